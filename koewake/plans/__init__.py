"""Input tables and the queries over them."""
