"""Operators for the text and sampling problems of a training-data pipeline. Nothing outside this folder imports it."""
