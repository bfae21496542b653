import pytest

from compare import canonical, views
from koewake.llm import queries

ORACLE = queries.oracle_sql()
FOUND = {"p1_found": ["id_a", "id_b"], "p2_found": ["id_a", "id_b"], "p4_found": ["plan_id", "emotion"], "p5_found": ["id", "lang"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, name):
    got, want = queries.queries()[name](spark, sf).toPandas(), views(sf).sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_over_the_tables(spark, sf, name):
    out = queries.queries()[name](spark, sf)
    if name in FOUND:
        assert out.columns == FOUND[name]
    n = out.count()
    assert n == 0 if name == "p6_round_trip" else n > 0
