"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import canonical, views
from koewake.plans import oracle, queries

NAMES = sorted(oracle.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    return views(sf)


def test_every_core_query_has_sql():
    assert set(queries.queries()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    got = queries.queries()[name](spark, sf).toPandas()
    want = duck.sql(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark, sf):
    out = entry.entry(spark)
    assert out.count() > 0 and "emotion" in out.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_llm_needs_it():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "koewake"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "koewake.llm" not in p.read_text(), p


def test_plans_prune_and_push_down(spark, sf):
    plan = queries.queries()["done_by_dir"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,done)]" in plan
    assert "asr_text" not in plan and "BatchEvalPython" not in plan
