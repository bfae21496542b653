"""Percentiles and samples."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from koewake.llm import percentiles as P
from koewake.llm import quota_sample as Q

SHARES = (0.0, 0.1, 0.5, 0.9, 1.0)


def test_percentiles_against_numpy(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.4 else r.choice("abc"), r.choice([0.0, 5.0, round(r.gauss(0, 9), 1)])) for _ in range(4000)]
    rows += [(None, 3.0), ("one", 7.0), ("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(x["g"], x["share"]): x["percentile"] for x in P.percentiles(P.value_counts(df, {"g": F.col("g")}, F.col("v")), ["g"], SHARES, 7).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert len(got) == len(groups) * len(SHARES)
    for (g, s), p in got.items():
        assert math.isclose(p, np.quantile(groups[g], s), abs_tol=1e-9), (g, s)


def test_combined_parts_equal_the_whole(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("day"), (F.col("id") * 37 % 101).cast("double").alias("v"), F.lit("x").alias("g"))
    parts = [P.value_counts(df.where(F.col("day") == d), {"g": F.col("g")}, F.col("v")) for d in range(7)]
    a = P.percentiles(P.combine(parts, ["g"]), ["g"], SHARES, 3).collect()
    b = P.percentiles(P.value_counts(df, {"g": F.col("g")}, F.col("v")), ["g"], SHARES, 9).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert P.percentiles(P.value_counts(df.limit(0), {"g": F.col("g")}, F.col("v")), ["g"], SHARES).count() == 0


def plans(spark, *rows):
    return spark.createDataFrame(rows, "plan_id long, emotion string, sample_rows long, target_share double, min_rows long")


def test_sample(spark):
    rows = [(i, "done", ("Neutral " if i % 3 else "ｓａｄ") if i % 50 else "angry", None) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, status string, emotion string, emotion_final string").repartition(6)
    p = plans(spark, (1, "neutral", 1000, 0.7, 0), (1, "sad", 1000, 0.2, 0), (1, "angry", 1000, 0.1, 90), (2, "angry", 100, 0.5, 500), (2, "sleepy", 10, 0.1, None), (3, "sad", 10, None, None))
    sample, report = Q.sample_by_plan(df, p, Q.emotion_of(F.col("emotion_final"), F.col("emotion")))
    rep = {(r["plan_id"], r["emotion"]): r for r in report.collect()}
    took = {(r["plan_id"], r["emotion"]): r["count"] for r in sample.groupBy("plan_id", "emotion").count().collect()}
    assert took == {(1, "neutral"): 700, (1, "sad"): 200, (1, "angry"): 100, (2, "angry"): 120}
    assert {k for k, r in rep.items() if r["exhausted"]} == {(2, "angry"), (2, "sleepy")}
    assert rep[(2, "sleepy")]["available"] == 0 and rep[(3, "sad")]["wanted"] == 0
    assert sample.distinct().count() == sample.count()
    assert sorted(sample.collect()) == sorted(Q.sample_by_plan(df.repartition(3), p, Q.emotion_of(F.col("emotion_final"), F.col("emotion")))[0].collect())  # partitions don't matter
    ids = np.array([r["id"] for r in sample.where("plan_id = 1 AND emotion = 'neutral'").collect()])
    assert abs(ids.mean() - 3000) < 300  # uniform
    none, rep = Q.sample_by_plan(df.limit(0), p, F.col("emotion"))
    assert none.count() == 0 and rep.where("exhausted").count() == 5


def test_many_categories_take_several_passes(spark, monkeypatch):
    df = spark.range(3000).select("id", F.concat(F.lit("c"), F.col("id") % 7).alias("c"))
    p = plans(spark, *((1, f"c{i}", 100, 0.2, 0) for i in range(8)), (2, "c3", 50, 0.5, 2))
    once = [sorted(map(tuple, x.collect())) for x in Q.sample_by_plan(df, p, F.col("c"))]
    monkeypatch.setattr(Q, "MOST_SENT", 3)
    assert [sorted(map(tuple, x.collect())) for x in Q.sample_by_plan(df, p, F.col("c"))] == once and len(once[0]) == 7 * 20 + 25


def test_reservoir_trims_in_one_pass(spark):
    df = spark.range(40_000).select("id", F.lit("c").alias("c")).coalesce(1)
    out = Q.reservoirs(df, F.col("c"), "id", {"c": 50})
    best = [r["id"] for r in df.orderBy(F.xxhash64(F.lit(0), "id")).limit(50).collect()]
    assert sorted(best) == sorted(r["id"] for r in out.where("id IS NOT NULL").collect())
    assert out.where("n IS NOT NULL").agg(F.sum("n")).first()[0] == 40_000


@pytest.mark.parametrize("share,size,least,want", [(0.1429, 3495, 0, 500), (0.1, 20, 0, 2), (0.05, 20, 3, 3), (None, None, None, 0), (0.3, 10, 0, 3)])
def test_wanted(spark, share, size, least, want):
    df = spark.createDataFrame([(share, size, least)], "s double, n long, m long")
    assert df.select(Q.wanted_rows(F.col("s"), F.col("n"), F.col("m"))).first()[0] == want
