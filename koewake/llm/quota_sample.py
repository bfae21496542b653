"""Samples that match target proportions of categories (problem 4).

Method: every row gets a random but repeatable priority. One pass keeps, in each partition and for each category, a
reservoir of the rows with the lowest priorities, as many as the largest plan can want, and counts the category; two
reservoirs merge by keeping the lowest of both. When the counts are final, the quota of each plan and category is the
smaller of what is wanted and what there is, and the merged reservoir is trimmed to its rows of lowest priority, which
are a uniform sample. The trim finds the bin of priorities in which the quota ends and ranks within that bin only, so
no task holds a whole category. Categories that cannot meet their target are reported as exhausted.

Defined results: wanted is the larger of ``min_rows`` and ``target_share * sample_rows``, rounded up; null shares and
minimums count as 0; a category without rows has a quota of 0; rows of categories that no plan names are counted but
never kept; an empty table gives an empty sample and reports every category that is wanted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from koewake.functions.labels import clean_label
from koewake.session import materialise

BINS = 4096
#: Categories, and rows of plans, that are sent to every task at once; more categories take several passes, more rows are joined.
MOST_SENT = 100_000


def emotion_of(final: Column, audio: Column) -> Column:
    """The emotion of a row, in one spelling: the final one, else that of the audio, else neutral."""
    return F.coalesce(clean_label(final), clean_label(audio), F.lit("neutral"))


def wanted_rows(share: Column, size: Column, least: Column) -> Column:
    exact = F.round(F.coalesce(share, F.lit(0.0)) * F.coalesce(size, F.lit(0)), 6)
    return F.greatest(F.coalesce(least, F.lit(0)).cast("long"), F.ceil(exact).cast("long"))


def reservoirs(rows: DataFrame, category: Column, id_col: str, most: dict[str, int], seed: int = 0) -> DataFrame:
    """``(category, id, priority, n)``: per partition the kept rows (``n`` null), and the count of each category (``id`` null)."""
    src = rows.select(category.alias("category"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.lit(seed), id_col).alias("priority"))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[np.ndarray]] = {}
        count: dict[str, int] = {}
        size: dict[str, int] = {}
        for b in batches:
            cats = b.column(0).dictionary_encode()
            codes = cats.indices.to_numpy(zero_copy_only=False)
            ids, pr = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for code, name in enumerate(cats.dictionary.to_pylist()):
                at = codes == code
                count[name] = count.get(name, 0) + int(at.sum())
                k = most.get(name, 0)
                if not k:
                    continue
                kept.setdefault(name, []).append(np.stack([pr[at], ids[at]]))
                size[name] = size.get(name, 0) + int(at.sum())
                if size[name] > 2 * k + 10_000:
                    kept[name] = [_lowest(kept[name], k)]
                    size[name] = k
        for name, n in count.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([n], pa.int64())], ["category", "id", "priority", "n"])
            if name in kept:
                x = _lowest(kept.pop(name), most[name])
                m = x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(x[1]), pa.array(x[0]), pa.nulls(m, pa.int64())], ["category", "id", "priority", "n"])

    return src.mapInArrow(keep, "category string, id long, priority long, n long")


def _lowest(parts: list[np.ndarray], k: int) -> np.ndarray:
    x = np.concatenate(parts, axis=1)
    return x if x.shape[1] <= k else x[:, np.argpartition(x[0], k - 1)[:k]]


def _demands(plans: DataFrame) -> DataFrame:
    return plans.select("plan_id", F.col("emotion").alias("emotion"), clean_label(F.col("emotion")).alias("category"), wanted_rows(F.col("target_share"), F.col("sample_rows"), F.col("min_rows")).alias("wanted"))


def sample_by_plan(rows: DataFrame, plans: DataFrame, category: Column, id_col: str = "id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The sample ``(plan_id, emotion, id)`` and the report ``(plan_id, emotion, wanted, available, taken, exhausted)``.

    ``plans`` has ``plan_id``, ``emotion``, ``sample_rows``, ``target_share`` and ``min_rows``, and may have any number of rows.
    """
    asked = materialise(_demands(plans).where("category IS NOT NULL").groupBy("category").agg(F.max("wanted").alias("most"), F.count(F.lit(1)).alias("rows")), "asked")
    n, wants = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    passes = max(1, -(-n // MOST_SENT))
    turn = lambda c: F.pmod(F.xxhash64(c), F.lit(passes))
    states = []
    for i in range(passes):
        most = {r["category"]: r["most"] for r in asked.where(turn("category") == i).collect()}  # about MOST_SENT at most
        states.append(materialise(reservoirs(rows if passes == 1 else rows.where(turn(category) == i), category, id_col, most, seed), "reservoirs"))
    state = reduce(DataFrame.unionByName, states)
    counts = state.where("n is not null").groupBy("category").agg(F.sum("n").alias("available"))
    report = _demands(plans).join(counts, "category", "left").select(
        "plan_id", "emotion", "category", "wanted", F.coalesce("available", F.lit(0)).alias("available"),
        F.least("wanted", F.coalesce("available", F.lit(0))).alias("taken"),
    ).withColumn("exhausted", F.col("available") < F.col("wanted"))
    kept = state.where("id is not null").withColumn("bin", F.shiftright("priority", 52).cast("int"))
    upto = kept.groupBy("category", "bin").agg(F.count(F.lit(1)).alias("m"))
    upto = upto.withColumn("upto", F.sum("m").over(W.partitionBy("category").orderBy("bin")))  # at most BINS rows a category
    ends = report.where("taken > 0").join(upto, "category").groupBy("plan_id", "emotion", "category", "taken").agg(
        F.min(F.when(F.col("upto") >= F.col("taken"), F.col("bin"))).alias("last"),
        F.coalesce(F.max(F.when(F.col("upto") < F.col("taken"), F.col("upto"))), F.lit(0)).alias("before"),
    )
    chosen = kept.join(F.broadcast(ends) if wants <= MOST_SENT else ends, "category").where(F.col("bin") <= F.col("last"))
    inside = chosen.where(F.col("bin") < F.col("last")).select("plan_id", "emotion", "id")
    order = F.row_number().over(W.partitionBy("plan_id", "emotion").orderBy("priority", "id"))
    edge = chosen.where(F.col("bin") == F.col("last")).withColumn("place", order).where(F.col("place") <= F.col("taken") - F.col("before")).select("plan_id", "emotion", "id")
    return inside.unionByName(edge), report.drop("category")
