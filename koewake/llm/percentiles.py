"""Exact percentiles of a numeric column per group, and counts that combine over days or directories (problem 3).

Method: a full distributed sort. Equal values of a group are first counted together where they are read, so neither a
hot group nor a sentinel that fills a third of all rows reaches one task. The counted values are range-partitioned by
group and value and sorted; each partition counts what it holds of each group; the counts of the partitions before it
give its offsets; the target positions fall into known partitions, and the two neighbouring order statistics are
interpolated. The error is zero, in rank and in value.

The counted values are also the form in which results combine: ``combine`` adds those of several days or directories,
and percentiles of the sum equal percentiles of all rows.

Defined results: null and NaN values are left out, and no result tells how many they were; a null group is a group; a group with one value has it as every percentile; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from koewake.session import materialise

#: Offsets of (partition, group) up to this many are sent to every task; more are joined.
MOST_SENT = 100_000


def value_counts(df: DataFrame, groups: dict[str, Column], value: Column) -> DataFrame:
    """Rows ``(*groups, value, n)``: how often each group has each value. Counts combine by ``combine``."""
    v = value.cast("double")
    rows = df.select(*(c.alias(k) for k, c in groups.items()), F.when(~F.isnan(v), v).alias("value"))
    return rows.where(F.col("value").isNotNull()).groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("n"))


def combine(counts: Sequence[DataFrame], groups: Sequence[str]) -> DataFrame:
    """The sum of counted values; ``groups`` may be fewer than the parts were counted by."""
    parts = [c.select(*groups, "value", "n") for c in counts]
    return reduce(DataFrame.unionByName, parts).groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def _running(width: int):
    """Adds to each sorted row how many values its partition has of its group up to it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in b.columns[:width]:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(c[0].as_py() for c in b.columns[:width])
            n = b.column(width + 1).to_numpy(zero_copy_only=False)
            upto = np.cumsum(n)
            starts = np.flatnonzero(new)
            base = np.zeros(b.num_rows, np.int64)
            base[starts] = np.diff(np.concatenate([[0], upto[starts - 1]]))
            upto = upto - np.cumsum(base)
            if first == group:
                upto[: starts[0] if len(starts) else None] += total
            group, total = tuple(c[-1].as_py() for c in b.columns[:width]), int(upto[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto, pa.int64())], [*b.schema.names, "upto"])

    return run


def ranked(counts: DataFrame, groups: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows ``(*groups, value, n, before, total)``: counted values with the position of their first in the sorted group.

    This is the whole distribution of each group; every percentile can be read from it.
    """
    groups = list(groups)
    width = int(partitions or counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.select(*groups, "value", "n").repartitionByRange(width, *groups, "value").sortWithinPartitions(*groups, "value")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    schema = ", ".join([*(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in groups), "value double, n long, part int, upto long"])
    ordered = materialise(ordered.mapInArrow(_running(len(groups)), schema), "sorted")
    held = ordered.groupBy(*groups, "part").agg(F.sum("n").alias("held"))
    by_group = W.partitionBy(*groups)
    offsets = held.select(
        *groups, "part",
        (F.sum("held").over(by_group.orderBy("part")) - F.col("held")).alias("earlier"), F.sum("held").over(by_group).alias("total"),
    )
    offsets = materialise(offsets, "offsets")
    few = offsets.count() <= MOST_SENT
    on = reduce(Column.__and__, (ordered[c].eqNullSafe(offsets[c]) for c in [*groups, "part"]))
    both = ordered.join(F.broadcast(offsets) if few else offsets, on)
    return both.select(*(ordered[c] for c in groups), "value", "n", (F.col("earlier") + F.col("upto") - F.col("n")).alias("before"), "total")


def percentiles(counts: DataFrame, groups: Sequence[str], shares: Sequence[float], partitions: int | None = None) -> DataFrame:
    """Rows ``(*groups, n, share, percentile)``: exact percentiles of counted values, linear between neighbours."""
    groups = list(groups)
    values = ranked(counts, groups, partitions).withColumn("after", F.col("before") + F.col("n"))
    wanted = F.array(*(F.struct(F.lit(float(s)).alias("share"), ((F.col("total") - 1) * F.lit(float(s))).alias("at")) for s in shares))
    # a value holds the positions before .. after - 1; a target needs those at floor(at) and floor(at) + 1
    hit = F.filter(wanted, lambda t: (F.floor(t["at"]) >= F.col("before") - 1) & (F.floor(t["at"]) < F.col("after")))
    found = values.select(*groups, "value", "total", "before", "after", F.explode(hit).alias("t")).select("*", F.floor("t.at").alias("pos"))
    holds = lambda pos: (pos >= F.col("before")) & (pos < F.col("after"))
    lower, upper = (F.max(F.when(holds(F.col("pos") + step), F.col("value"))) for step in (0, 1))
    out = found.groupBy(*groups, F.col("total").alias("n"), F.col("t.share").alias("share")).agg(lower.alias("a"), upper.alias("b"), F.max(F.col("t.at") - F.col("pos")).alias("w"))
    return out.select(*groups, "n", "share", F.when(F.col("w") > 0, F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).otherwise(F.col("a")).alias("percentile"))
