"""Pairs of rows that share a key, safe against keys that hold a great part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koewake.session import materialise

#: Rows of a key beyond which its rows are spread over several tasks.
HOT = 20_000
#: Keys with more rows than a part has; there can't be more of them, as a part has at least this share of all rows.
MOST_HOT = 100_000


def meet(rows: DataFrame, keyed: DataFrame, keys: list[str], id_col: str, how: str = "inner", hot: int = HOT) -> DataFrame:
    """``rows`` joined with the fewer rows of ``keyed``, which know the rows of their key, ``n``.

    The rows of a hot key are cut into parts by a hash of ``id_col``, and what ``keyed`` has of it goes to each. Which keys
    are hot is sent to every task: at most ``MOST_HOT`` keys. ``keyed`` must be cheap to read twice.
    """
    total, most = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    size = max(hot, total // MOST_HOT)
    if most <= size:
        return rows.join(keyed.drop("n") if how == "left_semi" else keyed, keys, how)
    parts = F.when(F.col("n") > size, F.ceil(F.col("n") / size)).otherwise(1).cast("int")
    hottest = keyed.where(F.col("n") > size).groupBy(*keys).agg(F.max(parts).alias("_parts"))
    salt = F.pmod(F.xxhash64(F.lit(7), id_col), F.coalesce("_parts", F.lit(1))).cast("int")
    a = rows.join(F.broadcast(hottest), keys, "left").withColumn("_salt", salt).drop("_parts")
    b = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return a.join(b.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def with_several(rows: DataFrame, keys: list[str], id_col: str, variant: str) -> DataFrame:
    """Rows of keys that have more than one value of ``variant``."""
    several = rows.groupBy(*keys).agg(F.min(variant).alias("lo"), F.max(variant).alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    return meet(rows, materialise(several.select(*keys, "n"), "several"), keys, id_col, "left_semi")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")]


def _blocks(n: str, hot: int) -> Column:
    return F.ceil(F.col(n) / hot).cast("int")


def _every(blocks: str = "blocks") -> Column:
    """A copy for each block."""
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _one_of(x: str, blocks: str = "blocks") -> Column:
    return F.pmod(F.xxhash64(F.lit(3), x), F.col(blocks)).cast("int")


def pairs_of_variants(rows: DataFrame, keys: list[str], id_col: str, variant: str, hot: int = HOT) -> DataFrame:
    """All ``(id_a, id_b)``, ``id_a < id_b``, of rows with equal ``keys`` and different ``variant``.

    Variants are paired first and then their rows, so a variant that fills a key is never compared with itself. A key
    with many variants, and a variant with many rows, is cut into blocks of ``hot``, and the other side goes to each.
    Null keys and variants make no pairs. ``rows`` must be cheap to read several times.
    """
    known = rows.select(*keys, F.col(variant).alias("x"), F.col(id_col).alias("id")).where("x IS NOT NULL")
    sizes = materialise(known.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("m")), "sizes")
    several = materialise(sizes.groupBy(*keys).agg(F.count("x").alias("n")).where("n > 1"), "several")
    each = meet(sizes, several, keys, "x", hot=hot).withColumn("blocks", _blocks("n", hot)).drop("n")
    one = each.withColumn("block", _every()).drop("blocks").withColumnsRenamed({"x": "x_a", "m": "m_a"})
    two = each.withColumn("block", _one_of("x")).drop("blocks").withColumnsRenamed({"x": "x_b", "m": "m_b"})
    larger = (F.col("m_a") > F.col("m_b")) | ((F.col("m_a") == F.col("m_b")) & (F.col("x_a") < F.col("x_b")))
    paired = materialise(one.join(two, [*keys, "block"]).where(larger).select(*keys, "x_a", "x_b", "m_a", "m_b"), "variants")
    side = lambda x, m: paired.withColumnsRenamed({x: "x", m: "n"}).withColumn("blocks", F.ceil((F.col("n") if m == "m_a" else F.col("m_a")) / hot).cast("int"))
    a = meet(known, side("x_a", "m_a"), [*keys, "x"], "id", hot=hot).withColumnsRenamed({"x": "x_a", "id": "id_1"})
    b = meet(known, side("x_b", "m_b"), [*keys, "x"], "id", hot=hot).withColumnsRenamed({"x": "x_b", "id": "id_2"})
    a = a.withColumn("block", _one_of("id_1")).select(*keys, "x_a", "x_b", "block", "id_1")
    b = b.withColumn("block", _every()).select(*keys, "x_a", "x_b", "block", "id_2")
    return a.join(b.hint("merge"), [*keys, "x_a", "x_b", "block"]).select(*_ordered("id_1", "id_2"))


def pairs_within(rows: DataFrame, keys: list[str], id_col: str, fresh: str | None = None, hot: int = HOT, keep: str | None = None) -> DataFrame:
    """All ``(id_a, id_b)``, ``id_a < id_b``, of rows with equal ``keys``; with ``keep`` also that column of both, in no order.

    ``fresh``: only pairs of which at least one row is true in that column. ``rows`` must be cheap to read several times.
    Rows of a key with more than ``hot`` rows are cut into blocks, and the other side of the pairs goes to every block,
    so no task pairs a whole key. Null keys make no pairs.
    """
    known = rows.select(*keys, F.col(id_col).alias("id"), (F.col(fresh) if fresh else F.lit(True)).alias("fresh"), *([F.col(keep).alias("keep")] if keep else []))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("any")).where((F.col("n") > 1) & F.col("any")).drop("any")
    sizes = materialise(sizes, "sizes")
    known = meet(known, sizes, keys, "id", hot=hot).withColumn("blocks", _blocks("n", hot)).drop("n")
    a = known.where("fresh").withColumn("block", _every()).drop("blocks", "fresh").withColumnsRenamed({"id": "id_1", "keep": "keep_1"})
    b = known.withColumn("block", _one_of("id")).drop("blocks").withColumnsRenamed({"id": "id_2", "keep": "keep_2"})
    once = (F.col("id_1") < F.col("id_2")) | (~F.col("fresh") & (F.col("id_1") != F.col("id_2")))
    return a.join(b, [*keys, "block"]).where(once).select(*_ordered("id_1", "id_2"), *(["keep_1", "keep_2"] if keep else []))


def class_sizes(rows: DataFrame, keys: list[str], id_col: str, variant: str, hot: int = HOT) -> DataFrame:
    """One row per row: its id, the least id of the rows with its ``keys``, their number, and that of their variants."""
    each = rows.groupBy(*keys, variant).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("least"))
    sizes = materialise(each.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(variant).alias("texts"), F.min("least").alias("class_id")), "classes")
    return meet(rows, sizes, keys, id_col, hot=hot).select(id_col, "class_id", F.col("n").alias("rows"), "texts")
