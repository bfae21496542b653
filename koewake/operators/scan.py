"""What a scan found against the cache: which files are new, changed, known, or out of bounds.

A manifest has ``file_name, file_hash, file_path, file_size, duration_ms, source_dir`` and optionally ``sr_ok, sr_actual``.
Null durations pass the gate; repeated rows are classified each on its own; an empty cache makes every file new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koewake import schema as S
from koewake.functions.numbers import whole
from koewake.functions.paths import clean_dir


def gate(duration_ms: Column) -> Column:
    """``short``, ``long`` or ``ok``; the bounds themselves are ok."""
    return F.when(duration_ms < S.MIN_DURATION_MS, "short").when(duration_ms > S.MAX_DURATION_MS, "long").otherwise("ok")


def gate_message(duration_ms: Column) -> Column:
    """Why a file is out of bounds; null where it isn't."""
    seconds = F.bround(duration_ms / 1000, 1).cast("decimal(18,1)").cast("string")
    short = F.concat(F.lit("duration too short: "), whole(duration_ms), F.lit(f"ms < {S.MIN_DURATION_MS}ms"))
    long = F.concat(F.lit("duration too long: "), seconds, F.lit(f"s > {S.MAX_DURATION_MS // 1000}s"))
    return F.when(duration_ms < S.MIN_DURATION_MS, short).when(duration_ms > S.MAX_DURATION_MS, long)


def is_audio(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*S.SUFFIXES)


def classify(manifest: DataFrame, cache: DataFrame, strict: bool = False, per_directory: bool = False) -> DataFrame:
    """The manifest with ``scan_status``: skipped, cached, changed or new.

    A file is cached if its name and hash are done, or filtered unless ``strict``; changed if another file of its name
    is done. With ``per_directory`` only files of its own directory count, however it is spelled; files without one are
    never known then. Both look-ups are equi-joins on distinct keys, so no row is repeated.
    """
    known = ["done"] if strict else ["done", "filtered"]
    place = ["_place"] if per_directory else []
    if per_directory:
        manifest, cache = (x.withColumn("_place", clean_dir(F.col("source_dir"))) for x in (manifest, cache))
    keys = cache.where(F.col("status").isin(*known)).select("file_name", "file_hash", *place).distinct().withColumn("_cached", F.lit(True))
    names = cache.where(F.col("status") == "done").select("file_name", *place).distinct().withColumn("_named", F.lit(True))
    both = manifest.join(keys, ["file_name", "file_hash", *place], "left").join(names, ["file_name", *place], "left")
    status = F.when(gate(F.col("duration_ms")) != "ok", "skipped").when(F.col("_cached"), "cached").when(F.col("_named"), "changed").otherwise("new")
    return both.withColumn("scan_status", status).drop("_cached", "_named", *place)


def summary(classified: DataFrame, *by: str) -> DataFrame:
    """Counts of the classes, over all or by columns."""
    one = lambda s: F.count_if(F.col("scan_status") == s).alias(s)
    return classified.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(one(s) for s in ("cached", "new", "changed", "skipped")))


def warnings(classified: DataFrame) -> DataFrame:
    """One row for each warning: a wrong rate, a file too short or too long."""
    rate = F.when(~F.col("sr_ok"), F.concat(F.lit("[采样率] "), F.col("file_name"), F.lit(": 采样率 "), F.col("sr_actual").cast("string"), F.lit(f"Hz (需要 {S.SAMPLE_RATE}Hz)")))
    d = F.col("duration_ms")
    seconds = F.bround(d / 1000, 1).cast("decimal(18,1)").cast("string")
    short = F.when(d < S.MIN_DURATION_MS, F.concat(F.lit("[太短] "), F.col("file_name"), F.lit(": "), whole(d), F.lit(f"ms (最低 {S.MIN_DURATION_MS}ms)")))
    long = F.when(d > S.MAX_DURATION_MS, F.concat(F.lit("[太长] "), F.col("file_name"), F.lit(": "), seconds, F.lit(f"s (最大 {S.MAX_DURATION_MS // 1000}s)")))
    return classified.select("file_name", F.explode(F.array_compact(F.array(rate, short, long))).alias("warning"))
