"""Normalises the texts of done and filtered rows and decides again which of them are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koewake.functions import text as T


def _decided(rows: DataFrame, only: Column) -> DataFrame:
    """Rows with what the rules say of those that are done or filtered, and ``only``; each text is worked on once."""
    raw = F.coalesce("asr_text", F.lit(""))
    rows = rows.withColumn("_due", F.coalesce(F.col("status").isin("done", "filtered") & only, F.lit(False)))
    rows = rows.withColumns({"_blank": F.when(F.col("_due"), T.strip_blanks(raw) == ""), "_text": F.when(F.col("_due"), T.normalize_japanese(raw))})
    rows = rows.withColumn("_bare", T.bare_text(F.col("_text")))
    rows = rows.withColumn("_reason", F.when(~F.col("_blank"), T.reason_of(F.col("_text"), F.col("_bare"))))  # normal texts have no outer blanks
    rows = rows.withColumn("_status", F.when(~F.col("_blank"), F.when(F.col("_reason") != "", "filtered").otherwise("done")).otherwise(F.col("status")))
    return rows.withColumns({"_changed": F.coalesce(~F.col("_blank") & (F.col("_text") != raw), F.lit(False)), "_moved": F.col("_due") & (F.col("_status") != F.col("status"))}).drop("_bare")


def decide(cache: DataFrame) -> DataFrame:
    """Done and filtered rows with ``new_text, filter_reason, new_status`` and what changes: ``blank, changed, moved``.

    Blank and null texts are left as they are.
    """
    d = _decided(cache.where(F.col("status").isin("done", "filtered")), F.lit(True)).drop("_due")
    names = {"_blank": "blank", "_text": "new_text", "_reason": "filter_reason", "_status": "new_status", "_changed": "changed", "_moved": "moved"}
    return d.select(*(F.col(c) for c in cache.columns if c not in names.values()), *(F.col(c).alias(n) for c, n in names.items()))


def run(cache: DataFrame, now: Column | None = None, only: Column | None = None) -> DataFrame:
    """The cache after it, with ``filter_reason``; the text before the first change stays in ``raw_asr_text``.

    ``only``: which rows it is about. Each row is decided on its own: nothing is joined or shuffled.
    """
    d = _decided(cache, F.lit(True) if only is None else only)
    changed = F.col("_changed")
    values = {
        "raw_asr_text": F.when(changed, F.coalesce(F.nullif(F.col("raw_asr_text"), F.lit("")), F.col("asr_text"))).otherwise(F.col("raw_asr_text")),
        "asr_text": F.when(changed, F.col("_text")).otherwise(F.col("asr_text")),
        "status": F.col("_status"),
        "filter_reason": F.col("_reason"),
    }
    if now is not None:
        values["updated_at"] = F.when(changed | F.col("_moved"), now).otherwise(F.col("updated_at"))
    return d.withColumns(values).select(*cache.columns, *([] if "filter_reason" in cache.columns else ["filter_reason"]))


def stats(cache: DataFrame) -> DataFrame:
    """One row: total, normalized, filtered, unchanged; and exactly: newly filtered and restored rows."""
    d = decide(cache)
    return d.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("changed").alias("normalized"),
        F.count_if(~F.col("changed") & F.col("moved")).alias("filtered"),
        F.count_if(~F.col("blank") & ~F.col("changed") & ~F.col("moved")).alias("unchanged"),
        F.count_if(F.col("moved") & (F.col("new_status") == "filtered")).alias("newly_filtered"),
        F.count_if(F.col("moved") & (F.col("new_status") == "done")).alias("restored"),
    )
