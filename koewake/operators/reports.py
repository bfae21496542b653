"""Counts, shares and listings of the cache, each one pass over it.

An empty cache gives no rows, or zeros where there is one row for all. Null statuses count in totals only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from koewake import schema as S
from koewake.functions.numbers import bar, percent
from koewake.functions.text import preview

ISSUES = "array<string>"


def has_issues(x: Column) -> Column:
    return x.isNotNull() & (x != "[]") & (x != "")


def in_dir(cache: DataFrame, source_dir: str | None = None) -> DataFrame:
    """Rows of a directory; of all where none or an empty one is given."""
    return cache.where(F.col("source_dir") == source_dir) if source_dir else cache


def status_counts(cache: DataFrame, *by: str) -> DataFrame:
    return cache.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in S.STATUSES))


def dashboard(cache: DataFrame, *by: str) -> DataFrame:
    """Totals, statuses, rows with issues and rows with corrected text."""
    return cache.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col("status") == s).alias(s) for s in S.STATUSES),
        F.count_if(has_issues(F.col("quality_issues"))).alias("quality_issues"),
        F.count_if(F.col("raw_asr_text") != "").alias("corrected"),
    )


def emotion_histogram(cache: DataFrame) -> DataFrame:
    """Done rows by emotion, with share and bar; most frequent first, then by name."""
    counts = cache.where("status = 'done'").groupBy("emotion").agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy()  # a few rows, one for each emotion
    shares = counts.withColumns({"total": F.sum("n").over(everything), "most": F.max("n").over(everything)})
    return shares.select("emotion", "n", percent(F.col("n"), F.col("total")).alias("share"), bar(F.col("n"), F.col("most")).alias("bar")).orderBy(F.desc("n"), "emotion")


def neutral_alert(cache: DataFrame, *by: str) -> DataFrame:
    """Where more than 70 percent of the done rows are neutral."""
    n = cache.where("status = 'done'").groupBy(*by).agg(F.count(F.lit(1)).alias("done"), F.count_if(F.col("emotion") == "neutral").alias("neutral"))
    return n.withColumn("alert", F.coalesce(F.try_divide(F.col("neutral") * F.lit(100.0), F.col("done")) > S.NEUTRAL_ALERT, F.lit(False)))


def _short(issue: Column) -> Column:
    return F.when(issue == "", "?").otherwise(F.split(F.split(issue, ":")[0], " ")[0])


def reasons(cache: DataFrame) -> DataFrame:
    """Why rows were filtered or failed: errors together, rows with issues by each, the rest as fillers.

    Most frequent first, then by first appearance. Issues that are no JSON count as one issue with their whole text.
    """
    rows = cache.where(F.col("status").isin("filtered", "error"))
    parsed = F.coalesce(F.from_json("quality_issues", ISSUES), F.array("quality_issues"))
    found = F.when(F.col("status") == "error", F.array(F.lit("API 错误"))).when(has_issues(F.col("quality_issues")), F.transform(F.filter(parsed, lambda x: x.isNotNull()), _short)).otherwise(F.array(F.lit("语气词/噪声过滤")))
    each = rows.select("id", F.explode(found).alias("reason"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("n"), "first_id", "reason")


def issue_kinds(cache: DataFrame) -> DataFrame:
    """Issues of all rows by kind; those that are no JSON are left out."""
    each = cache.where(has_issues(F.col("quality_issues"))).select("id", F.explode(F.from_json("quality_issues", ISSUES)).alias("issue")).where("issue IS NOT NULL")
    return each.groupBy(_short(F.col("issue")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def page(cache: DataFrame, status: str | None = None, source_dir: str | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    """A page of rows by id, without the raw responses."""
    rows = in_dir(cache, source_dir)
    rows = rows.where(F.col("status") == status) if status else rows
    return rows.drop("asr_raw").orderBy("id").offset(offset).limit(limit)


def page_total(cache: DataFrame, status: str | None = None, source_dir: str | None = None) -> DataFrame:
    rows = in_dir(cache, source_dir)
    return (rows.where(F.col("status") == status) if status else rows).agg(F.count(F.lit(1)).alias("total"))


def review(cache: DataFrame, limit: int = 50, size: int = 60, default: str = "") -> DataFrame:
    """The first filtered and failed rows by id, with a preview of text or error."""
    rows = cache.where(F.col("status").isin("filtered", "error"))
    return rows.select("id", "file_name", "status", "quality_issues", preview(F.col("asr_text"), F.col("error_msg"), size, default).alias("preview")).orderBy("id").limit(limit)


def done_by_dir(cache: DataFrame) -> DataFrame:
    return cache.where("status = 'done'").groupBy("source_dir").agg(F.count(F.lit(1)).alias("done"), F.sum("duration_ms").alias("duration_ms"))


def registered_stats(registry: DataFrame, cache: DataFrame) -> DataFrame:
    """Every registered directory with its counts; zeros where it has no rows. Both sides are in one spelling."""
    counts = status_counts(cache, "dir_path")
    names = ["total", *S.STATUSES]
    return registry.join(counts, "dir_path", "left").select(*registry.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def progress_events(cache: DataFrame) -> DataFrame:
    """A server-sent event for each row that is finished: what a listener of the whole run was told."""
    ended = cache.where(F.col("status").isin("done", "error", "filtered"))
    what = F.to_json(F.struct(F.col("id").alias("id"), F.when(F.col("status") == "error", "error").otherwise("ok").alias("status")))
    return ended.select("id", F.concat(F.lit("event: progress\ndata: "), what, F.lit("\n\n")).alias("event"))
