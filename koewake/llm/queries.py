"""The queries of the problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from koewake.llm import encode, history, langid, leakage, lookalike, percentiles, quality, quota_sample
from koewake.functions.labels import clean_label
from koewake.functions.paths import clean_dir
from koewake.plans.oracle import dir_sql, label_sql
from koewake.plans.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, lookalike.Rules]:
    """The texts, and the rules that all of them give: the same for every query of problem 1."""
    rows = load(spark, sf_dir, "audio_cache", "id", "asr_text", "raw_asr_text")
    return rows, lookalike.rules_of(rows, ["asr_text", "raw_asr_text"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, made = _texts(spark, sf_dir)
    return lookalike.looking_alike(rows, "id", "asr_text", "raw_asr_text", made)


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, made = _texts(spark, sf_dir)
    return lookalike.consistent(rows, ["asr_text", "raw_asr_text"], ["id"], made=made)


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each row: the same as p1_found without its pairs."""
    rows, made = _texts(spark, sf_dir)
    return lookalike.classes(rows, "id", "asr_text", "raw_asr_text", made)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "audio_cache", "id", "file_hash", "file_name", "source_dir", "created_at")
    return history.same_recordings(rows, day="created_at")


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row of the latest day, what the history before it covers."""
    rows = load(spark, sf_dir, "audio_cache", "id", "file_hash", "file_name", "source_dir", "created_at")
    return history.covered_by_history(rows, "created_at")


SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted durations per directory and per emotion; what isn't above zero is no duration and left out."""
    rows = load(spark, sf_dir, "audio_cache", "duration_ms", "emotion_final", "source_dir", "created_at")
    both = F.array(
        F.struct(F.lit("emotion_final").alias("grouping"), clean_label(F.col("emotion_final")).alias("key")),
        F.struct(F.lit("source_dir").alias("grouping"), clean_dir(F.col("source_dir")).alias("key")),
    )
    rows = rows.where("duration_ms > 0").select("duration_ms", F.explode(both).alias("g"))
    return percentiles.value_counts(rows, {"grouping": F.col("g.grouping"), "key": F.col("g.key")}, F.col("duration_ms"))


def p3_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole distribution of durations per emotion and per directory: the form in which results combine."""
    return percentiles.ranked(_durations(spark, sf_dir), ["grouping", "key"])


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = percentiles.percentiles(_durations(spark, sf_dir), ["grouping", "key"], SHARES)
    return out.select("grouping", "key", "n", "share", (F.floor(F.col("percentile") * 1024 + 0.5) / F.lit(1024.0)).alias("duration_ms"))


def p3_combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The medians of each directory by month, combined from counts that were made by day; of durations above zero."""
    rows = load(spark, sf_dir, "audio_cache", "duration_ms", "source_dir", "created_at").where("duration_ms > 0")
    daily = percentiles.value_counts(rows, {"dir": clean_dir(F.col("source_dir")), "day": F.to_date("created_at")}, F.col("duration_ms"))
    monthly = percentiles.combine([daily.withColumn("month", F.date_format("day", "yyyy-MM"))], ["dir", "month"])
    out = percentiles.percentiles(monthly, ["dir", "month"], (0.5, 0.9))
    return out.select("dir", "month", "n", "share", (F.floor(F.col("percentile") * 1024 + 0.5) / F.lit(1024.0)).alias("duration_ms"))


def _plans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "audio_cache", "id", "status", "emotion", "emotion_final").where("status = 'done'")
    return quota_sample.sample_by_plan(rows, load(spark, sf_dir, "sample_targets"), quota_sample.emotion_of(F.col("emotion_final"), F.col("emotion")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir)[1].where("exhausted").select("plan_id", "emotion")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir)[1]


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir)[0]


def p4_sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows the sample has of each plan and emotion."""
    return p4_sample(spark, sf_dir).groupBy("plan_id", "emotion").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.wrong_labels(load(spark, sf_dir, "audio_cache", "id", "asr_text", "language"), "id", "asr_text", "language")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_segments(load(spark, sf_dir, "audio_cache", "id", "asr_text", "language"), "id", "asr_text", "language")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(load(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text does not come back from its ids: none."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    back = encode.decode(encode.encode(docs, "doc_id", "text"), "doc_id").withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").where(F.coalesce("text", F.lit("")) != F.col("decoded")).select("doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "eval_items"))


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p7_found, and passages with an edit in the run."""
    return leakage.leaks(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "eval_items"), exact=False)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(load(spark, sf_dir, "documents", "doc_id", "text"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(load(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Query]:
    all_of = (p1_found, p1_forms, p1_classes, p2_found, p2_coverage, p3_ranks, p3_percentiles, p3_combined_days, p4_found, p4_report, p4_sample, p4_sample_sizes, p5_found, p5_segments, p6_ids, p6_round_trip, p7_found, p7_near, p8_found, p8_statistics)
    return {f.__name__: f for f in all_of}


def _shares_sql(groups: str, source: str, shares: tuple[float, ...]) -> str:
    """DuckDB's own exact percentiles, one row for each share."""
    one = "SELECT {g}, count(*) AS n, CAST({s} AS DOUBLE) AS share, floor(quantile_cont(duration_ms, {s}) * 1024 + 0.5) / 1024.0 AS duration_ms FROM x GROUP BY ALL"
    return f"WITH x AS ({source}) " + " UNION ALL ".join(one.format(g=groups, s=s) for s in shares)


def _p4_sql() -> str:
    emotion = f"coalesce({label_sql('emotion_final')}, {label_sql('emotion')}, 'neutral')"
    return f"""
        WITH c AS (SELECT {emotion} AS category, count(*) AS available FROM audio_cache WHERE status = 'done' GROUP BY 1),
        w AS (SELECT plan_id, emotion, {label_sql('emotion')} AS category,
                     greatest(coalesce(min_rows, 0), CAST(ceil(round(coalesce(target_share, 0) * coalesce(sample_rows, 0), 6)) AS BIGINT)) AS wanted FROM sample_targets)
        SELECT plan_id, emotion, wanted, coalesce(available, 0) AS available, least(wanted, coalesce(available, 0)) AS taken, coalesce(available, 0) < wanted AS exhausted
        FROM w LEFT JOIN c USING (category)"""


def oracle_sql() -> dict[str, str]:
    positive = "FROM audio_cache WHERE duration_ms > 0"
    label, place = label_sql("emotion_final"), dir_sql("source_dir")
    durations = f"SELECT 'emotion_final' AS grouping, {label} AS key, duration_ms {positive} UNION ALL SELECT 'source_dir', {place}, duration_ms {positive}"
    return {
        "p3_ranks": f"""
            WITH c AS (SELECT grouping, key, duration_ms AS value, count(*) AS n FROM ({durations}) GROUP BY ALL)
            SELECT *, CAST(sum(n) OVER (PARTITION BY grouping, key ORDER BY value) AS BIGINT) - n AS before, CAST(sum(n) OVER (PARTITION BY grouping, key) AS BIGINT) AS total FROM c""",
        "p3_percentiles": _shares_sql("grouping, key", durations, SHARES),
        "p3_combined_days": _shares_sql("dir, month", f"SELECT {place} AS dir, strftime(created_at, '%Y-%m') AS month, duration_ms {positive}", (0.5, 0.9)),
        "p4_found": f"SELECT plan_id, emotion FROM ({_p4_sql()}) WHERE exhausted",
        "p4_report": _p4_sql(),
        "p4_sample_sizes": f"SELECT plan_id, emotion, taken AS rows, taken AS ids FROM ({_p4_sql()}) WHERE taken > 0",
        "p6_round_trip": "SELECT doc_id FROM documents WHERE false",
    }
