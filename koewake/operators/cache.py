"""Changes of the cache, each a pure function from one state of it to the next.

Parquet has no updates: a new state is written as a whole beside the old one (``sources.snapshots``). The key is
``(file_name, file_hash)``. Incoming rows that repeat a key are reduced to the last by directory and path. ``now`` is
the time that changed rows get; without it their old time stays, which keeps results repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from koewake.session import materialise

KEY = ["file_name", "file_hash"]


def _touched(change: Column, now: Column | None) -> dict[str, Column]:
    return {} if now is None else {"updated_at": F.when(change, now).otherwise(F.col("updated_at"))}


def last_of_key(rows: DataFrame) -> DataFrame:
    """One row for each key: the last by directory and path."""
    w = W.partitionBy(*KEY).orderBy(F.col("source_dir").desc_nulls_last(), F.col("file_path").desc_nulls_last(), F.col("file_size").desc_nulls_last(), F.col("duration_ms").desc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_pending(cache: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """Incoming keys become pending, new ones get ids after the highest by path; all other rows stay.

    A column ``issue``, where ``incoming`` has it, makes its rows filtered instead, for that issue. Which keys are new is found from keys alone; the cache itself is joined once. New ids come from counts per sorted
    partition, not from one task.
    """
    new_values = ["file_path", "file_size", "duration_ms", "source_dir"]
    issue = "issue" in incoming.columns
    src = last_of_key(incoming.select(*KEY, *new_values, *(["issue"] if issue else [])))
    keys = cache.select(*KEY)
    fresh = _numbered(src.join(keys, KEY, "left_anti"), cache.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    src = src.join(keys, KEY, "left_semi").withColumn("id", F.lit(None).cast("long")).unionByName(fresh)
    src = src.select(*KEY, F.col("id").alias("_id"), *(F.col(c).alias("_" + c) for c in new_values), (F.col("issue") if issue else F.lit(None).cast("string")).alias("_issue"), F.lit(True).alias("_in"))
    hit = F.coalesce(F.col("_in"), F.lit(False))
    state = F.when(F.col("_issue").isNotNull(), "filtered").otherwise("pending")
    return cache.join(src, KEY, "full_outer").withColumns(
        {c: F.when(hit, F.col("_" + c)).otherwise(F.col(c)) for c in new_values}
        | {"id": F.coalesce("id", "_id"), "status": F.when(hit, state).otherwise(F.col("status")), "error_msg": F.when(~hit, F.col("error_msg"))}
        | ({"quality_issues": F.coalesce("_issue", "quality_issues")} if issue else {})
        | ({} if now is None else {"updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "created_at": F.coalesce("created_at", now)})
    ).select(*cache.columns)


def _numbered(rows: DataFrame, top: int) -> DataFrame:
    """Rows with ids after ``top``, in the order of path and key: a distributed sort, and counts of its partitions."""
    new = rows.repartitionByRange("file_path", *KEY).sortWithinPartitions("file_path", *KEY)
    new = materialise(new.withColumn("_at", F.monotonically_increasing_id()), "new-ids")  # partition and place in it
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    held = new.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_held"))
    offsets = held.select("_part", (F.sum("_held").over(W.orderBy("_part")) - F.col("_held")).alias("_before"))  # a row for each partition
    numbered = new.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.select(*rows.columns, (F.col("_before") + place + F.lit(top + 1)).alias("id"))


def mark_processing(cache: DataFrame, keys: DataFrame, now: Column | None = None) -> DataFrame:
    hit = cache.join(keys.select(*KEY).distinct().withColumn("_hit", F.lit(True)), KEY, "left")
    change = F.coalesce("_hit", F.lit(False))
    return hit.withColumns({"status": F.when(change, "processing").otherwise(F.col("status"))} | _touched(change, now)).select(*cache.columns)


RESULT = ["status", "asr_text", "emotion", "language", "asr_raw", "confidence", "quality_issues", "raw_asr_text"]


def write_back(cache: DataFrame, results: DataFrame, now: Column | None = None) -> DataFrame:
    """Results by key: their values replace those of the row; a directory only where one is given.

    Results without a row are dropped. An error sets status and message only.
    """
    src = results.select(*KEY, *(F.col(c).alias("_" + c) for c in RESULT), *(F.col(c).alias("_" + c) if c in results.columns else F.lit(None).cast("string").alias("_" + c) for c in ("source_dir", "error_msg")), F.lit(True).alias("_in"))
    both = cache.join(src, KEY, "left")
    hit = F.coalesce("_in", F.lit(False))
    error = hit & (F.col("_status") == "error")
    fine = hit & ~F.coalesce(error, F.lit(False))
    values = {c: F.when(fine, F.col("_" + c)).otherwise(F.col(c)) for c in RESULT if c not in ("status", "raw_asr_text", "quality_issues")}
    values |= {
        "status": F.when(hit, F.col("_status")).otherwise(F.col("status")),
        "raw_asr_text": F.when(fine, F.coalesce("_raw_asr_text", F.lit(""))).otherwise(F.col("raw_asr_text")),
        "quality_issues": F.when(fine, F.coalesce("_quality_issues", F.lit("[]"))).otherwise(F.col("quality_issues")),
        "source_dir": F.when(fine & (F.length("_source_dir") > 0), F.col("_source_dir")).otherwise(F.col("source_dir")),
        "error_msg": F.when(error, F.col("_error_msg")).otherwise(F.col("error_msg")),
    }
    return both.withColumns(values | _touched(hit, now)).select(*cache.columns)


def reset_errors(cache: DataFrame, now: Column | None = None) -> DataFrame:
    change = F.coalesce(F.col("status") == "error", F.lit(False))
    return cache.withColumns({"status": F.when(change, "pending").otherwise(F.col("status")), "error_msg": F.when(~change, F.col("error_msg"))} | _touched(change, now))


def fill_duration(cache: DataFrame, probed: DataFrame) -> DataFrame:
    """Durations where the row has none; several probes of a key give the longest."""
    best = probed.where("duration_ms IS NOT NULL").groupBy(*KEY).agg(F.max("duration_ms").alias("_probed"))
    return cache.join(best, KEY, "left").withColumn("duration_ms", F.coalesce("duration_ms", "_probed")).select(*cache.columns)


def fill_source_dir(cache: DataFrame, dirs: DataFrame) -> DataFrame:
    """The directory of rows without one: the longest registered directory that their path lies in.

    ``dirs`` has ``dir_path``. Paths are compared step by step through their parents, so the join stays on equality.
    """
    steps = F.split("file_path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    lacking = cache.where("source_dir IS NULL OR source_dir = ''").select("id", F.explode(parents).alias("dir_path"))
    found = lacking.join(dirs.select("dir_path").distinct(), "dir_path").groupBy("id").agg(F.max_by("dir_path", F.length("dir_path")).alias("_dir"))
    return cache.join(found, "id", "left").withColumn("source_dir", F.coalesce(F.nullif(F.col("source_dir"), F.lit("")), F.col("_dir"), F.col("source_dir"))).select(*cache.columns)


def rename(cache: DataFrame, renames: DataFrame) -> DataFrame:
    """New names, hashes and paths after transcoding: ``renames`` has the key and ``new_name, new_hash, new_path``."""
    both = cache.join(renames.select(*KEY, "new_name", "new_hash", "new_path"), KEY, "left")
    return both.withColumns({c: F.coalesce(n, c) for c, n in (("file_name", "new_name"), ("file_hash", "new_hash"), ("file_path", "new_path"))}).select(*cache.columns)


def pending(cache: DataFrame, source_dir: Column | None = None) -> DataFrame:
    rows = cache.where("status = 'pending'")
    return rows if source_dir is None else rows.where(F.col("source_dir") == source_dir)
