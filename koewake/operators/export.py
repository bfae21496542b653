"""Versioned training sets: ``list.txt``, ``annotations.json`` and the files of each emotion."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from koewake.functions.text import pipe_escape
from koewake.session import materialise
from koewake.sources import files
from koewake.sources.files import Folder

VERSION = re.compile(r"^v(\d+)$")


def resolved_emotion() -> Column:
    """The final emotion, else that of the audio, else neutral; empty ones count as none."""
    return F.coalesce(F.nullif(F.col("emotion_final"), F.lit("")), F.nullif(F.col("emotion"), F.lit("")), F.lit("neutral"))


def latest(rows: DataFrame) -> DataFrame:
    """Of rows with one name in one directory only the newest."""
    w = W.partitionBy("source_dir", "file_name").orderBy(F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def list_lines(cache: DataFrame, speaker: str = "heroine", language: str = "ja") -> DataFrame:
    done = cache.where("status = 'done'")
    line = F.concat_ws("|", F.coalesce("file_path", F.lit("")), F.lit(speaker), F.lit(language), pipe_escape(F.col("asr_text")))
    return done.select("id", line.alias("line"))


def annotations(cache: DataFrame, language: str = "ja") -> DataFrame:
    """One JSON document for each done row; nulls are kept."""
    done = cache.where("status = 'done'").withColumn("_final", resolved_emotion())
    doc = F.struct(
        F.concat_ws("/", "_final", "file_name").alias("file"),
        F.col("file_path").alias("original_path"),
        pipe_escape(F.col("asr_text")).alias("text"),
        F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit(language)).alias("language"),
        F.struct(F.col("emotion").alias("audio"), F.col("text_emotion").alias("text_semantic"), F.col("_final").alias("final")).alias("emotion"),
        "confidence",
        "duration_ms",
        "file_hash",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("processed_at"),
    )
    return done.select("id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def emotion_counts(cache: DataFrame) -> DataFrame:
    return cache.where("status = 'done'").groupBy(resolved_emotion().alias("emotion")).agg(F.count(F.lit(1)).alias("n")).orderBy("emotion")


def next_version(names: Iterable[str]) -> int:
    """One more than the highest of ``v1, v2, ...``; 1 where there is none."""
    return max((int(m[1]) for n in names if (m := VERSION.match(n))), default=0) + 1


def next_version_of(names: DataFrame, column: str) -> DataFrame:
    n = F.try_to_number(F.regexp_extract(column, r"^v(\d+)$", 1), F.lit("999999999999999999"))
    return names.agg((F.coalesce(F.max(n), F.lit(0)).cast("long") + 1).alias("next_version"))


def _indented(last: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [json.dumps(json.loads(d), ensure_ascii=False, indent=2) + ("" if i == last else ",") for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])

    return run


def write(cache: DataFrame, root: str, speaker: str = "heroine", language: str = "ja", only_latest: bool = False, copy_files: bool = True) -> str:
    """Writes the next version under ``root`` and returns its path; an empty cache writes nothing and returns ``''``.

    The lines are sorted and written in parallel, and the parts joined to one file by the driver, which streams them.
    Recordings are copied by the executors. ``root`` may be on any file system that all of them see.
    """
    done = cache.where("status = 'done'")
    done = materialise(latest(done) if only_latest else done, "export").orderBy("id")
    last = done.agg(F.max("id")).first()[0]
    if last is None:
        return ""
    spark = cache.sparkSession
    out = f"{root.rstrip('/')}/v{next_version(Folder(spark, root).names())}"
    folder = Folder(spark, out)
    folder.make()
    list_lines(done, speaker, language).select("line").write.text(f"{out}/_lines")
    folder.join_parts("_lines", "list.txt")
    annotations(done, language).mapInArrow(_indented(last), "value string").write.text(f"{out}/_documents")
    folder.join_parts("_documents", "annotations.json", "[\n", "]\n")
    if copy_files:
        copied = done.select("file_path", resolved_emotion().alias("emotion"), "file_name").mapInArrow(_copy(out), "copied long")
        copied.agg(F.sum("copied")).collect()
    return out


def _copy(out: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = 0
            for src, emotion, name in zip(*(c.to_pylist() for c in b.columns)):
                to = "/".join([out, os.path.basename(emotion), os.path.basename(name)])
                if files.exists(src) and not files.exists(to):
                    files.copy(src, to)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["copied"])

    return run
