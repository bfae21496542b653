"""Directories of audio files as a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from koewake import schema as S
from koewake.functions.paths import clean_dir
from koewake.operators import convert
from koewake.operators.scan import is_audio
from koewake.sources import wav

#: Larger files are listed without content, and hashed and measured by path; clips are far smaller.
MOST_BYTES = 512 << 20
FILE_SCHEMA = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def bounded(files: DataFrame) -> DataFrame:
    """Files with their content, null above ``MOST_BYTES``: of those no byte is read here."""
    large = files.drop("content").where(F.col("length") > MOST_BYTES).withColumn("content", F.lit(None).cast("binary"))
    return files.where(F.col("length") <= MOST_BYTES).unionByName(large)


def listing(spark: SparkSession, directory: str, with_content: bool = True) -> DataFrame:
    """The audio files directly in a directory: ``path, modificationTime, length`` and their content."""
    files = spark.read.format("binaryFile").load(directory).where(is_audio(F.col("path")))
    return bounded(files) if with_content else files.drop("content")


def as_manifest(files: DataFrame) -> DataFrame:
    """Files as rows of a manifest, hashed and probed in one pass over their bytes; those without content by path."""
    plain = F.regexp_replace(F.col("path"), r"^file:(?://)?(?=/)", "")
    keyed = files.select(plain.alias("file_path"), F.col("length").alias("file_size"), F.md5("content").alias("file_hash"), "content")
    probed = wav.probe(keyed)
    is_wav = F.lower("file_path").endswith(".wav")
    rows = probed.withColumns(
        {
            "file_name": F.regexp_extract("file_path", r"([^/]+)$", 1),
            "source_dir": clean_dir(F.regexp_extract("file_path", r"^(.*)/[^/]+$", 1)),
            "sr_ok": ~is_wav | F.coalesce(F.col("sample_rate") == S.SAMPLE_RATE, F.lit(False)),
            "sr_actual": F.when(is_wav, F.col("sample_rate")),
        }
        | wav.verdict()
    )
    return rows.select("file_name", "file_hash", "file_path", "file_size", "duration_ms", "source_dir", "sr_ok", "sr_actual", "issues", "passed")


def manifest(spark: SparkSession, directory: str, converter: convert.Converter | None = None) -> DataFrame:
    """The files of a directory as a manifest, by name; with a converter also the durations of other types than WAV."""
    rows = as_manifest(listing(spark, directory))
    if converter:
        known = convert.probed(convert.others(rows.select("file_path")), converter).select("file_path", F.col("duration_ms").alias("_probed"))
        rows = rows.join(known, "file_path", "left").withColumn("duration_ms", F.coalesce("duration_ms", "_probed")).select(*rows.columns)
    return rows.orderBy("file_name", "file_path")
