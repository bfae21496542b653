"""The cache as whole snapshots: ``root/v<N>`` written beside the old ones, and a pointer that moves when one is complete."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from koewake.functions.paths import clean_dir
from koewake.schema import AUDIO_CACHE

#: The column by which versions are partitioned; it isn't part of the rows.
PART = "part_directory"
_NAME = re.compile(r"^v(\d+)$")


class Snapshots:
    """Versions of one table under ``root``, which may be any path that Hadoop's file systems know.

    A version counts once its ``_SUCCESS`` is there, so a job that dies leaves the last version current.
    """

    def __init__(self, spark: SparkSession, root: str, schema=AUDIO_CACHE) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, path, fs = self._fs()
        if not fs.exists(path):
            return []
        found = []
        for s in fs.listStatus(path):
            m = _NAME.match(s.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                found.append(int(m[1]))
        return sorted(found)

    def read(self, version: int | None = None, directory: str | None = None) -> DataFrame:
        """A version, the last one without a number; an empty table where there is none.

        With ``directory``, in its one spelling, only the rows that lie in it: other directories' files aren't opened.
        """
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        whole = StructType([*self.schema.fields, StructField(PART, StringType())])
        rows = self.spark.read.schema(whole).parquet(f"{self.root}/v{have[-1] if version is None else version}")
        return (rows.where(F.col(PART) == directory) if directory else rows).drop(PART)

    def write(self, df: DataFrame) -> int:
        """Writes the next version, partitioned by directory, and returns its number.

        Rows of a directory are brought together, but for large ones, which are split while they are shuffled.
        """
        jvm, path, fs = self._fs()
        taken = [int(m[1]) for s in (fs.listStatus(path) if fs.exists(path) else []) if (m := _NAME.match(s.getPath().getName()))]
        n = max(taken, default=0) + 1
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], clean_dir(F.col("source_dir")).alias(PART))
        rows.hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(f"{self.root}/v{n}")
        return n

    def drop_before(self, keep: int = 2) -> None:
        """Deletes all but the last ``keep`` versions."""
        jvm, _, fs = self._fs()
        for n in self.versions()[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{n}"), True)
