"""New recordings as a stream of files into the cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from koewake.operators import cache as C
from koewake.operators import scan
from koewake.operators.scan import is_audio
from koewake.session import materialise, new_path
from koewake.sources.audio_files import FILE_SCHEMA, as_manifest, bounded
from koewake.sources.snapshots import Snapshots


def ingest_batch(store: Snapshots, manifest: DataFrame) -> DataFrame:
    """Classifies a manifest, stores new and changed files as pending and those out of bounds as filtered.

    Returns the classified manifest. Only keys that aren't known are added, so a batch that runs twice changes nothing.
    """
    now = store.read()
    found = materialise(scan.classify(manifest, now), "found")
    fresh = found.where(F.col("scan_status").isin("new", "changed")).withColumn("issue", F.lit(None).cast("string"))
    gone = found.where("scan_status = 'skipped'").join(now.select(*C.KEY), C.KEY, "left_anti").join(fresh.select(*C.KEY), C.KEY, "left_anti")
    gone = gone.withColumn("issue", F.to_json(F.array(scan.gate_message(F.col("duration_ms")))))
    columns = [*C.KEY, "file_path", "file_size", "duration_ms", "source_dir", "issue"]
    store.write(C.upsert_pending(now, fresh.select(*columns).unionByName(gone.select(*columns)), F.current_timestamp()))
    return found


def watch(spark: SparkSession, directory: str, store: Snapshots, checkpoint: str | None = None, after: Callable[[DataFrame, int], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """A stream of the audio files of a directory into ``store``; ``after`` gets each classified batch.

    The stream's checkpoint knows files by path; the cache knows them by content, so a copy under another name is
    still found.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(directory)
    files = bounded(files.where(is_audio(F.col("path"))))

    def each(batch: DataFrame, number: int) -> None:
        found = ingest_batch(store, as_manifest(batch))
        if after:
            after(found, number)

    q = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or new_path(spark, "watch"))
    return (q.trigger(availableNow=True) if available_now else q).start()
