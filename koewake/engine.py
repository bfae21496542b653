"""The whole tool behind one object: what the command line and a service would call."""

from __future__ import annotations

import json
import math
import os
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from koewake.functions.paths import clean_dir
from koewake.operators import cache as C
from koewake.operators import convert, emotions, export, postprocess, repair, reports, scan, transcribe
from koewake.sources import audio_files
from koewake.sources.files import Folder
from koewake.sources.registry import Registry
from koewake.sources.snapshots import Snapshots
from koewake.streaming.ingest import ingest_batch, watch

#: Recordings whose results are committed together.
COMMIT = 500
RESULT_SCHEMA = ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in transcribe.RESULT)


class Busy(RuntimeError):
    """A task is running already."""


class Engine:
    """A corpus under ``home``: its cache, its registered directories and its exports.

    Reading never changes anything. Every change writes a new snapshot of the cache. A directory, where one can be
    given, limits every step to it; none or an empty one means all.
    """

    def __init__(self, spark: SparkSession, home: str, recogniser: transcribe.Recogniser = transcribe.offline, converter: convert.Converter | None = None, analyser: emotions.Analyser | None = None) -> None:
        self.spark, self.home, self.recogniser, self.converter, self.analyser = spark, home, recogniser, converter, analyser
        self.store = Snapshots(spark, os.path.join(home, "cache"))
        self.registry = Registry(os.path.join(home, "dirs.json"))
        self.results = Folder(spark, os.path.join(home, "results"))
        self._lock = threading.Lock()
        self._streams: dict[str, queue.Queue] = {}
        self.progress: Callable[[dict], None] | None = None

    # reading

    def cache(self, directory: str = "") -> DataFrame:
        return self.store.read(directory=os.path.normpath(directory) if directory else None)

    def stats(self, directory: str = "") -> DataFrame:
        return reports.dashboard(self.cache(directory))

    def directories(self) -> DataFrame:
        known = self.spark.createDataFrame([(d,) for d in self.registry.all()], "dir_path string")
        return reports.registered_stats(known, self.store.read().withColumn("dir_path", clean_dir(F.col("source_dir"))))

    def files(self, status: str = "", directory: str = "", limit: int = 500, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        rows = self.cache(directory)
        return reports.page(rows, status or None, None, limit, offset), reports.page_total(rows, status or None)

    def emotion_report(self, directory: str = "") -> DataFrame:
        return reports.emotion_histogram(self.cache(directory))

    def filtered_report(self, directory: str = "", limit: int = 50) -> tuple[DataFrame, DataFrame]:
        rows = self.cache(directory)
        return reports.reasons(rows), reports.review(rows, limit)

    def issue_report(self, directory: str = "") -> DataFrame:
        return reports.issue_kinds(self.cache(directory))

    # changes

    @contextmanager
    def _alone(self):
        if not self._lock.acquire(blocking=False):
            raise Busy("a task is running")
        try:
            yield
        finally:
            self._lock.release()

    def _tell(self, **what) -> None:
        if self.progress:
            self.progress(what)

    def scan(self, directory: str) -> DataFrame:
        """Takes the files of a directory into the cache; returns the counts of the classes."""
        self.registry.add(directory)
        return scan.summary(ingest_batch(self.store, audio_files.manifest(self.spark, directory, self.converter)))

    def watch(self, directory: str, **options):
        return watch(self.spark, directory, self.store, **options)

    def process(self, directory: str, fix: bool = False, concurrency: int = 3, then_export: str = "", speaker: str = "heroine", language: str = "ja", hint: str = "", rate: float | None = None, commit: int = COMMIT) -> DataFrame:
        """Scans, repairs if asked, recognises what is pending, normalises, filters, and exports if asked.

        What is recognised is committed after every ``commit`` recordings. A run that dies is gone on with by the next,
        which takes over the results that were committed and calls for the rest only.
        """
        with self._alone():
            self._tell(stage="scan")
            self.scan(directory)
            if fix:
                self._tell(stage="fix")
                self.fix(directory)
            self._recognise(directory, concurrency, hint, rate, commit)
            if self.analyser:
                self._tell(stage="emotions")
                self.store.write(emotions.merged(self.store.read(), emotions.text_emotions(self.cache(directory), self.analyser), F.current_timestamp()))
            self._tell(stage="postprocess")
            self.postprocess(directory)
            if then_export:
                self._tell(stage="export")
                self.export(then_export, directory, speaker, language)
            return self.stats(directory)

    def _recover(self) -> int:
        """Takes committed results into the cache; returns how many there were."""
        names = self.results.names()
        whole = [f"{self.results.path}/{n}" for n in names if self.results.fs.exists(self.results.at(n, "_SUCCESS"))]
        n = 0
        if whole:
            done = self.spark.read.schema(RESULT_SCHEMA).parquet(*whole).dropDuplicates(C.KEY)
            n = done.count()
            self.store.write(C.write_back(self.store.read(), done, F.current_timestamp()))
        for name in names:
            self.results.delete(name)
        return n

    def _recognise(self, directory: str, concurrency: int, hint: str, rate: float | None, commit: int) -> None:
        self._recover()
        mine = self.cache(directory)
        waiting = mine.where(F.col("status").isin("pending", "processing")).select(*C.KEY, "file_path")
        total = waiting.count()
        if not total:
            return
        rows = self.store.read()
        marked = C.mark_processing(rows, waiting, F.current_timestamp())
        self.store.write(marked)
        waiting = self.cache(directory).where("status = 'processing'").select(*C.KEY, "file_path")
        batches = -(-total // commit)
        part = F.pmod(F.xxhash64(*C.KEY), F.lit(batches))
        began, done = time.monotonic(), 0
        for i in range(batches):
            path = f"{self.results.path}/batch-{i:06d}-{uuid.uuid4().hex[:8]}"
            transcribe.transcribe(waiting.where(part == i), self.recogniser, concurrency, hint, rate).write.parquet(path)
            for r in self.spark.read.parquet(path).select("file_name", "status", "error_msg").toLocalIterator():  # about as many as are committed together
                done += 1
                percent, left = eta(done, total, time.monotonic() - began)
                self._tell(done=done, total=total, current_file=r["file_name"], status="ok" if r["status"] == "done" else "error", eta=left, pct=percent, error=(r["error_msg"] or "")[:200])
        self._recover()

    def start(self, directory: str, **options) -> str:
        """``process`` in the background; the events of the task that is returned are read by ``events``."""
        if self._lock.locked():
            raise Busy("a task is running")
        task, told = uuid.uuid4().hex[:8], queue.Queue()
        self._streams[task] = told

        def run() -> None:
            began = time.monotonic()
            outer, self.progress = self.progress, lambda what: told.put(("progress", what))
            try:
                s = self.process(directory, **options).first().asDict()
                told.put(("complete", {"elapsed": round(time.monotonic() - began, 3), "done_count": s["done"], "error_count": s["error"]}))
            except Exception as e:  # noqa: BLE001 - whatever happened, who listens is told
                told.put(("error", {"message": str(e)}))
            finally:
                self.progress = outer
                told.put(("done", {}))

        threading.Thread(target=run, daemon=True).start()
        return task

    def events(self, task: str) -> Iterator[str]:
        """The events of a task as server-sent events, until it is done; an unknown task is an error."""
        told = self._streams.get(task)
        if told is None:
            yield event("error", {"message": "unknown task"})
            return
        while True:
            kind, what = told.get()
            yield event(kind, what)
            if kind == "done":
                del self._streams[task]
                return

    def plan_fixes(self, directory: str) -> DataFrame:
        """What a repair would do, without doing it."""
        files = audio_files.listing(self.spark, directory)
        return repair.repair(repair.wav_only(files.select(F.regexp_replace("path", r"^file:(?://)?(?=/)", "").alias("file_path"), "content")))

    def fix(self, directory: str) -> DataFrame:
        """Repaired copies of a directory's WAV files under ``home/fixed``, and converted ones of other types if there is a
        converter; the cache follows to their names and hashes."""
        files = audio_files.listing(self.spark, directory)
        files = files.select(F.regexp_replace("path", r"^file:(?://)?(?=/)", "").alias("file_path"), "content")
        place = os.path.join(self.home, "fixed")
        out = repair.repair(repair.wav_only(files), place).persist()
        new = out.where("any_fixed").select("file_path", "new_name", "new_hash", "new_path")
        if self.converter:
            other = convert.convert(convert.others(files), place, self.converter).persist()
            new = new.unionByName(other.where("fixed").select(*new.columns))
        old = self.store.read()
        renames = old.select(*C.KEY, "file_path").join(new, "file_path").dropDuplicates(C.KEY)
        self.store.write(C.rename(old, renames))
        return out

    def postprocess(self, directory: str = "") -> DataFrame:
        """Normalises and filters the texts; returns the counts."""
        counts = postprocess.stats(self.cache(directory))
        result = counts.collect()
        only = clean_dir(F.col("source_dir")) == os.path.normpath(directory) if directory else None
        self.store.write(postprocess.run(self.store.read(), F.current_timestamp(), only).drop("filter_reason"))
        return self.spark.createDataFrame(result, counts.schema)

    def export(self, root: str, directory: str = "", speaker: str = "heroine", language: str = "ja", only_latest: bool = False) -> str:
        return export.write(self.cache(directory), root, speaker, language, only_latest)

    def retry_errors(self) -> int:
        rows = self.store.read()
        n = rows.where("status = 'error'").count()
        if n:
            self.store.write(C.reset_errors(rows, F.current_timestamp()))
        return n

    def refresh(self, directory: str) -> int:
        """Fills missing directories and durations from the files; returns how many rows lacked one."""
        rows = self.store.read()
        lacking = rows.where("duration_ms IS NULL OR source_dir IS NULL OR source_dir = ''").count()
        known = self.spark.createDataFrame([(os.path.normpath(directory),)], "dir_path string")
        rows = C.fill_source_dir(rows, known)
        self.store.write(C.fill_duration(rows, audio_files.manifest(self.spark, directory, self.converter)))
        return lacking

    def clear(self, directories: bool = False) -> int:
        """Empties the cache, and the registry if asked; returns how many rows the cache had."""
        rows = self.store.read()
        n = rows.count()
        self.store.write(rows.limit(0))
        for d in self.registry.all() if directories else ():
            self.registry.remove(d)
        return n


def eta(done: int, total: int, seconds: float) -> tuple[int, float]:
    """Percent done, and the seconds that are left at the speed so far."""
    if not total or not done:
        return 0, math.inf if total else 0.0
    return int(done * 100 / total), seconds / done * (total - done)


def event(kind: str, what: dict) -> str:
    """A server-sent event."""
    return f"event: {kind}\ndata: {json.dumps(what, ensure_ascii=False)}\n\n"
