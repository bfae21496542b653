"""The queries over the tables of a directory, one for each operator."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from koewake import schema as S
from koewake.functions import numbers, signal, text
from koewake.functions.labels import clean_label
from koewake.functions.paths import clean_dir
from koewake.operators import cache as C
from koewake.operators import convert, emotions, export, postprocess, repair, reports, responses, scan, transcribe
from koewake.plans.tables import load
from koewake.session import materialise, new_path, ship
from koewake.sources import audio_files, wav
from koewake.sources.files import opened, save
from koewake.sources.snapshots import Snapshots
from koewake.streaming.ingest import ingest_batch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _cache(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return load(spark, sf_dir, "audio_cache", *columns)


# ---- text -----------------------------------------------------------------------------------------------------------


def _of_text(name: str, f: Callable[[Column], Column]) -> None:
    """A query that applies a text rule to what was heard, before any correction."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        heard = F.coalesce(F.nullif(F.col("raw_asr_text"), F.lit("")), F.col("asr_text"))
        return _cache(spark, sf_dir, "id", "asr_text", "raw_asr_text").where("asr_text IS NOT NULL").select("id", f(heard).alias("value"))

    run.__name__ = name
    query(run)


_of_text("text_kana", text.full_kana)
_of_text("text_fullwidth", text.plain_alnum)
_of_text("text_whitespace", text.squeeze_blanks)
_of_text("text_control", text.strip_controls)
_of_text("text_strip", text.strip_blanks)
_of_text("text_normalize", text.normalize_japanese)
_of_text("text_nonverbal", lambda x: text.is_non_verbal(text.strip_blanks(x)))
_of_text("text_has_japanese", text.has_japanese)
_of_text("text_filler", text.is_filler)


@query
def text_filter_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = F.coalesce(F.nullif(F.col("raw_asr_text"), F.lit("")), F.col("asr_text"))
    rows = _cache(spark, sf_dir, "id", "asr_text", "raw_asr_text").where("asr_text IS NOT NULL").select("id", text.normalize_japanese(heard).alias("s"))
    return rows.select("id", "s", text.bare_text(F.col("s")).alias("b")).select("id", text.reason_of(F.col("s"), F.col("b")).alias("value"))


_of_text("text_pipe_escape", text.pipe_escape)


@query
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir, "id", "asr_text", "error_msg")
    return rows.select("id", text.preview(F.col("asr_text"), F.col("error_msg"), 60).alias("preview"), text.preview(F.col("asr_text"), F.col("error_msg"), 40, "(空)").alias("short"))


# ---- postprocessing -------------------------------------------------------------------------------------------------


@query
def postprocess_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postprocess.decide(_cache(spark, sf_dir, "id", "status", "asr_text"))
    return rows.select("id", "status", "new_status", F.when(~F.col("blank"), F.col("new_text")).alias("new_text"), "filter_reason", "changed")


@query
def postprocess_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.stats(_cache(spark, sf_dir, "status", "asr_text"))


@query
def postprocess_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.run(_cache(spark, sf_dir, "id", "status", "asr_text", "raw_asr_text"))


@query
def filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postprocess.decide(_cache(spark, sf_dir, "id", "status", "asr_text"))
    return rows.where("filter_reason <> ''").groupBy("filter_reason").agg(F.count(F.lit(1)).alias("n"))


# ---- reports --------------------------------------------------------------------------------------------------------


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(_cache(spark, sf_dir, "status"))


@query
def status_counts_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(_cache(spark, sf_dir, "status", "source_dir"), "source_dir")


@query
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir, "status").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dashboard(_cache(spark, sf_dir, "status", "quality_issues", "raw_asr_text"))


@query
def dashboard_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir, "status", "quality_issues", "raw_asr_text", "source_dir")
    return reports.dashboard(rows.withColumn("dir", clean_dir(F.col("source_dir"))), "dir")


@query
def emotion_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.emotion_histogram(_cache(spark, sf_dir, "status", "emotion")).select("emotion", "n")


@query
def emotion_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.emotion_histogram(_cache(spark, sf_dir, "status", "emotion")).select("emotion", "n", "share")


@query
def emotion_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.emotion_histogram(_cache(spark, sf_dir, "status", "emotion")).select("emotion", "n", "bar")


@query
def emotion_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir, "status", "emotion", "source_dir").where("status = 'done'")
    return rows.groupBy(clean_dir(F.col("source_dir")).alias("dir"), clean_label(F.col("emotion")).alias("emotion")).agg(F.count(F.lit(1)).alias("n"))


@query
def neutral_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.neutral_alert(_cache(spark, sf_dir, "status", "emotion"))


@query
def neutral_alert_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir, "status", "emotion", "source_dir")
    return reports.neutral_alert(rows.withColumn("dir", clean_dir(F.col("source_dir"))), "dir")


@query
def reason_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reasons(_cache(spark, sf_dir, "id", "status", "quality_issues"))


@query
def issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.issue_kinds(_cache(spark, sf_dir, "id", "quality_issues"))


@query
def issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir, "id", "file_name", "quality_issues")
    return rows.where(reports.has_issues(F.col("quality_issues")))


@query
def issue_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir, "quality_issues").agg(F.count_if(reports.has_issues(F.col("quality_issues"))).alias("n"))


@query
def corrected_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir, "raw_asr_text").agg(F.count_if(F.col("raw_asr_text") != "").alias("n"))


@query
def files_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir)
    return reports.page(rows, status="done", source_dir="/data/studio_a", limit=500, offset=100)


@query
def files_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page_total(_cache(spark, sf_dir, "status", "source_dir"), status="done", source_dir="/data/studio_a")


@query
def review_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.review(_cache(spark, sf_dir, "id", "file_name", "status", "quality_issues", "asr_text", "error_msg"))


@query
def review_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir, "status").agg(F.count_if(F.col("status").isin("filtered", "error")).alias("n"))


@query
def done_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir, "id", "file_name", "source_dir", "status", "asr_raw").where("status = 'done'")
    return rows.select("id", "file_name", "source_dir", F.try_parse_json("asr_raw").isNotNull().alias("has_response"))


@query
def done_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reports.done_by_dir(_cache(spark, sf_dir, "status", "source_dir", "duration_ms"))
    return d.select("source_dir", "done", F.round("duration_ms", 2).alias("duration_ms"))


@query
def missing_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir, "id", "file_path", "duration_ms").where("duration_ms IS NULL").select("id", "file_path")


@query
def registry_left_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir, "status", "source_dir").withColumn("dir_path", clean_dir(F.col("source_dir")))
    return reports.registered_stats(load(spark, sf_dir, "dir_registry", "dir_id", "dir_path", "speaker_name"), rows)


# ---- scan -----------------------------------------------------------------------------------------------------------


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "scan_manifest")


@query
def duration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "scan_manifest", "scan_id", "duration_ms")
    return rows.select("scan_id", scan.gate(F.col("duration_ms")).alias("gate"))


@query
def duration_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "scan_manifest", "scan_id", "duration_ms").where(scan.gate(F.col("duration_ms")) != "ok")
    return rows.select("scan_id", scan.gate_message(F.col("duration_ms")).alias("message"))


@query
def scan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.classify(_manifest(spark, sf_dir), _cache(spark, sf_dir, "file_name", "file_hash", "status")).select("scan_id", "scan_status")


@query
def scan_classify_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.classify(_manifest(spark, sf_dir), _cache(spark, sf_dir, "file_name", "file_hash", "status"), strict=True).select("scan_id", "scan_status")


@query
def scan_classify_per_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir, "file_name", "file_hash", "status", "source_dir")
    return scan.classify(_manifest(spark, sf_dir), rows, per_directory=True).select("scan_id", "scan_status")


@query
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.summary(scan.classify(_manifest(spark, sf_dir), _cache(spark, sf_dir, "file_name", "file_hash", "status")), "batch_no")


@query
def scan_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.warnings(_manifest(spark, sf_dir)).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


@query
def first_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten warnings by name, and how many are left."""
    every = scan.warnings(_manifest(spark, sf_dir))
    left = every.agg(F.greatest(F.count(F.lit(1)) - 10, F.lit(0)).alias("left")).scalar()
    return every.orderBy("file_name", "warning").limit(10).withColumn("left", left)


@query
def rate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "scan_manifest", "scan_id", "file_name", "sr_actual")
    wav = F.lower(F.regexp_extract("file_name", r"(\.[^./]+)$", 1)) == ".wav"
    return rows.where(wav & (F.col("sr_actual") != S.SAMPLE_RATE)).select("scan_id", signal.rate_message(F.col("sr_actual")).alias("message"))


@query
def audio_suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "scan_manifest", "scan_id", "file_path")
    return rows.select("scan_id", scan.is_audio(F.col("file_path")).alias("is_audio"))


# ---- cache ----------------------------------------------------------------------------------------------------------


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan hands to the cache: new and changed files."""
    rows = scan.classify(_manifest(spark, sf_dir), _cache(spark, sf_dir, "file_name", "file_hash", "status"))
    return rows.where(F.col("scan_status").isin("new", "changed"))


@query
def upsert_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = C.upsert_pending(_cache(spark, sf_dir), _incoming(spark, sf_dir))
    return after.select("id", "file_name", "file_hash", "file_path", "file_size", "duration_ms", "status", "error_msg")


@query
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = C.upsert_pending(_cache(spark, sf_dir), _incoming(spark, sf_dir))
    return reports.status_counts(after)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result for each key: of several replies the first with a text, else the first."""
    parsed = responses.outcome(responses.parse(load(spark, sf_dir, "asr_response")))
    first = F.struct(F.when(F.col("status") == "done", 0).otherwise(1), "received_at", "response_id")
    best = parsed.groupBy("file_name", "file_hash").agg(F.min_by(F.struct("status", "text", "emotion", "language", "confidence", "body", "error_msg"), first).alias("r"))
    return best.select(
        "file_name", "file_hash", "r.status", F.col("r.text").alias("asr_text"), "r.emotion", "r.language",
        F.col("r.body").alias("asr_raw"), "r.confidence", F.lit("[]").alias("quality_issues"), F.lit("").alias("raw_asr_text"), "r.error_msg",
    )


@query
def write_back_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = C.write_back(_cache(spark, sf_dir), _results(spark, sf_dir))
    return after.select("id", "status", "asr_text", "emotion", "language", "confidence", "error_msg", "raw_asr_text", "quality_issues")


@query
def reset_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reset_errors(_cache(spark, sf_dir)).select("id", "status", "error_msg")


@query
def reset_errors_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir, "status").agg(F.count_if(F.col("status") == "error").alias("n"))


@query
def mark_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir)
    return C.mark_processing(rows, C.pending(rows)).select("id", "status")


@query
def backfill_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fill_duration(_cache(spark, sf_dir), load(spark, sf_dir, "scan_manifest", "file_name", "file_hash", "duration_ms")).select("id", "duration_ms")


@query
def backfill_source_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fill_source_dir(_cache(spark, sf_dir, "id", "file_path", "source_dir"), load(spark, sf_dir, "dir_registry", "dir_path")).select("id", "source_dir")


@query
def rename_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that isn't wav gets the name, hash and path of its transcoded form."""
    rows = _cache(spark, sf_dir, "id", "file_name", "file_hash", "file_path")
    to_wav = lambda c: F.regexp_replace(c, r"\.[^./]+$", ".wav")
    other = rows.where(~F.lower("file_name").endswith(".wav"))
    renames = other.select("file_name", "file_hash", to_wav("file_name").alias("new_name"), F.md5(F.concat(F.lit("wav:"), "file_hash")).alias("new_hash"), to_wav("file_path").alias("new_path"))
    return C.rename(rows, renames)


@query
def pending_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pending(_cache(spark, sf_dir, "id", "status", "file_path", "source_dir")).select("id", "file_path", "source_dir")


@query
def pending_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending files that the last scan of each directory still listed."""
    seen = load(spark, sf_dir, "scan_manifest", "file_path").distinct()
    return C.pending(_cache(spark, sf_dir, "id", "status", "file_path")).join(seen, "file_path", "left_semi").select("id", "file_path")


@query
def clear_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir, "id").agg(F.count(F.lit(1)).alias("deleted"))


# ---- responses and emotions -----------------------------------------------------------------------------------------


@query
def asr_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = responses.parse(load(spark, sf_dir, "asr_response"))
    return rows.select("response_id", "file_name", "file_hash", "received_at", "ok", "text", "emotion", "language", "confidence")


@query
def enum_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir, "id", "emotion")
    return rows.select("id", responses.clamp_emotion(F.col("emotion")).alias("emotion"))


@query
def emotion_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir, "id", "emotion", "emotion_final").select("id", export.resolved_emotion().alias("emotion"))


@query
def emotion_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir, "id", "emotion", "text_emotion", "confidence").where("emotion IS NOT NULL")
    return rows.select("id", responses.merge_emotion(F.col("emotion"), F.col("text_emotion"), F.col("confidence")).alias("m")).select("id", "m.source", "m.final", "m.needs_review")


@query
def set_emotion_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir, "id", "status", "emotion", "text_emotion", "confidence", "emotion_final")
    merged = responses.merge_emotion(F.col("emotion"), F.col("text_emotion"), F.col("confidence"))["final"]
    return rows.select("id", F.when((F.col("status") == "done") & F.col("emotion").isNotNull(), merged).otherwise(F.col("emotion_final")).alias("emotion_final"))


# ---- signals --------------------------------------------------------------------------------------------------------


def _pcm(spark: SparkSession, sf_dir: str, factor: float = 1.0) -> DataFrame:
    """The embeddings as short signals."""
    v = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    one = lambda x: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), x.cast("double") * F.lit(32767.0) * F.lit(factor))).cast("int")
    return v.select("vec_id", F.transform("embedding", one).alias("pcm"))


def _joined(pcm: Column) -> Column:
    return F.md5(F.array_join(pcm.cast("array<string>"), ","))


def _of_pcm(name: str, factor: float, f: Callable[[Column], dict[str, Column]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pcm(spark, sf_dir, factor).select("vec_id", *(c.alias(k) for k, c in f(F.col("pcm")).items()))

    run.__name__ = name
    query(run)


_of_pcm("pcm_peak", 1.0, lambda p: {"peak": signal.peak(p), "samples": F.size(p)})
_of_pcm("pcm_rms_db", 1.0, lambda p: {"sum_squares": signal.sum_squares(p), "rms": F.round(signal.rms(p), 4), "rms_db": F.round(signal.decibels(signal.rms(p)), 4)})
_of_pcm("pcm_clipping", 2.5, lambda p: {"clipped": signal.clipped(p), "share": F.round(signal.clip_share(p), 6), "ok": signal.clipping_ok(p)})
_of_pcm("pcm_silence", 0.05, lambda p: {"silent": signal.silent(p), "share": F.round(signal.silent_share(p), 6), "ok": signal.silence_ok(p)})
_of_pcm("pcm_quality_verdict", 2.5, lambda p: {"passed": signal.clipping_ok(p) & signal.silence_ok(p), "issues": F.array_join(signal.issues(F.lit(44100), p), "; ")})
_of_pcm("pcm_quiet_verdict", 0.01, lambda p: {"passed": signal.clipping_ok(p) & signal.silence_ok(p), "issues": F.array_join(signal.issues(F.lit(32000), p), "; ")})
_of_pcm("pcm_resample_hold", 1.0, lambda p: {"samples": F.size(signal.resample(p, 16000)), "signal": _joined(signal.resample(p, 16000))})
_of_pcm("pcm_resample_mean", 1.0, lambda p: {"samples": F.size(signal.resample(p, 96000)), "signal": _joined(signal.resample(p, 96000))})
_of_pcm("pcm_resample_linear", 1.0, lambda p: {"samples": F.size(signal.resample(p, 44100)), "signal": _joined(signal.resample(p, 44100))})
_of_pcm("pcm_loudness", 1.0, lambda p: {"gain": F.round(signal.loudness_gain(p), 6), "peak": signal.peak(signal.loudness(p)), "signal": _joined(signal.loudness(p))})
_of_pcm("pcm_declip", 2.5, lambda p: {"gain": F.round(signal.declip_gain(p), 6), "peak": signal.peak(signal.declip(p)), "signal": _joined(signal.declip(p))})
_of_pcm("pcm_auto_fix", 1.0, lambda p: {"samples": F.size(signal.auto_fix(p, 16000)), "signal": _joined(signal.auto_fix(p, 16000))})


# ---- files and exports ----------------------------------------------------------------------------------------------


@query
def mime_data_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stand in for the bytes of files."""
    rows = _cache(spark, sf_dir, "id", "file_name", "file_hash", "asr_text")
    return rows.select("id", responses.data_uri(F.encode(F.coalesce("asr_text", "file_hash"), "UTF-8"), F.col("file_name")).alias("uri"))


@query
def content_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("md5"))


@query
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of directories, of which some are versions."""
    names = load(spark, sf_dir, "documents", "doc_id", "source").select(F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".bak").otherwise("")).alias("name"))
    return export.next_version_of(names, "name")


@query
def export_list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.list_lines(_cache(spark, sf_dir, "id", "status", "file_path", "asr_text"))


@query
def export_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.annotations(_cache(spark, sf_dir))
    d = F.from_json("document", "file string, original_path string, text string, language string, emotion struct<audio:string,text_semantic:string,final:string>, confidence double, duration_ms double, file_hash string, processed_at string")
    return rows.select("id", d.alias("d")).select("id", "d.file", "d.original_path", "d.text", "d.language", F.col("d.emotion.audio").alias("audio"), F.col("d.emotion.text_semantic").alias("text_semantic"), F.col("d.emotion.final").alias("final"), "d.confidence", F.round("d.duration_ms", 3).alias("duration_ms"), "d.file_hash", "d.processed_at")


@query
def export_emotion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.emotion_counts(_cache(spark, sf_dir, "status", "emotion", "emotion_final"))


@query
def export_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.latest(_cache(spark, sf_dir, "id", "file_name", "source_dir", "status").where("status = 'done'")).select("id")


@query
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the work on each directory has come."""
    rows = _cache(spark, sf_dir, "status", "source_dir").withColumn("dir", clean_dir(F.col("source_dir")))
    n = rows.groupBy("dir").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("done", "filtered", "error")).alias("finished"))
    return n.withColumn("percent", numbers.percent(F.col("finished"), F.col("total")))


@query
def export_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of ``list.txt`` as it was written."""
    out = export.write(_cache(spark, sf_dir), new_path(spark, "export"), copy_files=False)
    return spark.read.text(f"{out}/list.txt").select(F.col("value").alias("line"))


@query
def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.progress_events(_cache(spark, sf_dir, "id", "status"))


# ---- files that are made of signals ---------------------------------------------------------------------------------


def _wav_files(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """``vec_id, file_path, content``: the signals as WAV files of several rates, every third in two channels; or all of 16 kHz."""
    ship(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, made = b.column(0).to_pylist(), []
            for i, x in zip(ids, b.column(1).to_pylist()):
                made.append(wav.wav_bytes(np.array(x), 16000) if plain else wav.wav_bytes(np.array(x), (32000, 44100, 16000, 48000)[i % 4], 2 if i % 3 == 0 else 1))
            paths = [f"/signals/{i % 7}/s{i}.wav" for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths), pa.array(made, pa.binary())], ["vec_id", "file_path", "content"])

    return _pcm(spark, sf_dir, 1.0 if plain else 2.5).mapInArrow(run, "vec_id long, file_path string, content binary")


@query
def wav_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wav.probe(_wav_files(spark, sf_dir))
    return rows.select("vec_id", "readable", "sample_rate", "channels", "frames", F.round("duration_ms", 6).alias("duration_ms"), "peak", "sum_squares", "clipped", "silent")


@query
def wav_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _wav_files(spark, sf_dir).select(F.col("file_path").alias("path"), F.octet_length("content").cast("long").alias("length"), "content")
    return audio_files.as_manifest(files).select("file_name", "file_path", "file_size", F.round("duration_ms", 6).alias("duration_ms"), "source_dir", "sr_ok", "sr_actual")


@query
def wav_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.repair(_wav_files(spark, sf_dir, plain=True))
    return rows.select("file_path", "readable", "orig_rate", "rate_fixed", "loudness_fixed", "clipping_fixed", "any_fixed")


@query
def wav_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired files, written, read again, and hashed by their samples."""
    files = _wav_files(spark, sf_dir, plain=True)
    made = repair.repair(files, new_path(spark, "repaired")).join(files.select("file_path", "vec_id"), "file_path").where("any_fixed").select("vec_id", "new_path")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signals = []
            for path in b.column(1).to_pylist():
                with opened(path) as f:
                    signals.append(wav.read_pcm(f.read())[2])
            hashes = [hashlib.md5(",".join(map(str, x.tolist())).encode()).hexdigest() for x in signals]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in signals], pa.int32()), pa.array(hashes, pa.string())], ["vec_id", "samples", "signal"])

    return made.mapInArrow(run, "vec_id long, samples int, signal string")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals as files in the shared folder, under names of another type: ``vec_id, file_path``."""
    place = new_path(spark, "signals")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [f"{place}/s{i}.ogg" for i in b.column(0).to_pylist()]
            for path, content in zip(paths, b.column(2).to_pylist()):
                save(path, content)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths)], ["vec_id", "file_path"])

    return materialise(_wav_files(spark, sf_dir).mapInArrow(run, "vec_id long, file_path string"), "stored")


@query
def convert_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stand-in of the outside program tells of files of another type."""
    files = _stored(spark, sf_dir)
    told = convert.convert(files, None, convert.Offline()).join(files, "file_path")
    return told.select("vec_id", "sample_rate", "channels", "format", F.round("duration_ms", 6).alias("duration_ms"), "fixed")


@query
def convert_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The converted files, probed again."""
    files = _stored(spark, sf_dir)
    made = convert.convert(files, new_path(spark, "converted"), convert.Offline()).join(files, "file_path").select("vec_id", F.col("new_path").alias("file_path"))
    return convert.probed(made, convert.Offline()).join(made, "file_path").select("vec_id", "sample_rate", "channels", F.round("duration_ms", 6).alias("duration_ms"))


def _answer(path: str, content: bytes | None, hint: str) -> dict:
    """Stands in for a service: texts, silence and refusals by the number in a file's name."""
    n = int(path.rsplit("/s", 1)[1].split(".")[0])
    if n % 7 == 0:
        return {"status_code": 429, "body": '{"message": "slow down"}'}
    return transcribe.reply("" if n % 5 == 0 else f" 声{n} ", S.EMOTIONS[n % 7] if n % 3 else "odd", None if n % 2 else "en")


@query
def transcribe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _stored(spark, sf_dir)
    keyed = files.select(F.concat(F.lit("s"), "vec_id").alias("file_name"), F.md5(F.col("vec_id").cast("string")).alias("file_hash"), "file_path")
    return transcribe.transcribe(keyed, _answer, 4, "ja").select("file_name", "file_hash", "status", "asr_text", "emotion", "language", "confidence", F.regexp_replace("error_msg", r" \| audio.*$", "").alias("error_msg"))


@query
def text_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emotions.text_emotions(_cache(spark, sf_dir, "id", "status", "asr_text"))


@query
def text_emotions_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cache(spark, sf_dir, "id", "status", "asr_text", "emotion", "text_emotion", "emotion_final")
    return emotions.merged(rows, emotions.text_emotions(rows)).select("id", "text_emotion", "emotion_final")


@query
def snapshot_of_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache written as a snapshot, and one directory read back."""
    store = Snapshots(spark, new_path(spark, "snapshots"))
    store.write(_cache(spark, sf_dir))
    return store.read(directory="/data/studio_a").select("id", "file_name", "status", "asr_text")


@query
def ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after the manifest was taken in two times."""
    store = Snapshots(spark, new_path(spark, "ingested"))
    store.write(_cache(spark, sf_dir))
    for _ in range(2):
        ingest_batch(store, _manifest(spark, sf_dir))
    return store.read().select("file_name", "file_hash", "status", "error_msg")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From what was heard to the emotions of what is kept: normalise, filter, count, share."""
    after = postprocess.run(_cache(spark, sf_dir, "id", "status", "asr_text", "raw_asr_text", "emotion"))
    return reports.emotion_histogram(after)
