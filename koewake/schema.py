"""Fixed values and the schema of the one relation, the cache of recordings."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

#: States of a recording, labels, limits.
STATUSES = ("pending", "processing", "done", "error", "filtered")
EMOTIONS = ("neutral", "happy", "sad", "angry", "surprised", "fearful", "disgusted")
SUFFIXES = (".wav", ".mp3", ".flac", ".m4a", ".ogg", ".wma", ".aac", ".opus")
MIME = {".wav": "audio/wav", ".mp3": "audio/mpeg", ".flac": "audio/flac", ".m4a": "audio/mp4", ".ogg": "audio/ogg", ".aac": "audio/aac", ".opus": "audio/ogg"}
MIN_DURATION_MS, MAX_DURATION_MS = 500, 30000
SAMPLE_RATE = 32000
CLIP_LEVEL, CLIP_SHARE = 32111, 0.01
SILENT_LEVEL, SILENT_SHARE, LEAST_RMS = 655.34, 0.8, 0.01
PEAK_TARGET, CLIPPED_PEAK, DECLIP_TARGET = 0.707, 32000, 0.9
NEUTRAL_ALERT = 70.0
DONE_CONFIDENCE, SURE_CONFIDENCE = 0.9, 0.6

AUDIO_CACHE = StructType(
    [
        StructField("id", LongType(), False),
        StructField("file_name", StringType(), False),
        StructField("file_hash", StringType(), False),
        StructField("file_path", StringType(), False),
        StructField("file_size", LongType()),
        StructField("duration_ms", DoubleType()),
        StructField("status", StringType()),
        StructField("asr_text", StringType()),
        StructField("emotion", StringType()),
        StructField("language", StringType()),
        StructField("asr_raw", StringType()),
        StructField("text_emotion", StringType()),
        StructField("emotion_final", StringType()),
        StructField("confidence", DoubleType()),
        StructField("error_msg", StringType()),
        StructField("quality_issues", StringType()),
        StructField("raw_asr_text", StringType()),
        StructField("created_at", TimestampType()),
        StructField("updated_at", TimestampType()),
        StructField("source_dir", StringType()),
    ]
)
