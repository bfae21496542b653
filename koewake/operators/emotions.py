"""The emotion of a text by a pluggable analyser, and its merge with that of the audio.

An analyser gets a text and returns ``{emotion, confidence}``; one that fails, or has no key, gives an empty emotion and
an error, and the emotion of the audio stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koewake import schema as S
from koewake.operators.responses import merge_emotion
from koewake.session import ship

Analyser = Callable[[str], dict]


def offline(text: str) -> dict:
    """Stands in for an analyser: an answer that depends on the length of the text alone."""
    return {"emotion": S.EMOTIONS[len(text) % len(S.EMOTIONS)], "confidence": len(text) % 11 / 10}


def text_emotions(cache: DataFrame, analyser: Analyser = offline) -> DataFrame:
    """``(id, text_emotion, text_confidence, text_error)`` of done rows with a text."""
    ship(cache.sparkSession)
    src = cache.where("status = 'done' AND length(asr_text) > 0").select("id", "asr_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, known = [], {}
            for t in b.column(1).to_pylist():
                if t not in known:  # equal texts are asked for once
                    try:
                        r = analyser(t)
                        known[t] = (str(r.get("emotion") or ""), float(r.get("confidence") or 0.0), r.get("error"))
                    except Exception as e:  # noqa: BLE001 - a failed call is a result
                        known[t] = ("", 0.0, f"{type(e).__name__}: {e}")
                rows.append(known[t])
            kinds = [pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["id", "text_emotion", "text_confidence", "text_error"])

    return src.mapInArrow(run, "id long, text_emotion string, text_confidence double, text_error string")


def merged(cache: DataFrame, analysed: DataFrame, now: Column | None = None) -> DataFrame:
    """The cache with ``text_emotion`` and ``emotion_final`` of the rows that were analysed without error."""
    new = analysed.where("text_error IS NULL").select("id", F.col("text_emotion").alias("_text"), F.col("text_confidence").alias("_sure"))
    both = cache.join(new, "id", "left")
    hit = F.col("_text").isNotNull()
    final = merge_emotion(F.col("emotion"), F.col("_text"), F.col("_sure"))["final"]
    values = {"text_emotion": F.when(hit, F.col("_text")).otherwise(F.col("text_emotion")), "emotion_final": F.when(hit, final).otherwise(F.col("emotion_final"))}
    if now is not None:
        values["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return both.withColumns(values).select(*cache.columns)
