"""Recognition of recordings by a pluggable function, on the executors.

A recogniser gets the path of one recording, its bytes (none above ``MOST_BYTES``), and a hint of the language, and
returns the reply of its service as it is: ``{status_code, body}``. Replies are parsed by ``responses`` in the JVM and
kept. Only keys and paths are moved: each file is read, measured and recognised in one pass where the call is made. The
number of partitions bounds how many calls run at once, and ``rate`` how many begin in a second.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koewake import schema as S
from koewake.operators import responses
from koewake.session import ship
from koewake.sources import files as source
from koewake.sources import wav

Recogniser = Callable[[str, bytes | None, str], dict]
#: Larger files are measured in parts, and recognised by their path.
MOST_BYTES = 512 << 20
RESULT = ["file_name", "file_hash", "status", "asr_text", "emotion", "language", "asr_raw", "confidence", "quality_issues", "raw_asr_text", "error_msg"]
_OFFLINE = ("ちょっと待ってよ。", "ありがとうございます！", "もう一回だけ、聞いてくれる？", "えーと…")


def reply(text: str, emotion: str | None = None, language: str | None = None) -> dict:
    """A reply in the form of the service, for recognisers that have only a text and labels."""
    message = {"content": [{"text": text}], "annotations": [{"emotion": emotion, "language": language}]}
    return {"status_code": 200, "body": json.dumps({"output": {"choices": [{"message": message}]}}, ensure_ascii=False)}


def offline(path: str, content: bytes | None, hint: str) -> dict:
    """Stands in for a recogniser: an answer that depends on the bytes alone."""
    n = int(hashlib.md5(content or b"").hexdigest(), 16)
    return reply(_OFFLINE[n % len(_OFFLINE)], S.EMOTIONS[n % len(S.EMOTIONS)], hint or "ja")


def _read(path: str) -> tuple[bytes | None, tuple]:
    """The bytes of a file, and its figures."""
    if source.size_of(path) > MOST_BYTES:
        with source.opened(path) as f:
            return None, wav.figures_of(f)
    with source.opened(path) as f:
        content = f.read()
    return content, wav.figures(content)


def transcribe(files: DataFrame, recogniser: Recogniser = offline, concurrency: int = 3, hint: str = "", rate: float | None = None) -> DataFrame:
    """Files with ``file_name, file_hash, file_path``: results by key, in the form of ``cache.write_back``.

    A call that fails, and a file that can't be read, is a result: an error. A reply without text is one too.
    """
    ship(files.sparkSession)
    src = files.select("file_name", "file_hash", "file_path").repartition(concurrency, "file_hash")
    names = [x.split()[0] for x in wav.FIGURES.split(", ")]
    wait = concurrency / rate if rate else 0.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began = 0.0
        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # what was recognised goes on before the rest is
                b = whole.slice(at, 64)
                rows = []
                for path in b.column(2).to_pylist():
                    figures, code, body, failed = wav.figures(None), None, None, None
                    try:
                        content, figures = _read(path)
                        time.sleep(max(0.0, began + wait - time.monotonic()))
                        began = time.monotonic()
                        r = recogniser(path, content, hint)
                        code, body = r.get("status_code"), r.get("body")
                    except Exception as e:  # noqa: BLE001 - a failed call is a result
                        failed = f"{type(e).__name__}: {e}"
                    rows.append((code, body, failed, *figures))
                kinds = [pa.int32(), pa.string(), pa.string(), *wav.KINDS]
                yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["file_name", "file_hash", "status_code", "body", "failed", *names])

    called = src.mapInArrow(run, f"file_name string, file_hash string, status_code int, body string, failed string, {wav.FIGURES}")
    parsed = responses.outcome(responses.parse(called.withColumns(wav.verdict())), issues=F.col("issues"))
    fine = F.col("status") == "done"
    given = {
        "asr_text": F.when(fine, F.col("text")), "emotion": F.when(fine, F.col("emotion")), "language": F.when(fine, F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit(hint))),
        "asr_raw": F.col("body"), "confidence": F.when(fine, F.col("confidence")), "quality_issues": F.to_json("issues"), "raw_asr_text": F.lit(""),
        "error_msg": F.when(~fine, F.coalesce("failed", "error_msg")),
    }
    return parsed.withColumns(given).select(*RESULT)
