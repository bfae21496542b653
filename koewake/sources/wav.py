"""WAV files decoded once, by Arrow batches, into the figures that the checks need; and WAV bytes from signals.

Only 16-bit PCM is read; several channels are mixed down to their mean. What can't be read has ``readable = false`` and
null figures, and never fails the job.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koewake import schema as S
from koewake.functions.numbers import whole
from koewake.session import ship
from koewake.sources.files import opened

#: Frames, or bytes, of a large file that are held at a time.
CHUNK = 1 << 20
FIGURES = "readable boolean, sample_rate int, channels int, frames long, duration_ms double, peak long, sum_squares long, clipped long, silent long"
KINDS = [pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), *[pa.int64()] * 4]


def read_pcm(content: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, channels and samples of a WAV file, mixed down to one channel with means rounded down."""
    with wave.open(io.BytesIO(content), "rb") as w:
        rate, channels, width, frames = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
        if width != 2 or channels < 1 or rate < 1:
            raise wave.Error("not 16-bit PCM")
        x = np.frombuffer(w.readframes(frames), "<i2")
    x = x[: len(x) // channels * channels].reshape(-1, channels).astype(np.int64)
    return rate, channels, x.sum(axis=1) // channels


def wav_bytes(samples: np.ndarray, rate: int = S.SAMPLE_RATE, channels: int = 1) -> bytes:
    """A 16-bit WAV file; the samples of several channels take turns."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples).astype("<i2").tobytes())
    return out.getvalue()


def figures(content: bytes | None) -> tuple:
    return (False, *[None] * 8) if content is None else figures_of(io.BytesIO(content))


def figures_of(file: BinaryIO) -> tuple:
    """The figures of an open file, of which ``CHUNK`` frames are held at a time."""
    n = peak = squares = clipped = silent = 0
    try:
        with wave.open(file, "rb") as w:
            rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
            if width != 2 or channels < 1 or rate < 1:
                raise wave.Error("not 16-bit PCM")
            while data := w.readframes(CHUNK):
                x = np.frombuffer(data, "<i2")
                x = x[: len(x) // channels * channels].reshape(-1, channels).astype(np.int64).sum(axis=1) // channels
                a = np.abs(x)
                n, peak, squares = n + len(x), max(peak, int(a.max(initial=0))), squares + int((x * x).sum())
                clipped, silent = clipped + int((a >= S.CLIP_LEVEL).sum()), silent + int((a < S.SILENT_LEVEL).sum())
    except (wave.Error, EOFError, struct.error, TypeError, ValueError):
        return (False, *[None] * 8)
    return (True, rate, channels, n, n / rate * 1000, peak, squares, clipped, silent)


def _by_path(path: str) -> tuple[str, tuple]:
    """Hash and figures of a file that is too large to be held."""
    with opened(path) as f:
        md5 = hashlib.md5()
        while data := f.read(CHUNK):
            md5.update(data)
        f.seek(0)
        return md5.hexdigest(), figures_of(f)


def probe(files: DataFrame) -> DataFrame:
    """Files with ``content``: every other column, and the figures of each, without the content.

    Files without content are read by their ``file_path``, if there is one, and get their ``file_hash`` too.
    """
    ship(files.sparkSession)
    kept = [c for c in files.columns if c != "content"]
    src = files.select(*kept, "content")
    names = [x.split()[0] for x in FIGURES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, own = b.column(len(kept)), list(b.columns[:-1])
            large = {}
            if content.null_count and "file_path" in kept:
                paths = own[kept.index("file_path")]
                large = {i: _by_path(paths[i].as_py()) for i, x in enumerate(content) if not x.is_valid and paths[i].is_valid}
            if large and "file_hash" in kept:
                at = kept.index("file_hash")
                own[at] = pa.array([large[i][0] if i in large else h for i, h in enumerate(own[at].to_pylist())], pa.string())
            rows = [large[i][1] if i in large else figures(x.as_py()) for i, x in enumerate(content)]
            made = [pa.array([r[i] for r in rows], KINDS[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, *made], [*kept, *names])

    head = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in kept)
    return src.mapInArrow(run, f"{head}, {FIGURES}" if head else FIGURES)


def verdict() -> dict[str, Column]:
    """``passed, issues`` of probed files, as in ``functions.signal``; an unreadable file has a rate issue only."""
    n = F.col("frames")
    rms = F.coalesce(F.sqrt(F.try_divide(F.col("sum_squares").cast("double"), n)), F.lit(0.0))
    level = rms / F.lit(32767.0)
    clip = F.coalesce(F.try_divide(F.col("clipped").cast("double"), n), F.lit(0.0))
    silent = F.coalesce(F.try_divide(F.col("silent").cast("double"), n), F.lit(1.0))
    rate = F.when(~F.col("readable"), F.lit("unreadable")).when(F.col("sample_rate") != S.SAMPLE_RATE, F.concat(F.lit("采样率 "), F.col("sample_rate").cast("string"), F.lit(f"Hz (需要 {S.SAMPLE_RATE}Hz)")))
    share = F.bround(clip * 100, 1).cast("decimal(10,1)").cast("string")
    clipping = F.when(clip >= S.CLIP_SHARE, F.concat(F.lit("削波率 "), share, F.lit("% ("), F.col("clipped").cast("string"), F.lit("/"), n.cast("string"), F.lit(" 样本)")))
    db = F.lit(20.0) * F.log10(F.greatest(level, F.lit(1e-10)))
    low = F.when(level < S.LEAST_RMS, F.concat(F.lit("RMS 过低 ("), whole(db), F.lit(" dB)")))
    long = F.when(silent >= S.SILENT_SHARE, F.concat(F.lit("静音占比过高 ("), whole(silent * 100), F.lit("%)")))
    quiet = F.when(low.isNotNull() | long.isNotNull(), F.concat_ws("; ", low, long))
    issues = F.array_compact(F.array(rate, F.when(F.col("readable"), clipping), F.when(F.col("readable"), quiet)))
    return {"issues": issues, "passed": F.size(issues) == 0}
