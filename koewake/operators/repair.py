"""Repair of WAV files: resampled, levelled, brought down where clipped. Results go to a new place, never over the input."""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koewake import schema as S
from koewake.session import ship
from koewake.sources.files import save
from koewake.sources.wav import read_pcm, wav_bytes

PLAN = "file_path string, readable boolean, orig_rate int, rate_fixed boolean, loudness_fixed boolean, loudness_reason string, peak_before_db double, peak_after_db double, clipping_fixed boolean, gain double, any_fixed boolean"


def resampled(x: np.ndarray, old: int, new: int = S.SAMPLE_RATE) -> np.ndarray:
    if old == new:
        return x
    if new % old == 0:
        return np.repeat(x, new // old)
    if old % new == 0:
        k = old // new
        return x[: len(x) // k * k].reshape(-1, k).sum(axis=1) // k
    if len(x) < 2:
        return x
    n = int(len(x) * new / old)
    at = np.arange(n) * (len(x) - 1) / (n - 1) if n > 1 else np.zeros(n)
    lo = at.astype(np.int64)
    part = at - lo
    hi = np.minimum(lo + 1, len(x) - 1)
    return np.where(lo >= len(x) - 1, x[-1], np.trunc(x[lo] * (1 - part) + x[hi] * part)).astype(np.int64)


def _db(level: float) -> float:
    return round(20 * math.log10(level / 32767), 1)


def levelled(x: np.ndarray) -> tuple[np.ndarray, dict]:
    peak = int(np.abs(x).max(initial=0))
    if peak == 0:
        return x, {"fixed": False, "reason": "silent" if len(x) else "empty", "before": -96.0, "after": None}
    gain = S.PEAK_TARGET * 32767 / peak
    if 0.95 <= gain <= 1.05:
        return x, {"fixed": False, "reason": "already_ok", "before": _db(peak), "after": None}
    y = np.trunc(np.clip(x * gain, -32768, 32767)).astype(np.int64)
    return y, {"fixed": True, "reason": None, "before": _db(peak), "after": _db(int(np.abs(y).max()))}


def declipped(x: np.ndarray) -> tuple[np.ndarray, float | None]:
    peak = int(np.abs(x).max(initial=0))
    if peak < S.CLIPPED_PEAK:
        return x, None
    gain = S.DECLIP_TARGET * 32767 / peak
    return np.trunc(np.clip(x * gain, -32768, 32767)).astype(np.int64), gain


def repaired(content: bytes) -> tuple[bytes, dict]:
    rate, channels, x = read_pcm(content)
    y = resampled(x, rate)
    y, loud = levelled(y)
    y, gain = declipped(y)
    changed = rate != S.SAMPLE_RATE or loud["fixed"] or gain is not None
    return (wav_bytes(y) if changed or channels > 1 else content), {"rate": rate, "loud": loud, "gain": gain, "fixed": changed}


def repair(files: DataFrame, out_dir: str | None = None) -> DataFrame:
    """What would be repaired, one row for each file; with ``out_dir`` the repaired files are written there.

    With ``out_dir`` the rows also have ``new_name, new_hash, new_path`` for ``cache.rename``. A task that runs twice
    writes the same bytes to the same name.
    """
    ship(files.sparkSession)
    src = files.select("file_path", "content")
    names = [x.split()[0] for x in PLAN.split(", ")] + ["new_name", "new_hash", "new_path"]
    kinds = [pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.float64(), pa.bool_(), *[pa.string()] * 3]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    data, r = repaired(content)
                except Exception:  # noqa: BLE001 - whatever a broken file raises, it is unreadable
                    rows.append((path, False, *[None] * 8, False, None, None, None))
                    continue
                new = (None, None, None)
                if out_dir and r["fixed"]:
                    base = os.path.splitext(os.path.basename(path))[0] + ".wav"
                    to = "/".join([out_dir.rstrip("/"), hashlib.md5(os.path.dirname(path).encode()).hexdigest()[:8], base])  # equal names of two directories stay apart
                    save(to, data)
                    new = (base, hashlib.md5(data).hexdigest(), to)
                loud = r["loud"]
                rows.append((path, True, r["rate"], r["rate"] != S.SAMPLE_RATE, loud["fixed"], loud["reason"], loud["before"], loud["after"], r["gain"] is not None, None if r["gain"] is None else round(r["gain"], 3), r["fixed"], *new))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)

    made = src.mapInArrow(run, PLAN + ", new_name string, new_hash string, new_path string")
    return made if out_dir else made.drop("new_name", "new_hash", "new_path")


def wav_only(files: DataFrame) -> DataFrame:
    """Other types need an outside converter and are left out."""
    return files.where(F.lower("file_path").endswith(".wav"))
