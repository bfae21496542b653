"""Audio of other types by an outside program: figures, durations, and conversion to WAV.

The program is a plug-in that says whether it is there, so that a cluster without it reports this for each file and goes
on. Converted files go to a new place, never over the input; the cache follows by ``cache.rename``.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import shutil
import subprocess
import wave
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koewake import schema as S
from koewake.operators.repair import resampled
from koewake.session import ship
from koewake.sources import files as files_of
from koewake.sources.wav import read_pcm, wav_bytes

FIGURES = "sample_rate int, channels int, format string, duration_ms double, error string"


class Converter(Protocol):
    """Works on a local path, or on the bytes of a file that has none; writes nothing."""

    def available(self) -> bool: ...

    def probe(self, source: str | bytes) -> dict:
        """``sample_rate, channels, format, duration_ms`` of the first stream; empty if it can't be read."""

    def convert(self, source: str | bytes) -> bytes:
        """A mono 16-bit WAV file of the wanted rate, or raises."""


class FFmpeg:
    """The programs ``ffprobe`` and ``ffmpeg``, where an executor has them."""

    #: Seconds that a probe and a conversion may take.
    PROBE_S, CONVERT_S = 30, 120

    def available(self) -> bool:
        return bool(shutil.which("ffprobe") and shutil.which("ffmpeg"))

    def _run(self, source: str | bytes, seconds: int, program: str, *args: str, to: tuple[str, ...] = ()) -> subprocess.CompletedProcess:
        at, data = (source, None) if isinstance(source, str) else ("pipe:0", source)
        return subprocess.run([program, "-v", "error", *args, "-i", at, *to], input=data, capture_output=True, timeout=seconds, check=False)

    def probe(self, source: str | bytes) -> dict:
        done = self._run(source, self.PROBE_S, "ffprobe", "-print_format", "json", "-show_format", "-show_streams", "-select_streams", "a:0")
        told = json.loads(done.stdout or b"{}") if done.returncode == 0 else {}
        if not told.get("streams"):
            return {}
        s, seconds = told["streams"][0], float(told.get("format", {}).get("duration") or 0)
        return {"sample_rate": int(s.get("sample_rate") or 0), "channels": int(s.get("channels") or 1), "format": s.get("codec_name") or "", "duration_ms": seconds * 1000 if seconds > 0 else None}

    def convert(self, source: str | bytes) -> bytes:
        done = self._run(source, self.CONVERT_S, "ffmpeg", to=("-ar", str(S.SAMPLE_RATE), "-ac", "1", "-f", "s16le", "pipe:1"))
        if done.returncode:
            raise RuntimeError(f"ffmpeg failed: {done.stderr.decode('utf-8', 'replace').strip()[:200]}")
        return wav_bytes(np.frombuffer(done.stdout, "<i2"))


class Offline:
    """Stands in for the outside program where files are WAV by content, whatever they are called."""

    def available(self) -> bool:
        return True

    def _bytes(self, source: str | bytes) -> bytes:
        if isinstance(source, bytes):
            return source
        with open(source, "rb") as f:
            return f.read()

    def probe(self, source: str | bytes) -> dict:
        try:
            with wave.open(io.BytesIO(self._bytes(source)), "rb") as w:
                rate, n = w.getframerate(), w.getnframes()
                return {"sample_rate": rate, "channels": w.getnchannels(), "format": f"pcm_s{8 * w.getsampwidth()}le", "duration_ms": n / rate * 1000 if n else None}
        except (wave.Error, EOFError, OSError):
            return {}

    def convert(self, source: str | bytes) -> bytes:
        rate, _, x = read_pcm(self._bytes(source))
        return wav_bytes(resampled(x, rate))


def _source(path: str) -> str | bytes:
    if "://" not in path or path.startswith("file:"):
        return files_of.local(path)
    with files_of.opened(path) as f:
        return f.read()


def _probe(path: str, converter: Converter) -> dict:
    if not converter.available():
        return {"error": "converter not installed"}
    try:
        return converter.probe(_source(path)) or {"error": "unreadable"}
    except Exception as e:  # noqa: BLE001 - whatever a broken file raises, it is unreadable
        return {"error": f"{type(e).__name__}: {e}"[:200]}


def _rows(names: list[str], kinds: list[pa.DataType], one):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m.get(n) for m in made], k) for n, k in zip(names, kinds))], ["file_path", *names])

    return run


_NAMES = [x.split()[0] for x in FIGURES.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()]


def probed(files: DataFrame, converter: Converter | None = None) -> DataFrame:
    """``file_path`` and the figures of each file by the outside program; only paths are moved."""
    ship(files.sparkSession)
    converter = converter or FFmpeg()
    return files.select("file_path").mapInArrow(_rows(_NAMES, _KINDS, lambda p: _probe(p, converter)), f"file_path string, {FIGURES}")


def needs_fix() -> Column:
    """Whether a probed file has another rate than the wanted one, or several channels."""
    return (F.coalesce(F.col("sample_rate"), F.lit(0)) != S.SAMPLE_RATE) | (F.coalesce(F.col("channels"), F.lit(1)) > 1)


def convert(files: DataFrame, out_dir: str | None = None, converter: Converter | None = None) -> DataFrame:
    """What would be converted, by rate and channels; with ``out_dir`` every file is, and its row has ``new_name, new_hash, new_path``."""
    ship(files.sparkSession)
    converter = converter or FFmpeg()
    plan = probed(files, converter).withColumn("fixed", F.col("error").isNull() & needs_fix())
    if out_dir is None:
        return plan

    def one(path: str) -> dict:
        was = _probe(path, converter)
        if was.get("error"):
            return was | {"fixed": False}
        try:
            base = os.path.splitext(os.path.basename(path))[0] + ".wav"
            data = converter.convert(_source(path))
            to = "/".join([out_dir.rstrip("/"), hashlib.md5(os.path.dirname(path).encode()).hexdigest()[:8], base])
            files_of.save(to, data)
            return was | {"fixed": True, "new_name": base, "new_hash": hashlib.md5(data).hexdigest(), "new_path": to}
        except Exception as e:  # noqa: BLE001 - a failed conversion is a result
            return was | {"fixed": False, "error": str(e)[:200]}

    names, kinds = [*_NAMES, "fixed", "new_name", "new_hash", "new_path"], [*_KINDS, pa.bool_(), *[pa.string()] * 3]
    return files.select("file_path").mapInArrow(_rows(names, kinds, one), f"file_path string, {FIGURES}, fixed boolean, new_name string, new_hash string, new_path string")


def others(files: DataFrame) -> DataFrame:
    """Audio files that aren't WAV by name."""
    return files.where(~F.lower("file_path").endswith(".wav"))
