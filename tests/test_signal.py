import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from koewake.functions import signal as G
from koewake.operators import repair
from koewake.sources import wav


def one(spark, pcm, *columns):
    df = spark.createDataFrame([(pcm,)], "p array<int>")
    return df.select(*(c(F.col("p")) if callable(c) else c for c in columns)).first()


@pytest.mark.parametrize(
    "pcm,old,new,want",
    [
        ([1, -2], 16000, 32000, [1, 1, -2, -2]),
        ([1, 2, -1, -2, 5], 64000, 32000, [1, -2]),
        ([0, 30, 60, 90, 120, 150], 48000, 32000, [0, 50, 100, 150]),
        ([100, -101, 7, 9], 44100, 32000, [100, 9]),
        ([7], 44100, 32000, [7]),
        ([], 44100, 32000, []),
        ([], 16000, 32000, []),
        ([], 64000, 32000, []),
    ],
)
def test_resample(spark, pcm, old, new, want):
    assert one(spark, pcm, lambda p: G.resample(p, old, new))[0] == want
    assert repair.resampled(np.array(pcm, dtype=np.int64), old, new).tolist() == want


@pytest.mark.parametrize(
    "pcm,want", [([1000, -2000], [11583, -23166]), ([0, 0], [0, 0]), ([], []), ([23167], [23167])]
)
def test_loudness(spark, pcm, want):
    assert one(spark, pcm, G.loudness)[0] == want
    assert repair.levelled(np.array(pcm, dtype=np.int64))[0].tolist() == want


@pytest.mark.parametrize("pcm,want", [([32000, -7], [29490, -6]), ([31999], [31999]), ([], [])])
def test_declip(spark, pcm, want):
    assert one(spark, pcm, G.declip)[0] == want
    assert repair.declipped(np.array(pcm, dtype=np.int64))[0].tolist() == want


def test_checks(spark):
    r = one(spark, [32111, 32110], G.clipped, G.clip_share, G.clipping_ok)
    assert tuple(r) == (1, 0.5, False)
    r = one(spark, [1000, -1000, 0, 655, 656], G.rms, lambda p: G.decibels(G.rms(p)), G.silent_share, G.silence_ok)
    assert round(r[0], 1) == 756.2 and round(r[1], 1) == -32.7 and r[2] == 0.4 and r[3]
    r = one(spark, [], G.silent_share, lambda p: G.decibels(G.rms(p)), G.silence_ok, G.peak, G.clip_share)
    assert tuple(r) == (1.0, -200.0, False, 0, 0.0)
    assert one(spark, None, G.peak, G.loudness, G.rms)[0] is None


def wav_file(samples, rate=32000, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes() if width == 2 else bytes(len(samples) * width))
    return out.getvalue()


def test_wav_figures(spark):
    good = wav_file([0, 1000, -1000, 32767])
    files = [("good", good), ("stereo", wav_file([1, 2, -1, -2], channels=2)), ("8bit", wav_file([1, 2], width=1)), ("24bit", wav_file([1, 2], width=3)), ("empty", wav_file([])), ("cut", good[:20]), ("none", None)]
    got = {r["path"]: r for r in wav.probe(spark.createDataFrame(files, "path string, content binary")).withColumns(wav.verdict()).collect()}
    assert got["good"]["frames"] == 4 and got["good"]["clipped"] == 1 and got["good"]["peak"] == 32767
    assert got["stereo"]["frames"] == 2 and got["stereo"]["peak"] == 2 and got["stereo"]["sum_squares"] == 1 + 4  # means rounded down
    for bad in ("8bit", "24bit", "cut", "none"):
        assert not got[bad]["readable"] and got[bad]["issues"] == ["unreadable"], bad
    assert got["empty"]["frames"] == 0 and not got["empty"]["passed"]
    rate, _, x = wav.read_pcm(wav.wav_bytes(np.array([1, -2, 3])))
    assert rate == 32000 and x.tolist() == [1, -2, 3]


def test_repair(spark, tmp_path):
    quiet, fine = wav_file([100, -200] * 100, rate=16000), wav_file([23167, -23167] * 100)
    files = spark.createDataFrame([("/a/q.wav", quiet), ("/b/q.wav", quiet), ("/a/f.wav", fine), ("/a/x.wav", b"nothing")], "file_path string, content binary")
    plan = {r["file_path"]: r for r in repair.repair(files).collect()}
    assert plan["/a/q.wav"]["rate_fixed"] and plan["/a/q.wav"]["loudness_fixed"] and not plan["/a/q.wav"]["clipping_fixed"]
    assert not plan["/a/f.wav"]["any_fixed"] and plan["/a/f.wav"]["loudness_reason"] == "already_ok"
    assert not plan["/a/x.wav"]["readable"] and not list(tmp_path.iterdir())
    done = {r["file_path"]: r for r in repair.repair(files, str(tmp_path)).collect()}
    assert done["/a/q.wav"]["new_path"] != done["/b/q.wav"]["new_path"]
    rate, _, x = wav.read_pcm(open(done["/a/q.wav"]["new_path"], "rb").read())
    assert rate == 32000 and len(x) == 400 and abs(x).max() <= 23167
