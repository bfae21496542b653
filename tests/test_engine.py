"""The whole way from files to an export, and the stream."""

import numpy as np
import pytest

from koewake.engine import Busy, Engine, eta
from koewake.sources.snapshots import Snapshots
from koewake.streaming.ingest import watch
from test_signal import wav_file


@pytest.fixture
def corpus(tmp_path):
    d = tmp_path / "audio"
    (d / "sub").mkdir(parents=True)
    tone = (np.sin(np.arange(32000) / 10) * 20000).astype(int)
    (d / "a.wav").write_bytes(wav_file(tone))
    (d / "B.WAV").write_bytes(wav_file(tone[:20000] // 4, rate=16000))
    (d / "short.wav").write_bytes(wav_file(tone[:100]))
    (d / "note.txt").write_text("no audio")
    (d / "sub" / "c.wav").write_bytes(wav_file(tone))
    return d


def test_process(spark, corpus, tmp_path):
    e = Engine(spark, str(tmp_path / "home"))
    first = e.scan(str(corpus)).first()
    assert (first["total"], first["new"], first["skipped"]) == (3, 2, 1)
    assert {r["file_name"]: r["status"] for r in e.cache().collect()} == {"a.wav": "pending", "B.WAV": "pending", "short.wav": "filtered"}
    s = e.process(str(corpus), then_export=str(tmp_path / "out")).first()
    assert s["pending"] == 0 and s["done"] + s["filtered"] == 3 and (tmp_path / "out/v1/list.txt").exists()
    again = e.scan(str(corpus)).first()
    assert (again["cached"], again["new"], again["skipped"]) == (2, 0, 1)
    assert e.directories().first()["total"] == 3
    with e._alone(), pytest.raises(Busy):
        e.process(str(corpus))


def test_fix_keeps_input_and_cache_follows(spark, corpus, tmp_path):
    e = Engine(spark, str(tmp_path / "home"))
    e.scan(str(corpus))
    before = (corpus / "B.WAV").read_bytes()
    plan = {r["file_path"].split("/")[-1]: r["any_fixed"] for r in e.plan_fixes(str(corpus)).collect()}
    assert plan["B.WAV"] and e.cache().where("file_path LIKE '%fixed%'").count() == 0
    e.fix(str(corpus))
    assert (corpus / "B.WAV").read_bytes() == before and e.cache().where("file_path LIKE '%/fixed/%'").count() >= 1


def test_failures_are_results(spark, corpus, tmp_path):
    def broken(path, content, hint):
        raise RuntimeError("quota")

    e = Engine(spark, str(tmp_path / "home"), broken)
    assert e.process(str(corpus)).first()["error"] == 2
    assert {r["error_msg"] for r in e.cache().where("status = 'error'").collect()} == {"RuntimeError: quota"}
    assert e.retry_errors() == 2 and e.cache().where("status = 'pending'").count() == 2
    assert e.clear() == 3 and e.cache().count() == 0


def test_results_are_committed_and_not_asked_for_again(spark, corpus, tmp_path, monkeypatch):
    from koewake.operators import transcribe as T

    calls = tmp_path / "calls"
    calls.mkdir()
    for i in range(6):
        (corpus / f"n{i}.wav").write_bytes(wav_file((np.sin(np.arange(32000) / (10 + i)) * 20000).astype(int)))
    place = str(calls)

    def counting(path, content, hint):
        import os
        import uuid

        open(os.path.join(place, os.path.basename(path) + "-" + uuid.uuid4().hex[:6]), "w").close()
        return T.reply("もう一回だけ、聞いてくれる？", "happy", "ja") | {"hint": hint}

    e = Engine(spark, str(tmp_path / "home"), counting)
    real = T.transcribe

    def dies(*a, **k):
        if any(calls.iterdir()):  # what came before is committed
            raise RuntimeError("driver lost")
        return real(*a, **k)

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(T, "transcribe", dies)
        e.process(str(corpus), commit=3)
    first = len(list(calls.iterdir()))
    states = {r["status"] for r in e.cache().collect()}
    assert 0 < first < 8 and "processing" in states and "done" not in states
    events = []
    again = Engine(spark, str(tmp_path / "home"), counting)
    again.progress = events.append
    s = again.process(str(corpus), commit=3).first()
    assert s["processing"] == s["pending"] == s["error"] == 0 and s["done"] == 8
    assert len(list(calls.iterdir())) == 8 and again.results.names() == []
    told = [x for x in events if "done" in x]
    assert [x["done"] for x in told] == list(range(1, 8 - first + 1)) and told[-1]["pct"] == 100 and all(x["status"] == "ok" for x in told)
    raw = again.cache().where("status = 'done'").first()["asr_raw"]
    assert "choices" in raw


def test_empty_and_missing_are_errors(spark, corpus, tmp_path):
    from koewake.operators import transcribe as T

    files = spark.createDataFrame([("a.wav", "h", str(corpus / "a.wav")), ("B.WAV", "h", str(corpus / "B.WAV")), ("x.wav", "h", "/no/such/file.wav")], "file_name string, file_hash string, file_path string")
    got = {r["file_name"]: r for r in T.transcribe(files, lambda p, c, h: T.reply(" " if p.endswith("B.WAV") else "はい、" + h, "odd", None), 2, "ja").collect()}
    assert (got["a.wav"]["status"], got["a.wav"]["asr_text"], got["a.wav"]["emotion"], got["a.wav"]["language"]) == ("done", "はい、ja", "neutral", "ja")
    assert got["B.WAV"]["status"] == "error" and got["B.WAV"]["error_msg"].startswith("empty transcription | audio: 采样率 16000Hz") and got["B.WAV"]["asr_text"] is None
    assert got["x.wav"]["status"] == "error" and "No such file" in got["x.wav"]["error_msg"]
    refused = T.transcribe(files.where("file_name = 'a.wav'"), lambda p, c, h: {"status_code": 429, "body": '{"message": "slow down"}'}).first()
    assert (refused["status"], refused["error_msg"]) == ("error", "slow down")


def test_events_of_a_task(spark, corpus, tmp_path):
    import json

    e = Engine(spark, str(tmp_path / "home"))
    told = list(e.events(e.start(str(corpus))))
    kinds = [t.split("\n")[0] for t in told]
    assert kinds[-2:] == ["event: complete", "event: done"] and "event: progress" in kinds and all(t.endswith("\n\n") for t in told)
    assert [json.loads(t.split("data: ")[1]) for t in told if "current_file" in t][-1]["done"] == 2
    assert list(e.events("nope")) == ['event: error\ndata: {"message": "unknown task"}\n\n']


def test_other_types_by_a_converter(spark, corpus, tmp_path):
    from koewake.operators import convert

    tone = (np.sin(np.arange(32000) / 10) * 20000).astype(int)
    (corpus / "d.ogg").write_bytes(wav_file(np.repeat(tone, 2), rate=44100))  # WAV by content
    (corpus / "e.mp3").write_bytes(b"nothing")
    files = spark.createDataFrame([(str(corpus / n),) for n in ("d.ogg", "e.mp3")], "file_path string")

    class Missing(convert.FFmpeg):
        def available(self):
            return False

    assert {r["error"] for r in convert.probed(files, Missing()).collect()} == {"converter not installed"}
    plan = {r["file_path"][-5:]: r for r in convert.convert(files, None, convert.Offline()).collect()}
    assert plan["d.ogg"]["fixed"] and plan["d.ogg"]["sample_rate"] == 44100 and plan["e.mp3"]["error"] == "unreadable" and not plan["e.mp3"]["fixed"]
    e = Engine(spark, str(tmp_path / "home"), converter=convert.Offline())
    e.scan(str(corpus))
    held = {r["file_name"]: r for r in e.cache().collect()}
    assert round(held["d.ogg"]["duration_ms"]) == 1451 and held["e.mp3"]["duration_ms"] is None
    e.fix(str(corpus))
    after = {r["file_name"]: r for r in e.cache().collect()}
    assert "/fixed/" in after["d.wav"]["file_path"] and after["d.wav"]["file_hash"] != held["d.ogg"]["file_hash"] and (corpus / "d.ogg").exists()


def test_outside_programs_are_asked_by_path_and_by_pipe(tmp_path, monkeypatch):
    from koewake.operators.convert import FFmpeg
    from koewake.sources.wav import read_pcm

    monkeypatch.setenv("PATH", str(tmp_path))
    assert not FFmpeg().available()
    told = '{"streams": [{"sample_rate": "44100", "channels": 2, "codec_name": "vorbis"}], "format": {"duration": "1.5"}}'
    for name, does in [("ffprobe", f"echo '{told}'"), ("ffmpeg", 'case "$*" in *broken*) echo "no stream" >&2; exit 1;; esac; printf "\\001\\000\\002\\000"')]:
        (tmp_path / name).write_text(f"#!/bin/sh\n{does}\n")
        (tmp_path / name).chmod(0o755)
    f = FFmpeg()
    assert f.available() and f.probe("/x.ogg") == f.probe(b"bytes") == {"sample_rate": 44100, "channels": 2, "format": "vorbis", "duration_ms": 1500.0}
    rate, channels, x = read_pcm(f.convert(b"bytes"))
    assert (rate, channels, x.tolist()) == (32000, 1, [1, 2])
    with pytest.raises(RuntimeError, match="no stream"):
        f.convert("/broken.ogg")


def test_text_emotions(spark):
    from koewake import schema as S
    from koewake.operators import emotions

    rows = [(1, "done", "abc", "happy", None, None), (2, "done", "", "sad", None, None), (3, "error", "abc", None, None, "x"), (4, "done", "bad", "sad", None, None)]
    df = spark.createDataFrame(rows, "id long, status string, asr_text string, emotion string, text_emotion string, emotion_final string")

    def analyser(text):
        if text == "bad":
            raise ValueError("no key")
        return emotions.offline(text)

    told = emotions.text_emotions(df, analyser)
    assert sorted((r["id"], r["text_emotion"], r["text_error"]) for r in told.collect()) == [(1, S.EMOTIONS[3], None), (4, "", "ValueError: no key")]
    got = {r["id"]: (r["text_emotion"], r["emotion_final"]) for r in emotions.merged(df, told).collect()}
    assert got == {1: (S.EMOTIONS[3], "happy"), 2: (None, None), 3: (None, "x"), 4: (None, None)}


def test_stream(spark, corpus, tmp_path):
    store, point, seen = Snapshots(spark, str(tmp_path / "t")), str(tmp_path / "cp"), []
    for _ in range(2):
        watch(spark, str(corpus), store, point, lambda df, n: seen.append(df.count())).awaitTermination(120)
    assert seen == [3] and store.read().count() == 3
    (corpus / "copy.wav").write_bytes((corpus / "a.wav").read_bytes())
    watch(spark, str(corpus), store, point, lambda df, n: seen.append(df.count())).awaitTermination(120)
    assert seen == [3, 1] and store.read().count() == 4


def test_eta():
    assert eta(0, 0, 1.0) == (0, 0.0) and eta(5, 10, 5.0) == (50, 5.0)


def test_large_files_are_classified(spark, corpus, tmp_path, monkeypatch):
    from koewake.sources import audio_files

    (corpus / "long.wav").write_bytes(wav_file(np.arange(32000 * 31) % 9000))
    (corpus / "large.mp3").write_bytes(b"x" * 100_001)
    want = {(r["file_name"], r["file_hash"], r["duration_ms"], str(r["issues"])) for r in audio_files.manifest(spark, str(corpus)).collect()}
    monkeypatch.setattr(audio_files, "MOST_BYTES", 100_000)
    monkeypatch.setattr(audio_files.wav, "CHUNK", 5_000)
    assert audio_files.listing(spark, str(corpus)).where("content IS NULL").count() == 2
    assert {(r["file_name"], r["file_hash"], r["duration_ms"], str(r["issues"])) for r in audio_files.manifest(spark, str(corpus)).collect()} == want and len(want) == 5
    e = Engine(spark, str(tmp_path / "home"))
    first = e.scan(str(corpus)).first()
    assert (first["total"], first["new"], first["skipped"]) == (5, 3, 2)
    assert {r["file_name"]: r["status"] for r in e.cache().collect()} == {"a.wav": "pending", "B.WAV": "pending", "large.mp3": "pending", "short.wav": "filtered", "long.wav": "filtered"}
    assert {r["file_path"].split("/")[-1]: r["readable"] for r in e.plan_fixes(str(corpus)).collect()}["long.wav"] is False
    assert e.process(str(corpus)).first()["total"] == 5
    store = Snapshots(spark, str(tmp_path / "t"))
    watch(spark, str(corpus), store, str(tmp_path / "cp")).awaitTermination(120)
    assert store.read().count() == 5
