import itertools

import pytest
from pyspark.sql import functions as F

from conftest import rows
from koewake import schema as S
from koewake.operators import cache as C
from koewake.operators import export, postprocess, reports, responses, scan
from koewake.sources.registry import Registry, load_dotenv
from koewake.sources.snapshots import Snapshots

FIELDS = "id file_name status duration_ms asr_text emotion emotion_final quality_issues raw_asr_text source_dir".split()
SAMPLE = [
    (1, "rec001.wav", "done", 3200.0, "今日は本当に嬉しいよ！", "happy", None, "[]", "", "/data/a"),
    (2, "rec002.wav", "done", 2800.0, "もう、泣きそうだよ…", "sad", "", '["采样率 44100Hz (需要 32000Hz)"]', "", "/data/a"),
    (3, "rec003.wav", "filtered", 900.0, "えーと…", "neutral", None, "[]", "", "/data/a"),
    (4, "rec004.wav", "filtered", 120.0, "", "neutral", None, '["duration too short: 120ms < 500ms"]', "", "/data/b"),
    (5, "rec005.wav", "error", 4000.0, None, None, None, None, None, "/data/b"),
    (6, "rec006.wav", "pending", None, None, None, None, None, None, "/data/b"),
    (7, "rec007.wav", "processing", 500.0, None, None, None, None, None, "/data/b"),
    (8, "rec008.wav", "done", 30000.0, "ABC|日本", "angry", "happy", "not json", "ＡＢＣ|日本", ""),
]


def cache_of(spark, sample, **more):
    """Rows of the cache from the given fields; hashes are ``h<id>`` and paths follow from directory and name."""
    out = []
    for r in sample:
        d = dict(zip(FIELDS, r)) | more
        d |= {"file_hash": d.get("file_hash", f"h{d['id']}"), "file_path": f"{d.get('source_dir') or ''}/{d['file_name']}"}
        out.append(tuple(d.get(f.name) for f in S.AUDIO_CACHE))
    return spark.createDataFrame(out, S.AUDIO_CACHE)


@pytest.fixture(scope="module")
def sample(spark):
    return cache_of(spark, SAMPLE).cache()


def test_reports(sample):
    assert {r["reason"]: r["n"] for r in reports.reasons(sample).collect()} == {"语气词/噪声过滤": 1, "duration": 1, "API 错误": 1}
    assert {r["kind"]: r["n"] for r in reports.issue_kinds(sample).collect()} == {"采样率": 1, "duration": 1}
    assert sample.where(reports.has_issues(F.col("quality_issues"))).count() == 3
    assert {r["emotion"]: r["n"] for r in reports.emotion_histogram(sample).collect()} == {"happy": 1, "sad": 1, "angry": 1}
    assert {r["emotion"]: r["n"] for r in export.emotion_counts(sample).collect()} == {"happy": 2, "sad": 1}
    d = reports.dashboard(sample).first()
    assert (d["total"], d["done"], d["filtered"], d["error"], d["pending"], d["processing"], d["corrected"]) == (8, 3, 2, 1, 1, 1, 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], S.AUDIO_CACHE)
    assert reports.dashboard(none).first()["total"] == 0
    for df in (reports.reasons(none), reports.issue_kinds(none), reports.emotion_histogram(none), reports.page(none), export.list_lines(none), postprocess.run(none), C.reset_errors(none), export.latest(none)):
        assert df.count() == 0
    assert postprocess.stats(none).first()["total"] == 0
    assert not reports.neutral_alert(none).first()["alert"]


def test_scan_classes(spark):
    done = cache_of(spark, [(1, "a.wav", "done"), (2, "b.wav", "error"), (3, "f.wav", "filtered")])
    names = [("a.wav", "h1", 1000.0), ("a.wav", "h9", 1000.0), ("b.wav", "h2", 1000.0), ("c.wav", "h3", None), ("d.wav", "h4", 499.9), ("e.wav", "h5", 500.0), ("e.wav", "h6", 30000.0), ("g.wav", "h7", 30000.1), ("f.wav", "h3", 1000.0)]
    manifest = spark.createDataFrame(names, "file_name string, file_hash string, duration_ms double").withColumn("status", F.lit("clash"))
    got = {(r["file_name"], r["file_hash"]): r["scan_status"] for r in scan.classify(manifest, done).collect()}
    assert got == {
        ("a.wav", "h1"): "cached", ("a.wav", "h9"): "changed", ("b.wav", "h2"): "new", ("c.wav", "h3"): "new", ("d.wav", "h4"): "skipped",
        ("e.wav", "h5"): "new", ("e.wav", "h6"): "new", ("g.wav", "h7"): "skipped", ("f.wav", "h3"): "cached",
    }
    strict = {(r["file_name"], r["file_hash"]): r["scan_status"] for r in scan.classify(manifest, done, strict=True).collect()}
    assert strict[("f.wav", "h3")] == "new"
    s = scan.summary(scan.classify(manifest, done)).first()
    assert s["total"] == s["cached"] + s["new"] + s["changed"] + s["skipped"] == 9
    none = scan.classify(manifest, done.limit(0))
    assert none.where("scan_status = 'new'").count() == 7


def test_upsert_is_idempotent_and_keeps_keys_unique(spark, sample):
    new = [("rec003.wav", "h3", "/x/rec003.wav", 5, 900.0, "/x"), ("n2.wav", "k2", "/x/n2.wav", 1, None, "/x"), ("n1.wav", "k1", "/x/n1.wav", 1, None, "/x"), ("n1.wav", "k1", "/y/n1.wav", 2, 3.0, "/y"), ("n1.wav", "k1", None, 2, 3.0, None)]
    incoming = spark.createDataFrame(new, "file_name string, file_hash string, file_path string, file_size long, duration_ms double, source_dir string")
    once = C.upsert_pending(sample, incoming)
    twice = C.upsert_pending(once, incoming)
    assert rows(once) == rows(twice) and once.columns == sample.columns
    assert once.select(*C.KEY).distinct().count() == once.count() == 10
    got = {r["file_name"]: r for r in once.collect()}
    assert got["n2.wav"]["id"] == 9 and got["n1.wav"]["id"] == 10  # by path
    assert got["n1.wav"]["file_path"] == "/y/n1.wav" and got["rec003.wav"]["status"] == "pending" and got["rec001.wav"]["status"] == "done"
    assert rows(C.upsert_pending(sample, incoming.limit(0))) == rows(sample)


def test_state_machine(spark):
    """Every event from every state gives the expected state."""
    key = spark.createDataFrame([("f.wav", "h1")], "file_name string, file_hash string")
    result = key.select("*", *(F.lit(None).cast("double" if c == "confidence" else "string").alias(c) for c in C.RESULT))
    events = {
        "processing": lambda c: C.mark_processing(c, key),
        "done": lambda c: C.write_back(c, result.withColumn("status", F.lit("done")).withColumn("asr_text", F.lit("こんにちは"))),
        "error": lambda c: C.write_back(c, result.withColumn("status", F.lit("error")).withColumn("error_msg", F.lit("broken"))),
        "reset": C.reset_errors,
    }
    for state, event in itertools.product(S.STATUSES, events):
        c = events[event](cache_of(spark, [(1, "f.wav", state, 1000.0, "前の文")])).first()
        want = ("pending" if state == "error" else state) if event == "reset" else event
        assert c["status"] == want, (state, event)
        assert c["asr_text"] == ("こんにちは" if event == "done" else "前の文")
        assert c["error_msg"] == ("broken" if event == "error" else None)


def test_results_without_row_are_dropped(spark, sample):
    other = spark.createDataFrame([("no.wav", "no", "done")], "file_name string, file_hash string, status string").select("*", *(F.lit(None).cast("double" if c == "confidence" else "string").alias(c) for c in C.RESULT if c != "status"))
    assert rows(C.write_back(sample, other)) == rows(sample)


def test_postprocess(spark, sample):
    after = {r["id"]: r for r in postprocess.run(sample).collect()}
    assert after[3]["status"] == "filtered" and after[3]["filter_reason"] == "filler_only"
    assert after[4]["status"] == "filtered" and after[4]["filter_reason"] is None  # blank: left alone
    assert after[8]["raw_asr_text"] == "ＡＢＣ|日本"
    s = postprocess.stats(sample).first()
    assert s["total"] == 5 and s["unchanged"] == 4


def test_fill_source_dir_takes_the_longest(spark):
    c = cache_of(spark, [(1, "x.wav", "done"), (2, "y.wav", "done")])
    c = c.withColumn("file_path", F.when(F.col("id") == 1, "/data/kite_2/x.wav").otherwise("/data/kite/sub/y.wav"))
    dirs = spark.createDataFrame([("/data/kite",), ("/data/kite/sub",), ("/data/kite",)], "dir_path string")
    assert {r["id"]: r["source_dir"] for r in C.fill_source_dir(c, dirs).collect()} == {1: None, 2: "/data/kite/sub"}


def test_responses(spark):
    def reply(content, notes='[{"emotion": "happy", "language": "ja"}]'):
        return f'{{"output": {{"choices": [{{"message": {{"content": {content}, "annotations": {notes}}}}}]}}}}'

    bodies = [reply('[{"text": " a"}, {"text": "b "}]'), reply('"直"'), '{"output": {"choices": []}}', reply('"x"', "[]"), reply('"x"', '[{"emotion": "sleepy", "language": null}]'), "no json", None, '"[1]"']
    df = spark.createDataFrame([(i, 200, b) for i, b in enumerate(bodies)] + [(9, 500, bodies[0]), (10, None, bodies[0])], "i int, status_code int, body string")
    got = {r["i"]: (r["ok"], r["text"], r["emotion"], r["language"], r["confidence"]) for r in responses.parse(df).collect()}
    assert got[0] == (True, "ab", "happy", "ja", 0.9) and got[1][1] == "直"
    assert got[3] == (True, "x", "neutral", "", 0.9) and got[4][2:4] == ("neutral", "")
    for i in (2, 5, 6, 7, 9, 10):
        assert got[i] == (False, "", "neutral", "", 0.0), i


@pytest.mark.parametrize(
    "audio,text,conf,want",
    [("happy", "", None, ("audio_only", "happy", False)), ("happy", "HAPPY", 0.9, ("both_agree", "happy", False)), ("happy", "happy", 0.6, ("both_agree", "happy", False)), ("happy", "happy", 0.59, ("both_agree", "happy", True)), ("happy", "sad", 0.99, ("conflict", "happy", True))],
)
def test_merge(spark, audio, text, conf, want):
    df = spark.createDataFrame([(audio, text, conf)], "a string, t string, c double")
    assert tuple(df.select(responses.merge_emotion(F.col("a"), F.col("t"), F.col("c")).alias("m")).first()["m"]) == want


def test_versions():
    assert export.next_version(["v1", "v2", "v10", "vx", "v3.bak"]) == 11 and export.next_version([]) == 1


def test_export_files(spark, sample, tmp_path):
    import json

    src = tmp_path / "in"
    src.mkdir()
    (src / "rec001.wav").write_bytes(b"1")
    c = sample.withColumn("file_path", F.concat(F.lit(f"{src}/"), "file_name"))
    out = export.write(c, str(tmp_path / "out"))
    assert out.endswith("v1") and export.write(c, str(tmp_path / "out")).endswith("v2")
    lines = open(f"{out}/list.txt", encoding="utf-8").read().splitlines()
    assert len(lines) == 3 and lines[2].endswith("|heroine|ja|ABC 日本")
    notes = json.load(open(f"{out}/annotations.json", encoding="utf-8"))
    assert [n["emotion"]["final"] for n in notes] == ["happy", "sad", "happy"] and notes[0]["confidence"] is None
    assert (tmp_path / "out/v1/happy/rec001.wav").read_bytes() == b"1"
    assert export.write(c.limit(0), str(tmp_path / "none")) == ""


def test_snapshots(spark, sample, tmp_path):
    store = Snapshots(spark, str(tmp_path / "t"))
    assert store.read().count() == 0 and store.versions() == []
    store.write(sample)
    store.write(store.read().limit(2))  # reads the old version while the new one is written
    assert store.versions() == [1, 2] and store.read().count() == 2 and store.read(1).count() == 8
    (tmp_path / "t" / "v3").mkdir()  # a job that died
    assert store.read().count() == 2 and store.write(sample) == 4
    store.drop_before(1)
    assert store.versions() == [4]


def test_registry_and_dotenv(tmp_path):
    r = Registry(str(tmp_path / "dirs.json"))
    (tmp_path / "a").mkdir()
    assert r.all() == [] and r.add(str(tmp_path / "a")) and not r.add(str(tmp_path / "x" / ".." / "a")) and r.first() == str(tmp_path / "a")
    r.file.write_text('{"audio_dir": "%s"}' % (tmp_path / "a"))
    assert r.all() == [str(tmp_path / "a")] and r.remove(str(tmp_path / "a")) and not r.remove("/nowhere")
    (tmp_path / ".env").write_text("# x\nA=1\nB='two'\nC\nD=\"3\"\nA=4\n")
    env = {"D": "kept"}
    assert load_dotenv(str(tmp_path / ".env"), env) == {"A": "1", "B": "two"} and env["D"] == "kept"


def test_directories_of_any_depth(spark):
    from koewake.functions.paths import clean_dir

    want = {
        "/a/b/c/d/e/f/../../../../../x": "/a/x", "/a//b/": "/a/b", "/data/tmp/../a": "/data/a", "/../x": "/x", "a/../../b": "../b", "./a": "a", "/": "/",
        "": None, "  ": None, "/a/.": "/a", "/a/./b/..": "/a", "../x/..": "..", "a/..": None, "/..//..": "/", "/a/..b/.c/...": "/a/..b/.c/...", "/s" * 40 + "/.." * 39: "/s",
    }
    df = spark.createDataFrame(list(want.items()), "p string, want string")
    assert [tuple(r) for r in df.where(~clean_dir(F.col("p")).eqNullSafe(F.col("want"))).select("p", clean_dir(F.col("p"))).collect()] == []
