import itertools

import pytest

from koewake.llm import history as H
from koewake.session import new_path

FIELDS = "id long, file_hash string, file_name string, source_dir string, created_at timestamp, k string"


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("x_take_0012.wav", "X-Take-12.mp3", True),
        ("x_take_0012.wav", "Copy of x_take_0012 (1).wav", True),
        ("x_take_0012.wav", "コピー ～ x_take_０１２_32k.wav", True),
        ("ﾗｲﾊﾞﾙ_朝_01.wav", "ライバル 朝 1 - コピー.flac", True),
        ("scene1.wav", "scene1 copy 2.wav", True),
        ("scene1.wav", "scene1 - コピー (2).wav", True),
        ("scene_mono_12.wav", "scene.wav", False),
        ("x_take_0012.wav", "x_take_0013.wav", False),
        ("x_take_0012.wav", "take_x_0012.wav", False),
        ("x_12_take.wav", "x_take_12.wav", False),
        ("x_take2_0012.wav", "x_take3_0012.wav", False),
    ],
)
def test_names(a, b, same):
    assert (H.name_parts(a) == H.name_parts(b)) is same


def test_slips():
    assert H.slips("torvind", "trovind", 2) == 1 and H.slips("quellan", "qelan", 2) == 2 and H.slips("abc", "xyz", 2) == 3
    assert H.slips_allowed("主人公", "転校生") == 0 and H.slips_allowed("mic", "mi") == 0 and H.slips_allowed("phone", "pohe") == 2
    for a, b in [("phone", "pohe"), ("storm", "sotrm"), ("take", "tae"), ("whisper", "whsper")]:
        assert H.shortened(a) & H.shortened(b)


def sample(spark):
    import datetime as d

    names = [
        "hinari_train_farewell_0015.wav", "hinari_train_farewell_15 (1).mp3", "hniari_train_farewell_0015.wav", "hinari_trian_farwell_0015.wav", "hinari_train_farewell_0016.wav", "hinari_visit_farewell_0015.wav",
        "mic1.wav", "mic2.wav", "mci1.wav", "", None, "♪.wav", "☆.wav", "copy.wav", "hinari_train_farewell_0015.wav",
    ]
    out = []
    for i, (n, where) in enumerate(itertools.product(names, ["/data/a", "/data//a/", "/data/tmp/../a", "/data/b", "", None])):
        out.append((i, f"H{i % 40}".upper() if i % 2 else f"h{i % 40}", n, where, d.datetime(2025, 1, 1 + i % 4), "clash"))
    out += [(1000, None, None, None, None, None), (1001, "", "", "", None, None), (1002, " h1 ", "x.wav", "/q", None, None)]
    return spark.createDataFrame(out, FIELDS), out


def truth(rows):
    def same(a, b):
        if a[1] and b[1] and a[1].strip() and a[1].strip().lower() == b[1].strip().lower():
            return True
        da, db = (None if not r[3] else r[3].replace("//", "/").replace("tmp/../", "").rstrip("/") for r in (a, b))
        if not da or da != db or not a[2] or not b[2]:
            return False
        (ha, wa), (hb, wb) = H.name_parts(a[2]), H.name_parts(b[2])
        return ha == hb and len(wa) == len(wb) and all(H.slips(x, y, H.slips_allowed(x, y)) <= H.slips_allowed(x, y) for x, y in zip(wa, wb))

    return sorted((min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations(rows, 2) if same(a, b))


def test_against_brute_force(spark):
    df, rows = sample(spark)
    assert sorted(map(tuple, H.same_recordings(df, buckets=3).collect())) == truth(rows)


def tables(spark):
    return [t.name for t in spark.catalog.listTables() if t.name.startswith("koewake_")]


def test_days_against_history_give_the_same(spark):
    df, rows = sample(spark)
    path, got = new_path(spark, "test-history"), []
    first = H.History(spark, path, buckets=3)
    got += first.ingest(df.where("created_at IS NULL OR day(created_at) < 3"), "backlog").collect()
    n_keys = spark.table(first.table("keys")).count()
    day = df.where("day(created_at) = 3")
    once = first.ingest(day, "3").collect()
    held = {t: spark.table(first.table(t)).count() for t in H.TABLES}
    assert held["keys"] > n_keys
    assert sorted(first.ingest(day, "3").collect()) == sorted(once) and {t: spark.table(first.table(t)).count() for t in H.TABLES} == held  # repeated
    got += once
    first.close()
    again = H.History(spark, path)  # another session goes on
    assert again.buckets == 3 and again.batch == 2
    with pytest.raises(ValueError):
        H.History(spark, path, buckets=5)
    got += again.ingest(df.where("day(created_at) = 4")).collect()
    assert again.ingest(df.limit(0)).count() == 0
    pairs = sorted(map(tuple, got))
    assert len(pairs) == len(set(pairs)) and pairs == truth(rows)
    again.drop()
    for daily in (1, 3):
        assert sorted(map(tuple, H.same_recordings(df, day="created_at", buckets=3, daily=daily).collect())) == pairs
    assert tables(spark) == []


def test_failed_ingest_leaves_nothing(spark, monkeypatch):
    df, rows = sample(spark)
    h = H.History(spark, buckets=2)
    got = h.ingest(df.where("id < 30"), "a").collect()
    late = df.where("id >= 30")
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(h, "_pairs", lambda batch: (_ for _ in ()).throw(RuntimeError("lost")))
        h.ingest(late, "b")
    assert h.ingest(df.where("id = 30"), "b").count() >= 0 and h.batch == 2  # over what is left of the first try
    h.close()
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark.sparkContext._jsc.hadoopConfiguration()).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(h.path + "/commits/0-2.json"), False)
    other = H.History(spark, h.path)
    assert other.batch == 1 and other.names == {"a": 1}
    got += other.ingest(late, "c").collect()
    assert sorted(map(tuple, got)) == truth(rows)
    other.close()
    h.drop()


def test_hot_keys_are_cut_and_found_in_every_part(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT", 1)
    df, rows = sample(spark)
    h = H.History(spark, buckets=3)
    got = h.ingest(df.where("id % 7 = 0"), "a").collect()
    got += h.ingest(df.where("id % 7 BETWEEN 1 AND 4"), "b").collect()
    assert spark.table(h.table("hot")).count() > 3 and spark.table(h.table("keys")).where("s > 0").count() > 5
    h.compact(buckets=5)
    assert spark.table(h.table("keys")).select("batch").distinct().count() == 1 and h.buckets == 5
    again = H.History(spark, h.path)
    got += again.ingest(df.where("id % 7 > 4"), "c").collect()
    assert sorted(map(tuple, got)) == truth(rows)
    with pytest.raises(ValueError):
        again.ingest(df.limit(1), "a")
    again.close()
    h.drop()


def test_coverage(spark):
    import datetime as d

    old = [(1, "h1", "mia_park_0001.wav", "/a"), (2, "h2", "mia_bridge_0002.wav", "/a"), (3, None, None, "/b")]
    new = [(4, "H1 ", "x_0009.wav", "/b"), (5, "h9", "mia_bridge_1.wav", "/a/"), (6, "", "mia_station_1.wav", "/a"), (7, None, "mia_bridge_1.wav", "/b"), (8, "h7", "", None)]
    rows = [(*r, d.datetime(2025, 1, 1), "") for r in old] + [(*r, d.datetime(2025, 1, 2), "") for r in new]
    df = spark.createDataFrame(rows, FIELDS)
    want = [(4, True, 2, 0), (5, False, 3, 3), (6, False, 3, 2), (7, False, 3, 0), (8, False, 0, 0)]
    assert sorted(map(tuple, H.covered_by_history(df, "created_at", buckets=2).collect())) == want
    h = H.History(spark)
    assert sorted(map(tuple, h.coverage(df.where("id IN (5, 8)")).collect())) == [(5, False, 3, 0), (8, False, 0, 0)]
    h.drop()


def test_many_near_words_are_joined(spark, monkeypatch):
    df, rows = sample(spark)
    monkeypatch.setattr(H, "MOST_SENT", 1)
    assert sorted(map(tuple, H.same_recordings(df, buckets=2).collect())) == truth(rows)


def test_bucketed_join_has_no_shuffle_of_the_history(spark):
    df, _ = sample(spark)
    h = H.History(spark, buckets=5)
    h.ingest(df.where("id < 40"), "a")
    h.ingest(df.where("id >= 40"), "b")
    asked = h._of("keys", 2).select("k", "k2", "s").distinct()
    plan = h._before("keys", 2).join(asked.hint("shuffle_hash"), ["k", "k2", "s"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan
    h.drop()


def named(spark, names):
    """Rows of one directory, the last third of them on a later day, and their true pairs."""
    import datetime as d

    rows = [(i, None, n, "/data/a", d.datetime(2025, 1, 1 + (3 * i >= 2 * len(names))), "") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, FIELDS), truth(rows)


@pytest.mark.parametrize("turn", [1, -1])
def test_copies_of_copies(spark, turn):
    words = ["lullaby"] * 12 + ["lulaby", "laby", "llaby", "lullabyxx", "lulabyx"]
    df, want = named(spark, [f"{w}_0007.wav" for w in words][::turn])
    for day in (None, "created_at"):
        assert sorted(map(tuple, H.same_recordings(df, day, buckets=2).collect())) == want


@pytest.mark.parametrize("sent", [100_000, 0])
def test_slips_in_every_word(spark, monkeypatch, sent):
    monkeypatch.setattr(H, "MOST_SENT", sent)
    monkeypatch.setattr(H, "MOST_AT_ONCE", 3)
    names = ["brinta_final_battle_0084.wav"] * 2 + ["brnita_finnal_batle_0084.wav", "brintta_fnal_battel_84.wav", "brnita_finnal_batle_0085.wav"]
    df, want = named(spark, names)
    assert (0, 2) in want and sorted(map(tuple, H.same_recordings(df, "created_at", buckets=2).collect())) == want


def test_names_of_digits_only(spark):
    df, want = named(spark, ["001.wav", "1.wav", "0012_0003.wav", "12-3.wav", "2.wav", "123.wav", "12.wav", "1 (1).mp3"])
    assert want == [(0, 1), (0, 7), (1, 7), (2, 3)]
    assert sorted(map(tuple, H.same_recordings(df, "created_at", buckets=2).collect())) == want
