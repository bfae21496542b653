"""Encoding, leaked passages, quality."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from koewake.llm import encode as E
from koewake.llm import leakage, quality, rules

LONG = "The quick brown fox, it's 42 years old... 日本語のテキスト、 été  \n\n\t x" * 700


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80), st.integers(1, 20))
def test_parts_encode_as_the_whole(text, size):
    assert E.encode_text(text, size=size) == E.encoding().encode_ordinary(text)
    assert E.decode_ids(E.encode_text(text, size=size)) == text


def test_encode(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, ""), (3, None), (4, LONG), (5, "<|endoftext|>"), (6, "👩‍🎤 \U00020bb7"), (7, "あ" * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = E.encode(df, "doc_id", "text")
    got = [(r["doc_id"], r["ids"]) for r in out.collect()]
    assert len(got) == 8 and dict(got)[2] == [] and dict(got)[3] == [] and max(dict(got)[5]) < 50256
    assert dict(got)[4] == E.encoding().encode_ordinary(LONG)
    back = {r["doc_id"]: r["text"] for r in E.decode(out, "doc_id").collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    assert E.encode(df.limit(0), "doc_id", "text").count() == 0


def test_rank_file_comes_with_the_session(spark):
    import os

    from pyspark import SparkFiles

    E.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text").count()
    assert os.path.exists(SparkFiles.get(os.path.basename(E.RANKS))) and E.here(E.RANKS) == SparkFiles.get(os.path.basename(E.RANKS))
    assert E.here("/no/such/ranks") == "/no/such/ranks"


WORDS = "lantern bridge salt river copper winter garden mirror stone whistle letter candle harbour pocket thunder velvet meadow basket window feather".split()


def passage(r, n=30):
    return " ".join(r.choice(WORDS) + str(r.randint(10, 99)) for _ in range(n))


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_leaks_against_brute_force(spark, edits):
    r = random.Random(3)
    items = [(i, passage(r).capitalize() + ".", "en") for i in range(20)]
    kana = "あいうえおかきくけこさしすせそたちつてと"
    items += [(100 + i, "".join(r.choice(kana) for _ in range(60)) + "。", "ja") for i in range(5)] + [(200, "短い文です", "ja"), (201, "Only five words in here", "en"), (202, None, "en"), (203, "...", "en")]
    docs = []
    for i in range(120):
        k, text, lang = r.choice(items)
        filler = passage(r, 20)
        if text and lang == "en" and k < 100:
            w = text.split()
            n = r.randint(9, 15)
            a = r.randint(0, len(w) - n)
            docs.append((i, f"{filler}. {'- '.join(x.upper() for x in w[a : a + n])}\n{filler}"))
        elif text and k < 200:
            n = r.randint(21, 27)
            a = r.randint(0, 60 - n)
            docs.append((i, f"序文{' '.join(text[a : a + n])}終わり"))
        else:
            docs.append((i, filler if r.random() < 0.5 else f"x {text} y"))
    docs += [(900, None), (901, ""), (902, "!!!"), (903, passage(r, 60_000) + " " + items[3][1]), (904, items[3][1]), (904, items[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    e = spark.createDataFrame(items, "item_id long, text string, lang string")
    got = sorted(map(tuple, leakage.leaks(d, e, edits=edits).collect()))
    runs = []
    for k, text, lang in items:
        if text and leakage.letters(text):
            units = [leakage.letters(w) for w in text.split()] if lang == "en" else list(leakage.letters(text))
            n = min(len(units), 12 if lang == "en" else 24)
            runs += [(k, "".join(units[j : j + n])) for j in range(len(units) - n + 1)]
    want = sorted((i, k) for i, t in docs for k in {k for k, s in runs if s in leakage.letters(t)})
    assert got == want and len(want) > 20
    assert leakage.leaks(d.limit(0), e).count() == leakage.leaks(d, e.limit(0)).count() == 0


def brute(docs, items, edits=0):
    """Pairs of a document and an item of which a shortest run lies in it, by search for every run."""
    out = set()
    for k, text, lang in items:
        s = leakage.letters(text)
        sizes = [1] * len(s) if lang != "en" else [len(leakage.letters(w)) for w in text.split()]
        ends = list(np.cumsum(sizes))
        n = min(len(ends), 12 if lang == "en" else 24)
        runs = {s[(ends[j] - sizes[j]) : ends[j + n - 1]] for j in range(len(ends) - n + 1)}
        out |= {(i, k) for i, t in docs for r in runs if r in leakage.letters(t)}
    return sorted(out)


@pytest.mark.parametrize("limits", [(1 << 21, 1 << 20, 4096, 50_000), (300, 60, 40, 2)])
def test_hot_grams_and_small_bounds(spark, monkeypatch, limits):
    for name, v in zip(("BLOCK", "MOST_HITS", "PIECE", "MOST_ITEMS"), limits):
        monkeypatch.setattr(leakage, name, v)
    r = random.Random(8)
    ab = "".join(r.choice("あい") for _ in range(400))
    items = [(1, "あ" * 90, "ja"), (2, "あい" * 50, "ja"), (3, ab, "ja"), (4, "あ" * 23 + "い" + "う" * 23, "ja"), (5, "ha " * 40, "en"), (6, passage(r), "en"), (7, "あ" * 23 + "い" + "あ" * 23 + "う", "zh")]
    docs = [(1, "あ" * 5000), (2, "あい" * 700), (3, "い" + ab[100:123] + "う" + ab[100:124]), (4, ("あ" * 23 + "い") * 200), (5, "ha" * 300), (6, items[5][1].upper()), (7, "う" * 23 + "い"), (8, "".join(r.choice("あい") for _ in range(3000))), (6, items[5][1])]
    docs += [(9, passage(r, 400) + items[5][1] + "あ" * 3000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    e = spark.createDataFrame(items, "item_id long, text string, lang string")
    fs = leakage.finders("test", items, 12, 24, 1)  # in this process, where the bounds are changed
    got = sorted((docs[at][0], items[k][0]) for at, some in leakage.held([t for _, t in docs], fs, True) for k in some)
    leakage._READY.clear()
    want = sorted([*brute(docs, items), (6, 6)])
    assert got == want and len(want) > 8
    assert sorted(map(tuple, leakage.leaks(d, e).collect())) == want


def test_equal_letters_stay_bounded():
    import resource
    import time

    began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    cases = [
        ([(1, "あ" * 5000, "ja")], "あ" * 1_000_000, {1}),
        ([(1, "あ" * 5000, "ja")], ("あ" * 23 + "い") * 40_000, None),
        ([(1, "あいう" * 2000, "ja"), (2, "x " * 3000, "en")], "あうい" * 300_000 + "x" * 100_000, {2}),
    ]
    for items, text, want in cases:
        fs = leakage.finders(items[0][1][:2] + text[23], items, 12, 24, 1)
        got = [(at, {items[k][0] for k in some}) for at, some in leakage.held([text, None], fs, True)]
        assert got == ([(0, want)] if want else [])
    leakage._READY.clear()
    assert time.perf_counter() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_near_leaks(spark):
    r = random.Random(5)
    text = passage(r)
    broken = text.split()[:14]
    broken[6] = broken[6][:-1] + "x"
    d = spark.createDataFrame([(1, " ".join(broken)), (2, passage(r))], "doc_id long, text string")
    e = spark.createDataFrame([(1, text, "en")], "item_id long, text string, lang string")
    assert leakage.leaks(d, e, edits=1).count() == 0
    assert [tuple(x) for x in leakage.leaks(d, e, edits=1, exact=False).collect()] == [(1, 1)]


def test_letters():
    assert leakage.letters("Ａb-c É́ ①２!") == "abce12" and leakage.letters("ｶﾞ が") == "ガが" and leakage.letters(None) == ""


def test_rules_learn_and_export(spark):
    r = np.random.default_rng(0)
    x = r.uniform(0, 1, (1500, 3))
    y = (x[:, 0] <= 0.3) | ((x[:, 1] > 0.8) & (x[:, 2] > 0.5))
    names = ["a", "b", "c"]
    learned = rules.induce(x, y, names, cost=2.0)
    assert (rules.predict(learned, x, names) == y).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, v)) for v in x[:200]], "a double, b double, c double")
    assert [v[0] for v in df.selectExpr(rules.to_sql(learned)).collect()] == rules.predict(learned, x[:200], names).tolist()
    assert rules.induce(x[:0], y[:0], names) == [] and rules.to_sql([]) == "false"


def test_quality(spark):
    from koewake.llm.quality_samples import labelled_documents

    held_out = labelled_documents(400, seed=91)
    rows = [(i, "\n".join(t)) for i, (t, _) in enumerate(held_out)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("xs", F.lit("clash"))
    bad = {r["doc_id"] for r in quality.not_prose(df).collect()}
    right = [(i in bad) != prose for i, (_, prose) in enumerate(held_out)]
    assert np.mean(right) >= 0.93


def test_quality_edges(spark):
    prose = "When the rain was over, we went back to the house and nobody said a word about it."
    table = "\n".join(f"file_{i}.wav,{i * 37},0.{i}" for i in range(12))
    rows = [(1, prose), (2, table), (3, None), (4, ""), (5, " \n　\t "), (6, prose + "\n" + table), (7, (prose + " ") * 5000), (8, f"{prose}\n- salt"), (1, prose), (9, "> " + prose[:40] + "\n> " + prose[40:]), (10, "ANNA: " + prose)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.statistics(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["is_prose"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [True, False, None, None, None, False, True, True, True, True]
    assert by[1]["words"] == len(prose.split()) and by[1]["lines_ending_in_punctuation"] == 1.0 and by[3]["words"] is None
    assert {r["doc_id"] for r in quality.not_prose(df).collect()} == {2, 6}
    assert quality.statistics(df.limit(0)).count() == 0


def test_labels_and_quote_marks_alone_are_no_prose(spark):
    prose = "When the rain was over, we went back to the house and nobody said a word about it."
    rows = [(1, "Name:\nDate:\nPlace:"), (2, ">\n> >\n>"), (3, "Name: \n> \n日付：　"), (4, " \n　"), (5, f"> {prose}\n>\n> {prose}"), (6, f"ANNA: {prose}"), (7, "名前：​\n年齢：​"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r["doc_id"]: r for r in quality.statistics(df).collect()}
    assert [by[i]["is_prose"] for i in range(1, 9)] == [False, False, False, None, True, True, False, None]
    assert {r["doc_id"] for r in quality.not_prose(df).collect()} == {1, 2, 3, 7}
    assert by[1]["signs"] == 16 and by[2]["signs"] == 5 and by[6]["signs"] == len(prose) + 6
