import itertools
import unicodedata
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from koewake.llm import lookalike
from koewake.llm.pairs import pairs_of_variants, pairs_within, with_several

SAME = [
    ("ｶﾞﾗｽ", "ガラス"), ("é", "é"), ("е́", "é"), ("한", "한"), ("한", "한"), ("ＡＢＣ　１", "ABC 1"), ("a‍b﻿", "ab"), ("⾔", "言"),
    ("コードネーム", "コ―ドネ一ム"), ("コード", "コ─ド"), ("ế", "ế"), ("ё", "ë"), ("ﬁn", "fin"), ("か゛", "が"), ("ﾍﾞ", "べ"), ("a  b\n", " a b"), ("Па", "Пa"), ("ộ", "ộ"), ("〜", "～"),
]
OTHER = [("①", "1"), ("x²", "x2"), ("A", "a"), ("か", "が"), ("や", "ゃ"), ("ひ", "ヒ"), ("é", "e"), ("。", ""), ("は", "ば"), ("…", "...")]


@pytest.mark.parametrize("counts", [None, {"ー": 9, "一": 10, " ": 5, "e": 3, "е": 7, "、": 2}])
def test_classes(counts):
    r = lookalike.Rewriter(counts)
    for a, b in SAME:
        assert r(a) == r(b), (a, b)
    for a, b in OTHER:
        assert r(a) != r(b), (a, b)
    assert r(None) is None and r("") == "" and r("​") == ""
    for a, b in SAME:
        assert r(r(a)) == r(a)


def test_frequency_chooses():
    assert lookalike.Rewriter({"！": 5, "!": 1})("!") == "！" and lookalike.Rewriter({"!": 5})("！") == "!"


def test_pairs_against_brute_force(spark):
    texts = ["ガラス", "ｶﾞﾗｽ", "ガラス", "ｶ゙ラス", "ガラス！", "", None, "​", "abc", "аbc", "ABC", "abc ", "x" * 200_000, "x" * 199_999 + "х"]
    rows = [(i, t, t if i % 3 else "ｶﾞﾗｽ", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, asr_text string, raw_asr_text string, k int")
    got = sorted(map(tuple, lookalike.looking_alike(df, "id", "asr_text", "raw_asr_text").collect()))
    r = lookalike.Rewriter()
    want = [(i, j) for (i, a, *_), (j, b, *_) in itertools.combinations(rows, 2) if a and b and a != b and r(a) == r(b) and r(a)]
    want += [(i, i) for i, a, b, _ in rows if a and b and a != b and r(a) == r(b)]
    assert got == sorted(want) and want
    assert lookalike.looking_alike(df.limit(0), "id", "asr_text", "raw_asr_text").count() == 0


def test_forms_keep_rows(spark):
    df = spark.createDataFrame([(1, "é", None), (1, "é", None), (2, None, "")], "id long, a string, b string")
    out = lookalike.consistent(df, ["a", "b"], ["id"])
    assert out.count() == 3 and out.columns == ["id", "a", "b", "a_form", "b_form"]


@pytest.mark.parametrize("hot", [2, 3, 1000])
def test_hot_keys_give_every_pair_once(spark, hot):
    rows = [(i, i % 2, i % 5, i > 14) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, k int, v int, fresh boolean")
    every = [(a, b) for a, b in itertools.combinations(rows, 2) if a[1] == b[1]]
    run = lambda **o: sorted(map(tuple, pairs_within(df, ["k"], "id", hot=hot, **o).collect()))
    assert run() == sorted((a[0], b[0]) for a, b in every)
    want = sorted((a[0], b[0]) for a, b in every if a[2] != b[2])
    assert sorted(map(tuple, pairs_of_variants(df, ["k"], "id", "v", hot=hot).collect())) == want
    assert with_several(df, ["k"], "id", "v").count() == 20 and with_several(df, ["v"], "id", "v").count() == 0
    assert run(fresh="fresh") == sorted((a[0], b[0]) for a, b in every if a[3] or b[3])


@pytest.mark.parametrize("blank", [" ", "　", " ", "\n"])
def test_any_blank_may_represent(spark, blank):
    r = lookalike.Rewriter({blank: 9, " ": 1})
    assert r.blank == blank
    for a, b in [("夜　　空", "夜 空"), ("夜  空", "夜　空"), ("　夜", "夜"), ("夜　", "夜"), (" 夜\n", "夜"), ("\n\n夜", "夜")]:
        assert r(a) == r(b) and r(r(a)) == r(a), (a, b)
    df = spark.createDataFrame([(1, "夜　　空", None), (2, "夜　空", None), (3, "　夜　空　", "夜　空")], "id long, a string, r string")
    assert sorted(map(tuple, lookalike.looking_alike(df, "id", "a", "r").collect())) == [(1, 2), (1, 3), (2, 3), (3, 3)]


def test_all_roman_numerals():
    r = lookalike.Rewriter()
    for signs, letters in [("ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ", "I II III IV V VI VII VIII IX X XI XII"), ("ⅰⅱⅲⅳⅴⅵⅶⅷⅸⅹⅺⅻ", "i ii iii iv v vi vii viii ix x xi xii")]:
        for a, b in zip(signs, letters.split()):
            assert r(a) == r(b) == b


BASES = "aAeoOuyıкеΑαかはカ각가ᄀABﬁ ạếḍοιﬆやﾔⅷ"
MARKS = "\u0300\u0301\u0302\u0307\u0308\u030a\u0323\u0327\u0331\u0328\u031b\u3099\u309a\u0344\u0340"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(BASES), st.lists(st.sampled_from(MARKS), max_size=4)), max_size=5), st.sampled_from([0, 1, 2, 3]), st.randoms())
def test_canonical_equals_have_one_form(parts, which, r):
    s = "".join(b + "".join(m) for b, m in parts)
    made = MADE[which]
    forms = [unicodedata.normalize(f, s) for f in ("NFC", "NFD")]
    # the order of marks of different classes doesn't show either
    mixed = "".join(b + "".join(sorted(r.sample(m, len(m)), key=lambda c: [x for x in m if unicodedata.combining(x) == unicodedata.combining(c)].index(c) if len({unicodedata.combining(x) for x in m}) == len(m) else 0)) for b, m in parts)
    if unicodedata.normalize("NFD", mixed) == forms[1]:
        forms.append(mixed)
    assert len({made(x) for x in [s, *forms]}) == 1
    assert made(made(s)) == made(s)


def _parts(*signs):
    return {unicodedata.normalize("NFD", c): 50 for c in signs}


MADE = [
    lookalike.Rewriter(),
    lookalike.Rewriter(_parts("ạ", "が", "가", "ế", "é")),
    lookalike.Rewriter(_parts("ậ", "ǻ", "각", "ê", "ấ") | {"е": 9, "а": 9, "ạ": 3}),
    lookalike.Rewriter(_parts(*(chr(c) for c in range(0xC0, 0x180) if unicodedata.decomposition(chr(c)) and "<" not in unicodedata.decomposition(chr(c))))),
]


def test_stacks_of_marks():
    for r in MADE:
        assert r("\ufb01\u0344") == r("f\u1e2f") == r(r("\ufb01\u0344"))
        assert r("\u00e1\u0323") == r("\u1ea1\u0301") and r("\u00eb\u0323") == r("e\u0323\u0308") != r("\u00eb")
    assert MADE[3]("été") == unicodedata.normalize("NFD", "été") and MADE[0](unicodedata.normalize("NFD", "été")) == "été"


def test_counts_of_signs_in_parts(spark):
    nfd = unicodedata.normalize("NFD", "été が 각")
    df = spark.createDataFrame([(1, nfd, "é"), (2, nfd, None), (3, "ｶﾞ", "")], "id long, a string, b string")
    counts = lookalike.counted(df, ["a", "b"])
    assert counts["e\u0301"] == 4 and counts["é"] == 1 and counts["か\u3099"] == 2 and counts["カ\u3099"] == 1
    out = {r["id"]: r["b_form"] for r in lookalike.consistent(df, ["a", "b"], ["id"]).collect()}
    assert out == {1: "e\u0301", 2: None, 3: ""}  # parts are used more


def test_confusable_signs(spark, tmp_path):
    made = lookalike.rules(None, lookalike.confusable(spark))
    r = lookalike.Rewriter(made)
    for a, b in [("\u2236", ":"), ("\u2215", "/"), ("\u13AA", "A"), ("\uA4EE", "A"), ("\U0001D400", "A"), ("\u0251", "a"), ("\u03C1", "p"), ("\uFE63", "-"), ("\u0430", "a"), ("\u0406", "I")]:
        assert r(a) == r(b) == b, (a, b)
    plain = [chr(c) for c in range(33, 127)] + list("あアいイうウ一二三ロ口土士日曰鎮鎭…。、")
    forms = [r(c) for c in plain]
    assert [(a, b) for (a, x), (b, y) in itertools.combinations(zip(plain, forms), 2) if x == y] == [("ロ", "口")]
    for a, b in OTHER:
        assert r(a) != r(b)
    for a, b in SAME:
        assert r(a) == r(b)
    lookalike.save(made, spark, str(tmp_path / "v1"))
    assert lookalike.saved(spark, str(tmp_path / "v1")) == made


def test_classes_hold_every_row(spark):
    texts = ["ガラス", "ｶﾞﾗｽ", "ガラス", "abc", "аbc", None, "", "x"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id long, a string, r string")
    got = sorted(map(tuple, lookalike.classes(df, "id", "a", "r").collect()))
    assert got == [(0, 0, 3, 2), (1, 0, 3, 2), (2, 0, 3, 2), (3, 3, 2, 2), (4, 3, 2, 2), (7, 7, 1, 1)]


@pytest.mark.parametrize("fails", ["missing", "half-way", "short", "empty"])
def test_without_the_whole_table_is_an_error(spark, monkeypatch, fails):
    whole = lookalike.confusable(spark)
    made = lookalike.rules(None, whole)
    real = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    calls = []

    class Checker:
        def getSkeleton(self, _, s):
            calls.append(s)
            if fails == "empty":
                return s
            if fails == "half-way" and len(calls) > 3:
                raise OSError("gone")
            got = real.getSkeleton(0, s)
            return got.rpartition("\x01")[0] if fails == "short" else got

    def build():
        if fails == "missing":
            raise TypeError("'JavaPackage' object is not callable")
        return Checker()

    icu = SimpleNamespace(text=SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=lambda: SimpleNamespace(build=build))))
    df = spark.createDataFrame([(1, "\u13AAB", None), (2, "AB", None)], "id long, a string, r string")
    with monkeypatch.context() as m:
        m.setattr(lookalike, "_CONFUSABLE", [])
        m.setattr(spark._jvm, "com", SimpleNamespace(ibm=SimpleNamespace(icu=icu)), raising=False)
        for found in (lookalike.looking_alike, lookalike.classes):
            with pytest.raises(RuntimeError, match="table of confusable signs"):
                found(df, "id", "a", "r")
        assert lookalike._CONFUSABLE == []
        assert list(map(tuple, lookalike.looking_alike(df, "id", "a", "r", made=made).collect())) == [(1, 2)]
    assert lookalike.confusable(spark) == whole and len(whole) > 600
    assert list(map(tuple, lookalike.looking_alike(df, "id", "a", "r").collect())) == [(1, 2)]
