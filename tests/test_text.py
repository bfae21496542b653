import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from koewake.functions import text as T

# Input, normalised (None: the same), verdict
GOLDEN = [
    ("今日は本当に嬉しいよ！", None, ""),
    ("えーと…", None, "filler_only"),
    ("・・・", None, ""),
    ("（笑）", None, "too_short(1 chars)"),
    ("ﾊﾛｰ　ＡＢＣ１２３", "ハロー　ABC123", ""),
    ("abc def", None, "no_japanese"),
    ("あ。", None, "too_short(1 chars)"),
    ("  ", "", "empty"),
    ("ｶﾞｷﾞ", "ガギ", ""),
    ("♪～", None, "non_verbal"),
    ("はい。", None, "filler_only"),
    ("「」", None, "no_japanese"),
    ("えーと、あの", None, ""),
    ("a ​ b日本", "a  b日本", ""),
    ("日\t\n本", "日 本", ""),
    ("　日本　", "日本", ""),
    ("〜〜", None, "no_japanese"),
    ("カ️", "カ", "too_short(1 chars)"),
    ("々々", None, "no_japanese"),
    ("ー", None, "too_short(1 chars)"),
    ("アッ", None, ""),
    ("はい はい", None, ""),
    ("＊＊＊", None, "non_verbal"),
    ("*笑い*", None, ""),
    ("​﻿", "", "empty"),
    ("!?\x1c!", "!?!", "non_verbal"),
]


def test_golden(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, x string")
    got = {r["i"]: r for r in df.select("i", T.normalize_japanese(F.col("x")).alias("n"), T.filter_reason(T.normalize_japanese(F.col("x"))).alias("r")).collect()}
    for i, (x, n, r) in enumerate(GOLDEN):
        assert got[i]["n"] == (x if n is None else n), (i, x)
        assert got[i]["r"] == r, (i, x)


def test_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("あ" * 300_000,)], "x string")
    got = df.select(T.normalize_japanese(F.col("x")).alias("n"), T.filter_reason(F.col("x")).alias("r"), T.pipe_escape(F.col("x")).alias("p")).collect()
    assert [r["r"] for r in got] == ["empty", "empty", ""]
    assert got[0]["n"] is None and got[0]["p"] == "" and len(got[2]["n"]) == 300_000


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=30, max_size=60))
def test_a_third_pass_changes_nothing(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts if "\x00" not in t] or [("",)], "x string")
    two = T.normalize_japanese(T.normalize_japanese(F.col("x")))
    assert df.where(two != T.normalize_japanese(two)).count() == 0


@pytest.mark.parametrize("size,want", [(60, "e" * 60), (3, "eee")])
def test_preview(spark, size, want):
    df = spark.createDataFrame([("", "e" * 90)], "t string, e string")
    assert df.select(T.preview(F.col("t"), F.col("e"), size)).first()[0] == want
