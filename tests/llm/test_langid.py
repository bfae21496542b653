import numpy as np
import pytest
from pyspark.sql import functions as F

from koewake.llm import langid as L

TRAIN = {
    "en": ["I left the {} at home and nobody saw it.", "Do you know where the {} was last night?", "We should have gone to the {} before noon."],
    "de": ["Ich habe den {} zu Hause vergessen und niemand hat es gesehen.", "Weißt du, wo der {} gestern Abend war?", "Wir sind seit gestern im {} und haben nichts."],
    "fr": ["J'ai oublié le {} à la maison et personne ne l'a vu.", "Tu sais où était le {} hier soir ?", "Nous sommes dans le {} depuis ce matin."],
    "es": ["Olvidé el {} en casa y nadie se dio cuenta.", "¿Sabes dónde estaba el {} anoche?", "Llevamos toda la mañana en el {} sin nada."],
    "ja": ["{}を家に忘れたけど、誰も気づかなかった。", "昨日の夜、{}はどこにあったの？", "kinou no yoru {} wa doko ni atta no"],
    "zh": ["我把{}忘在家里了，没有人看见。", "你知道昨天晚上{}在哪里吗？", "我们从早上开始就在{}里。"],
    "ko": ["집에 {}을 두고 왔는데 아무도 몰랐어요.", "어젯밤에 {}이 어디 있었는지 알아?", "우리는 아침부터 {}에 있었습니다."],
}
THINGS = ["radio", "garten", "miroir", "puente", "駅", "灯", "나무", "kite", "12", "opera", "nota", "umi"]


def labelled(things):
    return [(s.format(t), lang) for lang, ss in TRAIN.items() for s in ss for t in things]


@pytest.fixture(scope="module")
def net():
    rows = labelled(THINGS[:8]) * 3
    noise = [(t, "en" if lang != "en" else "de") for t, lang in rows[::13]]
    return L.fit(rows + noise)


def test_held_out_accuracy(net):
    rows = labelled(THINGS[8:])
    p = net.languages([L.plain(t) for t, _ in rows])
    right = [L.LANGS[int(k)] == lang for k, (_, lang) in zip(p.argmax(1), rows)]
    assert np.mean(right) >= 0.95


def test_segments():
    assert len(L.segments("Bitte warte. - 금방 갈게. - We should go, not now.")) == 3
    assert len(L.segments("I left it.…¿Te acuerdas de ello?")) == 2
    assert len(L.segments('The phrase is "coy apex 5819", keep it safe!')) == 1
    assert len(L.segments("忘れないで！ (It takes 319 minutes.)")) == 2 and len(L.segments("She said ありがとう and left.")) == 1
    assert L.segments("3 2 1") == L.segments("♪…") == L.segments("") == []


def test_labels(spark):
    names = ["ja", "ja-JP", "JPN", "Japanese", "ｊａ", "en-US", "zho", "xx", "", None, "und", "Deutsch", "es-MX"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    assert [r[0] for r in df.select(L.named_language(F.col("x"))).collect()] == ["ja"] * 5 + ["en", "zh", None, None, None, None, "de", "es"]


def test_wrong_labels(spark, net):
    rows = [
        (1, "家に忘れたけど、誰も気づかなかった。", "ja", "clash"), (2, "家に忘れたけど、誰も気づかなかった。", "en", ""), (3, "I left the radio at home and nobody saw it.", None, ""),
        (4, "I left the radio at home and nobody saw it.\n家に忘れたけど、誰も気づかなかった。", "ja", ""), (5, "3 2 1", "ja", ""), (6, None, "ja", ""), (7, "", None, ""), (8, "I left the radio at home. " * 3000, "en", ""),
        (9, "She said ありがとう and left the radio at home.", "en", ""), (3, "I left the radio at home and nobody saw it.", None, ""),
    ]
    df = spark.createDataFrame(rows, "id long, text string, language string, langs string")
    got = sorted(map(tuple, L.wrong_labels(df, "id", "text", "language", net).collect()))
    assert got == [(2, "ja"), (3, "en"), (3, "en"), (4, "en"), (4, "ja")]
    seg = L.language_segments(df.where("id = 4"), "id", "text", "language", net).collect()
    assert [s["lang"] for s in sorted(seg, key=lambda s: s["place"])] == ["en", "ja"] and all(0 < s["confidence"] <= 1 for s in seg)
    assert L.wrong_labels(df.limit(0), "id", "text", "language", net).count() == 0


def test_sample_is_bounded(spark):
    df = spark.range(3000).select("id", F.lit("ねえ、どこへ行ったの？").alias("t"), F.lit("ja").alias("l"))
    assert 0 < len(L.labelled_sample(df, "id", "t", "l", most=600)) <= 600
    assert L.labelled_sample(df.limit(0), "id", "t", "l") == []


def test_short_whole_sentences_count():
    ja = ("家に忘れたけど、誰も気づかなかった。", "ja", 0.99)
    read = lambda text, lang, p=0.97: L.languages_of([ja, (text, lang, p)], inside=L.embedded(ja[0] + text))
    for text, lang in [("Thank you.", "en"), ("정말 고마워요.", "ko"), ("고마워요!", "ko"), ("没事。", "zh"), ("Guten Morgen!", "de")]:
        assert L.segments(ja[0] + text)[1] == text and read(text, lang) == sorted(["ja", lang]), text
    assert read("정말 고마워요.", "ko", 0.7) == ["ja", "ko"]
    for text, lang, p in [("Thank you.", "en", 0.7), ("Thank you", "en", 0.97), ("Anna!", "en", 0.97), ("Anna Meier!", "es", 0.97), ("오빠!", "ko", 0.97)]:
        assert read(text, lang, p) == ["ja"], text
    assert L.embedded("彼女は「Thank you.」と言った。") == {"Thank you."} == L.embedded("「Thank you.」と彼女は言った。") and L.embedded("帰った。「Thank you.」") == set()
    assert L.languages_of([ja, ("Thank you.", "en", 0.97)], inside={"Thank you."}) == ["ja"]
    assert L.languages_of([ja, ("Thank you very much.", "en", 0.97)], inside={"Thank you very much."}) == ["en", "ja"]


def test_short_whole_sentences_are_reported(spark, net):
    df = spark.createDataFrame([(1, "家に忘れたけど、誰も気づかなかった。우리는 있었습니다.", "ja")], "id long, text string, language string")
    assert sorted(map(tuple, L.wrong_labels(df, "id", "text", "language", net).collect())) == [(1, "ja"), (1, "ko")]


def test_romanised():
    for text, want in [("わたしは駅へ行った", "watashiha e tta"), ("きょう", "kyou"), ("ちょっとマッチ", "chottomatchi"), ("シャツとジュース", "shatsutojusu"), ("ファンと学校", "fanto"), ("私は", "wa"), ("日本", ""), ("ｶﾞｯｺｳ", "gakkou"), ("っ", "")]:
        assert L.romanised(text) == want, text


def test_network_is_trained_once(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(labelled(THINGS))], "id long, t string, l string")
    net = L.network(df, "id", "t", "l", str(tmp_path))
    monkeypatch.setattr(L, "fit", None)  # no more training
    assert L.network(df.repartition(3), "id", "t", "l", str(tmp_path)) is net
    L._FITTED.clear()
    again = L.network(df, "id", "t", "l", str(tmp_path))
    x = ["hello there", "忘れないで"]
    assert again is not net and np.array_equal(again.languages(x), net.languages(x))
