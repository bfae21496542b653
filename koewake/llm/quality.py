"""Statistics of a document's text that tell prose from lists, tables and junk (problem 8).

Method: an ordered rule list, induced by incremental reduced-error pruning on labelled lines (quality_samples), decides
which lines of a document are no running sentences. The learned thresholds are exported to a SQL CASE expression and
applied natively, together with the statistics; nothing is shuffled and no Python runs over the corpus. A document is
running prose if its running lines make up at least half of its signs.

Defined results: null, empty and blank texts have null statistics and no verdict; lines that show nothing don't count;
marks of quoting and names of speakers count as signs of their line, and a line of nothing else is no running sentence;
texts of any length are measured whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from koewake.llm import rules
from koewake.llm.quality_samples import labelled_documents
from koewake.session import spread

#: Common words of running text. Articles, and words of place that lists also have, are left out.
COMMON = {
    "en": "in on at over under below about after again all although am and any are as be because been before but by can could did do does for from had has have he her him his how i if into is it its just may me more most my no nobody not of once one only or our out she should since so some than that their them then there these they this to too until up us was we were what when where which while who whoever whose why will with would yet you your without still",
    "de": "aber als auch aus bis da damit dass denn doch durch für gegen haben hat hatte hatten hier ich ihm ihn ihr ist ja kann kein man mehr mit muss müssen nach nicht niemand noch nur ob oder ohne schon sehr sein seit sich sie sind so soll um und uns von war waren warum was weil wenn wer werden wie wir wird wurde wurden zu",
    "fr": "alors après avait avaient avant avec avons bien car ce cela ces comme depuis donc dont elle elles encore est et était été être fait il ils je jusqu là leur leurs lui mais même ne nous on ont ou où par parce pas pendant personne peu plus pour pourquoi puis qu quand que qui reste s sans sera si son sont tout toute très tu va vous y",
    "es": "ahora antes aquí aunque cada como con cuando de del desde donde durante ella ellos entre era es eso esta estaba estado está están este esto fue ha había habían han hasta hay hemos junto le les lo más me mi mientras muy nada nadie ni no nos o para pero por porque pues que qué quien se sea ser si sin son su sus también tan todavía todo tras tu uno y ya",
}
#: Articles of any of the languages, as a common word of one is the article of another.
ARTICLES = "a an the der die das den dem des ein eine einen einem einer le la les l d de du un une el los las una unos unas del"
#: Endings and particles of running Korean; particles and endings of Japanese and Chinese.
COMMON_KO = r"\p{IsHangul}+(?:니다|세요|어요|아요|해요|예요|지요|까요|었다|았다|했다|이다|지만|으면|라면|는데|에서|에게|으로|때문에|기로|도록|면서|거나|고|를|을|는|와의|때도|어도|지|서)(?![\p{IsHangul}])|\p{IsHangul}+(?=[.?!])"
COMMON_JA = r"[はをがにもよね]|ま(?:した|せん|す)|で(?:す|した)?|て(?:いる|いた)|っ[たて]|ので|から|けど|な[いら]|して|と(?:いう)?|ください"
COMMON_ZH = r"[了是在没就也都很和这不有请会被们从到给还比可但因所吗呢着谁要让那我你他她它说]"

NAMES = ["common", "symbols", "digits", "ends", "word_len", "marker", "stops"]
#: The end of a sentence: a letter, then a full stop, but no file type or number.
STOP = r"[.!?…]+(?<=[\p{L}\p{M}][\"”’')»]?[.!?…]{1,9})[\"”’')»]*(?=\s|$)|[。！？]"
CLOSING = r"[.!?。！？…．]+[\p{Pe}\p{Pf}\p{Pi}\"']*\s*$"
_NO_WORD = r"[^\p{L}\p{M}\p{N}]+"
_CJK = r"[\x{3005}-\x{3007}\x{3041}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9D}\x{20000}-\x{3FFFF}]"
#: Punctuation of running text, and marks of emphasis around its words.
_PUNCTUATION = ".,!?;:'()\"*_。、，．！？；：「」『』（）…・‥“”‘’«»¿¡〜～-"


def _lit(s: str) -> str:
    return "r'" + s.replace("'", "\\x{27}") + "'"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _without(x: str, pattern: str) -> str:
    """SQL of how many signs of ``x`` match a pattern of one sign."""
    return f"(length({x}) - length(regexp_replace({x}, {_lit(pattern)}, '')))"


def _counts(x: str) -> dict[str, str]:
    """SQL of what is counted in line ``x``, each once."""
    words = sorted({w for ws in COMMON.values() for w in ws.split()} - set(ARTICLES.split()))
    known = ", ".join(f"'{w}'" for w in words)
    wide = f"{x} RLIKE {_lit(r'[\x{3000}-\x{10FFFF}]')}"  # found at once in East Asian lines, and nothing else to look for in others
    spaced = f"CASE WHEN {wide} THEN regexp_replace({x}, {_lit(_CJK)}, ' ') ELSE {x} END"
    split = f"split(lower(s), {_lit(_NO_WORD)})"  # empty at the ends only
    n = "size(ws) - CAST(ws[0] = '' AS INT) - CAST(size(ws) > 1 AND element_at(ws, -1) = '' AS INT)"
    korean = f"CASE WHEN {x} RLIKE {_lit(r'[가-힣]')} THEN regexp_count({x}, {_lit(COMMON_KO)}) ELSE 0 END"
    kana = f"CASE WHEN {x} RLIKE {_lit('[ぁ-ゖ]')} THEN regexp_count({x}, {_lit(COMMON_JA)}) WHEN {x} RLIKE {_lit(r'[一-鿿]')} THEN regexp_count({x}, {_lit(COMMON_ZH)}) ELSE 0 END"
    marks = f"regexp_replace({x}, {_lit(r'[\p{L}\p{M}\p{N}\sー]+')}, '')"  # few, so each is looked up
    return {
        # East Asian signs are those that spaces took the place of
        "words": f"transform(array({spaced}), s -> transform(array({split}), ws -> named_struct('n', {n}, 'known', size(filter(ws, w -> w IN ({known}))), "
        f"'cjk', length(replace({x}, ' ', '')) - length(replace(s, ' ', ''))))[0])[0]",
        "particles": f"CASE WHEN {wide} THEN {korean} + {kana} ELSE 0 END",
        "symbols": f"length(translate({marks}, {_text(_PUNCTUATION)}, ''))",
        "digits": _without(x, "[0-9０-９]"),
        "signs": f"length({x})",
        "ends": f"CAST(right({x}, 12) RLIKE {_lit(CLOSING)} AS INT)",
        "inked": f"length(replace({x}, ' ', ''))",
        "marker": f"CAST({x} RLIKE {_lit(r'^(?:[-*•・+#]|[(\[]?[0-9x ]{1,4}[.)\]])\s')} AS INT)",
        "stops": f"regexp_count({x}, {_lit(STOP)})",
    }


def _counted(xs: str) -> str:
    """SQL of what is counted in each of the lines ``xs``."""
    return f"transform({xs}, x -> named_struct(" + ", ".join(f"'{k}', CAST({v} AS DOUBLE)" if k != "words" else f"'words', {v}" for k, v in _counts("x").items()) + "))"


#: Signs of a line from which it is judged alone, and of its neighbours that are seen with a shorter one.
ALONE, BESIDE = 120, 80


def _features(cs: str) -> str:
    """SQL of the features of each line, from what was counted in the lines ``cs``.

    Each short line counts with its neighbours, as wrapped sentences go on over several lines; a long neighbour by the
    share of it that is seen.
    """
    beside = lambda at: f"named_struct('v', CASE WHEN c.signs < {ALONE} THEN {at} END, 'w', least(1D, {BESIDE} / greatest({at}.signs, 1D)))"
    around = [beside(f"(CASE WHEN i > 0 THEN {cs}[i - 1] END)"), beside(f"try_element_at({cs}, i + 2)")]
    seen = f"filter(array(named_struct('v', c, 'w', 1D), {', '.join(around)}), s -> s.v IS NOT NULL)"
    names = {"n": "v.words.n", "known": "v.words.known", "cjk": "v.words.cjk", **{k: f"v.{k}" for k in ("particles", "symbols", "digits", "signs", "inked", "stops", "ends")}}
    zero = "named_struct(" + ", ".join(f"'{k}', 0D" for k in [*names, "lines"]) + ")"
    step = "named_struct(" + ", ".join(f"'{k}', a.{k} + s.w * s.{v}" for k, v in names.items() if k != "ends") + ", 'ends', a.ends + s.v.ends, 'lines', a.lines + 1D)"
    size, units = "greatest(t.signs, 1D)", "greatest(t.n + t.cjk / 2.5D, 1D)"
    features = {
        "common": f"(t.known + t.particles) / {units}",
        "symbols": f"t.symbols / {size}",
        "digits": f"t.digits / {size}",
        "signs": "c.signs",
        "ends": "t.ends / t.lines",
        "word_len": f"t.inked / {units}",
        "marker": "c.marker",
        "stops": f"t.stops / {units}",
    }
    made = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in features.items()) + ")"
    return f"transform({cs}, (c, i) -> aggregate({seen}, {zero}, (a, s) -> {step}, t -> {made}))"


#: Blanks that Java's patterns don't count as such, and what ends a line.
BLANKS = r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
BREAKS = r"[\n\x{0B}\f\r\x{85}\x{2028}\x{2029}]"


def _bare(x: str) -> str:
    """A trimmed line without the marks of quoting, and the name of a speaker that has text behind it."""
    x = f"CASE WHEN left({x}, 1) = '>' THEN regexp_replace({x}, {_lit(r'^(?:\s*>)+\s*')}, '') ELSE {x} END"
    return f"CASE WHEN left({x}, 14) RLIKE '[:：]' THEN regexp_replace({x}, {_lit(r'^[\p{L}\p{M}]{1,12}\s?[:：]\s*(?=\S)')}, '') ELSE {x} END"


def _lines(text: str) -> str:
    """SQL of the lines that show something: ``x`` is what is judged, maybe empty, ``signs`` what the whole line shows."""
    hidden = f"CASE WHEN {text} RLIKE {_lit(r'[\p{Cf}]')} THEN regexp_replace({text}, {_lit(r'[\p{Cf}]+')}, '') ELSE {text} END"
    split = f"split(regexp_replace({hidden}, {_lit(BLANKS)}, ' '), {_lit(BREAKS)})"
    shown = f"filter(transform({split}, l -> trim(BOTH ' \t' FROM l)), l -> length(l) > 0)"
    return f"transform({shown}, l -> named_struct('x', {_bare('l')}, 'signs', length(l)))"


def _judged(lines: str, what: str) -> str:
    return f"transform(filter({lines}, l -> length(l.x) > 0), l -> l.{what})"


_LEARNED: dict[tuple[int, int], list[rules.Rule]] = {}


def line_features(spark: SparkSession, documents: list[tuple[list[str], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the lines of labelled documents, computed by the SQL that the corpus is measured by."""
    df = spark.createDataFrame([("\n".join(xs), prose) for xs, prose in documents], "text string, prose boolean")
    df = df.selectExpr(_lines("text") + " AS ls", "prose").selectExpr(_judged("ls", "x") + " AS xs", "prose").where("size(xs) > 0").selectExpr(f"explode(array({_counted('xs')})) AS cs", "prose")
    got = df.selectExpr(f"explode({_features('cs')}) AS f", "prose").select("f.*", "prose").toPandas()
    return got[NAMES].to_numpy(float), got["prose"].to_numpy(bool)


def learned_rules(spark: SparkSession, documents: int = 2400, seed: int = 7, tries: int = 5) -> list[rules.Rule]:
    """Rules that hold for lines that are no running prose. ``documents`` bounds the labelled documents.

    Of ``tries`` rule lists, grown and pruned on other parts of them, the one that is least wrong on as many unseen
    lines is taken; prose that is called junk counts three times.
    """
    key = (documents, seed)
    if key not in _LEARNED:
        x, y = line_features(spark, labelled_documents(documents, seed))
        unseen, prose = line_features(spark, labelled_documents(documents // 2, seed + 1))
        lists = [rules.induce(x, ~y, NAMES, seed=k) for k in range(tries)]

        def wrong(r: list[rules.Rule]) -> int:
            junk = rules.predict(r, unseen, NAMES)
            return 3 * int((junk & prose).sum()) + int((~junk & ~prose).sum())

        _LEARNED[key] = min(lists, key=wrong)
    return _LEARNED[key]


def statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text", learned: list[rules.Rule] | None = None) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, the statistics, ``prose_share`` and ``is_prose``."""
    learned = learned_rules(df.sparkSession) if learned is None else learned
    once = lambda e: f"explode(array({e}))"  # noqa: E731 - a generator is evaluated once, a projection would be repeated wherever it is used
    docs = spread(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    lines = docs.selectExpr("doc_id", "text", f"{once(_lines('coalesce(text, {empty})'.format(empty=repr(''))))} AS ls")
    lines = lines.selectExpr("doc_id", "text", "ls", f"{once(_judged('ls', 'x'))} AS xs")
    counted = lines.selectExpr("doc_id", "text", "ls", "xs", f"{once(_counted('xs'))} AS cs")
    measured = counted.selectExpr("doc_id", "text", "ls", "xs", "cs", f"{once(_features('cs'))} AS fs")
    judged = measured.selectExpr("*", f"transform(fs, f -> {rules.to_sql(learned, 'f.')}) AS junk", f"transform({_judged('ls', 'signs')}, n -> CAST(n AS DOUBLE)) AS own")
    total = lambda what: f"aggregate(fs, 0D, (a, f) -> a + {what})"
    n = "aggregate(ls, 0D, (a, l) -> a + l.signs)"
    mean = lambda what: f"{total(f'{what} * f.signs')} / greatest({total('f.signs')}, 1D)"
    words = "size(filter(split(text, r'\\s+'), w -> length(w) > 0))"
    s = judged.selectExpr(
        "doc_id",
        f"CAST({n} AS BIGINT) AS signs",
        "size(xs) AS lines",
        f"{words} AS words",
        f"length(regexp_replace(text, r'\\s+', '')) / greatest({words}, 1) AS mean_word_length",
        f"{mean('f.symbols')} AS symbol_share",
        f"{mean('f.digits')} AS digit_share",
        "aggregate(cs, 0D, (a, c) -> a + c.ends) / greatest(size(xs), 1) AS lines_ending_in_punctuation",
        f"{mean('f.common')} AS common_share",
        f"aggregate(zip_with(own, junk, (v, k) -> CASE WHEN k THEN 0D ELSE v END), 0D, (a, v) -> a + v) / greatest({n}, 1D) AS prose_share",
        f"{n} > 0 AS some",
    )
    known = [F.when(F.col("some"), F.col(c)).alias(c) for c in s.columns if c not in ("doc_id", "some")]
    return s.select("doc_id", *known).withColumn("is_prose", F.col("prose_share") >= 0.5)


def not_prose(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id)`` of documents of which running sentences make up less than half."""
    src = df.where(F.col(text).rlike(r"[^\s\p{Cf}\p{Zs}]"))
    return statistics(src, doc_id, text).where(~F.col("is_prose")).select("doc_id")
