"""One consistent form for texts that look the same (problem 1).

Method: pairs of strings that a reader cannot tell apart are joined by union-find, over strings and over single code
points, so that the classes are transitive (a full-width Cyrillic-looking letter, its plain form and the Latin letter
end in one class). The member that the corpus uses most represents its class, also where a sign is put together from
several code points. Texts are rewritten greedily, leftmost and longest first, by two Aho-Corasick automata: one over
code points, one over longer strings (a letter and its accent, a kana and its voicing mark, the parts of a Korean
syllable).

The pairs come from the Unicode tables, from the published table of confusable signs that Spark's Unicode library has,
as far as it doesn't contradict what counts as a difference, and from a few groups that this table lacks. The rules can
be stored and used again, so that the forms of yesterday's texts stay as they are.

Defined results: null gives null; a text of which nothing shows gives the empty string; runs of blanks give one blank,
and outer blanks nothing; everything else keeps its order, but for the marks of a sign, whose order doesn't show. Letter
case, kana size, syllabary, voicing, accents, punctuation, and circled or raised signs stay different. Texts of any
length are rewritten whole.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from koewake.llm.pairs import class_sizes, pairs_of_variants, with_several
from koewake.session import materialise, ship, spread

#: Signs that fonts draw alike, as groups; the rest follows from the Unicode tables.
DRAWN_ALIKE = (
    # Latin, Greek, Cyrillic capitals
    "AΑА", "BΒВ", "CСϹ", "EΕЕ", "HΗН", "IΙІ", "JЈͿ", "KΚК", "MΜМ", "NΝ", "OΟО", "PΡР", "SЅ", "TΤТ", "XΧХ", "YΥҮ", "ZΖ",
    # small letters
    "aа", "cсϲ", "eе", "hһ", "iі", "jјϳ", "oοо", "pр", "sѕ", "xх", "yу", "dԁ", "qԛ", "wԝ", "vν",
    # kana and characters
    "ト卜", "タ夕", "カ力", "ロ口", "エ工", "ニ二", "ハ八", "チ千", "ヒ匕", "ム厶", "ノ丿", "オ才",
    # the two syllabaries where they are drawn alike
    "へヘ", "べベ", "ぺペ",
    # strokes: the long-vowel sign, the character one, dashes, a box line
    "ー一―─—━", "-‐‑−", "〜～",
    "・·‧", "'’ʼ", "µμ", "ΩΩ", "ÅÅ",
)

#: Marks that are kept apart although Unicode decomposes them to plain signs.
KEPT_TAGS = ("<circle>", "<super>", "<sub>", "<square>", "<fraction>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")

BLANK = " "
#: What shows nothing besides the categories Cf, Cc and the variation selectors.
NOTHING = "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍"
MARK = regex.compile(r"\p{M}")
TWO_MARKS = regex.compile(r"\p{M}{2,}")
VOICING = (("゛", "゙"), ("゜", "゚"))
#: A sign that is put together: a letter and its marks, or the parts of a Korean syllable.
JOINED = regex.compile(r"\P{M}\p{M}+|[\u1100-\u115F][\u1160-\u11A7][\u11A8-\u11FF]?|[가-힣][\u11A8-\u11FF]")
IN_PARTS = regex.compile(r"[\p{M}゛゜ﾞﾟᅠ-ᇿ]")
_VOICED = {0x309B: 0x3099, 0x309C: 0x309A, 0xFF9E: 0x3099, 0xFF9F: 0x309A}


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return out


def is_nothing(ch: str) -> bool:
    cp = ord(ch)
    if ch in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85":
        return False
    return unicodedata.category(ch) in ("Cf", "Cc") or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or ch in NOTHING


def is_blank(ch: str) -> bool:
    return ch.isspace() or unicodedata.category(ch) in ("Zs", "Zl", "Zp")


@lru_cache(1)
def look_alikes() -> tuple[tuple[str, str], ...]:
    """Pairs of strings that look alike by the Unicode tables and the groups above: code points, and joined letters."""
    pairs: list[tuple[str, str]] = []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if is_nothing(ch):
            pairs.append((ch, ""))
            continue
        if is_blank(ch):
            pairs.append((ch, BLANK))
            continue
        parts = unicodedata.decomposition(ch).split()
        if not parts:
            continue
        if parts[0][0] == "<":
            if parts[0] in KEPT_TAGS:
                continue
            to = "".join(chr(int(x, 16)) for x in parts[1:])
            # wide, narrow and other compatible forms of one sign, and joined letters; no spelled-out signs
            if len(to) == 1 or (parts[0] == "<compat>" and to.isalpha()):
                pairs.append((ch, to))
        elif len(parts) == 1:
            pairs.append((ch, chr(int(parts[0], 16))))
    for group in DRAWN_ALIKE:
        pairs += [(group[0], x) for x in group[1:]]
    pairs += VOICING
    return tuple(pairs)


_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}]")


def fits(a: str, b: str) -> bool:
    """Whether a pair of the table of confusable signs is one that a reader takes for the same sign.

    Letters of one case, digits of one value, and operators that are drawn as plain marks; not characters of the East
    Asian scripts, of which the table joins some that differ by a stroke.
    """
    x, y = unicodedata.category(a), unicodedata.category(b)
    if x[0] == y[0] == "L":
        return (x == y or "Lo" in (x, y)) and "Lm" not in (x, y) and not _EAST.match(a) and not _EAST.match(b)
    if x == y == "Nd":
        return unicodedata.digit(a) == unicodedata.digit(b)
    return x == "Sm" and (y[0] == "P" or y == "Sm") and b.isascii()


_CONFUSABLE: list[tuple[str, str]] = []
NO_TABLE = "the table of confusable signs cannot be read from the session's Unicode library (com.ibm.icu.text.SpoofChecker); stored rules work without it"


def confusable(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """Pairs of single code points that the published table of confusable signs draws alike and that ``fits``.

    An error where the session's Unicode library cannot be reached, fails on the way, or has no such table: without it a
    result would lack cases and not show it. Stored rules need no library.
    """
    if not _CONFUSABLE:
        every = [c for c in map(chr, range(0x21, sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LNPS" and not 0xAC00 <= ord(c) <= 0xD7A3]
        alike: list[tuple[str, str]] = []
        try:
            checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
            for i in range(0, len(every), 5000):
                part = every[i : i + 5000]
                alike += zip(part, checker.getSkeleton(0, "\x01".join(part)).split("\x01"), strict=True)
        except Exception as e:
            raise RuntimeError(NO_TABLE) from e
        found = []
        for a, b in alike:
            if unicodedata.category(a) == "Lu" and b == "l":  # the table has one class for small l, capital I and one
                b = "I"
            if a != b and len(b) == 1 and not a.isascii() and not unicodedata.decomposition(a) and fits(a, b):
                found.append((a, b))
        if not found:
            raise RuntimeError(NO_TABLE)
        _CONFUSABLE[:] = found  # only a whole table is kept
    return tuple(_CONFUSABLE)


@dataclass(frozen=True)
class Rules:
    """What every code point, and every longer string, that doesn't represent its class is rewritten to."""

    point: dict[str, str]
    string: dict[str, str]
    blank: str

    def to_json(self) -> str:
        return json.dumps({"point": self.point, "string": self.string, "blank": self.blank})

    @staticmethod
    def from_json(text: str) -> Rules:
        return Rules(**json.loads(text))


def _parts_of(ch: str) -> tuple[str, str] | None:
    """The two parts that a sign is put together from."""
    cp = ord(ch)
    if 0xAC00 <= cp <= 0xD7A3:  # by the rule of the Unicode standard
        at, tail = divmod(cp - 0xAC00, 28)
        return (chr(cp - tail), chr(0x11A7 + tail)) if tail else (chr(0x1100 + at // 21), chr(0x1161 + at % 21))
    d = unicodedata.decomposition(ch).split()
    return (chr(int(d[0], 16)), chr(int(d[1], 16))) if len(d) == 2 and d[0][0] != "<" else None


@lru_cache(1)
def _composed() -> tuple[tuple[int, str, str, str], ...]:
    """Signs with their two parts, and how often parts are themselves put together; those of fewer steps first."""
    deep: dict[str, int] = {}
    # marks that are put together from marks stay in parts: they belong to the sign before them
    made = {c: p for c in map(chr, range(0x80, sys.maxunicode + 1)) if not 0xD800 <= ord(c) <= 0xDFFF and unicodedata.category(c)[0] != "M" and (p := _parts_of(c))}

    def depth(c: str) -> int:
        if c not in deep:
            deep[c] = 1 + depth(made[c][0]) if c in made else 0
        return deep[c]

    return tuple((depth(c), c, *made[c]) for c in sorted(made, key=lambda c: (depth(c), c)))


def rules(counts: Mapping[str, int] | None = None, drawn: Iterable[tuple[str, str]] = ()) -> Rules:
    """The rules of a corpus. ``counts``: how often it has each code point and, by their canonical decomposition, each sign
    that is put together; without them the plain or the lower one represents. ``drawn``: further pairs of code points.
    """
    counts = counts or {}
    pairs = look_alikes()
    points = Classes()
    for a, b in pairs:
        if len(a) == 1 and len(b) <= 1:
            points.union(a, b)
    fixed = {points.find(x) for x in ["", *map(chr, range(0x20, 0x7F)), *"".join(DRAWN_ALIKE)]}
    for a, b in drawn:  # never join two classes of plain signs, or of those above
        one, two = points.find(a), points.find(b)
        if one not in fixed or two not in fixed:
            points.union(a, b)
            fixed |= {points.find(a)} if one in fixed or two in fixed else set()

    def pick(xs: list[str]) -> str:
        # nothing represents the class that shows nothing; else the most frequent, then a plain sign, then the lowest
        return "" if "" in xs else min(xs, key=lambda x: (-counts.get(x, 0), bool(unicodedata.decomposition(x)), unicodedata.category(x) == "Cc", x))

    point = {x: r for xs in points.members().values() if len(xs) > 1 for r in [pick(xs)] for x in xs if x != r}
    plain = lambda s: "".join(point.get(c, c) for c in s)

    string: dict[str, str] = {}
    stands: dict[str, str] = {}
    longer = Classes()
    in_parts: Counter[str] = Counter()
    level: dict[str, None] = {}

    def settle() -> None:
        classes: dict[str, list[str]] = {}
        for x in level:
            classes.setdefault(longer.find(x), []).append(x)
        for root, xs in classes.items():
            whole = min((x for x in xs if len(x) == 1), key=lambda x: (-counts.get(x, 0), x))
            parts = min(x for x in xs if len(x) > 1)
            r = parts if sum(in_parts[x] for x in xs) > counts.get(whole, 0) else whole
            for x in xs:
                if len(x) == 1:
                    stands[x] = r
                if x != r:
                    string[x] = r
        level.clear()

    steps = 1
    for depth, c, p, m in _composed():
        if depth > steps:  # what the next ones are put together from is known now
            settle()
            steps = depth
        c1, m1 = plain(c), plain(m)
        if c1 in stands or not m1 or not c1:
            continue
        whole = stands.get(plain(p), plain(p)) + m1
        longer.union(c1, whole)
        level[c1] = level[whole] = None
        in_parts[whole] += counts.get(unicodedata.normalize("NFD", c), 0)
    settle()
    for a, b in pairs:  # letters that a joined sign spells out
        if len(b) > 1 and unicodedata.decomposition(a)[:1] == "<":
            string[plain(a)] = plain(b)
    return Rules(point, string, plain(BLANK))


def _ordered(m: regex.Match) -> str:
    """A run of marks in canonical order."""
    out, run = [], []
    for c in m[0]:
        if unicodedata.combining(c):
            run.append(c)
        else:
            out += [*sorted(run, key=unicodedata.combining), c]
            run = []
    return "".join([*out, *sorted(run, key=unicodedata.combining)])


class Rewriter:
    """Rewrites texts to the representatives of their look-alike classes, by ``rules`` or by those that counts give."""

    def __init__(self, by: Rules | Mapping[str, int] | None = None) -> None:
        self.rules = by if isinstance(by, Rules) else rules(by)
        point, string = self.rules.point, self.rules.string
        self.first, self.second = self._automaton(point), self._automaton(string)
        self.blank = self.rules.blank
        alone = "".join(x for x in string if len(x) == 1)
        tails = "".join({x[-1] for x in string if len(x) > 1})
        self.changing, self.joining = frozenset([*point, *alone]), frozenset([*tails, *alone])  # a look-up for each sign is far cheaper than a pattern of thousands
        self.runs = regex.compile(regex.escape(self.blank, special_only=False) + "{2,}")

    def may_change(self, s: str) -> bool:
        b = self.blank
        return not self.changing.isdisjoint(s) or IN_PARTS.search(s) is not None or s[:1] == b or s[-1:] == b or b + b in s

    @staticmethod
    def _automaton(table: dict[str, str]) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for k, v in table.items():
            a.add_word(k, (len(k), v))
        a.make_automaton()
        return a

    @staticmethod
    def _greedy(a: ahocorasick.Automaton, s: str) -> str:
        out, at = [], 0
        for end, (n, to) in a.iter_long(s):
            out.append(s[at : end + 1 - n])
            out.append(to)
            at = end + 1
        out.append(s[at:])
        return "".join(out)

    def __call__(self, s: str | None) -> str | None:
        if s is None or not self.may_change(s):
            return s
        if MARK.search(s):
            s = unicodedata.normalize("NFD", s)  # brings the marks of a sign into one order, also those it has in itself
        s = TWO_MARKS.sub(_ordered, self._greedy(self.first, s))
        while not self.joining.isdisjoint(s):  # a syllable may be put together in two steps, an accent in several
            t = self._greedy(self.second, s)
            if t == s:
                break
            s = t
        return self.runs.sub(self.blank, s).strip(self.blank)


def counted(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """How often each code point that has a look-alike occurs, and each sign that is put together, by its decomposition.

    A sum over all rows; its size is bounded by the Unicode tables.
    """
    ship(df.sparkSession)
    known = {x for p in (*look_alikes(), *confusable(df.sparkSession)) for s in p for x in s} | {c for _, c, *_ in _composed()}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in batches:
            for c in b.columns:
                for x, n in Counter(c.to_pylist()).items():
                    if x:
                        total.update(x if n == 1 else {k: v * n for k, v in Counter(x).items()})
                        for m in JOINED.findall(x.translate(_VOICED)) if IN_PARTS.search(x) else ():
                            if len(sign := unicodedata.normalize("NFKC", m)) == 1:
                                total[unicodedata.normalize("NFD", sign)] += n
        rows = [(c, n) for c, n in total.items() if len(c) > 1 or c in known]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["ch", "n"])

    sums = df.select(*columns).mapInArrow(count, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))
    return {r["ch"]: r["n"] for r in sums.collect()}


def rules_of(df: DataFrame, columns: list[str]) -> Rules:
    """The rules of the texts in ``columns``."""
    return rules(counted(df, columns), confusable(df.sparkSession))


def save(made: Rules, spark: SparkSession, path: str) -> None:
    """Stores rules under a path that is new; a later version goes to another path."""
    spark.createDataFrame([(made.to_json(),)], "rules string").coalesce(1).write.text(path)


def saved(spark: SparkSession, path: str) -> Rules:
    return Rules.from_json(spark.read.text(path, wholetext=True).first()[0])


def consistent(df: DataFrame, columns: list[str], keep: list[str], suffix: str = "_form", made: Rules | None = None) -> DataFrame:
    """``keep`` and ``columns`` of ``df``, and each of ``columns`` in its consistent form, by its own rules or those given.

    Other columns are left out. A name that would clash with the added ones must be renamed by the caller.
    """
    ship(df.sparkSession)
    made = made or rules_of(df, columns)
    picked = spread(df.select(*keep, *columns))
    schema = StructType([*picked.schema.fields, *(StructField(c + suffix, StringType()) for c in columns)])

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Rewriter(made)
        at = len(keep)
        for b in batches:
            memo: dict[str | None, str | None] = {}
            forms = []
            for c in b.columns[at:]:
                col = c.to_pylist()
                for x in col:
                    if x not in memo:
                        memo[x] = r(x)
                forms.append(pa.array([memo[x] for x in col], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *forms], [*b.schema.names, *(c + suffix for c in columns)])

    return picked.mapInArrow(rewrite, schema)


def _hashed(df: DataFrame, id_col: str, text: str, raw: str, made: Rules | None) -> DataFrame:
    """Rows whose text shows something: hashes of its form ``k, k2`` and of itself ``v``, and whether ``raw`` looks alike."""
    src = df.select(F.col(id_col).alias("id"), F.col(text).alias("a"), F.col(raw).alias("r")).where(F.length("a") > 0)
    formed = consistent(src, ["a", "r"], ["id"], made=made)
    h = lambda c: [F.xxhash64(c).alias("k"), F.xxhash64(F.lit(1), c).alias("k2")]
    own = (F.length("r") > 0) & (F.col("a") != F.col("r")) & (F.col("a_form") == F.col("r_form"))
    return materialise(formed.where(F.length("a_form") > 0).select("id", *h("a_form"), F.xxhash64("a").alias("v"), own.alias("own")), "forms")


def looking_alike(df: DataFrame, id_col: str, text: str, raw: str, made: Rules | None = None) -> DataFrame:
    """Pairs ``(id_a, id_b)`` of rows whose ``text`` looks the same but isn't the same string.

    ``id_a = id_b``: ``text`` and ``raw`` of the row do so. Null and empty texts, and texts of which nothing shows,
    make no case.
    """
    rows = _hashed(df, id_col, text, raw, made)
    own = rows.where("own").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    cand = with_several(rows, ["k", "k2"], "id", "v").select("id", "k", "k2", "v")
    return own.unionByName(pairs_of_variants(cand, ["k", "k2"], "id", "v"))


def classes(df: DataFrame, id_col: str, text: str, raw: str, made: Rules | None = None) -> DataFrame:
    """``(id, class_id, rows, texts)`` of every row whose text shows something: the least id of the rows that look like it,
    how many they are, and how many different texts they have. It grows with the rows, not with their pairs.
    """
    return class_sizes(_hashed(df, id_col, text, raw, made).select("id", "k", "k2", "v"), ["k", "k2"], "id", "v")
