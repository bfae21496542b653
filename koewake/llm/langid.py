"""The language of texts and of the segments of mixed texts, with a confidence (problem 5).

Method: a byte convolutional network. Bytes are embedded, filters of several widths run over them, each filter's
largest answer is kept, and a softmax gives the languages. It is trained in numpy, on a sample of labelled rows whose
size is bounded by a parameter, on some of its Japanese rows in Latin letters, and on a few written sentences; rows
whose label the half-trained network contradicts are left out before it goes on. A trained network is stored with the
hash of its sample and not trained again for the same one. It is applied to batches of windows of fixed length; a longer segment is the mean of
its windows.

Defined results: a text that is null, empty or without letters has no segments and no language; the language with the
most letters is the main one; another one counts only with a whole sentence. That is a segment with its own end mark that
stands by itself and is read with high confidence, also of two words (in Korean one with a sentence's ending, in Chinese
and Japanese two letters), or else one of several words; a single word or a name isn't. Texts of any length are cut into
sentences whole.
"""

from __future__ import annotations

import hashlib
import io
import math
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koewake.functions.labels import clean_label
from koewake.llm.lookalike import DRAWN_ALIKE
from koewake.llm.quality_samples import NAMES as PEOPLE
from koewake.llm.quality_samples import SENTENCES
from koewake.session import scratch, ship, spread

LANGS = ("ja", "en", "zh", "ko", "de", "fr", "es")
#: Codes and names of the languages.
CALLED = {
    "ja": "ja jp jpn japanese japanisch japonais japonés 日本語 日语 일본어",
    "en": "en eng english englisch anglais inglés 英語 英语 영어",
    "zh": "zh zho chi cmn chinese mandarin chinesisch chinois chino 中文 汉语 漢語 中国語 중국어",
    "ko": "ko kr kor korean koreanisch coréen coreano 한국어 韓国語 韩语",
    "de": "de deu ger german deutsch allemand alemán ドイツ語 德语 독일어",
    "fr": "fr fra fre french französisch français francés フランス語 法语 프랑스어",
    "es": "es spa spanish spanisch espagnol español castellano スペイン語 西班牙语 스페인어",
}
#: Kana and how they are written in Latin letters; what is put together follows by rule.
KANA = dict(zip(
    "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをんがぎぐげござじずぜぞだぢづでどばびぶべぼぱぴぷぺぽゔ",
    "a i u e o ka ki ku ke ko sa shi su se so ta chi tsu te to na ni nu ne no ha hi fu he ho ma mi mu me mo ya yu yo ra ri ru re ro wa wo n "
    "ga gi gu ge go za ji zu ze zo da ji zu de do ba bi bu be bo pa pi pu pe po vu".split(),
))
PARTICLES = {"は": "wa", "へ": "e"}
WINDOW, STRIDE = 64, 48
#: Bounds of the labelled rows that the network is trained on: their number, and the code points of each.
MOST_LABELLED, LONGEST = 12_000, 400

_LATIN = {ord(c): g[0] for g in DRAWN_ALIKE if g[0].isascii() and g[0].isalpha() for c in g[1:]}
_HIDDEN = regex.compile(r"[\p{Cf}\p{Cc}︀-️--[\t\n\r]]", regex.V1)
_DIGITS = regex.compile(r"\p{N}+")
_LETTER = regex.compile(r"\p{L}")
_WORD = regex.compile(r"[\p{L}\p{M}'’]+")
_SPACED = regex.compile(r"[\p{Latin}\p{Hangul}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
# a sentence ends after its marks and closing quotes; a full stop only before a blank, the end, a quote or another script
_END = regex.compile(r"(?:[!?。！？…]|\.(?=[\s\"”’'」』)\]…¿¡]|$|[^\p{Latin}\p{N}.]))[.!?。！？…]*[\"”’」』)\]]*\s*|[\n\r]+|／|\s[/|-]\s")
# quoted or bracketed whole sentences inside a line
_INNER = regex.compile(r"[「『(\"“]([^「『(\"“」』)\"”]*[.!?。！？…])[」』)\"”]")

_KANA_RUN = regex.compile(r"[\u3041-\u3096\u30A1-\u30FAー]+")

# its own end mark; what shows that a quoting sentence goes on; the ending of a Korean sentence of one word
_CLOSED = regex.compile(r"[.!?。！？…][\"”’」』)\]]*$")
_GOES_ON = regex.compile(r"\s*[,、，]?\s*(?:\p{Ll}|と|って|이?라고)")
_HANGUL_ONLY = regex.compile(r"(?:\p{Hangul}|\P{L})*$")
_KOREAN_END = regex.compile(r"\p{Hangul}(?:요|다|까|죠|니|네)$")


def named_language(label: Column) -> Column:
    """The language that a label names, by code or name, also with a region; null where it names none."""
    base = F.regexp_extract(clean_label(label), r"^([^-_]+)", 1)
    return F.try_element_at(_lookup({w: lang for lang, words in CALLED.items() for w in words.split()}), base)


def _lookup(table: dict) -> Column:
    """A map literal: its key is worked out once, a chain of conditions would work it out for each."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def plain(text: str) -> str:
    """A text in one width, case and script, for the network."""
    s = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).translate(_LATIN)
    return _DIGITS.sub("0", unicodedata.normalize("NFC", s).lower())


def romanised(text: str) -> str:
    """The kana of a Japanese text in Latin letters; characters, whose reading it doesn't know, part its words."""
    words = []
    for run in _KANA_RUN.findall(unicodedata.normalize("NFKC", text)):
        run = "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in run)
        out, twice = PARTICLES.get(run, ""), False
        for c in "" if out else run:
            if c == "っ":
                twice = True
            elif c in "ゃゅょ" and out.endswith("i"):
                y = "auo"["ゃゅょ".index(c)]
                out = out[:-1] + (y if out.endswith(("shi", "chi", "ji")) else "y" + y)
            elif c in "ぁぃぅぇぉ" and out:
                out = out[:-1] + "aiueo"["ぁぃぅぇぉ".index(c)]
            elif c in KANA:
                x = KANA[c]
                out += ("t" if x[0] == "c" else x[0] if twice and x[0] not in "aiueon" else "") + x if twice else x
                twice = False
        if out:
            words.append(out)
    return " ".join(words)


def segments(text: str) -> list[str]:
    """The sentences of a text that hold letters, in order."""
    s = _INNER.sub(lambda m: f"\n{m[1]}\n", _HIDDEN.sub("", text))
    out, at = [], 0
    for m in _END.finditer(s):
        out.append(s[at : m.end()])
        at = m.end()
    out.append(s[at:])
    return [x.strip() for x in out if _LETTER.search(x)]


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows, owner = [], []
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "replace")
        for at in range(0, max(1, len(b) - WINDOW + STRIDE), STRIDE):
            w = b[at : at + WINDOW]
            rows.append(w + b"\0" * (WINDOW - len(w)))
            owner.append(i)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW), np.array(owner)


class ByteNet:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, dim: int = 12, widths: tuple[int, ...] = (2, 3, 4, 6), filters: int = 24, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        self.widths = widths
        self.p = {"e": r.normal(0, 0.3, (256, dim)), "b": np.zeros(len(LANGS)), "w": r.normal(0, 0.1, (filters * len(widths), len(LANGS)))}
        for k in widths:
            self.p[f"f{k}"] = r.normal(0, math.sqrt(1 / (k * dim)), (k * dim, filters))
            self.p[f"c{k}"] = np.zeros(filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, widths=np.array(self.widths), **self.p)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> ByteNet:
        held = dict(np.load(io.BytesIO(data)))
        net = ByteNet(widths=tuple(int(k) for k in held.pop("widths")))
        net.p = held
        return net

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        e = self.p["e"][x]
        n, length, dim = e.shape
        pooled, kept = [], []
        for k in self.widths:
            view = np.lib.stride_tricks.sliding_window_view(e.reshape(n, -1), k * dim, axis=1)[:, ::dim]
            a = view @ self.p[f"f{k}"]
            at = a.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0] + self.p[f"c{k}"], 0))
            kept.append((view, at))
        h = np.concatenate(pooled, axis=1)
        z = h @ self.p["w"] + self.p["b"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), h, kept

    def predict(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + batch])[0] for i in range(0, len(x), batch)]) if len(x) else np.zeros((0, len(LANGS)), np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, h, kept = self._forward(x)
        d = z.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"w": h.T @ d, "b": d.sum(0), "e": np.zeros(self.p["e"].size)}
        dh = (d @ self.p["w"].T) * (h > 0)
        dim = self.p["e"].shape[1]
        row = np.arange(len(x))[:, None]
        for j, (k, (view, at)) in enumerate(zip(self.widths, kept)):
            f = self.p[f"f{k}"]
            part = dh[:, j * f.shape[1] : (j + 1) * f.shape[1]]
            seen = view[row, at]  # what each filter's largest answer looked at
            g[f"f{k}"] = np.einsum("nfd,nf->df", seen, part)
            g[f"c{k}"] = part.sum(0)
            back = part[:, :, None] * f.T[None]  # goes to the bytes that were looked at
            byte = x[row[:, :, None], at[:, :, None] + np.arange(k)].astype(np.int64)
            g["e"] += np.bincount((byte[..., None] * dim + np.arange(dim)).ravel(), back.ravel(), len(g["e"]))
        g["e"] = g["e"].reshape(self.p["e"].shape).astype(np.float32)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.004, batch: int = 64, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        mean = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = taken = 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                step += 1
                for k, g in self._gradients(x[at], y[at]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    now = rate * (1 - epoch / (epochs + 1))
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
                if epoch >= epochs // 2:  # the mean of the later steps is steadier than the last of them
                    taken += 1
                    for k, w in self.p.items():
                        mean[k] += (w - mean[k]) / taken
        if taken:
            self.p = mean

    def languages(self, texts: list[str]) -> np.ndarray:
        """Probabilities of the languages of plain texts."""
        x, owner = _windows(texts)
        p = np.log(self.predict(x) + 1e-9)
        out = np.zeros((len(texts), len(LANGS)))
        np.add.at(out, owner, p)
        out /= np.bincount(owner, minlength=len(texts))[:, None]
        out = np.exp(out)
        return out / out.sum(axis=1, keepdims=True)


def fit(labelled: list[tuple[str, str]], epochs: int = 6, seed: int = 0) -> ByteNet:
    """A network trained on ``(text, language)``; labels may be wrong in part."""
    texts, y = [], []
    for t, lang in labelled:
        parts = segments(t)
        if len(parts) == 1:
            texts.append(plain(parts[0]))
            y.append(LANGS.index(lang))
    for lang, sentences in SENTENCES.items():
        for i, s in enumerate(sentences):
            texts.append(plain(s.format(n=PEOPLE[i % 9], d=7)))
            y.append(LANGS.index(lang))
    latin = [r for t, lang in labelled if lang == "ja" and len(segments(t)) == 1 and len(r := romanised(t)) >= 12]
    latin = latin[:: max(1, -(-len(latin) // (len(labelled) // 12 + 1)))]  # Japanese in Latin letters, which samples hold little of
    texts += [plain(s) for s in latin]
    y += [LANGS.index("ja")] * len(latin)
    x, owner = _windows(texts)
    y = np.array(y)[owner]
    net = ByteNet(seed=seed)
    epochs = max(epochs, 40_000 // len(x))  # few rows are gone over more often
    net.train(x, y, epochs, seed=seed)
    p = net.predict(x)
    doubt = (p[np.arange(len(y)), y] < 0.05) & (p.max(axis=1) > 0.9)
    net.train(x[~doubt], y[~doubt], max(1, epochs // 2), seed=seed + 1)
    return net


def labelled_sample(df: DataFrame, id_col: str, text: str, label: str, most: int = MOST_LABELLED, longest: int = LONGEST) -> list[tuple[str, str]]:
    """At most ``most`` rows with a label that names a language, spread over the scripts that their texts are in.

    Texts of more than ``longest`` code points are read like any other, but the network isn't trained on them.
    """
    t = F.col(text)
    has = lambda p: t.rlike(p).cast("string")
    script = F.concat(has(r"[\p{IsHiragana}\p{IsKatakana}]"), has(r"\p{IsHangul}"), has(r"\p{IsHan}"), has(r"\p{IsLatin}"))
    src = df.select(F.col(id_col).alias("id"), t.alias("text"), named_language(F.col(label)).alias("lang"), script.alias("script")).where(F.col("lang").isNotNull() & F.length("text").between(1, longest))
    counts = {r["script"]: r["count"] for r in src.groupBy("script").count().collect()}  # 16 kinds at most
    only_latin = "falsefalsefalsetrue"
    share = lambda s: most // 2 if s == only_latin else most // 12
    if not counts:
        return []
    bound = _lookup({s: int(min(1.0, share(s) / n) * 1_000_000) for s, n in counts.items()})
    keep = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < F.try_element_at(bound, F.col("script"))
    rows = src.where(keep).select("text", "lang", F.xxhash64("id", F.lit(6)).alias("o")).limit(2 * most).collect()  # about as many as ``most``
    return [(t, lang) for _, t, lang in sorted((r["o"], r["text"], r["lang"]) for r in rows)[:most]]


#: Part of a stored network's name: another number for another way of training.
_TRAINING = 3
_FITTED: dict[str, ByteNet] = {}


def network(df: DataFrame, id_col: str, text: str, label: str, store: str | None = None) -> ByteNet:
    """The network of a labelled table: trained once for a sample, and read again whenever the sample is the same.

    It is kept in this process and under ``store``, or else in the shared folder of the session; a folder that outlives
    sessions spares the training in each of them.
    """
    spark = df.sparkSession
    sample = labelled_sample(df, id_col, text, label)
    key = hashlib.sha256(repr((_TRAINING, sample, KANA, SENTENCES)).encode("utf-8", "replace")).hexdigest()[:24]
    if key not in _FITTED:
        path = f"{(store or scratch(spark)).rstrip('/')}/koewake-langid-{key}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            row = (fit(sample).to_bytes(),)
            spark.createDataFrame([row], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)
        while len(_FITTED) >= 8:
            _FITTED.pop(next(iter(_FITTED)))
        _FITTED[key] = ByteNet.from_bytes(bytes(spark.read.parquet(path).first()[0]))
    return _FITTED[key]


class Reader:
    """Reads the languages of texts; what was read before is remembered up to a bound."""

    def __init__(self, net: ByteNet, remembered: int = 200_000) -> None:
        self.net, self.remembered, self.known = net, remembered, {}

    def learn(self, texts: Iterable[str]) -> None:
        new = list(dict.fromkeys(t for t in texts if t not in self.known))
        if len(self.known) + len(new) > self.remembered:
            self.known = {}
        if new:
            for t, p in zip(new, self.net.languages(new)):
                k = int(p.argmax())
                self.known[t] = (LANGS[k], float(p[k]))

    def read(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        """For each text its segments, each with language and confidence."""
        cut = [segments(t) if t else [] for t in texts]
        flat = [[plain(s) for s in c] for c in cut]
        self.learn(list(dict.fromkeys(p for c in flat for p in c)))
        missing = [p for c in flat for p in c if p not in self.known]
        if missing:  # more new segments at once than are remembered
            self.learn(missing)
        return [[(s, *self.known[p]) for s, p in zip(c, f)] for c, f in zip(cut, flat)]


def embedded(text: str) -> set[str]:
    """The segments of a text that are quoted or bracketed inside another sentence."""
    s = _HIDDEN.sub("", text)
    found: set[str] = set()
    for m in _INNER.finditer(s):
        before = _END.split(s[: m.start()])[-1]
        if _LETTER.search(before) or _GOES_ON.match(s, m.end()):
            found.update(segments(m[1]))
    return found


def is_sentence(s: str, lang: str, p: float, inside: bool, least: float = 0.5, sure: float = 0.9) -> bool:
    """Whether a segment is a whole sentence: by its own end mark, or by several words where it has none or lies inside another."""
    words, letters, cjk = _WORD.findall(s), len(_LETTER.findall(s)), _CJK.search(s)
    if p < least:
        return False
    if letters >= 4 if cjk else len(words) >= 3:
        return True
    if inside or not _CLOSED.search(s) or (p < sure and not (lang == "ko" and _HANGUL_ONLY.match(s))):  # one language alone writes Hangul
        return False
    if cjk:
        return letters >= 2
    if len(words) == 1:
        return bool(_KOREAN_END.search(words[0]))
    return lang == "de" or not all(w.istitle() for w in words)  # two names


def languages_of(read: list[tuple[str, str, float]], least: float = 0.5, inside: set[str] | frozenset[str] = frozenset()) -> list[str]:
    """The languages of a text: the main one, and others with a whole sentence. ``inside``: its ``embedded`` segments."""
    letters: dict[str, int] = {}
    for s, lang, _ in read:
        letters[lang] = letters.get(lang, 0) + len(_LETTER.findall(s)) * (2 if _CJK.search(s) else 1)
    if not letters:
        return []
    main = max(letters, key=lambda x: (letters[x], x))
    whole = {lang for s, lang, p in read if lang != main and is_sentence(s, lang, p, s in inside, least)}
    return sorted({main} | whole)


def read_languages(df: DataFrame, id_col: str, text: str, net: ByteNet, keep: list[str] | None = None) -> DataFrame:
    """Rows ``(id, *keep, langs, segments)`` of all rows whose text has letters."""
    ship(df.sparkSession)
    keep = keep or []
    src = spread(df.select(F.col(id_col).alias("id"), *keep, F.col(text).alias("text")).where(F.length("text") > 0))
    piece = pa.struct([("segment", pa.string()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net)
        for b in batches:
            col = b.column(b.num_columns - 1).to_pylist()
            distinct = list(dict.fromkeys(col))
            read = dict(zip(distinct, reader.read(distinct)))
            langs = {t: languages_of(r, inside=embedded(t) if len({lang for _, lang, _ in r}) > 1 else frozenset()) for t, r in read.items()}
            rows = [[{"segment": s, "lang": lang, "confidence": p} for s, lang, p in read[t]] for t in col]
            out = [*b.columns[:-1], pa.array([langs[t] for t in col], pa.list_(pa.string())), pa.array(rows, pa.list_(piece))]
            yield pa.RecordBatch.from_arrays(out, [*b.schema.names[:-1], "langs", "segments"])

    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in ["id", *keep])
    read = src.mapInArrow(run, f"{kinds}, langs array<string>, segments array<struct<segment:string,lang:string,confidence:double>>")
    return read.where(F.size("langs") > 0)


def wrong_labels(df: DataFrame, id_col: str, text: str, label: str, net: ByteNet | None = None) -> DataFrame:
    """``(id, lang)``: each language of the texts that aren't in exactly the one language that their label names."""
    net = net or network(df, id_col, text, label)
    src = df.withColumn("named", named_language(F.col(label)))
    read = read_languages(src, id_col, text, net, ["named"])
    return read.where(~F.col("langs").eqNullSafe(F.array("named"))).select("id", F.explode("langs").alias("lang"))


def language_segments(df: DataFrame, id_col: str, text: str, label: str, net: ByteNet | None = None) -> DataFrame:
    """``(id, place, segment, lang, confidence)`` of every segment of every text."""
    net = net or network(df, id_col, text, label)
    read = read_languages(df, id_col, text, net)
    return read.select("id", F.posexplode("segments").alias("place", "s")).select("id", "place", "s.segment", "s.lang", "s.confidence")
