"""Evaluation passages inside training documents (problem 7).

Method: q-gram lemma filtering. Of every document and every item only letters and digits count, in one case, width and
without accents. The q-grams of the items go to every task, in blocks of items if they are many. The documents of a
batch are laid end to end, their q-grams are hashed at once and looked up; a hit gives an item and a diagonal (place in
the document less place in the item). Hits are counted in overlapping bands of diagonals. A run of length L with at most
e edits shares at least L - q + 1 - e * q q-grams with the item within one band, so bands with fewer are dropped without
loss. What is left is verified by a banded alignment of all candidates at once, which knows for every place the longest
run with 0 .. e edits. The corpus is only mapped: nothing is shuffled.

Hot q-grams: a run counts by its letters, so an item keeps each of its shortest runs once; a million equal letters are
as one short run. Hits are expanded by at most ``MOST_HITS`` at a time: the documents of a batch in groups, and a
document that has more by itself in pieces that overlap by the longest run, of which those items that it is already
known to hold are left out. Nothing is dropped, and memory doesn't follow the text.

Defined results: an item counts as a whole if it is shorter than the shortest run; items and documents that are null or
without letters match nothing; a document that holds an item several times is one row, repeated documents are a row
each; documents of any length are searched whole, and items of any number.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koewake.session import materialise, ship, spread

#: Languages that are written with blanks between words are measured in words, these in letters.
BY_LETTER = ("ja", "zh")
#: Items, and letters of them, that go to every task at once; more are searched for in several passes.
MOST_ITEMS, MOST_LETTERS = 50_000, 20_000_000
#: Letters of an item that are one piece of it, of documents that are looked up at once, and hits that are expanded at once.
PIECE, BLOCK, MOST_HITS = 4096, 1 << 21, 1 << 18
_SLAB = 2048
_NEVER = np.int64(1) << 40
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.uint64((1 << 20) - 1)

_NO_LETTER = regex.compile(r"[^\p{L}\p{N}]+")
_ACCENT = regex.compile(r"(?:(?![\u3099\u309A])\p{M})+")
_ASCII_OUT = {i: None for i in range(128) if not chr(i).isalnum()}


def letters(text: str | None) -> str:
    """Letters and digits of a text in one case and width, without accents; voicing marks of kana stay."""
    if not text:
        return ""
    if text.isascii():
        return text.lower().translate(_ASCII_OUT)
    s = unicodedata.normalize("NFKC", text).casefold()
    s = unicodedata.normalize("NFC", _ACCENT.sub("", unicodedata.normalize("NFD", s)))
    return _NO_LETTER.sub("", s)


@dataclass
class Piece:
    """Letters of an item that hold some of its shortest runs that count."""

    item: int
    codes: np.ndarray
    need: np.ndarray
    """For every end, 0 to the last: the letters of the shortest run that ends there and counts."""
    shortest: int
    longest: int


def pieces(item: int, text: str | None, lang: str | None, words: int, chars: int, size: int = PIECE) -> list[Piece]:
    """The pieces of an item, which together hold each of its shortest runs once."""
    s = letters(text)
    if not s:
        return []
    if lang in BY_LETTER:
        ends, units = list(range(1, len(s) + 1)), chars
    else:
        # words are what blanks part; letters() of each, so that their sum is letters() of the whole
        sizes = [len(letters(w)) for w in unicodedata.normalize("NFKC", text).split()]
        ends, units = np.cumsum([n for n in sizes if n]).tolist(), words
    units = min(units, len(ends))
    starts = [0, *ends[:-1]]
    seen: set[str] = set()
    groups: list[list[tuple[int, int]]] = []
    last = -2
    for k in range(len(ends) - units + 1):
        a, b = starts[k], ends[k + units - 1]
        if (run := s[a:b]) in seen:
            continue
        seen.add(run)
        if k == last + 1 and b - groups[-1][0][0] <= size:
            groups[-1].append((a, b))
        else:
            groups.append([(a, b)])
        last = k
    codes = _codes(s)
    made = []
    for g in groups:
        base, n = g[0][0], g[-1][1] - g[0][0]
        from_ = np.full(n + 1, -1, np.int64)
        for a, b in g:
            from_[b - base] = a - base
        from_ = np.maximum.accumulate(from_)
        need = np.where(from_ < 0, _NEVER, np.arange(n + 1) - from_)
        made.append(Piece(item, codes[base : base + n], need, min(b - a for a, b in g), max(b - a for a, b in g)))
    return made


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * _BASE + codes[j : n + j].astype(np.uint64)
    return h ^ (h >> np.uint64(29))


def _spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``begin .. begin + n - 1`` of each, end to end."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


class Finder:
    """Looks up the q-grams of one set of pieces."""

    def __init__(self, made: list[Piece], q: int, edits: int) -> None:
        self.made, self.q, self.edits = made, q, edits
        grams = [_grams(x.codes, q) for x in made]
        h = np.concatenate([*grams, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(made)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.hashes, self.begin = np.unique(h[order], return_index=True)
        self.n = np.diff(np.append(self.begin, len(h)))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes & _MASK).astype(np.int64)] = True
        self.item = np.array([x.item for x in made])
        self.least = np.array([max(1, x.shortest - q + 1 - edits * q) for x in made])
        self.overlap = max((x.longest for x in made), default=0) + edits
        self.width = 2 * edits + 1

    def search(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, exact: bool) -> set[tuple[int, int]]:
        """``(document, item)`` of the documents that lie at ``start .. end`` of ``codes``."""
        g = _grams(codes, self.q)
        at = np.flatnonzero(self.bits[(g & _MASK).astype(np.int64)])
        k = np.searchsorted(self.hashes, g[at])
        ok = k < len(self.hashes)
        ok[ok] = self.hashes[k[ok]] == g[at[ok]]
        at, k = at[ok], k[ok]
        found: set[tuple[int, int]] = set()
        if not len(at):
            return found
        doc = np.searchsorted(start, at, "right") - 1
        hits = np.bincount(doc, self.n[k], minlength=len(start)).astype(np.int64)
        hot = hits > MOST_HITS
        turn = np.cumsum(np.where(hot, 0, hits)) // MOST_HITS  # documents of one turn have few hits together
        for t in np.unique(turn[doc[~hot[doc]]]):
            mine = ~hot[doc] & (turn[doc] == t)
            found |= self._turn(codes, start, end, doc[mine], at[mine], k[mine], (self.begin, self.n, self.owner, self.place), exact)
        for d in np.flatnonzero(hot):
            mine = doc == d
            found |= self._hot(codes, start, end, int(d), at[mine], k[mine], exact)
        return found

    def _hot(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, d: int, at: np.ndarray, k: np.ndarray, exact: bool) -> set[tuple[int, int]]:
        """As ``search`` for a document with many hits: piece by piece, and without the items that were found before."""
        found: set[tuple[int, int]] = set()
        known, held, cost = -1, (), None
        i = 0
        while i < len(at):
            if len(found) != known:
                known = len(found)
                left = ~np.isin(self.item[self.owner], [x for _, x in found])
                n = np.add.reduceat(left.astype(np.int64), self.begin)
                held = (np.cumsum(n) - n, n, self.owner[left], self.place[left])
                cost = np.append(n[k].cumsum(), 0)  # [-1] is what comes before the first
            to = max(np.searchsorted(cost[:-1], cost[i - 1] + MOST_HITS, "right"), np.searchsorted(at, at[i] + 2 * self.overlap, "right"))
            found |= self._turn(codes, start, end, np.full(to - i, d), at[i:to], k[i:to], held, exact)
            i = max(i + 1, np.searchsorted(at, at[to] - self.overlap)) if to < len(at) else to
        return found

    def _turn(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, at: np.ndarray, k: np.ndarray, held: tuple, exact: bool) -> set[tuple[int, int]]:
        """``held``: where the hits of each q-gram begin, their number, and the piece and place of each."""
        begin, n, owner, place = held
        n = n[k]
        ref = _spans(begin[k], n)
        at, doc = np.repeat(at, n), np.repeat(doc, n)
        owner = owner[ref]
        diagonal = at - place[ref]
        pair = doc * len(self.made) + owner
        # fewer hits than a band needs on all diagonals together
        _, inverse, total = np.unique(pair, return_inverse=True, return_counts=True)
        keep = total[inverse] >= self.least[owner]
        pair, diagonal = pair[keep], diagonal[keep]
        if not len(pair):
            return set()
        cands = []
        for shift in (0, self.edits + 1) if self.edits else (0,):  # overlapping bands: a run lies whole in one of them
            band = (diagonal + shift) // self.width
            low, bands = band.min(), band.max() - band.min() + 1
            key, count = np.unique(pair * bands + (band - low), return_counts=True)
            p, b = key // bands, key % bands + low
            enough = count >= self.least[p % len(self.made)]
            cands.append(np.stack([p[enough], b[enough] * self.width - shift + self.edits]))
        p, d = np.unique(np.concatenate(cands, axis=1), axis=1)
        who, what = p // len(self.made), p % len(self.made)
        holds = np.zeros(len(p), bool)
        order = np.argsort([len(self.made[o].codes) for o in what], kind="stable")
        for i in range(0, len(order), _SLAB):
            s = order[i : i + _SLAB]
            holds[s] = aligned(codes, start[who[s]], end[who[s]], [self.made[o] for o in what[s]], d[s], self.edits)[0 if exact else self.edits]
        return set(zip(who[holds].tolist(), self.item[what[holds]].tolist()))


def aligned(codes: np.ndarray, start: np.ndarray, end: np.ndarray, made: list[Piece], diagonal: np.ndarray, edits: int) -> np.ndarray:
    """Banded alignment of many candidates at once: whether each holds a run that counts with at most 0 .. ``edits`` edits.

    Of candidate i the document lies at ``start[i] .. end[i]`` of ``codes``, and the band around ``diagonal[i]``.
    """
    size, most = len(made), max(len(x.codes) for x in made)
    item = np.zeros((most, size), np.int64)
    need = np.full((most, size), _NEVER)
    for i, x in enumerate(made):
        item[: len(x.codes), i] = x.codes
        need[: len(x.codes), i] = x.need[1:]
    off = np.arange(-edits, edits + 1)[:, None]
    holds = np.zeros((edits + 1, size), bool)
    best = np.zeros((edits + 1, len(off) + 2, size), np.int64)
    for i in range(most):
        at = diagonal + i + off
        inside = (at >= start) & (at < end)
        same = inside & (codes[np.clip(at, 0, len(codes) - 1)] == item[i])
        now = np.zeros_like(best)
        for e in range(edits + 1):
            v = np.where(same, best[e, 1:-1] + 1, 0)
            if e:  # changed, left out of the document, or added to it
                v = np.maximum(v, np.maximum(best[e - 1, 1:-1] + 1, best[e - 1, 2:] + 1))
                v = np.where(inside, np.maximum(v, now[e - 1, :-2]), 0)
            now[e, 1:-1] = v
            holds[e] |= (v >= need[i]).any(axis=0)
        best = now
    return np.logical_or.accumulate(holds, axis=0)


_READY: dict[str, list[Finder]] = {}


def finders(key: str, given: list[tuple], words: int, chars: int, edits: int) -> list[Finder]:
    """The finders of a block of items, made once for each worker."""
    if key not in _READY:
        _READY.clear()
        groups: dict[int, list[Piece]] = {}
        for i, (_, text, lang) in enumerate(given):
            for x in pieces(i, text, lang, words, chars):  # as long q-grams as the lemma allows, of few sizes
                q = max(1, min(12, x.shortest // (edits + 2)))
                groups.setdefault(next(s for s in (12, 8, 6, 4, 3, 2, 1) if s <= q), []).append(x)
        _READY[key] = [Finder(xs, q, edits) for q, xs in sorted(groups.items())]
    return _READY[key]


def held(texts: Iterable[str | None], fs: list[Finder], exact: bool) -> Iterator[tuple[int, set[int]]]:
    """``(place, items)`` of the texts that hold any; as many texts at once as make about ``BLOCK`` letters."""
    places: list[int] = []
    parts: list[str] = []
    size = 0

    def found() -> dict[int, set[int]]:
        sizes = np.array([len(p) + 1 for p in parts])
        start = np.cumsum(sizes) - sizes
        codes = _codes("\0".join(parts))
        out: dict[int, set[int]] = {}
        for f in fs:
            for d, item in f.search(codes, start, start + sizes - 1, exact):
                out.setdefault(places[d], set()).add(item)
        return out

    longest = max((f.overlap for f in fs), default=0)
    for place, text in enumerate(texts):
        s = letters(text)
        if len(s) > 2 * BLOCK:  # alone, in overlapping parts
            yield from found().items() if parts else ()
            items: set[int] = set()
            for a in range(0, len(s), BLOCK):
                places, parts = [place], [s[a : a + BLOCK + longest]]
                items |= found().get(place, set())
            places, parts, size = [], [], 0
            if items:
                yield place, items
            continue
        if s:
            places.append(place)
            parts.append(s)
            size += len(s)
        if size > BLOCK:
            yield from found().items()
            places, parts, size = [], [], 0
    if parts:
        yield from found().items()


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", words: int = 12, chars: int = 24, edits: int = 1, exact: bool = True) -> DataFrame:
    """Rows ``(doc_id, item_id)``: documents that hold an item whole, or a run of ``words`` words or ``chars`` letters.

    ``edits``: edits that the filter and the alignment allow for; with ``exact`` the alignment must find a run without any.
    """
    ship(docs.sparkSession)
    given = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"), "lang")
    n, size = given.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, -(-n // MOST_ITEMS), -(-size // MOST_LETTERS))
    src = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0))
    if passes == 1:
        return _search(src, given, words, chars, edits, exact)
    part = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    return reduce(DataFrame.unionByName, [materialise(_search(src, given.where(part == i), words, chars, edits, exact), "leaks") for i in range(passes)])


def _search(src: DataFrame, items: DataFrame, words: int, chars: int, edits: int, exact: bool) -> DataFrame:
    given = [tuple(r) for r in items.collect()]  # as many as MOST_ITEMS and MOST_LETTERS allow
    key = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = finders(key, given, words, chars, edits)
        for b in batches:
            ids = b.column(0).to_pylist()
            pairs = [(ids[at], i) for at, some in held((t.as_py() for t in b.column(1)), fs, exact) for i in sorted({given[x][0] for x in some})]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], ["doc_id", "item_id"])

    return src.mapInArrow(run, "doc_id long, item_id long")
