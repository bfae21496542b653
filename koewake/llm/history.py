"""Same recordings in new batches and in everything accepted before (problem 2).

Method: each row becomes a few 128-bit keys in a table that is bucketed by them: the hash of its whole content, and
hashes of its name within its directory (the numbers, and the words, which may have slips). A batch is written as one
more partition with the same buckets; bucket-local semi-joins find the keys of the history that it touches, and only
those rows are paired. No earlier row is read again beyond its keys, and no table of the history is ever shuffled. The
parts of the names, hashed one by one, are kept too: by them ``coverage`` tells of a batch which rows are full copies of
content and what share of each name the history has already.

Slips: a word of three or four letters may differ by one slip (a letter left out, added, changed, or two swapped), a
longer one by two, in any number of words; words with Chinese characters must be equal. A name gets one key for
itself and one for each way of putting near words that were known before in place of its own, so two names that differ
by slips meet in the key of the words known first, and a hot word costs nothing. A near word that has none known before
it is a root. A near word is left out only where a root is near to both, in whose key they then meet; roots are never
left out. What a name had in place of a key's words goes with the key, and where both names of a pair had another word,
these are compared, so two names that are near to a third one only are no pair.

Batches: the partition of a batch is overwritten if the batch is taken in again, and counts only when it has been
committed, so an ingest that fails half-way, or is repeated, neither leaves nor doubles rows. Keys with many rows in a
batch are cut into parts, which lie in different buckets. The number of buckets follows the first batch, is stored with
the history, and changes by ``compact``, which also makes one partition of all.

Defined results: rows without hash have no content key; rows without directory or name have no name key; a name that
holds nothing but marks of copying is taken as it is; repeated ids pair as rows with another id only; an empty batch
gives no pairs and leaves the history as it was.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from koewake.functions.paths import clean_dir
from koewake.llm.pairs import HOT, MOST_HOT, pairs_within
from koewake.session import drop_path, materialise, new_path, ship

#: File types, and marks that copying, saving or repairing a file adds.
FILE_TYPES = "wav wave mp3 m4a flac ogg oga opus aac wma webm mp4 mka aif aiff amr caf wv ape raw pcm".split()
LEADING_MARKS = ("copy of", "copy", "コピー", "backup of", "kopie von", "copie de", "copia de", "副本")
COPIES = ("copy", "コピー", "のコピー", "kopie", "copie", "copia", "副本")
CLOSING_MARKS = ("backup", "bak", "repaired", "fixed", "restored", "denoised", "norm", "normalized", "normalised", "mono", "stereo", "resampled", "converted", "修正", "修復", "補正")

_GAP = r"[\s_.\-~〜]"
_TYPE = regex.compile(rf"\.(?:{'|'.join(FILE_TYPES)})\s*$")
_LEAD = regex.compile(rf"^{_GAP}*(?:{'|'.join(LEADING_MARKS)}){_GAP}+")
_CLOSE = regex.compile(rf"(?:{_GAP}*\(\d{{1,3}}\)|{_GAP}*\[\d{{1,3}}\]|{_GAP}+(?:{'|'.join(CLOSING_MARKS)})|{_GAP}+(?:{'|'.join(COPIES)})(?:\s+\d{{1,2}})?|{_GAP}+\d{{1,3}}k(?:hz)?)\s*$")
_TOKEN = regex.compile(r"\p{Nd}+|[\p{L}\p{M}]+")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Cc}\uFE00-\uFE0F]")
_FIXED_WORD = regex.compile(r"\p{Han}")

#: Near words beyond which they are joined instead of sent to every worker.
MOST_SENT = 100_000
#: Keys that a worker makes before it hands them on; a name may have many.
MOST_AT_ONCE = 10_000
#: Rows of the first batch for each bucket.
BUCKET_ROWS = 2_000_000
#: Tables of the history with what they are bucketed by. ``own`` of a key: null where it is of a content, else the words
#: that the name has in other places; ``c`` is the content's hash, ``s`` the part of a key that is cut.
TABLES = {
    "keys": ("k BIGINT, k2 BIGINT, s INT, id BIGINT, own STRING, c BIGINT", "k, k2, s"),
    "hot": ("k BIGINT, k2 BIGINT, parts INT", "k, k2"),
    "words": ("cut STRING, word STRING, n BIGINT", "cut"),
    "near": ("word STRING, known STRING, root BOOLEAN", "word"),
    "parts": ("p BIGINT", "p"),
}


def name_parts(name: str) -> tuple[str, list[str]]:
    """The order and numbers of a file name, and its words, without what doesn't tell recordings apart."""
    whole = _HIDDEN.sub("", unicodedata.normalize("NFKC", name)).casefold().strip()
    s, before = whole, None
    while s != before:
        before = s
        for mark in (_TYPE, _CLOSE, _LEAD):
            t = mark.sub("", s)
            if t and (mark is _TYPE or _TOKEN.search(t)):
                s = t
    tokens = _TOKEN.findall(s)
    words = [t for t in tokens if not t[0].isdecimal()]
    head = " ".join("w" if not t[0].isdecimal() else (t.lstrip("0") or "0") for t in tokens)
    return head, words if tokens else [s]


def slips_allowed(*words: str) -> int:
    """Slips between words of which the longest counts; none in one of one or two letters or with Chinese characters."""
    if min(map(len, words)) < 3 or any(map(_FIXED_WORD.search, words)):
        return 0
    return 1 if max(map(len, words)) < 5 else 2


def slips(a: str, b: str, most: int) -> int:
    """Letters left out, added, changed or swapped between ``a`` and ``b``; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            now.append(v)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return one[-1]


def shortened(word: str) -> set[str]:
    """The word with up to as many letters left out as it may have slips."""
    n = slips_allowed(word, word + "." * (len(word) > 3))  # the other word may be longer by a letter
    return {"".join(c for i, c in enumerate(word) if i not in out) for k in range(n + 1) for out in itertools.combinations(range(len(word)), k)}


def _keys(*parts: Column) -> list[Column]:
    return [F.xxhash64(*parts).alias("k"), F.xxhash64(F.lit(1), *parts).alias("k2")]


class History:
    """Keys of all rows accepted so far, in tables bucketed by key under ``path``.

    Opening an existing ``path`` continues it, also from another session. ``buckets``: how many, instead of by the size of
    the first batch; an existing history has its own number. ``cover``: whether parts of names are kept for ``coverage``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, cover: bool = True) -> None:
        ship(spark)
        self.cover = cover
        self.spark, self.path, self.wanted = spark, (path or new_path(spark, "history")).rstrip("/"), buckets
        self.tag = f"koewake_{uuid.uuid4().hex[:12]}"
        self.buckets = self.generation = 0
        self.names: dict[str, int] = {}
        self.batch = 0
        self._temps: list[str] = []
        for r in self._commits():
            if buckets and r["buckets"] != buckets and r["generation"] >= self.generation:
                raise ValueError(f"the history has {r['buckets']} buckets, not {buckets}")
            self.batch = max(self.batch, r["batch"])
            self.names[r["name"]] = r["batch"]
            if r["generation"] >= self.generation:
                self.generation, self.buckets = r["generation"], r["buckets"]
        if self.batch:
            self._tables()

    # tables

    def _fs(self, *steps: str):
        """A path below that of the history, and its file system."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *steps]))
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[dict]:
        """What was committed: a small file for each batch."""
        at, fs = self._fs("commits")
        found = [str(s.getPath()) for s in fs.listStatus(at)] if fs.exists(at) else []
        return [json.loads(r[0]) for r in self.spark.read.text([p for p in found if p.endswith(".json")], wholetext=True).collect()] if found else []

    def _commit(self, name: str, batch: int) -> None:
        part, fs = self._fs("commits", f"{self.generation}-{batch}.part")
        out = fs.create(part, True)
        out.writeBytes(json.dumps({"batch": batch, "name": name, "buckets": self.buckets, "generation": self.generation}))
        out.close()
        to = self._fs("commits", f"{self.generation}-{batch}.json")[0]
        fs.delete(to, False)
        fs.rename(part, to)
        self.names[name], self.batch = batch, max(self.batch, batch)

    def _tables(self) -> None:
        for name, (columns, by) in TABLES.items():
            self.spark.sql(
                f"CREATE TABLE {self.table(name)} ({columns}, batch INT) USING parquet PARTITIONED BY (batch) "
                f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/g{self.generation}/{name}'"
            )
            if known := " ".join(f"PARTITION (batch = {b})" for b in sorted(set(self.names.values())) if b >= self.names.get("compacted", 0)):
                self.spark.sql(f"ALTER TABLE {self.table(name)} ADD {known}")

    def table(self, name: str) -> str:
        return f"{self.tag}_g{self.generation}_{name}"

    def _before(self, name: str, batch: int) -> DataFrame:
        return self.spark.table(self.table(name)).where(F.col("batch") < batch)

    def _of(self, name: str, batch: int) -> DataFrame:
        return self.spark.table(self.table(name)).where(F.col("batch") == batch)

    def _put(self, name: str, df: DataFrame, batch: int) -> None:
        """Writes the partition of a batch, over what an earlier try left of it; one file for each bucket."""
        columns, by = TABLES[name]
        names, by = [x.split()[0] for x in columns.split(", ")], by.split(", ")
        part = f"{self.table(name)}_{batch}"
        made = df.select(*names).repartition(self.buckets, *by).sortWithinPartitions(*by)
        made.write.bucketBy(self.buckets, *by).sortBy(*by).mode("overwrite").option("path", f"{self.path}/g{self.generation}/{name}/batch={batch}").format("parquet").saveAsTable(part)
        self.spark.sql(f"DROP TABLE {part}")  # its files stay, as a partition
        self.spark.sql(f"ALTER TABLE {self.table(name)} ADD IF NOT EXISTS PARTITION (batch = {batch})")
        self.spark.sql(f"REFRESH TABLE {self.table(name)}")

    def _none(self, name: str, batch: int) -> None:
        """The partition of a batch is empty: deletes what an earlier try left of it."""
        self.spark.sql(f"ALTER TABLE {self.table(name)} DROP IF EXISTS PARTITION (batch = {batch})")
        at, fs = self._fs(f"g{self.generation}", name, f"batch={batch}")
        fs.delete(at, True)

    def _temp(self, df: DataFrame, name: str) -> DataFrame:
        """As ``materialise``, until the batch is done."""
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self._temps.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _tidy(self) -> None:
        while self._temps:
            drop_path(self.spark, self._temps.pop())

    def close(self) -> None:
        """Forget the tables of this session; the files stay."""
        self._tidy()
        if self.buckets:
            for t in TABLES:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.table(t)}")

    def drop(self) -> None:
        """``close``, and delete the files."""
        self.close()
        drop_path(self.spark, self.path)

    # batches

    def ingest(self, rows: DataFrame, name: str | None = None) -> DataFrame:
        """Pairs ``(id_a, id_b)``, ``id_a < id_b``, of which at least one row is in ``rows``; ``rows`` joins the history.

        ``rows`` has ``id``, ``file_hash``, ``file_name`` and ``source_dir``; further columns are ignored. An id must
        come once only. A batch with the ``name`` of one that was taken in replaces it.
        """
        name = name or uuid.uuid4().hex
        batch = self.names.get(name, self.batch + 1)
        if batch <= self.names.get("compacted", 0):
            raise ValueError(f"batch {name} has been compacted")
        src = rows.select(F.col("id").cast("long").alias("id"), "file_name", clean_dir(F.col("source_dir")).alias("dir"), F.nullif(F.lower(F.trim("file_hash")), F.lit("")).alias("h"))
        named = self._temp(_named(src), "names")
        if not self.buckets:
            self.buckets = self.wanted or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-named.count() // BUCKET_ROWS))
            self._tables()
        self._learn(named, batch)
        if self.cover:
            self._put("parts", _parts(named).select("p").distinct().join(self._before("parts", batch), "p", "left_anti"), batch)
        content = src.where("h IS NOT NULL").select(*_keys(F.lit("c"), F.col("h")), "id", F.lit(None).cast("string").alias("own"), F.lit(None).cast("long").alias("c"))
        whole = named.select(*_keys(F.lit("n"), F.concat("head", F.lit("\n"), F.array_join("words", " "))))
        made = content.unionByName(self._name_keys(named, batch))
        n = src.count()
        hot = _cut(content.select("k", "k2").unionByName(whole), 2 * n) if n > HOT else None  # else no key can have so many rows
        if hot is None or hot.isEmpty():
            self._none("hot", batch)
        else:
            self._put("hot", hot, batch)
        self._put("keys", self._salted(made, self._of("hot", batch)), batch)
        pairs = materialise(self._pairs(batch), "pairs")
        self._commit(name, batch)
        self._tidy()
        return pairs

    def _salted(self, keys: DataFrame, hot: DataFrame) -> DataFrame:
        """With the part of its key that a row belongs to; few keys have parts (``_cut``)."""
        return keys.join(F.broadcast(hot.select("k", "k2", "parts")), ["k", "k2"], "left").withColumn("s", F.pmod(F.xxhash64(F.lit(7), "id"), F.coalesce("parts", F.lit(1))).cast("int"))

    def _pairs(self, batch: int) -> DataFrame:
        """Pairs of the batch; only rows of keys that another row has are moved."""
        new, key = self._of("keys", batch), ["k", "k2", "s"]
        cut = self.spark.table(self.table("hot")).where(F.col("batch") <= batch).groupBy("k", "k2").agg(F.max("parts").alias("parts"))
        every = cut.select("k", "k2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"))
        sizes = new.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        asked = sizes.select(*key)
        if some := not cut.isEmpty():  # a key that was cut in one batch may be whole, or in other parts, in another
            every = self._temp(every.join(new.select("k", "k2").distinct(), ["k", "k2"], "left_semi"), "cut")
            asked = asked.unionByName(every).distinct()
        before = self._before("keys", batch)
        touched = self._temp(before.join(asked.hint("shuffle_hash"), key, "left_semi"), "touched") if batch > min(self.names.values(), default=batch) else before.limit(0)
        shared = sizes.where("n > 1").select(*key).unionByName(touched.select("k", "k2", F.lit(0).alias("s")))
        if some:
            shared = shared.unionByName(every)
        columns = ["k", "k2", "id", F.struct("own", "c").alias("keep"), (F.col("batch") == batch).alias("fresh")]
        mine = new.join(shared.distinct().hint("shuffle_hash"), key, "left_semi")
        together = self._temp(touched.select(*columns).unionByName(mine.select(*columns)), "together")
        met = pairs_within(together, ["k", "k2"], "id", fresh="fresh", keep="keep")
        of_content = F.col("keep_1.own").isNull()
        # equal contents are paired by content alone, and equal names by their own key alone
        other = F.coalesce(F.col("keep_1.c") != F.col("keep_2.c"), F.lit(True))
        same = (F.col("keep_1.own") == "") & (F.col("keep_2.own") == "")
        near = met.where(~of_content & other & (F.col("keep_1.own") != F.col("keep_2.own"))).select("id_a", "id_b", F.col("keep_1.own").alias("own_1"), F.col("keep_2.own").alias("own_2"))
        near = near.mapInArrow(_agreeing, "id_a long, id_b long").distinct()
        return met.where(of_content | (other & same)).select("id_a", "id_b").unionByName(near)

    def coverage(self, rows: DataFrame) -> DataFrame:
        """``(id, full_copy, parts, covered)`` of rows that may come: whether the history has their content, how many parts
        their names have, and how many of these it has in their directory. Rows without a name have none."""
        src = rows.select(F.col("id").cast("long").alias("id"), "file_name", clean_dir(F.col("source_dir")).alias("dir"), F.nullif(F.lower(F.trim("file_hash")), F.lit("")).alias("h"))
        if not self.cover:
            raise ValueError("this history keeps no parts")
        if not self.batch:
            known = _parts(_named(src)).groupBy("id").agg(F.count("p").alias("parts")).withColumn("covered", F.lit(0).cast("long"))
            copies = src.select("id").limit(0)
        else:
            have = self._before("parts", self.batch + 1).select("p").distinct().withColumn("known", F.lit(1))
            known = _parts(_named(src)).join(have, "p", "left").groupBy("id").agg(F.count("p").alias("parts"), F.count("known").alias("covered"))
            keyed = src.where("h IS NOT NULL").select(*_keys(F.lit("c"), F.col("h")), "id")
            copies = keyed.join(self._before("keys", self.batch + 1).select("k", "k2").hint("merge"), ["k", "k2"], "left_semi").select("id").distinct()
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        out = src.select("id").join(known, "id", "left").join(copies.withColumn("copy", F.lit(True)), "id", "left")
        return out.select("id", F.coalesce("copy", F.lit(False)).alias("full_copy"), zero("parts"), zero("covered"))

    def compact(self, buckets: int | None = None) -> None:
        """Rewrites the history as one partition of each table, with ``buckets`` buckets; hot keys are cut anew."""
        if not self.batch:
            return
        batch, old = self.batch, {t: self._before(t, self.batch + 1).drop("batch") for t in TABLES}
        olden, gone = [self.table(t) for t in TABLES], f"{self.path}/g{self.generation}"
        self.generation, self.buckets = self.generation + 1, buckets or self.buckets
        self.names["compacted"] = batch
        self._tables()
        for t, df in old.items():
            if t == "hot":
                self._put(t, _cut(old["keys"].select("k", "k2"), old["keys"].count()), batch)
            elif t != "keys":
                self._put(t, df, batch)
        self._put("keys", self._salted(old["keys"].drop("s"), self._of("hot", batch)), batch)
        self._commit("compacted", batch)
        for t in olden:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        drop_path(self.spark, gone)

    # words

    def _learn(self, named: DataFrame, batch: int) -> None:
        """Add the batch's new words, and which known words they are near to."""
        counts = named.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        known = self._before("words", batch).where("cut = word").select(F.col("cut").alias("word"))  # each word is its own longest cut
        self._put("words", counts.join(known, "word", "left_anti").mapInPandas(_with_cuts, "cut string, word string, n long"), batch)
        new = self._of("words", batch)
        a, b, c = new.alias("a"), new.alias("b"), self._before("words", batch).alias("b")
        first = (F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.word") < F.col("a.word")))
        two = [F.col("a.word").alias("word"), F.col("b.word").alias("known")]
        near = a.join(b, (F.col("a.cut") == F.col("b.cut")) & first).select(*two, F.lit(False).alias("old"))
        near = near.unionByName(a.join(c, F.col("a.cut") == F.col("b.cut")).select(*two, F.lit(True).alias("old"))).distinct()
        near = self._temp(near.mapInPandas(_near_enough, "word string, known string, old boolean"), "near")
        if near.isEmpty():
            return self._none("near", batch)
        # a word without near ones known before it is a root; the roots of what was known before are stored
        of_old = self._before("near", batch).where("root").groupBy("word").agg(F.collect_set("known").alias("of_old"))
        near = near.join(of_old.withColumnRenamed("word", "known"), "known", "left").join(near.select(F.col("word").alias("known"), F.lit(True).alias("hangs")).distinct(), "known", "left")
        near = near.withColumn("root", F.when(F.col("old"), F.col("of_old").isNull()).otherwise(F.col("hangs").isNull()))
        roots = near.where("root").groupBy("word").agg(F.collect_set("known").alias("roots"))
        both = near.join(roots, "word", "left").join(roots.select(F.col("word").alias("known"), F.col("roots").alias("of_new")), "known", "left")
        others = F.when(F.col("old"), F.col("of_old")).otherwise(F.col("of_new"))
        # a near word is left out where both words have the key of one root
        self._put("near", both.where(~F.coalesce(F.arrays_overlap("roots", others), F.lit(False))), batch)

    def _name_keys(self, named: DataFrame, batch: int) -> DataFrame:
        mine = named.select(F.explode("words").alias("word")).distinct()
        near = self._before("near", batch + 1).join(mine, "word", "left_semi").select("word", "known")
        sent = near.limit(MOST_SENT + 1).collect()
        kinds = "id long, key string, own string, c long"
        if len(sent) <= MOST_SENT:
            ways: dict[str, list[str]] = {}
            for r in sent:
                ways.setdefault(r["word"], []).append(r["known"])
            keyed = named.mapInArrow(_spelled(ways), kinds)
        else:  # the words of a name are few: join their near words and gather them again
            by = near.groupBy("word").agg(F.collect_list("known").alias("known"))
            some = named.select("id", "head", F.posexplode("words").alias("pos", "word")).join(by, "word")
            some = some.groupBy("id", "head").agg(F.collect_list(F.struct("pos", "known")).alias("ways"))
            keyed = named.join(some, ["id", "head"], "left").mapInArrow(_spelled(None), kinds)
        return keyed.select(*_keys(F.lit("n"), F.col("key")), "id", "own", "c")


def _cut(keys: DataFrame, rows: int) -> DataFrame:
    """Keys with so many rows that they are cut, and into how many parts: at most ``MOST_HOT`` keys of about ``rows``.

    Groups of keys are counted first: only those of groups with as many rows as a hot key has are counted one by one.
    """
    size = max(HOT, rows // MOST_HOT)
    groups = max(1024, min(1 << 20, 16 * rows // size))
    coarse = F.pmod("k", F.lit(groups)).alias("g")
    full = [r["g"] for r in keys.groupBy(coarse).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select("g").collect()]  # at most MOST_HOT
    held = keys.sparkSession.createDataFrame([(g,) for g in full], "g long")
    some = keys.join(F.broadcast(held), F.pmod("k", F.lit(groups)) == F.col("g"), "left_semi") if full else keys.limit(0)
    sizes = some.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    return sizes.select("k", "k2", F.ceil(F.col("n") / size).cast("int").alias("parts"))


def _parts(named: DataFrame) -> DataFrame:
    """``(id, p)``: the hashes of the words and numbers of each name, each once, with its directory."""
    head = F.split("head", "\n", 2)
    numbers = F.filter(F.split(head[1], " "), lambda x: (x != "w") & (x != ""))
    return named.select("id", head[0].alias("dir"), F.explode(F.array_distinct(F.concat("words", numbers))).alias("x")).select("id", F.xxhash64("dir", "x").alias("p"))


def _named(src: DataFrame) -> DataFrame:
    """Directory and numbers, the words, and the content's hash, of rows that have a directory and a name."""
    src = src.where(F.col("dir").isNotNull() & (F.length("file_name") > 0)).select("id", "file_name", "dir", F.when(F.col("h").isNotNull(), F.xxhash64("h")).alias("c"))

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, words = [], []
            for name, where in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                head, ws = name_parts(name)
                heads.append(f"{unicodedata.normalize('NFC', where)}\n{head}")
                words.append(ws)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heads, pa.string()), pa.array(words, pa.list_(pa.string())), b.column(3)], ["id", "head", "words", "c"])

    return src.mapInArrow(parse, "id long, head string, words array<string>, c long")


def _with_cuts(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(c, w, n) for w, n in zip(f["word"], f["n"]) for c in sorted(shortened(w))]
        yield pd.DataFrame(rows, columns=["cut", "word", "n"]).astype({"cut": str, "word": str, "n": "int64"})


def _near_enough(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        most = [slips_allowed(a, b) for a, b in zip(f["word"], f["known"])]
        yield f[np.array([slips(a, b, m) <= m for a, b, m in zip(f["word"], f["known"], most)], bool)]


def _agreeing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs without those of which both names had another word in a place of the key, and these aren't near."""
    words = lambda own: dict(x.split("\t", 1) for x in own.split("\n") if x)
    for b in batches:
        keep = np.ones(b.num_rows, bool)
        for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            if x and y:
                one, two = words(x), words(y)
                both = [(one[p], two[p]) for p in one.keys() & two.keys()]
                keep[i] = all(slips(v, w, slips_allowed(v, w)) <= slips_allowed(v, w) for v, w in both)
        yield b.select([0, 1]).filter(pa.array(keep))


def _spelled(ways: dict[str, list[str]] | None):
    """One key for a name, and one for each way of putting near words in place of any of its own."""

    def keys_of(b: pa.RecordBatch) -> Iterator[tuple[int, str, str, int | None]]:
        joined = b.column(4).to_pylist() if ways is None else None
        for row, (i, head, words, content) in enumerate(zip(*(c.to_pylist() for c in b.columns[:4]))):
            choices = [[w] for w in words]
            if ways is None:
                for x in joined[row] or []:
                    choices[x["pos"]] += x["known"]
            else:
                for c in choices:
                    c += ways.get(c[0], ())
            for chosen in itertools.product(*choices):
                own = [f"{p}\t{w}" for p, (w, c) in enumerate(zip(words, chosen)) if w != c]
                yield i, head + "\n" + " ".join(chosen), "\n".join(own), content

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.select(["id", "head", "words", "c", *(["ways"] if ways is None else [])])
            for part in itertools.batched(keys_of(b), MOST_AT_ONCE):
                ids, keys, owns, contents = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(owns, pa.string()), pa.array(contents, pa.int64())], ["id", "key", "own", "c"])

    return run


#: Days that come one by one, each against all before it; what is older is taken in at once.
DAILY = 1


def _by_day(rows: DataFrame, day: str | None, daily: int) -> list[tuple[str, DataFrame]]:
    """The backlog, and the latest days, in order."""
    if day is None:
        return [("backlog", rows)]
    on = F.to_date(day)
    days = [r[0] for r in rows.where(on.isNotNull()).groupBy(on.alias("day")).count().orderBy(F.desc("day")).limit(daily).collect()]
    if not days:
        return [("backlog", rows)]
    days = sorted(days)
    return [("backlog", rows.where(F.coalesce(on < F.lit(days[0]), F.lit(True)))), *((str(d), rows.where(on == F.lit(d))) for d in days)]


def same_recordings(rows: DataFrame, day: str | None = None, buckets: int | None = None, daily: int = DAILY) -> DataFrame:
    """Pairs ``(id_a, id_b)`` of all rows that are the same recording.

    With ``day``, a column of days or timestamps: the last ``daily`` days come one by one as batches, each against the
    history of all before it; what is older is taken in at once, and so are rows without day. The history is deleted.
    """
    history = History(rows.sparkSession, buckets=buckets, cover=False)
    pairs = [history.ingest(part, name) for name, part in _by_day(rows, day, daily)]
    history.drop()
    return reduce(DataFrame.unionByName, pairs)


def covered_by_history(rows: DataFrame, day: str, buckets: int | None = None) -> DataFrame:
    """``coverage`` of the rows of the latest day by all before it."""
    *before, (_, last) = _by_day(rows, day, 1)
    history = History(rows.sparkSession, buckets=buckets)
    for name, part in before:
        history.ingest(part, name)
    out = materialise(history.coverage(last), "coverage")
    history.drop()
    return out
