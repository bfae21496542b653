"""A whole corpus as ids of a public byte-pair tokenizer (problem 6).

Method: the tiktoken library with a local rank file. Long texts are first cut where no token can cross: before a blank
between two signs, and between a letter or digit and a sign of another kind; a part goes on to the next such place, so
only a text that has none is encoded in one call. The rank file goes to the executors with the session's files.
Decoding joins the raw bytes of the ids, and makes text of them only when all are together, so signs that span several
ids come back whole.

Defined results: an empty text and a null text both give an empty list; special tokens are never made, their spelling
in a text is ordinary text; texts of any length are encoded whole; unpaired surrogates cannot occur in Spark's strings.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from koewake.session import ship, spread

#: Where the vocabulary files of the public tokenizers lie; a parameter of every function here.
RANKS = os.environ.get("KOEWAKE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published pattern by which this tokenizer splits texts before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Code points of a text from which it is cut, and about how long its parts are.
LONG = 20_000

# a blank between two signs that aren't blank; a letter or digit before another sign, but not before an apostrophe
_SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}'])")


_SENT: set[tuple[str, str]] = set()


@lru_cache(4)
def encoding(ranks: str = RANKS) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(ranks), pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def sent(spark: SparkSession, ranks: str) -> None:
    """Sends the rank file of the driver to the executors, once for each session."""
    key = (spark.sparkContext.applicationId, ranks)
    if key not in _SENT and os.path.exists(ranks):
        spark.sparkContext.addFile(ranks)
        _SENT.add(key)


def here(ranks: str) -> str:
    """Where a worker finds the rank file: among the session's files, or under its own path."""
    came = SparkFiles.get(os.path.basename(ranks))
    return came if os.path.exists(came) else ranks


def parts(text: str, size: int = LONG) -> Iterator[str]:
    """The text in parts of about ``size`` code points that encode on their own as they do together."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(text: str | None, ranks: str = RANKS, size: int = LONG) -> list[int]:
    enc = encoding(ranks)
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for p in parts(text, size) for i in enc.encode_ordinary(p)]


def decode_ids(ids: list[int] | None, ranks: str = RANKS) -> str:
    enc = encoding(ranks)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids or ()).decode("utf-8", "replace")


def encode(df: DataFrame, id_col: str, text: str, ranks: str = RANKS) -> DataFrame:
    """``(id_col, ids)``: one row for every row of ``df``, in no order; a map without shuffle."""
    ship(df.sparkSession)
    sent(df.sparkSession, ranks)
    src = spread(df.select(id_col, F.col(text).alias("text")))
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(here(ranks))
        for b in batches:
            texts = b.column(1).to_pylist()
            short = [t if t and len(t) <= LONG else "" for t in texts]
            ids = [enc.encode_ordinary(t) if t else [] for t in short]
            for i, t in enumerate(texts):
                if t and len(t) > LONG:
                    ids[i] = encode_text(t, here(ranks))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, id_col: str, ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``(id_col, text)`` from lists of ids; null and empty lists give the empty text."""
    ship(df.sparkSession)
    sent(df.sparkSession, ranks)
    src = df.select(id_col, F.col(ids).alias("ids"))
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(x, here(ranks)) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, text string")
