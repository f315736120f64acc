"""Evaluation texts leaking into training text (size-partitioned MinHash containment).

A test item is short and a document long, so the Jaccard similarity of their shingle
sets says little; asked is containment. As in size-partitioned MinHash search, domains
are brought to partitions of one size, in which a containment of t turns into a Jaccard
similarity of t / (1 + |X| / |Q| - t). A leak may be as short as ``min_words`` words, so the
domains of an item are all its windows of that many words, those of a document likewise, and
a domain is the set of the five-word shingles of its window. A leaked window is contained
in full, t = 1, and between sets of one size that is Jaccard 1: there the MinHash of one
permutation agrees with certainty, and a longer signature would find nothing more. The
partitions are the sizes of the sets (repeated words make them smaller); a domain is
looked up by (size, MinHash, place of the shingle that gave it), whatever the length of its
text; the place keeps windows apart that overlap and so have one MinHash. What is found is verified by
exact containment of the shingles, and then by their order, word for word. Greek nu may
stand for v or n (see ``forms.NU``): the three have one hash, and the words tell v from n.

Items with equal text are searched for once. Their windows are a table of their own, made
by the executors and joined with the documents' by the same three. Before that, documents
are cut to windows whose MinHash some item has by a bitmap of ``FILTER_BITS`` bits (of fixed
size, whatever the number of items): so documents are read once, never moved, and only
windows that are leaks, but for a few, are shuffled.

Defined results: null and empty texts, and those with fewer than ``min_words`` words, hold
and leak nothing; rows without id are ignored; items with equal text all count; repeated
rows count once; texts are searched whole, items like documents with their notes, comments
and markup read as ``wikitext`` says; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.forms import NU
from tidelog.llm.wikitext import line_streams
from tidelog.operators.joins import lookup_join, spread
from tidelog.storage.workspace import materialise

MIN_WORDS = 10
SHINGLE = 5
#: Bits of the filter of MinHashes that items have: 2 MB, shared with all executors.
FILTER_BITS = 1 << 24
#: Distinct words whose hashes a worker keeps.
KEPT_WORDS = 200_000

_ODD = [np.uint64(int.from_bytes(hashlib.blake2b(b"position %d" % i, digest_size=8).digest(), "big") | 1) for i in range(64)]
_MIX = np.uint64(0x9E3779B97F4A7C15)


_NU_TO_N = str.maketrans(NU + "v", "nn")


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.translate(_NU_TO_N).encode(), digest_size=8).digest(), "big")


def same_words(a: list[str], b: list[str]) -> bool:
    """Equal words, where nu equals v and n."""
    if a == b:
        return True
    x, y = " ".join(a), " ".join(b)
    return len(x) == len(y) and (NU in x or NU in y) and all(c == d or NU in (c, d) and {c, d} <= {NU, "v", "n"} for c, d in zip(x, y))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += hashes[i : i + n] * _ODD[i]
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


def window_minima(s: np.ndarray, width: int) -> np.ndarray:
    """The MinHash of every window of ``width`` shingles."""
    n = len(s) - width + 1
    out = s[:n].copy()
    for i in range(1, width):
        np.minimum(out, s[i : i + n], out=out)
    return out


def windows(hashes: np.ndarray, min_words: int, shingle: int, asked: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(size, MinHash, its place, start) of every window of ``min_words`` words, given as hashes; with ``asked``, a bitmap
    of MinHashes, only of those that it may have."""
    if len(hashes) < min_words:
        return
    width = min_words - shingle + 1
    s = shingles(hashes, shingle)
    m = window_minima(s, width)
    if asked is None:
        starts = range(len(m))
    else:
        bit = m & np.uint64(8 * len(asked) - 1)
        starts = np.flatnonzero((asked[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).tolist()
    for i in starts:
        held = s[i : i + width].tolist()
        yield len(set(held)), int(m[i].astype(np.int64)), held.index(int(m[i])), i


def contained(theirs: list[str], mine: list[str], shingle: int) -> bool:
    """Whether all shingles of one window are shingles of the other, nu taken for v or n."""
    runs = lambda w: {tuple(x.translate(_NU_TO_N) for x in w[i : i + shingle]) for i in range(len(w) - shingle + 1)}
    return runs(theirs) <= runs(mine)


_WINDOW = "id bigint, size int, minhash bigint, place int, words string"


def _cut(min_words: int, shingle: int, asked=None):
    """The windows of (id, text) rows, each distinct one of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if asked is None else np.frombuffer(asked.value, np.uint8)
        known: dict[str, int] = {}
        lowered: dict[str, str] = {}
        finished: dict[str, list] = {}
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: set[tuple] = set()
                for lines in line_streams(text, lowered, finished):
                    for line in lines:
                        if line[1] is None:
                            if len(known) > KEPT_WORDS:
                                known.clear()
                            line[1] = np.array([known.get(w) or known.setdefault(w, word_hash(w)) for w in line[0]], np.uint64)
                    if sum(len(words) for words, _ in lines) < min_words:
                        continue
                    words = None
                    for size, m, place, at in windows(np.concatenate([h for _, h in lines]), min_words, shingle, bits):
                        words = words or [w for held, _ in lines for w in held]
                        found.add((i, size, m, place, " ".join(words[at : at + min_words])))
                out += found
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "size", "minhash", "place", "words"])

    return run


def _filter(items: DataFrame) -> bytes:
    """The bitmap of the items' MinHashes: of fixed size, put together by pages."""
    bit = F.col("minhash").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1  # pages count from 1
    pages = items.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in pages.collect():  # at most FILTER_BITS / 32768 rows of 4 KB
        page = np.frombuffer(bytes(r.bits), np.uint8)
        at = 4096 * (r.page - 1)
        out[at : at + 4096] |= page[: len(out) - at]
    return out.tobytes()


def _verified(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = (batch.column(i).to_pylist() for i in (2, 3))
            good = [a == b or (contained(b.split(" "), a.split(" "), shingle) and same_words(b.split(" "), a.split(" "))) for a, b in zip(mine, theirs)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def leaks(
    docs: DataFrame,
    items: DataFrame,
    min_words: int = MIN_WORDS,
    shingle: int = SHINGLE,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id): documents that hold ``min_words`` consecutive words of an item."""
    spark = docs.sparkSession
    named = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    texts = named.groupBy("text").agg(F.min("item_id").alias("rep"))
    members = named.join(texts, "text").select("rep", "item_id").distinct()
    asked = materialise(texts.select("rep", "text").mapInArrow(_cut(min_words, shingle), _WINDOW).withColumnRenamed("id", "rep"), "items")
    bits = spark.sparkContext.broadcast(_filter(asked))
    rows = spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null"))
    held = rows.mapInArrow(_cut(min_words, shingle, bits), _WINDOW).withColumnRenamed("id", "doc_id")
    met = lookup_join(held, asked.withColumnRenamed("words", "theirs"), ["size", "minhash", "place"], "inner", spread="doc_id", name="windows")
    found = met.select("doc_id", "rep", "words", "theirs").mapInArrow(_verified(shingle), "doc_id bigint, rep bigint").distinct()
    return lookup_join(found, members, ["rep"], "inner", spread="doc_id", name="members").select("doc_id", "item_id").distinct()
