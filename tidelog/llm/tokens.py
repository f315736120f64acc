"""Encoding of the whole corpus with a public tokenizer (corpus-level merge replay).

The vocabulary is a byte-level BPE in the ``tokenizers`` JSON format. Instead of merging
each text by itself, the merges are replayed over the corpus:

1. One pass splits the texts into words (the pre-tokens of byte-level BPE) and writes, per
   block of texts, its distinct words and every text as a list of word numbers.
2. Each distinct word of the corpus goes to one task. It lays its words one after another
   as byte symbols, with an inverted index from symbol pair to the positions where the pair
   stands. Merges are applied in rank order: the positions of the pair are read from the
   index, and only the neighbours of each merged place enter the index anew.
3. The ids of the words go back to the blocks that have the word, and each block turns its
   word numbers into ids.

A word is replayed once however often it occurs; texts are moved once, as word numbers.
Blocks hold about ``BLOCK_CHARS`` characters, so neither a long text list nor a frequent
word makes a task grow (a single text is never cut).

Defined results: a null or empty text gives an empty list; strings that look like special
tokens are ordinary text; no special tokens are added; a row without id keeps its row with
a null id; repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.joins import spread
from tidelog.storage.workspace import new_folder

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
#: Characters of a block of texts, about.
BLOCK_CHARS = 6_000_000
#: Words whose merges are replayed together.
REPLAY_WORDS = 200_000

# White space as the tokenizer's pattern knows it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def word_pattern() -> re.Pattern:
    """The split of byte-level BPE: contractions, and runs of letters, of numbers or of
    other signs with one blank before them, and runs of white space."""
    ranges, start, last = [], None, None
    for o in range(0x110000):
        if unicodedata.category(chr(o))[0] == "N":
            if start is None:
                start = o
            last = o
        elif start is not None:
            ranges.append((start, last))
            start = None
    numbers = "".join(f"{chr(a)}-{chr(b)}" if b > a else chr(a) for a, b in ranges)
    letters = f"[^\\W_{numbers}]"
    signs = f"(?:[^\\w{SPACE}]|_)"
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?{letters}+| ?[{numbers}]+| ?{signs}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


_ENDS_BLANK = re.compile(f"[{SPACE}]\\Z")


def chunks(text: str) -> list[str]:
    """The text cut before line ends that follow something visible; no word of the
    pattern goes over such a place, so chunks can be split by themselves."""
    out, current = [], None
    for line in text.split("\n"):
        if current is None:
            current = line
        elif current and not _ENDS_BLANK.search(current):
            out.append(current)
            current = "\n" + line
        else:
            current += "\n" + line
    out.append(current)
    return out


def load_merges(path: str) -> tuple[list[int], dict[tuple[int, int], int]]:
    """(ids of the 256 bytes, pair -> merged id). Merged ids grow with the merge's rank."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary = model["vocab"]
    #: Bytes that print stand for themselves, others for code points from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    byte_ids = [vocabulary[chr(rest.get(b, b))] for b in range(256)]
    merges, last = {}, -1
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merged = vocabulary[a + b]
        if merged < last:
            raise ValueError("the ids of merges must grow with their rank")
        last = merged
        merges.setdefault((vocabulary[a], vocabulary[b]), merged)
    return byte_ids, merges


def replay(words: list[str], byte_ids: list[int], merges: dict[tuple[int, int], int]) -> list[list[int]]:
    """The ids of every word, by replaying the merges over all of them in rank order."""
    symbols: list[int] = []
    starts = []
    for w in words:
        starts.append(len(symbols))
        symbols += [byte_ids[b] for b in w.encode("utf-8")]
        symbols.append(-1)  # no pair goes over the end of a word
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    index: dict[int, list[int]] = {}
    pair_of: dict[int, tuple[int, int]] = {}
    get = merges.get
    left = -1
    for i, right in enumerate(symbols):
        m = get((left, right))
        if m is not None:
            at = index.get(m)
            if at is None:
                index[m] = [i - 1]
                pair_of[m] = (left, right)
            else:
                at.append(i - 1)
        left = right
    queue = list(index)
    heapq.heapify(queue)
    while queue:
        m = heapq.heappop(queue)
        a, b = pair_of[m]
        positions = index.pop(m)
        positions.sort()
        for i in positions:
            if symbols[i] != a:
                continue
            j = after[i]
            if j >= n or symbols[j] != b:
                continue
            k = after[j]
            symbols[i], symbols[j] = m, -2
            after[i] = k
            if k < n:
                before[k] = i
                right = symbols[k]
                if right >= 0:
                    x = get((m, right))
                    if x is not None:
                        at = index.get(x)
                        if at is None:
                            index[x] = [i]
                            pair_of[x] = (m, right)
                            heapq.heappush(queue, x)
                        else:
                            at.append(i)
            h = before[i]
            if h >= 0 and symbols[h] >= 0:
                x = get((symbols[h], m))
                if x is not None:
                    at = index.get(x)
                    if at is None:
                        index[x] = [h]
                        pair_of[x] = (symbols[h], m)
                        heapq.heappush(queue, x)
                    else:
                        at.append(h)
    out = []
    ends = [*starts[1:], n]
    for s, e in zip(starts, ends):
        out.append([x for x in symbols[s : e - 1] if x >= 0])
    return out


_SPLIT = "kind int, block bigint, doc_id bigint, numbers binary, no int, word string"
_SPLIT_ARROW = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("numbers", pa.binary()), ("no", pa.int32()), ("word", pa.string())]
)


def _pack(numbers: np.ndarray) -> bytes:
    """Word numbers in two bytes each where they fit, else four; the first byte tells."""
    if not len(numbers) or int(numbers.max()) < 1 << 16:
        return b"\x02" + numbers.astype(np.uint16).tobytes()
    return b"\x04" + numbers.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if len(raw) < 2:
        return np.zeros(0, np.int64)
    return np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.int32, offset=1).astype(np.int64)


def _split(batches: Iterator[pa.RecordBatch], pattern: re.Pattern) -> Iterator[pa.RecordBatch]:
    findall = pattern.findall
    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 24
    numbers: dict[str, int] = {}
    seen: dict[str, np.ndarray] = {}
    held = 0
    none = np.zeros(0, np.int32)

    def dictionary() -> pa.RecordBatch:
        n = len(numbers)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, np.int32)), pa.array(np.full(n, block)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
             pa.array(np.arange(n, dtype=np.int32)), pa.array(list(numbers), pa.string())], schema=_SPLIT_ARROW)

    for batch in batches:
        ids, texts, i = batch.column(0), batch.column(1).to_pylist(), 0
        while i < len(texts):
            first, rows = i, []
            while i < len(texts) and held < BLOCK_CHARS:
                text = texts[i]
                i += 1
                if not text:
                    rows.append(b"")
                    continue
                parts = []
                for chunk in chunks(text):
                    known = seen.get(chunk)
                    if known is None:
                        words = findall(chunk)
                        known = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))
                        seen[chunk] = known
                    parts.append(known)
                rows.append(_pack(np.concatenate(parts) if parts else none))
                held += len(text)
            n = i - first
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, block)), ids.slice(first, n), pa.array(rows, pa.binary()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], schema=_SPLIT_ARROW)
            if held >= BLOCK_CHARS:
                if numbers:
                    yield dictionary()
                numbers.clear()
                seen.clear()
                held, block = 0, block + 1
    if numbers:
        yield dictionary()


def _give(docs: pa.Table, words: pa.Table) -> pa.Table:
    """One block: word numbers to ids."""
    order = np.argsort(words.column("no").to_numpy())
    lists = words.column("ids").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy().astype(np.int32, copy=False)
    starts, sizes = offsets[:-1][order].astype(np.int64), np.diff(offsets)[order].astype(np.int64)
    out, ends, at = [], [0], 0
    for raw in docs.column("numbers").to_pylist():
        w = _unpack(raw)
        if len(w):
            size = sizes[w]
            total = np.cumsum(size)
            at += int(total[-1])
            out.append(flat[np.repeat(starts[w] - (total - size), size) + np.arange(total[-1])])
        ends.append(at)
    values = np.concatenate(out) if out else np.zeros(0, np.int32)
    made = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(values))
    return pa.table({"doc_id": docs.column("doc_id"), "ids": made})


def encode(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    pattern = word_pattern()
    (
        spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
        .mapInArrow(lambda batches: _split(batches, pattern), _SPLIT).write.partitionBy("kind").parquet(path)
    )
    read = lambda kind: spark.read.schema(_SPLIT).option("basePath", path).parquet(path).where(F.col("kind") == kind)
    texts = read(0).select("block", "doc_id", "numbers")
    words = read(1).select("block", "no", "word")

    # 50k merges: of fixed size, whatever the corpus
    shared = spark.sparkContext.broadcast(load_merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def flush() -> pa.RecordBatch:
            ids = replay(held, *shared.value)
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            if len(held) >= REPLAY_WORDS:
                yield flush()
                held = []
        if held:
            yield flush()

    replayed = words.select("word").distinct().mapInArrow(run, "word string, ids array<int>")
    given = words.join(replayed, "word").select("block", "no", "ids")
    return (
        texts.groupBy("block").cogroup(given.groupBy("block"))
        .applyInArrow(_give, "doc_id bigint, ids array<int>").withColumnRenamed("doc_id", id_col)
    )
