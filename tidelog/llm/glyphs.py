"""Visually identical text with different characters (script-aware repair).

Each text is first cleaned of what can't be seen (see ``forms.clean``). Then look-alike
letters are repaired token by token. The dominant script of a token is that of most of
its letters that have no look-alike; a token made of look-alikes only takes the dominant
script of its text. A token that holds letters of another script than its dominant one is
mixed: its proposal has every look-alike letter replaced by the form of the dominant
script. A proposal is accepted if it exists in the corpus vocabulary, that is, if some
text has it as a token, or if it is reached from two or more different spellings; else
the token stays as it is. The dominant script and the proposal follow from letters that
no substitution changes, so texts that look the same get the same proposals, and where
they differ in a token, either one of them attests the proposal or two spellings do:
they always end in the same form.

One pass over the texts writes, to the shared folder, a row per document (hashes of the
text and of the form with all proposals taken, and the mixed tokens) and the distinct
tokens of each block of texts. Vocabulary and proposals meet as 64-bit hashes in an
equi-join; rejected tokens come back to their documents as a sum of position hashes, so
no text is moved again.

Defined results: a null text has a null form and no partner; an empty text, or one
without anything visible, has no partner; rows without id are left out of pairs; repeated
rows count once; very long texts are treated whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.forms import CLASSES, SCRIPTS, clean, plain, script
from tidelog.operators.joins import lookup_join, spread
from tidelog.storage.workspace import materialise, new_folder

TOKEN = re.compile("(?:[^\\W\\d_][\u0300-\u036f]*)+")
#: Tokens kept by a task before they are handed on.
BLOCK_TOKENS = 200_000

_OUT = "kind int, doc_id bigint, text_hash binary, form_hash binary, visible boolean, mixed array<struct<at:int,s:string,p:string>>, token string"
_ARROW = pa.schema([
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.binary()), ("form_hash", pa.binary()), ("visible", pa.bool_()),
    ("mixed", pa.list_(pa.struct([("at", pa.int32()), ("s", pa.string()), ("p", pa.string())]))), ("token", pa.string()),
])


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _votes(letters: Counter) -> str | None:
    """The script of most letters without a look-alike; None if there are none."""
    votes = Counter()
    for c, n in letters.items():
        if c not in CLASSES:
            s = script(c)
            if s in SCRIPTS:
                votes[s] += n
    return max(SCRIPTS, key=lambda s: votes[s]) if votes else None


def propose(token: str, context: str) -> str:
    """The token with its look-alike letters in its dominant script."""
    bare = unicodedata.normalize("NFD", token)
    own = _votes(Counter(bare)) or context
    out = []
    for c in bare:
        members = CLASSES.get(c)
        if members and script(c) != own:
            c = members[own] if own in members else next(members[s] for s in SCRIPTS if s in members)
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def repair(
    text: str, rejected: frozenset[tuple[str, str]] = frozenset(), cache: dict | None = None
) -> tuple[str, list[tuple[int, str, str]]]:
    """The clean text with every proposal taken, but the ``rejected`` (spelling, proposal);
    and its mixed tokens as (position in the result, spelling, proposal)."""
    base = clean(text)
    if plain(base):
        return base, []
    cache = {} if cache is None else cache
    context = _votes(Counter(unicodedata.normalize("NFD", base))) or SCRIPTS[0]
    parts, mixed, end, at = [], [], 0, 0
    for m in TOKEN.finditer(base):
        token = m[0]
        known = (token, context)
        p = cache.get(known)
        if p is None:
            if len(cache) > BLOCK_TOKENS:
                cache.clear()
            p = cache[known] = token if context == "LATIN" and plain(token) else propose(token, context)
        if p != token:
            gap = base[end : m.start()]
            at += len(gap)
            mixed.append((at, token, p))
            took = token if (token, p) in rejected else p
            parts += [gap, took]
            at += len(took)
            end = m.end()
    parts.append(base[end:])
    return "".join(parts), mixed


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict = {}
    tokens: set[str] = set()

    def vocabulary() -> pa.RecordBatch:
        words = list(tokens)
        tokens.clear()
        n = len(words)
        empty = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays(
            [pa.array([1] * n, pa.int32()), *[empty(f.type) for f in list(_ARROW)[1:-1]], pa.array(words, pa.string())], schema=_ARROW
        )

    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is None:
                continue
            form, mixed = repair(text, cache=cache)
            if mixed:
                spelled = {s for _, s, _ in mixed}
                tokens.update(t for t in TOKEN.findall(clean(text)) if t not in spelled)
            else:
                tokens.update(TOKEN.findall(form))
            if len(tokens) > BLOCK_TOKENS:
                yield vocabulary()
            rows.append((0, doc_id, _digest(text), _digest(form), not (not form or form.isspace()), [{"at": a, "s": s, "p": p} for a, s, p in mixed], None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
    if tokens:
        yield vocabulary()


class Analysis:
    """One pass over (id, text) rows, written to the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        path = new_folder(spark, "glyphs")
        found = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(_analyse, _OUT)
        hashed = F.transform(
            "mixed",
            lambda x: F.struct(
                x["at"].alias("at"), F.xxhash64(x["s"]).alias("s"), F.xxhash64(x["p"]).alias("p"), x["s"].alias("spelling"), x["p"].alias("proposal")
            ),
        )
        (
            found.select("kind", "doc_id", "text_hash", "form_hash", "visible", hashed.alias("mixed"),
                         F.when(F.col("kind") == 1, F.xxhash64("token")).alias("token"))
            .write.partitionBy("kind").parquet(path)
        )
        schema = (
            "doc_id bigint, text_hash binary, form_hash binary, visible boolean, "
            "mixed array<struct<at:int,s:bigint,p:bigint,spelling:string,proposal:string>>, token bigint, kind int"
        )
        self.table = spark.read.schema(schema).option("basePath", path).parquet(path)
        self.docs = self.table.where("kind = 0").select("doc_id", "text_hash", "form_hash", "visible", "mixed")

    def rejected(self) -> DataFrame:
        """(s, p): the mixed spellings whose proposal the vocabulary doesn't have. One
        spelling has other proposals in texts of another dominant script."""
        asked = self.docs.where(F.size("mixed") > 0).select(F.explode("mixed").alias("m")).select("m.s", "m.p").distinct()
        single = asked.groupBy("p").agg(F.count("*").alias("n"), F.min("s").alias("s")).where("n = 1").select("p", "s")
        attested = self.table.where("kind = 1").select(F.col("token").alias("p"))
        return single.join(attested, "p", "left_anti").select("s", "p")

    def forms(self) -> DataFrame:
        """(doc_id, text_hash, form_hash, rest, visible): documents with equal form_hash
        and rest have the same consistent form."""
        rejected = self.rejected()
        mixed = self.docs.where(F.size("mixed") > 0).select("doc_id", "text_hash", F.explode("mixed").alias("m"))
        rest = (
            lookup_join(mixed.select("doc_id", "text_hash", "m.at", "m.s", "m.p"), rejected, ["s", "p"], "inner", spread="doc_id", name="rejected")
            .distinct()
            .groupBy("doc_id", "text_hash").agg(F.sum(F.xxhash64("at", "s").cast("decimal(38,0)")).alias("rest"))
        )
        plainly = self.docs.select("doc_id", "text_hash", "form_hash", "visible")
        return lookup_join(plainly, rest, ["doc_id", "text_hash"], "left", spread="text_hash", name="rests").withColumn(
            "rest", F.coalesce("rest", F.lit(0).cast("decimal(38,0)"))
        )


def look_alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b): documents with unequal texts and one consistent form.

    The different texts of a form are joined, each once; then each pair of texts is given
    its documents. Copies of one text never meet each other, so the work follows the result."""
    forms = (
        Analysis(docs, id_col, text_col).forms().where("visible and doc_id is not null")
        .select("doc_id", "text_hash", "form_hash", "rest").distinct()
    )
    shared = (
        forms.groupBy("form_hash", "rest").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"))
        .where("low <> high").select("form_hash", "rest")
    )
    few = materialise(lookup_join(forms, shared, ["form_hash", "rest"], "left_semi", spread="doc_id", name="shared"), "alike")
    texts = few.select("form_hash", "rest", "text_hash").distinct()
    a, b = (texts.withColumnRenamed("text_hash", t) for t in ("ta", "tb"))
    met = a.join(b, ["form_hash", "rest"]).where("ta < tb").select("ta", "tb")
    of = lambda t, d: few.select(F.col("text_hash").alias(t), F.col("doc_id").alias(d))
    both = met.join(of("ta", "da"), "ta").join(of("tb", "db"), "tb").where("da <> db")
    return both.select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b")).distinct()


def consistent_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form): the consistent form of every text; a null text gives null."""
    analysis = Analysis(docs, id_col, text_col)
    rejected = analysis.rejected()
    spelled = (
        lookup_join(
            analysis.docs.where(F.size("mixed") > 0).select("doc_id", F.explode("mixed").alias("m")).select("doc_id", "m.s", "m.p", "m.spelling", "m.proposal"),
            rejected, ["s", "p"], "inner", spread="doc_id", name="rejected",
        ).groupBy("doc_id").agg(F.collect_set(F.struct("spelling", "proposal")).alias("rejected"))
    )

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            ids, texts, kept = (batch.column(i).to_pylist() for i in range(3))
            pairs = [frozenset((x["spelling"], x["proposal"]) for x in k or ()) for k in kept]
            forms = [None if t is None else repair(t, k, cache)[0] for t, k in zip(texts, pairs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.string())], names=[id_col, "form"])

    rows = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    joined = lookup_join(rows, spelled, ["doc_id"], "left", name="spelled").select("doc_id", "text", "rejected")
    return joined.mapInArrow(rewrite, f"{id_col} bigint, form string")
