import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import tokens as T

PATH = f"{T.TOKENIZERS}/byte_bpe_50k.json"
HARD = [
    "", " ", "\n", "  \n\t\n x", "a\n\n b", "\x1c\x1d a\x1fb", "don't DON'T it's 'sx we'll", "_a_b__ ²½ ٣a", "   x　 y\n",
    "aaaaaaaaaaaaa", "<|endoftext|> hi", "é" * 30, "\r\n\r\nq  ", "x​ y", "\na", "a\n", "a \n\n\n", "é\U0001f602\U0001f468‍\U0001f469",
    "ab" * 5000, "1234567890" * 500, "日本語です。", "\x85\x00z",
]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def own(texts):
    find = T.word_pattern().findall
    words: dict[str, int] = {}
    rows = [[words.setdefault(w, len(words)) for c in T.chunks(x) for w in find(c)] for x in texts]
    ids = T.replay(list(words), *T.load_merges(PATH))
    return [[i for w in r for i in ids[w]] for r in rows]


def test_hard_texts(reference):
    assert own(HARD) == reference(HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cn", "Co"), max_codepoint=0x2FFF), max_size=30), min_size=1, max_size=4))
def test_any_text(texts):
    t = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = t
    t.encode_special_tokens = True
    assert own(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_chunks_lose_nothing():
    for x in HARD:
        assert "".join(T.chunks(x)) == x
        find = T.word_pattern().findall
        assert [w for c in T.chunks(x) for w in find(c)] == find(x)


@pytest.mark.parametrize("block", [50, 6_000_000])
def test_encode(spark, reference, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK_CHARS", block)
    rows = [(i, x, 1, "w", 0) for i, x in enumerate([*HARD, None, HARD[6]])] + [(None, "null id", 1, "w", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block int, word string, kind int").repartition(3)
    got = {r.doc_id: list(r.ids) for r in T.encode(df).collect()}
    assert got == {r[0]: reference([r[1] or ""])[0] for r in rows}
    assert T.encode(df.where("doc_id < 0")).count() == 0


def test_round_trip_of_the_corpus(spark):
    t = Tokenizer.from_file(PATH)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in T.encode(df).collect():
        assert t.decode(list(r.ids), skip_special_tokens=False) == texts[r.doc_id]
