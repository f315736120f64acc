import random

import numpy as np
import pytest

from tidelog.llm import leaks as L
from tidelog.llm.wikitext import word_streams

W10 = "one two three four five six seven eight nine ten"


def words(text):
    return word_streams(text)[0]


def cut(text):
    """(size, MinHash, place) -> windows of a text."""
    out = {}
    for w in word_streams(text):
        for size, m, place, i in L.windows(np.array([L.word_hash(x) for x in w], np.uint64), 10, 5):
            out.setdefault((size, m, place), []).append(w[i : i + 10])
    return out


def leaked(item, doc):
    theirs, mine = cut(item), cut(doc)
    met = [(a, b) for k in theirs.keys() & mine.keys() for a in theirs[k] for b in mine[k]]
    return any(L.contained(a, b, 5) and L.same_words(a, b) for a, b in met)


@pytest.mark.parametrize(
    "text",
    [
        "One, two; THREE\nfour - five six 'seven' (eight) nine ten.",
        "one two [[target page|three]] four [[five]] six seven eight nine ten",
        "one two '''three''' four ''five'' six<ref name=\"a\">note here</ref> seven <!-- not this --> eight nine<ref name=x /> ten",
        "one two{{citation needed|date=2019}} three four{{dubious|2001}} five six<sup>[2019]</sup> seven eight nine ten",
        "one&nbsp;two&#160;three &mdash; four five six<br />seven<br>eight nine ten",
        "{{quote\n| text = one two three four five six seven eight nine ten\n| author = me\n}}",
        "{| class=\"wikitable\"\n! one !! two\n|-\n| three || four\n|-\n| style=\"x\" | five || six\n|}\nseven eight nine ten",
        "on­e t​wo thrеe fоur five sіx seѵen".replace("ѵ", "v") + " ｅｉｇｈｔ nine ten",
        "* one\n* two\n# three\n== four ==\nfive six s<b>ev</b>en eight nine [[ten]]",
        "[[File:x.jpg|thumb|300px|one two three four five six seven eight nine ten]]",
        "one two three<rеf>note</rеf> four five six seven eight nine ten",
        "one two <ref>a {{p.|40}} b</ref> three four five six seven eight nine ten",
        "<gallery>\nFile.png|one two three four five\nOther.jpg|six seven eight nine ten\n</gallery>",
        "one two three four five six seven eight nine ten {{unclosed",
        "[http://x.org one two three] four five six seven eight nine ten",
    ],
)
def test_a_reader_sees_the_passage(text):
    assert leaked(W10, text) and leaked(text, W10)


@pytest.mark.parametrize("text", ["one two three four five x six seven eight nine ten", "[[one two three four five|a]] six seven eight nine ten", " ".join(reversed(W10.split()))])
def test_no_passage(text):
    assert not leaked(W10, text)


def brute(docs, items, n=10):
    out = set()
    for d, x in docs:
        held = {tuple(w[k : k + n]) for w in word_streams(x) for k in range(len(w) - n + 1)}
        for i, y in items:
            if any(tuple(w[k : k + n]) in held for w in word_streams(y) for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("bits,limit", [(8, 0), (1 << 24, 8 << 20)])
def test_against_brute_force(spark, monkeypatch, bits, limit):
    """Also with a filter that lets everything through, and windows joined by a shuffle."""
    monkeypatch.setattr(L, "FILTER_BITS", bits)
    real = L.lookup_join
    monkeypatch.setattr(L, "lookup_join", lambda *a, **k: real(*a, **k, limit=limit))
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(25)] + ["the"] * 10
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 9, 10, 11, 30])))) for i in range(12)]
    items += [(50, items[5][1]), (51, None), (52, ""), (53, "the " * 15), (54, W10), (55, f"see<ref>{items[9][1]}</ref> and<!-- {W10} -->")]
    docs = []
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(2):
            src = rng.choice([x.split() for _, x in items if x])
            n = rng.randint(8, 12)
            k = rng.randint(0, max(0, len(src) - n))
            w[rng.randint(0, 60) : 0] = src[k : k + n]
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "the " * 100_000), (0, docs[0][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs] + [(None, W10, 1, "x")], "doc_id bigint, text string, item_id int, answer string").repartition(3)
    it = spark.createDataFrame([(*r, 2) for r in items] + [(None, W10, 2)], "item_id bigint, text string, doc_id int")
    got = [tuple(r) for r in L.leaks(df, it).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)
    assert L.leaks(df.where("doc_id < 0"), it).count() == 0 and L.leaks(df, it.where("item_id < 0")).count() == 0


RUSSIAN = "Водяная мельница на берегу реки стоит там много лет подряд"
GREEK = "Την παλιά γέφυρα στον ποταμό έχτισαν με πέτρα από το βουνό νωρίς"


@pytest.mark.parametrize("text", [RUSSIAN, GREEK])
def test_case_and_look_alikes_together(text):
    latin = str.maketrans("ВНКМТСЕОАРХΒΗΚΜΝΤΖΙΕΟΑΡΧνο", "BHKMTCEOAPXBHKMNTZIEOAPXvo")
    for doc in (text.upper(), text.lower(), text.upper().translate(latin), text.translate(latin), text.lower().translate(latin)):
        assert leaked(text, doc) and leaked(doc, text)


def test_v_is_not_n():
    assert not leaked(W10, W10.replace("v", "n"))
    assert leaked(W10, W10.replace("v", "ν")) and leaked(W10, W10.upper().replace("N", "Ν"))
    assert not leaked(W10, W10.replace("x", "ν"))


@pytest.mark.parametrize("name", ["efn", "Refn", "note"])
def test_a_passage_in_a_note_template(name):
    assert leaked(W10, f"some text{{{{{name}|group=n|{W10}}}}} goes on")
    assert leaked(W10, f"some text<ref>see {{{{{name}|1={W10}}}}}</ref> goes on")
    assert words(f"some{{{{{name}|{W10}}}}} text") == ["some", "text"]


def test_nothing_is_cut_off():
    short = "a b c d e f g h i j"
    assert leaked(short, f"x <!--{short}--> y") and leaked(f"x<ref>{short}</ref>", short)
    for deep in (30, 41, 3000):
        assert words("{{a|" * deep + W10 + "}}" * deep + " end") == [*W10.split(), "end"]
        assert words("[[a|" * deep + W10 + "]]" * deep + " end") == [*W10.split(), "end"]
        assert words("{{{a|" * deep + W10 + "}}}" * deep + " end") == [*W10.split(), "end"]
    name = " ".join(["name"] * 20)
    assert words("{{box|" + name + "=" + W10 + "}}") == W10.split()
    assert leaked(name, "{{box|" + name + "=" + W10 + "}}")
    assert words("<gallery>\n" + "f" * 300 + ".png|" + W10 + "\n</gallery>") == W10.split()


def test_braces_in_runs():
    assert words("{{a|{{b|x}}}} y") == ["x", "y"] and words("{{a|{{{b|x}}}}} y") == ["x", "y"]
    assert words("{{{{{1|x}}}|z}} y") == ["z", "y"] and words("{{a|x}}} y") == ["x", "y"]


def test_kept_lines_change_nothing(monkeypatch):
    from tidelog.llm import wikitext as T

    texts = [f"[[a|b]] Éne two\n{{{{x|three}}}}\nfour {i % 3} <ref>note {i}\nЕnd</ref>\r\nfive" for i in range(9)]
    for kept in (0, 2, 1000):
        monkeypatch.setattr(T, "KEPT_LINES", kept)
        lowered, finished = {}, {}
        for text in texts * 2:
            got = [[w for words, _ in lines for w in words] for lines in T.line_streams(text, lowered, finished)]
            assert got == word_streams(text)
