import random
from itertools import combinations

import pytest

from tidelog.llm import forms
from tidelog.llm.glyphs import consistent_text, look_alike_pairs, propose, repair

SAME = [
    ("café ñ", "café ñ"), ("Abc 12", "Ａｂｃ １２"), ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b"),
    ("ab", "﻿a­b"), ("ガパ", "ｶﾞﾊﾟ"), ("K;", "K;"), ("the port", "thе pоrt"), ("a", "а"),
    ("ö", "ӧ"), ("The Mill", "Τhe Мill"), ("была", "былa"),
]
UNLIKE = [("a", "A"), ("e", "é"), ("m2", "m²"), ("a-b", "a–b"), ("a b", "a  b"), ("a b", "a\nb"), ("0", "O"), ("l", "I"), ("1", "\U000110bd1")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert forms.fold(a) == forms.fold(b)
    assert repair("word " + a)[0] == repair("word " + b)[0] or "б" in a
    assert repair(a)[0] == repair(b)[0]


@pytest.mark.parametrize("a,b", UNLIKE)
def test_unlike(a, b):
    assert forms.fold(a) != forms.fold(b) and repair(a)[0] != repair(b)[0]


def test_plain_means_unchanged():
    table = forms._FOLD
    for o in range(0x3200):
        c = chr(o)
        if forms.plain(c) and not 0xD800 <= o < 0xE000:
            assert o not in table and forms.unicodedata.normalize("NFC", c) == c, hex(o)


def test_scripts_are_kept():
    assert propose("мельницa", "LATIN") == "мельница"
    assert propose("а", "CYRILLIC") == "а" and propose("а", "LATIN") == "a" and propose("a", "CYRILLIC") == "а"
    assert propose("Γη", "LATIN") == "Γη"
    text = "Первая мельница у реки"
    assert repair(text) == (text, [])


def brute(rows):
    return {
        (min(a, b), max(a, b)) for (a, x), (b, y) in combinations(rows, 2)
        if a != b and None not in (a, b, x, y) and x != y and forms.fold(x) == forms.fold(y) and forms.fold(x).strip()
    }


def corpus(seed):
    rng = random.Random(seed)
    base = ["The old mill at Delork", "by the sea", "Город у реки а", "Η πόλη του", "no copy here 12", "a", "över café"]
    rows = []
    swap = {}
    for line in forms.LOOK_ALIKES.split("\n"):
        members = line.split()
        for c in members:
            swap[c] = members
    for i in range(70):
        x = rng.choice(base)
        if rng.random() < 0.7:
            x = "".join(rng.choice(swap[c]) if c in swap and rng.random() < 0.3 else c for c in x)
        if rng.random() < 0.3:
            x = x.replace(" ", rng.choice([" ", "　", " ​"]), 1)
        if rng.random() < 0.3:
            x = forms.unicodedata.normalize("NFD", x)
        rows.append((i, x))
    return rows + [(200, None), (201, ""), (202, " "), (203, " "), (204, "​"), (205, "x" * 300_000), (206, "х" * 300_000), (3, rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, b"1", 5) for r in rows] + [(None, "a", b"1", 5)], "doc_id bigint, text string, text_hash binary, kind int").repartition(3)
    got = [tuple(r) for r in look_alike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert look_alike_pairs(df.where("doc_id < 0")).count() == 0
    of = {r.doc_id: r.form for r in consistent_text(df.where("doc_id is not null")).collect()}
    assert set(of) == {r[0] for r in rows} and of[200] is None and of[201] == ""
    assert all(of[a] == of[b] for a, b in got)


def test_a_proposal_nobody_attests_is_left(spark):
    rows = [(1, "xоzzle only"), (2, "another text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.form for r in consistent_text(df).collect()} == dict(rows)
    more = df.union(spark.createDataFrame([(3, "xozzle again")], df.schema))
    assert {r.doc_id: r.form for r in consistent_text(more).collect()}[1] == "xozzle only"


def test_a_spelling_is_rejected_by_script(spark):
    # In the Greek text The becomes Τhe, which nobody has; in the Russian ones it becomes
    # Тһе, which a second spelling attests. The first Russian text is there twice.
    russian = "Город у реки и мельница {} стоит"
    rows = [(1, "Η πόλη του ποταμού και γέφυρα The"), (2, russian.format("The")), (3, russian.format("Thе")), (2, russian.format("The"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert [tuple(r) for r in look_alike_pairs(df).collect()] == [(2, 3)]
    of = {r.doc_id: r.form for r in consistent_text(df).collect()}
    assert of[2] == of[3] == russian.format("Тһе") and of[1] == rows[0][1]


def test_repeated_rows_of_rejected_spellings(spark):
    rows = [(1, "авxя here"), (1, "авxя here"), (2, "авxя\u00a0here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [tuple(r) for r in look_alike_pairs(df).collect()] == [(1, 2)]


def test_every_letter_has_one_class_and_one_script():
    letters = forms.LOOK_ALIKES.split()
    assert len(letters) == len(set(letters))
    for line in forms._lines():
        assert len({forms.script(c) for c in line}) == len(line) and {forms.script(c) for c in line} <= set(forms.SCRIPTS)
    assert propose("տարօ", "ARMENIAN") == "տարօ" and repair("Հայաստան օր")[1] == []


def test_copies_of_a_text_are_not_joined_with_each_other(spark):
    n = 3000
    rows = spark.range(n).selectExpr("id as doc_id", "'a plain text' as text").union(spark.createDataFrame([(n, "a\u00a0plain text")], "doc_id bigint, text string"))
    got = look_alike_pairs(rows)
    assert got.count() == n and got.where(f"doc_id_b = {n}").count() == n


def test_what_executors_run_needs_no_package_there(tmp_path):
    """The functions are shipped by value: they load where the package isn't installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle
    from tidelog.llm import glyphs, leaks, survivor, tokens

    run = [glyphs._analyse, leaks._cut(10, 5), leaks._verified(5), survivor.best_choice, tokens._split, tokens._give, tokens.replay]
    (tmp_path / "f").write_bytes(cloudpickle.dumps(run))
    code = f"import sys; from pyspark import cloudpickle; n = len(cloudpickle.loads(open({str(tmp_path / 'f')!r}, 'rb').read())); assert n == {len(run)} and 'tidelog' not in sys.modules"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
