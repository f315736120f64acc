import itertools
import random

import pytest

from tidelog.llm import survivor as S
from tidelog.llm.survivor import Bundle, known, survivors

F = S.F
SCHEMA = "entry_id bigint, store_id bigint, key string, seq_no bigint, level int, a string, b string, c string, n int, first int, rank int"
TRUST = ("seq_no", "level", "entry_id")
KEYS = ["store_id", "key"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA)


def random_rows(seed, n=120):
    rng = random.Random(seed)
    return [
        (i, rng.choice([1, 2]), "hot" if rng.random() < 0.4 else rng.choice("xyz"), rng.randint(1, 9), rng.randint(0, 2),
         rng.choice([None, "", "p", "q", "r"]), rng.choice([None, "u", "v", "w"]), rng.choice([None, "1", " "]))
        for i in range(1, n + 1)
    ]


def test_known(spark):
    rows = [(v,) for v in ("x", " X ", None, "", "  ", "-", "N/A", "Unknown ", "none", "?", " ")]
    df = spark.createDataFrame(rows, "v string")
    assert [r.v for r in df.where(known("v")).collect()] == ["x", " X "]


def test_independent_fields(spark):
    rows = random_rows(1) + [(900, None, "x", 1, 1, "p", "u", "1"), (901, 1, None, 1, 1, "p", "u", "1")]
    df = frame(spark, rows).na.drop(subset=KEYS)
    bundles = [Bundle("a", ("a",), F.col("a").isNotNull()), Bundle("c", ("c",), known("c"))]
    got = {(r.store_id, r.key): (r.n, r.entry_id, r.a_entry_id, r.c_entry_id) for r in survivors(df, KEYS, bundles, TRUST, "entry_id", values=False).collect()}
    full = {(r.store_id, r.key): (r.n, r.entry_id, r.a_entry_id, r.c_entry_id) for r in survivors(frame(spark, rows), KEYS, bundles, TRUST, "entry_id").collect()}
    want = {}
    for key in {(r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None}:
        group = sorted((r for r in rows if (r[1], r[2]) == key), key=lambda r: (r[3], r[4], r[0]), reverse=True)
        pick = lambda ok: next((r[0] for r in group if ok(r)), 0)
        want[key] = (len(group), group[0][0], pick(lambda r: r[5] is not None), pick(lambda r: r[7] == "1"))
    assert got == full == want


def brute(group, depends):
    """The best choice over all combinations of distinct values."""
    at = {"a": 5, "b": 6}
    cands = {}
    for f, i in at.items():
        best = {}
        for r in group:
            if r[i] is not None:
                t = (r[3], r[4], r[0])
                if r[i] not in best or t > best[r[i]]:
                    best[r[i]] = t
        ranked = sorted(best.items(), key=lambda x: x[1], reverse=True)
        cands[f] = [(1 / k, t[2], v) for k, (v, t) in enumerate(ranked, 1)] + [(0.0, 0, None)]
    pairs = {(r[5], r[6]) for r in group}
    return max(x[0] + y[0] for x, y in itertools.product(cands["a"], cands["b"]) if x[2] is None or y[2] is None or (x[2], y[2]) in pairs)


@pytest.mark.parametrize("width", [1, 8])
def test_dependent_fields_are_optimal(spark, width):
    rows = random_rows(2, 40)
    bundles = [Bundle("a", ("a",), F.col("a").isNotNull()), Bundle("b", ("b",), F.col("b").isNotNull())]
    got = survivors(frame(spark, rows), KEYS, bundles, TRUST, "entry_id", depends=[("a", "b")], width=width).collect()
    by_id = {r[0]: r for r in rows}
    assert len(got) == len({(r[1], r[2]) for r in rows})
    for r in got:
        group = [x for x in rows if (x[1], x[2]) == (r.store_id, r.key)]
        if r.a is not None and r.b is not None:
            assert any((x[5], x[6]) == (r.a, r.b) for x in group)
        assert (r.a is None) == (r.a_entry_id == 0) and (r.a is None or by_id[r.a_entry_id][5] == r.a)

        def score(i, chosen):
            best = {}
            for x in group:
                if x[i] is not None and (x[i] not in best or (x[3], x[4], x[0]) > best[x[i]]):
                    best[x[i]] = (x[3], x[4], x[0])
            ranked = sorted(best, key=best.get, reverse=True)
            return 1 / (1 + ranked.index(chosen)) if chosen is not None else 0

        assert score(5, r.a) + score(6, r.b) == pytest.approx(brute(group, True))


def test_values_are_compared_as_they_are(spark):
    rows = [(1, 1, "k", 5, 0, "a\x1fb", "t1", None), (2, 1, "q", 5, 0, "p", "u", None), (3, 1, "q", 4, 0, "r", "w", None), (4, 1, "q", 6, 0, None, "w", None)]
    bundles = [Bundle("a", ("a",), F.col("a").isNotNull()), Bundle("b", ("b",), F.col("b").isNotNull())]
    got = {r.key: (r.a, r.b, r.a_entry_id, r.b_entry_id) for r in survivors(frame(spark, rows), KEYS, bundles, TRUST, "entry_id", depends=[("a", "b")]).collect()}
    # q: the newest value p and the newest type w never meet; p with u (1 + 1/2) and r with w
    # (1/2 + 1) are equal, and the first bundle's better value counts
    assert got == {"k": ("a\x1fb", "t1", 1, 1), "q": ("p", "u", 2, 2)}


def test_the_search_of_one_group():
    both = [("a", 1, 0, []), ("a", 2, 0, []), ("b", 1, 0, []), ("b", 2, 0, []), ("b", 3, 0, [])]
    rules = [("#0", "a", "b", "x", "y")]
    assert S.best_choice(both + [("#0", 1, 3, [])], ["a", "b"], rules, 8) == (1, 3, True)
    assert S.best_choice(both + [("#0", 2, 2, []), ("#0", 2, 1, [])], ["a", "b"], rules, 8) == (2, 1, True)
    assert S.best_choice(both, ["a", "b"], rules, 8) == (1, None, True)
    assert S.best_choice([("a", 1, 0, ["x"]), *both[1:]], ["a", "b"], rules, 8) == (1, 1, True)
    # between two bundles partners are given, whatever their rank
    assert S.best_choice(both[:2] + [("+a", 3, 0, []), ("a", 77, 0, []), ("b", 1, 0, []), ("#0", 77, 1, [])], ["a", "b"], rules, 2) == (77, 1, True)
    # in a chain a candidate beyond the width could be as good: search again
    chain = [*rules, ("#1", "b", "c", "y", "z")]
    three = [*both[:3], ("+a", 3, 0, []), ("c", 1, 0, []), ("#1", 1, 1, [])]
    assert S.best_choice(three, ["a", "b", "c"], chain, 2) == (1, None, 1, False)
    assert [c[0] for c in S.components(["a", "b", "c", "d"], [rules[0], ("#1", "d", "c", "w", "z")])] == [["a", "b"], ["c", "d"]]


@pytest.mark.parametrize("seed", range(3))
def test_two_bundles_need_no_wider_search(spark, seed, monkeypatch):
    """A hot key with many values: the partners are found by reductions, in one round."""
    rng = random.Random(seed)
    rows = [(i, 1, "hot", i, 0, rng.choice([None, f"v{i % 90}"]), rng.choice([None, None, f"t{rng.randint(0, 60)}"]), None) for i in range(1, 400)]
    rows += [(500, 1, "hot", 500, 0, "newest", None, None), (501, 1, "hot", 499, 0, None, "t-new", None), (502, 1, "hot", 0, 0, "newest", "t3", None), (503, 1, "hot", 0, 0, "v3", "t-new", None)]
    rounds = []
    real = S._solved
    monkeypatch.setattr(S, "_solved", lambda *a: rounds.append(a[-1]) or real(*a))
    bundles = [Bundle("a", ("a",), F.col("a").isNotNull()), Bundle("b", ("b",), F.col("b").isNotNull())]
    (r,) = survivors(frame(spark, rows), KEYS, bundles, TRUST, "entry_id", depends=[("a", "b")], width=2).collect()
    ranks = []
    for i in (5, 6):
        best = {}
        for x in rows:
            if x[i] is not None:
                best[x[i]] = max(best.get(x[i], ()), (x[3], x[4], x[0]))
        ranks.append({v: n for n, v in enumerate(sorted(best, key=best.get, reverse=True), 1)})
    pairs = [(ranks[0][x[5]], ranks[1][x[6]], x[5], x[6]) for x in rows if x[5] is not None and x[6] is not None]
    want = max(pairs, key=lambda p: (S.UNIT // p[0] + S.UNIT // p[1], -p[0], -p[1]))
    assert rounds == [2] and (r.a, r.b) == want[2:]


def test_a_chain_of_dependencies_against_brute_force(spark):
    rows = random_rows(7, 90)
    bundles = [Bundle(c, (c,), F.col(c).isNotNull()) for c in "abc"]
    depends = [("a", "b"), ("b", "c")]
    got = survivors(frame(spark, rows), KEYS, bundles, TRUST, "entry_id", depends=depends, width=2).collect()
    for r in got:
        group = [x for x in rows if (x[1], x[2]) == (r.store_id, r.key)]
        ranked = []
        for i in (5, 6, 7):
            best = {}
            for x in group:
                if x[i] is not None:
                    best[x[i]] = max(best.get(x[i], ()), (x[3], x[4], x[0]))
            ranked.append([*sorted(best, key=best.get, reverse=True), None])
        seen = [{(x[5], x[6]) for x in group}, {(x[6], x[7]) for x in group}]
        fits = lambda v: all(None in p or p in s for p, s in zip(((v[0], v[1]), (v[1], v[2])), seen))
        trust = lambda v: sum(0 if y is None else S.UNIT // (1 + ranked[i].index(y)) for i, y in enumerate(v))
        choices = [v for v in itertools.product(*ranked) if fits(v)]
        want = max(choices, key=lambda v: (trust(v), [-ranked[i].index(y) for i, y in enumerate(v)]))
        assert (r.a, r.b, r.c) == want


def test_a_bundle_is_taken_whole(spark):
    rows = [(1, 1, "k", 5, 0, "old", "x", None), (2, 1, "k", 9, 0, "new", None, None), (2, 1, "k", 9, 0, "new", None, None)]
    bundle = Bundle("ab", ("a", "b"), F.col("a").isNotNull() & F.col("b").isNotNull())
    (r,) = survivors(frame(spark, rows), KEYS, [bundle], TRUST, "entry_id").collect()
    assert (r.a, r.b, r.ab_entry_id, r.entry_id) == ("old", "x", 1, 2)


def test_empty(spark):
    bundle = Bundle("a", ("a",), F.col("a").isNotNull())
    assert survivors(frame(spark, []), KEYS, [bundle], TRUST, "entry_id", depends=[("a", "a")]).count() == 0


def test_without_dependencies_every_group_is_searched(spark, monkeypatch):
    """The sources come from the search, not from the root; a bundle that the best rows lack
    and one that no row has too."""
    rows = random_rows(5) + [(1000 + i, 3, "deep", 100 + i, 0, None, None, None) for i in range(50)] + [(2000, 3, "deep", 1, 0, None, "u", "1")]
    bundles = [Bundle("a", ("a",), F.col("a").isNotNull()), Bundle("b", ("b",), F.col("b").isNotNull()), Bundle("c", ("c",), known("c"))]
    want = {}
    for key in {(r[1], r[2]) for r in rows}:
        group = sorted((r for r in rows if (r[1], r[2]) == key), key=lambda r: (r[3], r[4], r[0]), reverse=True)
        pick = lambda ok: next((r[0] for r in group if ok(r)), 0)
        want[key] = (pick(lambda r: r[5] is not None), pick(lambda r: r[6] is not None), pick(lambda r: r[7] == "1"))
    for width in (1, 8):
        found = survivors(frame(spark, rows), KEYS, bundles, TRUST, "entry_id", width=width, values=False)
        assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
        assert {(r.store_id, r.key): (r.a_entry_id, r.b_entry_id, r.c_entry_id) for r in found.collect()} == want
    assert want[3, "deep"] == (0, 2000, 2000)


def test_the_search_without_dependencies(monkeypatch):
    seen = []
    real = S._search
    monkeypatch.setattr(S, "_search", lambda *a: seen.append(a) or real(*a))
    assert S.free_choice(["a", "b", "c"], (3, 0, 1), False) == [1, None, 1]
    assert S.free_choice(["a", "b", "c"], (3, 0, 1), True) == [1, None, 1]
    assert S.free_choice(["a"], (0,), True) == [None]
    assert [len(a[0]) for a in seen] == [4, 6, 0]
    # a choice that the bound doesn't prove is an error
    monkeypatch.setattr(S, "_search", lambda *a: ({"a": 1}, False))
    with pytest.raises(RuntimeError, match="open"):
        S.free_choice(["a"], (1,), True)
