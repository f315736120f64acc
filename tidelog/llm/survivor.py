"""Best representative of each duplicate group (consistent bundles).

Fields are grouped into bundles; a bundle's fields are taken together from one row.
The rows of a group are ranked by trust (for example newest, then most settled, then
greatest id), and a bundle's candidates are its distinct values in the rows in which all
its fields are present, ranked by their best row. A choice takes one candidate of each
bundle; its trust is the sum of the candidates' trusts, ``UNIT // rank``. Functional
dependencies between bundles restrict it: with ``(x, y)``, the values chosen for the fields
``x`` and ``y`` must stand together in at least one row of the group, unless one is null.

The search is branch and bound, for all groups at once:

- Root: the relaxation without dependencies, the best candidate of each bundle by itself,
  is an upper bound of every choice. It comes from one aggregation that combines on the map
  side, so a group with a third of all rows sends one row per map task. A root that keeps
  the dependencies is optimal and ends the search of its group. A root whose dependent values
  come from one row keeps them; only the rows of the other groups are looked at again.
- Without dependencies every group is searched beside its root: a bundle's candidates are the
  rows that have it among the ``width`` best of the group, or the root's where none of these
  has it. The first way down takes the best of each bundle and reaches the bound, which cuts
  all others and proves the choice, whatever rows there are beyond the width. Copies of a
  value count as candidates of their own here: they come after it, and nothing asks for them.
- Branches: of the groups whose root breaks a dependency, the ``width`` best candidates of
  each dependent bundle and the pairs that stand together among these are brought to one
  task, ranks only: a group of any size sends a bounded number of rows, which each map
  task has cut to the best before. There the search goes depth first, best candidates
  first, cut where the trust so far plus the best of the open bundles can't beat the best
  choice known. Where the bound can't show that no candidate beyond the width is as good,
  the group is searched again with eight times the width, until it can.

Values are compared as what they are, by joins, never as text made of them.

Defined results: rows with a null in the group key are ignored; a field never present
gives null and source id 0; if no choice keeps the dependencies, a bundle may be left
empty with trust 0; of choices of equal trust the one with better candidates in the earlier
bundles counts; equal values are one candidate, whose source is its best row; ties of
trust go to the greater id; repeated rows change nothing but the count; empty tables give
empty results; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.compaction import known as known
from tidelog.operators.joins import lookup_join
from tidelog.storage.workspace import materialise

#: Trust of the best candidate; of that at rank r, UNIT // r.
UNIT = 1 << 40


@dataclass(frozen=True)
class Bundle:
    """Fields chosen together, and when they are all present."""

    name: str
    fields: tuple[str, ...]
    present: Column = field(compare=False)


def root(rows: DataFrame, keys: Sequence[str], bundles: Sequence[Bundle], trust: Sequence[str], values: bool = True) -> DataFrame:
    """The relaxation: keys, ``n`` (rows), ``first`` (the first row's trust columns), and per
    bundle a struct ``b_<name>`` of its best row's trust columns and, with ``values``, fields."""
    order = [F.col(c) for c in trust]
    fields = lambda b: [F.col(f).alias(f"v_{f}") for f in b.fields] if values else []
    best = [F.max(F.when(b.present, F.struct(*order, *fields(b)))).alias(f"b_{b.name}") for b in bundles]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.struct(*order)).alias("first"), *best)


def survivors(
    rows: DataFrame,
    keys: Sequence[str],
    bundles: Sequence[Bundle],
    trust: Sequence[str],
    id_col: str,
    depends: Sequence[tuple[str, str]] = (),
    width: int = 8,
    values: bool = True,
) -> DataFrame:
    """One surviving record per group: keys, ``n``, the first row's id, every bundle's source
    id and, with ``values``, the chosen fields. ``trust`` are columns compared in turn,
    greatest first, the id last."""
    keys = list(keys)
    rows = rows.na.drop(subset=keys)
    owner = {f: b.name for b in bundles for f in b.fields}
    depends = [(x, y) for x, y in depends if owner[x] != owner[y]]  # a bundle's fields come from one row
    top = root(rows, keys, bundles, trust, values or bool(depends))
    if depends:
        top = _searched(materialise(top, "roots"), rows, keys, bundles, trust, id_col, depends, width)
        chosen = lambda b: F.col(f"b_{b.name}.{id_col}")
    else:
        top = _searched_freely(top, rows, keys, bundles, trust, id_col, width)
        chosen = lambda b: F.col(f"s_{b.name}")
    source = lambda b: F.coalesce(chosen(b), F.lit(0).cast("bigint")).alias(f"{b.name}_{id_col}")
    return top.select(
        *keys, "n", F.col(f"first.{id_col}").alias(id_col), *[source(b) for b in bundles],
        *[F.col(f"b_{b.name}.v_{f}").alias(f) for b in bundles for f in b.fields if values],
    )


def _searched(top: DataFrame, rows: DataFrame, keys: list[str], bundles, trust, id_col: str, depends, width: int) -> DataFrame:
    """The roots, with the choice of the search in groups whose root breaks a dependency."""
    owner = {f: b for b in bundles for f in b.fields}
    bound = [b for b in bundles if any(owner[f] is b for pair in depends for f in pair)]
    apart = F.lit(False)
    for x, y in depends:
        a, b = F.col(f"b_{owner[x].name}"), F.col(f"b_{owner[y].name}")
        apart = apart | (a[f"v_{x}"].isNotNull() & b[f"v_{y}"].isNotNull() & (a[id_col] != b[id_col]))
    suspects = top.where(apart).select(*keys)
    fields = list(dict.fromkeys([*trust, *[f for b in bound for f in b.fields]]))
    marks = [b.present.alias(f"_has_{b.name}") for b in bound]
    near = materialise(
        lookup_join(rows.select(*keys, *fields, *marks), suspects, keys, "left_semi", spread=id_col, name="suspects"), "near"
    )
    chosen = None
    names = [b.name for b in bound]
    rules = [(f"#{i}", owner[x].name, owner[y].name, x, y) for i, (x, y) in enumerate(depends)]
    twos = [r for r in rules if any({*c[0]} == {r[1], r[2]} and len(c[1]) == 1 for c in components(names, rules))]
    while True:
        values = {b.name: materialise(_values(near, keys, b, trust), "values") for b in bound}
        seen = {r[0]: materialise(near.where(F.col(r[3]).isNotNull() & F.col(r[4]).isNotNull()).select(*keys, r[3], r[4]).distinct(), "seen") for r in rules}
        ranked = {n: materialise(_ranked(v, keys, width), "ranked") for n, v in values.items()}
        for rule, m, n, x, y in twos:
            more = {
                n: _partner(values[n], ranked[m], seen[rule], keys, x, y, width),
                m: _partner(values[m], ranked[n], seen[rule], keys, y, x, width),
            }
            ranked |= {k: materialise(ranked[k].unionByName(p), "ranked") for k, p in more.items()}
        pairs = [_pairs(seen[r[0]], ranked[r[1]], ranked[r[2]], keys, r[3], r[4], width) for r in rules]
        picks = materialise(_solved(ranked, pairs, keys, bound, rules, width), "picks")
        done = picks.where("proven")
        for b in bound:
            best = _open(ranked[b.name], width).select(*keys, F.col("_rank").alias(f"at_{b.name}"), F.struct("_t.*", *[F.col(f"v_{f}") for f in b.fields]).alias(f"p_{b.name}"))
            done = done.join(best, [*keys, f"at_{b.name}"], "left")
        done = done.select(*keys, *[f"p_{b.name}" for b in bound])
        chosen = done if chosen is None else chosen.unionByName(done)
        open_groups = picks.where("not proven").select(*keys)
        if open_groups.isEmpty():
            break
        near = materialise(lookup_join(near, open_groups, keys, "left_semi", spread=id_col, name="open"), "near")
        width *= 8
    joined = top.join(chosen.withColumn("_searched", F.lit(True)), keys, "left")
    for b in bound:
        # the same fields by name, as the types of both structs follow from the same columns
        picked = F.struct(*[F.col(f"p_{b.name}")[c].alias(c) for c in [*trust, *[f"v_{f}" for f in b.fields]]])
        taken = F.when(F.col(f"p_{b.name}").isNotNull(), picked)
        joined = joined.withColumn(f"b_{b.name}", F.when(F.col("_searched"), taken).otherwise(F.col(f"b_{b.name}")))
    return joined.select(top.columns)


def _searched_freely(top: DataFrame, rows: DataFrame, keys: list[str], bundles, trust, id_col: str, width: int) -> DataFrame:
    """The roots with ``s_<bundle>``, the id of the row that the search without dependencies
    takes for it, null for one left empty."""
    names = [b.name for b in bundles]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in trust]))
    marks = [F.coalesce(b.present, F.lit(False)).alias(f"_has_{b.name}") for b in bundles]
    near = rows.select(*keys, *trust, *marks).withColumn("_at", at).where(F.col("_at") <= width)
    held = F.sort_array(F.collect_list(F.struct("_at", F.col(id_col).alias("_id"), *[f"_has_{n}" for n in names])))
    both = top.join(near.groupBy(*keys).agg(held.alias("_near")), keys).select(*top.columns, "_near")
    place = [top.columns.index(f"b_{n}") for n in names]
    n_at, all_columns = top.columns.index("n"), len(top.columns)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choice = lru_cache(1 << 16)(lambda counts, more: free_choice(names, counts, more))
        for batch in batches:
            lists = batch.column(all_columns)
            ends = lists.value_lengths().to_pylist()
            _, ids, *has = (c.to_pylist() for c in lists.flatten().flatten())
            roots = [batch.column(i).field(id_col).to_pylist() for i in place]
            made, start = [], 0
            for g, (length, n) in enumerate(zip(ends, batch.column(n_at).to_pylist())):
                end = start + length
                found = [[ids[i] for i in range(start, end) if h[i]] or [r[g]] * (r[g] is not None) for h, r in zip(has, roots)]
                picks = choice(tuple(map(len, found)), n > length)
                taken = [f[p - 1] if p else None for f, p in zip(found, picks)]
                if taken != [r[g] for r in roots]:
                    raise RuntimeError(f"the search took {taken}, below the bound")
                made.append(taken)
                start = end
            chosen = [pa.array(c, pa.int64()) for c in list(zip(*made)) or [()] * len(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:all_columns], *chosen], names=[*batch.schema.names[:all_columns], *[f"s_{x}" for x in names]])

    schema = both.select(*top.columns).schema
    for n in names:
        schema = schema.add(f"s_{n}", "long")
    return both.mapInArrow(solve, schema)


def free_choice(names: list[str], counts: tuple[int, ...], more: bool) -> list[int | None]:
    """Branch and bound over one group without dependencies, with so many candidates of each
    bundle and, if ``more``, unseen ones behind them; raises if the bound doesn't prove it."""
    held = [(n, rank, 0, ()) for n, count in zip(names, counts) for rank in range(1, count + 1)]
    held += [(f"+{n}", count + 1, 0, ()) for n, count in zip(names, counts) if more and count]
    taken, proven = _search(held, names, [], min((c for c in counts if c), default=1))
    if not proven:
        raise RuntimeError(f"the bound leaves {counts} open")
    return [taken[n] for n in names]


def _values(near: DataFrame, keys: list[str], b: Bundle, trust) -> DataFrame:
    """A bundle's distinct values in each group, each with the trust of its best row."""
    return near.where(f"_has_{b.name}").groupBy(*keys, *[F.col(f).alias(f"v_{f}") for f in b.fields]).agg(
        F.max(F.struct(*[F.col(c) for c in trust])).alias("_t")
    )


def _ranked(values: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The best ``width`` values in each group, and the next one, which only tells that there
    are more. Each task cuts its part to as many before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_t")))
    return values.withColumn("_rank", rank).where(F.col("_rank") <= width + 1).withColumn("_partner", F.lit(False))


def _open(ranked: DataFrame, width: int) -> DataFrame:
    """The candidates that the search may take."""
    return ranked.where((F.col("_rank") <= width) | F.col("_partner"))


def _partner(values: DataFrame, others: DataFrame, seen: DataFrame, keys: list[str], x: str, y: str, width: int) -> DataFrame:
    """In each group the best value that may stand beside the other bundle's best one, if it
    ranks beyond the width. ``x`` is the field of the other bundle, ``y`` that of this one."""
    top = others.where((F.col("_rank") == 1) & F.col(f"v_{x}").isNotNull()).select(*keys, F.col(f"v_{x}").alias(x))
    met = seen.join(top, [*keys, x], "left_semi").select(*keys, F.col(y).alias(f"v_{y}")).distinct()
    fit = values.join(met, [*keys, f"v_{y}"], "left_semi").select(values.columns).unionByName(values.where(F.col(f"v_{y}").isNull()))
    rest = [c for c in values.columns if c not in keys]
    best = materialise(fit.groupBy(*keys).agg(F.max(F.struct("_t", *[c for c in rest if c != "_t"])).alias("_b")).select(*keys, "_b.*"), "partners")
    above = lookup_join(values.select(*keys, "_t"), best.select(*keys, F.col("_t").alias("_b")), keys, "inner", spread="_t", name="partners")
    counted = above.where(F.col("_t") > F.col("_b")).groupBy(*keys).agg(F.count("*").cast("int").alias("_n"))
    ranks = best.join(counted, keys, "left").withColumn("_rank", F.coalesce("_n", F.lit(0)) + 1).drop("_n")
    return ranks.where(F.col("_rank") > width).withColumn("_partner", F.lit(True)).select(*values.columns, "_rank", "_partner")


def _pairs(seen: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str, width: int) -> DataFrame:
    """(keys, _a, _b): ranks of which the values of a dependency stand together in a row."""
    rank = lambda r, f, to: _open(r, width).select(*keys, F.col(f"v_{f}").alias(f), F.col("_rank").alias(to))
    return seen.join(rank(a, x, "_a"), [*keys, x]).join(rank(b, y, "_b"), [*keys, y]).select(*keys, "_a", "_b").distinct()


def _solved(ranked: dict, pairs: list[DataFrame], keys: list[str], bound, rules: list[tuple], width: int) -> DataFrame:
    """(keys, at_<bundle>.., proven): the choice in each group whose root breaks a dependency."""
    good = None
    parts = None
    for b in bound:
        nulls = F.array_compact(F.array(*[F.when(F.col(f"v_{f}").isNull(), F.lit(f)) for f in b.fields]))
        here = F.when((F.col("_rank") <= width) | F.col("_partner"), b.name).otherwise(f"+{b.name}")
        part = ranked[b.name].select(*keys, here.alias("_kind"), F.col("_rank").alias("_a"), F.lit(0).alias("_b"), nulls.alias("_nulls"))
        parts = part if parts is None else parts.unionByName(part)
    for i, p in enumerate(pairs):
        part = p.select(*keys, F.lit(f"#{i}").alias("_kind"), "_a", "_b", F.array().cast("array<string>").alias("_nulls"))
        parts = parts.unionByName(part)
        # a pair of the best two, whatever else has a null, keeps this dependency
        kept = p.where("_a = 1 and _b = 1").select(*keys)
        good = kept if good is None else good.join(kept, keys, "left_semi")
    broken = parts.join(good, keys, "left_anti")
    names = [b.name for b in bound]
    types = dict(parts.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"at_{n} int" for n in names), "proven boolean"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picks = [best_choice([tuple(x.values()) for x in held], names, rules, width) for held in batch.column(len(keys)).to_pylist()]
            made = [pa.array(c, pa.int32()) for c in list(zip(*picks))[:-1]] or [pa.array([], pa.int32()) for _ in names]
            proven = pa.array([p[-1] for p in picks], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made, proven], names=[*keys, *[f"at_{n}" for n in names], "proven"])

    # bounded by the width, whatever the size of the group
    groups = broken.groupBy(*keys).agg(F.collect_list(F.struct("_kind", "_a", "_b", "_nulls")).alias("_held"))
    return groups.mapInArrow(solve, schema)


def components(names: list[str], rules: list[tuple]) -> list[tuple[list[str], list[tuple]]]:
    """Bundles that rules connect, directly or by others, with their rules."""
    out, left = [], list(names)
    while left:
        group = [left[0]]
        for n in group:
            group += [m for r in rules if n in r[1:3] for m in r[1:3] if m not in group]
        left = [n for n in left if n not in group]
        inside = [n for n in names if n in group]
        out.append((inside, [r for r in rules if r[1] in group]))
    return out


def best_choice(held: list[tuple], names: list[str], rules: list[tuple], width: int) -> tuple:
    """Branch and bound over one group: the rank taken in each bundle (None for one left
    empty), and whether no candidate beyond the width can be as good. ``held``: (bundle, rank,
    0, names of null fields), (+bundle, rank, 0, []) for a next one that isn't among them, and
    (rule, rank, rank, []) rows."""
    taken, proven = {}, True
    for inside, own in components(names, rules):
        part, sure = _search(held, inside, own, width)
        taken |= part
        proven = proven and sure
    return (*(taken[n] for n in names), proven)


def _search(held: list[tuple], names: list[str], rules: list[tuple], width: int) -> tuple[dict[str, int | None], bool]:
    candidates: dict[str, list] = {n: [] for n in names}
    seen: dict[str, set] = {r[0]: set() for r in rules}
    more = dict.fromkeys(names, False)
    for kind, a, b, nulls in held:
        if kind in seen:
            seen[kind].add((a, b))
        elif kind in candidates:
            candidates[kind].append((a, frozenset(nulls)))
        elif kind[1:] in more:
            more[kind[1:]] = True
    for c in candidates.values():
        c.sort(key=lambda x: x[0])
    place = {n: i for i, n in enumerate(names)}
    checks: list[list] = [[] for _ in names]  # what is decided once a bundle is chosen
    for rule, a, b, x, y in rules:
        checks[max(place[a], place[b])].append((rule, place[a], place[b], x, y))
    tops = [UNIT if candidates[n] else 0 for n in names]
    rest = [sum(tops[i:]) for i in range(len(names) + 1)]
    best, taken = -1, [None] * len(names)
    chosen: list = [None] * len(names)

    def allowed(i: int) -> bool:
        for rule, a, b, x, y in checks[i]:
            p, q = chosen[a], chosen[b]
            if p and q and x not in p[1] and y not in q[1] and (p[0], q[0]) not in seen[rule]:
                return False
        return True

    def walk(i: int, score: int) -> None:
        nonlocal best, taken
        if i == len(names):
            if score > best:
                best, taken = score, [c[0] if c else None for c in chosen]
            return
        for c in [*candidates[names[i]], None]:
            gain = UNIT // c[0] if c else 0
            if score + gain + rest[i + 1] <= best:
                break  # candidates come by falling trust
            chosen[i] = c
            if allowed(i):
                walk(i + 1, score + gain)
            chosen[i] = None

    walk(0, 0)
    #: Between two bundles the partner of the other's best is among the candidates, so one
    #: beyond the width stands beside the other's second at most.
    spared = UNIT - UNIT // 2 if len(names) == 2 and len(rules) == 1 else 0
    beyond = max((rest[0] - tops[i] + UNIT // (width + 1) - spared for i, n in enumerate(names) if more[n]), default=-1)
    return dict(zip(names, taken)), beyond < best
