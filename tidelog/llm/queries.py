"""Queries of the training-data operators for language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.glyphs import consistent_text, look_alike_pairs
from tidelog.llm.leaks import leaks
from tidelog.llm.ledger import KeyLedger
from tidelog.llm.survivor import Bundle, known, survivors
from tidelog.llm.tokens import encode
from tidelog.operators.compaction import resolve_runs
from tidelog.operators.joins import lookup_join
from tidelog.sources.tables import table
from tidelog.storage.workspace import new_folder


def _ranked_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = resolve_runs(table(spark, sf_dir, "table_handles")).select("run_id", F.coalesce("level", F.lit(-1)).alias("level"))
    entries = table(spark, sf_dir, "run_entries").select(
        "entry_id", "run_id", "store_id", "key", "value", "seq_no", "tombstone", "value_type", "writer"
    )
    return lookup_join(entries, levels, ["run_id"], "left", spread="entry_id", name="levels").withColumn(
        "level", F.coalesce("level", F.lit(-1))
    )


def _present() -> dict:
    return {
        "value": F.col("value").isNotNull() | F.coalesce(F.col("tombstone"), F.lit(False)),
        "value_type": known("value_type"),
        "writer": known("writer"),
    }


TRUST = ("seq_no", "level", "entry_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of the survivors' fields, by the search of every group. No bundle depends
    on another here, so its first way down reaches the bound."""
    fields = {"value": ("value", "tombstone")}
    bundles = [Bundle(n, fields.get(n, (n,)), c) for n, c in _present().items()]
    found = survivors(_ranked_entries(spark, sf_dir), ["store_id", "key"], bundles, TRUST, "entry_id", values=False)
    return found.where("n > 1").select("store_id", "key", "entry_id", "value_entry_id", "value_type_entry_id", "writer_entry_id")


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving records themselves; a type must stand with its value in some row."""
    rows = _ranked_entries(spark, sf_dir).withColumn("value_type", F.when(known("value_type"), F.lower(F.trim("value_type"))))
    here = _present()
    bundles = [
        Bundle("value", ("value", "tombstone"), here["value"]),
        Bundle("value_type", ("value_type",), F.col("value_type").isNotNull()),
        Bundle("writer", ("writer",), here["writer"]),
    ]
    return survivors(rows, ["store_id", "key"], bundles, TRUST, "entry_id", depends=[("value", "value_type")]).drop("n")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = KeyLedger(spark, new_folder(spark, "ledger"))
    ledger.load(table(spark, sf_dir, "mutation_log"))
    return ledger.check(table(spark, sf_dir, "probe_keys"), "probe_id", "probes")


def p4_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, keys met, and wrong answers against the exact rank over all rows."""
    probes = table(spark, sf_dir, "probe_keys")
    found = p4_found(spark, sf_dir).withColumn("met", F.lit(True))
    keyed = probes.where("key is not null and store_id is not null and probe_id is not null")
    history = table(spark, sf_dir, "mutation_log").where("key is not null").select("store_id", "key", F.lit(None).cast("bigint").alias("probe_id"))
    first = (
        history.unionByName(keyed.select("store_id", "key", "probe_id"))
        .groupBy("store_id", "key").agg(F.max(F.col("probe_id").isNull()).alias("old"), F.min("probe_id").alias("probe_id"))
        .where("not old and probe_id is not null").select("probe_id", F.lit(True).alias("first"))
    )
    both = keyed.select("probe_id").distinct().join(found, "probe_id", "left").join(first, "probe_id", "left")
    wrong = F.col("met").isNotNull() == F.col("first").isNotNull()
    return both.agg(
        F.count("*").alias("answers"), F.count("met").alias("met"), F.coalesce(F.sum(wrong.cast("bigint")), F.lit(0).cast("bigint")).alias("wrong")
    )


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf_dir, "documents"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text."""
    return consistent_text(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_records, p4_found, p4_error_rate, p6_ids, p7_found, p8_found, p8_forms)
}

_LEVELS = r"""l as (select run_id, max(level) as level from table_handles
  where regexp_matches(lower(trim(file_name)), '\.sst$') group by run_id),
e as (select r.*, coalesce(l.level, -1) as lv from run_entries r left join l on r.run_id = l.run_id)"""


def _label(c: str) -> str:
    return f"{c} is not null and lower(trim({c})) not in ('', '-', '?', 'n/a', 'none', 'unknown')"


_UNIT = 1 << 40  # trust of a best candidate

_FIRST = "coalesce(arg_max(entry_id, (seq_no, lv, entry_id)) filter (where {}), 0)"

ORACLE = {
    "p3_found": f"""with {_LEVELS} select store_id, key, arg_max(entry_id, (seq_no, lv, entry_id)) as entry_id,
      {_FIRST.format("value is not null or tombstone")} as value_entry_id,
      {_FIRST.format(_label("value_type"))} as value_type_entry_id, {_FIRST.format(_label("writer"))} as writer_entry_id
      from e group by store_id, key having count(*) > 1""",
    "p3_records": f"""with {_LEVELS}, t as (select store_id, key, entry_id, value, tombstone, writer,
        case when {_label("value_type")} then lower(trim(value_type)) end as value_type, value is not null or coalesce(tombstone, false) as hv, {_label("writer")} as hw,
        row_number() over (partition by store_id, key order by seq_no desc nulls last, lv desc, entry_id desc) as pos
        from e where store_id is not null and key is not null),
      g as (select store_id, key, arg_min(entry_id, pos) as entry_id, coalesce(arg_min(entry_id, pos) filter (where hw), 0) as writer_entry_id,
        arg_min(writer, pos) filter (where hw) as writer from t group by store_id, key),
      v as (select *, row_number() over (partition by store_id, key order by pos) as rank from (select store_id, key, value, tombstone,
        arg_min(entry_id, pos) as id, min(pos) as pos from t where hv group by store_id, key, value, tombstone)),
      y as (select *, row_number() over (partition by store_id, key order by pos) as rank from (select store_id, key, value_type,
        arg_min(entry_id, pos) as id, min(pos) as pos from t where value_type is not null group by store_id, key, value_type)),
      p as (select distinct store_id, key, value, value_type from t where value is not null and value_type is not null),
      c as (select v.store_id, v.key, v.rank as a, y.rank as b from v join y on v.store_id = y.store_id and v.key = y.key
          left join p on p.store_id = v.store_id and p.key = v.key and p.value = v.value and p.value_type = y.value_type
          where v.value is null or p.value is not null
        union all select store_id, key, rank, null from v union all select store_id, key, null, rank from y),
      d as (select *, row_number() over (partition by store_id, key order by coalesce({_UNIT} // a, 0) + coalesce({_UNIT} // b, 0) desc, a nulls last, b nulls last) as r from c)
      select g.store_id, g.key, g.entry_id, coalesce(v.id, 0) as value_entry_id, coalesce(y.id, 0) as value_type_entry_id, g.writer_entry_id,
        v.value, v.tombstone, y.value_type, g.writer
      from g left join d on d.store_id = g.store_id and d.key = g.key and d.r = 1
      left join v on v.store_id = g.store_id and v.key = g.key and v.rank = d.a left join y on y.store_id = g.store_id and y.key = g.key and y.rank = d.b""",
    "p4_found": """select probe_id from probe_keys p where key is not null and (
      exists (select 1 from mutation_log m where m.store_id = p.store_id and m.key = p.key)
      or exists (select 1 from probe_keys q where q.store_id = p.store_id and q.key = p.key and q.probe_id < p.probe_id))""",
    "p4_error_rate": """select count(*) as answers, count(*) filter (where
      exists (select 1 from mutation_log m where m.store_id = p.store_id and m.key = p.key)
      or exists (select 1 from probe_keys q where q.store_id = p.store_id and q.key = p.key and q.probe_id < p.probe_id)) as met,
      cast(0 as bigint) as wrong from probe_keys p where key is not null""",
}
