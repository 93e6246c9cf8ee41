"""Queries of the engine's own operators, over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access, canonical, classify, decay, render
from ..functions.instants import BLANKS
from ..functions.jsonschema import schema_errors
from ..operators import bundles, citations, conflicts, hygiene, integrity, migrate, reducer, rules, temporal
from ..plans import compiler
from ..session import prepare
from ..streaming import sessions
from .. import schemas

NOW = "2025-01-01T00:00:00Z"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def _now():
    return F.lit(NOW).cast("timestamp")


# Bundles made from orders: B lacks every 13th record of A, changes every 10th and adds every 17th under a new id.
def _records(spark: SparkSession, sf: str, copy: int) -> DataFrame:
    k = F.col("o_orderkey")
    rows = _table(spark, sf, "orders")
    shape = lambda key, value: canonical.canonical_struct(id=key, schema_version=F.lit("1.0.0"), value=value, note=F.col("o_orderpriority"))
    old = F.concat(F.lit("rec_"), k.cast("string"))
    if not copy:
        return rows.select(F.lit(0).alias("bundle_ix"), k.alias("pos"), old.alias("id"), shape(old, F.col("o_custkey")).alias("doc"))
    new = F.concat(F.lit("rec_x"), k.cast("string"))
    kept = rows.where(k % 13 != 0).select(F.lit(1).alias("bundle_ix"), k.alias("pos"), old.alias("id"), shape(old, F.col("o_custkey") + F.when(k % 10 == 0, 1).otherwise(0)).alias("doc"))
    return kept.unionByName(rows.where(k % 17 == 0).select(F.lit(1).alias("bundle_ix"), k.alias("pos"), new.alias("id"), shape(new, F.col("o_custkey")).alias("doc")))


_BUNDLES = """
with raw as (
  select 0 b, o_orderkey pos, 'rec_' || o_orderkey id, o_custkey v, o_orderpriority n from orders
  union all select 1, o_orderkey, 'rec_' || o_orderkey, o_custkey + case when o_orderkey % 10 = 0 then 1 else 0 end, o_orderpriority from orders where o_orderkey % 13 <> 0
  union all select 1, o_orderkey, 'rec_x' || o_orderkey, o_custkey, o_orderpriority from orders where o_orderkey % 17 = 0
), bundle as (
  select b, id, arg_max('{"id":' || to_json(id) || ',"note":' || to_json(n) || ',"schema_version":"1.0.0","value":' || v || '}', pos) doc from raw group by b, id
), a as (select * from bundle where b = 0), c as (select * from bundle where b = 1)
"""


@query(_BUNDLES + "select sha256(coalesce(string_agg(doc, chr(10) order by id), '')) fingerprint from a")
def bundle_fingerprint(spark, sf):
    return spark.range(1).select(F.lit(bundles.fingerprint(_records(spark, sf, 0))).alias("fingerprint"))


@query(_BUNDLES + ", h as (select sha256(id || chr(0) || doc) h from a), parts as (select count(*) n, "
       + ", ".join(f"coalesce(sum(cast('0x' || substr(h, {1 + 12 * i}, 12) as bigint)), 0) p{i}" for i in range(5)) + " from h) select n records, sha256(concat_ws('.', n, p0, p1, p2, p3, p4)) fingerprint from parts")
def bundle_tree_fingerprint(spark, sf):
    return bundles.tree_fingerprint(_records(spark, sf, 0))


@query(_BUNDLES + "select coalesce(a.id, c.id) id, case when a.id is null then 'added' when c.id is null then 'removed' when a.doc = c.doc then 'unchanged' else 'changed' end status, a.doc old_doc, c.doc new_doc from a full join c on a.id = c.id")
def bundle_diff(spark, sf):
    return bundles.diff(_records(spark, sf, 0), _records(spark, sf, 1))


@query(_BUNDLES + "select case when a.id is null then 'added' when c.id is null then 'removed' when a.doc = c.doc then 'unchanged' else 'changed' end status, count(*) records from a full join c on a.id = c.id group by 1")
def bundle_diff_summary(spark, sf):
    return bundles.diff_summary(bundle_diff(spark, sf))


def _both(spark, sf):
    return _records(spark, sf, 0).unionByName(_records(spark, sf, 1))


@query(_BUNDLES + "select id, arg_max(doc, b) doc from bundle group by id")
def merge_last(spark, sf):
    return bundles.merge(_both(spark, sf)).records


@query(_BUNDLES + "select id, arg_min(doc, b) doc from bundle group by id")
def merge_first(spark, sf):
    return bundles.merge(_both(spark, sf), prefer="first").records


@query(_BUNDLES + "select id, string_agg(b || ':' || doc, ' ' order by b) variants from bundle group by id having count(distinct doc) > 1")
def merge_conflicts(spark, sf):
    found = bundles.merge(_both(spark, sf)).conflicts
    return found.select("id", F.array_join(F.transform("variants", lambda v: F.concat(v["bundle_ix"].cast("string"), F.lit(":"), v["doc"])), " ").alias("variants"))


def _lines(spark, sf):
    """Line items as one bundle in which orders are the ids, so that most ids repeat."""
    pos = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    doc = canonical.canonical_struct(id=F.col("l_orderkey").cast("string"), part=F.col("l_partkey"), line=F.col("l_linenumber"))
    return _table(spark, sf, "lineitem").select((F.col("l_orderkey") % 2).cast("int").alias("bundle_ix"), pos.alias("pos"), F.col("l_orderkey").cast("string").alias("id"), doc.alias("doc"))


_LINES = """with line as (select l_orderkey % 2 b, l_orderkey * 100 + l_linenumber pos, cast(l_orderkey as varchar) id,
  '{"id":"' || l_orderkey || '","line":' || l_linenumber || ',"part":' || l_partkey || '}' doc from lineitem) """


@query(_LINES + "select id, arg_max(doc, (pos, doc)) doc from line group by id")
def dedup_last(spark, sf):
    ordered = _lines(spark, sf).withColumn("pos", F.struct("pos", "doc"))
    return bundles.dedup_last(ordered)


@query(_LINES + "select id, arg_min(doc, (pos, doc)) doc from line group by id")
def dedup_first(spark, sf):
    return bundles.dedup_first(_lines(spark, sf).withColumn("pos", F.struct("pos", "doc"))).select("id", "doc")


@query(_LINES + ", seen as (select b, id, pos, row_number() over (partition by b, id order by pos) n, min(pos) over (partition by b, id) first_pos from line) select id, cast(b as int) bundle_ix, min(pos) pos from seen where pos > first_pos group by id, b")
def merge_duplicate_ids(spark, sf):
    return bundles.merge(_lines(spark, sf)).duplicate_ids


@query(_BUNDLES + "select id, doc from a where id in (select id from c)")
def bundle_intersect(spark, sf):
    return bundles.intersect(_records(spark, sf, 0), _records(spark, sf, 1))


@query(_BUNDLES + "select id, doc from a where id not in (select id from c)")
def bundle_subtract(spark, sf):
    return bundles.subtract(_records(spark, sf, 0), _records(spark, sf, 1))


_WHOLE = """with last as (select bundle_ix, id, arg_max(doc, pos) doc from bundle_record group by all),
leaf as (select l.bundle_ix, l.id, t.fullkey, case when t.type in ('BIGINT', 'UBIGINT', 'HUGEINT') then 'integer' else t.type end kind, case when t.type in ('OBJECT', 'ARRAY') then '' when t.type = 'DOUBLE' then cast(cast(t.atom as double) as varchar) else coalesce(t.atom ->> '$', '') end v from last l, json_tree(l.doc) t),
whole as (select bundle_ix, id, string_agg(fullkey || '|' || kind || '|' || v, chr(10) order by fullkey) w from leaf group by all), a as (select * from whole where bundle_ix = 0), c as (select * from whole where bundle_ix = 1) """


@query(_WHOLE + "select coalesce(a.id, c.id) id, case when a.id is null then 'added' when c.id is null then 'removed' when a.w = c.w then 'unchanged' else 'changed' end status from a full join c on a.id = c.id")
def bundle_record_diff(spark, sf):
    """The two copies of the ledger, compared as canonical text."""
    rows = _table(spark, sf, "bundle_record")
    copies = [bundles.envelope(rows.where(F.col("bundle_ix") == i), doc="doc", position="pos", bundle_ix=i) for i in (0, 1)]
    return bundles.diff(*copies).select("id", "status")


_FIELDS = ("status", "confidence", "scope", "statement", "owner", "valid_from")


def _conflicts(spark, sf):
    variants = _table(spark, sf, "conflict_variant").where("conflict_id is not null").select("conflict_id", "variant_ix", "record_id", *_FIELDS).distinct()
    doc = F.to_json(F.struct("conflict_id", F.col("record_id").alias("id"), *_FIELDS))
    return variants.groupBy(F.col("conflict_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("variant_ix").alias("bundle_ix"), doc.alias("doc")))).alias("variants"))


_VARIANTS = "with v as (select distinct conflict_id, variant_ix, record_id, status, confidence, scope, statement, owner, valid_from from conflict_variant where conflict_id is not null) "


@query(_VARIANTS + "select conflict_id, arg_min(record_id, variant_ix) chosen_id, list_sort(array_agg(record_id) filter (variant_ix <> (select min(w.variant_ix) from v w where w.conflict_id = v.conflict_id))) rejected from v group by conflict_id".replace("list_sort(", "coalesce(array_to_string(list_sort(").replace(")) rejected", ")), ','), '') rejected"))
def conflict_pick_one(spark, sf):
    done = conflicts.resolve(_conflicts(spark, sf), choice=F.lit("0"), resolved_by=F.lit("engine"), rationale=F.lit("the first variant is kept"), resolved_at=F.lit(NOW))
    return done.select("conflict_id", F.get_json_object("chosen_record", "$.id").alias("chosen_id"), F.array_join(F.array_sort("rejected_record_ids"), ",").alias("rejected"))


@query(_VARIANTS + "select conflict_id, " + ", ".join(f"arg_max({f}, variant_ix) filter ({f} is not null) {f}" for f in _FIELDS) + " from v group by conflict_id")
def conflict_merge_fields(spark, sf):
    done = conflicts.resolve(_conflicts(spark, sf), choice=F.lit("merge"), resolved_by=F.lit("engine"), rationale=F.lit("the last value of each field"), resolved_at=F.lit(NOW))
    return done.select("conflict_id", *[F.get_json_object("chosen_record", f"$.{f}").alias(f) for f in _FIELDS])


def _resolutions(spark, sf):
    return _table(spark, sf, "conflict_resolution").select("id", "conflict_id", "chosen_record", "rejected_record_ids").distinct()


@query("""with r as (select distinct id, conflict_id, chosen_record, rejected_record_ids from conflict_resolution),
x as (select id by_id, unnest(rejected_record_ids) record_id from r), f as (select record_id, min(by_id) by_id, count(distinct by_id) n from x group by record_id)
select v.record_id id, f.by_id superseded_by_conflict_resolution, coalesce(f.n, 0) rejections, '' resolved_id from (select distinct record_id from conflict_variant where record_id is not null) v left join f using (record_id)
union all select coalesce(chosen_record ->> '$.id', conflict_id), null, 0, id from r where chosen_record is not null""")
def apply_resolutions(spark, sf):
    none = F.lit(None).cast("array<string>")
    ids = _table(spark, sf, "conflict_variant").where("record_id is not null").select("record_id").distinct()
    bundle = ids.select(F.col("record_id").alias("id"), F.lit("{}").alias("doc"), none.alias("superseded_by"), none.alias("resolved_conflict_ids"), F.lit(None).cast("string").alias("superseded_by_conflict_resolution"), F.lit(None).cast("string").alias("superseded_at"))
    done = conflicts.apply(bundle, _resolutions(spark, sf), now=F.lit(NOW))
    return done.select("id", "superseded_by_conflict_resolution", F.coalesce(F.array_size("superseded_by"), F.lit(0)).cast("bigint").alias("rejections"), F.coalesce(F.get("resolved_conflict_ids", F.lit(0)), F.lit("")).alias("resolved_id"))


@query("""with r as (select distinct id, conflict_id, chosen_record, rejected_record_ids from conflict_resolution), d as (select conflict_id, min(id) f from r group by conflict_id having count(*) > 1),
k as (select distinct record_id from conflict_variant), m as (select distinct id from (select id, unnest(list_append(coalesce(rejected_record_ids, []), conflict_id)) x from r) where x in (select record_id from k))
select r.id resolution_id, r.conflict_id, 'duplicate_conflict_id' problem from r join d using (conflict_id) where r.id <> d.f
union all select id, conflict_id, 'no_matching_record' from r where id not in (select id from m)""")
def resolution_violations(spark, sf):
    return conflicts.violations(_table(spark, sf, "conflict_variant").select(F.col("record_id").alias("id")), _resolutions(spark, sf))


@query("""select distinct id, 'span_' || substr(sha256('{"locator_kind":' || coalesce(to_json(locator.kind), 'null') || ',"locator_value":' || coalesce(to_json(locator.value), 'null') || ',"source_id":' || coalesce(to_json(source_id), 'null') || '}'), 1, 24) content_id from evidence_span""")
def content_ids(spark, sf):
    rows = _table(spark, sf, "evidence_span")
    return rows.select("id", canonical.span_id(F.col("source_id"), F.col("locator")).alias("content_id")).distinct()


_ALL_IDS = "(select id from source_record union all select id from evidence_span union all select id from candidate union all select id from ledger_entry union all select id from memory_reducer_decision union all select id from context_pack union all select id from conflict_resolution)"


@query(f"""select case when starts_with(id, 'src_') or starts_with(id, 'span_') then 'evidence' when starts_with(id, 'cand_') then 'candidate' when starts_with(id, 'fact_') or starts_with(id, 'pref_') or starts_with(id, 'dec_') then 'ledger'
when starts_with(id, 'ctx_') then 'contextpack' when starts_with(id, 'redmem_') then 'reducer_decision' when starts_with(id, 'confres_') then 'audit' else 'other' end plane, count(*) records from {_ALL_IDS} where id is not null group by 1""")
def classify_plane(spark, sf):
    out = None
    for name in ("source_record", "evidence_span", "candidate", "ledger_entry", "memory_reducer_decision", "context_pack", "conflict_resolution"):
        ids = _table(spark, sf, name).select("id")
        out = ids if out is None else out.unionByName(ids)
    return out.where("id is not null").groupBy(classify.plane_of_id(F.col("id")).alias("plane")).agg(F.count("*").alias("records"))


@query("""select bundle_ix, case when list_contains(keys, 'ledger_type') then (doc ->> '$.ledger_type') || '_ledger_entry' else 'unknown' end record_type,
case when list_contains(keys, 'span_hash_sha256') then 'evidence' when list_contains(keys, 'evidence_span_ids') then 'claim' end citation_kind, count(*) records from bundle_record group by all""")
def classify_shape(spark, sf):
    rows = _table(spark, sf, "bundle_record")
    keys, kind = F.col("keys"), F.get_json_object("doc", "$.ledger_type")
    return rows.groupBy("bundle_ix", classify.record_type(keys, F.get_json_object("doc", "$.candidate_type"), kind).alias("record_type"), classify.citation_kind(keys).alias("citation_kind")).agg(F.count("*").alias("records"))


@query("""select bundle_ix, case when list_contains(keys, 'ledger_type') then coalesce(doc ->> '$.ledger_type', 'ledger_entry') else 'claim' end claim_type,
case when coalesce(doc ->> '$.ledger_type', '') <> '' then (doc ->> '$.ledger_type') || '_ledger_entry' else 'unknown' end compiler_type, count(*) records from bundle_record group by all""")
def classify_values(spark, sf):
    rows = _table(spark, sf, "bundle_record")
    values = {f: F.get_json_object("doc", f"$.{f}") for f in ("source_type", "episode_type", "span_hash_sha256", "candidate_type", "ledger_type", "card_type", "pack_type", "decision_type")}
    return rows.groupBy("bundle_ix", classify.claim_type(F.col("keys"), values["candidate_type"], values["ledger_type"]).alias("claim_type"), classify.compiler_type(values).alias("compiler_type")).agg(F.count("*").alias("records"))


def _decisions(spark, sf):
    spans = _table(spark, sf, "evidence_span").select("id", "privacy_class")
    return access.decide(spans, access.team_scope(), privacy_class=F.col("privacy_class"), record_type=F.lit("evidence_span"))


_CLASS = "coalesce(nullif(privacy_class, ''), 'internal')"
_ACCESS = f"with d as (select id, {_CLASS} c, list_position(['public', 'internal', 'private', 'sensitive', 'highly_sensitive'], {_CLASS}) l from evidence_span) "


@query(_ACCESS + "select id, case when l between 1 and 2 then 'allow' else 'drop' end as action, case when l is null or l = 0 then 'unknown privacy_class=' || c when l > 2 then 'privacy_class=' || c || ' > max=internal' else 'privacy_class=' || c || ' <= max=internal' end reason from d")
def access_decisions(spark, sf):
    return _decisions(spark, sf).select("id", "action", "reason")


@query(_ACCESS + "select case when l between 1 and 2 then 'allow' else 'drop' end as action, case when l > 0 then c end privacy_class, count(*) records from d group by all")
def access_summary(spark, sf):
    return access.summary(_decisions(spark, sf))


@query(_ACCESS + "select id from d where l between 1 and 2")
def scope_team(spark, sf):
    return access.scoped(_table(spark, sf, "evidence_span"), access.team_scope(), privacy_class=F.col("privacy_class"), record_type=F.lit("evidence_span")).select("id")


_T = f"timestamptz '{NOW}'"
_ACTIVE = f"status = 'active' and coalesce(len(superseded_by), 0) = 0 and coalesce(cast(valid_from as timestamptz) <= {_T}, true) and coalesce({_T} < cast(valid_until as timestamptz), true) and coalesce({_T} < cast(stale_after as timestamptz), true)"


@query(f"select distinct id from ledger_entry where {_ACTIVE}")
def active_at(spark, sf):
    return temporal.current(_table(spark, sf, "ledger_entry"), _now()).select("id").distinct()


@query(f"select distinct id from ledger_entry where coalesce(status, '') not in ('retracted', 'archived') and coalesce(cast(valid_from as timestamptz) <= {_T}, true) and coalesce({_T} < cast(valid_until as timestamptz), true)")
def as_of(spark, sf):
    return temporal.as_of(_table(spark, sf, "ledger_entry"), _now()).select("id").distinct()


@query(f"select subject, count(distinct id) entries from ledger_entry where {_ACTIVE} group by subject")
def current_by_key(spark, sf):
    return temporal.current(_table(spark, sf, "ledger_entry"), _now()).groupBy("subject").agg(F.count_distinct("id").alias("entries"))


@query("""with recursive step as (select id, max(superseded_by[1]) nxt from ledger_entry where id is not null group by id),
walk as (select id, id last_id, cast(0 as bigint) steps, 'go' state, [id] seen from step
  union all
  select w.id, s.nxt, w.steps + 1, case when list_contains(w.seen, s.nxt) then 'cycle' when s.nxt not in (select id from step) then 'dangling' else 'go' end, list_append(w.seen, s.nxt)
  from walk w join step s on s.id = w.last_id where w.state = 'go' and s.nxt is not null),
ended as (select w.id, w.last_id, w.steps, case when w.state = 'go' then 'current' else w.state end ends from walk w left join step s on s.id = w.last_id where w.state <> 'go' or s.nxt is null)
select id, case when ends <> 'cycle' then last_id end last_id, case when ends <> 'cycle' then steps end steps, ends from ended""")
def supersession_chain(spark, sf):
    return temporal.supersession_chains(_table(spark, sf, "ledger_entry").select("id", "superseded_by"))


@query("""with p as (select distinct subject, id, coalesce(epoch_us(cast(valid_from as timestamptz)), -9223372036854775808) b, coalesce(least(epoch_us(cast(valid_until as timestamptz)), epoch_us(cast(stale_after as timestamptz))), 9223372036854775807) e from ledger_entry where subject is not null),
o as (select *, max({'ends': e, 'id': id}) over (partition by subject order by b, e, id rows between unbounded preceding and 1 preceding) m from p where b < e)
select subject, id, m.id overlaps_id from o where m.ends > b""")
def interval_overlap(spark, sf):
    rows = _table(spark, sf, "ledger_entry").select("subject", "id", "valid_from", "valid_until", "stale_after").distinct()
    return temporal.overlaps(rows, group="subject")


def _decayed(spark, sf, curve):
    rows = _table(spark, sf, "ledger_entry")
    score = decay.decay_score(F.col("asserted_at"), _now(), F.col("supersedes"), F.col("evidence_span_ids"), decay.DecayPolicy(curve=curve))
    return rows.select("id", F.round(score["score"], 9).alias("score"), F.round(score["time"], 9).alias("time"), F.round(score["event"], 9).alias("event")).distinct()


def _decay_sql(curve: str) -> str:
    return f"""with a as (select id, (epoch_us({_T}) - epoch_us(cast(asserted_at as timestamptz))) / 1e6 age, coalesce(len(supersedes), 0) s, coalesce(len(evidence_span_ids), 0) e from ledger_entry),
p as (select id, coalesce(age >= 0, false) known, {curve} t, pow(0.5, s) * pow(0.9, e) v from a)
select distinct id, case when known then round(greatest(0.0, least(1.0, t, v)), 9) else 1.0 end score, case when known then round(t, 9) else 1.0 end "time", case when known then round(v, 9) else 0.0 end event from p"""


@query(_decay_sql("pow(0.5, age / 7776000.0)"))
def decay_exponential(spark, sf):
    return _decayed(spark, sf, "exponential")


@query(_decay_sql("greatest(0.0, 1 - age / 15552000.0)"))
def decay_linear(spark, sf):
    return _decayed(spark, sf, "linear")


@query(f"""select count(*) records, count(*) filter (coalesce(cast(valid_from as timestamptz) <= {_T}, true) and coalesce({_T} <= cast(valid_until as timestamptz), true)) active, count(*) filter ({_T} > cast(stale_after as timestamptz)) stale,
count(*) filter ({_T} > cast(valid_until as timestamptz)) expired, count(*) filter (coalesce(len(superseded_by), 0) > 0) superseded from ledger_entry""")
def hygiene_counts(spark, sf):
    return hygiene.temporal_counts(_table(spark, sf, "ledger_entry"), _now())


@query("""select 'plane' dimension, case when starts_with(id, 'fact_') or starts_with(id, 'pref_') or starts_with(id, 'dec_') then 'ledger' else 'other' end "value", count(*) records from ledger_entry group by 2
union all select 'type', ledger_type, count(*) from ledger_entry where coalesce(ledger_type, '') <> '' group by 2 union all select 'privacy', 'unspecified', count(*) from ledger_entry""")
def hygiene_by(spark, sf):
    return hygiene.counts_by(_table(spark, sf, "ledger_entry"))


@query("""select (select count(*) from ledger_entry where coalesce(len(evidence_span_ids), 0) = 0) missing,
(select count(*) from ledger_entry e where exists (select 1 from (select unnest(e.evidence_span_ids) r) where r not in (select id from evidence_span where id is not null))) orphaned""")
def hygiene_gaps(spark, sf):
    return hygiene.evidence_gaps(_table(spark, sf, "ledger_entry"), _table(spark, sf, "evidence_span"))


@query("""with t as (select cast(x as timestamptz) t from (select unnest([asserted_at, valid_from, valid_until, updated_at]) x from ledger_entry) where x is not null)
select strftime(timezone('UTC', min(t)), '%Y-%m-%dT%H:%M:%SZ') window_start, strftime(timezone('UTC', max(t)), '%Y-%m-%dT%H:%M:%SZ') window_end from t""")
def hygiene_window(spark, sf):
    return hygiene.window(_table(spark, sf, "ledger_entry").select("asserted_at", "valid_from", "valid_until", "updated_at"))


def _graph(spark, sf):
    sources = _table(spark, sf, "source_record").select("id", F.lit("source_record").alias("record_type"))
    spans = _table(spark, sf, "evidence_span").select("id", F.lit("evidence_span").alias("record_type"), "source_id")
    entries = _table(spark, sf, "ledger_entry").select("id", F.concat("ledger_type", F.lit("_ledger_entry")).alias("record_type"), F.col("evidence_span_ids").alias("evidence_ids"))
    candidates = _table(spark, sf, "candidate").select("id", F.concat(F.lit("candidate_"), "candidate_type").alias("record_type"), F.col("evidence_span_ids").alias("evidence_ids"))
    return citations.graph(sources, spans, entries.unionByName(candidates))


_GRAPH = """with node as (select distinct id, 'source' kind from source_record union select id, 'evidence' from evidence_span union select id, 'claim' from ledger_entry union select id, 'claim' from candidate),
ref as (select id from_id, source_id to_id, 'derives_from' relation from evidence_span where source_id is not null
  union select id, unnest(evidence_span_ids), 'cites' from ledger_entry union select id, unnest(evidence_span_ids), 'cites' from candidate),
refs as (select * from ref where to_id is not null and from_id is not null), edge as (select * from refs where to_id in (select id from node)),
supp as (select distinct c.from_id id from edge c join edge d on d.from_id = c.to_id and d.relation = 'derives_from' where c.relation = 'cites') """


@query(_GRAPH + "select from_id, to_id, relation from edge")
def citation_edges(spark, sf):
    return _graph(spark, sf).edges.select("from_id", "to_id", "relation")


@query(_GRAPH + "select from_id, to_id, relation from refs where to_id not in (select id from node)")
def citation_dangling(spark, sf):
    return _graph(spark, sf).dangling.select("from_id", "to_id", "relation")


@query(_GRAPH + "select kind, count(*) nodes from node where id is not null group by kind")
def citation_node_counts(spark, sf):
    return citations.node_counts(_graph(spark, sf))


@query(_GRAPH + "select to_id id, count(*) in_degree from edge group by to_id")
def citation_indegree(spark, sf):
    return citations.in_degree(_graph(spark, sf))


@query(_GRAPH + "select id from node where kind = 'claim' and id not in (select id from supp)")
def citation_unsupported(spark, sf):
    return citations.unsupported_claims(_graph(spark, sf))


@query(_GRAPH + "select id from node where kind = 'source' and id not in (select to_id from edge)")
def citation_unused(spark, sf):
    return citations.unused_sources(_graph(spark, sf))


@query(_GRAPH + """select c.from_id start_id, c.from_id || ' > ' || c.to_id || coalesce(' > ' || d.to_id, '') path, case when d.to_id is null then 'evidence' else 'source' end end_kind
from edge c left join edge d on d.from_id = c.to_id where c.relation = 'cites' union all select id, id, 'claim' from node where kind = 'claim' and id not in (select from_id from edge)""")
def citation_paths(spark, sf):
    g = citations.held(_graph(spark, sf))
    return citations.paths(g, g.nodes.where("kind = 'claim'")).select("start_id", F.array_join("path", " > ").alias("path"), "end_kind")


@query(_GRAPH + """, hop as (select c.from_id source_id, d.to_id target_id, c.from_id || ' > ' || c.to_id || ' > ' || d.to_id path from edge c join edge d on d.from_id = c.to_id where c.relation = 'cites')
select source_id, target_id, min(path) path from hop group by all""")
def shortest_path(spark, sf):
    """From every claim to every source that its spans lead to."""
    g = citations.held(_graph(spark, sf))
    cites, derives = (g.edges.where(F.col("relation") == r) for r in ("cites", "derives_from"))
    ends = cites.select(F.col("from_id").alias("source_id"), F.col("to_id").alias("span")).join(derives.select(F.col("from_id").alias("span"), F.col("to_id").alias("target_id")), "span")
    return citations.shortest_paths(g, ends).select("source_id", "target_id", F.array_join("path", " > ").alias("path"))


@query(_GRAPH + "select id from node where false")
def citation_cycles(spark, sf):
    return citations.cycles(citations.held(_graph(spark, sf)))


def _planted(spark, sf):
    """The graph with faults: spans whose hash begins with 1 are gone, and those whose hash begins with 2 derive from the least claim that cites them."""
    g = _graph(spark, sf)
    spans = _table(spark, sf, "evidence_span")
    citing = g.edges.where("relation = 'cites'").groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("claim"))
    first = F.substring("span_hash_sha256", 1, 1)
    kept = spans.where(~F.coalesce(first == "1", F.lit(False))).join(citing, "id", "left").select("id", F.lit("evidence_span").alias("record_type"), F.when((first == "2") & F.col("claim").isNotNull(), F.col("claim")).otherwise(F.col("source_id")).alias("source_id"))
    claims = g.nodes.where("kind = 'claim'").select("id", "record_type")
    cited = g.edges.where("relation = 'cites'").groupBy(F.col("from_id").alias("id")).agg(F.collect_set("to_id").alias("evidence_ids"))
    return citations.graph(g.nodes.where("kind = 'source'").select("id", "record_type"), kept, claims.join(cited, "id", "left"))


_PLANTED = _GRAPH + """, citing as (select to_id id, min(from_id) claim from edge where relation = 'cites' group by to_id),
span as (select s.id, case when substr(s.span_hash_sha256, 1, 1) = '2' and c.claim is not null then c.claim else s.source_id end source_id from evidence_span s left join citing c on c.id = s.id where not coalesce(substr(s.span_hash_sha256, 1, 1) = '1', false)),
pnode as (select id from node where kind <> 'evidence' union select id from span), pref as (select id from_id, source_id to_id, 'derives_from' relation from span where source_id is not null union select from_id, to_id, relation from edge where relation = 'cites'),
pedge as (select * from pref where to_id in (select id from pnode)) """


@query(_PLANTED + "select from_id, to_id, relation from pref where to_id not in (select id from pnode)")
def citation_dangling_faults(spark, sf):
    return _planted(spark, sf).dangling.select("from_id", "to_id", "relation")


@query("with recursive " + _PLANTED.removeprefix("with ") + """, walk as (select from_id a, to_id b, 1 n from pedge union select w.a, e.to_id, 0 from walk w join pedge e on e.from_id = w.b), loop as (select distinct a id from walk where a = b)
select id from loop union select w.b from walk w where w.a in (select id from loop) and exists (select 1 from walk v where v.a = w.b and v.b in (select id from loop))""")
def citation_cycle_faults(spark, sf):
    return citations.cycles(_planted(spark, sf))


_FAULTY_SPANS = """(select case when h = '0' then replace(id, 'span_', 'spin_') else id end id, case when h = '1' then replace(source_id, 'src_', 'doc_') else source_id end source_id, case when h = '2' then null else locator end locator, case when h = '3' then 'odd' when h = '4' then 'none' else excerpt_policy end excerpt_policy, text_excerpt,
case when h = '5' then upper(span_hash_sha256) else span_hash_sha256 end span_hash_sha256, case when h = '6' then 'secret' else privacy_class end privacy_class from (select *, coalesce(substr(span_hash_sha256, 2, 1), '') h from evidence_span))"""


@query("""with b as (select id, unnest([case when not coalesce(regexp_matches(id, '^span_[0-9a-f]{16,}$'), false) then 'id has its prefix' end, case when not coalesce(starts_with(source_id, 'src_'), false) then 'source_id has its prefix' end,
case when coalesce(locator.kind, '') = '' or coalesce(locator.value, '') = '' then 'locator is complete' end, case when not coalesce(excerpt_policy in ('none', 'synthetic', 'redacted', 'short_quote_allowed'), false) then 'excerpt_policy is known' end,
case when not coalesce(not (text_excerpt is not null and excerpt_policy = 'none'), false) then 'excerpt follows its policy' end, case when not coalesce(regexp_matches(span_hash_sha256, '^[0-9a-f]{64}$'), false) then 'span_hash_sha256 is a digest' end,
case when not coalesce(privacy_class in ('public', 'internal', 'private', 'sensitive', 'highly_sensitive'), false) then 'privacy_class is known' end]) rule from evidence_span) select rule, id from b where rule is not null""")
def span_rule_violations(spark, sf):
    return rules.violations(_table(spark, sf, "evidence_span"), rules.span_rules()).select("rule", "id")


@query(SQL["span_rule_violations"].replace("from evidence_span)", f"from {_FAULTY_SPANS})"))
def span_rule_faults(spark, sf):
    """The same over spans of which some have a fault each."""
    h = F.coalesce(F.substring("span_hash_sha256", 2, 1), F.lit(""))
    change = lambda digit, name, to: F.when(h == digit, to).otherwise(F.col(name))
    rows = _table(spark, sf, "evidence_span").withColumns({
        "id": change("0", "id", F.replace("id", F.lit("span_"), F.lit("spin_"))), "source_id": change("1", "source_id", F.replace("source_id", F.lit("src_"), F.lit("doc_"))), "locator": change("2", "locator", None),
        "excerpt_policy": F.when(h == "3", "odd").when(h == "4", "none").otherwise(F.col("excerpt_policy")), "span_hash_sha256": change("5", "span_hash_sha256", F.upper("span_hash_sha256")), "privacy_class": change("6", "privacy_class", F.lit("secret")),
    })
    return rules.violations(rows, rules.span_rules()).select("rule", "id")


@query("""with b as (select id, unnest([case when not coalesce(status in ('active', 'stale', 'superseded', 'retracted', 'contested', 'archived'), false) then 'status is known' end, case when not coalesce(confidence in ('low', 'medium', 'high'), false) then 'confidence is known' end,
case when coalesce(len(evidence_span_ids), 0) = 0 then 'evidence is given' end, case when try_cast(valid_from as timestamptz) > try_cast(valid_until as timestamptz) then 'validity is ordered' end, case when try_cast(valid_from as timestamptz) > try_cast(stale_after as timestamptz) then 'staleness is ordered' end,
case when not coalesce(status <> 'superseded' or coalesce(len(superseded_by), 0) > 0, false) then 'superseded names its successor' end, case when not coalesce(status <> 'superseded' or valid_until is not null, false) then 'superseded has an end' end,
case when not coalesce(status <> 'active' or coalesce(len(superseded_by), 0) = 0, false) then 'active has no successor' end]) rule from ledger_entry) select rule, id from b where rule is not null""")
def ledger_rule_violations(spark, sf):
    """All rules of ledger entries; the SQL states eight of them, and the tables break no other."""
    return rules.violations(_table(spark, sf, "ledger_entry"), rules.ledger_rules()).select("rule", "id")


_ORIGIN = """select 'duplicate candidate' rule, id record_id, null ref_id from candidate group by id having count(*) > 1
union all select distinct 'dangling source_record_ids', id, r from (select id, unnest(source_record_ids) r from candidate) where r not in (select id from source_record)
union all select distinct 'dangling evidence_span_ids', id, r from (select id, unnest(evidence_span_ids) r from candidate) where r not in (select id from evidence_span)
union all select distinct 'span source not declared', c.id, c.r from (select id, source_record_ids s, unnest(evidence_span_ids) r from candidate) c join evidence_span e on e.id = c.r where len(c.s) > 0 and e.source_id is not null and not list_contains(c.s, e.source_id)
union all select distinct 'span episode not declared', c.id, c.r from (select id, episode_record_ids s, unnest(evidence_span_ids) r from candidate) c join evidence_span e on e.id = c.r where len(c.s) > 0 and e.episode_id is not null and not list_contains(c.s, e.episode_id)"""


@query(_ORIGIN)
def candidate_integrity(spark, sf):
    return integrity.candidate_bundle(_table(spark, sf, "source_record"), None, _table(spark, sf, "evidence_span"), _table(spark, sf, "candidate"))


def _authorised(decisions: str) -> str:
    return f"""with d as (select distinct id, target_candidate_ids c, target_ledger_entry_ids l, evidence_span_ids e from {decisions}), j as (select x.id, x.reducer_decision_id r, coalesce(x.candidate_ids, []) xc, coalesce(x.evidence_span_ids, []) xe, coalesce(x.metadata ->> '$.human_asserted' = 'true', false) human, d.id did, coalesce(d.c, []) c, coalesce(d.l, []) l, coalesce(d.e, []) e from ledger_entry x left join d on d.id = x.reducer_decision_id)
select distinct 'dangling reducer_decision_id' "rule", id record_id, r ref_id from j where did is null union all select distinct 'entry is no target of its decision', id, r from j where did is not null and not list_contains(l, id)
union all select distinct 'candidates beyond the decision', id, r from j where did is not null and not list_has_all(c, xc) union all select distinct 'evidence beyond the decision', id, r from j where did is not null and not list_has_all(e, xe)
union all select distinct 'neither candidates nor a human stand behind it', id, r from j where len(xc) = 0 and not human"""


@query(_authorised("memory_reducer_decision"))
def reducer_authorisation(spark, sf):
    return integrity.authorisation(_table(spark, sf, "ledger_entry"), _table(spark, sf, "memory_reducer_decision"))


_CUT_DECISIONS = "(select distinct id, case when ends_with(id, '0') then list_filter(target_candidate_ids, lambda x: x > 'cand_claim_8') else target_candidate_ids end target_candidate_ids, case when ends_with(id, '1') then [] else target_ledger_entry_ids end target_ledger_entry_ids, case when ends_with(id, '2') then evidence_span_ids[2:] else evidence_span_ids end evidence_span_ids from memory_reducer_decision where not ends_with(id, '3'))"


@query(_authorised(_CUT_DECISIONS))
def reducer_authorisation_faults(spark, sf):
    """The same where some decisions are gone and others have lost a part of their lists."""
    rows, key = _table(spark, sf, "memory_reducer_decision").where("not endswith(id, '3')"), F.col("id")
    rows = rows.withColumns({
        "target_candidate_ids": F.when(key.endswith("0"), F.filter("target_candidate_ids", lambda x: x > "cand_claim_8")).otherwise(F.col("target_candidate_ids")), "target_ledger_entry_ids": F.when(key.endswith("1"), F.array().cast("array<string>")).otherwise(F.col("target_ledger_entry_ids")),
        "evidence_span_ids": F.when(key.endswith("2"), F.slice("evidence_span_ids", 2, 1000)).otherwise(F.col("evidence_span_ids")),
    })
    return integrity.authorisation(_table(spark, sf, "ledger_entry"), rows)


_LINKS = """with u as (select id, max(valid_from) vf, max(valid_until) vu from ledger_entry group by id), n as (select distinct unnest(supersedes) o, id n from ledger_entry), w as (select distinct id o, unnest(superseded_by) n from ledger_entry),
k as (select coalesce(n.o, w.o) o, coalesce(n.n, w.n) n, n.o is not null by_new, w.o is not null by_old from n full join w on n.o = w.o and n.n = w.n), j as (select k.*, a.id is not null ho, b.id is not null hn, a.vu, b.vf from k left join u a on a.id = k.o left join u b on b.id = k.n where k.o is not null and k.n is not null)
"""


@query(_LINKS + """select 'dangling supersession' rule, o record_id, n ref_id from j where not (ho and hn) union all select 'supersession not reciprocal', o, n from j where ho and hn and not (by_new and by_old)
union all select 'successor without valid_from', o, n from j where ho and hn and by_old and vf is null union all select 'superseded without valid_until', o, n from j where ho and hn and by_old and vu is null
union all select 'superseded ends after successor begins', o, n from j where ho and hn and by_old and cast(vu as timestamptz) > cast(vf as timestamptz)""")
def supersession_reciprocity(spark, sf):
    return integrity.supersession(_table(spark, sf, "ledger_entry"))


def _lost(table: str, field: str, target: str) -> str:
    return f"select distinct 'dangling {field}', id, r from (select id, unnest({field}) r from {table}) where r is not null and r not in (select id from {target} where id is not null)"


_LEDGER_SQL = " union all ".join([
    "select 'duplicate decision' \"rule\", id record_id, null ref_id from memory_reducer_decision group by id having count(*) > 1", "select 'duplicate entry', id, null from ledger_entry group by id having count(*) > 1",
    _lost("memory_reducer_decision", "target_candidate_ids", "candidate"), _lost("memory_reducer_decision", "target_ledger_entry_ids", "ledger_entry"), _lost("ledger_entry", "source_record_ids", "source_record"),
    _lost("ledger_entry", "evidence_span_ids", "evidence_span"), _lost("ledger_entry", "candidate_ids", "candidate"),
    *[f"select distinct 'span {k} not declared', c.id, c.r from (select id, {k}_record_ids s, unnest(evidence_span_ids) r from ledger_entry) c join evidence_span e on e.id = c.r where len(c.s) > 0 and e.{k}_id is not null and not list_contains(c.s, e.{k}_id)" for k in ("source", "episode")],
    f"select * from ({_authorised('memory_reducer_decision')})", f"select * from ({SQL['supersession_reciprocity']})",
])


@query(_LEDGER_SQL)
def ledger_integrity(spark, sf):
    return integrity.ledger_bundle(*[_table(spark, sf, n) for n in ("source_record", "evidence_span", "candidate", "memory_reducer_decision", "ledger_entry")])


def _packs(spark, sf):
    lists = [F.coalesce(F.col(f"trusted_memory.{k}"), F.array().cast("array<string>")) for k in ("fact_ids", "preference_ids", "decision_ids")]
    return _table(spark, sf, "context_pack").select("id", "created_at", F.concat(*lists).alias("entry_ids"))


@query("""with c as (select distinct id, created_at, unnest(list_concat(coalesce(trusted_memory.fact_ids, []), coalesce(trusted_memory.preference_ids, []), coalesce(trusted_memory.decision_ids, []))) r from context_pack),
e as (select * from ledger_entry qualify row_number() over (partition by id order by updated_at desc nulls last, status desc nulls last, superseded_by desc nulls last, valid_from desc nulls last, valid_until desc nulls last, stale_after desc nulls last) = 1)
select 'dangling pack entry' rule, c.id record_id, c.r ref_id from c where c.r not in (select id from e) union all
select 'entry not active at created_at', c.id, c.r from c join e on e.id = c.r where not coalesce(e.status = 'active' and coalesce(len(e.superseded_by), 0) = 0 and coalesce(cast(e.valid_from as timestamptz) <= cast(c.created_at as timestamptz), true) and coalesce(cast(c.created_at as timestamptz) < cast(e.valid_until as timestamptz), true) and coalesce(cast(c.created_at as timestamptz) < cast(e.stale_after as timestamptz), true), false)""")
def pack_integrity(spark, sf):
    return integrity.pack_bundle(_packs(spark, sf), _table(spark, sf, "ledger_entry"))


def _judged(spark, sf):
    return reducer.judge(_table(spark, sf, "candidate"), _table(spark, sf, "evidence_span"), now=_now())


_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?\s?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"
_JUDGED = f"""with t as (select *, upper(trim(extracted_at, '{BLANKS}')) x from candidate),
s as (select *, case when regexp_matches(x, '{_ISO}') then try_cast(x as timestamptz) end seen from t),
c as (select * from s qualify row_number() over (partition by id order by seen desc nulls last, extracted_at desc nulls last, evidence_span_ids desc nulls last, confidence desc nulls last) = 1),
k as (select c.*, (select arg_min(r, i) from (select unnest(c.evidence_span_ids) r, generate_subscripts(c.evidence_span_ids, 1) i) where r not in (select id from evidence_span where id is not null)) lost from c),
j as (select *, case when coalesce(len(evidence_span_ids), 0) = 0 or lost is not null then 'no_evidence' when coalesce(list_position(['low', 'medium', 'high'], confidence), 0) < 2 then 'low_confidence'
  when not coalesce(seen >= {_T} - interval 90 day, false) then 'stale' end reason from k) """


@query(_JUDGED + "select id, reason from j")
def reduce_candidates(spark, sf):
    return _judged(spark, sf).select("id", "reason")


@query(_JUDGED + "select reason, count(*) candidates from j where reason is not null group by reason")
def reduce_rejections(spark, sf):
    return reducer.rejections(_judged(spark, sf))


@query(_JUDGED + """select id candidate_id, reason reason_code, case when coalesce(len(evidence_span_ids), 0) = 0 then 'no evidence is cited' when lost is not null then 'not among the evidence: ' || lost
when reason = 'low_confidence' then 'confidence is ' || coalesce(confidence, 'not given') || ', least is medium' else 'extracted at ' || coalesce(extracted_at, 'no known time') || ', over 90 days ago or unreadable' end message, candidate_type, confidence from j where reason is not null""")
def reduce_rejected(spark, sf):
    return reducer.rejected(_judged(spark, sf))


def _json_sql(**members: str) -> str:
    """Canonical JSON of an object, in SQL, from SQL of its members' JSON texts."""
    return "'{" + " || ',".join(f'"{k}":\' || {v}' for k, v in sorted(members.items())) + " || '}'"


def _quoted(field: str) -> str:
    return f"coalesce(to_json({field}), 'null')"


_SPAN = "('[' || to_json(evidence_span_ids[1]) || ']')"
_CLAIM = _json_sql(evidence_span_ids=_SPAN, ledger_type="'\"fact\"'", predicate=_quoted("predicate"), object=_quoted('"object"'), scope=_quoted("claim_scope"), subject=_quoted("subject"), valid_from=f"'\"{NOW}\"'")
_PREFERENCE = _json_sql(evidence_span_ids=_SPAN, ledger_type="'\"preference\"'", domain="'null'", preference_text="'null'", scope="case when candidate_type = 'taste_signal' then '\"global\"' else 'null' end", subject="case when candidate_type = 'taste_signal' then 'null' else " + _quoted("subject") + " end", valid_from=f"'\"{NOW}\"'")
_PROMOTED = (
    _JUDGED
    + f""", p as (select *, case when candidate_type = 'claim' then 'fact' else 'preference' end kind, case when candidate_type = 'claim'
  then 'fact_' || substr(sha256({_json_sql(ledger_type="'" + '"fact"' + "'", evidence_span_ids=_SPAN, normalized_payload=_CLAIM)}), 1, 24) else 'pref_' || substr(sha256({_json_sql(ledger_type="'" + '"preference"' + "'", evidence_span_ids=_SPAN, normalized_payload=_PREFERENCE)}), 1, 24) end entry_id,
  candidate_type || ' grounded in span ' || evidence_span_ids[1] || case candidate_type when 'claim' then '; scope=' || coalesce(claim_scope, 'None') when 'taste_signal' then '; strength_hint=None' else '; domain=None' end rationale
  from j where reason is null and candidate_type in ('claim', 'preference', 'taste_signal')),
d as (select *, 'redmem_' || substr(sha256({_json_sql(decision_type="'" + '"promote"' + "'", target_candidate_ids="('[' || to_json(id) || ']')", target_ledger_entry_ids="('[' || to_json(entry_id) || ']')", evidence_span_ids=_SPAN, rationale="to_json(rationale)")}), 1, 24) decision_id from p) """
)


@query(_PROMOTED + "select id candidate_id, decision_id, entry_id, kind ledger_type, evidence_span_ids[1] span_id from d")
def reduce_promotions(spark, sf):
    return reducer.promote(_judged(spark, sf), now=_now())


@query(_PROMOTED + f"""select entry_id id, kind ledger_type, 'active' status, confidence, coalesce(source_record_ids[1], '') source_id, id candidate_id, decision_id reducer_decision_id, '{NOW}' valid_from, subject, case when kind = 'fact' then claim_text end fact_text,
case when kind = 'preference' then 'medium' end strength from d""")
def reduce_entries(spark, sf):
    """The ledger entries that promotion makes (the test candidates have no fields of preferences and taste signals)."""
    _, entries = reducer.records(_judged(spark, sf), now=_now())
    return entries.select("id", "ledger_type", "status", "confidence", F.col("source_record_ids")[0].alias("source_id"), F.col("candidate_ids")[0].alias("candidate_id"), "reducer_decision_id", "valid_from", "subject", "fact_text", "strength")


@query(_PROMOTED + f"select decision_id id, id candidate_id, entry_id, rationale, '{NOW}' decided_at, confidence, risk_class from d")
def reduce_decisions(spark, sf):
    decisions, _ = reducer.records(_judged(spark, sf), now=_now())
    return decisions.select("id", F.col("target_candidate_ids")[0].alias("candidate_id"), F.col("target_ledger_entry_ids")[0].alias("entry_id"), "rationale", "decided_at", "confidence", "risk_class")


def _row_rules_sql() -> str:
    """The rules of the catalogue, in SQL, over the columns that the tables have."""
    absent = {"decision_ledger_entry": ("alternatives_considered", "rationale_text")}
    when = lambda f: f"case when regexp_matches(upper({f}), '{_ISO}') then try_cast(upper({f}) as timestamptz) end"
    parts = []
    for kind, table in {**{f"{k}_ledger_entry": f"(select * from ledger_entry where ledger_type = '{k}')" for k in ("fact", "preference", "decision")}, **{n: n for n in ("source_record", "evidence_span", "memory_reducer_decision", "conflict_resolution")}}.items():
        fields = [(f, k, e) for f, k, e in schemas.fields_of(kind) if f not in absent.get(kind, ())]
        checks = {"id has its prefix": f"starts_with(id, '{canonical.PREFIXES[kind]}_')"}
        for field, shape, enum in fields:
            if shape == "s":
                checks[f"{field} is required"] = f"coalesce(trim({field}, ' '), '') <> ''"
            if enum:
                checks[f"{field} is known"] = f"{field} in ({', '.join(repr(x) for x in schemas.ENUMS[enum])})"
            if shape in "sn" and (field.endswith("_at") or field in ("valid_from", "valid_until", "stale_after")):
                checks[f"{field} is a time"] = f"({field} is null or regexp_matches(upper({field}), '{_ISO}'))"
            if shape == "l" and (field in rules._LIST_PREFIXES or field.endswith("span_ids")):
                prefixes = "|".join(rules._LIST_PREFIXES.get(field, ("span_",)))
                checks[f"{field} have their prefix"] = f"coalesce(len(list_filter({field}, lambda x: not coalesce(regexp_matches(x, '^({prefixes})'), false))) = 0, true)"
        names = [f for f, _, _ in fields]
        for later in ("valid_until", "stale_after"):
            if "valid_from" in names and later in names:
                checks[f"{later} is not before valid_from"] = f"coalesce({when('valid_from')} <= {when(later)}, true)"
        broken = ", ".join(f"case when not coalesce({test}, false) then '{rule}' end" for rule, test in checks.items())
        parts.append(f"select '{kind}' record_type, r \"rule\", id from (select id, unnest([{broken}]) r from {table}) where r is not null")
    return " union all ".join(parts)


@query(_row_rules_sql())
def row_rule_violations(spark, sf):
    """What the catalogue demands of every row of the domain tables."""
    entries = _table(spark, sf, "ledger_entry")
    planes = {f"{k}_ledger_entry": entries.where(F.col("ledger_type") == k) for k in ("fact", "preference", "decision")}
    planes |= {n: _table(spark, sf, n) for n in ("source_record", "evidence_span", "memory_reducer_decision", "conflict_resolution")}
    return integrity.row_violations(planes)


_SORTED = {f: f"coalesce(to_json(list_sort({f}, 'ASC', 'NULLS LAST')), 'null')" for f in ("evidence_span_ids", "target_candidate_ids", "target_ledger_entry_ids")}
_EXPECTED = "'redmem_' || substr(sha256(" + _json_sql(decision_type=_quoted("decision_type"), rationale=_quoted("rationale"), **_SORTED) + "), 1, 24)"


@query(f"select distinct id, expected_id, id is not distinct from expected_id id_matches from (select id, {_EXPECTED} expected_id from memory_reducer_decision)")
def expected_ids(spark, sf):
    """Identifiers that content demands against those given (the test tables' ids are not derived from content)."""
    from ..functions.identity import with_id_check

    rows = with_id_check(_table(spark, sf, "memory_reducer_decision"), "memory_reducer_decision")
    return rows.select("id", "expected_id", "id_matches").distinct()


@query(_GRAPH + "select distinct c.from_id start_id, coalesce(d.to_id, c.to_id) id from edge c left join edge d on d.from_id = c.to_id where c.relation = 'cites' union select id, id from node where kind = 'claim' and id not in (select from_id from edge)")
def citation_descendants(spark, sf):
    g = citations.held(_graph(spark, sf))
    return citations.reached(g, g.nodes.where("kind = 'claim'"))


@query("select coalesce(schema_version, '1.0.0') migrated_from, '1.1.0' schema_version, count(*) records from ledger_entry group by 1")
def migrate_versions(spark, sf):
    return migrate.counts(migrate.default_migrator().migrate(_table(spark, sf, "ledger_entry"), "1.1.0"))


def _selected(spark, sf, strategy, most=100):
    """Trusted entries, each id once (exact repeats and earlier states would be ties of one position)."""
    rows = _table(spark, sf, "ledger_entry").groupBy("id").agg(F.max(F.struct("updated_at", "schema_version", "ledger_type", "status", "confidence", "asserted_at", "valid_from", "supersedes", "evidence_span_ids")).alias("e"))
    rows = rows.select("id", "e.*").withColumns({"pos": F.lit(0), "record_type": F.col("ledger_type"), "privacy_class": F.lit("internal")})
    policy = compiler.Policy(max_records=most, strategy=strategy)
    return compiler.select_records(rows, _graph(spark, sf), access.team_scope(), policy, as_of=_now())


_SELECT = _GRAPH + """, e as (select * from ledger_entry qualify row_number() over (partition by id order by updated_at desc nulls last, schema_version desc nulls last, ledger_type desc nulls last, status desc nulls last, confidence desc nulls last, asserted_at desc nulls last, valid_from desc nulls last) = 1),
s as (select id, ledger_type, case when schema_version is null then 'schema_invalid' when status in ('stale', 'retracted', 'contested') then 'status_' || status when id not in (select id from supp) then 'no_source_backing' end why,
  coalesce(epoch_us(coalesce(cast(asserted_at as timestamptz), cast(valid_from as timestamptz))) / 1e6, 0.0) + coalesce(2.0 * nullif(list_position(['low', 'medium', 'high'], confidence), 0) / 3, 0.0) score from e),
k as (select s.*, row_number() over (partition by ledger_type order by score desc, id) turn, coalesce(d.n, 0) n from s left join (select to_id, count(*) n from edge group by to_id) d on d.to_id = s.id where why is null) """


@query(_SELECT + "select id, cast(row_number() over (order by score desc, id) as int) rank from k qualify rank <= 100")
def compile_recent(spark, sf):
    return _selected(spark, sf, "recent").where("rank is not null").select("id", "rank")


@query(_SELECT + "select id, cast(row_number() over (order by turn, ledger_type) as int) rank from k qualify rank <= 100")
def compile_diverse(spark, sf):
    return _selected(spark, sf, "diverse").where("rank is not null").select("id", "rank")


@query(_SELECT + "select id, cast(row_number() over (order by n desc, score desc, id) as int) rank from k qualify rank <= 100")
def compile_frequent(spark, sf):
    return _selected(spark, sf, "frequent").where("rank is not null").select("id", "rank")


@query(_SELECT + "select why reason, count(*) records from s where why is not null group by why union all select 'exceeded_max_records', count(*) - 100 from k having count(*) > 100")
def compile_excluded(spark, sf):
    return compiler.exclusions(_selected(spark, sf, "recent"))


@query(_SELECT + f""", f as (select id, coalesce(epoch_us({_T}) - epoch_us(cast(asserted_at as timestamptz)) >= 0, false) known, (epoch_us({_T}) - epoch_us(cast(asserted_at as timestamptz))) / 1e6 age, coalesce(len(supersedes), 0) p, coalesce(len(evidence_span_ids), 0) q from e),
g as (select id, case when known then greatest(0.0, least(1.0, pow(0.5, age / 7776000.0), pow(0.5, p) * pow(0.9, q))) else 1.0 end fresh from f)
select id, cast(row_number() over (order by fresh desc, id) as int) rank from k join g using (id) qualify rank <= 100""")
def compile_fresh(spark, sf):
    return _selected(spark, sf, "fresh").where("rank is not null").select("id", "rank")


_PACK = _SELECT + f""", top as (select id, ledger_type, row_number() over (order by score desc, id) rank from k qualify rank <= 100), section as (select ledger_type, string_agg(to_json(id), ',' order by rank) ids from top group by ledger_type),
out as (select why reason, count(*) n from s where why is not null group by why union all select 'exceeded_max_records', count(*) - 100 from k having count(*) > 100),
pack as (select (select '[' || string_agg(to_json(id), ',' order by id) || ']' from top) ids, (select '{{' || string_agg('"' || ledger_type || '":[' || ids || ']', ',' order by ledger_type) || '}}' from section) sections, (select '{{' || string_agg('"' || reason || '":' || n, ',' order by reason) || '}}' from out) excluded),
named as (select *, 'ctx_' || substr(sha256('{{"created_at":"{NOW}","pack_type":"project","record_ids":' || ids || ',"task_id":"task-1"}}'), 1, 24) id from pack) """


def _packed(spark, sf):
    return compiler.pack(_selected(spark, sf, "recent"), task_id="task-1", pack_type="project", created_at=NOW)


@query(_PACK + "select id, sections, excluded, sha256(ids) build_inputs_hash from named")
def context_pack_build(spark, sf):
    return _packed(spark, sf).select("id", F.to_json("sections").alias("sections"), F.to_json("excluded").alias("excluded"), "build_inputs_hash")


@query(_PACK + """select 'ctxreceipt_' || substr(sha256('{"build_inputs_hash":"' || sha256(ids) || '","context_pack_id":"' || id || '"}'), 1, 24) id, id context_pack_id, ids included_ids from named""")
def context_pack_receipt(spark, sf):
    return compiler.receipt(_packed(spark, sf)).select("id", "context_pack_id", F.to_json("included_ids").alias("included_ids"))


_TASK = {"task_id": "task-1", "task_title": "title", "task_type": "research", "task_summary": "summary", "project_id": None, "risk_class": "low", "sensitivity": "internal"}


@query(_PACK + """, cited as (select distinct to_id id from edge where relation = 'cites' and from_id in (select id from top)), span as (select distinct c.id, s.source_id, s.episode_id from cited c join evidence_span s on s.id = c.id)
select ledger_type || '_ids' slot, id from top union all select 'evidence_span_ids', id from (select distinct id from span) union all select distinct 'source_record_ids', source_id from span where source_id is not null
union all select distinct 'episode_record_ids', episode_id from span where episode_id is not null union all select 'primary_evidence_span_ids', id from (select distinct id from span order by id limit 5)
union all select 'included_ids', id from (select id from top union select id from span union select source_id from span union select episode_id from span) where id is not null""")
def context_pack_document(spark, sf):
    """The lists of a pack as a whole document, a row per id."""
    spans = _table(spark, sf, "evidence_span").select("id", "source_id", "episode_id", F.lit(None).cast("string").alias("created_at"))
    pack = compiler.document(_selected(spark, sf, "recent"), _graph(spark, sf), spans, task=_TASK, state={}, created_at=NOW)
    lists = {**{f: f"trusted_memory.{f}" for f in ("fact_ids", "preference_ids", "decision_ids")}, **{f: f"evidence.{f}" for f in ("source_record_ids", "episode_record_ids", "evidence_span_ids", "primary_evidence_span_ids")}, "included_ids": "retrieval_trace.included_ids"}
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("slot"), F.col(c).alias("ids")) for f, c in lists.items()]))
    return pack.select(both.alias("l")).select("l.slot", F.explode("l.ids").alias("id"))


@query(_SELECT + """, top as (select id from k order by score desc, id limit 100) select distinct to_id id from edge where relation = 'cites' and from_id in (select id from top) order by id limit 5""")
def primary_evidence(spark, sf):
    """Spans carry no time of their own here, so ties are decided by id alone."""
    spans = _table(spark, sf, "evidence_span").select("id", F.lit(None).cast("string").alias("created_at"))
    return compiler.primary_evidence(spans, _selected(spark, sf, "recent"), _graph(spark, sf).edges.where("relation = 'cites'")).select("id")


def _texts(spark, sf, max_chars=render.MAX_CHARS):
    rows = _table(spark, sf, "ledger_entry")
    parts = [render.embedding_inputs(rows.where(F.col("ledger_type") == k), f"{k}_ledger_entry", max_chars=max_chars) for k in ("fact", "preference", "decision")]
    parts.append(render.embedding_inputs(_table(spark, sf, "evidence_span"), "evidence_span", max_chars=max_chars))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lined(label: str, field: str) -> str:
    return f"'{label}: ' || nullif({field}, '')"


_FOOT = "coalesce('Evidence: ' || nullif(array_to_string(evidence_span_ids, ', '), ''), '')"
_META = """concat_ws(',', '"record_id":' || to_json(coalesce(id, '')), '"record_type":"' || ledger_type || '_ledger_entry"', '"privacy_class":"internal"', '"plane":"ledger"', """ + ", ".join(f"""'"{f}":' || to_json(nullif("{f}", ''))""" for f in ("subject", "predicate", "object", "scope", "confidence", "domain")) + ")"
_TEXTS = f"""with t as (
select id, ledger_type || '_ledger_entry' k, {_META} m, case ledger_type
 when 'fact' then concat_ws(chr(10), nullif(fact_text, ''), 'Subject: ' || nullif(subject, '') || ' ' || nullif(predicate, '') || ' ' || nullif("object", ''), {_lined('Scope', 'scope')}, 'Confidence: ' || coalesce(nullif(confidence, ''), 'unknown'), {_lined('Valid from', 'valid_from')}, {_FOOT})
 when 'preference' then concat_ws(chr(10), {_lined('Preference', 'preference_text')}, {_lined('Subject', 'subject')}, {_lined('Domain', 'domain')}, {_lined('Strength', 'strength')}, {_FOOT})
 when 'decision' then concat_ws(chr(10), {_lined('Decision', 'decision_text')}, {_lined('Scope', 'decision_scope')}, {_lined('Owner', 'owner')}, {_lined('Reversibility', 'reversibility')}, {_FOOT}) end x from ledger_entry where ledger_type in ('fact', 'preference', 'decision')
union all select id, 'evidence_span', '"record_id":' || to_json(coalesce(id, '')) || ',"record_type":"evidence_span","privacy_class":' || to_json(coalesce(nullif(privacy_class, ''), 'internal')) || ',"plane":"evidence"', concat_ws(chr(10), 'Span ' || coalesce(nullif(id, ''), 'unknown') || ' in source ' || coalesce(nullif(source_id, ''), 'unknown'), case when locator is not null then 'Locator: ' || coalesce(locator.kind, '?') || '=' || coalesce(locator.value, '?') end,
 coalesce('Text: ' || nullif(text_excerpt, ''), 'Text: [no excerpt; excerpt_policy=' || coalesce(nullif(excerpt_policy, ''), 'none') || ']'), 'Privacy: ' || coalesce(nullif(privacy_class, ''), 'internal')) from evidence_span) """


@query(_TEXTS + "select coalesce(id, '') record_id, k record_type, x \"text\", sha256(x) content_hash_sha256 from t where x <> ''")
def embedding_text(spark, sf):
    return _texts(spark, sf).select("record_id", "record_type", "text", "content_hash_sha256")


@query(_TEXTS + """, c as (select id, k, x, regexp_extract(x[1:121], '^((?s).{0,119}[.!?\\n])([\\s.!?]|$)', 1) kept from t where x <> '')
select coalesce(id, '') record_id, k record_type, length(x) > 120 truncated, case when length(x) <= 120 then x else regexp_replace(case when kept <> '' then kept else x[1:120] end, '\\s+$', '') || '...[truncated]' end "text" from c""")
def embedding_truncate(spark, sf):
    return _texts(spark, sf, 120).select("record_id", "record_type", "truncated", "text")


@query(_TEXTS + "select sha256(x) content_hash_sha256, min(coalesce(id, '')) record_id, count(*) copies from t where x <> '' group by 1")
def embedding_dedup(spark, sf):
    return render.distinct_texts(_texts(spark, sf))


@query(_TEXTS + "select coalesce(id, '') record_id, case when k = 'evidence_span' then 'evidence' else 'ledger' end plane, cast(length(x) as int) char_count, '{' || m || '}' metadata from t where x <> ''")
def embedding_metadata(spark, sf):
    return _texts(spark, sf).select("record_id", "plane", "char_count", F.to_json("metadata").alias("metadata"))


@query("select coalesce(id, '') record_id, 'memory_reducer_decision' record_type, 'audit' plane, concat_ws(chr(10), " + ", ".join(f"'{f}: ' || {f}" for f in ("confidence", "decided_at", "decision_type", "id", "rationale", "risk_class", "schema_version")) + ") \"text\" from memory_reducer_decision")
def embedding_generic(spark, sf):
    rows = _table(spark, sf, "memory_reducer_decision").select("id", "schema_version", "decision_type", "rationale", "decided_at", "confidence", "risk_class")
    return render.embedding_inputs(rows, "memory_reducer_decision").select("record_id", "record_type", "plane", "text")


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_id desc) <= 5")
def session_latest_n(spark, sf):
    return sessions.latest_turns(_table(spark, sf, "events"), session="user_id", turn="event_id", keep=5).select("user_id", "event_id", "event_type")


_SOURCE = "'src_' || substr(sha256('{\"content_hash_sha256\":\"' || sha256(cast(user_id as varchar)) || '\",\"origin_or_raw_ref\":{\"kind\":\"synthetic_fixture\",\"value\":\"' || user_id || '\"},\"source_type\":\"other\"}'), 1, 24)"
_TURNS = "with t as (select user_id, event_id, event_type, props, " + _SOURCE + " src from events)"
_PLACE = lambda part: "'\"locator_kind\":\"message_range\",\"locator_value\":\"' || event_id || '" + part + "\",\"source_id\":\"' || src || '\"}'"


@query(_TURNS + " select user_id session_id, event_id turn, 'episode' kind, 'ep_' || substr(sha256('{\"episode_type\":\"conversation_segment\",' || " + _PLACE("") + "), 1, 24) id, null \"text\" from t union all select user_id, event_id, 'span', 'span_' || substr(sha256('{' || "
       + _PLACE(":input") + "), 1, 24), event_type from t union all select user_id, event_id, 'span', 'span_' || substr(sha256('{' || " + _PLACE(":output") + "), 1, 24), props from t")
def session_records(spark, sf):
    turns = _table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("input"), F.col("props").alias("output"))
    return sessions.turn_records(turns)


#: What every ledger document of the two copies must look like.
DOCUMENT_SCHEMA = {
    "type": "object",
    "required": ["id", "schema_version", "ledger_type", "status", "owner"],
    "properties": {"id": {"type": "string", "pattern": "^(fact|pref|dec)_"}, "ledger_type": {"enum": ["fact", "preference", "decision"]}, "status": {"type": "string"}, "freshness_score": {"type": ["number", "null"], "minimum": 0, "maximum": 1}},
}


@query("""with e as (select bundle_ix, pos, unnest([case when not list_contains(json_keys(doc), 'owner') then '$: owner is missing' end, case when not regexp_matches(doc ->> '$.id', '^(fact|pref|dec)_') then '$.id: does not match ^(fact|pref|dec)_' end,
case when doc ->> '$.ledger_type' not in ('fact', 'preference', 'decision') then '$.ledger_type: is not one of ["fact", "preference", "decision"]' end, case when json_type(doc, '$.status') <> 'VARCHAR' then '$.status: is not of type string' end,
case when json_type(doc, '$.freshness_score') not in ('DOUBLE', 'UBIGINT', 'BIGINT', 'NULL') then '$.freshness_score: is not of type number or null' when try_cast(doc ->> '$.freshness_score' as double) not between 0 and 1 then '$.freshness_score: is out of range' end]) error from bundle_record)
select bundle_ix, pos, error from e where error is not null""")
def jsonschema_errors(spark, sf):
    rows = _table(spark, sf, "bundle_record")
    return rows.select("bundle_ix", "pos", F.explode(schema_errors(F.col("doc"), DOCUMENT_SCHEMA)).alias("error"))
