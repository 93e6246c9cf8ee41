"""Queries of the general training-data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import BLANKS, instant, micros, trimmed
from ..operators import asof, differences, drift, hierarchy, history, survivorship, timezones
from ..session import cut, prepare

_ATTRIBUTES = {"status": "text", "confidence": "text", "scope": "text", "valid_from": "instant", "valid_until": "instant", "stale_after": "instant", "superseded_by": "list"}
_SURVIVING = ("status", "confidence", "scope", "statement", "owner", "valid_from")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def citations(packs: DataFrame) -> DataFrame:
    """Distinct (pack_id, entry_id, created_at) of what context packs cite in trusted_memory."""
    lists = [F.coalesce(F.col(f"trusted_memory.{k}"), F.array().cast("array<string>")) for k in ("fact_ids", "preference_ids", "decision_ids")]
    return packs.select(F.col("id").alias("pack_id"), "created_at", F.explode(F.concat(*lists)).alias("entry_id")).where("entry_id is not null").distinct()


def as_known(spark: SparkSession, sf: str) -> DataFrame:
    """Cited entries with the attributes known when their pack was made."""
    cited = citations(_table(spark, sf, "context_pack")).withColumn("at", instant(F.col("created_at")))
    changes = _table(spark, sf, "ledger_snapshot").withColumnRenamed("id", "entry_id")
    return asof.as_known_at(
        cited, changes, entity="entry_id", event_time=F.col("at"), known_at=F.col("received_at"), rank_by=F.col("taken_at"), versions=("status", "valid_from", "stale_after")
    )


def p1_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return as_known(spark, sf).select("pack_id", "entry_id", "created_at", "known_status", "known_valid_from", "known_stale_after", "is_known")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    status = F.lower(trimmed(F.col("known_status")))
    starts, ends = instant(F.col("known_valid_from")), instant(F.col("known_stale_after"))
    usable = F.col("is_known") & (status == "active") & (starts.isNull() | (starts <= F.col("at"))) & (ends.isNull() | (ends > F.col("at")))
    found = as_known(spark, sf).where(~F.coalesce(usable, F.lit(False)))
    return found.select("pack_id", "entry_id", F.when(F.col("is_known"), F.coalesce(status, F.lit(""))).otherwise("unknown").alias("known_status")).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = drift.drift(_table(spark, sf, "raw_export"), feed="feed", file="file_name", exported="exported_at", line="line_no", doc="doc")
    return found.withColumnRenamed("file", "file_name").distinct()


def _unified(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    columns = {"feed": "feed", "file": "file_name", "exported": "exported_at", "line": "line_no", "doc": "doc"}
    rows = _table(spark, sf, "raw_export").where(F.col("record_kind") == kind)
    return drift.unify(rows, drift.drift(rows, **columns, cheapest=True), **columns)


def p2_ledger_entries(spark: SparkSession, sf: str) -> DataFrame:
    """All exported ledger entries as one table."""
    return _unified(spark, sf, "ledger_entry")


def p2_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """All exported reducer decisions as one table."""
    return _unified(spark, sf, "memory_reducer_decision")


def time_values(spark: SparkSession, sf: str) -> DataFrame:
    """(record_table, record_id, field_name, agent, value) of the four time fields, each spelling once."""
    entry, decision = _table(spark, sf, "ledger_entry"), _table(spark, sf, "memory_reducer_decision")
    agents = decision.where("id is not null").groupBy(F.col("id").alias("reducer_decision_id")).agg(F.max("decided_by.agent").alias("agent"))
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("observed_at", "created_at")])
    entries = entry.select(F.col("id").alias("record_id"), "reducer_decision_id", F.explode(fields).alias("x")).select("record_id", "reducer_decision_id", "x.*").where("value is not null")
    entries = entries.join(agents, "reducer_decision_id", "left")
    parts = [
        entries.select(F.lit("ledger_entry").alias("record_table"), "record_id", "field_name", "agent", "value"),
        _table(spark, sf, "candidate").select(F.lit("candidate").alias("record_table"), F.col("id").alias("record_id"), F.lit("extracted_at").alias("field_name"), F.col("extracted_by.agent").alias("agent"), F.col("extracted_at").alias("value")),
        decision.select(F.lit("memory_reducer_decision").alias("record_table"), F.col("id").alias("record_id"), F.lit("decided_at").alias("field_name"), F.col("decided_by.agent").alias("agent"), F.col("decided_at").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("value is not null")


def _normalised(spark: SparkSession, sf: str, values: DataFrame) -> DataFrame:
    zones = _table(spark, sf, "agent_zone").where("agent is not null").groupBy("agent").agg(F.max("tz_name").alias("tz_name"))
    return timezones.normalised(values.join(zones, "agent", "left"), value="value", home="tz_name", source=("record_table", "field_name", "agent"))


def p3_instants(spark: SparkSession, sf: str) -> DataFrame:
    return _normalised(spark, sf, time_values(spark, sf)).select("record_table", "record_id", "field_name", "value", "epoch_us", "format", "ambiguous").distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    odd = time_values(spark, sf).where(~F.col("value").rlike(timezones.CANONICAL)).distinct()
    return _normalised(spark, sf, odd).where("epoch_us is not null").select("record_table", "record_id", "field_name", "epoch_us").distinct()


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return history.version_history(_table(spark, sf, "ledger_snapshot"), key="id", number="snapshot_no", received="received_at", attributes=_ATTRIBUTES)


def p4_history(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).select("id", "version_no", F.col("first").alias("first_snapshot_no"), F.col("last").alias("last_snapshot_no"))


def standing_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Variants that the resolution in force has not rejected."""
    resolution, variant = _table(spark, sf, "conflict_resolution"), _table(spark, sf, "conflict_variant")
    in_force = (
        resolution.where("conflict_id is not null and coalesce(trim(superseded_at), '') = ''")
        .groupBy("conflict_id")
        .agg(F.max(F.struct(micros(F.col("resolved_at")).alias("at"), "id", "rejected_record_ids")).alias("last"))
    )
    rejected = in_force.select("conflict_id", F.explode("last.rejected_record_ids").alias("record_id")).distinct()
    return variant.join(rejected, ["conflict_id", "record_id"], "left_anti")


def _survivors(spark: SparkSession, sf: str) -> DataFrame:
    return survivorship.survivors(standing_variants(spark, sf), group="conflict_id", record="record_id", fields=_SURVIVING, latest=(micros(F.col("updated_at")), F.col("trust")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _survivors(spark, sf).select("conflict_id", "field_name", "record_id")


def p5_records(spark: SparkSession, sf: str) -> DataFrame:
    """One surviving record per conflict."""
    cells = _survivors(spark, sf)
    return cells.groupBy("conflict_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in _SURVIVING])


def p5_truths(spark: SparkSession, sf: str) -> DataFrame:
    facts, _ = survivorship.truths(standing_variants(spark, sf), group="conflict_id", source="bundle_ix", fields=_SURVIVING)
    return facts.withColumn("probability", F.round("probability", 6))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return cut(hierarchy.links(_table(spark, sf, "ledger_entry").select("id", "supersedes", "superseded_by"), key="id", parents="supersedes", children="superseded_by"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(_links(spark, sf)).select("id", "root_id", "depth")


def p6_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Path, depth, root and number of later entries of each linked entry."""
    return hierarchy.hierarchy(_links(spark, sf), paths=True).withColumn("path", F.array_join("path", " > "))


def p6_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(_links(spark, sf), paths=True))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    copies = _table(spark, sf, "bundle_record").select("bundle_ix", "pos", "id", "doc")
    found = differences.differences(copies.where("bundle_ix = 0"), copies.where("bundle_ix = 1"), key="id", doc="doc", position="pos")
    return found.withColumnRenamed("field", "field_name").select("id", "side", "field_name")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_attributes, p2_found, p2_ledger_entries, p2_decisions, p3_found, p3_instants, p4_found, p4_history, p5_found, p5_records, p5_truths, p6_found, p6_hierarchy, p6_descendants, p7_found)
}

_KNOWN_SQL = """
with cited as (
  select distinct id pack_id, created_at, unnest(list_concat(coalesce(trusted_memory.fact_ids, []), coalesce(trusted_memory.preference_ids, []), coalesce(trusted_memory.decision_ids, []))) entry_id
  from context_pack
), best as (
  select c.pack_id, c.entry_id, c.created_at, s.status, s.valid_from, s.stale_after, s.id is not null is_known,
    row_number() over (partition by c.pack_id, c.entry_id, c.created_at order by s.taken_at desc nulls last, s.received_at desc nulls last, s.status desc nulls last, s.valid_from desc nulls last, s.stale_after desc nulls last) n
  from cited c left join ledger_snapshot s on s.id = c.entry_id and s.received_at <= try_cast(c.created_at as timestamptz)
  where c.entry_id is not null
)
"""
_HISTORY_SQL = """
with last as (
  select id, snapshot_no, lower(trim(status)) a, lower(trim(confidence)) b, lower(trim(scope)) c,
    try_cast(valid_from as timestamptz) d, try_cast(valid_until as timestamptz) e, try_cast(stale_after as timestamptz) f,
    list_sort(list_distinct(list_filter(list_transform(coalesce(superseded_by, []), lambda x: lower(trim(x))), lambda x: x <> ''))) g, received_at
  from ledger_snapshot
  qualify row_number() over (partition by id, snapshot_no order by received_at desc) = 1
), runs as (
  select *, coalesce(lag(snapshot_no) over w = snapshot_no - 1 and lag(coalesce(a, '')) over w = coalesce(a, '') and lag(coalesce(b, '')) over w = coalesce(b, '') and lag(coalesce(c, '')) over w = coalesce(c, '')
    and lag(d) over w is not distinct from d and lag(e) over w is not distinct from e and lag(f) over w is not distinct from f and lag(g) over w = g, false) goes_on
  from last window w as (partition by id order by snapshot_no)
), numbered as (
  select *, sum(case when goes_on then 0 else 1 end) over (partition by id order by snapshot_no) version_no from runs
)
"""
_NOTHING = ", ".join(f"'{text}'" for text in survivorship.NO_VALUE)
_SURVIVING_SQL = f"""
with in_force as (
  select conflict_id, rejected_record_ids from conflict_resolution where coalesce(trim(superseded_at), '') = ''
  qualify row_number() over (partition by conflict_id order by cast(resolved_at as timestamptz) desc, id desc) = 1
), rejected as (select distinct conflict_id, unnest(rejected_record_ids) record_id from in_force),
standing as (select * from conflict_variant anti join rejected using (conflict_id, record_id)),
cells as (
  select conflict_id, record_id, updated_at, trust, unnest(['status', 'confidence', 'scope', 'statement', 'owner', 'valid_from']) field_name, unnest([status, confidence, scope, statement, owner, valid_from]) value
  from standing
), best as (
  select * from cells where coalesce(lower(trim(value, '{BLANKS}')), '') not in ({_NOTHING})
  qualify row_number() over (partition by conflict_id, field_name order by cast(updated_at as timestamptz) desc nulls last, trust desc nulls last, record_id, value) = 1
)
"""


def _truth_sql(rounds: int = 8) -> str:
    """Expectation-maximisation with a table per half round."""
    parts = [
        _SURVIVING_SQL
        + f""", stated as (select distinct c.conflict_id g, c.field_name f, lower(trim(c.value, '{BLANKS}')) v, cast(c.bundle_ix as varchar) s
  from (select conflict_id, bundle_ix, unnest(['status', 'confidence', 'scope', 'statement', 'owner', 'valid_from']) field_name, unnest([status, confidence, scope, statement, owner, valid_from]) value from standing) c
  where c.conflict_id is not null and c.bundle_ix is not null and coalesce(lower(trim(c.value, '{BLANKS}')), '') not in ({_NOTHING})),
voters as (select g, f, list_sort(list(distinct s)) voters from stated group by g, f),
facts as (select g, f, v, list_sort(list(distinct s)) pro, list_filter(any_value(voters), lambda x: not list_contains(list(distinct s), x)) con from stated join voters using (g, f) group by g, f, v),
cases as materialized (select pro, con, count(*) n from facts group by pro, con),
votes as materialized (select pro, con, n, unnest(list_concat(list_transform(pro, lambda x: {{'s': x, 'o': 1}}), list_transform(con, lambda x: {{'s': x, 'o': 0}})), recursive := true) from cases),
quality0 as (select distinct s, cast(0.7 as double) sens, cast(0.7 as double) spec from votes)"""
    ]
    for k in range(rounds):
        parts.append(
            f"""belief{k} as materialized (select pro, con, 1 / (1 + exp(sum(case when o = 1 then ln(1 - spec) - ln(sens) else ln(spec) - ln(1 - sens) end))) p from votes join quality{k} using (s) group by pro, con),
quality{k + 1} as materialized (select s, (sum(n * p * o) + 7) / (sum(n * p) + 10) sens, (sum(n * (1 - p) * (1 - o)) + 7) / (sum(n * (1 - p)) + 10) spec from votes join belief{k} using (pro, con) group by s)"""
        )
    return ", ".join(parts) + f" select g conflict_id, f field_name, v \"value\", round(p, 6) probability, p >= 0.5 is_true from facts join belief{rounds - 1} using (pro, con)"


_TREE_SQL = """
with recursive stated as (
  select unnest(supersedes) parent, id child from ledger_entry union select id, unnest(superseded_by) from ledger_entry
), edges as (
  select child, min(parent) parent from stated where parent in (select id from ledger_entry) and child in (select id from ledger_entry) group by child
), nodes as (select child id from edges union select parent from edges),
walk as (
  select id, id root_id, 0 depth, [id] path from nodes where id not in (select child from edges)
  union all
  select e.child, w.root_id, w.depth + 1, list_append(w.path, e.child) from walk w join edges e on e.parent = w.id
)
"""
_CELLS_SQL = """
with last as (select * from bundle_record where id is not null qualify row_number() over (partition by bundle_ix, id order by pos desc) = 1),
leaves as (
  select l.bundle_ix, l.id, t.fullkey, t.type, case when t.type in ('OBJECT', 'ARRAY') then '' when t.type in ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') then cast(cast(t.atom as double) as varchar) else coalesce(t.atom ->> '$', '') end v
  from last l, json_tree(l.doc) t where t.fullkey <> '$'
), fields as (
  select bundle_ix, id, regexp_extract(fullkey, '^[$][.]("[^"]*"|[^.\\[]+)', 1) field_name,
    string_agg(fullkey || '|' || case when type in ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') then 'N' else type end || '|' || v, chr(10) order by fullkey) whole
  from leaves group by all
), a as (select * from fields where bundle_ix = 0), b as (select * from fields where bundle_ix = 1),
ids as (select coalesce(x.id, y.id) id, x.id is not null in_0, y.id is not null in_1 from (select id from last where bundle_ix = 0) x full join (select id from last where bundle_ix = 1) y on x.id = y.id)
"""
_DRIFT_SQL = r"""
with doc as (select distinct feed, file_name, line_no, cast(doc as json) j from raw_export where json_valid(doc) and json_type(case when json_valid(doc) then doc else 'null' end) = 'OBJECT'),
files as (select feed, file_name, min(exported_at) e from raw_export group by all),
pair as (select feed, file_name, lag(file_name) over (partition by feed order by e, file_name) prev from files qualify prev is not null),
tops as (select doc.feed, doc.file_name, doc.j ->> '$.id' id, '' parent, k.key name, k.value v, k.type t from doc, json_each(doc.j) k where k.key <> 'id'),
cell as (select * from tops union all select tops.feed, tops.file_name, tops.id, tops.name, m.key, m.value, m.type from tops, json_each(case when tops.t = 'OBJECT' then tops.v else '{}' end) m where tops.t = 'OBJECT' and tops.name <> 'metadata'),
known as (select *, case when t in ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') then 'number' when t = 'NULL' then null else t end kind,
  case when t = 'NULL' then null when t in ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') then cast(cast(v as double) as varchar) when t = 'OBJECT' then (select string_agg(o.key || '=' || o.value, ';' order by o.key) from json_each(v) o) else cast(v as varchar) end text from cell),
field as (select feed, file_name, parent, name, list_sort(list_distinct(list(kind) filter (kind is not null))) kinds from known group by all),
now as (select p.feed, p.file_name, f.parent, f.name, coalesce(f.kinds, []) kinds from pair p join field f on f.feed = p.feed and f.file_name = p.file_name),
was as (select p.feed, p.file_name, f.parent, f.name, coalesce(f.kinds, []) kinds from pair p join field f on f.feed = p.feed and f.file_name = p.prev),
gone as (select * from was anti join now using (feed, file_name, parent, name)), fresh as (select * from now anti join was using (feed, file_name, parent, name)),
old as (select distinct p.feed, p.file_name, a.id, a.parent, a.name, a.kind, a.text from pair p join known a on a.feed = p.feed and a.file_name = p.prev semi join gone g on g.feed = p.feed and g.file_name = p.file_name and g.parent = a.parent and g.name = a.name),
new as (select distinct p.feed, p.file_name, b.id, b.parent, b.name, b.kind, b.text from pair p join known b on b.feed = p.feed and b.file_name = p.file_name semi join fresh g on g.feed = p.feed and g.file_name = p.file_name and g.parent = b.parent and g.name = b.name),
renamed as (select a.feed, a.file_name, a.parent, a.name old_name, b.name new_name from old a join new b on a.feed = b.feed and a.file_name = b.file_name and a.id = b.id and a.parent = b.parent
  group by all having bool_and(a.text is not distinct from b.text and a.kind is not distinct from b.kind) and count(a.text) > 0),
edit as (
  select feed, file_name, parent, 'renamed' change_kind, old_name, new_name from renamed
  union all select feed, file_name, parent, 'removed', name, '' from gone g where not exists (select 1 from renamed r where r.feed = g.feed and r.file_name = g.file_name and r.parent = g.parent and r.old_name = g.name)
  union all select feed, file_name, parent, 'added', '', name from fresh g where not exists (select 1 from renamed r where r.feed = g.feed and r.file_name = g.file_name and r.parent = g.parent and r.new_name = g.name)
  union all select n.feed, n.file_name, n.parent, 'retyped', n.name, n.name from now n join was w using (feed, file_name, parent, name) where n.kinds <> w.kinds and len(n.kinds) > 0 and len(w.kinds) > 0
)
select feed, file_name, change_kind, case when old_name = '' or parent = '' then old_name else parent || '.' || old_name end old_field, case when new_name = '' or parent = '' then new_name else parent || '.' || new_name end new_field
from edit e where parent = '' or not exists (select 1 from edit t where t.feed = e.feed and t.file_name = e.file_name and t.parent = '' and e.parent in (t.old_name, t.new_name))
"""
_INSTANT_SQL = r"""
with decision as (select id, max(decided_by.agent) agent from memory_reducer_decision where id is not null group by id),
zone as (select agent, max(tz_name) tz from agent_zone group by agent),
value as (
  select distinct 'ledger_entry' record_table, e.id record_id, x.f field_name, d.agent, x.v from (select id, reducer_decision_id, unnest([{'f': 'observed_at', 'v': observed_at}, {'f': 'created_at', 'v': created_at}]) x from ledger_entry) e left join decision d on d.id = e.reducer_decision_id
  union select 'candidate', id, 'extracted_at', extracted_by.agent, extracted_at from candidate
  union select 'memory_reducer_decision', id, 'decided_at', decided_by.agent, decided_at from memory_reducer_decision),
odd as (select v.*, upper(trim(v, e' \t\r\n')) s, z.tz home from value v left join zone z on z.agent = v.agent where v is not null and not regexp_full_match(v, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z')),
part as (select *, case
  when regexp_matches(s, '^\d{4}([-/])\d{2}[-/]\d{2}[T ]\d') then regexp_extract(s, '^(\d{4})[-/](\d{2})[-/](\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?()\s*(.*)$', ['y', 'm', 'd', 'h', 'i', 'c', 'f', 'p', 'z'])
  when regexp_matches(s, '^\d{8}T') then regexp_extract(s, '^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})()()(.*)$', ['y', 'm', 'd', 'h', 'i', 'c', 'f', 'p', 'z'])
  when regexp_matches(s, '^\d{2}[.]') then regexp_extract(s, '^(\d{2})[.](\d{2})[.](\d{4}) (\d{2}):(\d{2}):(\d{2})()()\s*(.*)$', ['d', 'm', 'y', 'h', 'i', 'c', 'f', 'p', 'z'])
  when regexp_matches(s, '^\d{2}/') then regexp_extract(s, '^(\d{2})/(\d{2})/(\d{4}) (\d{2}):(\d{2}):(\d{2})() ([AP])M\s*(.*)$', ['m', 'd', 'y', 'h', 'i', 'c', 'f', 'p', 'z'])
  when regexp_matches(s, '^([A-Z]{3}, )?\d{1,2} [A-Z]') then regexp_extract(s, '^(?:[A-Z]{3}, )?(\d{1,2}) ([A-Z]{3})[A-Z]* (\d{4}) (\d{2}):(\d{2}):(\d{2})()()\s*(.*)$', ['d', 'm', 'y', 'h', 'i', 'c', 'f', 'p', 'z'])
  else regexp_extract(s, '^([A-Z]{3})[A-Z]* (\d{1,2}), (\d{4}) (\d{2}):(\d{2})()() ([AP])M\s*(.*)$', ['m', 'd', 'y', 'h', 'i', 'c', 'f', 'p', 'z']) end r from odd),
clock as (select *, try_cast(r.h as int) hh, case when regexp_matches(r.m, '^\d') then r.m else cast((strpos('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', r.m) + 2) // 3 as varchar) end mon from part),
local as (select *, try_cast(r.y || '-' || lpad(mon, 2, '0') || '-' || lpad(r.d, 2, '0') || ' ' || lpad(cast(case when r.p = '' then hh when hh between 1 and 12 then hh % 12 + case r.p when 'P' then 12 else 0 end end as varchar), 2, '0') || ':' || r.i || ':' || case when r.c = '' then '00' else r.c end as timestamp) t,
  coalesce(try_cast(rpad(left(r.f, 6), 6, '0') as bigint), 0) micro,
  case when r.z in ('Z', 'UTC', 'GMT', '[UTC]') then 0 when regexp_matches(r.z, '^[+-]\d{2}(:?\d{2})?$') then cast(left(r.z, 1) || '1' as int) * (cast(r.z[2:3] as int) * 60 + coalesce(try_cast(right(r.z[4:], 2) as int), 0))
    else case r.z when 'CET' then 60 when 'CEST' then 120 when 'EST' then -300 when 'EDT' then -240 when 'PST' then -480 when 'PDT' then -420 when 'JST' then 540 end end off,
  case when r.z = '' then home when regexp_matches(r.z, '^\[.+/.+\]$') then (select any_value(tz_name) from agent_zone where upper(tz_name) = trim(r.z, '[]')) end tz from clock),
spot as (select *, timezone(tz, t) u from local where hh < 24),
fair as (select *, case when off is not null then epoch_us(t) - cast(off as bigint) * 60000000
  when timezone(tz, u) <> t then epoch_us(t) - (epoch_us(timezone(tz, u - interval 1 day)) - epoch_us(u - interval 1 day))
  when timezone(tz, u - interval 1 hour) = t then epoch_us(u - interval 1 hour) else epoch_us(u) end + micro us from spot),
number as (select *, cast(s as decimal(38, 6)) n from odd where regexp_full_match(s, '\d+(\.\d{1,6})?')),
counted as (select *, unnest([n * 1000000, n * 1000, n, n / 1000]) us from number)
select distinct record_table, record_id, field_name, us epoch_us from fair where us is not null
union select distinct record_table, record_id, field_name, cast(floor(us) as bigint) from counted where us >= 1704067200000000 and us < 1767225600000000
"""
#: The same over all values, with the format that each is written in.
_FORMAT = r"""case when regexp_full_match(v, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z') then 'canonical' when regexp_matches(s, '^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d') then 'ymd' when regexp_matches(s, '^\d{8}T') then 'basic' when regexp_matches(s, '^\d{2}[.]') then 'dotted day first'
  when regexp_matches(s, '^\d{2}/') then 'slashed month first' when regexp_matches(s, '^([A-Z]{3}, )?\d{1,2} [A-Z]') then 'day month' else 'month day' end"""
_INSTANTS_SQL = (
    _INSTANT_SQL[: _INSTANT_SQL.index("select distinct record_table")].rstrip().replace(r" and not regexp_full_match(v, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z')", "")
    .replace("unnest([n * 1000000, n * 1000, n, n / 1000]) us", "unnest([{'us': n * 1000000, 'unit': 's'}, {'us': n * 1000, 'unit': 'ms'}, {'us': n, 'unit': 'us'}, {'us': n / 1000, 'unit': 'ns'}], recursive := true)")
    + f""", read as (select record_table, record_id, field_name, v, agent, us, {_FORMAT} format from fair where us is not null
  union select record_table, record_id, field_name, v, agent, cast(floor(us) as bigint), 'number ' || unit from counted where us >= 1704067200000000 and us < 1767225600000000)
select distinct o.record_table, o.record_id, o.field_name, o.v "value", r.us epoch_us, r.format, false ambiguous from odd o left join read r on r.record_table = o.record_table and r.record_id is not distinct from o.record_id and r.field_name = o.field_name and r.v = o.v and r.agent is not distinct from o.agent
"""
)
SQL: dict[str, str] = {
    "p3_instants": _INSTANTS_SQL,
    "p2_found": _DRIFT_SQL,
    "p3_found": _INSTANT_SQL,
    "p1_found": _KNOWN_SQL
    + """select distinct pack_id, entry_id, case when is_known then coalesce(lower(trim(status)), '') else 'unknown' end known_status from best
where n = 1 and not coalesce(is_known and lower(trim(status)) = 'active' and coalesce(try_cast(valid_from as timestamptz) <= cast(created_at as timestamptz), true)
  and coalesce(try_cast(stale_after as timestamptz) > cast(created_at as timestamptz), true), false)""",
    "p1_attributes": _KNOWN_SQL + "select pack_id, entry_id, created_at, status known_status, valid_from known_valid_from, stale_after known_stale_after, is_known from best where n = 1",
    "p4_found": _HISTORY_SQL
    + "select id, cast(version_no as int) version_no, cast(min(snapshot_no) as int) first_snapshot_no, cast(max(snapshot_no) as int) last_snapshot_no from numbered group by id, version_no",
    "p4_history": _HISTORY_SQL
    + """, version as (select id, cast(version_no as int) version_no, cast(min(snapshot_no) as int) first, cast(max(snapshot_no) as int) last, any_value(nullif(a, '')) a, any_value(nullif(b, '')) b, any_value(nullif(c, '')) c, any_value(d) d, any_value(e) e, any_value(f) f, any_value(g) g from numbered group by id, version_no)
select id, version_no, first, last, '{"status":' || coalesce(to_json(a), 'null') || ',"confidence":' || coalesce(to_json(b), 'null') || ',"scope":' || coalesce(to_json(c), 'null') || ',"valid_from":' || coalesce(to_json(cast(epoch_us(d) as varchar)), 'null')
 || ',"valid_until":' || coalesce(to_json(cast(epoch_us(e) as varchar)), 'null') || ',"stale_after":' || coalesce(to_json(cast(epoch_us(f) as varchar)), 'null') || ',"superseded_by":' || case when len(g) > 0 then to_json(cast(to_json(g) as varchar)) else 'null' end || '}' attributes from version""",
    "p5_found": _SURVIVING_SQL + "select conflict_id, field_name, record_id from best",
    "p5_records": _SURVIVING_SQL
    + "select conflict_id, " + ", ".join(f"max(value) filter (field_name = '{f}') {f}" for f in _SURVIVING) + " from best group by conflict_id",
    "p5_truths": _truth_sql(),
    "p6_found": _TREE_SQL + "select n.id, coalesce(w.root_id, '') root_id, cast(coalesce(w.depth, -1) as int) depth from nodes n left join walk w on w.id = n.id",
    "p6_hierarchy": _TREE_SQL
    + """, below as (select a id, count(*) - 1 n from (select unnest(path) a from walk) group by a)
select n.id, coalesce(w.root_id, '') root_id, cast(coalesce(w.depth, -1) as int) depth, b.n descendants, array_to_string(w.path, ' > ') path
from nodes n left join walk w on w.id = n.id left join below b on b.id = n.id""",
    "p6_descendants": _TREE_SQL
    + "select id, descendant_id, cast(depth - place + 1 as int) distance from (select id descendant_id, depth, unnest(path) id, generate_subscripts(path, 1) place from walk) where id <> descendant_id",
    "p7_found": _CELLS_SQL
    + """select id, case when in_0 then 'only_0' else 'only_1' end side, '' field_name from ids where not (in_0 and in_1)
union all select coalesce(a.id, b.id), 'both', coalesce(a.field_name, b.field_name) from a full join b on a.id = b.id and a.field_name = b.field_name
where coalesce(a.id, b.id) in (select id from ids where in_0 and in_1) and a.whole is distinct from b.whole""",
}
