"""Schemas that drift between files (problem 2).

A file's schema is a tree: fields, and members of object-valued fields, to any depth asked for. Between a
file and the one before it in its feed, a constrained tree edit distance (functions/trees.py) finds the
cheapest script of additions, removals, renames, moves and changes of type. Which renames there may be is
settled by the values: over the records that both files hold, a gone and a new field of the same object
must agree. Schemas are reduced to a few rows per file where the lines are read. Only files with both gone
and new fields of one object are read again, for just those fields; the evidence is one join on (file,
record). The trees are small and are compared per file. Scripts compile into one projection per file, under
which all files of a kind come out as one table.
"""

from __future__ import annotations

import itertools
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import jsonvalue, trees
from ..session import cut, groups_for

# JSON types as bits of a set; null has no bit.
TYPE_BITS = {"null": 0, "boolean": 1, "number": 2, "string": 4, "array": 8, "object": 16}

#: Stands between the names of a path inside; results have a dot.
_SEP = "\x1f"

#: Files whose fields are to be read again are broadcast to the lines up to this many, and joined by shuffle beyond.
BROADCAST_FILES = 200_000

_FIELD = pa.schema([("feed", pa.string()), ("file", pa.string()), ("parent", pa.string()), ("name", pa.string()), ("types", pa.int32())])
_FIELD_DDL = "feed string, file string, parent string, name string, types int"
_VALUE = pa.list_(pa.struct([("parent", pa.string()), ("name", pa.string()), ("value", pa.binary())]))
_VALUE_DDL = "array<struct<parent:string,name:string,value:binary>>"


def _clean(name: str) -> str:
    """A key that can be written as UTF-8 (JSON may hold lone surrogates)."""
    return name if name.isascii() else name.encode("utf-8", "replace").decode()


def _fields_of(key: str, opaque: frozenset[str], depth: int | None):
    """Per batch, the fields of each file and the set of their types."""

    def walk(value: dict, path: tuple[str, ...], at: tuple, seen: dict[tuple, int]) -> None:
        for name, inner in value.items():
            if not path and name == key:
                continue
            field = (*at, _SEP.join(path), name)
            seen[field] = seen.get(field, 0) | TYPE_BITS[jsonvalue.kind(inner)]
            if isinstance(inner, dict) and not (not path and name in opaque) and (depth is None or len(path) + 1 < depth):
                walk(inner, (*path, name), at, seen)

    def fields(batches):
        for batch in batches:
            seen: dict[tuple, int] = {}
            for feed, file, doc in zip(batch["feed"].to_pylist(), batch["file"].to_pylist(), batch["doc"].to_pylist(), strict=True):
                walk(jsonvalue.parse_object(doc) or {}, (), (feed, file), seen)
            rows = [(feed, file, _clean(parent), _clean(name), types) for (feed, file, parent, name), types in seen.items()]
            columns = list(zip(*rows, strict=True)) or [()] * len(_FIELD)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIELD.types, strict=True)], schema=_FIELD)

    return fields


def _values_of(key: str):
    """Per record with an id, its values of the wanted paths; absent ones are left out, null ones are null."""

    def values(batches):
        for batch in batches:
            ids, found, kept = [], [], []
            for row, (doc, paths) in enumerate(zip(batch["doc"].to_pylist(), batch["paths"].to_pylist(), strict=True)):
                record = jsonvalue.parse_object(doc)
                rid = None if record is None else record.get(key)
                if rid is None:
                    continue
                kept.append(row)
                ids.append(_clean(rid) if isinstance(rid, str) and not isinstance(rid, jsonvalue.Number) else jsonvalue.canonical(rid))
                mine = []
                for path in paths:
                    holder = record
                    for part in path["parent"].split(_SEP) if path["parent"] else ():
                        holder = holder.get(part) if isinstance(holder, dict) else None
                    if isinstance(holder, dict) and path["name"] in holder:
                        value = holder[path["name"]]
                        mine.append({"parent": path["parent"], "name": path["name"], "value": None if value is None else jsonvalue.digest(value)})
                found.append(mine)
            lead = batch.select(["feed", "target", "role", "line", "tie"]).take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([*lead.columns, pa.array(ids, pa.string()), pa.array(found, _VALUE)], names=[*lead.schema.names, "id", "fields"])

    return values


def matching(pairs: list[tuple[str, str, int]]) -> list[tuple[str, str]]:
    """As many renames (old, new, evidence) as possible, one per field; those with most evidence among equals."""
    return trees.renames({(old, new): 1 - 1e-6 / (1 + proof) for old, new, proof in pairs})


def _tree(fields: list[tuple[str, str, int]]) -> trees.Tree:
    """A tree from (parent, name, types); holders that are not listed have no type of note."""
    root: trees.Tree = {}
    for parent, name, types in sorted(fields):
        at = root
        for part in parent.split(_SEP) if parent else ():
            at = at.setdefault(part, (0, {}))[1]
        at[name] = (types, at[name][1] if name in at else {})
    return root


def edit_script(fields: list[tuple[str, str, str, int, int]], pairs: list[tuple[str, str, str, int]], *, cheapest: bool = False) -> list[tuple[str, str, str]]:
    """The cheapest script between two schema trees, as (kind, old, new) with dotted names.

    `fields`: (parent, name, state, types before, types now) with state gone, new or both; `pairs`:
    (parent, old, new, evidence) that may be renamed. An edited node takes its members along, so those
    appear in no edit of their own. The script makes one of several renames that a field allows, and moves
    fields between objects, if it is `cheapest`; else every rename that is allowed is listed, with no
    addition or removal of its ends, and a move is a removal and an addition.
    """
    split = lambda parent: tuple(parent.split(_SEP)) if parent else ()
    before = _tree([(p, n, was) for p, n, state, was, _ in fields if state != "new"])
    after = _tree([(p, n, now) for p, n, state, _, now in fields if state != "gone"])
    # Unlisted holders are in both trees.
    for p, _, state, _, _ in fields:
        other = after if state == "gone" else before
        known = {(split(q), m) for q, m, s, _, _ in fields if s == state}
        for i, part in enumerate(split(p)):
            if (split(p)[:i], part) in known:
                break
            other = other.setdefault(part, (0, {}))[1]
    allowed = {(split(p), o, n): max(1, proof) for p, o, n, proof in pairs}
    _, script = trees.distance(before, after, allowed, moves=cheapest)
    if not cheapest:
        held = {e.old[:-1] for e in script if e.kind in ("removed", "renamed")} | {e.new[:-1] for e in script if e.kind == "added"}
        mine = [(p, o, n) for p, o, n in allowed if p in held]
        olds, news = {(*p, o) for p, o, _ in mine}, {(*p, n) for p, _, n in mine}
        script = [e for e in script if e.kind == "retyped" or (e.kind == "removed" and e.old not in olds) or (e.kind == "added" and e.new not in news)]
        script += [trees.Edit("renamed", (*p, o), (*p, n)) for p, o, n in mine]
    return sorted((e.kind, ".".join(e.old), ".".join(e.new)) for e in script)


def drift(lines: DataFrame, *, feed: str, file: str, exported: str, line: str, doc: str, key: str = "id", opaque: tuple[str, ...] = ("metadata",), depth: int | None = 2, cheapest: bool = False) -> DataFrame:
    """(feed, file, change_kind, old_field, new_field): what each file changes against the one before it.

    Every rename that the values allow is listed, or, if `cheapest`, one script of least cost, with moves.
    Schemas are compared down to `depth` levels (None: all).

    Files of a feed are ordered by their earliest `exported`, then by name; a null `exported` is first.
    Lines that are null or no JSON object don't count, but a file of such lines alone still has its place
    and an empty schema. Members of object-valued fields are fields named `field.member`, except those of
    `opaque` fields. Of several records of one id in a file the one with the greatest `line` is compared,
    though all of them give the file its fields; records without an id only give fields. Values are equal
    as JSON values.
    """
    rows = lines.select(F.coalesce(F.col(feed).cast("string"), F.lit("")).alias("feed"), F.coalesce(F.col(file).cast("string"), F.lit("")).alias("file"), F.col(exported).alias("exported"), F.col(line).alias("line"), F.col(doc).alias("doc"))
    order = Window.partitionBy("feed").orderBy("exported", "file")
    files = rows.groupBy("feed", "file").agg(F.min("exported").alias("exported")).withColumn("before", F.lag("file").over(order))
    files = cut(files.select("feed", "file", "before"))

    schema = cut(rows.select("feed", "file", "doc").mapInArrow(_fields_of(key, frozenset(opaque), depth), _FIELD_DDL).groupBy("feed", "file", "parent", "name").agg(F.bit_or("types").alias("types")))
    pairs_of_files = files.where("before is not null").select("feed", "file", "before")
    nothing = F.lit(None).cast("int")
    now = schema.join(pairs_of_files.select("feed", "file"), ["feed", "file"]).select("feed", "file", "parent", "name", F.col("types").alias("now"), nothing.alias("was"))
    was = schema.withColumnRenamed("file", "before").join(pairs_of_files, ["feed", "before"]).select("feed", "file", "parent", "name", nothing.alias("now"), F.col("types").alias("was"))
    compared = now.unionByName(was).groupBy("feed", "file", "parent", "name").agg(F.max("was").alias("was"), F.max("now").alias("now"))
    state = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "new").otherwise("both")
    compared = cut(compared.withColumn("state", state).where("state <> 'both' or (was <> now and was <> 0 and now <> 0)"))

    # Renames are possible where an object has both gone and new fields; lists here are as short as a schema.
    in_state = lambda s: F.collect_list(F.when(F.col("state") == s, F.struct("parent", "name")))
    chances = compared.groupBy("feed", "file", "parent").agg(in_state("gone").alias("gone"), in_state("new").alias("new")).where("size(gone) > 0 and size(new) > 0")
    chances = chances.groupBy("feed", "file").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.flatten(F.collect_list("new")).alias("new")).join(pairs_of_files, ["feed", "file"])
    wanted = cut(
        chances.select("feed", F.col("before").alias("file"), F.col("file").alias("target"), F.lit(0).alias("role"), F.col("gone").alias("paths")).unionByName(
            chances.select("feed", "file", F.col("file").alias("target"), F.lit(1).alias("role"), F.col("new").alias("paths"))
        )
    )
    asked = rows.select("feed", "file", F.col("line").cast("bigint").alias("line"), F.xxhash64("doc").alias("tie"), "doc").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_FILES else wanted, ["feed", "file"])
    values = asked.select("feed", "target", "role", "line", "tie", "doc", "paths").mapInArrow(_values_of(key), f"feed string, target string, role int, line bigint, tie bigint, id string, fields {_VALUE_DDL}")
    last = values.groupBy("feed", "target", "id", "role").agg(F.max_by("fields", F.struct("line", "tie")).alias("fields"))
    sides = last.groupBy("feed", "target", "id").agg(*[F.max(F.when(F.col("role") == r, F.col("fields"))).alias(f"side{r}") for r in (0, 1)]).where("size(side0) > 0 and size(side1) > 0")
    cross = F.flatten(F.transform("side0", lambda a: F.transform(F.filter("side1", lambda b: b["parent"] == a["parent"]), lambda b: F.struct(a["parent"].alias("parent"), a["name"].alias("old"), b["name"].alias("new"), a["value"].alias("a"), b["value"].alias("b")))))
    same = F.col("a").eqNullSafe(F.col("b"))
    evidence = (
        sides.select("feed", F.col("target").alias("file"), F.explode(cross).alias("x"))
        .select("feed", "file", "x.*")
        .groupBy("feed", "file", "parent", "old", "new")
        .agg(F.min(same).alias("all_same"), F.sum((same & F.col("a").isNotNull()).cast("long")).alias("proof"))
        .where("all_same and proof > 0")
    )
    return _scripts(compared, evidence, cheapest)


def _scripts(compared: DataFrame, evidence: DataFrame, cheapest: bool) -> DataFrame:
    spark = compared.sparkSession
    none = F.lit(None)
    both = compared.select("feed", "file", "parent", "name", "state", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"), none.cast("string").alias("new"), none.cast("bigint").alias("proof")).unionByName(
        evidence.select("feed", "file", "parent", F.col("old").alias("name"), F.lit("pair").alias("state"), F.lit(0).alias("was"), F.lit(0).alias("now"), "new", F.col("proof").cast("bigint").alias("proof"))
    )
    groups = groups_for(compared.count(), 20_000, least=int(spark.conf.get("spark.sql.shuffle.partitions")))

    def edit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (feed, file), g in pdf.groupby(["feed", "file"], sort=False):
            rows = list(zip(g["parent"], g["name"], g["state"], g["was"], g["now"], g["new"], g["proof"], strict=True))
            script = edit_script([r[:5] for r in rows if r[2] != "pair"], [(r[0], r[1], r[5], int(r[6])) for r in rows if r[2] == "pair"], cheapest=cheapest)
            out += [(feed, file, *edit) for edit in script]
        return pd.DataFrame(out, columns=["feed", "file", "change_kind", "old_field", "new_field"])

    bucket = F.pmod(F.xxhash64("feed", "file"), F.lit(groups))
    return both.groupBy(bucket.alias("bucket")).applyInPandas(edit, "feed string, file string, change_kind string, old_field string, new_field string")


def canonical_names(scripts: DataFrame, files: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(feed, file, field, name): the compiled projections. `name` is what the feed called the field first.

    `files` has feed, file and its number `ix` in the feed. Only fields that a rename has touched are
    listed; all others keep their name. A removal or addition ends or begins a chain of renames. A field
    that is added under the canonical name of another one that lives gets a name of its own, `name_2` or the
    next that is free: no name of `taken` (feed, field) or of the scripts, so that no later field has it.
    Members follow the field that holds them.
    """
    # A move ends one field and begins another. Feeds without a rename need no projection.
    halves = F.when(F.col("change_kind") == "moved", F.array(F.struct(F.lit("removed").alias("k"), F.col("old_field").alias("o"), F.lit("").alias("n")), F.struct(F.lit("added").alias("k"), F.lit("").alias("o"), F.col("new_field").alias("n"))))
    halves = F.explode(F.coalesce(halves, F.array(F.struct(F.col("change_kind").alias("k"), F.col("old_field").alias("o"), F.col("new_field").alias("n")))))
    scripts = scripts.select("feed", "file", halves.alias("h")).select("feed", "file", F.col("h.k").alias("change_kind"), F.col("h.o").alias("old_field"), F.col("h.n").alias("new_field"))
    kinds = scripts.where("change_kind in ('renamed', 'removed', 'added')").join(scripts.where("change_kind = 'renamed'").select("feed").distinct(), "feed", "left_semi")
    kinds = kinds.join(files, ["feed", "file"]).select("feed", "ix", "old_field", "new_field")
    avoid = scripts.select("feed", F.explode(F.array("old_field", "new_field")).alias("field"))
    avoid = (avoid if taken is None else avoid.unionByName(taken.select("feed", "field"))).select(F.col("feed").alias("of"), "field").distinct()

    def compose(pdf: pd.DataFrame, reserved: pd.DataFrame) -> pd.DataFrame:
        names: dict[str, str] = {}
        out, avoided = [], set(reserved["field"])
        first = pdf["feed"].iloc[0] if len(pdf) else None
        steps: dict[int, list] = {}
        for ix, old, new in zip(pdf["ix"], pdf["old_field"], pdf["new_field"], strict=True):
            steps.setdefault(int(ix), []).append((old, new))
        for ix in sorted(steps):
            moved, before = {}, dict(names)
            for old, new in steps[ix]:
                if old:
                    name = names.pop(old, old)
                    # An entry of a member has the holder's name of the file on both sides.
                    members = {m: names.pop(m) for m in [m for m, inner in names.items() if m.startswith(f"{old}.") and inner.startswith(f"{old}.")]}
                    if new:
                        moved[new] = name
                        moved |= {new + m[len(old) :]: new + inner[len(old) :] for m, inner in members.items()}
            names |= {new: name for new, name in moved.items() if new != name}
            for new in sorted(new for old, new in steps[ix] if not old):
                if new in (used := set(names.values())):
                    names[new] = next(n for n in (f"{new}_{k}" for k in itertools.count(2)) if n not in used and n not in avoided)
            # The projection before goes on where a file only adds.
            if names != before or any(old for old, _ in steps[ix]):
                out += [(first, ix, new, name) for new, name in names.items()] or [(first, ix, None, None)]
        return pd.DataFrame(out, columns=["feed", "ix", "field", "name"])

    return kinds.groupBy("feed").cogroup(avoid.groupBy("of")).applyInPandas(compose, "feed string, ix int, field string, name string")


def _names_return(scripts: DataFrame) -> bool:
    """Whether some field is added under a name, within its object, that a rename has left."""
    inner = lambda c: F.element_at(F.split(c, r"\."), -1).alias("inner")
    left = scripts.where("change_kind = 'renamed'").select("feed", inner("old_field")).distinct()
    return not scripts.where("change_kind = 'added'").select("feed", inner("new_field")).join(left, ["feed", "inner"]).isEmpty()


def _projected(value: dict, names: dict[str, str], path: str = "") -> dict:
    """An object's fields under their canonical names, which never take the place of another field.

    Under a retyped field members come and go without an edit, so a name of theirs may be in use; the field
    keeps its own then.
    """
    target = {m: n[len(path) :] if (n := names.get(path + m, "")).startswith(path) and n else m for m in value}
    plain = {m for m, n in target.items() if m == n}
    out: dict = {}
    value = {m: _projected(v, names, f"{path}{m}.") if isinstance(v, dict) else v for m, v in value.items()}
    for m, v in value.items():
        name = target[m] if m in plain or target[m] not in plain and target[m] not in out else m
        while name in out or (name in plain and name != m):
            name += "_2"
        out[name] = v
    return out


def _renamed(batches):
    """Documents with their fields under canonical names; `names` maps the touched ones, members as field.member."""
    for batch in batches:
        docs, ids, ok = [], [], []
        for text, names in zip(batch["doc"].to_pylist(), batch["names"].to_pylist(), strict=True):
            try:
                record = json.loads(text) if text is not None else None
            except ValueError:
                record = None
            ok.append(isinstance(record, dict))
            if not ok[-1]:
                docs.append(None)
                ids.append(None)
                continue
            names = dict(names or ())
            out = _projected(record, names)
            docs.append(json.dumps(out, ensure_ascii=True))
            ids.append(out["id"] if isinstance(out.get("id"), str) else None)
        kept = batch.drop_columns(["doc", "names"]) if hasattr(batch, "drop_columns") else batch.select([n for n in batch.schema.names if n not in ("doc", "names")])
        table = pa.RecordBatch.from_arrays([*kept.columns, pa.array(ids, pa.string()), pa.array(docs, pa.string())], names=[*kept.schema.names, "id", "record"])
        yield table.filter(pa.array(ok, pa.bool_()))


#: Fields beyond the commonest so many come out in a map instead of columns.
MOST_FIELDS = 10_000


def unify(lines: DataFrame, scripts: DataFrame, *, feed: str, file: str, exported: str, line: str, doc: str, most_columns: int = MOST_FIELDS) -> DataFrame:
    """One table of all records: (source_feed, source_file, source_line, id, and each field under its canonical name).

    Each file's projection is composed from the scripts up to it; no two fields of a record share a name in
    it, so a new field under the name that a renamed one keeps comes out as `name_2`. Scalars come out as text, arrays and
    objects as JSON text, absent fields as null; a record's own fields that clash with the four leading
    columns get the prefix `field_`. Should there be more than `most_columns` fields, the rarer ones are in
    the map `more_fields`. `scripts` make at most one rename of a field (`cheapest`). Repeated lines come out once; lines that are no JSON object not at all.
    """
    rows = lines.select(F.coalesce(F.col(feed).cast("string"), F.lit("")).alias("feed"), F.coalesce(F.col(file).cast("string"), F.lit("")).alias("file"), F.col(exported).alias("exported"), F.col(line).cast("bigint").alias("line"), F.col(doc).alias("doc"))
    order = Window.partitionBy("feed").orderBy("exported", "file")
    files = cut(rows.groupBy("feed", "file").agg(F.min("exported").alias("exported")).withColumn("ix", F.row_number().over(order)).select("feed", "file", "ix"))
    scripts = cut(scripts)
    # What a field of its own may not be called is only read where a name comes back.
    taken = None
    if _names_return(scripts):
        taken = rows.select("feed", "file", "doc").mapInArrow(_fields_of("id", frozenset(), None), _FIELD_DDL)
        taken = taken.select("feed", F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat_ws(".", F.replace("parent", F.lit(_SEP), F.lit(".")), "name")).alias("field"))
    steps = canonical_names(scripts, files, taken).groupBy("feed", "ix").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("field", "name")), lambda x: x["field"].isNotNull())).alias("step"))
    filled = Window.partitionBy("feed").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    projections = files.join(steps, ["feed", "ix"], "left").select("feed", "file", F.last("step", ignorenulls=True).over(filled).alias("names"))
    once = rows.select("feed", "file", "line", "doc").distinct().join(projections, ["feed", "file"])
    renamed = cut(once.select("feed", "file", "line", "doc", "names").mapInArrow(_renamed, "feed string, file string, line bigint, id string, record string"))
    counted = renamed.select(F.explode(F.json_object_keys("record")).alias("k")).where("k <> 'id'").groupBy("k").agg(F.count("*").alias("n"))
    names = [r[0] for r in counted.orderBy(F.desc("n"), "k").limit(most_columns + 1).collect()]
    names, more = sorted(names[:most_columns]), len(names) > most_columns
    lead = {"source_feed", "source_file", "source_line", "id"}
    schema = StructType([StructField(n, StringType()) for n in names])
    fields = [F.col("r").getField(n).alias(f"field_{n}" if n.lower() in lead else n) for n in names]
    if more:
        whole = F.map_filter(F.from_json("record", "map<string,string>"), lambda k, _: ~k.isin("id", *names))
        fields.append(F.map_from_entries(F.array_sort(F.map_entries(F.col("m")))).alias("more_fields"))
        renamed = renamed.withColumn("m", whole)
    kept = ["feed", "file", "line", "id", F.from_json("record", schema).alias("r"), *(["m"] if more else [])]
    return renamed.select(*kept).select(F.col("feed").alias("source_feed"), F.col("file").alias("source_file"), F.col("line").alias("source_line"), "id", *fields)
