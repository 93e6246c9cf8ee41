"""JSON and JSON-lines bundles in, JSON lines out."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.instants import trimmed
from ..functions.jsonschema import schema_errors
from ..operators.rules import ViolationError
from ..schemas import json_schema


def sniff(path: str, head: str = "") -> str:
    """json or jsonl: by the file's name, else by its first character; an empty text is jsonl."""
    if path.endswith(".jsonl"):
        return "jsonl"
    if path.endswith(".json"):
        return "json"
    return "json" if head.lstrip()[:1] in ("{", "[") else "jsonl"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of text files, lines counted from 1 in each.

    Line numbers need the file's order: each split keeps it and is numbered from its block start by a
    prefix sum over the splits, so that no file is read by one task.
    """
    raw = spark.read.text(path).select(F.col("value").alias("text"), F.input_file_name().alias("path"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row"))
    counts = raw.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return raw.join(starts, ["path", "block"]).select("path", (F.col("offset") + F.col("row") - F.col("first") + 1).alias("line"), "text")


def read_bundle(spark: SparkSession, path: str, *, bundle_ix: int = 0, strict: bool = True) -> DataFrame:
    """(bundle_ix, pos, doc) of a bundle file.

    JSON lines: blank lines are skipped; a line that is no JSON object is an error naming its number, or is
    left out unless `strict`. JSON: an object is one record, an array one per object in it, other items are
    left out; anything else is an error.
    """
    if sniff(path, "" if path.endswith((".json", ".jsonl")) else _head(spark, path)) == "jsonl":
        lines = numbered_lines(spark, path).where(F.trim("text") != "")
        kind = F.schema_of_variant(F.try_parse_json("text"))
        bad = ~F.coalesce(kind.startswith("OBJECT"), F.lit(False))
        if strict:
            first = lines.where(bad).orderBy("line").limit(1).collect()
            if first:
                raise ValueError(f"line {first[0]['line']}: no JSON object")
        return lines.where(~bad).select(F.lit(bundle_ix).alias("bundle_ix"), F.col("line").alias("pos"), F.col("text").alias("doc"))
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    top = F.substring(F.trim("text"), 1, 1)
    if whole.where(F.try_parse_json("text").isNull() | ~top.isin("{", "[")).limit(1).count():
        raise ValueError("no JSON object or array")
    items = whole.select(F.posexplode(F.when(top == "{", F.array("text")).otherwise(F.transform(F.from_json("text", "array<variant>"), lambda v: F.to_json(v)))).alias("pos", "doc"))
    return items.where(F.substring(F.trim("doc"), 1, 1) == "{").select(F.lit(bundle_ix).alias("bundle_ix"), F.col("pos").cast("bigint").alias("pos"), "doc")


def _head(spark: SparkSession, path: str) -> str:
    """The first character of a file, wherever it lies and whatever blanks come first; empty for a blank file."""
    first = spark.read.text(path).select(F.substring(trimmed(F.col("value")), 1, 1).alias("c")).where("c <> ''").limit(1).collect()
    return first[0][0] if first else ""


def load_single_json(path: str):
    """The one value of a JSON file."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def validated_jsonl(spark: SparkSession, path: str, schema: str | dict) -> DataFrame:
    """(path, line, text, errors) of every line; a blank line has an error. No line raises."""
    rules = json_schema(schema) if isinstance(schema, str) else schema
    return numbered_lines(spark, path).select("path", "line", "text", schema_errors(F.col("text"), rules).alias("errors"))


def validate_jsonl(spark: SparkSession, path: str, schema: str | dict, *, raise_on_error: bool = False) -> DataFrame:
    """(line, errors) of the lines that break the schema."""
    bad = validated_jsonl(spark, path, schema).where(F.size("errors") > 0).select("line", "errors")
    if raise_on_error:
        first = bad.orderBy("line").limit(1).collect()
        if first:
            raise ViolationError(f"line {first[0]['line']}: {first[0]['errors'][0]}")
    return bad


def write_planes(records: DataFrame, path: str) -> None:
    """JSON lines of (plane, doc), a folder per plane."""
    records.select("plane", F.col("doc").alias("value")).write.mode("overwrite").partitionBy("plane").text(path)


def import_memories(rows: DataFrame) -> DataFrame:
    """Rows of a simple store (id, kind, payload, created_at, source) as five records each: (plane, pos, id, doc).

    Every row yields a source, a span of it, a candidate, a decision and an entry, linked by identifiers that
    are derived from their content. Rows of one (id, kind, source) are one record: the last created counts.
    """
    from ..functions.canonical import canonical_struct, content_id, ledger_id, sha256, source_id, span_id

    last = rows.groupBy("id", "kind", "source").agg(F.max_by("payload", "created_at").alias("payload"), F.max("created_at").alias("created_at"))
    c = F.col
    nowhere = F.struct(F.lit("local_path").alias("kind"), F.concat(c("source"), F.lit("#"), c("id").cast("string")).alias("value"))
    a = last.withColumn("raw_ref", nowhere).withColumn("hash", sha256(c("payload")))
    a = a.withColumn("src", source_id(F.lit("other"), F.lit(None).cast("string"), c("raw_ref"), c("hash")))
    a = a.withColumn("locator", F.struct(F.lit("synthetic_locator").alias("kind"), c("id").cast("string").alias("value"))).withColumn("span", span_id(c("src"), c("locator")))
    kind = F.when(c("kind").isin("preference", "decision"), c("kind")).otherwise("fact")
    a = a.withColumn("ledger_type", kind).withColumn("entry", ledger_id(c("ledger_type"), F.array("span"), {"text": c("payload"), "valid_from": c("created_at")}))
    a = a.withColumn("cand", content_id("candidate_claim", evidence_span_ids=F.array("span"), text=c("payload")))
    a = a.withColumn("dec", content_id("memory_reducer_decision", decision_type=F.lit("promote"), target_candidate_ids=F.array("cand"), target_ledger_entry_ids=F.array("entry"), evidence_span_ids=F.array("span"), rationale=F.lit("imported")))
    made = F.array(
        F.struct(F.lit("source").alias("plane"), c("src").alias("id"), canonical_struct(id=c("src"), source_type=F.lit("other"), raw_ref=c("raw_ref"), content_hash_sha256=c("hash"), captured_at=c("created_at")).alias("doc")),
        F.struct(F.lit("evidence").alias("plane"), c("span").alias("id"), canonical_struct(id=c("span"), source_id=c("src"), locator=c("locator"), text_excerpt=c("payload"), span_hash_sha256=c("hash")).alias("doc")),
        F.struct(F.lit("candidate").alias("plane"), c("cand").alias("id"), canonical_struct(id=c("cand"), candidate_type=F.lit("claim"), evidence_span_ids=F.array("span"), claim_text=c("payload"), extracted_at=c("created_at")).alias("doc")),
        F.struct(F.lit("reducer").alias("plane"), c("dec").alias("id"), canonical_struct(id=c("dec"), decision_type=F.lit("promote"), target_candidate_ids=F.array("cand"), target_ledger_entry_ids=F.array("entry"), evidence_span_ids=F.array("span"), decided_at=c("created_at")).alias("doc")),
        F.struct(F.lit("ledger").alias("plane"), c("entry").alias("id"), canonical_struct(id=c("entry"), ledger_type=c("ledger_type"), status=F.lit("active"), evidence_span_ids=F.array("span"), reducer_decision_id=c("dec"), valid_from=c("created_at")).alias("doc")),
    )
    return a.select(c("id").alias("pos"), F.explode(made).alias("r")).select("r.plane", "pos", "r.id", "r.doc")
