"""Records as texts for embedding: declarative templates compiled to one column."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# The lines of each record type's text. `Label: field`; a field after | is a fallback, after = a
# default text; fields joined by + are all needed; [] is a list. Lines without a value are left out.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "source_record": ("Title: title", "Author: author_or_sender=unknown", "Type: source_type=unknown", "URI: origin_uri|raw_ref.value", "Captured: captured_at=unknown"),
    "candidate_claim": ("Claim: claim_text", "Subject: subject+predicate+object", "Scope: claim_scope", "Confidence: confidence=unknown", "!evidence"),
    "candidate_decision": ("Decision: decision_text", "Scope: decision_scope", "Owner: owner_hint", "Rationale: rationale_text", "Alternatives: alternatives_mentioned[]", "Reversibility: reversibility", "!evidence"),
    "candidate_preference": ("Preference: preference_text", "Subject: subject", "Domain: domain", "Scope: scope", "Strength: strength_hint", "!evidence"),
    "candidate_task": ("Task: task_text", "Kind: task_kind", "Projects: project_refs[]", "Owner: owner_hint", "Urgency: urgency_hint", "!evidence"),
    "candidate_taste_signal": ("Taste: taste_text", "Domain: domain", "Kind: signal_kind", "Strength: strength_hint", "Examples: example_span_ids[]", "Contrast: contrast_span_ids[]", "!evidence"),
    "fact_ledger_entry": ("fact_text", "Subject: subject+predicate+object", "Scope: scope", "Confidence: confidence=unknown", "Valid from: valid_from", "!evidence"),
    "decision_ledger_entry": ("Decision: decision_text", "Scope: decision_scope", "Owner: owner", "Rationale: rationale_text", "Alternatives considered: alternatives_considered[]", "Reversibility: reversibility", "!evidence"),
    "preference_ledger_entry": ("Preference: preference_text", "Subject: subject", "Domain: domain", "Strength: strength", "!evidence"),
    "taste_card": ("Principle: principle", "Rationale: rationale", "Subject: subject", "Domain: domain", "Kind: taste_kind", "Strength: strength", "!evidence"),
}
# How texts are cut, and what else goes along with them.
MARKER, BOUNDARY_WINDOW, MAX_CHARS = "...[truncated]", 200, 8192
METADATA = ("source_type", "subject", "predicate", "object", "scope", "confidence", "context_pack_kind", "domain", "taste_kind", "claim_scope")


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def _list(values: Column) -> Column:
    return _filled(F.array_join(F.coalesce(values, F.array().cast("array<string>")), ", "))


class _Row:
    """Columns by name; those that a table lacks are null."""

    def __init__(self, columns: list[str], schema: T.StructType | None = None) -> None:
        self.columns, self.schema = set(columns), schema

    def __getitem__(self, name: str) -> Column:
        return F.col(name) if name.split(".")[0] in self.columns else F.lit(None)

    def kind(self, name: str) -> str:
        return self.schema[name].dataType.simpleString() if self.schema is not None and name in self.columns else ""

    def members(self, name: str) -> list[str]:
        """Members of a struct column, none for others."""
        kind = self.schema[name].dataType if self.schema is not None and name in self.columns else None
        return kind.names if isinstance(kind, T.StructType) else []

    def ids(self, name: str) -> Column:
        """All ids of a list, or of the lists of a struct."""
        if self.kind(name) == "array<string>":
            return F.coalesce(F.col(name), F.array().cast("array<string>"))
        lists = [f"{name}.{m}" for m in self.members(name) if self.schema[name].dataType[m].dataType.simpleString() == "array<string>"]  # type: ignore[index]
        return F.array_compact(F.concat(*[F.coalesce(F.col(x), F.array().cast("array<string>")) for x in lists])) if lists else F.array().cast("array<string>")

    def text(self, name: str) -> Column:
        return _filled(self[name].cast("string"))

    def list(self, name: str) -> Column:
        return _list(self[name].cast("array<string>"))


def _line(row: _Row, template: str) -> Column:
    label, _, spec = template.rpartition(": ")
    spec, _, default = spec.partition("=")
    if spec.endswith("[]"):
        value = row.list(spec[:-2])
    elif "+" in spec:
        parts = [row.text(f) for f in spec.split("+")]
        complete = parts[0].isNotNull()
        for p in parts[1:]:
            complete = complete & p.isNotNull()
        value = F.when(complete, F.concat_ws(" ", *parts))
    else:
        value = F.coalesce(*[row.text(f) for f in spec.split("|")])
    if default:
        value = F.coalesce(value, F.lit(default))
    return F.concat(F.lit(f"{label}: "), value) if label else value


def evidence_footer(row: _Row) -> Column:
    """The cited spans; an empty text, and so a trailing newline, where there are none."""
    cited = F.coalesce(row.list("evidence_span_ids"), row.text("evidence_id"))
    return F.coalesce(F.concat(F.lit("Evidence: "), cited), F.lit(""))


def text_of(record_type: str, columns: list[str], schema: T.StructType | None = None) -> Column:
    """The text of a record type over a table with these columns; nested ones are read by `schema`."""
    row = _Row(columns, schema)
    if record_type == "evidence_span":
        where = F.when(row["locator"].isNotNull(), F.concat(F.lit("Locator: "), F.coalesce(row["locator.kind"], F.lit("?")), F.lit("="), F.coalesce(row["locator.value"], F.lit("?"))))
        said = F.coalesce(F.concat(F.lit("Text: "), row.text("text_excerpt")), F.concat(F.lit("Text: [no excerpt; excerpt_policy="), F.coalesce(row.text("excerpt_policy"), F.lit("none")), F.lit("]")))
        head = F.concat(F.lit("Span "), F.coalesce(row.text("id"), F.lit("unknown")), F.lit(" in source "), F.coalesce(row.text("source_id"), F.lit("unknown")))
        return F.concat_ws("\n", head, where, said, F.concat(F.lit("Privacy: "), F.coalesce(row.text("privacy_class"), F.lit("internal"))))
    if record_type == "episode_record":
        time = F.concat(F.lit("Time: "), F.coalesce(row.text("event_time_start"), F.lit("unknown")), F.lit(" to "), F.coalesce(row.text("event_time_end"), F.lit("ongoing")))
        lines = [_line(row, t) for t in ("Episode: title", "Type: episode_type=unknown", "Source: source_id=unknown", "Summary: summary", "Actors: actors[]", "Topics: topics[]")]
        return F.concat_ws("\n", *lines, time, evidence_footer(row))
    if record_type == "context_pack":
        said = [row.text(f"task.{f}") for f in ("task_summary", "task_title", "task_type") if f in row.members("task")] or ([row.text("task")] if row.kind("task") == "string" else [])
        task = F.coalesce(*said) if said else F.lit(None).cast("string")
        # Lists of ids, or sections of such lists, whose ids then follow one another.
        memory, candidates = (_filled(F.array_join(row.ids(f), ", ")) for f in ("trusted_memory", "candidate_context"))
        trace = row.text("retrieval_trace") if row.kind("retrieval_trace") == "string" else _filled(F.array_join(row.ids("retrieval_trace"), "; "))
        lines = (("Task", task), ("Trusted memory", memory), ("Candidate context", candidates), ("Retrieval trace", trace))
        return F.concat_ws("\n", F.concat(F.lit("ContextPack: "), F.coalesce(row.text("pack_type"), F.lit("general"))), *[F.concat(F.lit(f"{label}: "), v) for label, v in lines])
    if record_type not in TEMPLATES:
        return generic_text(columns, schema=schema)
    return F.concat_ws("\n", *[evidence_footer(row) if t == "!evidence" else _line(row, t) for t in TEMPLATES[record_type]])


def _formatted(value: Column, kind: T.DataType | None) -> Column:
    """A value as text: lists joined by commas, without nulls; objects as JSON with sorted keys and blanks after , and :."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(F.array_compact(value), lambda x: _formatted(x, kind.elementType)), ", ")
    if isinstance(kind, (T.StructType, T.MapType)):
        return spaced_json(F.to_json(value, {"ignoreNullFields": "false"}))
    if isinstance(kind, T.BooleanType):
        return F.initcap(value.cast("string"))
    return value.cast("string")


@arrow_udf(T.StringType())
def spaced_json(text: pa.Array) -> pa.Array:
    """JSON texts with sorted keys and a blank after each comma and colon, which Spark's writer can't make."""
    return pa.array([None if t is None else json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False) for t in text.to_pylist()], pa.string())


def generic_text(columns: list[str], most: int = 50, schema: T.StructType | None = None) -> Column:
    """`field: value` lines by name of the first `most` fields; nulls are left out."""
    kind = lambda c: schema[c].dataType if schema is not None else None
    named = [F.concat(F.lit(f"{c}: "), _formatted(F.col(c), kind(c))) for c in sorted(columns[:most])]
    return F.concat_ws("\n", *named)


def truncated(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """struct(text, truncated): cut after the last sentence end among the last 200 characters, else hard.

    A sentence ends with . ! ? or a newline before a blank, another end or the end of the text.
    """
    if max_chars <= 0:
        raise ValueError("max_chars must be above 0")
    start = max(0, max_chars - BOUNDARY_WINDOW)
    head, tail = F.substring(text, 1, start), F.substring(text, start + 1, max_chars - start + 1)
    # One character beyond the cut decides whether an end at the cut is one.
    kept = F.regexp_extract(tail, r"(?s)^(.{0," + str(max_chars - start - 1) + r"}[.!?\n])(?=[\s.!?]|$)", 1)
    cut = F.when(kept != "", F.concat(head, kept)).otherwise(F.substring(text, 1, max_chars))
    short = F.length(text) <= max_chars
    return F.struct(F.when(short, text).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit(MARKER))).alias("text"), (~short).alias("truncated"))


def embedding_inputs(records: DataFrame, record_type: str, *, max_chars: int = MAX_CHARS) -> DataFrame:
    """(record_id, record_type, plane, privacy_class, text, truncated, char_count, content_hash_sha256, metadata).

    Records whose text is empty are left out.
    """
    from .classify import plane_of_type

    row = _Row(records.columns)
    plane, privacy, key = plane_of_type(F.lit(record_type)), F.coalesce(row.text("privacy_class"), F.lit("internal")), F.coalesce(row.text("id"), F.lit(""))
    extras = [x for f in METADATA if f in records.columns for x in (F.lit(f), row.text(f))]
    always = [F.lit("record_id"), key, F.lit("record_type"), F.lit(record_type), F.lit("privacy_class"), privacy, F.lit("plane"), plane]
    metadata = F.map_filter(F.create_map(*always, *extras), lambda k, v: v.isNotNull())
    out = records.select(key.alias("record_id"), privacy.alias("privacy_class"), metadata.alias("metadata"), truncated(text_of(record_type, records.columns, records.schema), max_chars).alias("t")).where("t.text <> ''")
    return out.select("record_id", F.lit(record_type).alias("record_type"), plane.alias("plane"), "privacy_class", "t.text", "t.truncated", F.length("t.text").alias("char_count"), F.sha2(F.col("t.text"), 256).alias("content_hash_sha256"), "metadata")


def distinct_texts(inputs: DataFrame) -> DataFrame:
    """(content_hash_sha256, record_id, copies): the least record of each text."""
    return inputs.groupBy("content_hash_sha256").agg(F.min("record_id").alias("record_id"), F.count("*").alias("copies"))


#: An embedding input as JSON, for storing it between runs.
INPUT = "record_id string, record_type string, plane string, privacy_class string, text string, truncated boolean, char_count int, content_hash_sha256 string, metadata map<string,string>"


def to_documents(inputs: DataFrame) -> DataFrame:
    """(doc): each embedding input as a JSON object."""
    return inputs.select(F.to_json(F.struct(*[c.split()[0] for c in INPUT.split(", ")]), {"ignoreNullFields": "false"}).alias("doc"))


def from_documents(docs: DataFrame) -> DataFrame:
    """The embedding inputs of JSON objects (doc); members that are missing get their defaults, others are ignored."""
    r = F.from_json("doc", INPUT)
    defaults = {"record_id": "", "record_type": "", "plane": "audit", "privacy_class": "internal", "text": "", "truncated": False, "char_count": 0, "content_hash_sha256": ""}
    values = [F.coalesce(F.col(f"r.{c}"), F.lit(v)).alias(c) for c, v in defaults.items()]
    return docs.select(r.alias("r")).select(*values, F.coalesce("r.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
