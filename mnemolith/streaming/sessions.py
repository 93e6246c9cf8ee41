"""Session memory: the latest turns of each session, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jsonschema import schema_errors
from ..schemas import json_schema


def latest_turns(turns: DataFrame, *, session: str, turn: str, keep: int) -> DataFrame:
    """The last `keep` turns of each session, in all columns; equal turns are decided by no rule beyond `turn`.

    Turns with a null session are left out. Spark turns the rank filter into a per-partition limit before
    the shuffle, so a hot session sends at most `keep` rows per task.
    """
    if keep < 1:
        raise ValueError("keep must be 1 or more")
    order = Window.partitionBy(session).orderBy(F.desc(turn))
    return turns.where(F.col(session).isNotNull()).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def merged(bundles: DataFrame, *, key: str = "id") -> DataFrame:
    """The first record per id over (bundle_ix, plane_ord, pos); ids that are null are left out."""
    order = F.struct("bundle_ix", "plane_ord", "pos")
    return bundles.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("doc", order).alias("doc"))


def turn_records(turns: DataFrame) -> DataFrame:
    """Turns (session_id, turn, input, output) as an episode and two spans each: (session_id, turn, kind, id, text)."""
    from ..functions.canonical import episode_id, sha256, source_id, span_id

    c = F.col
    ref = F.struct(F.lit("synthetic_fixture").alias("kind"), c("session_id").cast("string").alias("value"))
    a = turns.withColumn("src", source_id(F.lit("other"), F.lit(None).cast("string"), ref, sha256(c("session_id").cast("string"))))
    place = lambda part: F.struct(F.lit("message_range").alias("kind"), F.concat(c("turn").cast("string"), F.lit(part)).alias("value"))
    made = F.array(
        F.struct(F.lit("episode").alias("kind"), episode_id(c("src"), F.lit("conversation_segment"), place("")).alias("id"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("span").alias("kind"), span_id(c("src"), place(":input")).alias("id"), c("input").alias("text")),
        F.struct(F.lit("span").alias("kind"), span_id(c("src"), place(":output")).alias("id"), c("output").alias("text")),
    )
    return a.select("session_id", "turn", F.explode(made).alias("r")).select("session_id", "turn", "r.*")


# The members, in this order, of which the first that is a text is what a turn says.
SAID = ("input", "question", "human_input", "query", "text", "user_input", "prompt")


def said(value: Column) -> Column:
    """The text of a turn's value, given as JSON or as plain text.

    An object says the first of `SAID` that is a text, else all of it as JSON; a list says what its items
    say, one per line; anything else says itself.
    """
    plain = F.try_parse_json(value)
    kind = F.schema_of_variant(plain)

    def of(text: Column, item: Column, what: Column) -> Column:
        member = F.lit(None).cast("string")
        for name in reversed(SAID):
            inner = F.try_variant_get(item, f"$.{name}", "variant")
            member = F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(item, f"$.{name}", "string")).otherwise(member)
        return F.when(what.startswith("OBJECT"), F.coalesce(member, text)).when(what == "STRING", F.try_variant_get(item, "$", "string")).otherwise(text)

    items = F.from_json(value, "array<variant>")
    lines = F.transform(items, lambda v: of(F.to_json(v), v, F.schema_of_variant(v)))
    return F.when(kind.startswith("ARRAY"), F.array_join(lines, "\n")).when(kind.isNotNull(), of(value, plain, kind)).otherwise(value)


@dataclass(frozen=True)
class SessionPack:
    """What a session remembers: its latest turns, their spans and its source, all by session_id."""

    records: DataFrame
    evidence: DataFrame
    sources: DataFrame


def session_records(turns: DataFrame, *, captured_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, episodes, spans) of turns (session_id, turn, input, output) as whole rows.

    A session is one source, a turn one episode of it and two spans; inputs and outputs may be JSON.
    """
    from ..functions.canonical import episode_id, sha256, source_id, span_id

    c, none = F.col, F.lit(None).cast("string")
    ref = F.struct(F.lit("synthetic_fixture").alias("kind"), c("session_id").alias("value"))
    text = F.concat(F.lit("conversation-session:"), c("session_id"))
    rows = turns.where("session_id is not null").select(c("session_id").cast("string").alias("session_id"), c("turn").cast("bigint").alias("turn"), said(c("input").cast("string")).alias("input"), said(c("output").cast("string")).alias("output"))
    rows = rows.withColumn("source_id", source_id(F.lit("conversation"), none, ref, sha256(text)))
    sources = rows.select("session_id", "source_id").distinct().select(
        "session_id", c("source_id").alias("id"), F.lit("1.0.0").alias("schema_version"), F.lit("conversation").alias("source_type"), F.concat(F.lit("Conversation session "), c("session_id")).alias("title"),
        none.alias("origin_uri"), ref.alias("raw_ref"), sha256(text).alias("content_hash_sha256"), captured_at.alias("captured_at"), F.array(F.lit("user"), F.lit("assistant")).alias("participants"), F.lit("internal").alias("privacy_class"),
    )
    at = lambda kind: F.struct(F.lit(kind).alias("kind"), c("turn").cast("string").alias("value"))
    episode = episode_id(c("source_id"), F.lit("turn"), at("turn"))
    episodes = rows.select(
        "session_id", "turn", episode.alias("id"), F.lit("1.0.0").alias("schema_version"), "source_id", F.lit("turn").alias("episode_type"), at("turn").alias("episode_locator"),
        F.concat(F.lit("Turn "), c("turn").cast("string"), F.lit(" of session "), c("session_id")).alias("title"), F.substring(F.coalesce(F.when(c("output") != "", c("output")), c("input"), F.lit("")), 1, 200).alias("summary"),
        F.array(F.lit("user"), F.lit("assistant")).alias("actors"),
    )
    sides = F.explode(F.array(*[F.struct(F.lit(f"turn_{side}").alias("kind"), c(side).alias("text")) for side in ("input", "output")]))
    each = rows.select("session_id", "turn", "source_id", episode.alias("episode_id"), sides.alias("s"))
    place = F.struct(c("s.kind").alias("kind"), c("turn").cast("string").alias("value"))
    spans = each.select(
        "session_id", "turn", span_id(c("source_id"), place).alias("id"), F.lit("1.0.0").alias("schema_version"), "source_id", "episode_id", place.alias("locator"), c("s.text").alias("text_excerpt"), F.lit("verbatim").alias("excerpt_policy"),
        sha256(F.coalesce(c("s.text"), F.lit(""))).alias("span_hash_sha256"), F.lit("internal").alias("privacy_class"),
    )
    return sources, episodes, spans


def remembered(sources: DataFrame, episodes: DataFrame, spans: DataFrame, *, keep: int) -> SessionPack:
    """The last `keep` turns of each session, the spans of those turns, and the session's source."""
    latest = latest_turns(episodes, session="session_id", turn="turn", keep=keep)
    evidence = spans.join(latest.select(F.col("id").alias("episode_id")), "episode_id", "left_semi")
    return SessionPack(latest, evidence.select(spans.columns), sources)


def session_stream(turns: DataFrame, *, session: str, turn: str, text: str, keep: int) -> DataFrame:
    """A stream of (session, turn, text) updates: after each batch, the latest `keep` turns of the sessions it touched.

    The state per session is at most `keep` turns; late turns take their place by number.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            held += list(zip(b["turn"].astype(int), b["text"].astype(str), strict=True))
        held = sorted({t: x for t, x in held}.items())[-keep:]
        state.update(([int(t) for t, _ in held], [x for _, x in held]))
        yield pd.DataFrame({"session": key[0], "turn": [t for t, _ in held], "text": [x for _, x in held]})

    rows = turns.select(F.col(session).cast("string").alias("session"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("session is not null and turn is not null")
    return rows.groupBy("session").applyInPandasWithState(update, "session string, turn bigint, text string", "turns array<bigint>, texts array<string>", "update", "NoTimeout")


def validated_stream(spark: SparkSession, folder: str, schema: str | dict) -> DataFrame:
    """A stream over JSON-lines files as they arrive: (text, errors); no line raises."""
    rules = json_schema(schema) if isinstance(schema, str) else schema
    return spark.readStream.text(folder).select(F.col("value").alias("text"), schema_errors(F.col("value"), rules).alias("errors"))
