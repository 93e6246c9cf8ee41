"""Queries of the training-text problems, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, prepare
from . import leakage, packing, spans, tokens


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def p8_packs(spark: SparkSession, sf: str) -> DataFrame:
    """Which pack of each container size every text, or piece of a text, is in."""
    sizes = {r[0]: r[1] for r in _table(spark, sf, "pack_capacity").select("capacity_name", "max_tokens").collect()}
    counted = cut(tokens.token_counts(_table(spark, sf, "documents"), item="doc_id", text="text"))
    return packing.packs(counted, sizes).withColumnsRenamed({"container": "capacity_name", "item": "doc_id"})


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Packs, tokens and share of used space per container size."""
    sizes = _table(spark, sf, "pack_capacity")
    used = p8_packs(spark, sf).groupBy("capacity_name").agg(F.count_distinct("pack").alias("packs"), F.sum("tokens").alias("tokens"))
    return used.join(sizes, "capacity_name").select("capacity_name", "packs", "tokens", F.round(F.col("tokens") / (F.col("packs") * F.col("max_tokens")), 6).alias("filled"))


def p8_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Per container size: texts packed, packs over capacity, texts cut without need or not whole, and whether
    all packs but one are, taken together, at least 99 % full."""
    sizes = _table(spark, sf, "pack_capacity")
    placed = cut(p8_packs(spark, sf))
    packs = placed.groupBy("capacity_name", "pack").agg(F.sum("tokens").alias("used")).join(sizes, "capacity_name")
    per_size = packs.groupBy("capacity_name").agg(
        F.count(F.when(F.col("used") > F.col("max_tokens"), 1)).alias("overfull"),
        (F.count("*") - 1 <= F.ceil(F.sum("used") / F.first("max_tokens")) * 1.01).alias("tight"),
    )
    texts = placed.groupBy("capacity_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("all"), F.max("piece").alias("last")).join(sizes, "capacity_name")
    needed = F.greatest(F.ceil(F.col("all") / F.col("max_tokens")), F.lit(1))
    per_text = texts.groupBy("capacity_name").agg(F.count("*").alias("texts"), F.count(F.when((F.col("pieces") != needed) | (F.col("last") != needed - 1), 1)).alias("cut_wrongly"))
    return per_size.join(per_text, "capacity_name").select("capacity_name", "texts", "overfull", "cut_wrongly", "tight")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf, "eval_item"), _table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).where("passage_words >= 15").select("item_id", "doc_id").distinct()


def p9_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Items of which a document holds half or more of the own wording, in whatever order."""
    return _leaks(spark, sf).where("coverage >= 0.5").groupBy("item_id", "doc_id").agg(F.round(F.max("coverage"), 6).alias("coverage"))


def p9_verbatim(spark: SparkSession, sf: str) -> DataFrame:
    """Items that a document holds as they are, in plain letters and digits: among the leaks all of them are found."""
    items, documents = _table(spark, sf, "eval_item"), _table(spark, sf, "documents")
    pairs = leakage.leaks(items, documents).where("passage_words >= 15").select("item_id", "doc_id").distinct()
    plain = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    held = pairs.join(items.select("item_id", plain(F.col("text")).alias("item")), "item_id").join(documents.select("doc_id", plain(F.col("text")).alias("body")), "doc_id")
    return held.where(F.contains("body", "item")).select("item_id", "doc_id").distinct()


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_chars(spans.shared_spans(_table(spark, sf, "documents")))


QUERIES = {f.__name__: f for f in (p8_packs, p8_fill, p8_quality, p9_found, p9_coverage, p9_verbatim, p10_found)}
#: Token counts and alignments are beyond SQL; tests compare them with brute force. For p10_found SQL takes every
#: window of every text, which whole tables allow up to sf0.1.
SQL: dict[str, str] = {
    "p8_quality": "select capacity_name, (select count(distinct doc_id) from documents) texts, cast(0 as bigint) overfull, cast(0 as bigint) cut_wrongly, true tight from pack_capacity",
    # Every item with 15 words of its own occurs nowhere as it is without being found.
    "p9_verbatim": """
with item as (select item_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' t from eval_item),
word as (select item_id, unnest(string_split(trim(t), ' ')) w, generate_subscripts(string_split(trim(t), ' '), 1) i from item),
gram as (select item_id, i, w || ' ' || lead(w) over (partition by item_id order by i) || ' ' || lead(w, 2) over (partition by item_id order by i) || ' ' || lead(w, 3) over (partition by item_id order by i) g from word),
common as (select g from gram where g is not null group by g having count(distinct item_id) > greatest(3, 0.1 * (select count(*) from eval_item))),
shared as (select item_id, unnest([i, i + 1, i + 2, i + 3]) i from gram where g in (select g from common)),
own as (select w.item_id, w.i - row_number() over (partition by w.item_id order by w.i) run from word w anti join shared s on s.item_id = w.item_id and s.i = w.i),
long as (select distinct item_id from own group by item_id, run having count(*) >= 15)
select distinct i.item_id, d.doc_id from item i join (select doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' t from documents) d on contains(d.t, i.t) where i.item_id in (select item_id from long) and length(i.t) > 2
""",
    "p10_found": """
with wide as (select doc_id, unnest(range(1, length(text) - 318)) i, text from documents where length(text) >= 320),
win as (select doc_id, i, md5(substr(text, i, 320)) h from wide),
shared as (select h from win group by h having count(distinct doc_id) > 1),
hit as (select doc_id, i, lead(i) over (partition by doc_id order by i) - i step from win where h in (select h from shared))
select doc_id, cast(sum(least(coalesce(step, 320), 320)) as bigint) shared_chars from hit group by doc_id
"""
}
