"""Best representative of each duplicate group.

Two operators. `survivors` builds one surviving record per group, field by field, by a stated order of
preference. `truths` is a latent two-sided quality model: expectation-maximisation infers how often each
source states what is true (sensitivity) and withholds what is false (specificity), and keeps every value
it judges true, so a field may keep several.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import trimmed
from ..session import cut

# Texts that only say that nothing is known, in lower case.
NO_VALUE = (
    "", "-", "--", "---", "?", "??", "???", ".", "...", "n/a", "na", "n.a.", "#n/a", "nan", "nil", "none", "null", "(none)", "(null)", "<none>", "<null>",
    "missing", "no data", "no value", "not available", "not applicable", "not known", "not set", "not specified", "tba", "tbc", "tbd", "to be decided",
    "to be determined", "unbekannt", "undefined", "unknown", "desconocido", "(unknown)", "<unknown>", "unspecified", "unset", "–", "—",
)


def has_value(text: Column) -> Column:
    """False for null, blank and texts that only say that nothing is known."""
    return F.coalesce(~F.lower(trimmed(text)).isin(*NO_VALUE), F.lit(False))


def survivors(variants: DataFrame, *, group: str, record: str, fields: Sequence[str], latest: Sequence[Column]) -> DataFrame:
    """(group, field_name, record, value): for each group and field the variant that supplies the value.

    Of the variants with a value in the field the one that is greatest by the numeric columns `latest`, in
    order, wins (null is least), then the smallest record id (null is last), then the smallest value. Fields
    without any value give no row, nor do rows without a group. Repeats make no difference. One map-side
    combined aggregation: a group with a third of all rows is reduced before the shuffle.
    """
    most = (1 << 63) - 1
    order = [F.coalesce(-c.cast("long"), F.lit(most)).alias(f"k{i}") for i, c in enumerate(latest)]
    ranked = variants.where(F.col(group).isNotNull()).select(
        F.col(group).alias("g"), F.struct(*order, F.col(record).isNull().alias("no_id"), F.col(record).alias("record")).alias("rank"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]
    )
    cells = ranked.select("g", "rank", F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f"f{i}").alias("value")) for i, f in enumerate(fields)])).alias("cell"))
    cells = cells.select("g", "rank", F.col("cell.name").alias("field_name"), F.col("cell.value").alias("value")).where(has_value(F.col("value")))
    best = cells.groupBy("g", "field_name").agg(F.min(F.struct("rank", "value")).alias("best"))
    return best.select(F.col("g").alias(group), "field_name", F.col("best.rank.record").alias(record), F.col("best.value").alias("value"))


def truths(variants: DataFrame, *, group: str, source: str, fields: Sequence[str], rounds: int = 8, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(facts, sources): facts (group, field_name, value, probability, is_true) and sources (source,
    sensitivity, specificity).

    A source with a record in the group and a value for the field affirms its own values and denies the
    others stated there. Facts with the same sources for and against them are one case, so a round of
    expectation-maximisation touches only the distinct cases. Nulls and texts without a value state
    nothing; values are compared after trimming and in lower case, and a value that repeats counts once
    per source. Empty tables give empty results.
    """
    stated = (
        variants.where(F.col(group).isNotNull() & F.col(source).isNotNull())
        .select(F.col(group).alias("g"), F.col(source).cast("string").alias("s"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
        .select("g", "s", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"f{i}").alias("v")) for i, f in enumerate(fields)])).alias("c"))
        .where(has_value(F.col("c.v")))
        .select("g", F.col("c.f").alias("f"), F.lower(trimmed(F.col("c.v"))).alias("v"), "s")
        .distinct()
    )
    voters = stated.groupBy("g", "f").agg(F.collect_set("s").alias("voters"))
    facts = stated.groupBy("g", "f", "v").agg(F.array_sort(F.collect_set("s")).alias("pro")).join(voters, ["g", "f"])
    facts = cut(facts.select("g", "f", "v", "pro", F.array_sort(F.array_except("voters", "pro")).alias("con")))
    cases = cut(facts.groupBy("pro", "con").agg(F.count("*").alias("n")))
    votes = cases.select("pro", "con", "n", F.explode(F.concat(F.transform("pro", lambda x: F.struct(x.alias("s"), F.lit(1).alias("o"))), F.transform("con", lambda x: F.struct(x.alias("s"), F.lit(0).alias("o"))))).alias("x")).select("pro", "con", "n", "x.s", "x.o")
    quality = votes.select("s").distinct().select("s", F.lit(0.7).alias("sens"), F.lit(0.7).alias("spec"))
    belief = None
    for _ in range(rounds):
        log_true = F.when(F.col("o") == 1, F.log("sens")).otherwise(F.log(1 - F.col("sens")))
        log_false = F.when(F.col("o") == 1, F.log(1 - F.col("spec"))).otherwise(F.log("spec"))
        belief = votes.join(quality, "s").groupBy("pro", "con").agg((1 / (1 + F.exp(F.sum(log_false - log_true)))).alias("p"))
        weighed = votes.join(belief, ["pro", "con"])
        # Beta(7, 3) priors keep a source that is rarely seen near the start values.
        quality = cut(
            weighed.groupBy("s").agg(
                ((F.sum(F.col("n") * F.col("p") * F.col("o")) + 7) / (F.sum(F.col("n") * F.col("p")) + 10)).alias("sens"),
                ((F.sum(F.col("n") * (1 - F.col("p")) * (1 - F.col("o"))) + 7) / (F.sum(F.col("n") * (1 - F.col("p"))) + 10)).alias("spec"),
            )
        )
    judged = facts.join(belief, ["pro", "con"]).select(F.col("g").alias(group), F.col("f").alias("field_name"), F.col("v").alias("value"), F.col("p").alias("probability"), (F.col("p") >= threshold).alias("is_true"))
    return judged, quality.select(F.col("s").alias(source), F.col("sens").alias("sensitivity"), F.col("spec").alias("specificity"))
