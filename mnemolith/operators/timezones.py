"""Mixed timestamp formats and time zones (problem 3).

Every value is parsed under all formats that fit it. A source is a mixture of formats; expectation-
maximisation over the counts of values per (source, set of fitting formats) finds its weights, and the
posterior chooses a reading for each value or marks it as ambiguous. `conventions` are formats known to
be used or unused, as a prior of one or nought.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import readings
from ..session import cut

#: Written as it should be; such values need no interpretation.
CANONICAL = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z\z"
# How the project writes dates (TESTDATA.md), as formats that are not used.
CONVENTIONS = {"dotted month first": 0.0, "slashed day first": 0.0, "dashed month first": 0.0}

_READINGS = "array<struct<format:string,us:bigint>>"
_ARROW = pa.list_(pa.struct([("format", pa.string()), ("us", pa.int64())]))


def _read(batches):
    for batch in batches:
        found = [[{"format": f, "us": u} for f, u in readings(v, z)] for v, z in zip(batch["value"].to_pylist(), batch["home"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], names=[*batch.schema.names, "readings"])


def mixture(cases: pd.DataFrame, prior: Mapping[str, float], rounds: int = 25) -> pd.DataFrame:
    """Posteriors of one source: `cases` has `formats` (a tuple that fits) and `n`."""
    names = sorted({f for fs in cases["formats"] for f in fs})
    weight = {f: prior.get(f, 1.0) / len(names) for f in names}
    share: list[dict[str, float]] = []
    for _ in range(rounds):
        share, total = [], dict.fromkeys(names, 0.0)
        for fs, n in zip(cases["formats"], cases["n"], strict=True):
            mass = sum(weight[f] for f in fs)
            share.append({f: weight[f] / mass for f in fs} if mass else {})
            for f, p in share[-1].items():
                total[f] += n * p
        # One imagined value per format keeps a weight above nought unless the prior rules it out.
        everything = sum(total.values()) + len(names)
        new = {f: (total[f] + 1) * (prior.get(f, 1.0) > 0) / everything for f in names}
        done = max((abs(new[f] - weight[f]) for f in names), default=0) < 1e-9
        weight = new
        if done:
            break
    # A value whose only readings are ruled out denotes nothing.
    rows = [(fs, max(s, key=lambda f: (s[f], f), default=None), max(s.values(), default=0.0)) for fs, s in zip(cases["formats"], share, strict=True)]
    return pd.DataFrame(rows, columns=["formats", "format", "posterior"])


def normalised(values: DataFrame, *, value: str, home: str, source: Sequence[str], conventions: Mapping[str, float] = CONVENTIONS, sure: float = 0.9) -> DataFrame:
    """`values` with `epoch_us`, `format`, `posterior` and `ambiguous`.

    `home` is the column with the zone of zone-less values. `epoch_us` is null where the value denotes no
    instant; `ambiguous` is true where several readings remain and none reaches the posterior `sure` (the
    likeliest one is still given). Columns of those names are replaced. Null and empty values denote nothing. Canonical values are read by
    Spark's own cast and never reach Python.
    """
    source, made = list(source), {"epoch_us", "format", "posterior", "ambiguous"}
    if made & {value, home, *source}:
        raise ValueError(f"columns named {sorted(made)} can't be read, they are made")
    values = values.drop(*made)
    kept = values.columns
    rows = values.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(kept)})
    place = {c: f"_{i}" for i, c in enumerate(kept)}
    v = F.col(place[value])
    instant = F.unix_micros(v.try_cast("timestamp"))
    # An impossible date denotes nothing, however well it is written.
    plain = rows.where(v.rlike(CANONICAL)).withColumns({"epoch_us": instant, "format": F.when(instant.isNotNull(), "canonical"), "posterior": F.when(instant.isNotNull(), 1.0)})
    other = rows.where(~F.coalesce(v.rlike(CANONICAL), F.lit(False))).withColumns({"value": v, "home": F.col(place[home])})
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in other.schema)}, readings {_READINGS}"
    read = cut(other.mapInArrow(_read, schema).drop("value", "home"))
    read = read.withColumn("formats", F.transform("readings", lambda r: r["format"]))
    src = F.struct(*[F.coalesce(F.col(place[c]).cast("string"), F.lit("")) for c in source])
    read = read.withColumn("source", F.to_json(src))
    cases = read.where(F.size("readings") > 0).groupBy("source", "formats").agg(F.count("*").alias("n"))

    def infer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["formats"] = [tuple(f) for f in pdf["formats"]]
        out = mixture(pdf, conventions)
        out["formats"] = [list(f) for f in out["formats"]]
        out.insert(0, "source", pdf["source"].iloc[0])
        return out

    model = cases.groupBy("source").applyInPandas(infer, "source string, formats array<string>, format string, posterior double")
    chosen = F.filter("readings", lambda r: r["format"] == F.col("format"))
    judged = read.join(model, ["source", "formats"], "left").withColumn("epoch_us", F.get(chosen, F.lit(0))["us"])
    out = plain.unionByName(judged.select(plain.columns))
    ambiguous: Column = F.coalesce(F.col("posterior") < sure, F.lit(False))
    return out.withColumn("ambiguous", ambiguous).withColumnsRenamed({p: c for c, p in place.items()})
