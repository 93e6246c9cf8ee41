"""Differences between two copies of data (problem 7).

Every document is unpivoted where it is read, into (field, value) cells that hang on its row; values are
64-bit digests of their canonical JSON, so no text of a document leaves the task that reads it. One
exchange by key brings the last row of each copy together. Its cells then are rows again, with sign -1 or
+1; equal ones cancel in an aggregation that needs no further exchange, and what doesn't cancel is the
difference.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonvalue

#: The field under which a document that is no JSON object is compared as a whole.
WHOLE = "$"
_CELLS = pa.list_(pa.struct([("field", pa.string()), ("value", pa.int64())]))
_CELLS_DDL = "array<struct<field:string,value:bigint>>"


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _unpivot(batches):
    for batch in batches:
        offsets, fields, values = [0], [], []
        for doc in batch["doc"].to_pylist():
            record = jsonvalue.parse_object(doc)
            if record is None:
                # Kept apart from any JSON text.
                fields.append(WHOLE)
                values.append(_digest(f"\0{doc}"))
            else:
                fields += [f if f.isascii() else f.encode("utf-8", "replace").decode() for f in record]
                values += [_digest(jsonvalue.canonical(v)) for v in record.values()]
            offsets.append(len(fields))
        cells = pa.StructArray.from_arrays([pa.array(fields, pa.string()), pa.array(values, pa.int64())], names=["field", "value"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells)
        yield pa.RecordBatch.from_arrays([batch["key"], batch["pos"], batch["tie"], batch["sign"], lists.cast(_CELLS)], names=["key", "pos", "tie", "sign", "cells"])


def differences(left: DataFrame, right: DataFrame, *, key: str, doc: str, position: str, sides: tuple[str, str] = ("only_0", "only_1")) -> DataFrame:
    """(key, side, field): keys that one copy lacks (field '') and, for keys in both, each differing field.

    Per copy and key the row with the greatest `position` counts (a null position is the least, equal
    positions are decided by the greater hash of the document). Keys that are null are left out. A document
    that is null or no JSON object is compared as a whole, under the field `$`. An absent field differs from
    a null one. Values are equal if 64-bit digests of their canonical JSON are, which is compared within one
    key and field only. A key that repeats is combined on the map side, so a hot one is no hot task.
    """
    rows = None
    for copy, sign in ((left, -1), (right, 1)):
        part = copy.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(position).cast("bigint").alias("pos"), F.xxhash64(doc).alias("tie"), F.lit(sign).cast("int").alias("sign"), F.col(doc).alias("doc"))
        rows = part if rows is None else rows.unionByName(part)
    cells = rows.mapInArrow(_unpivot, f"key string, pos bigint, tie bigint, sign int, cells {_CELLS_DDL}")
    last = lambda sign: F.max(F.when(F.col("sign") == sign, F.struct("pos", "tie", "cells")))["cells"]
    both = cells.groupBy("key").agg(last(-1).alias("a"), last(1).alias("b"))
    # The cell of the key itself has no field; like any other it cancels where both copies have it.
    signed = lambda c, sign: F.when(F.col(c).isNotNull(), F.array_append(F.transform(c, lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), F.lit(sign).alias("sign"))), F.struct(F.lit(None).cast("string").alias("field"), F.lit(0).cast("bigint").alias("value"), F.lit(sign).alias("sign"))))
    empty = F.array().cast("array<struct<field:string,value:bigint,sign:int>>")
    rows = both.select("key", F.explode(F.concat(F.coalesce(signed("a", -1), empty), F.coalesce(signed("b", 1), empty))).alias("c")).select("key", "c.*")
    left_over = rows.groupBy("key", "field", "value").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    per_key = left_over.groupBy("key").agg(F.max(F.when(F.col("field").isNull(), F.col("sign"))).alias("side"), F.collect_set("field").alias("fields"))
    side: Column = F.when(F.col("side") < 0, sides[0]).when(F.col("side") > 0, sides[1]).otherwise("both")
    return per_key.select(
        F.col("key").alias(key), side.alias("side"), F.explode(F.when(F.col("side").isNotNull(), F.array(F.lit(""))).otherwise(F.array_sort("fields"))).alias("field")
    )
