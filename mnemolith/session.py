"""Session conventions shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that one Python group or one sorted key may hold; group counts are derived from it.
ROWS_PER_GROUP = 200_000


def prepare(spark: SparkSession) -> SparkSession:
    """Zone-less time strings are UTC everywhere in this engine."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that a lost executor loses nothing.

    The folder is the cluster's `spark.checkpoint.dir`; only where that is unset (local tests) a
    temporary one is made.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mnemolith-"))
    return df.checkpoint()


def groups_for(rows: int, per_group: int = ROWS_PER_GROUP, least: int = 1, most: int = 1 << 20) -> int:
    """Number of hash groups that keeps each near `per_group` rows."""
    return max(least, min(most, -(-rows // per_group)))
