"""Joins with one row per class or label, where a label may have nearly all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_spread(df: DataFrame, table: DataFrame, on: list[str], *, how: str = "left") -> DataFrame:
    """Join with a table that has one row per key, without meeting a hot key in one task.

    Rows are numbered off to as many groups as there are shuffle partitions, and
    every group gets its copy of the table, so a key's rows are dealt out evenly
    whatever its share.  A table that turns out to be small is broadcast by
    Spark instead.  Building the query runs nothing.
    """
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = table.withColumn("__group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = df.withColumn("__group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int"))
    return dealt.join(copies, [*on, "__group"], how).drop("__group")
