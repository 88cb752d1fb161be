"""Source country of a log line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ip_number(c: Column) -> Column:
    """Dotted address as BIGINT, NULL when an octet is above 255 or missing."""
    octets = F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    valid = (F.size(octets) == 4) & F.forall(octets, lambda x: (x >= 0) & (x <= 255))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    return F.when(valid, number)


def with_country(df: DataFrame, ip_col: str, ranges: DataFrame, out_col: str = "country") -> DataFrame:
    """Country of the narrowest range with ``start_ip <= ip <= end_ip``.

    Ranges are cut into the /16 blocks they touch, and a block becomes one row
    with its ranges, narrowest first.  So every row meets one block at most and
    never multiplies, also where ranges overlap.  Spark broadcasts the blocks or
    merges on them, whatever their size asks for, and splits a block that is
    hot.  Rows without an address or a range get ``not found``.
    """
    one = F.struct(
        (F.col("end_ip") - F.col("start_ip")).alias("width"),
        F.col("start_ip").alias("first"),
        F.col("end_ip").alias("last"),
        F.col("country").alias("name"),
    )
    blocks = (
        ranges.select(
            one.alias("range"),
            F.explode(F.sequence(F.shiftright("start_ip", 16), F.shiftright("end_ip", 16))).alias(
                "__block"
            ),
        )
        .groupBy("__block")
        .agg(F.array_sort(F.collect_list("range")).alias("__ranges"))  # of one block of addresses
    )
    left = df.withColumn("__ip", ip_number(F.col(ip_col))).withColumn(
        "__ip_block", F.shiftright("__ip", 16)
    )
    joined = left.join(blocks, F.col("__ip_block") == F.col("__block"), "left")
    fitting = F.filter("__ranges", lambda r: F.col("__ip").between(r["first"], r["last"]))
    return joined.withColumn(
        out_col, F.coalesce(F.get(fitting, F.lit(0))["name"], F.lit("not found"))
    ).drop("__ip", "__ip_block", "__block", "__ranges")
