"""Counts and summaries of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.sources.scratch import scratch_path


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(
        *(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns),
        F.count("*").alias("n_rows"),
    )


#: Smallest normal double, and the exponent that its order key starts from.
_LEAST_NORMAL = 2.0**-1022
#: Bits of the order key that one narrowing settles: 2^16 counts per place at most.
_BITS = 16


def order_key(value: Column) -> Column:
    """A LONG in the order of a double: sign, exponent and fraction as one number.

    Distinct doubles have distinct keys.  NaN is the greatest; both zeros are one.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    # the logarithm may round up or down to the next power
    low = guess - F.when(F.pow(F.lit(2.0), guess) > size, 1).otherwise(0)
    exponent = low + F.when(F.pow(F.lit(2.0), low + 1) <= size, 1).otherwise(0)
    fraction = (size / F.pow(F.lit(2.0), exponent) * 2.0**52).cast("long") - F.lit(2**52)
    normal = (exponent + 1023) * F.lit(2**52) + fraction
    # small numbers in two steps, as 2^1074 is no double
    tiny = (size * 2.0**1022 * 2.0**52).cast("long")
    key = F.when(size < _LEAST_NORMAL, tiny).otherwise(normal)
    key = F.when(size == float("inf"), F.lit(2047 * 2**52)).otherwise(key)
    signed = F.when(value < 0, -key).otherwise(key)
    return F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise(signed)


def order_statistics(counted: DataFrame, places: DataFrame) -> DataFrame:
    """``feature, place, value``: the values at places (from 0) of the sorted columns.

    ``counted`` has ``feature, value DOUBLE, freq``, ``places`` a few rows per
    feature of ``feature, place``.  The order key is settled 16 bits at a time:
    counts per digit tell which digit holds a place, and only values with that
    digit are counted again.  No column is sorted or gathered; what is joined
    to the values has one row per feature and wanted place at most.
    """
    values = counted.withColumn("key", order_key(F.col("value")))
    ahead = F.collect_list(F.struct("place", F.col("place").alias("rest")))
    state = places.groupBy("feature").agg(ahead.alias("wanted")).withColumn("prefix", F.lit(None).cast("long"))
    for shift in range(64 - _BITS, -1, -_BITS):
        prefix = F.shiftright("key", shift)
        before = F.lit(None).cast("long") if shift == 64 - _BITS else F.shiftright("key", shift + _BITS)
        digits = (
            values.select("feature", "value", "freq", before.alias("prefix"), prefix.alias("digit"))
            .alias("v")
            .join(
                F.broadcast(state).alias("s"),
                (F.col("v.feature") == F.col("s.feature")) & F.col("v.prefix").eqNullSafe(F.col("s.prefix")),
            )
            .groupBy("v.feature", "v.prefix", "digit", "wanted")
            .agg(F.sum("freq").alias("n"), F.min("value").alias("value"))
        )
        # at most 2^16 rows per feature and prefix
        order = Window.partitionBy("feature", "prefix").orderBy("digit")
        upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        here = F.filter(
            "wanted", lambda w: (w["rest"] >= F.col("upto") - F.col("n")) & (w["rest"] < F.col("upto"))
        )
        left = F.transform(
            here,
            lambda w: F.struct(w["place"].alias("place"), (w["rest"] - (F.col("upto") - F.col("n"))).alias("rest")),
        )
        state = (
            digits.withColumn("upto", upto)
            .select("feature", F.col("digit").alias("prefix"), left.alias("wanted"), "value")
            .where(F.size("wanted") > 0)
        )
        found, state = state, state.drop("value")
    return found.select("feature", "value", F.explode("wanted.place").alias("place"))


def quartiles(counted: DataFrame) -> DataFrame:
    """``feature, q25, q50, q75`` of counted values, between two neighbours in proportion."""
    shares = F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75)))
    n = counted.groupBy("feature").agg(F.sum("freq").alias("n"))
    at = n.select("feature", F.posexplode(F.transform(shares, lambda p: p * (F.col("n") - 1))).alias("q", "at"))
    places = at.select("feature", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("place"))
    found = order_statistics(counted, places.distinct())
    value_at = F.map_from_entries(F.collect_list(F.struct("place", "value")))
    by_feature = found.groupBy("feature").agg(value_at.alias("values")).join(n, "feature")

    def quartile(p: float) -> Column:
        place = F.lit(p) * (F.col("n") - 1)
        below, above = F.col("values")[F.floor(place)], F.col("values")[F.ceil(place)]
        between = (F.ceil(place) - place) * below + (place - F.floor(place)) * above
        return F.when(below == above, below).otherwise(between)

    return by_feature.select(
        "feature", quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75")
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with exact quartiles.

    The values of each column are counted first, and the counts written to the
    shared folder, so that the rows of ``df`` are made once.  Number, mean,
    deviation and limits follow from values and frequencies; ``order_statistics``
    finds the values at the quartiles, whether they are few or all different.
    A column without values has a row with ``n`` 0.
    """
    spark = df.sparkSession
    cells = F.array(
        *(
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
            for c in columns
        )
    )
    path = scratch_path(spark, "value-counts")
    (
        df.select(F.inline(cells))
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count("*").alias("freq"))
        .write.parquet(path)
    )
    counted = spark.read.schema("feature STRING, value DOUBLE, freq LONG").parquet(path)
    # one row per column
    first = counted.groupBy("feature").agg(
        F.sum("freq").alias("n"),
        (F.sum(F.col("value") * F.col("freq")) / F.sum("freq")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    off = F.col("value") - F.col("mean")
    squares = (
        counted.join(F.broadcast(first.select("feature", "mean")), "feature")
        .groupBy("feature")
        .agg(F.sum(off * off * F.col("freq")).alias("squares"))
    )
    names = spark.range(1).select(F.explode(F.array(*(F.lit(c) for c in columns))).alias("feature"))
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
    return (
        names.join(first, "feature", "left")
        .join(squares, "feature", "left")
        .join(quartiles(counted), "feature", "left")
        .select(
            "feature",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.round("mean", 6).alias("mean"),
            F.round(spread, 6).alias("std"),
            *["min", "q25", "q50", "q75", "max"],
        )
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
