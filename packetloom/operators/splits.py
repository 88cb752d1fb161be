"""Reproducible splits and batch numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.spread import join_spread


def stratified_split(
    df: DataFrame, id_col: str, label_col: str | None, seed: str, test_percent: int
) -> DataFrame:
    """Add ``part`` (``train`` or ``test``) with exact quotas per label.

    Rows are ordered by a hash of id and seed; the first ``n * test_percent /
    100`` of a label (rounded down) are the test part.  Counts per hash bucket
    find the bucket that holds the border, and only that bucket is ranked, so a
    label with nearly all rows never meets in one task.  Buckets are found by
    label and bucket, borders are joined to the rows group by group; building
    the query runs nothing.
    """
    label = F.lit("all") if label_col is None else F.coalesce(F.col(label_col).cast("string"), F.lit(""))
    keyed = df.withColumn("__label", label).withColumn(
        "__hash", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)))
    )
    keyed = keyed.withColumn("__bucket", F.substring("__hash", 1, 4))
    narrow = keyed.select("__label", "__bucket", "__hash", F.col(id_col).alias("__id"))
    per_bucket = narrow.groupBy("__label", "__bucket").agg(F.count("*").alias("__n"))
    # at most 65536 rows per label
    by_label = Window.partitionBy("__label")
    up_to = by_label.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    borders = (
        per_bucket.withColumn("__upto", F.sum("__n").over(up_to))
        .withColumn("__quota", F.floor(F.sum("__n").over(by_label) * test_percent / 100))
        .where((F.col("__upto") >= F.col("__quota")) & (F.col("__upto") - F.col("__n") < F.col("__quota")))
        .select(
            "__label",
            "__bucket",
            (F.col("__quota") - (F.col("__upto") - F.col("__n"))).alias("__rest"),
        )
    )
    rank = F.row_number().over(Window.partitionBy("__label", "__bucket").orderBy("__hash", "__id"))
    last = (
        narrow.join(borders, ["__label", "__bucket"])
        .withColumn("__rank", rank)
        .where(F.col("__rank") == F.col("__rest"))
        .select("__label", F.struct("__hash", "__id").alias("__last"))
    )
    test = F.struct(F.col("__hash"), F.col(id_col).alias("__id")) <= F.col("__last")
    return (
        join_spread(keyed, last, ["__label"])
        .withColumn("part", F.when(F.coalesce(test, F.lit(False)), "test").otherwise("train"))
        .drop("__label", "__hash", "__bucket", "__last")
    )


def with_batch_number(
    df: DataFrame, order_col: str, size: int, *, n_ranges: int | None = None, out_col: str = "batch_no"
) -> DataFrame:
    """Number batches of ``size`` rows in the order of a numeric unique column.

    Rows are cut into ranges at approximate quantiles.  The row counts of the
    ranges before give each range its offset, so numbering runs in parallel and
    is exact wherever the cuts fall.
    """
    if n_ranges is None:
        n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / n_ranges for i in range(1, n_ranges)]
    cuts = sorted(set(df.approxQuantile(order_col, steps, 0.25 / n_ranges))) if steps else []
    edges = [float("-inf"), *(cuts or [0.0]), float("inf")]
    ranged = Bucketizer(splits=edges, inputCol="__order", outputCol="__range").transform(
        df.withColumn("__order", F.col(order_col).cast("double"))
    )
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    # as many rows as there are ranges
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    within = Window.partitionBy("__range").orderBy(order_col)
    numbered = ranged.withColumn("__row", F.row_number().over(within)).join(offsets, "__range")
    return numbered.withColumn(
        out_col, F.floor((F.col("__offset") + F.col("__row") - 1) / size)
    ).drop("__order", "__range", "__offset", "__row")
