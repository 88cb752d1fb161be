"""Confusion counts, reports, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.spread import join_spread


def confusion_counts(df: DataFrame, label_col: str, predicted_col: str) -> DataFrame:
    """Long form: one row per pair that occurs."""
    return df.groupBy(F.col(label_col).alias("label"), F.col(predicted_col).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(df: DataFrame, label_col: str, predicted_col: str, classes: list) -> DataFrame:
    """One row per label, one column per class."""
    counts = [
        F.count_if(F.col(predicted_col) == c).alias(f"predicted_{c}") for c in classes
    ]
    return df.groupBy(F.col(label_col).alias("label")).agg(*counts)


def classification_report(df: DataFrame, label_col: str, predicted_col: str) -> DataFrame:
    """Precision, recall, f1 and support per class, their mean, the accuracy.

    Reads the rows once; everything after the confusion counts is as small as
    the squared number of classes.
    """
    counts = confusion_counts(df, label_col, predicted_col)
    marks = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").cast("string").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("called"),
                    F.when(F.col("label") == F.col("predicted"), F.col("n"))
                    .otherwise(0)
                    .alias("hits"),
                ),
                F.struct(
                    F.col("predicted").cast("string").alias("class"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("called"),
                    F.lit(0).cast("long").alias("hits"),
                ),
            )
        )
    )
    zero = F.lit(0.0)
    per_class = (
        marks.groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits"))
        .withColumn("precision", F.coalesce(F.try_divide("hits", "called"), zero))
        .withColumn("recall", F.coalesce(F.try_divide("hits", "support"), zero))
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(
                    2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
                ),
                zero,
            ),
        )
    )
    overall = per_class.agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.sum("support").alias("support"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
    )
    rows = [
        per_class.select("class", "precision", "recall", "f1", "support"),
        overall.select(F.lit("macro avg").alias("class"), "precision", "recall", "f1", "support"),
        overall.select(
            F.lit("accuracy").alias("class"),
            F.lit(None).cast("double").alias("precision"),
            F.lit(None).cast("double").alias("recall"),
            F.col("accuracy").alias("f1"),
            "support",
        ),
    ]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """``label, n, weight`` with ``weight = total / n``."""
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    everything = df.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("weight", everything / F.col("n"))


def with_class_weight(df: DataFrame, label_col: str) -> DataFrame:
    """Add the weight of each row's class."""
    weights = class_weights(df, label_col).select(F.col("label").alias(label_col), "weight")
    return join_spread(df, weights, [label_col])
