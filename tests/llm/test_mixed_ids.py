"""Mixing documents without ids, or with one id."""

import pytest
from pyspark.sql import functions as F

from packetloom.llm import mixing


def documents(spark, ids):
    rows = [(ids(i), "word " * (1 + i % 12) + str(i), "a") for i in range(500)]
    rows += [(1000 + i, "other " * (1 + i % 7) + str(i), "b") for i in range(700)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i % 2], ids=["none", "one", "two"])
def test_a_source_meets_its_target_whatever_its_ids(spark, ids):
    docs = documents(spark, ids)
    plan = mixing.mixing_plan(docs)
    counted = mixing.with_copies(docs, plan)
    taken = counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")
    )
    for r in taken.collect():
        assert abs(r.taken - r.target) <= 13, r
    again = mixing.with_copies(docs, mixing.mixing_plan(docs))
    assert not counted.exceptAll(again).count()


def test_newton_ends_on_tiny_and_uneven_sources(spark):
    rows = [(1, "one", "a"), (2, "w " * 50_000, "a"), (3, "one two", "b"), (4, "x", "c"), (5, None, None)]
    plan = mixing.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert plan.count() == 4
