"""Queries that need their features several times make them once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from packetloom.operators import features as feat
from packetloom.plans import QUERIES

NAMES = [
    "explanation_prompts",
    "explanation_top10",
    "explanation_sentences",
    "explanation_shares",
    "tree_attributions",
    "saved_model_scores",
    "boosted_tree_scores",
    "logistic_model_report",
]


@pytest.mark.parametrize("name", NAMES)
def test_features_are_computed_once_a_row(spark, sf_dir, name, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    plain = feat.rule_features

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    def counting(df, text_col, rules, **how):
        return plain(df.withColumn(text_col, counted.asNondeterministic()(text_col)), text_col, rules, **how)

    monkeypatch.setattr(feat, "rule_features", counting)
    QUERIES[name].build(spark, sf_dir).collect()
    assert seen.value == spark.read.parquet(f"{sf_dir}/events.parquet").count()
