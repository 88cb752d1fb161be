"""Derived texts are made on all cores, however the files are cut."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from packetloom.sources.fixtures import fixture

VIEWS = ["traffic", "weblogs", "pii_text", "edr_events"]


@pytest.mark.parametrize("name", VIEWS)
def test_one_row_group_is_dealt_to_all_cores(spark, sf_dir, name):
    events = pq.ParquetFile(f"{sf_dir}/events.parquet").metadata
    assert events.num_row_groups == 1
    rows = fixture(spark, sf_dir, name).groupBy(F.spark_partition_id().alias("p")).count().collect()
    counts = [r["count"] for r in rows]
    assert sum(counts) == events.num_rows
    assert len(counts) >= spark.sparkContext.defaultParallelism
    assert max(counts) <= 1.5 * sum(counts) / len(counts)
