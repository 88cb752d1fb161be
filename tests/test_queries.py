"""Every registered query against its reference SQL, on the smallest tables."""

import os

import compare
import pytest
from conftest import SF_DIR

from packetloom.plans import QUERIES

WITH_SQL = sorted(n for n, q in QUERIES.items() if q.oracle is not None)
WITHOUT_SQL = sorted(n for n, q in QUERIES.items() if q.oracle is None)


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_reference_sql(spark, sf_dir, con, name):
    query = QUERIES[name]
    ours = compare.rows_of_spark(query.build(spark, sf_dir))
    problem = compare.difference(ours, compare.rows_of_duckdb(con, query.oracle))
    assert problem is None, problem
    assert ours[1], "no rows"
    if len(ours[1]) > 1:
        assert len(set(ours[1])) > 1, "all rows are the same"


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_returns_varied_rows(spark, sf_dir, name):
    _, rows = compare.rows_of_spark(QUERIES[name].build(spark, sf_dir))
    assert len(set(rows)) > 1


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    frame = entry.entry(spark)
    assert frame.columns == ["label", "feature", "hit_rows", "total_value"]
    assert frame.count() > 0


def test_every_rule_fires_on_some_rows_only(spark, sf_dir):
    for name in ("ips_rule_features", "weblog_rule_features", "training_rule_features"):
        _, rows = compare.rows_of_spark(QUERIES[name].build(spark, "/root/testdata/sf0.01"))
        columns = sorted(QUERIES[name].build(spark, sf_dir).columns)
        for i, c in enumerate(columns):
            if c in ("event_id", "label"):
                continue
            fired = sum(1 for r in rows if r[i] > 0)
            assert 0 < fired < len(rows), c


def test_names_are_plain():
    for name in QUERIES:
        assert name == os.path.basename(name) and "pipeline" not in name
