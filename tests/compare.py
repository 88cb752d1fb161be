"""Run a registered query and its reference SQL on the same tables."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return value + 0.0
    if hasattr(value, "tolist") and not isinstance(value, str):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, [tuple(plain(_row(r[c])) for c in columns) for r in df.collect()]


def _row(v):
    if hasattr(v, "asDict"):
        return {k: _row(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [_row(x) for x in v]
    return v


def rows_of_duckdb(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [
        tuple(plain(r[i]) for i in order) for r in result.fetchall()
    ]


def difference(spark_side, duck_side):
    """None when equal, else a short text."""
    (sc, sr), (dc, dr) = spark_side, duck_side
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"{len(sr)} rows != {len(dr)} rows"
    a, b = sorted(map(repr, sr)), sorted(map(repr, dr))
    if a == b:
        return None
    only_a = sorted(set(a) - set(b))[:2]
    only_b = sorted(set(b) - set(a))[:2]
    bad = len(set(a) - set(b))
    return f"{bad} rows differ\n   spark {only_a}\n   other {only_b}"


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    from packetloom.plans import QUERIES

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    chosen = [q for n, q in QUERIES.items() if not names or any(n.startswith(x) for x in names)]
    failed = 0
    for q in chosen:
        try:
            start = time.time()
            left = rows_of_spark(q.build(spark, sf_dir))
            spent = time.time() - start
            if q.oracle is None:
                print(f"rows {q.name} {len(left[1])} {spent:.1f}s", flush=True)
                continue
            start = time.time()
            right = rows_of_duckdb(con, q.oracle)
            other = time.time() - start
            problem = difference(left, right)
        except Exception as e:  # report and go on with the next query
            problem, spent, other, left = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0, ([], [])
        failed += problem is not None
        distinct = len(set(left[1])) if left[1] else 0
        print(
            f"{'ok  ' if problem is None else 'FAIL'} {q.name} {len(left[1])} rows "
            f"({distinct} distinct) {spent:.1f}s/{other:.1f}s {problem or ''}",
            flush=True,
        )
    print(f"{len(chosen)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
