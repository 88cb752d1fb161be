"""Exact quartiles of columns with any doubles."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from packetloom.operators import profile

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1023, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2)]
EDGES += [1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 8.0, math.nextafter(8.0, 0)]


def doubles(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        x = struct.unpack("<d", rng.randbytes(8))[0]
        if math.isfinite(x):
            out.append(x)
    return out


def test_keys_are_in_the_order_of_the_values(spark):
    values = sorted({*EDGES, *doubles(3000, 1), *(2.0**k for k in range(-1074, 1024)), *(-(3.0**k) for k in range(200))})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE")
    keys = [r[0] for r in df.orderBy("i").select(profile.order_key(F.col("v"))).collect()]
    assert all(a < b for a, b in zip(keys[:-1], keys[1:], strict=True))
    nan = spark.range(1).select(profile.order_key(F.lit(float("nan")))).first()[0]
    assert nan > keys[-1]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 1000, 20_001])
def test_quartiles_equal_the_built_in_ones(spark, n):
    small = random.Random(n)
    rows = [
        (v / 4, small.choice([0, 0, 0, 1]), i, small.gauss(0, 1e-3), None if i % 3 else i)
        for i, v in enumerate(doubles(n, n))
    ]
    names = ["wild", "flag", "distinct", "small", "holes"]
    df = spark.createDataFrame(rows, "wild DOUBLE, flag INT, distinct INT, small DOUBLE, holes INT").repartition(5)
    out = {r["feature"]: r for r in profile.describe(df, names).collect()}
    for name in names:
        want = df.select(F.percentile(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
        assert [out[name][q] for q in ("q25", "q50", "q75")] == pytest.approx(want, rel=1e-15), name


def test_a_column_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a INT, b INT")
    out = {r["feature"]: r for r in profile.describe(df, ["a", "b"]).collect()}
    assert out["a"]["q50"] == 1.5 and out["b"]["n"] == 0 and out["b"]["q50"] is None
    empty = profile.describe(df.limit(0), ["a"]).collect()
    assert empty[0]["n"] == 0 and empty[0]["q25"] is None
