"""Attributions of rows at the baseline."""

import math

from packetloom.operators import learn


def test_every_row_has_all_features(spark):
    rows = [(i, float(i % 2), float(i % 3), float(i % 2)) for i in range(60)]
    train = spark.createDataFrame(rows, "id long, a double, b double, y double")
    model = learn.fit_logistic(train, ["a", "b"], "y")
    test = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 1.0), (2, 1.0, 1.0)], "id long, a double, b double")
    found = learn.occlusion(model, test, ["id"], ["a", "b"], {"a": 0.0, "b": 1.0}).collect()
    assert sorted((r.id, r.feature) for r in found) == [(1, "a"), (1, "b"), *[(2, "a")] * 2, *[(2, "b")] * 2]
    p = {r.id: r.proba[1] for r in learn.score(model, test).collect()}
    for r in found:
        want = p[2] - p[1] if (r.id, r.feature) == (2, "a") else 0.0
        assert math.isclose(r.phi, want, abs_tol=1e-12)
