"""Neither side of a vector search passes through the driver."""

from __future__ import annotations

import numpy as np

from packetloom.operators import retrieve


def test_no_side_is_broadcast(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    found = retrieve.top_k_similar(df, df, k=2, query_id="id", corpus_id="id", exclude_same_id=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert "SortMergeJoin" in plan
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, retrieve.PLACES)
    np.fill_diagonal(scores, -2)
    best = {(i, r + 1): j for i, row in enumerate(scores) for r, j in enumerate(np.lexsort((np.arange(300), -row))[:2])}
    assert {(x["id"], x["rank"]): x["near_id"] for x in found.collect()} == best
