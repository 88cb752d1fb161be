"""Classes that only share lists by chance are neither clustered nor compared."""

import random

import numpy as np
import pyarrow as pa
import pytest

from packetloom.llm import minhash


def groups(i, j, n):
    root = list(range(n))
    for a, b in zip(i, j, strict=True):
        old, new = root[a], root[b]
        root = [new if r == old else r for r in root]
    return {frozenset(k for k in range(n) if root[k] == r) for r in set(root)}


def test_no_sets_of_unrelated_documents(spark, monkeypatch):
    made, write = {}, minhash.written

    def counted(df, name):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(minhash, "written", counted)
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghijkl", k=60)) for _ in range(minhash.PIECE + 100)]
    n = len(texts)
    rows = [*enumerate(texts), *((n + i, f"{texts[i]} z") for i in range(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs, words=3, percent=85).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i % n for i in range(n + 5)}
    assert made["sets"] == 10
    assert "cut" not in made


@pytest.mark.parametrize(("few", "seeds"), [(1, 1), (1, 64), (4, 3), (100, 64)])
def test_lists_connect_what_their_pairs_connect(monkeypatch, few, seeds):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "SEEDS", seeds)
    monkeypatch.setattr(minhash, "ROWS", 7)
    rng, n, least = np.random.default_rng(few + seeds), 200, 14
    marks = rng.integers(-128, 128, (9, minhash.HASHES))[rng.integers(0, 9, n)]
    other = rng.random(marks.shape) < rng.random((n, 1))
    marks = np.where(other, rng.integers(-128, 128, marks.shape), marks).astype(np.int8)
    lists = np.sort(rng.integers(0, 8, n) ** 2)
    agree = (marks[:, None] == marks[None]).sum(axis=2) >= least
    expected = groups(*np.nonzero(agree & (lists[:, None] == lists)), n)
    assert 8 < len(expected) < n

    i, j = minhash.agreeing(lists, marks, least)
    assert groups(i, j, n) == expected

    table = pa.table({"rep": np.arange(n), "list": lists, "mark": pa.array(marks.tolist(), pa.list_(pa.int8()))})
    out = pa.Table.from_batches(minhash._agreeing(least)(iter(table.to_batches(max_chunksize=10))))
    assert groups(out["a"].to_pylist(), out["b"].to_pylist(), n) == expected
    assert out.num_rows < 2 * n
