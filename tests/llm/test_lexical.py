"""Lexical search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from packetloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def scored(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 75 + 25 * sum(c.values()) * n // total
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out)


def documents(n):
    rng = np.random.default_rng(n)
    words = [f"w{i}" for i in range(300)] + ["Über", "ÄB", "日本", "x-y", "it's"]
    share = 1 / np.arange(1, len(words) + 1)
    share /= share.sum()
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=share))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(40)]  # equal scores
    docs += [(None, docs[3][1]), (3, docs[3][1]), (None, None), (n + 99, ""), (n + 98, "--- !"), (n + 97, "W1 " * 30_000)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(12)]
    items += [(3, docs[5][1]), (40, None), (41, "unknownterm"), (None, "W7 w7 w290"), (42, "?!")]
    return docs, items


@pytest.mark.parametrize(("k", "bucket", "block"), [(20, 64, 8_000_000), (3, 2048, 500)])
def test_best_documents(spark, monkeypatch, k, bucket, block):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    docs, items = documents(700)
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, length string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    found = [tuple(r) for r in lexical.best_documents(d, q, k=k).collect()]
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))
    # two queries share the id 3; null ids are last
    key = lambda r: ((r[0] is None, r[0] or 0), r[3], (r[2] is None, r[2] or 0))
    want = []
    for item in items:
        want += scored(docs, [item], k)
    assert sorted(map(key, found)) == sorted(map(key, want))
    assert order(r for r in found if r[0] != 3) == order(r for r in want if r[0] != 3)


def test_bounds_skip_documents():
    rng = np.random.default_rng(0)
    queries = lexical.Queries([" ".join(f"t{i}" for i in rng.choice(500, 20, replace=False)) for _ in range(10)])
    size = len(queries.index)
    queries.weigh(rng.integers(100, 9000, size))
    n = 4000
    sizes = rng.integers(1, 30, n)
    terms = np.concatenate([rng.choice(size, s, replace=False) for s in sizes])
    impact = rng.integers(100_000, 900_000, len(terms))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    squares = np.add.reduceat(impact.astype(float) ** 2 * queries.weights[terms], ends[:-1])
    order = np.argsort(-squares)
    best, rescored = lexical.Best(5, np.zeros(10, np.int64)), 0
    for k in range(0, n, 500):
        rows = order[k : k + 500]
        inside = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows])
        bucket_ends = np.concatenate([[0], np.cumsum(sizes[rows])])
        rescored += lexical.search_bucket(
            queries, best, (rows, np.zeros(500, bool)), np.sqrt(squares[rows]), bucket_ends, terms[inside], impact[inside]
        )
    for q in range(10):
        dense = np.zeros(size, np.int64)
        dense[queries.terms[q]] = queries.products[q]
        scores = np.add.reduceat(dense[terms] * impact, ends[:-1])
        top = np.lexsort((np.arange(n), -scores))[:5]
        assert best.docs[q].tolist() == top.tolist() and best.scores[q].tolist() == scores[top].tolist()
    assert rescored < 0.5 * 10 * n


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.best_documents(docs.limit(0), items).count() == 0
    assert lexical.best_documents(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.best_documents(docs, items).collect()] == scored([(1, "a b")], [(1, "a")], 20)
