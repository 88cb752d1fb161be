"""Merkle proofs against a tree built level by level."""

import hashlib

import pytest
from pyspark.sql import functions as F

from packetloom.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root and, for every node, the steps (left, right) to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            path.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def expected(rows):
    """{(id, source, leaf): (subroot, root, path)} of rows (id, source, text)."""
    groups = {}
    for i, source, text in rows:
        groups.setdefault(source, []).append((i is not None, i or 0, leaf([i, source, text])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    return {
        ((x[1] if x[0] else None), s, x[2]): (trees[s][0], root, path + above[k])
        for k, s in enumerate(names)
        for x, path in zip(sorted(groups[s]), trees[s][1], strict=True)
    }


ROWS = (
    [(i, "hot", f"text {i}") for i in range(800)]
    + [(i, None, "no source") for i in range(4)]
    + [(None, "ä", "no id"), (7, "ä", None), (8, "ä", ""), (9, "Z", "é\n" * 20_000)]
    + [(5000 + i, f"s{i}", "alone") for i in range(20)]
)


@pytest.mark.parametrize("digits", [5, 2])
def test_proofs_equal_the_tree(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, text string").repartition(5)
    docs = docs.withColumn("path", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("tree", F.lit("x"))
    docs = docs.withColumn("leaf", merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "text")]))
    found = merkle.proofs(docs, leaf="leaf", keep=["rank"]).withColumn(
        "folded", merkle.root_from(F.col("leaf"), F.col("path"))
    )
    got = found.collect()
    want = expected(ROWS)
    assert len(got) == len(ROWS) and {r["rank"] for r in got} == {1}
    for r in got:
        subroot, root, path = want[r.doc_id, r.source, r.leaf]
        assert (r.subroot, r.root, r.folded) == (subroot, root, root)
        assert [tuple(step) for step in r.path] == path


def test_repeated_rows_have_their_own_proofs(spark):
    docs = spark.createDataFrame([(1, "a", "same")] * 5 + [(1, "a", "other")], "doc_id long, source string, text string")
    docs = docs.withColumn("leaf", merkle.leaf_of(*[F.col(c) for c in docs.columns]))
    found = merkle.proofs(docs, leaf="leaf").collect()
    leaves = sorted(r.leaf for r in found)
    root, paths = tree(leaves)
    assert {r.root for r in found} == {root}
    assert sorted((r.leaf, [tuple(s) for s in r.path]) for r in found) == sorted(zip(leaves, paths, strict=True))


def test_a_changed_leaf_leads_elsewhere_and_no_rows_have_no_proofs(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, source string, text string")
    docs = docs.withColumn("leaf", merkle.leaf_of(*[F.col(c) for c in docs.columns]))
    found = merkle.proofs(docs, leaf="leaf")
    wrong = found.select((merkle.root_from(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("ok"))
    assert not any(r.ok for r in wrong.collect())
    assert merkle.proofs(docs.limit(0), leaf="leaf").count() == 0
    alone = merkle.proofs(docs.where("doc_id = 1"), leaf="leaf").first()
    assert alone.leaf == alone.subroot == alone.root and alone.path == []
