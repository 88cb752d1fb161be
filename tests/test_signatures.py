"""Signatures against a search that tries every one at every place."""

import random
import time

import pytest
from pyspark.sql import functions as F

from packetloom.operators import signatures

SCHEMA = "pattern_no INT, pattern STRING, vendor STRING"


def plain(text, table):
    """First definition of the first pattern at the leftmost place, then behind it."""
    first = {}
    for no, pattern, vendor in sorted(table):
        if pattern:
            first.setdefault(pattern.lower(), (no, vendor))
    low = "".join(c.lower() if c < "\x80" else c for c in text)
    out, at = [], 0
    while at < len(low):
        here = [(no, key, vendor) for key, (no, vendor) in first.items() if low.startswith(key, at)]
        if here:
            _, key, vendor = min(here)
            out.append((len(out) + 1, text[at : at + len(key)], vendor))
            at += len(key)
        else:
            at += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, monkeypatch, seed):
    monkeypatch.setattr(signatures, "BITS", [64, 1 << 12, 1 << 22][seed])
    rng = random.Random(seed)
    letters = "aAbBé😀- "
    word = lambda low, high: "".join(rng.choices(letters, k=rng.randint(low, high)))
    table = [(i, word(1, 7), f"v{i}") for i in range(60)] + [(60, "AB", "again"), (61, "ab", "later"), (62, "", "no")]
    texts = [word(0, 60) for _ in range(150)] + ["", "ab" * 2_000, None]
    df = spark.createDataFrame([(i % 7, t, t) for i, t in enumerate(texts)], "id INT, t STRING, key STRING")
    out = signatures.signature_matches(df, "t", ["id", "key"], spark.createDataFrame(table, SCHEMA))
    got = sorted((r.id, r.key, r.detection_no, r.matched, r.vendor) for r in out.collect())
    want = sorted((i % 7, t, *m) for i, t in enumerate(texts) if t for m in plain(t, table))
    assert got == want


def test_many_signatures_and_none(spark):
    table = spark.range(300_000).selectExpr("CAST(id AS INT) AS pattern_no", "concat('sig-', hex(id * 7919), ';') AS pattern", "'v' AS vendor")
    texts = [(i, f"x sig-{i * 7919:X}; sig-{i:X}! SIG-{(i + 1) * 7919:x};") for i in range(50)]
    df = spark.createDataFrame(texts, "id INT, t STRING")
    found = signatures.signature_matches(df, "t", ["id"], table).where("vendor = 'v'").collect()
    assert len(found) == 100 and {r.detection_no for r in found} == {1, 2}
    assert signatures.signature_matches(df, "t", ["id"], table.limit(0)).count() == 0
    assert signatures.signature_matches(df.limit(0), "t", ["id"], table.limit(9)).count() == 0


def test_eight_million_characters_in_one_task(spark):
    table = spark.createDataFrame([(i, f"union select {i}", "v") for i in range(40)], SCHEMA)
    line = F.concat(F.lit("GET /item?x=union+select+1 "), F.repeat(F.sha2(F.col("id").cast("string"), 256), 6))
    df = spark.range(20_000).select("id", line.alias("t")).coalesce(1)
    hit = spark.range(3).select("id", F.lit("a Union Select 7").alias("t"))
    assert signatures.signature_matches(hit, "t", ["id"], table).count() == 3
    begin = time.time()
    assert signatures.signature_matches(df, "t", ["id"], table).count() == 0
    assert time.time() - begin < 6
