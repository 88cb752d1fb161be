"""Ranked lexical search: the best documents for every query, exactly.

A term of a document counts by its impact, which grows with its occurrences and
falls with the length of the document; a term of a query by its weight, which
falls with the number of documents that hold it.  A score is the inner product
of the two, in integers.

One pass cuts the texts into terms and keeps those that some query holds, with
their occurrences; sums over it give the statistics and weights.  With the root
of a term's weight on both sides, a document is a vector of impacts and the
Cauchy-Schwarz inequality bounds a score by the product of two lengths.  The
vectors are ordered by length and cut into buckets of ``BUCKET``.  A query whose
length times the greatest length in a bucket stays below its k-th best score so
far skips the bucket.  Inside a bucket, the heaviest terms of the query are
taken until a document without any of them cannot reach that score; a document
that holds one is bounded by its products in them plus the remaining lengths,
and what the bound leaves is scored in integers.  The longest ``1 / FIRST`` of
the documents are searched first, on all tasks; their k-th scores are where the
tasks over the others begin.  Bounds are widened by ``SLACK`` for rounding.

Queries are taken in blocks of about ``BLOCK_BYTES`` of text, so the terms that
are sent to the tasks are bounded; each block reads the documents.  Documents
of equal length are dealt out by a hash, so copies are spread.

Cases: a null or empty text, or one without terms, has no terms: such documents
and queries are not found and find nothing.  Texts are read whole.  Equal scores
are ordered by id, null ids last.  Rows that repeat an id are documents and
queries of their own.  Empty tables give an empty result.  Other columns are
left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.llm.common import need, written

#: Documents of a bucket.
BUCKET = 2048
#: One of so many documents, the longest, is searched first.
FIRST = 32
#: Text of a block of queries, about.
BLOCK_BYTES = 8_000_000
#: Relative rounding error that bounds allow for.
SLACK = 1e-9

#: Every byte that is no letter, digit or part of a longer character becomes a space.
_FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impact of terms that occur ``tf`` times in documents of ``n`` terms."""
    lengths, places = np.unique(n, return_inverse=True)
    m = np.array([75 + 25 * x * documents // total for x in lengths.tolist()], np.int64)[places]
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Queries:
    """A block of queries: their terms, and after ``weigh`` their vectors."""

    def __init__(self, texts: list[str | None]) -> None:
        counted = [Counter(terms_of((t or "").encode())) for t in texts]
        self.index = {term: i for i, term in enumerate(sorted(set().union(*counted)))}
        self.counts = [{self.index[t]: c for t, c in q.items()} for q in counted]

    def weigh(self, weights: np.ndarray) -> None:
        self.weights = weights
        roots = np.sqrt(weights)
        self.terms, self.values, self.products, self.rests = [], [], [], []
        for counts in self.counts:
            terms = np.array([t for t in counts if weights[t] > 0], np.int64)
            repeats = np.array([counts[t] for t in terms.tolist()], np.int64)
            values = repeats * roots[terms]
            order = np.argsort(-values, kind="stable")
            terms, repeats, values = terms[order], repeats[order], values[order]
            self.terms.append(terms)
            self.values.append(values)
            self.products.append(repeats * weights[terms])
            tail = np.concatenate([np.cumsum((values**2)[::-1])[::-1], [0.0]])
            self.rests.append(np.sqrt(tail))  # length of what is left after the first f terms


class Best:
    """The k best documents of every query so far, and the score to reach."""

    def __init__(self, k: int, reach: np.ndarray) -> None:
        self.k, self.reach = k, reach.copy()
        self.scores = [np.empty(0, np.int64) for _ in reach]
        self.docs = [np.empty(0, np.int64) for _ in reach]
        self.missing = [np.empty(0, bool) for _ in reach]

    def add(self, q: int, scores: np.ndarray, docs: np.ndarray, missing: np.ndarray) -> None:
        scores = np.concatenate([self.scores[q], scores])
        docs = np.concatenate([self.docs[q], docs])
        missing = np.concatenate([self.missing[q], missing])
        order = np.lexsort((docs, missing, -scores))[: self.k]
        self.scores[q], self.docs[q], self.missing[q] = scores[order], docs[order], missing[order]
        if len(order) == self.k:
            self.reach[q] = max(self.reach[q], scores[order[-1]])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(s) for s in self.scores]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)),
                pa.array(np.concatenate(self.docs), mask=np.concatenate(self.missing)),
                pa.array(np.concatenate(self.scores)),
            ],
            ["query", "doc_id", "score"],
        )


def search_bucket(
    queries: Queries,
    best: Best,
    docs: tuple[np.ndarray, np.ndarray],
    lengths: np.ndarray,
    ends: np.ndarray,
    terms: np.ndarray,
    impact: np.ndarray,
) -> int:
    """Documents by falling length, the i-th with terms[ends[i]:ends[i + 1]]; returns rescored rows."""
    size, rescored = len(lengths), 0
    owner = np.repeat(np.arange(size), np.diff(ends))
    order = np.argsort(terms, kind="stable")
    posted, at, value = terms[order], owner[order], impact[order] * np.sqrt(queries.weights[terms[order]])
    wide = 1 + SLACK
    dense = np.zeros(len(queries.weights), np.int64)
    for q, (own, values, products, rests) in enumerate(
        zip(queries.terms, queries.values, queries.products, queries.rests, strict=True)
    ):
        reach = best.reach[q]
        if not len(own) or rests[0] * lengths[0] * wide < reach:
            continue
        # the fewest terms without which no document of the bucket reaches the score
        f = int(np.argmax(rests * lengths[0] * wide < max(reach, 1)))
        low, high = np.searchsorted(posted, own[:f]), np.searchsorted(posted, own[:f], "right")
        if not (high > low).any():
            continue
        spans = [slice(a, b) for a, b in zip(low, high, strict=True)]
        places = np.concatenate([at[s] for s in spans])
        found = np.concatenate([value[s] for s in spans])
        times = np.repeat(values[:f], high - low)
        dot = np.bincount(places, found * times, size)
        rest = np.maximum(lengths**2 * wide - np.bincount(places, found**2, size), 0)
        bound = (dot + rests[f] * np.sqrt(rest)) * wide
        open_ = np.flatnonzero((dot > 0) & (bound >= reach))
        if not len(open_):
            continue
        rescored += len(open_)
        sizes = ends[open_ + 1] - ends[open_]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inside = np.repeat(ends[open_] - first, sizes) + np.arange(sizes.sum())
        dense[own] = products
        scores = np.add.reduceat(dense[terms[inside]] * impact[inside], first)
        dense[own] = 0
        good = (scores > 0) & (scores >= reach)
        best.add(q, scores[good], docs[0][open_][good], docs[1][open_][good])
    return rescored


def _counted(docs: DataFrame, sent, doc_id: str, text: str) -> DataFrame:
    """doc_id, n, terms, tfs: terms of the queries in every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.index.get
        for batch in batches:
            n, ends, flat, counts = [], [0], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(raw) if raw else []
                known = np.array([i for i in map(get, words) if i is not None], np.int32)
                known, tf = np.unique(known, return_counts=True)
                n.append(len(words))
                ends.append(ends[-1] + len(known))
                flat.append(known)
                counts.append(tf)
            offsets = pa.array(ends, pa.int32())
            empty = [np.empty(0, np.int32)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat + empty))),
                    pa.ListArray.from_arrays(
                        offsets, pa.array(np.concatenate(counts + empty).astype(np.int32))
                    ),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = "doc_id long, n long, terms array<int>, tfs array<int>"
    return written(rows.mapInArrow(count, kind), "terms")


def _holding(counted: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the queries."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(held)], ["term", "held"])

    out = np.zeros(size, np.int64)
    held = counted.select("terms").mapInArrow(sums, "term long, held long").groupBy("term")
    for term, n in held.agg(F.sum("held")).collect():  # one row per term of the block of queries
        out[term] = n
    return out


def _unpacked(batch: pa.RecordBatch, documents: int, total: int):
    terms, tfs = batch["terms"], batch["tfs"]
    ends = terms.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(ends)
    flat = terms.flatten().to_numpy().astype(np.int64)
    n = np.repeat(batch["n"].to_numpy(), sizes)
    return ends - ends[0], flat, impacts(tfs.flatten().to_numpy().astype(np.int64), n, documents, total)


def _found(rows: DataFrame, sent, k: int, documents: int, total: int) -> DataFrame:
    """query, doc_id, score: the best of every task, from rows ordered by falling length."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, reach = sent.value
        best = Best(k, reach)
        held: list[pa.RecordBatch] = []

        def run() -> None:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ends, terms, impact = _unpacked(batch, documents, total)
            ids = batch["doc_id"]
            docs = (ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
            search_bucket(queries, best, docs, batch["length"].to_numpy(), ends, terms, impact)
            held.clear()

        for batch in batches:
            while batch.num_rows:
                room = BUCKET - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == BUCKET:
                    run()
        if held:
            run()
        yield best.rows()

    return rows.mapInArrow(search, "query int, doc_id long, score long")


def _best_of_block(docs: DataFrame, items: list, k: int, doc_id: str, text: str) -> DataFrame:
    """item_id, rank, doc_id, score for the queries (item_id, text) of one block."""
    spark = docs.sparkSession
    queries = Queries([t for _, t in items])
    counted = _counted(docs, spark.sparkContext.broadcast(queries), doc_id, text)
    row = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    documents, total = row[0], max(row[1] or 0, 1)
    held = _holding(counted, len(queries.index))
    queries.weigh(np.array([weight(documents, int(h)) for h in held], np.int64))
    weights = queries.weights

    @F.arrow_udf("double")
    def length(n: pa.Array, terms: pa.Array, tfs: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([n, terms, tfs], ["n", "terms", "tfs"])
        ends, flat, impact = _unpacked(batch, documents, total)
        sums = np.concatenate([[0.0], np.cumsum(impact.astype(float) ** 2 * weights[flat])])
        # a difference of sums may be off by the rounding of the greater one
        slack = np.where(np.diff(ends) > 0, sums[-1] * 1e-15 * max(len(flat), 1), 0)
        return pa.array(np.sqrt(np.diff(sums[ends]) + slack))

    measured = counted.where(F.size("terms") > 0).withColumn("length", length("n", "terms", "tfs"))
    measured = written(measured, "lengths")
    cut = measured.agg(F.percentile_approx("length", 1 - 1 / FIRST)).first()[0] or 0.0

    def ordered(rows: DataFrame) -> DataFrame:
        order = [F.desc("length"), F.xxhash64("doc_id", F.monotonically_increasing_id())]
        return rows.repartitionByRange(*order).sortWithinPartitions(F.desc("length"))

    def search(rows: DataFrame, reach: np.ndarray, name: str) -> DataFrame:
        sent = spark.sparkContext.broadcast((queries, reach))
        return written(_found(ordered(rows), sent, k, documents, total), name)

    reach = np.zeros(len(items), np.int64)
    first = search(measured.where(F.col("length") >= cut), reach, "first-found")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    for query, score in kth.select("query", "score").collect():  # one row per query of the block
        reach[query] = score
    others = search(measured.where(F.col("length") < cut), reach, "found")
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], "query int, item_id long")
    return (
        first.unionAll(others)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .join(names, "query")
        .select("item_id", "rank", "doc_id", "score")
    )


def best_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every query with a score above 0."""
    need(docs, doc_id, text)
    need(items, item_id, item_text)
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        block = [(r.item_id, r.text) for r in asked.where(number == b).collect()]  # BLOCK_BYTES, about
        if block:
            found = found.unionAll(_best_of_block(docs, block, k, doc_id, text))
    return found
