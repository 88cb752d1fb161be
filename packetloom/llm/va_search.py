"""Exact top-k search with vector-approximation files.

Vectors become whole numbers, ``floor(256 * x)``, and the score is the integer
inner product.  The candidates are cut into blocks.  A block carries for every
vector a coarse cell per component (its approximation) beside the exact vector.
A search scans the cells only and gets an upper and a lower bound of every
score; candidates whose upper bound is below the k-th largest lower bound are
out.  The exact vectors of the rest are read in the order of their upper bounds,
best first, until the k-th best score found lies above every bound left, so the
result is exact, ties included.

Queries are cut into blocks too, and each block of queries meets each block of
candidates in one row, so the work per task has a fixed size.  The k best of
every pair of blocks are merged by two grouped steps.

Cases: vectors that are null, empty, or hold a null or non-finite number take no
part, nor do rows with a null id.  Vectors of different lengths have no score
with each other.  A row is no candidate for the query with its own id.  Ties go
to the smaller id.  Equal rows that repeat an id count once.  Fewer than k candidates give fewer rows.  Components beyond
``LARGEST`` in size after scaling count as ``LARGEST``, which keeps every score
within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.llm.common import need, written

#: Vectors of a block of candidates and of a block of queries.
CANDIDATES = 4096
QUERIES = 512
#: Whole numbers of a component that share a cell.
CELL = 16
#: Exact vectors read at a time.
READ = 32
#: Largest size of a component.
LARGEST = 1 << 24


def quantised(vector: Column) -> Column:
    """``floor(256 * x)`` of every component."""
    bound = float(LARGEST)
    return F.transform(
        vector,
        lambda x: F.greatest(
            F.least(F.floor(x.cast("double") * 256).cast("double"), F.lit(bound)), F.lit(-bound)
        ).cast("int"),
    )


def _blocked(rows: DataFrame, blocks: str) -> DataFrame:
    """dims, block, ids, exact: the vectors of one length in that many blocks."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block, from runs of sorted rows."""
        open_key, ids, exact = None, [], []

        def flush():
            x = np.array(exact, np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([open_key[0]], pa.int32()),
                    pa.array([open_key[1]], pa.int32()),
                    pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                    pa.array([x.tobytes()], pa.binary()),
                ],
                ["dims", "block", "ids", "exact"],
            )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for dims, block, vec_id, q in zip(*columns, strict=True):
                if (dims, block) == open_key and vec_id == ids[-1] and q == exact[-1]:
                    continue
                if (dims, block) != open_key:
                    if ids:
                        yield flush()
                    open_key, ids, exact = (dims, block), [], []
                ids.append(vec_id)
                exact.append(q)
        if ids:
            yield flush()

    block = F.pmod(F.xxhash64("vec_id"), F.col(blocks)).cast("int").alias("block")
    return (
        rows.select("dims", block, "vec_id", "q")
        .repartition("dims", "block")
        .sortWithinPartitions("dims", "block", "vec_id")
        .mapInArrow(packed, "dims int, block int, ids binary, exact binary")
    )


def bounds(queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all queries with all cells."""
    low = cells.astype(np.float64) * CELL
    high = low + (CELL - 1)
    plus, minus = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


def block_search(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int
) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates in a block for each query."""
    cells = np.floor_divide(exact, CELL)
    lower, upper = bounds(queries.astype(np.float64), cells)
    own = query_ids[:, None] == ids[None, :]
    # bounds are sums of doubles; far outside the usual range they get some slack
    slack = np.maximum(1.0, np.abs(upper).max(initial=0.0) * 2.0**-40)
    lower[own], upper[own] = -np.inf, -np.inf
    for row, query_id in enumerate(query_ids):
        possible = len(ids) - int(own[row].sum())
        if not possible:
            continue
        wanted = min(k, possible)
        least = np.partition(lower[row], -wanted)[-wanted] - slack
        open_ = np.flatnonzero((upper[row] >= least) & ~own[row])
        open_ = open_[np.argsort(-upper[row, open_], kind="stable")]
        scores = np.empty(0, np.int64)
        for start in range(0, len(open_), READ):
            if len(scores) >= wanted:
                kth = np.partition(scores, -wanted)[-wanted]
                if kth > upper[row, open_[start]] + slack:
                    break
            part = exact[open_[start : start + READ]].astype(np.int64)
            scores = np.r_[scores, part @ queries[row].astype(np.int64)]
        found = ids[open_[: len(scores)]]
        for i in np.lexsort((found, -scores))[:wanted]:
            yield int(query_id), int(found[i]), int(scores[i])


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query row."""
    need(vectors, vec_id, vector)
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = written(
        vectors.where(F.col(vec_id).isNotNull() & (F.size(vector) > 0) & finite).select(
            F.col(vec_id).cast("long").alias("vec_id"),
            quantised(F.col(vector)).alias("q"),
            F.size(vector).alias("dims"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        ),
        "quantised",
    )
    # one row per length of vectors
    counts = written(
        rows.groupBy("dims").agg(
            F.ceil(F.count("*") / CANDIDATES).cast("int").alias("blocks"),
            F.ceil(F.count_if("asks") / QUERIES).cast("int").alias("query_blocks"),
        ),
        "block-counts",
    ).where(F.col("query_blocks") > 0)
    counted = rows.join(counts, "dims")
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    each_query = F.sequence(F.lit(0), F.col("query_blocks") - 1)
    candidates = (
        _blocked(counted, "blocks")
        .join(counts, "dims")
        .select("dims", "block", "ids", "exact", F.explode(each_query).alias("query_block"))
    )
    asking = (
        _blocked(counted.where("asks"), "query_blocks")
        .join(counts, "dims")
        .select(
            "dims",
            F.col("block").alias("query_block"),
            F.col("ids").alias("query_ids"),
            F.col("exact").alias("queries"),
            F.explode(each).alias("block"),
        )
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dims, ids, exact, query_ids, queries = (
                    batch.column(i)[row].as_py() for i in range(5)
                )
                found = list(
                    block_search(
                        np.frombuffer(query_ids, np.int64),
                        np.frombuffer(queries, np.int32).reshape(-1, dims),
                        np.frombuffer(ids, np.int64),
                        np.frombuffer(exact, np.int32).reshape(-1, dims),
                        k,
                    )
                )
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"]
                )

    # every pair of blocks is a key of its own, and each row a fixed amount of work
    pairs = candidates.join(asking, ["dims", "block", "query_block"])
    tasks = pairs.select("dims", "ids", "exact", "query_ids", "queries")
    found = tasks.mapInArrow(search, "query_id long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    # a query has k rows from each block of candidates: first the best of some, then of all
    some = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy(*order)
    every = Window.partitionBy("query_id").orderBy(*order)
    return (
        found.distinct()
        .withColumn("place", F.row_number().over(some))
        .where(F.col("place") <= k)
        .withColumn("rank", F.row_number().over(every))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
