"""Chunks of long texts, vectors of texts, nearest neighbours."""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.vectorize import counted

# --- chunks -----------------------------------------------------------------


def merge_pieces(pieces: list[str], joiner: str, size: int, overlap: int) -> list[str]:
    """Fill chunks up to ``size`` characters; start the next with the overlap."""
    chunks: list[str] = []
    held: deque[str] = deque()
    length = 0

    def emit() -> None:
        text = joiner.join(held).strip()
        if text:
            chunks.append(text)

    for piece in pieces:
        if held and length + len(joiner) + len(piece) > size:
            emit()
            # keep a tail no longer than the overlap that leaves room for the piece
            while held and (length > overlap or length + len(joiner) + len(piece) > size):
                length -= len(held.popleft()) + (len(joiner) if held else 0)
        length += len(piece) + (len(joiner) if held else 0)
        held.append(piece)
    emit()
    return chunks


def chunks(
    df: DataFrame,
    text_col: str,
    ids: list[str],
    *,
    separator: str,
    size: int,
    overlap: int = 0,
    keep_separator: bool = False,
) -> DataFrame:
    """``ids, chunk_no, chunk``.

    The separator is a regular expression when it is kept (at the start of the
    piece behind it), else plain text.  The split happens in Spark; only the
    greedy filling, which depends on the piece before, runs row-wise in Arrow
    batches.
    """
    text = F.col(text_col)
    if keep_separator:
        pieces = F.split(text, f"(?={separator})")
        joiner = ""
    else:
        pieces = F.split(text, "".join("\\" + c if not c.isalnum() and ord(c) > 32 else c for c in separator))
        joiner = separator
    pieces = F.filter(pieces, lambda p: p != "")

    @F.pandas_udf("array<string>")
    def fill(column: pd.Series) -> pd.Series:
        return column.map(lambda p: None if p is None else merge_pieces(list(p), joiner, size, overlap))

    return df.select(*ids, F.posexplode(fill(pieces)).alias("__at", "chunk")).select(
        *ids, (F.col("__at") + 1).alias("chunk_no"), "chunk"
    )


def halves(df: DataFrame, text_col: str, ids: list[str], limit: int) -> DataFrame:
    """Cut texts in half, again and again, until no piece is above the limit.

    Works on positions, the text itself is copied once per final piece.
    """
    length = F.length(text_col)
    rounds = F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(float(limit)))).cast("int") + 1)

    def span(start: Column, size: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), size.cast("int").alias("size"))

    def cut(s: Column) -> Column:
        first = F.floor(s["size"] / 2)
        return F.when(s["size"] <= limit, F.array(s)).otherwise(
            F.array(
                span(s["start"], first),
                span(s["start"] + first, s["size"] - first),
            )
        )

    spans = F.aggregate(
        F.when(rounds > 0, F.sequence(F.lit(1), rounds)).otherwise(F.array().cast("array<int>")),
        F.array(span(F.lit(1), length)),
        lambda acc, _: F.flatten(F.transform(acc, cut)),
    )
    return (
        df.where(F.col(text_col).isNotNull())
        .select(*ids, text_col, F.posexplode(spans).alias("__at", "__s"))
        .select(
            *ids,
            (F.col("__at") + 1).alias("piece_no"),
            F.substr(F.col(text_col), F.col("__s.start"), F.col("__s.size")).alias("piece"),
        )
    )


# --- vectors ----------------------------------------------------------------


def hashed_counts(c: Column, size: int = 64) -> Column:
    """Word counts hashed into ``size`` cells, for texts without embeddings."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    cells = F.transform(
        words, lambda w: (F.conv(F.substr(F.md5(w), F.lit(1), F.lit(4)), 16, 10).cast("int") % size)
    )
    found = F.map_from_entries(F.coalesce(counted(cells), F.array().cast(_COUNTS)))
    places = F.sequence(F.lit(0), F.lit(size - 1))

    def filled(counts: Column) -> Column:
        return F.transform(
            places, lambda i: F.coalesce(F.element_at(counts, i), F.lit(0)).cast("double")
        )

    return F.get(F.transform(F.array(found), filled), F.lit(0))


_COUNTS = "array<struct<word: int, term_count: bigint>>"
#: Vectors of a block; a pair of blocks is the unit of work.
BLOCK = 2048
#: Vectors of a ball, at most; a block is a sequence of balls of neighbours.
BALL = 64
#: Groups of neighbours of a batch.
PIVOTS = 64
#: Blocks of queries whose similarities a task remembers; without them less is skipped.
REMEMBERED = 1024
#: Similarities count to so many places.
PLACES = 6


def top_k_similar(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    k: int,
    query_id: str,
    corpus_id: str,
    query_vector: str = "embedding",
    corpus_vector: str = "embedding",
    metric: str = "cosine",
    floor: float | None = None,
    exclude_same_id: bool = False,
) -> DataFrame:
    """``query_id, rank, corpus_id, similarity``: exact nearest neighbours.

    Similarity counts to six places, ties go to the smaller id.  Both sides are
    packed into blocks of vectors where they lie.  A block is ordered into balls
    of neighbouring vectors, with centre and radius.  The shuffle partitions form
    a square: the blocks of the queries are dealt out to its rows, those of the
    corpus to its columns, so either side is copied once per column or row and
    no task holds one whole.  For a pair of blocks the product with the
    centres bounds what each ball can reach, and only the queries whose k-th
    similarity so far is not above that bound are multiplied with its vectors;
    a task remembers these similarities from block to block.  Nothing passes
    through the driver, and building the query runs nothing.  Vectors that are
    NULL, empty or hold a NULL, NaN or infinite component take no part, vectors
    of different length do not meet.  The floor drops rows behind the ranking.
    """
    groups = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = math.isqrt(max(groups - 1, 0)) + 1
    down = -(-groups // across)

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("rows"), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = _packed(queries, query_id, query_vector, metric).select(
        "dims",
        F.col("ids").alias("q_ids"),
        F.col("rows").alias("q_rows"),
        dealt(down).alias("down"),
        each(across).alias("across"),
    )
    c = _packed(corpus, corpus_id, corpus_vector, metric).select(
        "*", dealt(across).alias("across"), each(down).alias("down")
    )
    # Spark takes a block for a hundred bytes; it would send a side through the driver to all
    pairs = c.hint("merge").join(q, ["down", "across", "dims"])
    pairs = pairs.select("dims", "ids", "rows", "q_ids", "q_rows", "starts")
    types = [queries.schema[query_id].dataType, corpus.schema[corpus_id].dataType]
    schema = T.StructType(
        [
            T.StructField("__q", types[0]),
            T.StructField("__c", types[1]),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    order = Window.partitionBy("__q").orderBy(F.desc("similarity"), "__c")
    found = (
        pairs.mapInArrow(_block_search(k, exclude_same_id), schema)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
    if floor is not None:
        found = found.where(F.col("similarity") >= floor)
    return found.select(
        F.col("__q").alias(query_id),
        F.col("rank").cast("int").alias("rank"),
        F.col("__c").alias(corpus_id if corpus_id != query_id else f"near_{corpus_id}"),
        "similarity",
    )


def _packed(df: DataFrame, id_col: str, vector: str, metric: str) -> DataFrame:
    """``dims, ids, rows, starts``: the vectors of a partition in blocks of one length."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    usable = F.col(id_col).isNotNull() & finite
    rows = df.where(usable & (F.size(vector) > 0)).select(
        F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            for dims in np.unique(sizes):
                places = np.flatnonzero(sizes == dims)
                values = batch.column(1).take(pa.array(places)).flatten().to_numpy()
                vectors = _unit(values.reshape(-1, dims)) if metric == "cosine" else values.reshape(-1, dims)
                order, pivots = _neighbours_together(vectors)
                for start in range(0, len(places), BLOCK):
                    some = order[start : start + BLOCK]
                    matrix = vectors[some]
                    ids = batch.column(0).take(pa.array(places[some]))
                    ends = pa.array([0, len(ids)], pa.int32())
                    starts = _ball_starts(pivots[start : start + BLOCK])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([dims], pa.int32()),
                            pa.ListArray.from_arrays(ends, ids),
                            pa.array([matrix.tobytes()], pa.binary()),
                            pa.array([starts.tolist()], pa.list_(pa.int32())),
                        ],
                        ["dims", "ids", "rows", "starts"],
                    )

    id_type = df.schema[id_col].dataType
    return rows.mapInArrow(
        pack,
        T.StructType(
            [
                T.StructField("dims", T.IntegerType()),
                T.StructField("ids", T.ArrayType(id_type)),
                T.StructField("rows", T.BinaryType()),
                T.StructField("starts", T.ArrayType(T.IntegerType())),
            ]
        ),
    )


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _neighbours_together(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which vectors near the same pivot follow each other, nearest first, and the pivots.

    Each pivot is the vector farthest from the pivots before it, of a thousand at most.
    """
    some = vectors[:: max(1, len(vectors) // 1024)]
    pivots, away = some[:1], np.full(len(some), np.inf)
    while len(pivots) < min(PIVOTS, len(some)):
        away = np.minimum(away, ((some - pivots[-1]) ** 2).sum(axis=1))
        pivots = np.vstack([pivots, some[away.argmax()]])
    near = (pivots**2).sum(axis=1) - 2 * vectors @ pivots.T  # squared distance, less the vector's own length
    mine = near.argmin(axis=1)
    order = np.lexsort((near[np.arange(len(vectors)), mine], mine))
    return order, mine[order]


def _ball_starts(pivots: np.ndarray) -> np.ndarray:
    """Where balls begin: at another pivot, and after BALL vectors of one."""
    new = np.flatnonzero(np.append(True, pivots[1:] != pivots[:-1]))
    inside = np.arange(len(pivots)) - np.repeat(new, np.diff(np.append(new, len(pivots))))
    return np.flatnonzero(inside % BALL == 0)


def _balls(vectors: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the balls, their centres and radii."""
    ends = np.append(starts[1:], len(vectors))
    centres = np.add.reduceat(vectors, starts) / (ends - starts)[:, None]
    away = np.linalg.norm(vectors - np.repeat(centres, ends - starts, axis=0), axis=1)
    return np.append(starts, len(vectors)), centres, np.maximum.reduceat(away, starts)


class _Nearest:
    """The k nearest vectors of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, exclude: bool) -> None:
        self.ids, self.vectors, self.k, self.exclude = ids, vectors, k, exclude
        self.lengths = np.linalg.norm(vectors, axis=1)
        self.reach = np.full(len(ids), -np.inf)
        self.multiplied = 0

    def search(
        self, ids: np.ndarray, vectors: np.ndarray, starts: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries and vectors, and similarities: the best k of this block for each
        query, without those that cannot be among its best k of all blocks so far."""
        bounds, centres, radii = _balls(vectors, starts)
        most = self.vectors @ centres.T + self.lengths[:, None] * radii
        # room for rounding, of the bound and of the similarity
        sizes = np.linalg.norm(centres, axis=1) + radii
        most += 10.0**-PLACES + 1e-12 * (1 + self.lengths[:, None] * sizes)
        found_q, found_c, found_s = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
        nearest = most.argmax(axis=1)
        for first in (True, False):  # every query begins with the ball that may be best for it
            for ball in range(len(radii)):
                due = (nearest == ball) == first
                open_ = np.flatnonzero(due & (most[:, ball] >= self.reach))
                if not len(open_):
                    continue
                a, b = bounds[ball], bounds[ball + 1]
                self.multiplied += len(open_) * (b - a)
                scores = np.round(self.vectors[open_] @ vectors[a:b].T, PLACES) + 0.0
                if self.exclude:
                    scores[self.ids[open_][:, None] == ids[None, a:b]] = -np.inf
                row, column = np.nonzero((scores >= self.reach[open_][:, None]) & (scores > -np.inf))
                found_q.append(open_[row])
                found_c.append(a + column)
                found_s.append(scores[row, column])
                self._raise(open_, scores)
        q, c, score = map(np.concatenate, (found_q, found_c, found_s))
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = (rank < self.k) & (score >= self.reach[q])
        return q[kept], c[kept], score[kept]

    def _raise(self, rows: np.ndarray, scores: np.ndarray) -> None:
        """The k-th similarity within one ball is one that the query reaches."""
        if scores.shape[1] >= self.k:
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            self.reach[rows] = np.maximum(self.reach[rows], kth)


def _block_search(k: int, exclude: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[bytes, np.ndarray] = {}  # similarities that are reached, of every block of queries
        for batch in batches:
            for row in range(batch.num_rows):
                dims = batch.column(0)[row].as_py()
                ids, q_ids = batch.column(1)[row].values, batch.column(3)[row].values
                held = np.frombuffer(batch.column(2)[row].as_py()).reshape(-1, dims)
                raw = batch.column(4)[row].as_py()
                own = q_ids.to_numpy(zero_copy_only=False)
                key = hashlib.sha256(raw + repr(own.tolist()).encode()).digest()
                nearest = _Nearest(own, np.frombuffer(raw).reshape(-1, dims), k, exclude)
                if key in asked:
                    nearest.reach = asked[key]
                at, found, values = nearest.search(
                    ids.to_numpy(zero_copy_only=False), held, batch.column(5)[row].values.to_numpy()
                )
                if len(asked) >= REMEMBERED:
                    asked.clear()
                asked[key] = nearest.reach
                yield pa.RecordBatch.from_arrays(
                    [q_ids.take(pa.array(at)), ids.take(pa.array(found)), pa.array(values)],
                    ["__q", "__c", "similarity"],
                )

    return search


# --- passages ---------------------------------------------------------------

PASSAGE_PROMPT = (
    "Answer the question in whole sentences from the passage; ignore the passage when it does "
    "not help.\nQUESTION: '{query}'\nPASSAGE: '{passage}'\n\nANSWER:\n"
)


def escape_passage(c: Column) -> Column:
    """Quotes out, line breaks to blanks."""
    return F.translate(c, "\n'\"", " ")


# Forms of the ids that are extracted.
TACTIC_ID = r"\bTA\d{4}\b"
TECHNIQUE = r"\b(T\d{4}(?:\.\d{3})?) \(([^)]*)\)"


def extract_techniques(df: DataFrame, text_col: str, ids: list[str]) -> DataFrame:
    """``ids, tactic_id, technique_id, technique_name`` from descriptive text."""
    pair = F.arrays_zip(
        F.regexp_extract_all(F.col(text_col), F.lit(TECHNIQUE), F.lit(1)).alias("technique_id"),
        F.regexp_extract_all(F.col(text_col), F.lit(TECHNIQUE), F.lit(2)).alias("technique_name"),
    )
    tactic = F.regexp_extract(F.col(text_col), TACTIC_ID, 0)
    return df.select(
        *ids, F.when(tactic != "", tactic).alias("tactic_id"), F.explode(pair).alias("__t")
    ).select(*ids, "tactic_id", "__t.technique_id", "__t.technique_name")


def with_extracted_number(df: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """Typed value from a piece of text; a piece that fails keeps its reason."""
    found = F.regexp_extract(F.col(text_col), pattern, 1)
    value = found.try_cast("int")
    return df.withColumns(
        {
            "extracted": value,
            "status": F.when(value.isNotNull(), "ok")
            .when(found == "", "nothing found")
            .otherwise("not a number"),
        }
    )
