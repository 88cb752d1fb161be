"""Embedding near-dedup with spherical-cap filters.

A filter is a direction on the sphere with the cap around it.  The directions
form a random product code: after a fast random rotation (signs and Hadamard
transforms, twice) a vector is cut into parts, each part has so many random
directions, and every choice of one direction per part is a filter.  That gives
far more filters than could be listed, yet the ones a vector exceeds most are
decoded from short sorted lists: the best of each part, merged in pairs.  A
vector belongs to the filters it exceeds most, the width of its caps being given
by their number; near vectors share some of them almost surely, vectors that
are not near almost never.

How sharp a code may be depends on the length of the vectors and the cosine: of
``SHAPES``, sharpest first, the first counts for which random pairs at exactly
the wanted cosine, the hardest ones, share a filter with a frequency of
``RECALL`` or more.  Short vectors have few directions that differ, and links
are many among them, so their filters are wide.

Vectors are joined on (label, filter).  Filters with one vector are dropped, and
a filter with more than ``MEMBERS`` is cut into pieces that meet in pairs, so no
task holds more than two pieces.  All pairs of a piece are verified with a
matrix product in double precision.  A pair that shares several filters is
counted in the smallest one only.  What leaves a task is not the pairs but
counts per vector and a spanning set of links per piece.

Equal vectors of a label are one class throughout and linked if their cosine,
which is 1, reaches the threshold.  Recall is probabilistic in principle; the
tests compare with brute force.

Cases: null labels, and vectors that are null, empty, zero or hold a null or
non-finite number link with nothing.  Vectors of different lengths are not
compared.  Rows with a null id are left unlinked; rows that repeat an id count
as vectors of their own for ``n_links``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import drop_written, need, once_per_worker, runs, spanning, written
from packetloom.llm.components import components

COSINE = 0.98
#: Parts of a vector, directions of a part, filters of a vector; sharpest first.
SHAPES = [
    *[(4, code, 64) for code in (256, 128, 64, 32, 16, 8)],
    *[(2, code, 64) for code in (256, 128, 64, 32)],
    *[(1, code, 64) for code in (4096, 2048, 1024, 512)],
    (1, 256, 32),
    (1, 64, 16),
    (1, 16, 8),
    (1, 4, 4),
]
#: Share of pairs at the threshold that must share a filter, and pairs to measure it.
RECALL, PAIRS = 0.995, 1000
#: Best directions of a part that are considered.
BEST = 32
#: Most vectors of a filter that are verified as one piece.
MEMBERS = 1024
_SEED = 20250102


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        x = x.reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class ProductCode:
    """Random product code for vectors of one length."""

    def __init__(self, dims: int, blocks: int, code: int, listed: int) -> None:
        rng = np.random.default_rng([_SEED, dims])
        self.blocks, self.code, self.count = blocks, code, listed
        self.width = max(blocks, 1 << (dims - 1).bit_length())
        self.signs = rng.choice([-1.0, 1.0], (2, self.width))
        part = self.width // blocks
        directions = rng.standard_normal((blocks, code, part))
        self.directions = directions / np.linalg.norm(directions, axis=2, keepdims=True)

    def listed(self, unit: np.ndarray) -> np.ndarray:
        """The filters that each unit vector exceeds most, sorted by number."""
        x = np.zeros((len(unit), self.width))
        x[:, : unit.shape[1]] = unit
        for signs in self.signs:
            x = _hadamard(x * signs)
        parts = x.reshape(len(x), self.blocks, -1)
        scores, codes = None, None
        considered = min(BEST if self.blocks > 1 else self.count, self.code)
        for b in range(self.blocks):
            inner = parts[:, b] @ self.directions[b].T
            best = np.argpartition(-inner, considered - 1, axis=1)[:, :considered]
            value = np.take_along_axis(inner, best, axis=1)
            if scores is None:
                scores, codes = value, best.astype(np.int64)
                continue
            both = (scores[:, :, None] + value[:, None, :]).reshape(len(x), -1)
            name = (codes[:, :, None] * self.code + best[:, None, :]).reshape(len(x), -1)
            # the best sums of all parts need no more than the best sums of the first
            count = min(self.count, both.shape[1])
            top = np.argpartition(-both, count - 1, axis=1)[:, :count]
            scores = np.take_along_axis(both, top, axis=1)
            codes = np.take_along_axis(name, top, axis=1)
        return np.sort(codes, axis=1)


def pairs_at(cosine: float, dims: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors in pairs with the given cosine."""
    rng = np.random.default_rng([_SEED, dims, n])
    x = _unit(rng.standard_normal((n, dims)))
    away = rng.standard_normal((n, dims))
    away -= (away * x).sum(axis=1, keepdims=True) * x
    if dims == 1:
        return x, x
    return x, cosine * x + np.sqrt(1 - cosine**2) * _unit(away)


def product_code(dims: int, cosine: float) -> ProductCode:
    """The sharpest code that finds pairs at the cosine."""
    x, y = pairs_at(cosine, dims, PAIRS)
    for blocks, code, listed in SHAPES:
        if blocks > 1 and dims < 2 * blocks:
            continue
        found = ProductCode(dims, blocks, code, listed)
        shared = np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(found.listed(x), found.listed(y), strict=True)])
        if shared >= RECALL:
            break
    return found


def _posted(cosine: float):
    def code_of(size: int) -> ProductCode:
        return once_per_worker(f"caps {size} {cosine}", lambda: product_code(size, cosine))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch["v"].to_pylist()
            filters: list = [None] * len(vectors)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            for size, places in by_size.items():
                code = code_of(size)
                for k in range(0, len(places), 512):
                    some = places[k : k + 512]
                    x = np.array([vectors[i] for i in some], np.float64)
                    for i, row in zip(some, code.listed(_unit(x)), strict=True):
                        filters[i] = row
            flat = np.concatenate([*filters, np.empty(0, np.int64)])
            ends = np.cumsum([0, *map(len, filters)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))],
                [*batch.schema.names, "filters"],
            )

    return rows


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _smaller_shared(
    filters: np.ndarray, here: int, one: np.ndarray, two: np.ndarray
) -> np.ndarray:
    """How many filters below ``here`` each of ``one`` shares with each of ``two``."""
    row, place = np.nonzero(filters < here)
    _, column, times = np.unique(filters[row, place], return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    kept = times[column] > 1
    row, column = row[kept], number[column[kept]]
    out = np.zeros((len(one), len(two)), np.float32)
    for start in range(0, int((times > 1).sum()), 4096):
        part = np.zeros((len(filters), 4096), np.float32)
        inside = (column >= start) & (column < start + 4096)
        part[row[inside], column[inside] - start] = 1
        out += part[one] @ part[two].T
    return out


def _verified(rows: dict[str, np.ndarray], own: bool, cosine: float):
    """Links within one piece (``own``) or between two, each pair in its smallest filter.

    Returns the places of linked vectors with the copies they gain, and a
    spanning set of links.
    """
    side = rows["side"]
    one = np.flatnonzero(side == 0)
    two = one if own else np.flatnonzero(side == 1)
    unit = rows["unit"]
    at_i, at_j = np.nonzero(unit[one] @ unit[two].T >= cosine)
    if own:
        at_i, at_j = at_i[at_i < at_j], at_j[at_i < at_j]
    i, j = one[at_i], two[at_j]
    # of the filters that a pair shares, only the smallest counts it
    first = _smaller_shared(rows["filters"], rows["filter"][0], one, two)[at_i, at_j] == 0
    i, j = i[first], j[first]
    gained = np.zeros(len(side), np.int64)
    np.add.at(gained, i, rows["copies"][j])
    np.add.at(gained, j, rows["copies"][i])
    return gained, i, j


def _pieces(cosine: float):
    def piece(table: pa.Table):
        classes = table["class"].to_numpy()
        x = np.array(table["v"].to_pylist(), np.float64)
        rows = {
            "side": table["side"].to_numpy(),
            "filter": table["filter"].to_numpy(),
            "copies": table["copies"].to_numpy(),
            "unit": _unit(x),
            "filters": np.array(table["filters"].to_pylist(), np.int64),  # of one length of vectors
        }
        gained, i, j = _verified(rows, bool(table["own"][0].as_py()), cosine)
        links = spanning(i, j, len(classes))
        linked = np.flatnonzero(gained)
        for k in linked:
            yield int(classes[k]), int(gained[k]), None
        for a, b in links:
            yield int(classes[a]), 0, int(classes[b])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "key"):
            out = list(piece(table)) if table.num_rows > 1 else []
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["class", "gained", "other"]
                )

    return rows


def linked_vectors(
    vectors: DataFrame,
    *,
    cosine: float = COSINE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    need(vectors, vec_id, vector, label)
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    usable = (
        F.col(vec_id).isNotNull()
        & F.col(label).isNotNull()
        & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    )
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.when(usable, F.col(label).cast("string")).alias("label"),
        F.when(usable, F.col(vector).cast("array<double>")).alias("v"),
    )
    classes = written(
        rows.where(F.col("v").isNotNull())
        .groupBy("label", "v")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("class", F.monotonically_increasing_id()),
        "vector-classes",
    )
    posted = written(
        classes.select("class", "label", "v", "copies").mapInArrow(
            _posted(cosine), "class long, label string, v array<double>, copies long, filters array<long>"
        ),
        "caps",
    )
    posts = posted.select("label", F.size("v").alias("dims"), F.explode("filters").alias("filter"))
    shared = (
        posts.groupBy("label", "dims", "filter")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("label", "dims", "filter", F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts"))
    )
    members = posted.select(
        "*", F.size("v").alias("dims"), F.explode("filters").alias("filter")
    ).join(shared, ["label", "dims", "filter"])
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    met = members.withColumn("part", part).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    low, high = F.least("part", "with"), F.greatest("part", "with")
    pieces = met.select(
        F.xxhash64("label", "dims", "filter", low, high).alias("key"),
        "filter",
        (F.col("part") != low).cast("int").alias("side"),
        (low == high).alias("own"),
        "class",
        "copies",
        "v",
        "filters",
    )
    found = written(
        pieces.repartition("key")
        .sortWithinPartitions("key", "side", "class")
        .mapInArrow(_pieces(cosine), "class long, gained long, other long"),
        "cap-links",
    )
    gained = found.groupBy("class").agg(F.sum("gained").alias("gained"))
    below = components(found.where(F.col("other").isNotNull()), "class", "other")
    tops = below.select(F.col("root").alias("node"), "root").distinct()
    roots = written(below.unionAll(tops), "vector-roots")
    drop_written(posted)
    # an id may stand for several vectors, so components are of classes and named by their smallest id
    ids = classes.select(F.col("class").alias("node"), "rep")
    smallest = roots.join(ids, "node").groupBy("root").agg(F.min("rep").alias("smallest"))
    named = (
        classes.select(F.col("label").alias("_label"), F.col("v").alias("_v"), "rep", "copies", "class")
        .join(gained, "class", "left")
        .join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
        .join(smallest, "root", "left")
        .select("_label", "_v", "rep", "copies", "gained", "smallest")
    )
    out = rows.join(
        named, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left"
    )
    component = F.coalesce("smallest", "rep", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("gained", F.lit(0)), F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
