"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Word vectors: words fall into ``CELLS`` hashed cells, every cell has a sparse
random index vector, and the vector of a cell is the sum of the index vectors
around its occurrences in all documents, labelled or not.  These are integer
sums, formed per task and combined by one grouped sum, so they do not depend on
the order.  A document is the mean and
the spread of the vectors of all its words, with two counts.  A network of two
layers, trained with numpy, turns them into a probability, whose temperature is
fitted on training rows that the weights did not see.

The fit of the network uses at most ``TRAIN_ROWS`` labelled documents: those with the smallest
hash of the id.  The driver holds the pooled numbers of these, never texts.
Scoring reads every whole text in one pass of Arrow batches.

Cases: a null or empty text, or one without words, has no vectors, pools to
zeros and gets a score like others.  Labels other than 0 and 1, and labels
without a document, are left out; an id with several labels counts with the
largest, a repeated document once.  With labels of one class only, or none, the
score is the smoothed share of label 1.  Columns of the input are kept, those
called like an added one are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import need, once_per_worker, written

#: Hashed cells of words, length of the vectors, non-zero numbers of an index vector.
CELLS = 1 << 14
DIMS = 48
NONZERO = 4
#: Words on either side that count as context.
WINDOW = 2
#: Most labelled documents used in the fit.
TRAIN_ROWS = 12_000
#: Of these, the share that fits the temperature only.
CALIBRATION = 0.2
HIDDEN = 24
EPOCHS = 250
RATE = 0.01
DECAY = 1e-4
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_SEED = 20250103


class _Cells(dict):
    """Cell of a word; remembers a limited number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = cell = zlib.crc32(word.encode("utf-8", "surrogatepass")) % CELLS
        return cell


def cells_of(text: str | None) -> np.ndarray:
    cells = once_per_worker("quality cells", _Cells)
    words = _TOKEN.findall(text or "")
    return np.fromiter(map(cells.__getitem__, words), np.int32, len(words))


def index_vectors() -> np.ndarray:
    """The sparse random index vector of every cell."""
    rng = np.random.default_rng(_SEED)
    out = np.zeros((CELLS, DIMS), np.int8)
    places = np.argsort(rng.random((CELLS, DIMS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice([-1, 1], (CELLS, NONZERO)).astype(np.int8), axis=1)
    return out


def add_contexts(total: np.ndarray, cells: np.ndarray, index: np.ndarray) -> None:
    """Add the index vectors around every word to the row of its cell."""
    near = index[cells].astype(np.int64)
    context = np.zeros_like(near)
    for d in range(1, WINDOW + 1):
        context[d:] += near[:-d]
        context[:-d] += near[d:]
    np.add.at(total, cells, context)


def word_vectors(total: np.ndarray) -> np.ndarray:
    """Unit vectors; cells never seen keep their index vector."""
    seen = np.abs(total).sum(axis=1, keepdims=True) > 0
    vectors = np.where(seen, total, index_vectors()).astype(np.float64)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def pooled(cells: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors, log of the length, share of different words."""
    out = np.zeros(2 * DIMS + 2)
    if len(cells):
        found = vectors[cells]
        out[:DIMS] = found.mean(axis=0)
        out[DIMS : 2 * DIMS] = found.std(axis=0)
        out[-2] = math.log1p(len(cells))
        out[-1] = len(np.unique(cells)) / len(cells)
    return out


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]  # first layer, its bias, second layer, its bias
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(((features - self.centre) / self.scale) @ w1 + b1) @ w2 + b2

    def scores(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(features) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(features: np.ndarray, y: np.ndarray, vectors: np.ndarray) -> QualityModel:
    """Adam on all rows at once, then the temperature with the least loss on rows kept apart."""
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        n = features.shape[1]
        flat = (np.zeros((n, 1)), np.zeros(1), np.zeros(1), np.array(np.log(share / (1 - share))))
        return QualityModel(vectors, np.zeros(n), np.ones(n), flat, 1.0)
    rng = np.random.default_rng(_SEED)
    apart = rng.random(len(y)) < CALIBRATION
    if len(np.unique(y[~apart])) < 2 or not apart.any():
        apart[:] = False
    x, t = features[~apart], y[~apart]
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - centre) / scale
    w = [
        rng.standard_normal((x.shape[1], HIDDEN)) / math.sqrt(x.shape[1]),
        np.zeros(HIDDEN),
        rng.standard_normal(HIDDEN) / math.sqrt(HIDDEN),
        np.array(0.0),
    ]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, EPOCHS + 1):
        hidden = np.tanh(x @ w[0] + w[1])
        error = (_sigmoid(hidden @ w[2] + w[3]) - t) / len(t)
        back = np.outer(error, w[2]) * (1 - hidden**2)
        grads = [x.T @ back + DECAY * w[0], back.sum(0), hidden.T @ error + DECAY * w[2], error.sum()]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            w[k] = w[k] - RATE * move
    model = QualityModel(vectors, centre, scale, tuple(w), 1.0)
    rows = apart if apart.any() else ~apart
    logits = model.logits(features[rows])
    temperatures = np.exp(np.linspace(math.log(0.25), math.log(8), 101))
    best = min(temperatures, key=lambda s: _loss(logits / s, y[rows]))
    return QualityModel(vectors, centre, scale, tuple(w), float(best))


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, total = index_vectors(), np.zeros((CELLS, DIMS), np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            add_contexts(total, cells_of(text), index)
    cells = np.flatnonzero(np.abs(total).sum(axis=1))
    flat = pa.array(total[cells].ravel(), pa.int64())
    ends = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * DIMS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(cells, pa.int32()), pa.ListArray.from_arrays(ends, flat)], ["cell", "sums"]
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> QualityModel:
    """Fit on labelled documents; ``labels`` has the ids and labels to learn from."""
    need(docs, doc_id, text)
    need(labels, doc_id, label)
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(TRAIN_ROWS)
    )
    chosen = written(chosen, "quality-labels")
    sample = written(
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "id")  # TRAIN_ROWS short rows at most
        .dropDuplicates(["id"]),
        "quality-sample",
    )
    summed = (
        docs.select(text)
        .mapInArrow(_context_sums, "cell int, sums array<long>")
        .groupBy("cell")
        .agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(DIMS)]).alias("sums"))
        .toArrow()  # CELLS rows at most
    )
    total = np.zeros((CELLS, DIMS), np.int64)
    if summed.num_rows:
        total[summed["cell"].to_numpy()] = np.array(summed["sums"].to_pylist())
    vectors = word_vectors(total)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pooled(cells_of(t), sent.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64())), batch.column(2)],
                ["id", "x", "y"],
            )

    kind = f"id {sample.schema['id'].dataType.simpleString()}, x array<double>, y double"
    rows = (
        sample.select("id", "text", F.col("y").cast("double")).mapInArrow(features, kind).toArrow()
    ).sort_by("id")
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, 2 * DIMS + 2)
    return fit_network(x, rows["y"].to_numpy(), vectors)


def scored(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Adds ``score``: the probability of label 1, from the text alone."""
    need(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model = sent.value
        rows = [pooled(cells_of(t), model.vectors) for t in texts.to_pylist()]
        return pa.array(model.scores(np.array(rows).reshape(-1, 2 * DIMS + 2)), pa.float64())

    return docs.withColumn("score", score(F.col(text)))
