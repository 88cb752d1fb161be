"""Secret scans: fixed patterns plus two character Markov models.

The patterns find secrets that announce themselves (see ``base_spans``).  The
models find the rest: one is trained on random strings, the other on ordinary
identifiers, and a token counts as secret when its log-likelihood ratio per
character is high enough; of a token that a pattern covers in part, the rest is
judged.  Both are first-order chains over the characters of
``ALPHABET``.  The labelled samples come from the corpus itself and cover all of
it: what the patterns found is labelled random; the words of all texts, written
as people write names (``ordinary_identifiers``), are labelled ordinary.  Each
task adds its samples up to two square tables of counts, which a grouped sum
combines; only those tables, of fixed size, reach the driver.  There both are
scaled to fixed weights, so that a larger corpus judges no more sharply.  UUIDs
name things and are not judged.

Scanning is one pass of Arrow batches without a shuffle.

Cases: a null text is an empty one and has no spans.  Texts are read whole, and
all patterns take linear time.  Rows that repeat an id are scanned each on its
own.  Without any labelled secret the random model is uniform.  An empty table
gives an empty result.  Columns of the input are kept, those called like an
added one are replaced.  Spans count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import need

#: The kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns.  Letters of the names match in either case, ASCII only.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_LENGTH = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Tokens that the models judge, and the shortest.
LEAST_TOKEN = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_TOKEN)
#: Names that are random by design.
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: What a short part of a token is made of where a key or hex digits go on.
RUN = re.compile(r"[A-Za-z0-9+/]*")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Documents whose characters are counted at a time.
TOGETHER = 100
#: Added to every count, so that unseen pairs keep some probability.
SMOOTHING = 0.5
#: Pairs that the samples of either label count as, however many there are.
RANDOM_WEIGHT = 2000.0
ORDINARY_WEIGHT = 100_000.0
#: Numbers in identifiers, for each word.
NUMBERS = 0.1
#: Least log-likelihood ratio per character pair, in nats.
MARGIN = 0.3

_N = len(ALPHABET)
_CODES = np.full(256, _N, np.int64)
_CODES[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(_N)

Span = tuple[int, int, int]  # start, end, place of the kind in KINDS


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and without overlap within a kind.

    ``assign`` is a name, a sign and a value of 8 or more characters; shorter
    values use up their text and are dropped.  ``access`` are keys of 16 or more
    characters, ``hex`` runs of 32 or more lower-case digits.
    """
    spans: list[Span] = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LENGTH:
                spans.append((m.start(), m.end(), 0))
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _pairs(data: bytes) -> np.ndarray:
    """Counts of neighbouring characters as a square table; the last row and column
    stand for all characters outside ``ALPHABET``."""
    codes = _CODES[np.frombuffer(data, np.uint8)]
    cells = codes[:-1] * (_N + 1) + codes[1:]
    return np.bincount(cells, minlength=(_N + 1) ** 2).reshape(_N + 1, _N + 1)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(0).to_pylist()]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every, secret = (np.zeros((_N + 1, _N + 1), np.int64) for _ in range(2))
    parts = (
        batch.slice(k, TOGETHER)
        for batch in batches
        for k in range(0, batch.num_rows, TOGETHER)
    )
    for part in parts:
        texts = _texts(part)
        every += _pairs(" ".join(["", *texts, ""]).encode())
        found = []
        for text in texts:
            for start, end, kind in base_spans(text):
                value = ASSIGN.match(text, start) if kind == 0 else None
                found.append(value.group(2) if value else text[start:end])
        if found:
            secret += _pairs(" ".join(found).encode())
    for label, table in (("secret", secret), ("every", every)):
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict(
            {
                "label": pa.array([label] * len(cells), pa.string()),
                "cell": pa.array(cells, pa.int32()),
                "n": pa.array(table.ravel()[cells], pa.int64()),
            }
        )


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratio of every character pair, random against ordinary."""

    ratio: np.ndarray

    def score(self, token: str) -> float:
        """Mean ratio of the pairs of a token; 0 for fewer than two characters."""
        codes = _CODES[np.frombuffer(token.encode(), np.uint8)]
        return float(self.ratio[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0


def ordinary_identifiers(pairs: np.ndarray) -> np.ndarray:
    """Pairs of the identifiers that the words of the given pairs would make.

    Words follow each other in lower case behind ``_``, ``-`` and ``/``, in upper
    case behind ``_``, and with capitals (camel case); some are followed by
    numbers.  The letters within a word, its first and its last letter come from
    ``pairs``, whose last row and column stand for all that is no part of a word.
    """
    low, up, digit = slice(0, 26), slice(26, 52), slice(52, 62)
    under, *others = signs = [ALPHABET.index(c) for c in "_-/"]
    inside = (pairs[low, low] + pairs[up, low] + pairs[up, up]).astype(float)
    starts = (pairs[_N, low] + pairs[_N, up]).astype(float)
    ends = pairs[low, _N].astype(float)
    words = ends.sum()
    starts *= words / max(starts.sum(), 1)
    of_start = starts / max(words, 1)
    following = inside / np.maximum(inside.sum(axis=1, keepdims=True), 1)
    out = np.zeros((_N, _N))
    out[low, low] += 4 * inside  # behind three signs, and in camel case
    for sign in signs:
        out[low, sign] += ends
        out[sign, low] += starts
        out[sign, up] += starts / 3
        out[sign, digit] += NUMBERS * words / 10
        out[digit, sign] += NUMBERS * words / 10
    out[low, up] += ends[:, None] * of_start
    out[up, low] += starts[:, None] * following
    out[up, up] += inside
    out[up, under] += ends
    out[under, up] += starts
    for case in (low, up):
        out[case, digit] += NUMBERS * ends[:, None] / 10
        out[digit, case] += NUMBERS * starts / 10
    out[digit, digit] += NUMBERS * words / 50
    return out


def models_of(secret: np.ndarray, ordinary: np.ndarray) -> MarkovModels:
    def log_steps(counts: np.ndarray, weight: float) -> np.ndarray:
        smooth = counts * (weight / max(counts.sum(), 1)) + SMOOTHING
        return np.log(smooth / smooth.sum(axis=1, keepdims=True))

    return MarkovModels(
        log_steps(secret, RANDOM_WEIGHT) - log_steps(ordinary, ORDINARY_WEIGHT)
    )


def train(docs: DataFrame, text: str = "text") -> MarkovModels:
    """Both models from the labelled samples of all documents."""
    need(docs, text)
    rows = (
        docs.select(text)
        .mapInArrow(_count_pairs, "label string, cell int, n long")
        .groupBy("label", "cell")
        .agg(F.sum("n").alias("n"))
        .collect()  # two tables of len(ALPHABET) + 1 squared cells at most
    )
    tables = {label: np.zeros((_N + 1, _N + 1)) for label in ("secret", "every")}
    for label, cell, n in rows:
        tables[label].flat[cell] = n
    # overlapping spans may count a secret twice, so the rest is kept at 0 or more
    words = np.maximum(tables["every"] - tables["secret"], 0)
    return models_of(tables["secret"][:_N, :_N], ordinary_identifiers(words))


def _uncovered(token: re.Match, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """The parts of a token outside the given sorted spans that are long enough to judge.

    Of a shorter part, what runs on without ``_``, ``=`` or ``-`` from a key or
    hex digits, with the character that it touches there, as these may end
    within a secret.
    """
    at, end = token.span()
    before = None  # kind of the span that ends at ``at``
    for a, b, kind in [*taken, (end, end, None)]:
        if b < at or a > end or (b == at and kind is not None):
            continue
        if a - at >= LEAST_TOKEN:
            yield at, a
        elif a > at:
            if before in (1, 2):
                yield at, RUN.match(token.string, at, a).end()
            if kind in (1, 2):
                tail = RUN.match(token.string[at:a][::-1]).end()
                yield a - tail, a
        if b > at:
            at, before = b, kind


def model_spans(text: str, models: MarkovModels, taken: list[Span]) -> list[Span]:
    """Tokens that look random, or what the given sorted spans leave of them."""
    spans: set[Span] = set()
    for m in TOKEN.finditer(text):
        low, high = m.span()
        for a, b in _uncovered(m, taken):
            short = b - a < LEAST_TOKEN
            judged = text[max(a - 1, low) : min(b + 1, high)] if short else text[a:b]
            if "-" in judged:
                judged = UUID.sub("", judged)
            if b > a and models.score(judged) >= MARGIN:
                spans.add((a, b, 3))
    return sorted(spans)


def all_spans(text: str, models: MarkovModels) -> tuple[list[Span], list[Span]]:
    """The spans of the patterns, and these together with the models'."""
    base = base_spans(text)
    more = model_spans(text, models, base)
    return base, sorted(base + more, key=lambda s: (s[0], s[2]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of overlapping spans, replaced by its kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]} removed]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame, models: MarkovModels, text: str = "text") -> DataFrame:
    """Adds ``secret_spans``: array<struct<start, end, kind>> of every text."""
    need(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    kind = pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    )

    @F.arrow_udf("array<struct<start: int, end: int, kind: string>>")
    def spans_of(texts: pa.Array) -> pa.Array:
        rows = [
            [
                {"start": a, "end": b, "kind": KINDS[k]}
                for a, b, k in all_spans(t or "", sent.value)[1]
            ]
            for t in texts.to_pylist()
        ]
        return pa.array(rows, kind)

    return docs.withColumn("secret_spans", spans_of(F.col(text)))


def without_secrets(docs: DataFrame, models: MarkovModels, text: str = "text") -> DataFrame:
    """The same documents with their secrets cut out of the text; null stays null."""
    need(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array(
            [
                None if t is None else redacted(t, all_spans(t, sent.value)[1])
                for t in texts.to_pylist()
            ],
            pa.string(),
        )

    return docs.withColumn(text, cleaned(F.col(text)))

