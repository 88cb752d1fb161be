"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about the language of a document add up as logarithms:

* the text, by a naive Bayes model of hashed character trigrams per language,
  weakened by ``TEXT_WEIGHT`` because neighbouring trigrams overlap;
* the declared language of the markup, by how often each declaration goes with
  each language;
* the suffix of the address, likewise;
* the host, by a prior that is smoothed from the host to its domain to all
  documents.

The trigram model learns from the declared languages, however rare, and covers
all documents.  The trigrams of all of them smooth those of each, so that a
language with few documents fits other text no better than the corpus does.  The
driver and the tasks hold ``CELLS`` numbers per language.  The other tables count
how documents are classed by their text and the frequency of the declarations,
in one grouped aggregation each, combined before the shuffle; a key has the
counts of its own languages only.  They are joined to the documents, and Spark
broadcasts those that are small.  ``und`` is a further
class for text that fits no language: all trigrams are equally likely in it.  A
document is rejected when ``und`` wins, when the winner's probability is below
``LEAST``, or when there are no letters.

Cases: a null or empty text, or one without letters, is ``und`` and rejected.
A missing declaration or address gives no evidence.  Texts are read whole.
Rows that repeat an id are judged each on its own.  Without any declared
language everything is rejected.  An empty table gives an empty result.
Columns of the input are kept, those called like an added one are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import need, written
from packetloom.llm.url_filter import host_of

CELLS = 1 << 12
#: Languages whose counts a task holds, and documents that are judged, at a time.
HELD = 256
TOGETHER = 256
TEXT_WEIGHT = 0.3
#: Weight of the wider level in the prior of a host or domain, in documents.
SMOOTHING = 20.0
#: Prior of text in no known language.
UNKNOWN = 1e-9
#: Least probability of the winner.
LEAST = 0.5
UND = "und"
KEYS = ("declared", "suffix", "domain", "host")
#: Numbers, keys and the like say nothing about the language.
_DIGIT = re.compile(r"\d")
_WITH_DIGITS = re.compile(r"\b[^\W\d]*\d\w*")


_LETTERS = np.array([chr(c).isalpha() for c in range(0x3000)])
_BLANK = np.array([32], np.uint32)


def trigram_counts(text: str | None) -> np.ndarray:
    """Counts of hashed trigrams of lower-case letters; other characters are one blank.

    Words that hold digits are left out.
    """
    low = (text or "").lower()
    if _DIGIT.search(low):
        low = _WITH_DIGITS.sub(" ", low)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTERS[np.minimum(codes, len(_LETTERS) - 1)]
    beyond = codes >= len(_LETTERS)
    if beyond.any():
        for code in np.unique(codes[beyond]):
            letter[codes == code] = chr(code).isalpha()
    if not letter.any():
        return np.zeros(CELLS, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    codes = np.where(letter, codes, np.uint32(32))[keep]
    codes = np.concatenate([_BLANK, codes, _BLANK])
    mixed = codes[:-2] * np.uint32(0x9E3779B1)
    mixed += codes[1:-1] * np.uint32(0x85EBCA77)
    mixed += codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x27D4EB2F)
    return np.bincount(mixed >> np.uint32(20), minlength=CELLS)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    log_probabilities: np.ndarray  # languages and und, cells

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Weakened log-likelihood of every class; the last class is und.  0 without letters."""
        out = np.zeros((len(texts), len(self.log_probabilities)))
        for i, text in enumerate(texts):
            out[i] = self.log_probabilities @ trigram_counts(text)
        return TEXT_WEIGHT * out


def text_model(languages: tuple[str, ...], counts: np.ndarray) -> TextModel:
    every = counts.sum(axis=0) + 0.5
    smooth = counts + 0.5 * CELLS * every / every.sum()
    rows = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return TextModel(languages, np.vstack([rows, np.full((1, CELLS), -math.log(CELLS))]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, declared in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
            if declared not in total:
                if len(total) == HELD:
                    yield from _cell_rows(total)
                    total.clear()
                total[declared] = np.zeros(CELLS, np.int64)
            total[declared] += trigram_counts(text)
    yield from _cell_rows(total)


def _cell_rows(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for declared, counts in total.items():
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([declared] * len(cells), pa.string()),
                pa.array(cells, pa.int32()),
                pa.array(counts[cells], pa.int64()),
            ],
            ["declared", "cell", "n"],
        )


@dataclass(frozen=True)
class LanguageModel:
    """The text model, and counts of text-only decisions by declaration, suffix, domain, host."""

    text: TextModel
    counts: dict[str, DataFrame]  # key -> table of key, counts of its languages
    overall: tuple[float, ...]

    @property
    def tables(self) -> dict[str, DataFrame]:
        """The same as tables of key, array of counts per language."""
        places = F.sequence(F.lit(0), F.lit(len(self.text.languages) - 1))

        def dense(counts: str) -> Column:
            found = F.map_from_entries(counts)
            return F.transform(places, lambda i: F.coalesce(F.try_element_at(found, i), F.lit(0.0)))

        return {
            key: table.select(key, dense(f"{key}_counts").alias(f"{key}_counts"))
            for key, table in self.counts.items()
        }


def _evidence_rows(docs: DataFrame, text: str, declared: str, address: str) -> DataFrame:
    """docs as a struct, with the keys of all evidence."""
    host = F.when(F.col(address).contains("://"), host_of(F.col(address))).otherwise(
        F.lower(F.col(address))
    )
    labels = F.split("host", r"\.")
    return (
        docs.select(
            F.struct(*docs.columns).alias("_doc"),
            F.col(text).alias("_text"),
            F.lower(F.split(F.col(declared), "[-_]")[0]).alias("declared"),
            F.coalesce(host, F.lit("")).alias("host"),
        )
        .withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
        .withColumn("suffix", F.when(F.size(labels) > 1, F.element_at(labels, -1)))
    )


def _guesses(model: TextModel, log_shares: np.ndarray, spark):
    """Place of the language that text and frequency speak for; -1 where the text fits none."""
    sent = spark.sparkContext.broadcast((model, log_shares))

    @F.arrow_udf("int")
    def guess(texts: pa.Array) -> pa.Array:
        model, log_shares = sent.value
        out = []
        for k in range(0, len(texts), TOGETHER):
            found = model.evidence(texts.slice(k, TOGETHER).to_pylist())
            best = (found[:, :-1] + log_shares).argmax(axis=1)
            fits = found[np.arange(len(found)), best] >= found[:, -1]
            out.append(np.where(fits, best, -1))
        return pa.array(np.concatenate(out) if out else [], pa.int32())

    return guess


def train(
    docs: DataFrame,
    *,
    text: str = "text",
    declared: str = "lang",
    address: str = "source",
) -> LanguageModel:
    """Text model, then counts by declaration, suffix, domain and host over all documents."""
    need(docs, text, declared, address)
    rows = _evidence_rows(docs, text, declared, address).drop("_doc")
    known = rows.where((F.col("declared") != "") & (F.col("declared") != UND))
    declared_counts = {r[0]: r[1] for r in known.groupBy("declared").count().toLocalIterator()}
    languages = tuple(sorted(declared_counts))
    learnt = (
        known.select("_text", "declared")
        .mapInArrow(_counted, "declared string, cell int, n long")
        .groupBy("declared", "cell")
        .agg(F.sum("n").alias("n"))
        .toLocalIterator()  # CELLS rows per language at most
    )
    counts = np.zeros((len(languages), CELLS))
    place = {name: i for i, name in enumerate(languages)}
    for name, cell, n in learnt:
        counts[place[name], cell] = n
    model = text_model(languages, counts)
    if not languages:
        return LanguageModel(model, {}, ())
    often = np.array([declared_counts[name] for name in languages], np.float64)
    guess = _guesses(model, np.log(often / often.sum()), docs.sparkSession)(F.col("_text"))
    guessed = written(
        rows.select("declared", "suffix", "domain", "host", guess.alias("guess")).groupBy(
            "declared", "suffix", "domain", "host", "guess"
        ).agg(F.count("*").alias("n")),
        "language-guesses",
    ).where(F.col("guess") >= 0)
    tables = {
        key: written(
            guessed.where(F.col(key).isNotNull())
            .groupBy(key, "guess")
            .agg(F.sum("n").cast("double").alias("n"))
            .groupBy(key)
            .agg(F.collect_list(F.struct("guess", "n")).alias(f"{key}_counts")),
            f"language-{key}",
        )
        for key in KEYS
    }
    overall = np.zeros(len(languages))
    for i, n in guessed.groupBy("guess").agg(F.sum("n")).toLocalIterator():
        overall[i] = n
    return LanguageModel(model, tables, tuple(overall.tolist()))


def _dense(counts: pa.Array, n: int) -> np.ndarray:
    """Counts per language of every row, from lists of places and counts."""
    out = np.zeros((len(counts), n))
    pairs = counts.flatten()
    rows = np.repeat(np.arange(len(counts)), counts.value_lengths().fill_null(0).to_numpy())
    out[rows, pairs.field(0).to_numpy()] = pairs.field(1).to_numpy()
    return out


def _log_evidence(
    model: TextModel, overall: np.ndarray, columns: list[pa.Array]
) -> tuple[np.ndarray, np.ndarray]:
    """Log evidence of every language and und, and whether there are no letters.

    The columns are the texts, whether declaration and suffix are missing, and the counts of ``KEYS``.
    """
    texts, *missing = columns[:3]
    n = len(model.languages)
    count = {key: _dense(column, n) for key, column in zip(KEYS, columns[3:], strict=True)}
    logs = model.evidence(texts.to_pylist())
    silent = ~logs.any(axis=1)
    for key, none in zip(("declared", "suffix"), missing, strict=True):
        # how likely the declaration or suffix is in the language; 1 without one
        likely = np.minimum((count[key] + 0.5) / (overall + 1), 1)
        likely[none.to_numpy(zero_copy_only=False)] = 1
        logs[:, :-1] += np.log(likely)
    prior = (overall + 1) / (overall.sum() + n)
    for key in ("domain", "host"):
        sums = count[key].sum(axis=1, keepdims=True)
        prior = (count[key] + SMOOTHING * prior) / (sums + SMOOTHING)
    logs[:, :-1] += np.log(prior)
    logs[:, -1] += math.log(UNKNOWN)
    return logs, silent


def _decisions(model: LanguageModel, spark):
    """The most probable class of every document and its probability."""
    sent = spark.sparkContext.broadcast((model.text, np.array(model.overall)))
    kind = pa.struct([("language", pa.string()), ("confidence", pa.float64())])

    @F.arrow_udf("struct<language: string, confidence: double>")
    def decide(
        texts: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array, f: pa.Array
    ) -> pa.Array:
        text_model, overall = sent.value
        names = [*text_model.languages, UND]
        found, shares = [], []
        for k in range(0, len(texts), TOGETHER):
            part = [x.slice(k, TOGETHER) for x in (texts, a, b, c, d, e, f)]
            logs, silent = _log_evidence(text_model, overall, part)
            best = logs.argmax(axis=1)
            share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            found += [names[i] for i in np.where(silent, len(names) - 1, best)]
            shares += np.where(silent, 0.0, share).tolist()
        return pa.StructArray.from_arrays(
            [pa.array(found, pa.string()), pa.array(shares, pa.float64())], fields=list(kind)
        )

    return decide


def identified(
    docs: DataFrame,
    model: LanguageModel,
    *,
    text: str = "text",
    declared: str = "lang",
    address: str = "source",
) -> DataFrame:
    """Adds language, confidence and kept to every document."""
    need(docs, text, declared, address)
    added = ["language", "confidence", "kept"]
    columns = [F.col(f"_doc.{c}") for c in docs.columns if c not in added]
    if not model.text.languages:
        return docs.select(
            *[c for c in docs.columns if c not in added],
            F.lit(UND).alias("language"),
            F.lit(0.0).alias("confidence"),
            F.lit(False).alias("kept"),
        )
    rows = _evidence_rows(docs, text, declared, address)
    for key, table in model.counts.items():
        rows = rows.join(table, key, "left")
    decide = _decisions(model, docs.sparkSession)
    missing = [F.col(key).isNull() for key in ("declared", "suffix")]
    rows = rows.withColumn(
        "_found", decide(F.col("_text"), *missing, *[F.col(f"{key}_counts") for key in KEYS])
    )
    return rows.select(
        *columns,
        F.col("_found.language").alias("language"),
        F.col("_found.confidence").alias("confidence"),
        ((F.col("_found.language") != UND) & (F.col("_found.confidence") >= LEAST)).alias("kept"),
    )
