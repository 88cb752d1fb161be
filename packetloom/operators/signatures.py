"""Known signatures in texts, for signature tables of any size.

A match is the equality of a piece of the text and a signature, so it is found
by a join.  Which pieces of a text can match at all is decided in Arrow batches: two
bit fields of fixed size hold a hash of every signature and of the first
``PREFIX`` characters of every signature.  A place whose next characters are in
the second is looked at with each length that signatures have, and pieces that
are in the first go to the join, with the place and without the text.  Nothing
is compared with every signature, no list of them reaches the driver, and a
signature that occurs everywhere is one row on its side of the join.  Of the
matches of a text, the leftmost counts, of those at one place the first in the
table, then the next one behind its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.sources.scratch import scratch_path

#: Characters that decide whether a place is looked at.
PREFIX = 4
#: Bits of a field; a power of two.
BITS = 1 << 22
#: Characters that are looked at together.
CHARACTERS = 1 << 20
#: Odd, for the hashes of pieces.
BASE = 0x9E3779B97F4A7C15

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _first_definitions(signatures: DataFrame) -> DataFrame:
    """__key, __first, __s: signatures in lower case, the first of equal ones."""
    others = [c for c in signatures.columns if c not in ("pattern", "pattern_no")]
    first = (
        signatures.where("pattern <> ''")
        .groupBy(F.lower("pattern").alias("__key"))
        .agg(
            F.min("pattern_no").alias("__first"),
            F.min_by(F.struct("pattern_no", *others), "pattern_no").alias("__s"),
        )
    )
    path = scratch_path(signatures.sparkSession, "signatures")
    first.write.parquet(path)
    return signatures.sparkSession.read.schema(first.schema).parquet(path)


class _Windows:
    """Hashes of pieces of one row of characters, each in constant time.

    The characters, weighed by the powers of an odd number, are summed up; the
    difference of two sums, taken back by the power at its place, depends on the
    piece alone.
    """

    def __init__(self, texts: list[str]) -> None:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        powers = np.full(len(codes) + 1, BASE, np.uint64)
        back = np.full(len(codes) + 1, pow(BASE, -1, 1 << 64), np.uint64)
        powers[0] = back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * np.cumprod(powers)[:-1], out=self.sums[1:])

    def hashes(self, places: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        h = (self.sums[places + lengths] - self.sums[places]) * self.back[places]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(BASE)
        return h ^ (h >> np.uint64(29))


@F.arrow_udf(T.LongType())
def _hash(texts: pa.Array) -> pa.Array:
    found = texts.to_pylist()
    lengths = np.array([len(t) for t in found], np.int64)
    return pa.array(_Windows(found).hashes(np.cumsum(lengths) - lengths, lengths).view(np.int64))


def _bit_field(keys: DataFrame, text: Column) -> np.ndarray:
    """A bit for the hash of every text."""
    h = keys.select(_hash(text).alias("h"))
    words = (
        h.select(
            F.shiftright(F.col("h").bitwiseAND(F.lit(BITS - 1)), 6).cast("int").alias("word"),
            F.col("h").bitwiseAND(F.lit(63)).cast("int").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )
    field = np.zeros(BITS // 64, np.int64)
    for word, bits in words.collect():  # BITS / 64 rows at most
        field[word] = bits
    return field.view(np.uint64)


def _holds(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    word = field[(h & np.uint64(BITS - 1)) >> np.uint64(6)]
    return (word >> (h & np.uint64(63))) & np.uint64(1) == 1


def _batches(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts, together no longer than ``CHARACTERS`` where each is shorter."""
    held, length = [], 0
    for text in texts:
        if held and length + len(text) > CHARACTERS:
            yield held
            held, length = [], 0
        held.append(text)
        length += len(text)
    yield held


def _candidates(first: DataFrame) -> Callable[[Column], Column]:
    """Of a text, an array of ``at, size``: pieces that may be signatures."""
    size = F.length("__key")
    lengths = [r[0] for r in first.select(size.alias("n")).distinct().orderBy("n").collect()]
    whole = _bit_field(first, F.col("__key"))
    begins = _bit_field(first.where(size >= PREFIX), F.substring("__key", 1, PREFIX))

    def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of pieces of each text, their places and sizes."""
        windows = _Windows(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(texts)), sizes)

        def inside(places: np.ndarray, length: int) -> np.ndarray:
            return places[places + length <= ends[owner[places]]]

        everywhere = np.arange(len(owner))
        near = inside(everywhere, PREFIX)
        near = near[_holds(begins, windows.hashes(near, PREFIX))]
        found, long = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for length in lengths:
            places = inside(everywhere if length < PREFIX else near, length)
            places = places[_holds(whole, windows.hashes(places, length))]
            found.append(places)
            long.append(np.full(len(places), length))
        places, long = np.concatenate(found), np.concatenate(long)
        order = np.argsort(places, kind="stable")
        places, long = places[order], long[order]
        mine = owner[places]
        return np.bincount(mine, minlength=len(texts)), places - (ends - sizes)[mine], long

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("at", "size")])))
    def candidates(texts: pa.Array) -> pa.Array:
        parts = [pieces(some) for some in _batches([t or "" for t in texts.to_pylist()])]
        counts, at, long = map(np.concatenate, zip(*parts, strict=True))
        fields = [pa.array(at.astype(np.int32)), pa.array(long.astype(np.int32))]
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(fields, ["at", "size"]))

    return candidates


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _not_overlapping(starts: pa.Array, sizes: pa.Array) -> pa.Array:
    """Places in the lists of the matches that remain, each behind the end of the one before."""
    out = []
    for at, size in zip(starts.to_pylist(), sizes.to_pylist(), strict=True):
        kept, end = [], 0
        for i, start in enumerate(at):
            if start >= end:
                kept.append(i)
                end = start + size[i]
        out.append(kept)
    return pa.array(out, pa.list_(pa.int32()))


def signature_matches(df: DataFrame, text_col: str, ids: list[str], signatures: DataFrame) -> DataFrame:
    """``ids, detection_no, matched`` and the columns of the signature, in text order.

    ``signatures`` has pattern_no, pattern and further columns.  Letters of
    patterns are compared without case, those of texts from A to Z as well.
    Empty patterns and null texts match nothing.
    """
    first = _first_definitions(signatures)
    others = [c for c in signatures.columns if c not in ("pattern", "pattern_no")]
    # a byte that is no text would end the search of the others
    text = F.make_valid_utf8(text_col)
    rows = df.where(F.col(text_col).isNotNull()).select(
        *ids,
        F.monotonically_increasing_id().alias("__row"),
        text.alias("__text"),
        F.translate(text, _UPPER, _LOWER).alias("__low"),
    )
    rows = rows.withColumn("__found", _candidates(first)("__low"))
    # outer, because the plain form would infer a filter that searches every text again
    found = rows.select(*ids, "__row", "__text", "__low", F.explode_outer("__found").alias("__c"))
    at, size = F.col("__c.at"), F.col("__c.size")
    pieces = found.where("__c IS NOT NULL").select(
        *ids,
        "__row",
        at.alias("__at"),
        F.substr("__low", at + 1, size).alias("__key"),
        F.substr("__text", at + 1, size).alias("__matched"),
    )
    match = F.struct(
        F.col("__at").alias("at"),
        F.col("__first").alias("no"),
        F.length("__key").alias("size"),
        F.col("__matched").alias("matched"),
        F.col("__s").alias("s"),
    )
    matches = (
        pieces.join(first, "__key")
        .groupBy("__row", *ids)
        .agg(F.sort_array(F.collect_list(match)).alias("__m"))
        .withColumn("__kept", _not_overlapping("__m.at", "__m.size"))
    )
    return (
        matches.select(*ids, "__m", F.posexplode("__kept").alias("__no", "__i"))
        .withColumn("__match", F.get("__m", F.col("__i")))
        .select(
            *ids,
            (F.col("__no") + 1).alias("detection_no"),
            F.col("__match.matched").alias("matched"),
            *(F.col(f"__match.s.{c}").alias(c) for c in others),
        )
    )
