"""Byte-level BPE encoding and decoding.

A text is cut into words by the tokenizer's pattern.  A word is its UTF-8 bytes,
written as pieces of two hexadecimal digits per byte; a fold over the array of
pieces merges, step by step, the leftmost pair of lowest rank, until no pair has
one.  Ranks come from a literal map, cut into buckets by a hash of the piece so
that a lookup reads one short map.  Decoding concatenates the binary pieces of
the ids.

Words repeat, so each different word is folded once: a grouped count finds the
words, the frequent ones are folded as a table and sent to the tasks, and a pass
over the texts looks them up in Arrow batches.  The count from which a word is
frequent is chosen so that there are ``KNOWN_WORDS`` of them at most, each of
``KNOWN_BYTES`` bytes at most, which bounds what is sent.  All other words are
folded where they occur, in the row of their document, once per document.  So
texts are never shuffled and no table of all words is joined.

Words longer than ``FOLD_BYTES`` would take the fold quadratic time; they are
merged with a heap instead, by the same rule.

Cases: a null or empty text has no ids and decodes to nothing.  Texts are read
whole.  Rows that repeat an id are encoded each on its own.  An empty table
gives an empty result.  Columns of the input are kept, those called like an
added one are replaced.  Letters and numbers are those of the Java version's
Unicode tables.
"""

from __future__ import annotations

import base64
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import literal_json, need, written

#: White space of the tokenizer's pattern; Java's own class has ASCII only (fixed values).
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Buckets of the rank map.
BUCKETS = 1 << 16
#: Most frequent words sent to the tasks, and the longest of them.
KNOWN_WORDS = 1 << 19
KNOWN_BYTES = 64
#: Longest word that is folded.
FOLD_BYTES = 512
#: Documents that are looked up at a time.
TOGETHER = 500
#: No rank.
NONE = 2**31 - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def java_pattern(pattern: str) -> str:
    """The tokenizer's pattern with its white space spelled out."""
    return (
        pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]")
        .replace(r"(?!\S)", rf"(?![^{SPACE}])")
        .replace(r"\s+", f"[{SPACE}]+")
    )


def words_of(text: Column, pattern: str) -> Column:
    """All matches of the pattern; none for a null text."""
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0)),
        F.array().cast("array<string>"),
    )


class Ranks:
    """Literal columns of a rank table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.json: str | None = None
        size = max(ranks.values(), default=-1) + 1
        self.pieces = [""] * size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece.hex().upper()

    def with_map(self, df: DataFrame) -> DataFrame:
        """Adds ``_ranks``: array of maps from piece to rank, by hash of the piece."""
        if self.json is None:
            buckets = (
                df.sparkSession.range(1)
                .select(
                    F.posexplode(literal_json(self.pieces, "array<string>")).alias("rank", "piece")
                )
                .where("piece <> ''")
                .groupBy(_bucket(F.col("piece")).alias("bucket"))
                .agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("piece", "rank")))).alias("m"))
                .collect()  # as many entries as the vocabulary has
            )
            table = ["{}"] * BUCKETS
            for bucket, entries in buckets:
                table[bucket] = entries
            self.json = f"[{','.join(table)}]"
        return df.withColumn("_ranks", F.from_json(F.lit(self.json), "array<map<string,int>>"))


def _bucket(piece: Column) -> Column:
    return F.pmod(F.hash(piece), F.lit(BUCKETS))


def _rank(ranks: Column, piece: Column) -> Column:
    found = F.element_at(F.get(ranks, _bucket(piece)), piece)
    return F.coalesce(found, F.lit(NONE))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Stands before and behind the pieces; no pair with it has a rank.
EDGE = "|"


def _joined(*arrays: Column) -> Column:
    """Like concat, which is slow on arrays inside a lambda."""
    return F.flatten(F.array(*arrays))


def _merged(ranks: Column, state: Column) -> Column:
    """One merge; state is struct<pieces, pairs>, pairs the rank of each neighbouring pair."""
    pieces, pairs = state["pieces"], state["pairs"]
    rest = F.lit(4 * FOLD_BYTES)  # more than there is

    def at(i: Column) -> Column:
        def with_piece(one: Column) -> Column:
            before = _rank(ranks, F.concat(F.get(pieces, i - 2), one))
            after = _rank(ranks, F.concat(one, F.get(pieces, i + 1)))
            return F.struct(
                _joined(
                    F.slice(pieces, F.lit(1), i - 1), F.array(one), F.slice(pieces, i + 2, rest)
                ).alias("pieces"),
                _joined(
                    F.slice(pairs, F.lit(1), i - 2), F.array(before, after), F.slice(pairs, i + 2, rest)
                ).alias("pairs"),
            )

        one = F.concat(F.get(pieces, i - 1), F.get(pieces, i))
        return F.when(F.get(pairs, i - 1) == NONE, state).otherwise(_let(one, with_piece))

    return _let(F.array_position(pairs, F.array_min(pairs)).cast("int"), at)


def folded(words: Column, ranks: Column) -> Column:
    """Ids of every word of an array, by folding merges over its bytes."""

    def of(word: Column, ranks: Column) -> Column:
        def start(pieces: Column) -> Column:
            pairs = F.transform(
                F.slice(pieces, F.lit(1), F.size(pieces) - 1),
                lambda p, i: _rank(ranks, F.concat(p, F.get(pieces, i + 1))),
            )
            return F.struct(pieces.alias("pieces"), pairs.alias("pairs"))

        def run(first: Column) -> Column:
            return F.aggregate(
                F.slice(first["pieces"], F.lit(4), F.size(first["pieces"])),
                first,
                lambda state, _: _merged(ranks, state),
                lambda state: F.transform(
                    F.slice(state["pieces"], F.lit(2), F.size(state["pieces"]) - 2),
                    lambda p: _rank(ranks, p),
                ),
            )

        def ids(digits: Column) -> Column:
            places = F.sequence(F.lit(1), (F.length(digits) / 2).cast("int"))
            pieces = F.transform(places, lambda i: F.substring(digits, i * 2 - 1, F.lit(2)))
            edge = F.array(F.lit(EDGE))
            split = _let(_let(F.concat(edge, pieces, edge), start), run)
            return _let(
                _rank(ranks, digits), lambda r: F.when(r != NONE, F.array(r)).otherwise(split)
            )

        return _let(F.hex(F.encode(word, "UTF-8")), ids)

    # bound once, so that the plan holds the rank map once
    return _let(ranks, lambda ranks: F.transform(words, lambda word: of(word, ranks)))


def heap_merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs; for words too long to fold."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # end of the piece that begins here
    before = list(range(-1, n - 1))
    alive = [True] * n
    pairs: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            rank = ranks.get(word[i : end[end[i]]])
            if rank is not None:
                heapq.heappush(pairs, (rank, i, end[end[i]]))

    for i in range(n - 1):
        offer(i)
    while pairs:
        _, i, stop = heapq.heappop(pairs)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def known_words(docs: DataFrame, ranks: Ranks, pattern: str, text: str = "text") -> DataFrame:
    """word, ids of the frequent words, ``KNOWN_WORDS`` at most."""
    counted = (
        docs.select(F.explode(words_of(F.col(text), pattern)).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where((F.col("n") > 1) & (F.octet_length("word") <= KNOWN_BYTES))
    )
    counted = written(counted, "bpe-words")
    level = F.floor(F.log2(F.col("n").cast("double")) * 4)
    room, least = KNOWN_WORDS, NONE
    by_level = counted.groupBy(level.alias("level")).agg(
        F.count("*").alias("words"), F.min("n").alias("least")
    )
    for row in by_level.orderBy(F.desc("level")).collect():  # a few hundred rows
        room -= row["words"]
        if room < 0:
            break
        least = row["least"]
    chosen = ranks.with_map(counted.where(F.col("n") >= least).repartition("word"))
    return written(
        chosen.select("word", F.get(folded(F.array("word"), F.col("_ranks")), F.lit(0)).alias("ids")), "bpe-known"
    )


def encoded(
    docs: DataFrame, known: DataFrame, ranks: Ranks, pattern: str, text: str = "text"
) -> DataFrame:
    """Adds ``ids``: array<int> of every text."""
    need(docs, text)
    sent = _sent(known, ranks)
    kind = "struct<ids: array<int>, rare: array<string>>"

    @F.arrow_udf(kind)
    def looked_up(words: pa.Array) -> pa.Array:
        starts = range(0, max(len(words), 1), TOGETHER)
        found = pa.concat_arrays([part(words.slice(k, TOGETHER)) for k in starts])
        pa.default_memory_pool().release_unused()
        return found

    def part(words: pa.Array) -> pa.Array:
        """Ids of the known words; the k-th other word of a document as -k - 1, kept in rare."""
        names, offsets, flat, rank = sent.value
        ends = words.offsets.to_numpy().astype(np.int64)
        all_words = words.flatten()
        ends = ends - ends[0]
        place = pc.index_in(all_words, value_set=names).to_numpy(zero_copy_only=False)
        unknown = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), bool)
        place = np.where(unknown, 0, place).astype(np.int64)
        if len(names):
            start, sizes = offsets[place], offsets[place + 1] - offsets[place]
        else:
            start, sizes = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        long_ids: dict[int, list[int]] = {}
        codes = np.zeros(len(place), np.int64)
        rare: list[list[str]] = []
        missing = np.flatnonzero(unknown)
        texts = all_words.take(pa.array(missing)).to_pylist()
        cuts = np.searchsorted(missing, ends)
        for a, b in itertools.pairwise(cuts):
            places: dict[str, int] = {}
            for at, word in zip(missing[a:b], texts[a:b], strict=True):
                raw = word.encode()
                if len(raw) > FOLD_BYTES:
                    long_ids[int(at)] = heap_merged(raw, rank)
                else:
                    codes[at] = -1 - places.setdefault(word, len(places))
            rare.append(list(places))
        sizes[missing] = 1
        for at, found in long_ids.items():
            sizes[at] = len(found)
        first = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
        source = np.repeat(start, sizes) + inside
        from_known = ~np.repeat(unknown, sizes)
        out = np.repeat(codes, sizes)
        out[from_known] = flat[source[from_known]] if len(flat) else 0
        for at, found in long_ids.items():
            out[first[at] : first[at + 1]] = found
        ids = pa.ListArray.from_arrays(
            pa.array(first[ends], pa.int32()), pa.array(out, pa.int32())
        )
        return pa.StructArray.from_arrays(
            [ids, pa.array(rare, pa.list_(pa.string()))], ["ids", "rare"]
        )

    @F.arrow_udf("array<int>")
    def filled(codes: pa.Array, rare: pa.Array) -> pa.Array:
        starts = range(0, max(len(codes), 1), TOGETHER)
        return pa.concat_arrays([_filled(codes.slice(k, TOGETHER), rare.slice(k, TOGETHER)) for k in starts])

    rows = ranks.with_map(docs.withColumn("_found", looked_up(words_of(F.col(text), pattern))))
    # generated as a row of its own: Spark runs no Arrow function on an expression with lambdas
    rare = F.explode(F.array(folded(F.col("_found.rare"), F.col("_ranks"))))
    rows = rows.select(*docs.columns, "_found", rare.alias("_rare"))
    return rows.withColumn("ids", filled("_found.ids", "_rare")).drop("_found", "_rare")


def _sent(known: DataFrame, ranks: Ranks):
    """Broadcast of the known words and their ids; KNOWN_WORDS short words at most."""
    table = known.toArrow()
    ids = table["ids"].combine_chunks()
    value = (
        table["word"].combine_chunks(),
        ids.offsets.to_numpy().astype(np.int64),
        ids.flatten().to_numpy().astype(np.int32),
        ranks.ranks,
    )
    sent = known.sparkSession.sparkContext.broadcast(value)
    del table, ids, value
    pa.default_memory_pool().release_unused()
    return sent


def _spans(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lists, from 0, and their values."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], lists.flatten()


def _filled(codes: pa.ListArray, rare: pa.ListArray) -> pa.ListArray:
    """The ids with code -k - 1 replaced by the ids of the k-th rare word of the row."""
    ends, flat = _spans(codes)
    first, words = _spans(rare)
    starts, ids = _spans(words)
    flat, ids = flat.to_numpy(), ids.to_numpy()
    open_ = np.flatnonzero(flat < 0)
    row = np.searchsorted(ends, open_, "right") - 1
    word = first[row] - flat[open_] - 1
    sizes = np.ones(len(flat), np.int64)
    sizes[open_] = starts[word + 1] - starts[word]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begin[-1], np.int32)
    known = flat >= 0
    out[begin[:-1][known]] = flat[known]
    many = sizes[open_]
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    out[np.repeat(begin[:-1][open_], many) + inside] = ids[np.repeat(starts[word], many) + inside]
    return pa.ListArray.from_arrays(pa.array(begin[ends].astype(np.int32)), pa.array(out))


def decoded(ids: Column, ranks: Ranks) -> Column:
    """The bytes of the ids: their pieces, one after the other."""
    pieces = pa.array([bytes.fromhex(piece) for piece in ranks.pieces], pa.binary())

    def joined(lists: pa.ListArray) -> pa.Array:
        ends, flat = _spans(lists)
        taken = pieces.take(flat)
        bounds = np.frombuffer(taken.buffers()[1], np.int32)[ends]
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds), taken.buffers()[2]])

    @F.arrow_udf("binary")
    def text(lists: pa.Array) -> pa.Array:
        starts = range(0, max(len(lists), 1), TOGETHER)
        return pa.concat_arrays([joined(lists.slice(k, TOGETHER)) for k in starts])

    return text(ids)


def packed(ids: Column, ranks: Ranks) -> Column:
    """The ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def raw(lists: pa.Array) -> pa.Array:
        ends, flat = _spans(lists)
        data = flat.to_numpy().astype("<u4").tobytes()
        bounds = (4 * ends).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds), pa.py_buffer(data)])

    return raw(ids)
