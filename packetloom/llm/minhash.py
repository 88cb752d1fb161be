"""MinHash near-dedup by an inverted join on signature coordinates.

A document is a set of word shingles, hashed to 64 bits.  Equal sets are one
class from the start.  Every class has a signature of ``HASHES`` coordinates and
is posted under each (coordinate, value) pair.  Documents of the wanted
similarity agree in at least ``match_threshold`` coordinates, or are missed with
probability ``MISS`` at most.  So of the lists that a class shares with others
only the rarest matter: all but ``match_threshold - 1`` of them (prefix), and a
class that shares fewer lists than the threshold is skipped altogether.

A class is posted under the lists of its prefix with a byte of each coordinate.
In every list the classes whose bytes agree in at least ``match_threshold``
places are connected, which all of the wanted similarity do; what is connected
is linked to its smallest class, so pairs are not written.  So classes that merely share some list with
one another, as more and more do in larger tables, stay apart.

Connected classes form a cluster, which holds every link of its members.  A
cluster of up to ``PIECE`` classes is one row group: a task counts the shingles
that its members have in common with a matrix product and links the similar ones
to the smallest they reach.  A larger cluster is cut into pieces that meet in pairs.  Before that,
each of its classes is compared with one member of each of its lists, which is
linear: agreeing coordinates are counted, pairs above the threshold are confirmed
on the full shingle sets, and the largest component found is left out of
comparisons with itself.  No link between components is lost.

Signatures and sets are made in Arrow batches, one document at a time; joins,
counts and confirmation are DataFrame code.  Sets are only made for classes of
clusters; which these are goes to the tasks as a Bloom filter of fixed size,
exact joins follow.

Cases: a null or empty text, or one without words, has no shingles and is linked
with nothing; with fewer words than a shingle the whole sequence is the only
one.  Texts are read whole.  Rows with a null id are linked with nothing.
Rows that repeat an id share its component.  An empty table gives an empty
result.  Further columns are left out of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import drop_written, need, runs, stars, written
from packetloom.llm.components import components

#: Words of a shingle and least similarity in percent, unless the caller says otherwise.
WORDS = 5
PERCENT = 80
#: Coordinates of a signature, and the accepted chance to miss a link for too few matches.
HASHES = 32
MISS = 1e-6
#: Classes that are compared in one piece, and shingles counted at a time.
PIECE = 512
COLUMNS = 1 << 13
#: Lists of up to so many classes are compared together; of longer ones SEEDS classes at a time.
FEW = 16
SEEDS = 64
#: Posted classes that a task compares at a time, or one list if it is longer.
ROWS = 1 << 15
#: Bits of the Bloom filter (2 MB), whatever the size of the data.
BLOOM_BITS = 1 << 24
_CHUNK = 1 << 15

_SEEDS = np.random.default_rng(20250101).integers(1, 1 << 63, (2, HASHES), dtype=np.int64)
_FACTORS = (_SEEDS[0].astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_SHIFTS = _SEEDS[1].astype(np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def match_threshold(percent: float, hashes: int = HASHES, miss: float = MISS) -> int:
    """Coordinates in which documents of that similarity agree but for the chance ``miss``."""
    p, below = percent / 100, 0.0
    for t in range(hashes + 1):
        below += math.comb(hashes, t) * p**t * (1 - p) ** (hashes - t)
        if below > miss:
            return max(t, 1)
    return hashes


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text.

    ASCII letters count as lower case; words end at the six ASCII white spaces.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = min(words, len(found))
    out = np.full(len(found) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ hashed[i : i + len(out)]) * _STEP
        out ^= out >> np.uint64(29)
    out *= _MIX
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(hashes: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK, None] * _FACTORS + _SHIFTS
        np.minimum(low, part.min(axis=0), out=low)
    return low


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits as text; null without shingles), sig."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found) if len(found) else found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), _lists(sigs)],
                ["doc_id", "n_shingles", "set_key", "sig"],
            )

    kind = "doc_id long, n_shingles long, set_key string, sig array<long>"
    return docs.select("doc_id", "text").mapInArrow(rows, kind)


def _marks(sig: str) -> Column:
    """A byte of each coordinate; they agree where the coordinates do, and in 1 of 256 other places."""
    byte = lambda x: F.shiftrightunsigned(x, 24).bitwiseAND(F.lit(255))
    return F.transform(sig, lambda x: (byte(x) - 128).cast("tinyint"))


def chained(marks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect all rows which agree in enough places, not all their pairs.

    ``SEEDS`` rows at a time meet those that nothing has met yet.  Rows of one
    list of near copies are all met by the first, and none is left.
    """
    places = np.ascontiguousarray(marks.T)
    alone, met = np.arange(len(marks)), np.empty(0, np.int64)
    i, j = [], []
    while len(alone):
        if len(met):
            seeds, met = met[:SEEDS], met[SEEDS:]
        else:
            seeds, alone = alone[:SEEDS], alone[SEEDS:]
        others = np.concatenate([seeds, alone])
        same = np.zeros((len(seeds), len(others)), np.uint8)
        for place in places:
            same += place[seeds][:, None] == place[others]
        near = same >= least
        first = near.argmax(axis=0)
        found = near.any(axis=0)
        i.append(seeds[first[found]])
        j.append(others[found])
        # seeds that meet the same row are connected by it
        for rows in np.unique(np.packbits(near[:, found], axis=0), axis=1).T:
            together = seeds[np.flatnonzero(np.unpackbits(rows, count=len(seeds)))]
            i.append(together[:-1])
            j.append(together[1:])
        found = found[len(seeds) :]
        met, alone = np.concatenate([met, alone[found]]), alone[~found]
    return np.concatenate(i or [met]), np.concatenate(j or [met])


def agreeing(lists: np.ndarray, marks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect the rows of a list, which stand together, that agree in enough places."""
    cuts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]]))
    sizes = np.diff(cuts)
    left = np.repeat(cuts[1:], sizes) - np.arange(len(lists))
    few = np.repeat(sizes <= FEW, sizes)
    i, j = [], []
    for step in range(1, min(FEW, int(sizes.max()))):
        a = np.flatnonzero(few & (left > step))
        a = a[(marks[a] == marks[a + step]).sum(axis=1) >= least]
        i.append(a)
        j.append(a + step)
    for k in np.flatnonzero(sizes > FEW):
        a, b = chained(marks[cuts[k] : cuts[k + 1]], least)
        i.append(cuts[k] + a)
        j.append(cuts[k] + b)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *i]), np.concatenate([none, *j])


def _agreeing(least: int):
    def links(table: pa.Table) -> pa.RecordBatch:
        reps = table["rep"].to_numpy()
        marks = table["mark"].combine_chunks().flatten().to_numpy().reshape(-1, HASHES)
        i, j = agreeing(table["list"].to_numpy(), marks, least)
        a, b = stars(reps, i, j)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, ROWS
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                table = pa.Table.from_batches(held)
                lists = table["list"].to_numpy()
                last = int(np.flatnonzero(lists != lists[-1])[-1]) + 1 if lists[0] != lists[-1] else 0
                if last:
                    yield links(table.slice(0, last))
                held = table.slice(last).to_batches()
                n -= last
                most = max(ROWS, 2 * n)
        if n:
            yield links(pa.Table.from_batches(held))

    return rows


def _bits(hashed: Column) -> Column:
    """The four places of an id in the Bloom filter."""
    step = F.shiftrightunsigned(hashed, 32).bitwiseOR(F.lit(1))
    return F.array(
        *[(hashed + step * F.lit(i)).bitwiseAND(F.lit(BLOOM_BITS - 1)) for i in range(4)]
    )


def _bloom(ids: DataFrame) -> np.ndarray:
    bit = F.explode(_bits(F.xxhash64("rep"))).alias("bit")
    words = (
        ids.select(bit)
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
        .toArrow()  # BLOOM_BITS / 64 rows at most
    )
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _sets(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """rep, set: the shingle sets of the named documents."""
    sent = docs.sparkSession.sparkContext.broadcast(_bloom(reps))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = sent.value
        for batch in batches:
            hashed = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            hashed = hashed.view(np.uint64)
            step = (hashed >> np.uint64(32)) | np.uint64(1)
            maybe = np.ones(len(hashed), bool)
            for i in range(4):
                bit = (hashed + step * np.uint64(i)) & np.uint64(BLOOM_BITS - 1)
                maybe &= (filled[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            chosen = batch.filter(pa.array(maybe))
            found = [shingles(text, words) for text in chosen.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([chosen.column(0), _lists(found)], ["rep", "set"])

    hashed = F.xxhash64("doc_id").alias("h")
    made = (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", "text", hashed)
        .mapInArrow(rows, "rep long, set array<long>")
    )
    return made.join(reps, "rep", "left_semi")


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, least: int, percent: float):
    """The pairs (a, b) that agree in enough coordinates and whose sets are similar enough."""
    of = lambda t, name, col: t.select(F.col("rep").alias(name), F.col(col).alias(f"{col}_{name}"))
    agreeing = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda m: m))
    likely = (
        pairs.join(of(sigs, "a", "sig"), "a")
        .join(of(sigs, "b", "sig"), "b")
        .where(agreeing >= least)
        .select("a", "b")
        .distinct()
    )
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return (
        likely.join(of(sets, "a", "set"), "a")
        .join(of(sets, "b", "set"), "b")
        .where(100 * both.cast("double") >= percent * either.cast("double"))
        .select("a", "b")
        .distinct()
    )


def _whole(placed: DataFrame) -> DataFrame:
    """Clusters of one piece."""
    return placed.select(
        "rep", F.xxhash64("cluster").alias("key"), F.lit(0).alias("side"), F.lit(True).alias("own")
    )


def _cut(rooted: DataFrame) -> DataFrame:
    """Clusters of many pieces: each piece outside the largest component meets all pieces."""
    counts = rooted.groupBy("cluster", "root").agg(F.count("*").alias("n_root"))
    main = counts.groupBy("cluster").agg(
        F.max(F.struct("n_root", "root")).alias("main"), F.sum("n_root").alias("n_all")
    )
    pieces = lambda n: F.ceil(n / PIECE).cast("int")
    rows = (
        rooted.select("rep", "cluster", "root")
        .join(main, "cluster")
        .withColumn("inside", F.col("root") == F.col("main.root"))
        .withColumn("n_in", pieces(F.col("main.n_root")))
        .withColumn("n_out", pieces(F.col("n_all") - F.col("main.n_root")))
        .where(F.col("n_out") > 0)
    )
    place = F.when(F.col("inside"), F.pmod(F.xxhash64("rep"), F.col("n_in"))).otherwise(
        F.col("n_in") + F.pmod(F.xxhash64("rep"), F.col("n_out"))
    )
    first = F.when(F.col("inside"), F.col("n_in")).otherwise(F.lit(0))
    rows = rows.withColumn("piece", place.cast("int")).withColumn(
        "other", F.explode(F.sequence(first, F.col("n_in") + F.col("n_out") - 1))
    )
    low, high = F.least("piece", "other"), F.greatest("piece", "other")
    return rows.select(
        "rep",
        F.xxhash64("cluster", low, high).alias("key"),
        (F.col("piece") != low).cast("int").alias("side"),
        (low == high).alias("own"),
    )


def similar_rows(sets: list[np.ndarray], percent: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the sets that are similar enough, by counting common shingles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # others add nothing to any intersection
    number = np.cumsum(times > 1) - 1
    rows, column = rows[shared], number[column[shared]]
    both = np.zeros((len(sets), len(sets)))
    for start in range(0, int((times > 1).sum()), COLUMNS):
        here = (column >= start) & (column < start + COLUMNS)
        part = np.zeros((len(sets), min(COLUMNS, int(column.max()) + 1 - start)), np.float32)
        part[rows[here], column[here] - start] = 1
        both += part @ part.T
    either = sizes[:, None] + sizes[None, :] - both
    i, j = np.nonzero(np.triu(100 * both >= percent * either, 1))
    return i, j


def _pieces(percent: float):
    def links(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        reps, side = table["rep"].to_numpy(), table["side"].to_numpy()
        sets = [np.array(x, np.int64) for x in table["set"].to_pylist()]
        i, j = similar_rows(sets, percent)
        if not table["own"][0].as_py():
            apart = side[i] != side[j]
            i, j = i[apart], j[apart]
        return stars(reps, i, j)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "key"):
            if table.num_rows > 1:
                a, b = links(table)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = WORDS,
    percent: float = PERCENT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have a Jaccard similarity of ``percent`` or
    more are linked; ``component_id`` is the smallest id reachable, ``kept``
    holds for it alone (and for rows with a null id).
    """
    need(docs, doc_id, text)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    least = match_threshold(percent)
    signed = written(_signed(docs, words), "signatures")
    named = signed.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    rep = F.coalesce("rep", "doc_id")
    members = written(
        signed.join(classes, "set_key", "left").select(
            "doc_id",
            "n_shingles",
            rep.alias("rep"),
            F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig"),
        ),
        "classes",
    )
    drop_written(signed)
    sigs = members.where(F.col("sig").isNotNull()).select("rep", "sig")

    posted = sigs.select("rep", F.posexplode("sig").alias("place", "value")).select(
        "rep", F.xxhash64("place", "value").alias("list")
    )
    shared = posted.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rarest = (
        posted.join(shared, "list")
        .groupBy("rep")
        .agg(F.array_sort(F.collect_set(F.struct("n", "list"))).alias("lists"))
        .where(F.size("lists") >= least)
    )
    prefix = F.slice("lists", 1, F.size("lists") - least + 1)["list"]
    marks = sigs.groupBy("rep").agg(F.collect_set(_marks("sig")).alias("marks"))
    postings = written(
        rarest.select("rep", prefix.alias("lists")).join(marks, "rep"), "postings"
    )
    agreed = written(
        postings.select("rep", F.explode("marks").alias("mark"), "lists")
        .select("rep", "mark", F.explode("lists").alias("list"))
        .repartition("list")
        .sortWithinPartitions("list", "rep")
        .mapInArrow(_agreeing(least), "a long, b long"),
        "agreeing",
    )
    clusters = components(agreed)
    clusters = clusters.unionAll(clusters.select("root", "root").distinct())
    clusters = clusters.select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    placed = written(clusters.join(sizes, "cluster"), "clusters")
    sets = written(_sets(docs, placed.select("rep"), words), "sets")

    large = placed.where(F.col("n") > PIECE)
    n_large = large.count()
    links = None
    if n_large:
        sigs = written(sigs.join(large.select("rep"), "rep", "left_semi"), "candidates")
        met = postings.select("rep", F.explode("lists").alias("list")).join(large, "rep")
        hubs = met.groupBy("list", "cluster").agg(F.min("rep").alias("hub"))
        tried = met.join(hubs, ["list", "cluster"]).where(F.col("rep") != F.col("hub"))
        tried = tried.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
        links = written(_confirmed(tried, sigs, sets, least, percent), "hub-links")
        found = components(links).withColumnRenamed("node", "rep")
        rooted = large.join(found, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        cut = written(_cut(rooted), "cut")
        keyed = cut.unionAll(_whole(placed.where(F.col("n") <= PIECE)))
    else:
        keyed = _whole(placed)
    compared = written(
        keyed.join(sets, "rep")
        .repartition("key")
        .sortWithinPartitions("key", "side", "rep")
        .mapInArrow(_pieces(percent), "a long, b long"),
        "piece-links",
    )
    roots = components(compared if links is None else compared.unionAll(links))

    component = members.join(roots, F.col("rep") == F.col("node"), "left").withColumn(
        "component_id", F.coalesce("root", "rep")
    )
    return component.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
