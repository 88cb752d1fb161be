"""Token-id files: one zstandard frame per document and a seek table at the end.

A file is a sequence of independent zstandard frames, one per document, each
with zstandard's own content checksum, followed by one skippable frame that
holds the seek table: for every document its id, the ids before it, its number
of ids, place and size of its frame, and the CRC-32 of its ids.  A reader loads
the table from the end and decompresses only the frames it was asked for.  The
whole file is a valid zstandard stream.

Writing: texts become ids where they are read, in Arrow batches; a word that was
seen before is looked up, the library encodes the others.  Only the packed ids
are shuffled, to files by ranges of document ids whose bounds are quantiles, and
sorted.  A task writes each of its files under a temporary name and renames it,
so a repeated task replaces its own work.  The number of ids before each file
follows from the manifest, one row per file.

Cases: a null or empty text is the end id alone.  Texts are read whole.
Documents with a null id come first.  Rows that repeat an id are written next to
each other, in the order of their ids' bytes.  An empty table gives no file.
Further columns are left out.
"""

from __future__ import annotations

import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.llm.common import need, once_per_worker, scratch_path, written

#: About as many documents share a file.
FILE_DOCUMENTS = 8192
LEVEL = 3
#: Texts whose new words are learnt together.
TOGETHER = 256
#: Words that a worker remembers, and as many that it has not seen for longer.
CACHE_WORDS = 720_000

#: Zstandard's magic number of a skippable frame, and this format's.
SKIPPABLE = 0x184D2A5E
MAGIC = b"TOKSEEK1"
ENTRY = "<qBQQQII"  # doc_id, null id, start, ids, offset, bytes, crc32
FOOTER = "<IB8s"  # entries, bytes of an id, magic

#: Characters at which str.split cuts but white space of the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Latin letters but İ, whose lower case is two characters; the second joins the marks behind it.
_LATIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,!?]*)")


class Encoder:
    """Ids of whole texts by a tokenizer file whose tokens do not span white space."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)", re.IGNORECASE)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [self._packed(e.ids) for e in found]

    def _letters(self, words: list[str]) -> None:
        """Learn words of letters only; each ends with the only token that ends a word."""
        if not words:
            return
        found = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found[0].ids, self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words):
            raw, ends = ids.tobytes(), [0, *(cuts * self.kind.itemsize).tolist()]
            packed = [raw[a:b] for a, b in itertools.pairwise(ends)]
        else:
            packed = self._direct(words)
        self.known.update(zip(words, packed, strict=True))

    def _learn(self, words: set[str]) -> None:
        """Words of Latin letters are learnt without the marks behind them, others as they are."""
        split, other = {}, []
        for word in words:
            m = _LATIN_WORD.fullmatch(word)
            if m:
                core, marks = m.groups()
                split[word] = (core.lower() if core.isascii() else core, marks)
            else:
                other.append(word)
        cores = {core for core, _ in split.values()}
        self._letters([w for w in cores if w not in self.known])
        marks = {marks for _, marks in split.values() if marks}
        other += [w for w in marks if w not in self.known]
        self.known.update(zip(other, self._direct(other), strict=True))
        for word, (core, marks) in split.items():
            self.known[word] = self.known[core] + (self.known[marks] if marks else b"")

    def _forget(self) -> None:
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        self._forget()
        get = self.known.get
        cut, parts, new = [], [], set()
        for text in texts:
            odd = _SEPARATORS.search(text) or "<" in text and self.special.search(text)
            words = text.split() if not odd else []
            found = [self._direct([text])[0]] if odd else list(map(get, words))
            if None in found:
                new.update([word for word, ids in zip(words, found, strict=True) if ids is None])
            cut.append(words)
            parts.append(found)
        if new:
            again = {word: self.older[word] for word in new if word in self.older}
            self.known.update(again)
            self._learn(new.difference(again))
        known = self.known
        return [
            b"".join([known[w] if p is None else p for w, p in zip(words, found, strict=True)])
            if None in found
            else b"".join(found)
            for words, found in zip(cut, parts, strict=True)
        ]


def encoder(path: str) -> Encoder:
    """One encoder per worker and file, with what it has learnt."""
    return once_per_worker(f"encoder {path}", lambda: Encoder(path))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


class FileWriter:
    """Writes one file; it appears under its name when it is closed."""

    def __init__(self, uri: str, width: int) -> None:
        self.fs, self.path = _file_system(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.width, self.entries, self.offset, self.ids = width, [], 0, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, doc_id: int | None, packed: bytes) -> None:
        ids = np.frombuffer(packed, f"<u{self.width}")
        frame = self.packer.compress(packed)
        entry = (doc_id or 0, doc_id is None, self.ids, len(ids), self.offset, len(frame), crc_of(ids))
        self.entries.append(struct.pack(ENTRY, *entry))
        self.out.write(frame)
        self.offset += len(frame)
        self.ids += len(ids)

    def close(self) -> None:
        footer = struct.pack(FOOTER, len(self.entries), self.width, MAGIC)
        table = b"".join(self.entries) + footer
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.temporary, self.path)


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str) -> None:
        fs, path = _file_system(uri)
        self.file = fs.open_input_file(path)
        table = self.file.size() - struct.calcsize(FOOTER)
        footer = self.file.read_at(struct.calcsize(FOOTER), table)
        n, self.width, magic = struct.unpack(FOOTER, footer)
        if magic != MAGIC:
            raise ValueError(f"{uri} has no seek table")
        size = n * struct.calcsize(ENTRY)
        self.entries = list(struct.iter_unpack(ENTRY, self.file.read_at(size, table - size)))
        self.unpacker = zstandard.ZstdDecompressor()

    def ids(self, entry: tuple) -> np.ndarray:
        """The ids of one document; its frame alone is read and decompressed."""
        return np.frombuffer(self.unpacked(entry), "<u4")

    def unpacked(self, entry: tuple) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, with the checksum of the seek table."""
        _, _, _, n, offset, size, crc = entry
        frame = self.file.read_at(size, offset)
        found = np.frombuffer(self.unpacker.decompress(frame), f"<u{self.width}")
        packed = found.astype("<u4").tobytes()
        if len(found) != n or zlib.crc32(packed) != crc:
            raise ValueError("a document does not have the checksum in the seek table")
        return packed

    def documents(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        wanted = set(doc_ids)
        for entry in self.entries:
            if not entry[1] and entry[0] in wanted:
                yield entry[0], self.ids(entry)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    *,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write all documents to ``folder``; returns the manifest: file, path, docs, ids, start."""
    need(docs, doc_id, text)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = docs.count()
    files = max(1, -(-n // FILE_DOCUMENTS))
    ranges = docs.select("doc_id").repartitionByRange(files, "doc_id")
    lows = ranges.groupBy(F.spark_partition_id().alias("range")).agg(F.min("doc_id").alias("low"))
    bounds = np.array([r.low for r in lows.where("low IS NOT NULL").collect()], np.int64)  # one per file
    bounds = np.sort(bounds)[1:]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder(tokenizer_path)
        end = np.array([end_id], encode_text.kind).tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            groups = [texts[k : k + TOGETHER] for k in range(0, len(texts), TOGETHER)]
            packed = [x + end for group in groups for x in encode_text(group)]
            places = np.searchsorted(bounds, [-(1 << 63) if i is None else i for i in ids], "right")
            width = pa.array([encode_text.kind.itemsize] * len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int32()), batch.column(0), width, pa.array(packed, pa.binary())],
                ["file", "doc_id", "width", "packed"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, number = None, None

        def closed():
            writer.close()
            row = (number, f"{folder}/part-{number:08d}.tok", len(writer.entries), writer.ids)
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)],
                ["file", "path", "docs", "ids"],
            )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for file, doc, width, packed in zip(*columns, strict=True):
                if file != number:
                    if writer:
                        yield closed()
                    number, writer = file, FileWriter(f"{folder}/part-{file:08d}.tok", width)
                writer.add(doc, packed)
        if writer:
            yield closed()

    hadoop = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    conf = docs.sparkSession.sparkContext._jsc.hadoopConfiguration()
    hadoop.getFileSystem(conf).mkdirs(hadoop)
    encoded = docs.mapInArrow(encode, "file int, doc_id long, width int, packed binary")
    manifest = written(
        encoded.repartition(files, "file")
        .sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "packed")
        .mapInArrow(write, "file int, path string, docs long, ids long"),
        "manifest",
    )
    # one row per file, so the window without partitions holds no documents
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                reader = FileReader(path)
                for k in range(0, len(reader.entries), 1024):
                    entries = reader.entries[k : k + 1024]
                    ids = [reader.unpacked(e) for e in entries]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if e[1] else e[0] for e in entries], pa.int64()),
                            pa.array([start + e[2] for e in entries], pa.int64()),
                            pa.array([e[3] for e in entries], pa.int64()),
                            pa.array([e[6] for e in entries], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    files = manifest.count()  # a task per file: the manifest itself is one small partition
    return (
        manifest.select("path", "start", "file")
        .repartition(max(files, 1), "file")
        .select("path", "start")
        .mapInArrow(read, kind)
    )


def new_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "token-files")
