"""SentencePiece ids against the library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from packetloom.llm import piece_bpe
from packetloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "²½³ĳaabbcethe  \n\t▁.,;'éèñ中文日本\U0001f600​<s>0x12AKIA_-ﬁ\x00"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def decode(ours, ids):
    return ours.decode(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def test_random_texts(library):
    ours, rng = piece_bpe.Vocabulary(PATH), random.Random(4)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += [x for n in range(1, 70) for x in (" " * n, " " * n + "a", "a" * n, "▁" * n, "a" + " " * n + "the")]
    texts += ["abcdefghij" * 5000, "日本" * 5000, "<0x0A></s><unk>", " \t" * 3000]
    for text in texts:
        ids = ours.encode(text).tolist()
        assert ids == library.encode(text), repr(text[:80])
        assert decode(ours, ids) == library.decode(ids)


def test_backtracking_gives_what_merging_gives():
    ours, rng = piece_bpe.Vocabulary(PATH), random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choices("etaoinshr▁", k=rng.randint(1, 25)))
        assert [ours.names[i] for i in ours.pieces(text)] == ours.merged(text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CHUNKS", 5)
    monkeypatch.setattr(piece_bpe, "PAIRS", 5)
    ours = piece_bpe.Vocabulary(PATH)
    text = "the reader of this sentence reads the sentence of this reader, again and again"
    assert [ours.encode(text).tolist() for _ in range(3)] == [library.encode(text)] * 3


def test_broken_ids_decode_like_the_library(library):
    ours = piece_bpe.Vocabulary(PATH)
    for ids in ([], [library.piece_to_id("<0xC3>")], [264, 264], [28705, 28705, 264]):
        assert decode(ours, ids) == library.decode(ids)


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = QUERIES["op13_piece_bpe"](spark, SMALL).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, library):
    rows = [(1, None, 1), (1, "", 2), (None, "twice  twice", 3), (None, "twice  twice", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = piece_bpe.encoded(docs, PATH).withColumn("back", piece_bpe.decoded(F.col("ids"), PATH))
    found = [(r.doc_id, list(r.ids), r.back) for r in out.collect()]
    twice = (None, library.encode("twice  twice"), "twice  twice")
    assert found == [(1, [], ""), (1, [], ""), twice, twice]
    assert piece_bpe.encoded(docs.limit(0), PATH).count() == 0
