"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from packetloom.llm import (
    byte_bpe,
    embedding_dedup,
    language,
    minhash,
    mixing,
    quality,
    secrets,
    token_files,
    url_filter,
    va_search,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"
PROSE = "the house stands in the garden of the old town and nobody knows who built it "
ROWS = [
    (1, PROSE * 3, "en", "a", 1, 5, "x"),
    (1, PROSE * 3, "en", "a", 1, 5, "x"),
    (2, PROSE * 3, "en", None, 1, 5, None),
    (3, None, None, None, None, None, None),
    (None, PROSE, "en", "b", 1, 5, "x"),
    (4, "", "en", "b", 0, 0, "x"),
    (5, " \t\n", "en", "b", 3, 0, "x"),
    (6, "x" * 50_000, "en", "a", 1, 1, "x"),
    (7, PROSE * 2000, "en", "a", 1, 1, "x"),
    (8, "das haus steht in dem garten der alten stadt und niemand weiss wer es baute " * 3, "de", "b", 1, 1, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def test_language(docs, none):
    found = by_id(language.identified(docs, language.train(docs)))
    assert len(found) == len(ROWS)
    kept = {r.doc_id for r in found if r.kept}
    assert {1, 2, 7, 8} <= kept and not kept & {3, 4, 5}
    assert found[0].size == 5  # other columns stay
    assert language.identified(none, language.train(none)).count() == 0
    assert not any(r.kept for r in language.identified(docs, language.train(none)).collect())


def test_near_duplicates(docs, none):
    found = by_id(minhash.near_duplicates(docs, words=3, percent=85))
    assert [(r.doc_id, r.component_id, r.kept) for r in found] == [
        (None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True),
        (5, 5, True), (6, 6, True), (7, 1, False), (8, 8, True),
    ]
    assert {r.doc_id: r.n_shingles for r in found}[3] == 0
    assert minhash.near_duplicates(none).count() == 0


def test_secrets(docs, none):
    models = secrets.train(docs)
    assert secrets.scanned(docs, models).where(F.size("secret_spans") > 0).count() <= 1
    clean = by_id(secrets.without_secrets(docs, models))
    assert clean[1].text == ROWS[0][1] and clean[4].text is None
    assert secrets.scanned(none, secrets.train(none)).count() == 0


def test_mix(docs, none):
    plan = mixing.mixing_plan(docs)
    rows = by_id(mixing.with_copies(docs, plan))
    assert [r.copies for r in rows if r.doc_id in (3, 4, 5)] == [1, 1, 1]
    assert all(0 <= r.copies <= 3 for r in rows) and rows[1].copies == rows[2].copies
    mix = mixing.mixed(docs, plan)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in rows)
    assert mixing.mixed(none, mixing.mixing_plan(none)).count() == 0


def test_byte_bpe(docs, none):
    ranks = byte_bpe.Ranks(byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    for table in (docs, none):
        known = byte_bpe.known_words(table, ranks, public_tokenizers.PATTERN)
        rows = byte_bpe.encoded(table, known, ranks, public_tokenizers.PATTERN)
        text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
        wrong = rows.where(byte_bpe.decoded(F.col("ids"), ranks) != text)
        assert rows.count() == table.count() and wrong.count() == 0
        assert set(docs.columns) < set(rows.columns)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame(
        [(1, 1), (2, 1), (6, 0), (7, 0), (3, None), (99, 1), (None, 1), (1, 1), (8, 7)],
        "doc_id long, quality int",
    )
    for table, fit in ((docs, docs), (docs, none), (none, docs)):
        rows = quality.scored(table, quality.train(fit, labels)).collect()
        assert len(rows) == table.count() and all(0 <= r.score <= 1 for r in rows)


def test_token_files(docs, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_token_files(docs, path, f"{tmp_path}/a", end_id=2)
    rows = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert [r.n_tokens for r in rows if r.doc_id in (3, 4, 5)] == [1, 1, 1]
    empty = token_files.write_token_files(none, path, f"{tmp_path}/b", end_id=2)
    assert token_files.read_token_files(empty).count() == 0


def test_url_filter(spark):
    schema = "page_id long, url string, host string, verdict int"
    rows = [(1, None, "h", 1), (2, "", "h", 1), (3, "http://a.net/" + "x" * 100_000, "h", 1)] + [
        (4, "http://free-casino.example.com/", None, None)
    ] * 2
    model = url_filter.train(spark.createDataFrame([], "url string, blocked int"))
    rules = [url_filter.Rule("net", "/", "block")]
    found = url_filter.judged(spark.createDataFrame(rows, schema), rules, model).collect()
    assert [(r.page_id, r.host, r.rule) for r in found] == [
        (1, "", None), (2, "", None), (3, "a.net", "net/"),
        (4, "free-casino.example.com", None), (4, "free-casino.example.com", None),
    ]
    assert url_filter.judged(spark.createDataFrame([], schema), rules, model).count() == 0


VECTORS = [
    (0, [1.0, 0.0, 0.0], 1), (1, [2.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 2),
    (4, [1.0, 0.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [float("nan"), 0.0, 0.0], 1),
    (8, [1.0, None, 0.0], 1), (9, [float("inf"), 0.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.0], 1),
    (None, [1.0, 0.0, 0.0], 1), (12, [0.99, 0.01, 0.0], 1), (12, [0.99, 0.01, 0.0], 1),
]


def test_embedding_dedup(spark):
    schema = "vec_id long, embedding array<double>, label int"
    found = embedding_dedup.linked_vectors(spark.createDataFrame(VECTORS, schema)).collect()
    links = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in found}
    assert len(found) == len(VECTORS)
    assert {(0, 4, 0, True), (1, 4, 0, False), (2, 4, 0, False), (12, 4, 0, False)} < links
    alone = {r.vec_id for r in found if r.n_links == 0}
    assert alone == {3, 4, 5, 6, 7, 8, 9, 10, 11, None}
    assert embedding_dedup.linked_vectors(spark.createDataFrame([], schema)).count() == 0


def test_vector_search(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = spark.createDataFrame(VECTORS, schema)
    found = va_search.top_k(rows, F.col("vec_id") % 2 == 0, k=3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in found.collect()}
    assert got[0, 1] == (1, 256 * 512) and got[0, 2] == (2, 65536) and got[0, 3] == (3, 65536)
    assert all(r[0] not in (5, 7, 8, 9, 10) for r in got.values()) and (10, 1) not in got
    assert va_search.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
