"""Registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import (
    byte_bpe,
    embedding_dedup,
    language,
    lexical,
    merkle,
    minhash,
    mixing,
    piece_bpe,
    quality,
    secrets,
    token_files,
    url_filter,
    va_search,
)
from packetloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


URL_RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, else by the regression on n-grams."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judged(pages, URL_RULES, model).select(
        "page_id", "host", "path", "rule", "verdict", "probability"
    )


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.with_copies(docs, mixing.mixing_plan(docs)).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "source",
        "rate",
    )


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets in every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scanned(docs, secrets.train(docs)).select("doc_id", "secret_spans")
    listed = F.transform(
        "secret_spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    )
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")
    base_listed = F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))

    def count(kind: str):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(F.concat_ws(",", base_listed), 256).alias("base_sha256"),
        F.concat_ws(",", listed).alias("spans"),
    )


@query
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 3-word shingles at 85 percent."""
    docs = read(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs, words=3, percent=85)


ORACLES["op10_minhash_dedup"] = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1),
      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (
  SELECT a, b FROM both_ways
  UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM sets s LEFT JOIN low ON s.doc_id = low.a
"""


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with equal labels at cosine 0.98."""
    return embedding_dedup.linked_vectors(read(spark, sf_dir, "embeddings"), cosine=0.98)


ORACLES["op2_embedding_dedup"] = """
WITH RECURSIVE
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS r FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b
  ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (a.r * b.r) >= 0.98
),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS d FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d, 0) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN low ON e.vec_id = low.a LEFT JOIN deg ON e.vec_id = deg.a
"""


@query
def op6_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every vector whose id is divisible by 50."""
    vectors = read(spark, sf_dir, "embeddings")
    return va_search.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


ORACLES["op6_va_search"] = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL
),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token-id files and read back from them."""
    manifest = token_files.write_token_files(
        read(spark, sf_dir, "documents"),
        public_tokenizers.path("word_bpe_49k.json"),
        token_files.new_folder(spark),
        end_id=2,
    )
    return token_files.read_token_files(manifest).drop("ids")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its text, declared language and source."""
    docs = read(spark, sf_dir, "documents")
    return language.identified(docs, language.train(docs)).select(
        "doc_id", "language", "confidence", "kept"
    )


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a quarter of the labels is held out of the fit."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.train(docs, labels.where(~held_out))
    return quality.scored(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the bytes that they decode to."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = byte_bpe.Ranks(
        byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    )
    known = byte_bpe.known_words(docs, ranks, public_tokenizers.PATTERN)
    ids = byte_bpe.encoded(docs, known, ranks, public_tokenizers.PATTERN)
    rows = ids.select(
        "doc_id",
        byte_bpe.packed(F.col("ids"), ranks).alias("packed"),
        byte_bpe.decoded(F.col("ids"), ranks).alias("decoded"),
    )
    return rows.select(
        "doc_id",
        (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of every document; half of the texts are checked without newlines."""
    docs = read(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = merkle.leaf_of(*[F.col(c) for c in fields])
    cut = merkle.leaf_of(*[F.col(c) for c in fields[:-1]], F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(tampered, cut).alias("tampered"))
    found = merkle.proofs(rows, leaf="leaf", keep=["tampered"])
    folded = merkle.root_from(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLES["op11_merkle_manifest"] = """
WITH RECURSIVE
field AS (
  SELECT doc_id, source, text,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
      lambda x: coalesce(strlen(x) || ':' || x, '-')) AS f
  FROM documents
),
leaf AS (
  SELECT doc_id, source,
    sha256(array_to_string(f, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(array_to_string(f, '') || coalesce(strlen(replace(text, chr(10), '')) || ':'
      || replace(text, chr(10), ''), '-')) AS cut,
    -- crc32 of the decimal id, bit by bit; a byte is followed by seven shifts without one
    xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295::BIGINT) AS crc
  FROM field
),
names AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s
  FROM (SELECT DISTINCT source FROM documents)
),
placed AS (
  SELECT l.*, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r
  FROM leaf l JOIN names n ON l.source IS NOT DISTINCT FROM n.source
),
low(level, s, r, h, n) AS (
  SELECT 0, s, r, leaf, count(*) OVER (PARTITION BY s) FROM placed
  UNION ALL
  SELECT level + 1, s, r // 3, sha256(string_agg(h, '' ORDER BY r)), (any_value(n) + 2) // 3
  FROM low WHERE n > 1 GROUP BY level, s, r // 3
),
subroots AS (SELECT s, h AS subroot, level AS top FROM low WHERE n = 1),
high(level, s, r, h, n) AS (
  SELECT 100, 0, s, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, 0, r // 3, sha256(string_agg(h, '' ORDER BY r)), (any_value(n) + 2) // 3
  FROM high WHERE n > 1 GROUP BY level, r // 3
),
steps AS (
  SELECT p.doc_id, p.leaf, v.level, string_agg(b.h, '' ORDER BY b.r) FILTER (b.r < v.r) AS lefts,
    string_agg(b.h, '' ORDER BY b.r) FILTER (b.r > v.r) AS rights
  FROM placed p
  JOIN (SELECT DISTINCT level, s, r, n FROM low WHERE n > 1) v
    ON v.s = p.s AND v.r = p.r // (3 ** v.level)::BIGINT
  JOIN low b ON b.s = v.s AND b.level = v.level AND b.r // 3 = v.r // 3
  GROUP BY ALL
  UNION ALL
  SELECT p.doc_id, p.leaf, v.level, string_agg(b.h, '' ORDER BY b.r) FILTER (b.r < v.r),
    string_agg(b.h, '' ORDER BY b.r) FILTER (b.r > v.r)
  FROM placed p
  JOIN high v ON v.n > 1 AND v.r = p.s // (3 ** (v.level - 100))::BIGINT
  JOIN high b ON b.level = v.level AND b.r // 3 = v.r // 3
  GROUP BY ALL
),
paths AS (
  SELECT doc_id, leaf,
    list(coalesce(lefts, '') || '|' || coalesce(rights, '') ORDER BY level) AS path
  FROM steps GROUP BY doc_id, leaf
),
folded AS (
  SELECT p.doc_id, p.leaf, s, path,
    list_reduce([CASE WHEN crc % 2 = 0 THEN cut ELSE p.leaf END] || coalesce(path, []),
      lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
  FROM placed p LEFT JOIN paths t ON p.doc_id = t.doc_id AND p.leaf = t.leaf
)
SELECT doc_id, leaf, subroot, h AS root,
  sha256(coalesce(array_to_string(list_transform(path, lambda x: replace(x, '|', '')), ''), '')) AS proof_sha256,
  folded_root, folded_root = h AS verified
FROM folded JOIN subroots USING (s) CROSS JOIN (SELECT h FROM high WHERE n = 1)
"""


@query
def op13_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and the text that they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ids = piece_bpe.encoded(docs, path)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(piece_bpe.decoded(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.best_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


ORACLES["op12_lexical_search"] = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
total AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM terms),
post AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM terms)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM post CROSS JOIN total GROUP BY term, n_docs
),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS s
  FROM post JOIN weights USING (term) CROSS JOIN total
),
scores AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
