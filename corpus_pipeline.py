"""From raw documents to token ids: the stages of the training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  The runner
writes it as Parquet and reads it again as the documents of the next stage.
All stages but the last return the columns of their documents.

language     documents whose language is unknown go
near_dedup   of every group of near duplicates one row, with the smallest id, stays
secrets      secrets are cut out of the texts; all documents stay
mix          documents are dropped or repeated so that sources meet their targets
tokens       token ids of every document and the text they decode to
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import byte_bpe, language, minhash, mixing, secrets
from packetloom.llm.common import read, written


#: Documents that Spark hands to a Python worker at a time; texts may be long, and a worker
#: holds what it makes of them as well.
BATCH = 2000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    judged = language.identified(docs.withColumn("_row", F.struct(*docs.columns)), language.train(docs))
    return judged.where("kept").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of five, similarity 0.8; decided per row, as ids may repeat.

    Of each group the row with the smallest id stays, rows without an id come
    last.  Rows without words have no near duplicates, but those that repeat an
    id and its text stay once, too.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(rows, doc_id="_row").select(
        F.col("doc_id").alias("_row"), "n_shingles", "component_id"
    )
    wordless = F.col("n_shingles") == 0
    alone = wordless & F.col("doc_id").isNull()
    group = F.struct(
        F.when(~wordless | alone, F.col("component_id")).alias("component"),
        F.when(wordless, F.col("doc_id")).alias("id"),
        F.when(wordless, F.sha2("text", 256)).alias("text"),
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    stays = written(
        found.join(rows.select("_row", "doc_id", "text"), "_row")
        .groupBy(group.alias("_group"))
        .agg(first.alias("_first"))
        .select("_first._row"),
        "first-rows",
    )
    return rows.join(stays, "_row", "left_semi").select(*docs.columns)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs, secrets.train(docs)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.mixing_plan(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and whether they decode to the text again."""
    _small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.Ranks(byte_bpe.load_ranks(path))
    known = byte_bpe.known_words(docs, ranks, public_tokenizers.PATTERN)
    rows = byte_bpe.encoded(docs, known, ranks, public_tokenizers.PATTERN)
    text = F.coalesce(F.encode("text", "UTF-8"), F.unhex(F.lit("")))
    return rows.select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (byte_bpe.decoded(F.col("ids"), ranks) == text).alias("decodes"),
    )


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secrets", cut_secrets),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]

#: Trained models and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
