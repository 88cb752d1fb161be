"""Tokens, term counts and TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators of the payload tokens.  The text is lower-cased
# before the split, so "HTTP/1.1" never separates; the models were trained so.
PAYLOAD_SEPARATORS = r" |%20|\+|\/|%2f|HTTP/1.1|\?|\n|\r|\t"
AGENT_SEPARATORS = " "
KEPT_SEPARATORS = r"\s|%20|\+|\/|%2f|HTTP/1.1|\?|\n|\r|\t"


def tokens(c: Column, separators: str = PAYLOAD_SEPARATORS) -> Column:
    return F.split(F.lower(c), separators)


def tokens_with_separators(c: Column, separators: str = KEPT_SEPARATORS) -> Column:
    """Tokens and the separators between them, in text order, without empties."""
    pieces = F.split(c, separators)
    marks = F.regexp_extract_all(c, F.lit(separators), F.lit(0))
    both = F.flatten(F.zip_with(pieces, marks, lambda p, m: F.array(p, m)))
    return F.filter(both, lambda t: F.coalesce(t, F.lit("")) != "")


def counted(token_array: Column) -> Column:
    """Array of ``word, term_count``, each word of the row once; in n log n time."""

    def of(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 1)
        starts = F.filter(
            places,
            lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)),
        )
        return F.get(F.transform(F.array(starts), lambda at: lengths(words, at)), F.lit(0))

    def lengths(words: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, k: F.struct(
                F.get(words, at).alias("word"),
                (F.coalesce(F.get(starts, k + 1), F.size(words)) - at)
                .cast("long")
                .alias("term_count"),
            ),
        )

    found = F.get(F.transform(F.array(F.array_sort(token_array)), of), F.lit(0))
    return F.when(F.size(token_array) > 0, found)


def term_counts(
    df: DataFrame, ids: list[str], token_array: Column, vocabulary: DataFrame
) -> DataFrame:
    """``ids, feature, word, term_count`` for the words of the vocabulary.

    Words are counted within their row, so nothing is shuffled when Spark
    broadcasts the vocabulary.
    """
    words = df.select(*ids, F.inline(counted(token_array)))
    return words.join(vocabulary.select("feature", "word"), "word").select(
        *ids, "feature", "word", "term_count"
    )


def tfidf(df: DataFrame, ids: list[str], token_array: Column, vocabulary: DataFrame) -> DataFrame:
    """Term counts times the stored IDF."""
    words = df.select(*ids, F.inline(counted(token_array)))
    return words.join(vocabulary, "word").select(
        *ids, "feature", "word", (F.col("term_count") * F.col("idf")).alias("value")
    )


def recovered_counts(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences of a word from its TF-IDF value."""
    return values.join(vocabulary.select("feature", "idf"), "feature").withColumn(
        "term_count", F.col("value") / F.col("idf")
    )


def fit_idf(df: DataFrame, token_array: Column) -> DataFrame:
    """``word, doc_freq, idf`` with ``idf = ln((N + 1) / (doc_freq + 1))``."""
    n_docs = df.agg(F.count("*").alias("n")).scalar()
    seen = df.select(F.explode(F.array_distinct(token_array)).alias("word"))
    counted = seen.groupBy("word").agg(F.count("*").alias("doc_freq"))
    return counted.withColumn("idf", F.ln((n_docs + 1) / (F.col("doc_freq") + 1)))


def cut_to_budget(token_array: Column, budget: int) -> Column:
    return F.slice(token_array, 1, budget)
