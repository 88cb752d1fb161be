"""The rules as tables: catalogue, readable keywords, vocabulary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.matching import GAP
from packetloom.functions.rulesets import NOT_WORD, Family, keyword_patterns
from packetloom.sources.dims import Dim


def rule_dim(fam: Family) -> Dim:
    """One row per keyword pattern."""
    return Dim(
        "feature_no INT, feature STRING, kind STRING, alt_no INT, pattern STRING",
        [
            (no, fam.prefix + r.feature, r.kind, alt_no, pattern)
            for no, r in enumerate(fam.rules)
            for alt_no, pattern in enumerate(keyword_patterns(r))
        ],
    )


def pretty(c: Column) -> Column:
    """Readable keyword: ``[~]`` for a gap, plain characters for escapes."""
    out = F.replace(F.replace(c, F.lit(GAP), F.lit("[~]")), F.lit("[%%]"), F.lit("%"))
    out = F.regexp_replace(out, r"\[\\(.)\]", "$1")
    return F.replace(out, F.lit(NOT_WORD), F.lit(""))


def pretty_text(pattern: str) -> str:
    """``pretty`` for a pattern that is known while the plan is built."""
    out = pattern.replace(GAP, "[~]").replace("[%%]", "%")
    return re.sub(r"\[\\(.)\]", r"\1", out).replace(NOT_WORD, "")


def catalogue(spark: SparkSession, fam: Family) -> DataFrame:
    """``feature, kind, n_alternatives, keywords`` in rule order."""
    rules = rule_dim(fam).to_df(spark)
    keyword_list = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("alt_no", pretty(F.col("pattern")).alias("k")))),
            lambda s: s["k"],
        ),
        ", ",
    )
    return rules.groupBy("feature").agg(
        F.max("kind").alias("kind"),
        F.count("*").alias("n_alternatives"),
        keyword_list.alias("keywords"),
    )


def vocabulary(spark: SparkSession, fam: Family) -> DataFrame:
    """Distinct pieces of the patterns, and the whole ones without wildcards."""
    plain = F.replace(
        F.regexp_replace(F.col("pattern"), r"\[\\(.)\]", "$1"), F.lit("[%%]"), F.lit("%")
    )
    rules = rule_dim(fam).to_df(spark).select(plain.alias("plain"))
    pieces = rules.select(F.explode(F.split("plain", r"\(\.\*\?\)")).alias("word"))
    whole = rules.select(F.col("plain").alias("word"))
    return (
        pieces.unionByName(whole)
        .where(
            (F.col("word") != "")
            & ~F.contains(F.col("word"), F.lit(GAP))
            & ~F.rlike("word", F.lit(r"\(.*?\)"))
        )
        .distinct()
    )


def known_words(vocabulary_words: DataFrame, df: DataFrame, text_col: str) -> DataFrame:
    """The vocabulary words that occur in the texts.

    Everything else is dropped where it is read; only vocabulary words are
    shuffled, each at most once per task.
    """
    found = F.array_distinct(F.split(F.lower(F.col(text_col)), "[^a-z0-9]+"))
    words = df.select(F.explode(found).alias("word"))
    return words.join(vocabulary_words, "word", "left_semi").distinct()
