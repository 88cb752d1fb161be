"""Question answering and instruction data from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "struct<text:string,answer_start:int,answer_end:int>"
QUESTION = f"struct<question:string,id:string,answers:array<{ANSWER}>>"
PARAGRAPH = f"struct<context:string,payload:string,qas:array<{QUESTION}>>"
ARTICLE = f"struct<paragraphs:array<{PARAGRAPH}>>"


def with_answer_span(df: DataFrame) -> DataFrame:
    """Add ``answer_start`` (-1 when absent) and ``answer_end``, then lower-case.

    The span is taken before the text is lower-cased.
    """
    start = F.position(F.col("answer"), F.col("context")) - 1
    df = df.withColumn("answer_start", start).withColumn(
        "answer_end", F.col("answer_start") + F.length("answer")
    )
    return df.withColumns({c: F.lower(c) for c in ("question", "context", "answer")})


def squad_article(id_col: str) -> Column:
    """The nested article of one question row."""
    answer = F.struct(F.col("answer").alias("text"), "answer_start", "answer_end")
    qa = F.struct(
        "question", F.col(id_col).cast("string").alias("id"), F.array(answer).alias("answers")
    )
    paragraph = F.struct("context", "payload", F.array(qa).alias("qas"))
    return F.struct(F.array(paragraph).alias("paragraphs"))


def flatten_squad(articles: DataFrame, article_col: str) -> DataFrame:
    """One row per question; the first answer counts."""
    paragraphs = articles.select(F.inline(F.col(article_col)["paragraphs"]))
    questions = paragraphs.select("context", "payload", F.inline("qas"))
    first = F.get("answers", F.lit(0))
    return questions.select(
        "context",
        "payload",
        "question",
        "id",
        first["text"].alias("answer"),
        first["answer_start"].alias("answer_start"),
        (first["answer_start"] + F.length(first["text"])).alias("answer_end"),
    )


def _token_at(text: Column, position: Column) -> Column:
    """Number of the blank-separated token around a character position, else 0."""
    upto = F.substr(text, F.lit(1), position + 1)
    here = F.substr(text, position + 1, F.lit(1))
    inside = (position >= 0) & F.rlike(here, F.lit(r"\S"))
    return F.when(inside, F.regexp_count(upto, F.lit(r"(?<!\S)\S")) - 1).otherwise(0)


def with_token_span(df: DataFrame) -> DataFrame:
    """Answer span in tokens of ``context + ' ' + payload``."""
    text = F.concat_ws(" ", "context", "payload")
    return df.withColumns(
        {
            "token_start": _token_at(text, F.col("answer_start")),
            "token_end": _token_at(text, F.col("answer_end") - 1),
        }
    )


def tidy(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), "\n\r\t", "   ")


def instruction_records(df: DataFrame, instruction: str, given: str, output: str) -> DataFrame:
    """``instruction, input, output`` with line breaks taken out of the input."""
    return df.select(
        F.coalesce(instruction, F.lit("")).alias("instruction"),
        tidy(F.col(given)).alias("input"),
        F.coalesce(output, F.lit("")).alias("output"),
    )


def instruction_prompt() -> Column:
    """Training text of an instruction record, with or without input."""
    head = F.when(
        F.col("input") != "", F.concat(F.col("instruction"), F.lit(": "), F.col("input"))
    ).otherwise(F.col("instruction"))
    return F.concat(F.lit("User: "), head, F.lit("\n\nAssistant: "), F.col("output"))


def training_tokens(token_array: Column, budget: int, end: str = "</s>") -> Column:
    """Tokens cut to the budget, with an end marker when there is room."""
    cut = F.slice(token_array, 1, budget)
    room = (F.size(cut) < budget) & (F.element_at(cut, -1) != end)
    return F.when(room, F.array_append(cut, F.lit(end))).otherwise(cut)


def attack_family(c: Column) -> Column:
    return F.substring_index(c, "_", 1)


def with_techniques(df: DataFrame, family_col: str, techniques: DataFrame) -> DataFrame:
    """One row per technique of the family; unknown families keep a NULL."""
    pairs = techniques.select(
        F.col("family").alias(family_col),
        F.explode(F.split("technique_ids", ",\\s*")).alias("technique_id"),
    )
    return df.join(pairs, family_col, "left")
