"""Turns of conversations: pairs, histories, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1000  # turns that one task looks at together


def question_answer_pairs(df: DataFrame) -> DataFrame:
    """A user turn with the next turn when the assistant speaks there.

    Turns are looked at in blocks of a conversation.  The last turn of a block
    takes its successor from the first turn of the next block, so a
    conversation of any length spreads over many tasks.
    """
    blocked = df.withColumn("__block", F.floor(F.col("turn") / BLOCK))
    entry = F.struct("turn", "role", "text")
    firsts = blocked.groupBy("conv_id", "__block").agg(F.min_by(entry, "turn").alias("__first"))
    next_first = firsts.select(
        "conv_id",
        "__block",
        F.lead("__first").over(Window.partitionBy("conv_id").orderBy("__block")).alias("__beyond"),
    )
    inside = Window.partitionBy("conv_id", "__block").orderBy("turn")
    led = blocked.withColumn("__next", F.lead(entry).over(inside)).join(
        next_first, ["conv_id", "__block"]
    )
    following = F.coalesce("__next", "__beyond")
    return led.where((F.col("role") == "user") & (following["role"] == "assistant")).select(
        "conv_id",
        "turn",
        F.col("text").alias("question"),
        following["text"].alias("answer"),
    )


def history_prompts(df: DataFrame) -> DataFrame:
    """For every user turn: the turns before it as prior ones, then its own.

    The result repeats the history at every turn, as the application does; its
    size is quadratic in the length of a conversation by definition.  The texts
    of whole blocks are joined first, so a task only orders the turns of one
    block, and a long conversation spreads over as many tasks as it has blocks.
    """
    line = F.concat(
        F.when(F.col("role") == "assistant", "prior answer: ").otherwise("prior question: "),
        F.col("text"),
    )
    said = (
        df.where(F.col("role").isin("user", "assistant"))
        .withColumn("__block", F.floor(F.col("turn") / BLOCK))
        .withColumn("__line", line)
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", "__line")))
    blocks = said.groupBy("conv_id", "__block").agg(
        F.array_join(F.transform(ordered, lambda x: x["__line"]), "\n").alias("__text")
    )
    up_to = [Window.unboundedPreceding, -1]
    earlier = Window.partitionBy("conv_id").orderBy("__block").rowsBetween(*up_to)
    before = blocks.select(
        "conv_id", "__block", F.collect_list("__text").over(earlier).alias("__before")
    )
    inside = Window.partitionBy("conv_id", "__block").orderBy("turn").rowsBetween(*up_to)
    latest = F.array(F.concat(F.lit("latest question: "), F.col("text")))
    return (
        said.withColumn("__inside", F.collect_list("__line").over(inside))
        .where(F.col("role") == "user")
        .join(before, ["conv_id", "__block"])
        .select(
            "conv_id",
            "turn",
            F.array_join(F.concat("__before", "__inside", latest), "\n").alias("prompt"),
        )
    )


def cut_reply(c: Column) -> Column:
    """First line of a reply that goes on with another question."""
    return F.when(F.contains(c, F.lit("question:")), F.substring_index(c, "\n", 1)).otherwise(c)


def drop_last_line(c: Column) -> Column:
    """A reply that starts a new turn loses its last line."""
    lines = F.split(c, "\n")
    kept = F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "")
    return F.when(F.rlike(c, F.lit("(?m)^(질문|답변):")), F.trim(kept)).otherwise(c)


def clean_message(c: Column) -> Column:
    return F.translate(c, '\n\r\t"', "    ")


def silence(c: Column) -> Column:
    return F.coalesce(c, F.lit("_silence_"))


def pairs_from_text(df: DataFrame, text_col: str, ids: list[str]) -> DataFrame:
    """Pairs of a ``question: ... answer: ...`` transcript."""
    joined = F.regexp_replace(F.col(text_col), r"\n(?!(question|answer))", " ")
    pattern = r"question: (.*?)\nanswer: (.*?)\n"
    pair = F.arrays_zip(
        F.regexp_extract_all(joined, F.lit(pattern), F.lit(1)).alias("question"),
        F.regexp_extract_all(joined, F.lit(pattern), F.lit(2)).alias("answer"),
    )
    return df.select(*ids, F.posexplode(pair).alias("__at", "__pair")).select(
        *ids,
        (F.col("__at") + 1).alias("pair_no"),
        F.col("__pair.question").alias("question"),
        F.col("__pair.answer").alias("answer"),
    )


def rating(c: Column) -> Column:
    """Score of a rated answer, NULL when there is none."""
    return F.regexp_extract(c, r"Engagingness: (\d)", 1).try_cast("int")
