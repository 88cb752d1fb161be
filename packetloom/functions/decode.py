"""Decode payload text: base64 segments, hex blocks, percent escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.text import one_line

_BASE64_ONLY = "[^A-Za-z0-9+/=]"


def percent_decode(c: Column) -> Column:
    """One round of percent decoding.

    ``+`` stays, a ``%`` without two hex digits stays, bytes that are no UTF-8
    become U+FFFD.
    """
    kept_plus = F.replace(c, F.lit("+"), F.lit("%2B"))
    kept_bad = F.regexp_replace(kept_plus, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(kept_bad)


def double_percent_decode(c: Column) -> Column:
    """Two rounds, for ``%252f`` -> ``%2f`` -> ``/``."""
    return percent_decode(percent_decode(c))


def _base64_characters(kept: Column) -> Column:
    """The characters a lenient decoder takes from base64 text, or NULL.

    A padding that completes a group of four ends the data; padding anywhere
    else is skipped.  Without such an end the characters must fill whole
    groups.
    """
    parts = F.split(kept, "=")
    start = F.struct(
        F.get(parts, F.lit(0)).alias("chars"),
        F.lit(False).alias("ended"),
        F.lit(False).alias("half_padded"),
    )

    def step(acc: Column, part: Column) -> Column:
        # a part behind the first one follows exactly one "="
        fill = F.length(acc["chars"]) % 4
        ends = acc["ended"] | (fill == 3) | ((fill == 2) & acc["half_padded"])
        return F.struct(
            F.when(ends, acc["chars"]).otherwise(F.concat(acc["chars"], part)).alias("chars"),
            ends.alias("ended"),
            (~ends & (fill == 2) & (part == "")).alias("half_padded"),
        )

    def finish(acc: Column) -> Column:
        whole = acc["ended"] | (F.length(acc["chars"]) % 4 == 0)
        return F.when(whole, acc["chars"])

    rest = F.slice(parts, F.lit(2), F.size(parts))
    return F.when(
        F.contains(kept, F.lit("=")), F.aggregate(rest, start, step, finish)
    ).otherwise(kept)


def _decoded(chars: Column) -> Column:
    padded = F.rpad(chars, (F.ceil(F.length(chars) / 4) * 4).cast("int"), F.lit("="))
    return F.try_validate_utf8(F.unbase64(padded).cast("string"))


def decode_base64_segments(c: Column) -> Column:
    """Replace the base64 segments between percent escapes by their text.

    As in the online decoder, every occurrence of a decodable segment is
    replaced, in segment order.  Characters outside the base64 alphabet are
    skipped; a segment beyond ASCII, or whose bytes are no UTF-8 text, stays.
    """
    # step by step over arrays, so that each value is computed once per segment
    segments = F.filter(
        F.split(c, r"(?U)%\w\w"), lambda s: ~F.rlike(s, F.lit(r"[^\x00-\x7F]"))
    )
    kept = F.filter(
        F.transform(
            segments,
            lambda s: F.struct(
                s.alias("segment"), F.regexp_replace(s, _BASE64_ONLY, "").alias("kept")
            ),
        ),
        lambda t: (F.length(t["kept"]) > 0)
        & ((F.length(t["kept"]) % 4 == 0) | F.contains(t["kept"], F.lit("="))),
    )
    texts = F.transform(
        F.transform(
            kept,
            lambda t: F.struct(
                t["segment"].alias("segment"), _base64_characters(t["kept"]).alias("chars")
            ),
        ),
        lambda t: F.struct(t["segment"].alias("segment"), _decoded(t["chars"]).alias("text")),
    )
    decodable = F.filter(texts, lambda t: F.length(t["text"]) > 0)
    return F.aggregate(decodable, c, lambda acc, t: F.replace(acc, t["segment"], t["text"]))


def decode_hex_blocks(c: Column) -> Column:
    """``|hex|`` blocks to ASCII between the bars.

    Blocks of odd length or with a byte above 0x7f stay.
    """
    blocks = F.array_distinct(
        F.regexp_extract_all(c, F.lit(r"\|((?:[0-7][0-9a-fA-F])+)\|"), F.lit(1))
    )
    return F.aggregate(
        blocks,
        c,
        lambda acc, h: F.replace(
            acc, F.concat(F.lit("|"), h, F.lit("|")),
            F.concat(F.lit("|"), F.unhex(h).cast("string"), F.lit("|")),
        ),
    )


def with_decoded(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Base64 segments, hex blocks, then percent escapes twice."""
    steps = df.withColumn("__unbased", decode_base64_segments(F.col(text_col))).withColumn(
        "__unhexed", decode_hex_blocks(F.col("__unbased"))
    )
    return steps.withColumn(out_col, double_percent_decode(F.col("__unhexed"))).drop(
        "__unbased", "__unhexed"
    )


def display_clean(c: Column) -> Column:
    """Line breaks to blanks, angle brackets to their escaped form."""
    out = F.replace(one_line(c), F.lit("<"), F.lit("%26lt%3B"))
    return F.replace(out, F.lit(">"), F.lit("%26gt%3B"))


def display_restore(c: Column) -> Column:
    out = F.replace(c, F.lit("%26lt%3B"), F.lit("<"))
    return F.replace(out, F.lit("%26gt%3B"), F.lit(">"))
