"""Anonymise text and report what was found.

The masks run in a fixed order because a later pattern sees the output of the
earlier ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mask:
    name: str
    pattern: str
    replacement: str
    token: str  # text that stands in the masked output
    group: int = 0  # the group reported as finding


# Patterns, their order and the texts put in place of a match.
IP_PATTERN = r"(?<!\w\/)(?<!\w\/[0-9])(?<!\w\/[0-9][0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
HOST_PATTERN = (
    r"(?:(?<=:\/\/)|(?<=%3a%2f%2f)|(?<=www\.)|(?<=host: ))"
    r"((?!10\.10\.123\.123).*?)(?=\.go\.kr|\.or\.kr|\.com|\.co\.kr)"
)
EMAIL_PATTERN = r"([a-zA-Z0-9_.-]++)@([a-zA-Z0-9_-]+\.)"
# A digit is asked for before the look-behinds, most positions fail there.
IP_SEARCH = "(?U)(?=[0-9])" + IP_PATTERN
IP = Mask("ip", IP_SEARCH, "10.10.123.123", "10.10.123.123")
# An empty host gets one stand-in.
HOST = Mask("host", "(?id)" + HOST_PATTERN, "*****", "*****", 1)
EMAIL = Mask(
    # a match starts where a run of address characters starts or where the
    # previous match ended; saying so keeps long runs without "@" linear
    "email",
    r"(?:(?<![a-zA-Z0-9_.-])|\G)" + EMAIL_PATTERN,
    "abc@$2",
    "abc@",
    1,
)
CARD = Mask("card", r"(?U)\d{4}-\d{4}-\d{4}-\d{4}", "1234-XXXX-XXXX-XXXX", "1234-XXXX-XXXX-XXXX")
PHONE = Mask("phone", r"(?U)\d{2,3}-\d{3,4}-\d{4}", "010-XXXX-XXXX", "010-XXXX-XXXX")
RESIDENT = Mask("resident", r"(?U)\d{6}-\d{7}", "123456-*******", "123456-*******")
NAME = Mask("name", "[가-힣]{2,4}", "홍길동", "홍길동")

PAYLOAD_MASKS = (IP, HOST, EMAIL, CARD, PHONE, RESIDENT, NAME)
WEBLOG_MASKS = (EMAIL, CARD, PHONE, RESIDENT, NAME)


def apply_mask(c: Column, mask: Mask) -> Column:
    return F.regexp_replace(c, mask.pattern, mask.replacement)


def with_masked(
    df: DataFrame, text_col: str, out_col: str, masks=PAYLOAD_MASKS
) -> DataFrame:
    """Add the anonymised text."""
    out = F.col(text_col)
    for m in masks:
        out = apply_mask(out, m)
    return df.withColumn(out_col, out)


def findings(df: DataFrame, text_col: str, ids: list[str], masks=PAYLOAD_MASKS) -> DataFrame:
    """One row per found item: ``ids, kind_no, kind, item_no, item``.

    An item is looked for in the output of the masks before its own.
    """
    previous, cells = text_col, []
    for no, m in enumerate(masks):
        found = F.regexp_extract_all(F.col(previous), F.lit(m.pattern), F.lit(m.group))
        df = df.withColumn(f"__found_{m.name}", found)
        cells.append(_numbered(F.col(f"__found_{m.name}"), no, m.name))
        step = f"__masked_{m.name}"
        df = df.withColumn(step, apply_mask(F.col(previous), m))
        previous = step
    # a NULL text has no items
    rows = df.where(F.col(text_col).isNotNull())
    return rows.select(*ids, F.inline(F.flatten(F.array(*cells))))


def _numbered(items: Column, kind_no: int, kind: str) -> Column:
    return F.transform(
        items,
        lambda item, at: F.struct(
            F.lit(kind_no).alias("kind_no"),
            F.lit(kind).alias("kind"),
            (at + 1).alias("item_no"),
            item.alias("item"),
        ),
    )


def findings_report(df: DataFrame, text_col: str, ids: list[str], masks=PAYLOAD_MASKS) -> DataFrame:
    """Count and comma list per text and kind."""
    items = findings(df, text_col, ids, masks)
    return items.groupBy(*ids, "kind").agg(
        F.count("*").alias("n_items"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("item_no", "item"))), lambda s: s["item"]
            ),
            ", ",
        ).alias("items"),
    )


def literal_regex(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in text)


def masked_spans(df: DataFrame, masked_col: str, ids: list[str], masks=PAYLOAD_MASKS) -> DataFrame:
    """Where the stand-in texts are: ``ids, span_no, start_at, end_at, token``.

    Positions count from 0, the end is exclusive.
    """
    tokens = "(?i)" + "|".join(literal_regex(m.token) for m in masks)
    df = df.withColumn("__pieces", F.split(F.col(masked_col), tokens)).withColumn(
        "__tokens", F.regexp_extract_all(F.col(masked_col), F.lit(tokens), F.lit(0))
    )

    def length_of(column: str, upto: Column) -> Column:
        return F.aggregate(
            F.slice(F.col(column), F.lit(1), upto), F.lit(0), lambda acc, x: acc + F.length(x)
        )

    spans = F.transform(
        F.col("__tokens"),
        lambda token, at: F.struct(
            (at + 1).alias("span_no"),
            (length_of("__pieces", at + 1) + length_of("__tokens", at)).alias("start_at"),
            (length_of("__pieces", at + 1) + length_of("__tokens", at + 1)).alias("end_at"),
            token.alias("token"),
        ),
    )
    return df.select(*ids, F.inline(spans))
