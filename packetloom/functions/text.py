"""Small text helpers on Columns; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = 2147483647  # "to the end" for substring


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def one_line(c: Column) -> Column:
    """Line breaks and tabs to blanks, one for one."""
    return F.translate(c, "\n\r\t", "   ")


def count_literal(c: Column, piece: str) -> Column:
    """Non-overlapping occurrences of ``piece``, scanning left to right."""
    if len(piece) == 1:
        shrunk = F.length(F.translate(c, piece, ""))
    else:
        shrunk = F.length(F.replace(c, F.lit(piece)))
    return ((F.length(c) - shrunk) / len(piece)).cast("int")


def before(c: Column, sep: str) -> Column:
    """Text up to the first ``sep``; all of it when there is none."""
    return F.substring_index(c, sep, 1)


def after(c: Column, sep: str) -> Column:
    """Text behind the first ``sep``; NULL when there is none.

    Reads ``c`` once.  A filter on a derived column is pushed below the
    projection by inlining, so chained helpers that read their input twice
    would double the expression with every step.
    """
    literal = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in sep)
    return F.get(F.split(c, literal, 2), F.lit(1))


def any_of(conditions: list[Column]) -> Column:
    """OR as a balanced tree, so that long lists do not nest deeply."""
    return _tree(conditions, lambda a, b: a | b)


def _tree(items: list[Column], join) -> Column:
    if len(items) == 1:
        return items[0]
    half = len(items) // 2
    return join(_tree(items[:half], join), _tree(items[half:], join))


def recode(c: Column, names: dict[str, str], *, otherwise: str | None = "") -> Column:
    """Values by new name; values without one get ``otherwise`` (None keeps them)."""
    out = None
    for old, new in names.items():
        out = F.when(c == old, new) if out is None else out.when(c == old, new)
    return out.otherwise(c if otherwise is None else otherwise)


def dash_if_empty(c: Column) -> Column:
    return F.when(c == "", "-").otherwise(c)


def blank_nullish(c: Column) -> Column:
    """NULL and spelled-out nothings become the empty string."""
    nothings = ["", " ", "-", "null", "nan"]  # fixed values
    return F.when(c.isNull() | F.lower(c).isin(nothings), "").otherwise(c)
