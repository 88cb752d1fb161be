"""Rule features of payloads and web-server logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import matching
from packetloom.functions.rulesets import Family, family
from packetloom.functions.text import any_of, blank_nullish, count_literal, text_or_empty


def rule_features(
    df: DataFrame, text_col: str, rules: Family | str, *, keep: list[str] | None = None
) -> DataFrame:
    """Append one INT column per rule of the family.

    No shuffle and no Python: a narrow projection that works on batches and
    streams alike.
    """
    fam = family(rules) if isinstance(rules, str) else rules
    kept = df.columns if keep is None else keep
    prepared = matching.with_scopes(df, text_col, fam.rules)
    return prepared.select(
        *kept, *(matching.rule_column(r).alias(fam.prefix + r.feature) for r in fam.rules)
    )


# Column names and searched texts of the length and character counts.
SYSTEM_WORDS = {
    15: "manager",
    16: "console",
    17: "admin",
    18: "setup",
    19: "config",
    20: "server",
}
CHARACTERS = {
    21: ("single_quotation", "'"),
    22: ("double_quotation", '"'),
    24: ("plus", "+"),
    25: ("star", "*"),
    26: ("slush", "/"),
    27: ("lt", "<"),
    28: ("at", "@"),
    29: ("parent", "("),
    30: ("bracket", "{"),
    31: ("dollar", "$"),
    32: ("double_dot", ".."),
}


def character_features(df: DataFrame, text_col: str, *, keep: list[str] | None = None) -> DataFrame:
    """Length, system words and special-character counts (20 columns)."""
    text = text_or_empty(F.col(text_col))
    length = F.length(blank_nullish(F.col(text_col)))
    columns: dict[int, Column] = {
        13: length.alias("ips_00013_payload_length_value"),
        14: F.when(length < 1, 0.0)
        .otherwise(F.ln(length))
        .alias("ips_00014_payload_logscaled_length_value"),
        23: (count_literal(text, "=") - count_literal(text, "&")).alias(
            "ips_00023_payload_char_equal_cnt"
        ),
    }
    for no, word in SYSTEM_WORDS.items():
        columns[no] = (
            F.contains(F.lower(text), F.lit(word))
            .cast("int")
            .alias(f"ips_{no:05d}_payload_sys_{word}_flag")
        )
    for no, (name, char) in CHARACTERS.items():
        columns[no] = count_literal(text, char).alias(f"ips_{no:05d}_payload_char_{name}_cnt")
    kept = df.columns if keep is None else keep
    return df.select(*kept, *(columns[no] for no in sorted(columns)))


# Group, word and shape of the separator-aware keyword flags,
# numbered from 33.
SEPARATORS = (" ", "%20", "+")
KEYWORDS = [
    *(("sql", w, "between") for w in ("and", "or", "select", "from")),
    ("sql", "cast", "call"),
    ("sql", "union", "before"),
    *(("sql", w, "call") for w in ("eval", "char", "base64")),
    ("sql", "declare", "before"),
    *(("xss", w, "inside") for w in ("alert", "script", "document", "onmouseover", "onload")),
    *(
        ("cmd", w, "before")
        for w in (
            "cmd",
            "run",
            "config",
            "ls",
            "mkdir",
            "netstat",
            "ftp",
            "cat",
            "dir",
            "wget",
            "echo",
            "rm",
        )
    ),
]
_SHAPES = {
    "between": lambda w: [s + w + s for s in SEPARATORS],
    "before": lambda w: [w + s for s in SEPARATORS],
    "call": lambda w: [w + "("],
    "inside": lambda w: [w],
}


def keyword_features(df: DataFrame, text_col: str, *, keep: list[str] | None = None) -> DataFrame:
    """Keywords next to a blank, ``%20`` or ``+`` (27 columns)."""
    kept = df.columns if keep is None else keep
    prepared = df.withColumn("__lc", F.lower(text_or_empty(F.col(text_col))))
    return prepared.select(
        *kept,
        *(
            any_of([F.contains(F.col("__lc"), F.lit(t)) for t in _SHAPES[shape](word)])
            .cast("int")
            .alias(f"ips_{no:05d}_payload_{group}_{word}_flag")
            for no, (group, word, shape) in enumerate(KEYWORDS, start=33)
        ),
    )


def to_long(df: DataFrame, ids: list[str], features: list[str], *, nonzero: bool = False) -> DataFrame:
    """One row per feature: ``ids, feature_no, feature, value``.

    ``nonzero`` drops the zero values before anything is shuffled, the long
    form of "drop the all-zero columns".
    """
    entries = ", ".join(
        f"named_struct('feature_no', {no}, 'feature', '{f}', 'value', CAST({f} AS DOUBLE))"
        for no, f in enumerate(features)
    )
    cells = F.expr(f"array({entries})")
    if nonzero:
        cells = F.filter(cells, lambda x: x["value"] != 0)
    return df.select(*ids, F.inline(cells))


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def row_sum(features: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.col(f) for f in features))


def refine_labels(
    df: DataFrame, label_col: str, whitelist_col: str, features: list[str]
) -> DataFrame:
    """Relabel as normal: several requests in one payload, or no feature fired."""
    silent = (F.col(whitelist_col) <= 1) & (row_sum(features) == 0)
    return df.withColumn(
        label_col,
        F.when((F.col(whitelist_col) >= 2) | silent, "normal").otherwise(F.col(label_col)),
    )


def hits_by_label(df: DataFrame, label_col: str, features: list[str]) -> DataFrame:
    """Rows and summed values per feature and label.

    The wide table is aggregated first (one row per label, combined map-side)
    and only that small result is turned into long form.
    """
    wide = df.groupBy(label_col).agg(
        *(F.sum((F.col(f) > 0).cast("long")).alias(f"h__{f}") for f in features),
        *(F.sum(F.col(f).cast("long")).alias(f"v__{f}") for f in features),
    )
    cells = F.array(
        *(
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"h__{f}").alias("hit_rows"),
                F.col(f"v__{f}").alias("total_value"),
            )
            for f in features
        )
    )
    return wide.select(label_col, F.inline(cells))
