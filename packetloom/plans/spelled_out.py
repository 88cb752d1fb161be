"""The payload features as one SELECT with a regex call per pattern.

This is how the features are written without the pattern helpers: lower-casing
and blank replacement stand in every call.  It serves as yardstick for results
and speed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.matching import HTTP_SPLIT, instr_text
from packetloom.functions.rulesets import Alt, Family, family
from packetloom.sources.fixtures import fixture


def scope(text_col: str, name: str):
    text = F.coalesce(F.col(text_col), F.lit(""))
    lc = F.lower(text)
    n = F.regexp_replace(lc, "\\n|\\r|\\t", " ")
    parts = F.split(n, HTTP_SPLIT, 2)
    return {
        "raw": text,
        "lc": lc,
        "n": n,
        "head": F.get(parts, F.lit(0)),
        "tail": F.coalesce(F.get(parts, F.lit(1)), F.lit("")),
    }[name]


def alternative(a: Alt, text_col: str):
    text = scope(text_col, a.scope)
    if a.literal:
        hit = F.instr(text, instr_text(a)) > 0
    else:
        hit = F.rlike(text, F.lit(a.pattern))
    if a.needs:
        hit = F.rlike(scope(text_col, "n"), F.lit(a.needs)) & hit
    if a.http_guard:
        hit = (F.instr(scope(text_col, "lc"), HTTP_SPLIT) > 0) & hit
    return hit


def features(df: DataFrame, text_col: str, fam: Family, keep: list[str]) -> DataFrame:
    columns = []
    for r in fam.rules:
        if r.kind == "count":
            value = sum(
                (F.size(F.split(scope(text_col, a.scope), a.pattern)) - 1 for a in r.alts[1:]),
                F.size(F.split(scope(text_col, r.alts[0].scope), r.alts[0].pattern)) - 1,
            )
        else:
            hit = alternative(r.alts[0], text_col)
            for a in r.alts[1:]:
                hit = hit | alternative(a, text_col)
            value = F.when(hit, 1).otherwise(0)
        columns.append(value.cast("int").alias(fam.prefix + r.feature))
    return df.select(*keep, *columns)


def payload_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "traffic")
    return features(rows, "payload", family("ips"), ["event_id"])
