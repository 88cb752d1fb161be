"""Linear scores and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Class labels and the sentence of the report.
ATTACK, NORMAL = "공격", "정상"
SAYS_PREDICTION = "인공지능에서 예측한 결과 %s일 확률이 %s%%입니다."
SAYS_ATTACK_CLASS = "인공지능에서 예측한 결과 %s 공격일 확률이 %s%%입니다."


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def linear_score(coefs: dict[str, float], intercept: float) -> Column:
    """Logit from the feature columns of one row; no join, no shuffle."""
    terms = " + ".join(f"{f} * ({w!r}D)" for f, w in coefs.items())
    return F.expr(f"{intercept!r}D + {terms}")


def with_probability(
    df: DataFrame, coefs: dict[str, float], intercept: float, out_col: str = "attack_proba"
) -> DataFrame:
    return df.withColumn(out_col, sigmoid(linear_score(coefs, intercept)))


def long_scores(
    long: DataFrame, every: DataFrame, ids: list[str], coefs: DataFrame, intercept: float
) -> DataFrame:
    """The same score from long features and a coefficient table.

    ``every`` names all ids, so that a text without any feature scores the
    intercept.
    """
    weight = F.coalesce("coef", F.lit(0.0)) * F.col("value")
    terms = long.join(coefs.select("feature", "coef"), "feature", "left").select(
        *ids, weight.alias("term")
    )
    return (
        terms.unionByName(every.select(*ids, F.lit(0.0).alias("term")))
        .groupBy(*ids)
        .agg((F.lit(intercept) + F.sum("term")).alias("score"))
    )


def _weight_sum(words: Column, weights: Column) -> Column:
    found = F.transform(words, lambda w: F.coalesce(F.element_at(weights, w), F.lit(0.0)))
    return F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x)


def best_class(
    words: Column, intercepts: dict[str, float], weights: dict[str, dict[str, float]]
) -> Column:
    """Struct of the class with the highest linear score of the words, and the score.

    Everything is in the row; a row without known words gets the class with the
    highest intercept, equal scores go to the first name.
    """
    words = F.coalesce(words, F.array().cast("array<string>"))
    structs = []
    for name in sorted(intercepts):
        pairs = [F.lit(x) for pair in weights.get(name, {}).items() for x in pair]
        known = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        score = F.lit(float(intercepts[name])) + _weight_sum(words, known)
        structs.append(F.struct((-score).alias("low"), F.lit(name).alias("agent_class")))
    best = F.array_min(F.array(*structs))
    return F.struct(best["agent_class"].alias("agent_class"), (-best["low"]).alias("score"))


def as_percent(p: Column) -> Column:
    """Probability, rounded to two places, as an integer percentage."""
    return F.round(F.round(p, 2) * 100).cast("int")


def binary_comment(p_attack: Column) -> Column:
    """The sentence about a two-class prediction."""
    attack = p_attack >= 0.5
    return F.format_string(
        SAYS_PREDICTION,
        F.when(attack, ATTACK).otherwise(NORMAL),
        as_percent(F.when(attack, p_attack).otherwise(1 - p_attack)),
    )


# Class numbers of the log model and the labels of the others.
LOG_CLASSES = ("CMD Injection", "정상", "SQL Injection", "XSS")
OTHER_CLASSES = (
    "기타 (SQL, XSS, 정상)",
    "기타 (CMD, SQL, XSS)",
    "기타 (CMD, XSS, 정상)",
    "기타 (CMD, SQL, 정상)",
)


def class_percentages(proba: Column) -> list[Column]:
    """Percent columns of the four log classes; the rest goes to normal."""
    cmd, sql, xss = (as_percent(proba[i]) for i in (0, 2, 3))
    return [
        cmd.alias("cmd_percent"),
        (100 - cmd - sql - xss).alias("normal_percent"),
        sql.alias("sql_percent"),
        xss.alias("xss_percent"),
    ]


def class_name(number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in LOG_CLASSES)), number.cast("int") + 1)


def other_classes(number: Column) -> Column:
    """Label of everything but the class."""
    return F.element_at(F.array(*(F.lit(c) for c in OTHER_CLASSES)), number.cast("int") + 1)


def class_comment(number: Column, percent: Column) -> Column:
    """The sentence about a four-class prediction."""
    name = class_name(number)
    return F.when(name == NORMAL, F.format_string(SAYS_PREDICTION, name, percent)).otherwise(
        F.format_string(SAYS_ATTACK_CLASS, name, percent)
    )
