"""URL filters: rules first, then logistic regression on hashed character n-grams.

Everything is DataFrame expressions.  The regression is trained from a table of
labelled URLs by full gradient steps: each step is one grouped sum over the
training table, and only the gradient, whose length is ``CELLS``, reaches the
driver.  Scoring is a projection, so it neither shuffles nor needs Python.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is judged by the model from the bias alone.  Very long URLs are read
whole, in linear time.  With an empty training table, or labels of one class
only, the model is the smoothed share of blocked URLs.  Repeated rows give
repeated verdicts.  Columns of the input other than the named one are kept;
those called like an output column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import literal_doubles, literal_json, need, written

#: Hashed weights; the driver sees this many numbers in each step.
CELLS = 1 << 13
#: Lengths of the character n-grams.
GRAMS = (3, 4)
#: Most labelled URLs of each class used in training.
TRAIN_ROWS = 4000
STEPS = 20
#: Step length of Adagrad.
RATE = 1.0
#: Weight of the unwanted class in training; ordinary URLs are the usual case.
UNWANTED_SHARE = 0.2
#: A URL is blocked at this probability.
THRESHOLD = 0.5


#: Words of the labelled URL table: what such hosts and paths are called (fixed values).
UNWANTED_WORDS = (
    "adult ads adserver affiliate banner bets betting bingo bitcoin-doubler blackjack bonus-win "
    "cams casino cheap cheap-meds cialis click-here clickbait coupon-spam crack-keys crypto-win "
    "dating-hot download-free escort farm-links fast-loan fetish free-bets free-iphone "
    "free-money gambling hot-girls instant-cash jackpot keygen link-farm loan-now lottery "
    "miracle-diet nude payday pharma pills poker popunder porn prize-win replica roulette "
    "seo-links sex slots spam spam-farm spyware sweepstakes tracker track-pixel viagra warez "
    "weight-loss win-big xxx adult-x"
).split()
ORDINARY_WORDS = (
    "academy archive art astronomy bakery biology blog books bridge building butterfly chemistry "
    "children cinema city climate college concert cooking council culture dance design "
    "dictionary docs earth economy education encyclopedia engineering family festival football "
    "forest forum garden geography government harvest health heritage history home hospital "
    "house institute journal kitchen language law letters library literature magazine "
    "mathematics medicine mountain museum music nature news ocean opera orchestra painting "
    "parliament photo physics planet poetry press radio railway recipes research review river "
    "school science society software sport station statistics stories street student teacher "
    "action association fashion information mission relations shipping theatre thesis tourism town travel university village weather wiki winter writing"
).split()
#: The same frames for both classes, so that only the words tell them apart.
FRAMES = (
    ("www.{}.example.com", "/en/{n}"),
    ("{}.example.org", "/fr/{n}.html"),
    ("m.{}.example.net", "/de/{n}/"),
    ("host.example.com", "/{}/{n}"),
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class UrlModel:
    """Weights of the hashed n-grams and the bias."""

    weights: tuple[float, ...]
    bias: float


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(
        ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit("")
    )


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct<rule, verdict>; null where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Rules of equal length that fit the same URL are taken in order of name.
    """
    kind = "struct<rule: string, verdict: string>"
    out = F.lit(None).cast(kind)
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = (host == rule.host) | host.endswith(f".{rule.host}")
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits & path.startswith(rule.path), value).otherwise(out)
    return out


def hashed_grams(host: Column, path: Column) -> Column:
    """Cells of all n-grams of ``^host$path$`` in linear time; digits are alike."""
    text = F.translate(
        F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$")), "123456789", "0" * 9
    )
    chars = F.split(text, "")

    def cells(chars: Column, n: int) -> Column:
        starts = F.when(
            F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda i: F.pmod(
                F.xxhash64(F.concat(*[F.get(chars, i + k) for k in range(n)])), F.lit(CELLS)
            ).cast("int"),
        )

    def grams_of(chars: Column) -> Column:
        return F.concat(*[cells(chars, n) for n in GRAMS])

    return F.element_at(F.transform(F.array(chars), grams_of), 1)


def _margin(cells: Column, model: UrlModel) -> Column:
    """Mean weight of the n-grams plus bias."""
    weights = literal_doubles(model.weights)
    total = F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.get(weights, c))
    return total / F.sqrt(F.greatest(F.size(cells), F.lit(1)).cast("double")) + F.lit(model.bias)


def _probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def training_table(labelled: DataFrame, url: str = "url", label: str = "blocked") -> DataFrame:
    """At most ``TRAIN_ROWS`` different labelled URLs of each class.

    Those with the smallest hash are taken, so that reruns agree.  Repeated
    host and path pairs count once per label.
    """
    need(labelled, url, label)
    rows = (
        labelled.where(F.col(label).isNotNull())
        .select(
            host_of(F.col(url)).alias("host"),
            path_of(F.col(url)).alias("path"),
            F.col(label).cast("double").alias("y"),
        )
        .where(F.col("host") != "")
        .distinct()
    )
    order = [F.xxhash64("host", "path"), F.col("host"), F.col("path")]
    parts = [rows.where(F.col("y") == y).orderBy(*order).limit(TRAIN_ROWS) for y in (0.0, 1.0)]
    return parts[0].unionAll(parts[1])


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: every word in every frame, 1 for unwanted."""
    rows = [
        ("https://" + host.format(word) + path.format(word, n=1000 + 37 * i), int(unwanted))
        for words, unwanted in ((UNWANTED_WORDS, True), (ORDINARY_WORDS, False))
        for i, word in enumerate(words)
        for host, path in FRAMES
    ]
    kind = "array<struct<url: string, blocked: int>>"
    items = [{"url": u, "blocked": b} for u, b in rows]
    return spark.range(1).select(F.explode(literal_json(items, kind)).alias("x")).select("x.*")


def train(labelled: DataFrame, url: str = "url", label: str = "blocked") -> UrlModel:
    """Fit the regression; the unwanted class weighs ``UNWANTED_SHARE``."""
    examples = written(
        training_table(labelled, url, label).select(
            "y", hashed_grams(F.col("host"), F.col("path")).alias("cells")
        ),
        "url-examples",
    )
    counts = {r["y"]: r["n"] for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0.0, 0), counts.get(1.0, 0)
    zeros = (0.0,) * CELLS
    if not n0 or not n1:
        return UrlModel(zeros, math.log((n1 + 1) / (n0 + 1)))
    model = UrlModel(zeros, 0.0)
    squares, bias_square = [1e-12] * CELLS, 1e-12
    weight = F.when(F.col("y") == 1.0, F.lit(UNWANTED_SHARE / n1)).otherwise(
        F.lit((1 - UNWANTED_SHARE) / n0)
    )
    for _ in range(STEPS):
        residual = (_probability(_margin(F.col("cells"), model)) - F.col("y")) * weight
        root = F.sqrt(F.greatest(F.size("cells"), F.lit(1)).cast("double"))
        shares = F.concat(
            F.transform("cells", lambda c: F.struct(c.alias("cell"), (1 / root).alias("x"))),
            F.array(F.struct(F.lit(-1).alias("cell"), F.lit(1.0).alias("x"))),
        )
        gradient = (
            examples.select(residual.alias("r"), F.explode(shares).alias("s"))
            .groupBy("s.cell")
            .agg(F.sum(F.col("r") * F.col("s.x")).alias("g"))
        )
        weights, bias = list(model.weights), model.bias
        for cell, g in gradient.collect():  # CELLS + 1 rows at most
            if cell < 0:
                bias_square += g * g
                bias -= RATE * g / math.sqrt(bias_square)
            else:
                squares[cell] += g * g
                weights[cell] -= RATE * g / math.sqrt(squares[cell])
        model = UrlModel(tuple(weights), bias)
    return model


def judged(urls: DataFrame, rules: list[Rule], model: UrlModel, url: str = "url") -> DataFrame:
    """Adds host, path, rule, probability and verdict.

    The verdict is the longest fitting rule's; without one, the model's.
    """
    need(urls, url)
    out = (
        urls.withColumn("host", host_of(F.col(url)))
        .withColumn("path", path_of(F.col(url)))
        .withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
        .withColumn("_cells", hashed_grams(F.col("host"), F.col("path")))
        .withColumn("probability", _probability(_margin(F.col("_cells"), model)))
    )
    by_model = F.when(F.col("probability") >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    return (
        out.withColumn("rule", F.col("_fit.rule"))
        .withColumn("verdict", F.coalesce(F.col("_fit.verdict"), by_model))
        .drop("_fit", "_cells")
    )
