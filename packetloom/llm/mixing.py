"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: how often the mix takes it on average.  The rates
are those nearest to one (in relative entropy, none above ``MOST``) whose words
add up to the target of each source.  The dual of that convex problem has one
variable per source, ``lam``, and its solution is an exponential tilt,
``rate = min(MOST, exp(lam * size / mean size of the source))``.  Newton steps
on the logarithm of the sum, kept inside a bracket, find all ``lam`` at once:
each step is one grouped sum over the counts of (source, size) pairs, so a
source with a third of all rows is combined before the shuffle.

Rates become whole copies as ``floor(rate + u + delta)``, ``u`` being a hash of
the document's id and text and ``delta`` one number per source, chosen so that the words
taken come as near the target as the last document allows; one more document
of the source, the one whose size is nearest the rest, then gains or loses a copy.  ``delta`` is
found by narrowing an interval with grouped counts of the points where a
document gains a copy.  So no row is ranked, no source is sorted, and the copies
of a document follow from its own row and the row of its source alone: texts
are never shuffled.  Sums are decimals, so that reruns agree to the last bit.

Cases: a null text has no words; documents without words are taken once, which
adds nothing; a null source is a source like others and comes last; rows without
an id, or with a repeated one, are told apart by their texts, and rows that
repeat both get the same number of copies; an empty table gives an empty mix.
Columns of the input are kept, those called like an added one are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetloom.llm.common import WORD, need, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: No document and no source is taken more often.
MOST = 3
#: Newton stops when every source is this near its target, as a share or in words, or
#: when doubles cannot come nearer.  The bracket is halved where Newton's step leaves it
#: and in every so many steps, so this ends.
CLOSE = 1e-9
CLOSE_WORDS = 1e-3
HALVE = 8
#: Parts of an interval for ``delta``, and how often it is narrowed.
PARTS = 1024
NARROWINGS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _exact(terms: Column) -> Column:
    """A sum that does not depend on the order of its terms."""
    return F.sum(terms.cast("decimal(28,6)")).cast("double")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Per source: source_size, n_docs, target.

    Sources share all words by weight.  Targets stop at ``MOST`` times the
    source's size; the excess is shared again by weight until none is above.
    """
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    # one row per source, so the window without partitions holds no documents
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = written(
        sources.withColumn("weight", F.get(listed, F.pmod(place, F.lit(len(weights))))),
        "mix-sources",
    )
    cap = F.lit(MOST) * F.col("source_size")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    capped, n_capped, level = F.lit(False), 0, 0.0
    while True:
        full, left = weighed.agg(
            F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))
        ).first()
        level = (total - (full or 0)) / left if left else level
        above = capped | (F.col("weight") * level > cap)
        now = weighed.where(above).count()
        if now == n_capped:
            break
        capped, n_capped = above, now
    return weighed.withColumn(
        "target", F.when(capped, cap.cast("double")).otherwise(F.col("weight") * level)
    ).drop("weight")


def _rate(lam: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(lam * size / mean))


def _same_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join with a table of one row per source; Spark broadcasts it where its size allows."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left["source"].eqNullSafe(right["_source"])).drop("_source")


def _solved(hist: DataFrame, targets: DataFrame) -> DataFrame:
    """``lam`` per source; sources whose target is ``MOST`` times their size need none."""
    size, lam = F.col("size"), F.col("lam")
    full = F.col("target") >= F.col("source_size") * MOST * (1 - 1e-12)
    state = targets.select(
        "*",
        (F.col("source_size") / F.col("n_docs")).alias("mean"),
        full.alias("full"),
        F.when(full, 0.0)
        .otherwise(F.log(F.col("target") / F.col("source_size")))
        .alias("lam"),
        F.lit(-1e9).alias("low"),
        F.lit(1e9).alias("high"),
        F.lit(0.0).alias("miss"),
    )
    for step in itertools.count(1):
        rate = _rate(lam, size, F.col("mean"))
        words = F.col("n") * size * rate
        sums = (
            _same_source(hist, state.where(~F.col("full")).select("source", "lam", "mean"))
            .groupBy("source")
            .agg(
                _exact(words).alias("got"),
                _exact(F.when(rate < MOST, words * size / F.col("mean")).otherwise(0.0)).alias(
                    "slope"
                ),
            )
        )
        joined = state.join(
            sums.withColumnRenamed("source", "_source"),
            F.col("source").eqNullSafe(F.col("_source")),
            "left",
        ).drop("_source")
        more = F.col("got") < F.col("target")
        low = F.when(more, lam).otherwise(F.col("low"))
        high = F.when(more, F.col("high")).otherwise(lam)
        newton = lam + F.log(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")
        wide = F.when(more, lam + 1 + F.abs(lam)).otherwise(lam - 1 - F.abs(lam))
        middle = F.when((low > -1e8) & (high < 1e8), (low + high) / 2).otherwise(wide)
        inside = newton.isNotNull() & ~F.isnan(newton) & (newton > low) & (newton < high)
        if step % HALVE == 0:
            inside = F.lit(False)
        next_ = F.when(inside, newton).otherwise(middle)
        miss = F.abs(F.col("got") - F.col("target"))
        near = F.greatest(F.lit(CLOSE_WORDS), F.col("target") * CLOSE)
        open_ = F.col("got").isNotNull() & (miss > near) & (next_ != lam)
        state = written(
            joined.select(
                *targets.columns,
                "mean",
                "full",
                F.when(open_, next_).otherwise(lam).alias("lam"),
                F.when(open_, low).otherwise(F.col("low")).alias("low"),
                F.when(open_, high).otherwise(F.col("high")).alias("high"),
                open_.cast("double").alias("miss"),
            ),
            "mix-step",
        )
        if not state.agg(F.max("miss")).first()[0]:
            break
    return state.drop("low", "high", "miss")


def _key(doc_id: Column, text: Column) -> Column:
    """Tells documents apart, also those that share an id or have none."""
    return F.xxhash64(doc_id, text)


def _chance() -> Column:
    return F.shiftrightunsigned("key", 11) * F.lit(2.0**-53)


def _document_rate() -> Column:
    tilted = _rate(F.col("lam"), F.col("size"), F.col("mean"))
    return F.when(F.col("full"), F.lit(float(MOST))).when(F.col("size") == 0, 1.0).otherwise(tilted)


def _with_delta(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``delta``: the shift at which the copies of a source meet its target."""
    gains = _same_source(
        sized.where(F.col("size") > 0).select("key", "source", "size"), plan
    ).select(
        "source",
        "size",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.lit(MOST)),
                lambda k: k - _document_rate() - _chance(),
            )
        ).alias("at"),
    )
    ends = plan.select("source", "target", F.lit(-1.0).alias("low"), F.lit(1.0).alias("high"))
    for _ in range(NARROWINGS):
        width = F.col("high") - F.col("low")
        part = F.ceil((F.col("at") - F.col("low")) / width * PARTS)
        words = (
            _same_source(gains, ends)
            .where(F.col("at") <= F.col("high"))
            .groupBy("source", F.greatest(F.lit(0), part).cast("int").alias("part"))
            .agg(F.sum("size").alias("words"))
        )
        # at most PARTS + 1 rows per source from here on
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("part"))
        reached = (
            _same_source(words.withColumn("upto", upto), ends.select("source", "target"))
            .groupBy("source")
            .agg(
                F.min(F.when(F.col("upto") >= F.col("target"), F.struct("part", "upto"))).alias(
                    "over"
                ),
                F.max(F.when(F.col("upto") < F.col("target"), F.col("upto"))).alias("under"),
            )
            .withColumnRenamed("source", "_source")
        )
        ends = written(
            ends.join(reached, F.col("source").eqNullSafe(F.col("_source")), "left").select(
                "source",
                "target",
                F.coalesce(
                    F.col("low") + width * (F.greatest(F.col("over.part"), F.lit(1)) - 1) / PARTS,
                    F.col("low"),
                ).alias("low"),
                F.coalesce(
                    F.col("low") + width * F.greatest(F.col("over.part"), F.lit(1)) / PARTS,
                    F.col("high"),
                ).alias("high"),
                F.coalesce(F.col("over.upto"), F.lit(0)).alias("over"),
                F.coalesce("under", F.lit(0)).alias("under"),
            ),
            "mix-ends",
        )
        near = F.when(
            F.col("over") - F.col("target") <= F.col("target") - F.col("under"), F.col("high")
        ).otherwise(F.col("low"))
        last, ends = ends.select("source", near.alias("delta")), ends.drop("over", "under")
    return _with_fix(sized, written(_same_source(plan, last), "mix-plan"))


def _copies() -> Column:
    raw = F.floor(_document_rate() + _chance() + F.col("delta"))
    return F.least(F.greatest(raw, F.lit(0)), F.lit(MOST)).cast("int")


def _with_fix(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``fix``: the document of a source whose copy more or less closes most of the rest."""
    rows = _same_source(sized.where(F.col("size") > 0), plan).select(
        "source", "key", "size", "target", _copies().alias("copies")
    )
    rest = (
        rows.groupBy("source")
        .agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"))
        .withColumnRenamed("source", "_source")
    )
    step = F.signum("rest").cast("int")
    left = F.abs(F.abs("rest") - F.col("size"))
    possible = F.when(step > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0)
    fixes = (
        rows.join(rest, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .where(possible & (left < F.abs("rest")))
        .groupBy("source")
        .agg(F.min(F.struct(left.alias("left"), "key", step.alias("step"))).alias("fix"))
        .withColumnRenamed("source", "_source")
    )
    joined = plan.join(fixes, F.col("source").eqNullSafe(F.col("_source")), "left")
    return written(joined.drop("_source"), "mix-plan")


def mixing_plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per source: source_size, n_docs, target, mean, full, lam, delta, fix."""
    need(docs, doc_id, text, source)
    sized = written(
        docs.select(
            _key(F.col(doc_id), F.col(text)).alias("key"),
            F.col(source).alias("source"),
            size_of(F.col(text)).alias("size"),
        ),
        "mix-sizes",
    )
    hist = written(
        sized.where(F.col("size") > 0).groupBy("source", "size").agg(F.count("*").alias("n")),
        "mix-counts",
    )
    return _with_delta(sized, _solved(hist, source_targets(sized, weights)))


def with_copies(
    docs: DataFrame,
    plan: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Adds size, source_size, target, rate and copies (0 to ``MOST``) to every document."""
    added = ["size", "source_size", "target", "rate", "copies"]
    kept = [c for c in docs.columns if c not in added]
    rows = docs.select(
        F.struct(*kept).alias("_doc"),
        _key(F.col(doc_id), F.col(text)).alias("key"),
        F.col(source).alias("source"),
        size_of(F.col(text)).alias("size"),
    )
    joined = _same_source(rows, plan)
    rate = _document_rate()
    fixed = F.when(F.col("key") == F.col("fix.key"), F.col("fix.step"))
    copies = _copies() + F.coalesce(fixed, F.lit(0))
    return joined.select(
        "_doc.*",
        "size",
        "source_size",
        "target",
        rate.alias("rate"),
        F.when(F.col("size") == 0, 1).otherwise(copies).alias("copies"),
    )


def mixed(docs: DataFrame, plan: DataFrame, **names: str) -> DataFrame:
    """The mix: every document as many times as it has copies, with its own columns."""
    columns = docs.columns
    rows = docs.select(*columns)
    counted = with_copies(rows, plan, **names)
    hidden = [c for c in columns if c not in counted.columns]
    assert not hidden, hidden
    return counted.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(
        *columns
    )
