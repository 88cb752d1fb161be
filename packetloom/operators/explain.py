"""Why a payload got its score: importance, keywords, signatures, sentences.

The features of a payload sit in one row, so ranking and shares are array
operations inside that row.  Nothing here shuffles except the joins to
description tables, and those are broadcast when small.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import matching
from packetloom.functions.rulesets import Family, keyword_patterns
from packetloom.functions.text import one_line, text_or_empty
from packetloom.operators import rulebook
from packetloom.operators.scoring import ATTACK, NORMAL, linear_score, sigmoid

# Report sentences.
SAYS_ATTACK = "%s 가 공격 탐지 하였고 AI 탐지 키워드는 %s 입니다."
SAYS_NORMAL = "%s 가 정상 인식 하였습니다."
SAYS_AMPERSANDS = "& 특수문자가 총 %d건 입니다."
SAYS_SEMICOLONS = "; 특수문자가 총 %d건 입니다."
SAYS_DIRECTORIES = "상위 디렉토리 접근이 총 %d건 입니다."


def feature_means(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Baseline of a linear explanation: one row of means, fetched once."""
    row = df.agg(*(F.avg(f).alias(f) for f in features)).first()
    return {f: float(row[f] or 0.0) for f in features}


def attributions(coefs: dict[str, float], means: dict[str, float]) -> Column:
    """Array of ``feature_no, feature, value, phi``; exact for linear logits."""
    entries = ", ".join(
        f"named_struct('feature_no', {no}, 'feature', '{f}', 'value', CAST({f} AS DOUBLE), "
        f"'phi', {w!r}D * ({f} - {means[f]!r}D))"
        for no, (f, w) in enumerate(coefs.items())
    )
    return F.expr(f"array({entries})")


def with_importance(
    df: DataFrame, phis: Column, *, out_col: str = "explained", places: int = 4
) -> DataFrame:
    """Array ordered by importance with ``importance`` and ``direction``.

    Importance is ``sigmoid(|phi|)`` over its sum in the row; ties keep the
    feature order.
    """
    df = df.withColumn("__phi", phis)
    df = df.withColumn(
        "__all", F.aggregate("__phi", F.lit(0.0), lambda acc, x: acc + sigmoid(F.abs(x["phi"])))
    )

    def scored(x: Column) -> Column:
        return F.struct(
            (-F.round(sigmoid(F.abs(x["phi"])) / F.col("__all"), places)).alias("order_key"),
            x["feature_no"].alias("feature_no"),
            x["feature"].alias("feature"),
            x["value"].alias("value"),
            x["phi"].alias("phi"),
            F.round(sigmoid(F.abs(x["phi"])) / F.col("__all"), places).alias("importance"),
            F.when(x["phi"] >= 0, ATTACK).otherwise(NORMAL).alias("direction"),
        )

    return df.withColumn(out_col, F.array_sort(F.transform("__phi", scored))).drop("__phi", "__all")


def explain_linear(
    df: DataFrame,
    coefs: dict[str, float],
    means: dict[str, float],
    *,
    out_col: str = "explained",
    places: int = 4,
) -> DataFrame:
    """``with_importance`` of a linear model, column by column.

    The shares are plain arithmetic on feature columns, which Spark compiles;
    only the finished entries become an array.
    """
    numbered = list(enumerate(coefs.items()))
    phis = [f"{w!r}D * ({f} - {means[f]!r}D) AS __phi{i}" for i, (f, w) in numbered]
    sizes = [f"1 / (1 + exp(-abs(__phi{i}))) AS __s{i}" for i, _ in numbered]
    whole = " + ".join(f"__s{i}" for i, _ in numbered)
    shares = [f"round(__s{i} / __all, {places}) AS __share{i}" for i, _ in numbered]
    entries = ", ".join(
        f"named_struct('order_key', -__share{i}, 'feature_no', {i}, 'feature', '{f}', "
        f"'value', CAST({f} AS DOUBLE), 'phi', __phi{i}, 'importance', __share{i}, "
        f"'direction', CASE WHEN __phi{i} >= 0 THEN '{ATTACK}' ELSE '{NORMAL}' END)"
        for i, (f, _) in numbered
    )
    kept = df.columns
    steps = df.selectExpr("*", *phis).selectExpr("*", *sizes)
    steps = steps.selectExpr("*", f"{whole} AS __all").selectExpr("*", *shares)
    return steps.selectExpr(*kept, f"sort_array(array({entries})) AS {out_col}")


def with_class_scores(
    df: DataFrame,
    coefs: dict[int, dict[str, float]],
    intercepts: dict[int, float],
    *,
    out_col: str = "proba",
) -> DataFrame:
    """Add the class probabilities of a linear model, by class number, and ``prediction``.

    Equal scores go to the smaller number.
    """
    classes = sorted(coefs)
    logits = [linear_score(coefs[c], intercepts[c]).alias(f"__logit{c}") for c in classes]
    out = df.select("*", *logits)
    out = out.withColumn("__most", F.greatest(*(F.col(f"__logit{c}") for c in classes)))
    parts = [F.exp(F.col(f"__logit{c}") - F.col("__most")) for c in classes]
    out = out.withColumn("__parts", F.array(*parts))
    whole = F.aggregate("__parts", F.lit(0.0), lambda acc, x: acc + x)
    first = F.coalesce(*(F.when(F.col(f"__logit{c}") == F.col("__most"), F.lit(c)) for c in classes))
    return (
        out.withColumn("__whole", whole)
        .withColumn(out_col, F.transform("__parts", lambda x: x / F.col("__whole")))
        .withColumn("prediction", first)
        .drop("__most", "__parts", "__whole", *(f"__logit{c}" for c in classes))
    )


def explain_classes(
    df: DataFrame,
    coefs: dict[int, dict[str, float]],
    means: dict[str, float],
    *,
    names: tuple[str, ...],
    others: tuple[str, ...],
    out_col: str = "explained",
    places: int = 4,
) -> DataFrame:
    """``with_importance`` for the predicted class of a model with several classes.

    A feature's share is that of its attribution to the score of the class in
    ``prediction``.  One that speaks for the class points to its name, one
    against it to the label of all others.  ``means`` are stored with the model,
    so a row's explanation does not depend on the rows around it.
    """
    at = F.col("prediction") + 1
    entries = []
    for no, f in enumerate(means):
        weight = F.element_at(F.array(*(F.lit(float(coefs[c][f])) for c in sorted(coefs))), at)
        entries.append(
            F.struct(
                F.lit(no).alias("feature_no"),
                F.lit(f).alias("feature"),
                F.col(f).cast("double").alias("value"),
                (weight * (F.col(f) - F.lit(means[f]))).alias("phi"),
            )
        )
    out = with_importance(df, F.array(*entries), out_col=out_col, places=places)
    own = F.element_at(F.array(*map(F.lit, names)), at)
    rest = F.element_at(F.array(*map(F.lit, others)), at)
    return out.withColumn(
        out_col,
        F.transform(out_col, lambda x: x.withField("direction", F.when(x["phi"] >= 0, own).otherwise(rest))),
    )


def top_features(df: DataFrame, ids: list[str], *, k: int = 10, col: str = "explained") -> DataFrame:
    """One row per payload and rank, importance in percent.

    With the ``evidence`` column the keywords of the feature come along, ``-``
    when there are none.
    """
    found = ["evidence"] if "evidence" in df.columns else []
    top = F.posexplode(F.slice(F.col(col), 1, k)).alias("__at", "__x")
    rows = df.select(*ids, *found, top)
    keywords = []
    if found:
        mine = F.filter("evidence", lambda e: e["feature_no"] == F.col("__x.feature_no"))
        joined = F.array_join(F.transform(mine, lambda e: e["keyword"]), ", ")
        keywords = [F.regexp_replace(joined, "^$", "-").alias("keywords")]
    return rows.select(
        *ids,
        (F.col("__at") + 1).alias("rank"),
        F.col("__x.feature").alias("feature"),
        F.col("__x.value").alias("value"),
        F.round(F.col("__x.importance") * 100, 2).alias("importance_percent"),
        F.col("__x.direction").alias("direction"),
        *keywords,
    )


def top_as_text(df: DataFrame, out_col: str, *, k: int = 10, col: str = "explained") -> DataFrame:
    """Add the top features of a payload as text, a line each, for a prompt."""

    def keywords(no: Column) -> Column:
        mine = F.filter("evidence", lambda e: e["feature_no"] == no)
        return F.regexp_replace(
            F.array_join(F.transform(mine, lambda e: e["keyword"]), ", "), "^$", "-"
        )

    lines = F.transform(
        F.slice(F.col(col), 1, k),
        lambda x, i: F.concat_ws(
            " | ",
            (i + 1).cast("string"),
            x["feature"],
            x["value"].cast("int").cast("string"),
            x["direction"],
            keywords(x["feature_no"]),
        ),
    )
    return df.withColumn(out_col, F.array_join(lines, "\n"))


def token_ranks(tokens: Column, weights: dict[str, float]) -> Column:
    """Array of ``order_key, token_no, token, phi``, largest share first; in the row.

    The share of a token is ``sigmoid(|phi|)`` over the sum in the row, in
    percent; ``order_key`` is its negative.
    """
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    phis = F.transform(
        tokens,
        lambda t, i: F.struct(
            i.alias("token_no"),
            t.alias("token"),
            F.coalesce(F.element_at(known, F.lower(t)), F.lit(0.0)).alias("phi"),
        ),
    )

    def shared(rows: Column) -> Column:
        whole = F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + sigmoid(F.abs(x["phi"])))
        return F.get(F.transform(F.array(whole), lambda total: of(rows, total)), F.lit(0))

    def of(rows: Column, total: Column) -> Column:
        def entry(x: Column) -> Column:
            percent = F.round(sigmoid(F.abs(x["phi"])) / total * 100, 2)
            names = ("token_no", "token", "phi")
            kept = [x[n].alias(n) for n in names]
            return F.struct((-percent).alias("order_key"), *kept)

        return F.array_sort(F.transform(rows, entry))

    return F.get(F.transform(F.array(phis), shared), F.lit(0))


def describe(df: DataFrame, definitions: DataFrame) -> DataFrame:
    """Add the description of each feature, NULL when there is none."""
    return df.join(definitions, "feature", "left")


def shares(df: DataFrame, *, k: int = 10, col: str = "explained") -> DataFrame:
    """Add the shares of the top features: all of them and the attack ones."""
    top = F.slice(F.col(col), 1, k)

    def percent(only_attack: bool) -> Column:
        def add(acc: Column, x: Column) -> Column:
            p = F.round(x["importance"] * 100, 2)
            return acc + (F.when(x["direction"] == ATTACK, p).otherwise(0.0) if only_attack else p)

        return F.round(F.aggregate(top, F.lit(0.0), add), 2)

    return df.withColumns({"top_percent": percent(False), "attack_percent": percent(True)})


def global_importance(df: DataFrame, coefs: dict[str, float], means: dict[str, float]) -> DataFrame:
    """Mean absolute attribution per feature over all payloads."""
    wide = df.agg(
        *(F.avg(F.abs(F.lit(w) * (F.col(f) - F.lit(means[f])))).alias(f) for f, w in coefs.items())
    )
    cells = F.array(
        *(F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_phi")) for f in coefs)
    )
    return wide.select(F.inline(cells))


def risk(df: DataFrame, proba: Column, baseline_logit: float) -> DataFrame:
    """Risk in percent, the model's baseline, and the signed difference."""
    base = F.round(sigmoid(F.lit(baseline_logit)) * 100, 2)
    own = F.round(proba * 100, 2)
    delta = F.round(own - base, 2)
    return df.withColumns(
        {
            "baseline_percent": base,
            "risk_percent": own,
            "delta_text": F.format_string(
                "%s%s", F.when(delta < 0, "").otherwise("+"), F.format_number(delta, 2)
            ),
        }
    )


def sentences(rows: DataFrame) -> DataFrame:
    """A statement for each of the ranks 1 to 3 of ``top_features``."""
    f, v = F.col("feature"), F.col("value").cast("int")
    flag = F.when(v == 1, F.format_string(SAYS_ATTACK, f, F.col("keywords"))).otherwise(
        F.format_string(SAYS_NORMAL, f)
    )
    text = (
        F.when(f.contains("ampersand_count"), F.format_string(SAYS_AMPERSANDS, v))
        .when(f.contains("semicolon_count"), F.format_string(SAYS_SEMICOLONS, v))
        .when(f.contains("dir_count"), F.format_string(SAYS_DIRECTORIES, v))
        .otherwise(flag)
    )
    return rows.where("rank <= 3").withColumn("statement", text)


# --- evidence ---------------------------------------------------------------


def _split_alternatives(fam: Family):
    agents = [r for r in fam.rules if r.feature == "useragent_comb"]
    others = [r for r in fam.rules if r.feature != "useragent_comb"]
    return others, agents


def keyword_union(rules) -> list[str]:
    """All keyword patterns in rule order."""
    return list(dict.fromkeys(p for r in rules for p in keyword_patterns(r)))


def with_found(df: DataFrame, text_col: str, rules, out_col: str) -> DataFrame:
    """Add the texts that the rules' patterns cover, left to right, not overlapping."""
    patterns = keyword_union(rules)

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        find = matching.Finder(patterns)
        return pa.array([find(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return df.withColumn(out_col, found(text_col))


def agent_text(text: Column) -> Column:
    """Text behind the HTTP version, empty unless the version occurs once."""

    def around(version: str) -> Column:
        return F.split(text, version.replace(".", r"\."))

    def once(version: str) -> Column:
        return F.size(around(version)) == 2

    return (
        F.when(once("HTTP/1.1"), F.get(around("HTTP/1.1"), F.lit(1)))
        .when(once("HTTP/1.0"), F.get(around("HTTP/1.0"), F.lit(1)))
        .otherwise("")
    )


def _hits_sql(fragment: str, rules) -> str:
    """Array of ``feature_no, alt_no, keyword`` for one fragment."""
    cases = []
    for feature_no, r in enumerate(rules):
        for alt_no, pattern in enumerate(keyword_patterns(r)):
            hit = matching.pattern_sql(pattern, fragment, one_line_text=False)
            keyword = matching.text_literal(rulebook.pretty_text(pattern))
            cases.append(
                f"CASE WHEN {hit} THEN named_struct('feature_no', {feature_no}, "
                f"'alt_no', {alt_no}, 'keyword', {keyword}) END"
            )
    return f"filter(array({', '.join(cases)}), x -> x IS NOT NULL)"


def _with_fragments(df: DataFrame, text_col: str, fam: Family) -> DataFrame:
    """Add ``__fragments``; those of the user-agent rules come last.

    User-agent fragments are only looked for behind a single HTTP version.
    """
    others, agents = _split_alternatives(fam)
    line = one_line(text_or_empty(F.col(text_col)))
    out = df.withColumn("__line", line).withColumn("__low", F.lower("__line"))
    out = with_found(out, "__low", others, "__fragments")
    if agents:
        out = out.withColumn("__low", F.lower(agent_text(F.col("__line"))))
        out = with_found(out, "__low", agents, "__agents")
        out = out.withColumn("__fragments", F.concat("__fragments", "__agents")).drop("__agents")
    return out.drop("__line", "__low")


#: Fragments whose keywords a task remembers, and the longest of them.
REMEMBERED, REMEMBERED_LENGTH = 1 << 14, 256


def with_evidence(df: DataFrame, text_col: str, fam: Family) -> DataFrame:
    """Add ``evidence``: array of ``feature_no, alt_no, keyword`` in text order.

    The fragments of a text and their keywords come from one pass over Arrow
    batches, so the fragments stay in it.
    """
    others, agents = _split_alternatives(fam)
    numbered = [(no, alt, p) for no, r in enumerate(fam.rules) for alt, p in enumerate(keyword_patterns(r))]
    entries = pa.StructArray.from_arrays(
        [
            pa.array([no for no, _, _ in numbered], pa.int32()),
            pa.array([alt for _, alt, _ in numbered], pa.int32()),
            pa.array([rulebook.pretty_text(p) for _, _, p in numbered], pa.string()),
        ],
        ["feature_no", "alt_no", "keyword"],
    )

    @F.arrow_udf("array<struct<feature_no: int, alt_no: int, keyword: string>>")
    def found(lines: pa.Array, behind: pa.Array) -> pa.Array:
        find_others = matching.Finder(keyword_union(others))
        find_agents = matching.Finder(keyword_union(agents))
        matches = matching.Matches([p for _, _, p in numbered])
        known = functools.lru_cache(REMEMBERED)(matches)
        ends, places = [0], []
        for line, agent in zip(lines.to_pylist(), behind.to_pylist(), strict=True):
            for fragment in [*find_others(line), *find_agents(agent)]:
                places += known(fragment) if len(fragment) <= REMEMBERED_LENGTH else matches(fragment)
            ends.append(len(places))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries.take(pa.array(places, pa.int64())))

    line = one_line(text_or_empty(F.col(text_col)))
    agent = F.lower(agent_text(F.col("__line"))) if agents else F.lit("")
    out = df.withColumn("__line", line).withColumns({"__low": F.lower("__line"), "__agent": agent})
    return out.withColumn("evidence", found("__low", "__agent")).drop("__line", "__low", "__agent")


def evidence(df: DataFrame, text_col: str, ids: list[str], fam: Family) -> DataFrame:
    """``ids, fragment_no, fragment, feature, alt_no, keyword``.

    The rules are part of the expression: no join, no shuffle, and a fragment
    that occurs everywhere costs nothing extra.
    """
    found = _with_fragments(df, text_col, fam)
    # outer, because the plain form would infer a filter on the array and
    # search every text again for it
    rows = found.select(*ids, F.posexplode_outer("__fragments").alias("__at", "fragment")).where(
        "fragment IS NOT NULL"
    )
    feature_names = F.array(*(F.lit(f) for f in fam.features))
    return rows.select(
        *ids,
        (F.col("__at") + 1).alias("fragment_no"),
        "fragment",
        F.explode(F.expr(_hits_sql("fragment", fam.rules))).alias("__h"),
    ).select(
        *ids,
        "fragment_no",
        "fragment",
        F.get(feature_names, F.col("__h.feature_no")).alias("feature"),
        F.col("__h.alt_no").alias("alt_no"),
        F.col("__h.keyword").alias("keyword"),
    )


def keyword_lists(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """``ids, feature, keywords`` of the ``evidence`` column, joined in text order."""
    numbers = F.array_distinct(F.transform("evidence", lambda e: e["feature_no"]))

    def of(no: Column) -> Column:
        mine = F.filter("evidence", lambda e: e["feature_no"] == no)
        words = F.array_join(F.transform(mine, lambda e: e["keyword"]), ", ")
        return F.struct(no.alias("feature_no"), words.alias("keywords"))

    rows = df.select(*ids, F.inline(F.transform(numbers, of)))
    names = F.array(*(F.lit(f) for f in features))
    return rows.select(*ids, F.get(names, F.col("feature_no")).alias("feature"), "keywords")


def quote(text: str) -> str:
    """A pattern that matches just this text."""
    return "".join(f"[\\{ch}]" if ord(ch) < 128 and not ch.isalnum() else ch for ch in text)
