"""Scores, explanations, vectors, splits and model quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from packetloom.functions import httpparse
from packetloom.functions.rulesets import family, keyword_patterns
from packetloom.operators import (
    completion,
    evaluate,
    explain,
    rulebook,
    scoring,
    signatures,
    splits,
    vectorize,
)
from packetloom.operators import features as feat
from packetloom.plans import rule_sql
from packetloom.plans.registry import query, quoted, sql
from packetloom.plans.text_queries import PARSED_LOGS_SQL
from packetloom.sources import samples
from packetloom.sources.fixtures import fixture, read_table
from packetloom.sources.scratch import scratch_path

ID = ["event_id"]
IPS = family("ips")
COEFS = {f: w for _, f, w in samples.coefficients("ips").rows}
INTERCEPT = samples.INTERCEPT
_FEATURES = rule_sql.features("ips", "traffic", "payload", "event_id, label")
_LOGIT = f"{INTERCEPT} + " + " + ".join(f"{f} * ({w})" for f, w in COEFS.items())
_PROBA = f"1 / (1 + exp(-({_LOGIT})))"


def traffic_features(spark, sf_dir, keep=("event_id", "label")):
    return feat.rule_features(fixture(spark, sf_dir, "traffic"), "payload", "ips", keep=list(keep))


@query(
    sql(
        f"SELECT event_id, round(p, 9) AS attack_proba, "
        "'인공지능에서 예측한 결과 ' || CASE WHEN p >= 0.5 THEN '공격' ELSE '정상' END || '일 확률이 ' || "
        "CAST(CAST(round(round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 2) * 100) AS INT) AS VARCHAR) || '%입니다.' AS comment "
        f"FROM (SELECT event_id, {_PROBA} AS p FROM f)",
        f=_FEATURES,
    )
)
def logistic_scores(spark, sf_dir):
    """Attack probability of the fixed linear model, with its comment."""
    rows = scoring.with_probability(traffic_features(spark, sf_dir), COEFS, INTERCEPT, "p")
    return rows.select(
        "event_id",
        F.round("p", 9).alias("attack_proba"),
        scoring.binary_comment(F.col("p")).alias("comment"),
    )


_LONG = (
    f"SELECT event_id, feature, CAST(value AS DOUBLE) AS value FROM "
    f"(UNPIVOT (SELECT * EXCLUDE (label) FROM f) ON {', '.join(IPS.features)} INTO NAME feature VALUE value)"
)


@query(
    sql(
        f"SELECT event_id, round({INTERCEPT} + sum(coalesce(c.coef, 0) * value), 9) AS score "
        f"FROM l LEFT JOIN ({samples.coefficients('ips').sql()}) c ON l.feature = c.feature "
        "GROUP BY event_id",
        f=_FEATURES,
        l=_LONG,
    )
)
def scores_from_long_features(spark, sf_dir):
    """The same model as a coefficient table joined to long features."""
    long = feat.to_long(traffic_features(spark, sf_dir), ID, IPS.features, nonzero=True)
    coefs = samples.coefficients("ips").to_df(spark)
    every = fixture(spark, sf_dir, "traffic").select(*ID)
    return scoring.long_scores(long, every, ID, coefs, INTERCEPT).select(
        "event_id", F.round("score", 9).alias("score")
    )


# --- explanation ------------------------------------------------------------

_PHI = (
    "SELECT l.event_id, c.feature_no, l.feature, l.value, "
    "c.coef * (l.value - avg(l.value) OVER (PARTITION BY l.feature)) AS phi "
    f"FROM l JOIN ({samples.coefficients('ips').sql()}) c ON l.feature = c.feature"
)
_SCORED = (
    "SELECT *, round(s / sum(s) OVER (PARTITION BY event_id), 4) AS importance, "
    "CASE WHEN phi >= 0 THEN '공격' ELSE '정상' END AS direction "
    "FROM (SELECT *, 1 / (1 + exp(-abs(phi))) AS s FROM phis)"
)
_RANKED = (
    "SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY importance DESC, feature_no) AS INT) AS rank "
    "FROM scored"
)


def _evidence_parts(fam, source="traffic", text="payload") -> dict[str, str]:
    others = [r for r in fam.rules if r.feature != "useragent_comb"]
    agents = [r for r in fam.rules if r.feature == "useragent_comb"]
    cases = []
    for r in fam.rules:
        for no, p in enumerate(keyword_patterns(r)):
            cases.append(
                f"CASE WHEN regexp_matches(fragment, {quoted(p)}) THEN {{'feature': '{fam.prefix}{r.feature}', "
                f"'alt_no': {no}, 'keyword': {quoted(rulebook.pretty_text(p))}}} END"
            )
    one, zero = "string_split(line, 'HTTP/1.1')", "string_split(line, 'HTTP/1.0')"
    found = f"regexp_extract_all(lower(line), {quoted('|'.join(explain.keyword_union(others)))})"
    if agents:
        found = (
            f"list_concat({found}, regexp_extract_all("
            f"lower(CASE WHEN len({one}) = 2 THEN {one}[2] WHEN len({zero}) = 2 THEN {zero}[2] ELSE '' END), "
            f"{quoted('|'.join(explain.keyword_union(agents)))}))"
        )
    return dict(
        lines=f"SELECT event_id, translate(coalesce({text}, ''), chr(10) || chr(13) || chr(9), '   ') AS line FROM {source}",
        frags=f"SELECT event_id, {found} AS parts FROM lines",
        frag_rows="SELECT event_id, unnest(parts) AS fragment, CAST(generate_subscripts(parts, 1) AS INT) AS fragment_no FROM frags",
        tested="SELECT fragment, h.feature AS feature, h.alt_no AS alt_no, h.keyword AS keyword FROM ("
        f"SELECT fragment, unnest(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)) AS h "
        "FROM (SELECT DISTINCT fragment FROM frag_rows))",
        evidence="SELECT r.event_id, r.fragment_no, r.fragment, t.feature, CAST(t.alt_no AS INT) AS alt_no, t.keyword "
        "FROM frag_rows r JOIN tested t ON r.fragment = t.fragment",
        keyword_rows="SELECT event_id, feature, string_agg(keyword, ', ' ORDER BY fragment_no, alt_no) AS keywords "
        "FROM evidence GROUP BY event_id, feature",
    )


_EVIDENCE = _evidence_parts(IPS)


@query(
    sql(
        "SELECT event_id, fragment_no, fragment, feature, alt_no, keyword FROM evidence", **_EVIDENCE
    )
)
def keyword_evidence(spark, sf_dir):
    """Which keyword of which feature occurs where."""
    return explain.evidence(fixture(spark, sf_dir, "traffic"), "payload", ID, IPS)


@query(sql("SELECT event_id, feature, keywords FROM keyword_rows", **_EVIDENCE))
def keyword_lists(spark, sf_dir):
    """The keywords of every payload and feature in one text."""
    found = explain.with_evidence(fixture(spark, sf_dir, "traffic"), "payload", IPS)
    return explain.keyword_lists(found, ID, IPS.features)


def _explained(spark, sf_dir, *, evidence=False):
    """Features and evidence are made once, as a table: the means need all rows before the first."""
    rows = traffic_features(spark, sf_dir, ("event_id", "payload"))
    if evidence:
        rows = explain.with_evidence(rows, "payload", IPS)
    rows = rows.drop("payload")
    path = scratch_path(spark, "explained-features")
    rows.write.parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    means = explain.feature_means(table, IPS.features)
    return explain.explain_linear(table, COEFS, means)


_TOP10_PARTS = dict(
    f=_FEATURES,
    l=_LONG,
    phis=_PHI,
    scored=_SCORED,
    ranked=_RANKED,
    **_EVIDENCE,
    top10="SELECT r.event_id, r.rank, r.feature, d.description, r.value, "
    "round(r.importance * 100, 2) AS importance_percent, r.direction, coalesce(k.keywords, '-') AS keywords "
    f"FROM ranked r LEFT JOIN ({samples.FEATURE_DEFS.sql()}) d ON r.feature = d.feature "
    "LEFT JOIN keyword_rows k ON r.event_id = k.event_id AND r.feature = k.feature WHERE r.rank <= 10",
)


@query(
    sql(
        "SELECT event_id, rank, substr(feature, 5) AS feature, description, value, importance_percent, "
        "direction, keywords FROM top10",
        **_TOP10_PARTS,
    )
)
def explanation_top10(spark, sf_dir):
    """The ten most important features with description, value and keywords."""
    top = explain.top_features(_explained(spark, sf_dir, evidence=True), ID)
    described = explain.describe(top, samples.FEATURE_DEFS.to_df(spark))
    return described.withColumn("feature", feat.strip_prefix(F.col("feature"), "ips_"))


_STATEMENT = (
    "CASE "
    "WHEN contains(feature, 'ampersand_count') THEN '& 특수문자가 총 ' || CAST(CAST(value AS INT) AS VARCHAR) || '건 입니다.' "
    "WHEN contains(feature, 'semicolon_count') THEN '; 특수문자가 총 ' || CAST(CAST(value AS INT) AS VARCHAR) || '건 입니다.' "
    "WHEN contains(feature, 'dir_count') THEN '상위 디렉토리 접근이 총 ' || CAST(CAST(value AS INT) AS VARCHAR) || '건 입니다.' "
    "WHEN value = 1 THEN feature || ' 가 공격 탐지 하였고 AI 탐지 키워드는 ' || keywords || ' 입니다.' "
    "ELSE feature || ' 가 정상 인식 하였습니다.' END AS statement"
)


@query(
    sql(
        f"SELECT event_id, rank, {_STATEMENT} FROM top10 WHERE rank <= 3",
        **_TOP10_PARTS,
    )
)
def explanation_sentences(spark, sf_dir):
    """A sentence for each of the three most important features."""
    rows = explain.top_features(_explained(spark, sf_dir, evidence=True), ID, k=3)
    return explain.sentences(rows).select("event_id", "rank", "statement")


@query(
    sql(
        f"SELECT event_id, {quoted(completion.ROLE)} || chr(10) || 'feature importance: ' || string_agg("
        "CAST(rank AS VARCHAR) || ' | ' || feature || ' | ' || CAST(CAST(value AS INT) AS VARCHAR) || ' | ' || direction || ' | ' || keywords, "
        "chr(10) ORDER BY rank) || chr(10) || 'question: ' || "
        f"{quoted(completion.IMPORTANCE_QUESTION)} || chr(10) || 'answer: ' AS prompt FROM top10 GROUP BY event_id",
        **_TOP10_PARTS,
    )
)
def explanation_prompts(spark, sf_dir):
    """The prompt that asks for words about the top features."""
    told = explain.top_as_text(_explained(spark, sf_dir, evidence=True), "top")
    prompt = completion.render(
        completion.TEMPLATES["explain"],
        xai_result=F.col("top"),
        question=completion.IMPORTANCE_QUESTION,
    )
    return told.select("event_id", prompt.alias("prompt"))


@query(
    sql(
        "SELECT event_id, attack_proba, CAST(row_number() OVER (ORDER BY attack_proba DESC, event_id) AS INT) AS place FROM "
        f"(SELECT event_id, round({_PROBA}, 9) AS attack_proba FROM f) ORDER BY attack_proba DESC, event_id LIMIT 20",
        f=_FEATURES,
    )
)
def most_suspicious_payloads(spark, sf_dir):
    """The twenty payloads with the highest risk, ties by id."""
    rows = scoring.with_probability(traffic_features(spark, sf_dir), COEFS, INTERCEPT, "p")
    top = (
        rows.select("event_id", F.round("p", 9).alias("attack_proba"))
        .orderBy(F.desc("attack_proba"), "event_id")
        .limit(20)
    )
    # numbered behind the limit: twenty rows
    order = Window.orderBy(F.desc("attack_proba"), "event_id")
    return top.withColumn("place", F.row_number().over(order))


@query(
    sql(
        "SELECT event_id, round(sum(round(importance * 100, 2)), 2) AS top_percent, "
        "round(coalesce(sum(CASE WHEN direction = '공격' THEN round(importance * 100, 2) END), 0), 2) AS attack_percent "
        "FROM ranked WHERE rank <= 10 GROUP BY event_id",
        f=_FEATURES,
        l=_LONG,
        phis=_PHI,
        scored=_SCORED,
        ranked=_RANKED,
    )
)
def explanation_shares(spark, sf_dir):
    """Share of the top ten, and of those that speak for an attack."""
    return explain.shares(_explained(spark, sf_dir)).select(
        "event_id", "top_percent", "attack_percent"
    )


@query(
    sql(
        "SELECT feature, round(avg(abs(phi)), 9) AS mean_abs_phi FROM phis GROUP BY feature",
        f=_FEATURES,
        l=_LONG,
        phis=_PHI,
    )
)
def global_importance(spark, sf_dir):
    """Mean absolute attribution per feature."""
    rows = traffic_features(spark, sf_dir)
    means = explain.feature_means(rows, IPS.features)
    out = explain.global_importance(rows, COEFS, means)
    return out.select("feature", F.round("mean_abs_phi", 9).alias("mean_abs_phi"))


@query(
    sql(
        "SELECT event_id, base AS baseline_percent, own AS risk_percent, "
        "CASE WHEN round(own - base, 2) < 0 THEN '' ELSE '+' END || printf('%.2f', round(own - base, 2)) AS delta_text "
        f"FROM (SELECT event_id, round({_PROBA} * 100, 2) AS own, round(100 / (1 + exp(-({INTERCEPT}))), 2) AS base FROM f)",
        f=_FEATURES,
    )
)
def risk_against_baseline(spark, sf_dir):
    """Risk of a payload next to the model's average risk."""
    proba = scoring.sigmoid(scoring.linear_score(COEFS, INTERCEPT))
    return explain.risk(traffic_features(spark, sf_dir), proba, INTERCEPT).select(
        "event_id", "baseline_percent", "risk_percent", "delta_text"
    )


# --- logs: explanation of the predicted class -----------------------------------

WEB = family("web")
_LOG_MODEL = samples.log_class_coefficients()
LOG_COEFS = {c: {f: w for k, _, f, w, _ in _LOG_MODEL.rows if k == c} for c in samples.LOG_INTERCEPTS}
LOG_MEANS = {f: m for k, _, f, _, m in _LOG_MODEL.rows if k == 0}
_LOG_PARTS = dict(
    f=rule_sql.features("web", "weblogs", "web_log", "event_id"),
    logits="SELECT *, "
    + ", ".join(
        f"{b} + " + " + ".join(f"{f} * ({w})" for f, w in LOG_COEFS[c].items()) + f" AS l{c}"
        for c, b in samples.LOG_INTERCEPTS.items()
    )
    + " FROM f",
    classed="SELECT *, CASE greatest(l0, l1, l2, l3) WHEN l0 THEN 0 WHEN l1 THEN 1 WHEN l2 THEN 2 ELSE 3 END AS pred, "
    "exp(l0) + exp(l1) + exp(l2) + exp(l3) AS z FROM logits",
    names="SELECT * FROM (VALUES "
    + ", ".join(
        f"({i}, {quoted(own)}, {quoted(rest)})"
        for i, (own, rest) in enumerate(zip(scoring.LOG_CLASSES, scoring.OTHER_CLASSES, strict=True))
    )
    + ") AS t(class_no, own, rest)",
    l=f"SELECT event_id, pred, feature, CAST(value AS DOUBLE) AS value FROM (UNPIVOT "
    f"(SELECT event_id, pred, {', '.join(WEB.features)} FROM classed) ON {', '.join(WEB.features)} "
    "INTO NAME feature VALUE value)",
    phis="SELECT l.*, c.feature_no, c.coef * (l.value - c.mean) AS phi "
    f"FROM l JOIN ({_LOG_MODEL.sql()}) c ON l.feature = c.feature AND l.pred = c.class_no",
    scored="SELECT p.*, round(s / sum(s) OVER (PARTITION BY event_id), 4) AS importance, "
    "CASE WHEN phi >= 0 THEN own ELSE rest END AS direction "
    "FROM (SELECT *, 1 / (1 + exp(-abs(phi))) AS s FROM phis) p JOIN names ON pred = class_no",
    ranked=_RANKED,
    **_evidence_parts(WEB, "weblogs", "web_log"),
    top10="SELECT r.event_id, r.rank, r.feature, d.description, r.value, "
    "round(r.importance * 100, 2) AS importance_percent, r.direction, coalesce(k.keywords, '-') AS keywords "
    f"FROM ranked r LEFT JOIN ({samples.LOG_FEATURE_DEFS.sql()}) d ON r.feature = d.feature "
    "LEFT JOIN keyword_rows k ON r.event_id = k.event_id AND r.feature = k.feature WHERE r.rank <= 10",
)
_PERCENT = "CAST(round(round(exp(l{0}) / z, 2) * 100) AS INT)"


def _classified_logs(spark, sf_dir, keep=("event_id",)):
    rows = feat.rule_features(fixture(spark, sf_dir, "weblogs"), "web_log", "web", keep=list(keep))
    return explain.with_class_scores(rows, LOG_COEFS, samples.LOG_INTERCEPTS)


def _explained_logs(spark, sf_dir):
    rows = explain.explain_classes(
        _classified_logs(spark, sf_dir, ("event_id", "web_log")),
        LOG_COEFS,
        LOG_MEANS,
        names=scoring.LOG_CLASSES,
        others=scoring.OTHER_CLASSES,
    )
    return explain.with_evidence(rows, "web_log", WEB)


@query(
    sql(
        "SELECT event_id, own AS predicted, rest AS others, 100 - cmd_percent - sql_percent - xss_percent AS normal_percent, "
        "cmd_percent, sql_percent, xss_percent, '인공지능에서 예측한 결과 ' || own || CASE WHEN pred = 1 THEN '일' ELSE ' 공격일' END "
        "|| ' 확률이 ' || CAST(greatest(cmd_percent, 100 - cmd_percent - sql_percent - xss_percent, sql_percent, xss_percent) AS VARCHAR) "
        f"|| '%입니다.' AS comment FROM (SELECT *, {_PERCENT.format(0)} AS cmd_percent, {_PERCENT.format(2)} AS sql_percent, "
        f"{_PERCENT.format(3)} AS xss_percent FROM classed) JOIN names ON pred = class_no",
        **{k: _LOG_PARTS[k] for k in ("f", "logits", "classed", "names")},
    )
)
def weblog_class_predictions(spark, sf_dir):
    """Class of a log line by the fixed linear model, the label of the others, and percentages."""
    scored = _classified_logs(spark, sf_dir).select(
        "event_id", "prediction", *scoring.class_percentages(F.col("proba"))
    )
    percents = ("cmd_percent", "normal_percent", "sql_percent", "xss_percent")
    return scored.select(
        "event_id",
        scoring.class_name(F.col("prediction")).alias("predicted"),
        scoring.other_classes(F.col("prediction")).alias("others"),
        scoring.class_comment(F.col("prediction"), F.greatest(*percents)).alias("comment"),
        *percents,
    )


@query(sql("SELECT event_id, fragment_no, fragment, feature, alt_no, keyword FROM evidence", **_evidence_parts(WEB, "weblogs", "web_log")))
def weblog_keyword_evidence(spark, sf_dir):
    """Which keyword of which feature occurs where in a log line."""
    return explain.evidence(fixture(spark, sf_dir, "weblogs"), "web_log", ID, WEB)


@query(
    sql(
        "SELECT event_id, rank, substr(feature, 8) AS feature, description, value, importance_percent, direction, keywords FROM top10",
        **_LOG_PARTS,
    )
)
def weblog_explanation_top10(spark, sf_dir):
    """The ten features that matter most for the predicted class of a log line."""
    top = explain.top_features(_explained_logs(spark, sf_dir), ID)
    described = explain.describe(top, samples.LOG_FEATURE_DEFS.to_df(spark))
    return described.withColumn("feature", feat.strip_prefix(F.col("feature"), "weblog_"))


@query(sql(f"SELECT event_id, rank, {_STATEMENT} FROM top10 WHERE rank <= 3", **_LOG_PARTS))
def weblog_explanation_sentences(spark, sf_dir):
    """A sentence for each of the three features that matter most for the predicted class."""
    rows = explain.top_features(_explained_logs(spark, sf_dir), ID, k=3)
    return explain.sentences(rows).select("event_id", "rank", "statement")


_SIGNATURE_PATTERN = "(?i)" + "|".join(explain.quote(r[1].lower()) for r in samples.SIGNATURES.rows)


@query(
    sql(
        "SELECT event_id, detection_no, matched, s.vendor, s.device, s.detection_name, s.description, s.response "
        "FROM (SELECT event_id, unnest(m) AS matched, CAST(generate_subscripts(m, 1) AS INT) AS detection_no "
        f"FROM (SELECT event_id, regexp_extract_all(payload, {quoted(_SIGNATURE_PATTERN)}) AS m FROM traffic)) h "
        "JOIN (SELECT *, row_number() OVER (PARTITION BY lower(pattern) ORDER BY pattern_no) AS k "
        f"FROM ({samples.SIGNATURES.sql()})) s ON lower(h.matched) = lower(s.pattern) AND s.k = 1"
    )
)
def signature_matches(spark, sf_dir):
    """Known signatures in the payload, in order, with their description."""
    return signatures.signature_matches(
        fixture(spark, sf_dir, "traffic"), "payload", ID, samples.SIGNATURES.to_df(spark)
    )


# --- tokens and vectors -----------------------------------------------------

_SEP = vectorize.PAYLOAD_SEPARATORS
_KEPT = vectorize.KEPT_SEPARATORS
_VOCABULARY = samples.PAYLOAD_VOCABULARY
_WORDS = (
    f"SELECT event_id, unnest(string_split_regex(lower(payload), {quoted(_SEP)})) AS word FROM traffic"
)
_TFIDF = (
    f"SELECT event_id, v.feature, w.word, count(*) AS term_count, count(*) * any_value(v.idf) AS value "
    f"FROM words w JOIN ({_VOCABULARY.sql()}) v ON w.word = v.word GROUP BY event_id, v.feature, w.word"
)


@query(
    sql(
        "SELECT event_id, feature, word, term_count FROM t", words=_WORDS, t=_TFIDF
    )
)
def payload_term_counts(spark, sf_dir):
    """Occurrences of the vocabulary words in every payload."""
    return vectorize.term_counts(
        fixture(spark, sf_dir, "traffic"),
        ID,
        vectorize.tokens(F.col("payload")),
        _VOCABULARY.to_df(spark),
    )


@query(sql("SELECT event_id, feature, value FROM t", words=_WORDS, t=_TFIDF))
def payload_tfidf(spark, sf_dir):
    """TF-IDF features of the payloads that are not zero."""
    rows = vectorize.tfidf(
        fixture(spark, sf_dir, "traffic"),
        ID,
        vectorize.tokens(F.col("payload")),
        _VOCABULARY.to_df(spark),
    )
    return rows.select("event_id", "feature", "value")


@query(
    sql(
        "SELECT event_id, feature, word AS keyword, value, round(term_count, 6) AS term_count, rank FROM ("
        "SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY value DESC, feature) AS INT) AS rank FROM t) "
        "WHERE rank <= 10",
        words=_WORDS,
        t=_TFIDF.replace("count(*) AS term_count", "CAST(count(*) AS DOUBLE) AS term_count"),
    )
)
def tfidf_explained(spark, sf_dir):
    """The ten largest TF-IDF features with their word and its occurrences."""
    vocabulary = _VOCABULARY.to_df(spark)
    values = vectorize.tfidf(
        fixture(spark, sf_dir, "traffic"), ID, vectorize.tokens(F.col("payload")), vocabulary
    )
    # a payload has at most as many rows as the vocabulary has words
    ranked = Window.partitionBy("event_id").orderBy(F.desc("value"), "feature")
    return (
        vectorize.recovered_counts(values, vocabulary)
        .withColumn("rank", F.row_number().over(ranked))
        .where("rank <= 10")
        .select(
            "event_id",
            "feature",
            F.col("word").alias("keyword"),
            "value",
            F.round("term_count", 6).alias("term_count"),
            "rank",
        )
    )


_WORD_SPLIT = "[^a-z0-9]+"


@query(
    sql(
        "SELECT word, doc_freq, round(ln((n + 1) / (doc_freq + 1)), 9) AS idf FROM "
        "(SELECT word, count(*) AS doc_freq FROM (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, "
        f"unnest(regexp_split_to_array(lower(text), '{_WORD_SPLIT}')) AS word FROM documents)) GROUP BY word), "
        "(SELECT count(*) AS n FROM documents)"
    )
)
def document_idf(spark, sf_dir):
    """IDF table fitted on the documents."""
    docs = read_table(spark, sf_dir, "documents")
    out = vectorize.fit_idf(docs, vectorize.tokens(F.col("text"), _WORD_SPLIT))
    return out.withColumn("idf", F.round("idf", 9))


_INTERLEAVED = (
    f"SELECT event_id, list_filter(flatten(list_transform(list_zip(string_split_regex(coalesce(payload, ''), {quoted(_KEPT)}), "
    f"regexp_extract_all(coalesce(payload, ''), {quoted(_KEPT)})), lambda z: [z[1], z[2]])), "
    "lambda x: coalesce(x, '') <> '') AS tok FROM traffic"
)


@query(
    sql(
        "SELECT event_id, tok AS tokens, len(tok) AS n_tokens, tok[1:64] AS kept FROM i", i=_INTERLEAVED
    )
)
def attribution_tokens(spark, sf_dir):
    """Tokens with their separators, and the first 64 of them."""
    rows = fixture(spark, sf_dir, "traffic").fillna("", ["payload"])
    out = rows.withColumn("tokens", vectorize.tokens_with_separators(F.col("payload")))
    return out.select(
        "event_id",
        "tokens",
        F.size("tokens").cast("long").alias("n_tokens"),
        vectorize.cut_to_budget(F.col("tokens"), 64).alias("kept"),
    )


_TOKEN_TOP = (
    "SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY percent DESC, token_no) AS INT) AS rank FROM ("
    "SELECT *, round(s / sum(s) OVER (PARTITION BY event_id) * 100, 2) AS percent FROM ("
    "SELECT x.event_id, x.token_no, x.token, x.start_at, coalesce(w.weight, 0) AS phi, "
    "1 / (1 + exp(-abs(coalesce(w.weight, 0)))) AS s FROM placed x "
    f"LEFT JOIN ({samples.TOKEN_WEIGHTS.sql()}) w ON lower(x.token) = w.token))"
)


@query(
    sql(
        "SELECT event_id, rank, token, percent, CASE WHEN phi >= 0 THEN '공격' ELSE '정상' END AS direction "
        "FROM top WHERE rank <= 10",
        i=_INTERLEAVED,
        placed="SELECT event_id, unnest(tok) AS token, generate_subscripts(tok, 1) AS token_no, 0 AS start_at FROM i",
        top=_TOKEN_TOP,
    )
)
def token_attribution(spark, sf_dir):
    """The ten tokens that move the linear text score most."""
    rows = fixture(spark, sf_dir, "traffic").fillna("", ["payload"])
    tokens = vectorize.tokens_with_separators(F.col("payload"))
    ranked = explain.token_ranks(tokens, dict(samples.TOKEN_WEIGHTS.rows))
    return rows.select("event_id", F.posexplode(F.slice(ranked, 1, 10)).alias("at", "x")).select(
        "event_id",
        (F.col("at") + 1).alias("rank"),
        "x.token",
        (-F.col("x.order_key")).alias("percent"),
        F.when(F.col("x.phi") >= 0, explain.ATTACK).otherwise(explain.NORMAL).alias("direction"),
    )


@query(
    sql(
        "SELECT DISTINCT t.event_id, t.token, CAST(strpos(p.payload, t.token) - 1 AS INT) AS start_at, "
        "CAST(strpos(p.payload, t.token) - 1 + length(t.token) AS INT) AS end_at "
        "FROM (SELECT event_id, unnest(tok) AS token FROM i) t JOIN traffic p ON t.event_id = p.event_id",
        i=_INTERLEAVED,
    )
)
def token_offsets(spark, sf_dir):
    """First position of every token in its payload."""
    rows = fixture(spark, sf_dir, "traffic").fillna("", ["payload"])
    words = F.array_distinct(vectorize.tokens_with_separators(F.col("payload")))
    at = F.position(F.col("token"), F.col("payload")) - 1
    return rows.select("event_id", "payload", F.explode(words).alias("token")).select(
        "event_id", "token", at.alias("start_at"), (at + F.length("token")).alias("end_at")
    )


# --- splits and quality -----------------------------------------------------


@query(
    sql(
        "SELECT event_id, label, CASE WHEN k <= floor(n * 20 / 100) THEN 'test' ELSE 'train' END AS part FROM ("
        "SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(event_id AS VARCHAR) || '7171'), event_id) AS k, "
        "count(*) OVER (PARTITION BY label) AS n FROM traffic)"
    )
)
def stratified_split(spark, sf_dir):
    """80/20 split with exact quotas per label."""
    rows = fixture(spark, sf_dir, "traffic").select("event_id", "label")
    return splits.stratified_split(rows, "event_id", "label", "7171", 20)


@query(
    sql(
        "SELECT doc_id, CASE WHEN k <= floor(n * 5 / 100) THEN 'test' ELSE 'train' END AS part FROM ("
        "SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) AS k, "
        "count(*) OVER () AS n FROM documents)"
    )
)
def random_split(spark, sf_dir):
    """95/5 split over all rows."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id")
    return splits.stratified_split(rows, "doc_id", None, "42", 5)


@query(
    sql(
        "SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 100) AS BIGINT) AS batch_no FROM events"
    )
)
def batches_of_100(spark, sf_dir):
    """Batches of a hundred rows in id order."""
    rows = read_table(spark, sf_dir, "events").select("event_id")
    return splits.with_batch_number(rows, "event_id", 100)


_PREDICTED = (
    f"SELECT label, CASE WHEN {_PROBA} >= 0.5 THEN 'anomalies' ELSE 'normal' END AS predicted FROM f"
)


def _predictions(spark, sf_dir):
    rows = scoring.with_probability(traffic_features(spark, sf_dir), COEFS, INTERCEPT, "p")
    return rows.select(
        "label", F.when(F.col("p") >= 0.5, "anomalies").otherwise("normal").alias("predicted")
    )


@query(
    sql(
        "SELECT label, CAST(sum(CASE WHEN predicted = 'normal' THEN 1 ELSE 0 END) AS BIGINT) AS predicted_normal, "
        "CAST(sum(CASE WHEN predicted = 'anomalies' THEN 1 ELSE 0 END) AS BIGINT) AS predicted_anomalies "
        "FROM p GROUP BY label",
        f=_FEATURES,
        p=_PREDICTED,
    )
)
def confusion_matrix(spark, sf_dir):
    """Labels against predictions."""
    return evaluate.confusion_matrix(
        _predictions(spark, sf_dir), "label", "predicted", ["normal", "anomalies"]
    )


@query(
    sql(
        "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM c "
        "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), "
        "CAST(sum(support) AS BIGINT) FROM c "
        "UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM c",
        f=_FEATURES,
        p=_PREDICTED,
        m="SELECT k AS class, (SELECT count(*) FROM p WHERE label = k) AS support, "
        "(SELECT count(*) FROM p WHERE predicted = k) AS called, "
        "(SELECT count(*) FROM p WHERE label = k AND predicted = k) AS hits "
        "FROM (SELECT DISTINCT label AS k FROM p UNION SELECT DISTINCT predicted FROM p)",
        c="SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 "
        "FROM (SELECT *, CASE WHEN called = 0 THEN 0 ELSE hits / called END AS precision, "
        "CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM m)",
    )
)
def classification_report(spark, sf_dir):
    """Precision, recall, f1 and support of the fixed model."""
    return evaluate.classification_report(_predictions(spark, sf_dir), "label", "predicted")


@query(
    sql(
        "SELECT label, count(*) AS n, round((SELECT count(*) FROM traffic) / count(*), 9) AS weight "
        "FROM traffic GROUP BY label"
    )
)
def class_weights(spark, sf_dir):
    """Inverse frequency of every label."""
    out = evaluate.class_weights(fixture(spark, sf_dir, "traffic"), "label")
    return out.withColumn("weight", F.round("weight", 9))


_AGENT_WORDS = dict(
    logs=PARSED_LOGS_SQL.replace("SELECT event_id, web_log,", "SELECT event_id,", 1),
    words="SELECT event_id, user_agent, unnest(string_split(lower(regexp_replace(user_agent, '[^a-zA-Z]+', ' ', 'g')), ' ')) AS word "
    "FROM logs WHERE parse_status = 'web log'",
)


@query(
    sql(
        "SELECT event_id, feature, word, count(*) * any_value(idf) AS value FROM "
        f"(SELECT w.event_id, w.word, v.feature, v.idf FROM words w JOIN ({samples.AGENT_VOCABULARY.sql()}) v "
        "ON w.word = v.word) GROUP BY event_id, feature, word",
        **_AGENT_WORDS,
    )
)
def agent_tfidf(spark, sf_dir):
    """TF-IDF features of the user agents."""
    logs = httpparse.parse_weblogs(fixture(spark, sf_dir, "weblogs"), "web_log")
    words = vectorize.tokens(
        httpparse.agent_words(F.col("user_agent")), vectorize.AGENT_SEPARATORS
    )
    return vectorize.tfidf(logs, ID, words, samples.AGENT_VOCABULARY.to_df(spark))


@query(
    sql(
        "SELECT event_id, agent_class, score FROM (SELECT *, row_number() OVER "
        "(PARTITION BY event_id ORDER BY score DESC, agent_class) AS k FROM "
        "(SELECT g.event_id, b.agent_class, b.intercept + coalesce(sum(a.weight), 0) AS score "
        f"FROM logs g CROSS JOIN ({samples.AGENT_INTERCEPTS.sql()}) b LEFT JOIN words w ON w.event_id = g.event_id "
        f"LEFT JOIN ({samples.AGENT_WEIGHTS.sql()}) a ON w.word = a.word AND a.agent_class = b.agent_class "
        "WHERE g.parse_status = 'web log' GROUP BY g.event_id, b.agent_class, b.intercept)) WHERE k = 1",
        **_AGENT_WORDS,
    )
)
def agent_classes(spark, sf_dir):
    """Best class of the user agent of every parsed log."""
    logs = httpparse.parse_weblogs(fixture(spark, sf_dir, "weblogs"), "web_log")
    words = vectorize.tokens(
        httpparse.agent_words(F.col("user_agent")), vectorize.AGENT_SEPARATORS
    )
    weights = {}
    for name, word, weight in samples.AGENT_WEIGHTS.rows:
        weights.setdefault(name, {})[word] = weight
    best = scoring.best_class(words, dict(samples.AGENT_INTERCEPTS.rows), weights)
    return (
        logs.where("parse_status = 'web log'")
        .withColumn("best", best)
        .select("event_id", "best.agent_class", "best.score")
    )
