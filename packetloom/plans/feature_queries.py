"""Rule features, labels and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.rulesets import FAMILIES, family
from packetloom.operators import features as feat
from packetloom.operators import profile, rulebook
from packetloom.plans import rule_sql
from packetloom.plans.registry import query, quoted, sql
from packetloom.sources.fixtures import fixture, read_table

ID = ["event_id"]


def features_sql(fam: str, source: str = "traffic", text: str = "payload", keep: str = "event_id"):
    return sql(rule_sql.features(fam, source, text, keep))


@query(features_sql("ips"))
def ips_rule_features(spark, sf_dir):
    """The 32 IPS features of every payload."""
    return feat.rule_features(fixture(spark, sf_dir, "traffic"), "payload", "ips", keep=ID)


@query(features_sql("waf"))
def waf_rule_features(spark, sf_dir):
    """The same rules under the WAF model's column names."""
    return feat.rule_features(fixture(spark, sf_dir, "traffic"), "payload", "waf", keep=ID)


@query(features_sql("web", "weblogs", "web_log"))
def weblog_rule_features(spark, sf_dir):
    """The 13 features of web-server log lines."""
    return feat.rule_features(fixture(spark, sf_dir, "weblogs"), "web_log", "web", keep=ID)


@query(features_sql("ips_training", keep="event_id, label"))
def training_rule_features(spark, sf_dir):
    """Flags and request count of the labelled training table."""
    return feat.rule_features(
        fixture(spark, sf_dir, "traffic"), "payload", "ips_training", keep=["event_id", "label"]
    )


@query(features_sql("waf_v1"))
def waf_earlier_rule_features(spark, sf_dir):
    """The earlier WAF rule set."""
    return feat.rule_features(fixture(spark, sf_dir, "traffic"), "payload", "waf_v1", keep=ID)


def _character_sql() -> str:
    blank = (
        "CASE WHEN payload IS NULL OR lower(payload) IN ('', ' ', '-', 'null', 'nan') "
        "THEN '' ELSE payload END"
    )

    def n(ch: str) -> str:
        return f"len(string_split(coalesce(payload, ''), {quoted(ch)})) - 1"

    cols = {
        13: f"CAST(length({blank}) AS INT) AS ips_00013_payload_length_value",
        14: f"round(CASE WHEN length({blank}) < 1 THEN 0.0 ELSE ln(length({blank})) END, 9) "
        "AS ips_00014_payload_logscaled_length_value",
        23: f"CAST(({n('=')}) - ({n('&')}) AS INT) AS ips_00023_payload_char_equal_cnt",
    }
    for no, w in feat.SYSTEM_WORDS.items():
        cols[no] = (
            f"CASE WHEN instr(lower(coalesce(payload, '')), '{w}') > 0 THEN 1 ELSE 0 END "
            f"AS ips_{no:05d}_payload_sys_{w}_flag"
        )
    for no, (name, ch) in feat.CHARACTERS.items():
        cols[no] = f"CAST({n(ch)} AS INT) AS ips_{no:05d}_payload_char_{name}_cnt"
    return "SELECT event_id, " + ", ".join(cols[i] for i in sorted(cols)) + " FROM traffic"


@query(sql(_character_sql()))
def character_features(spark, sf_dir):
    """Length, system words and character counts."""
    name = "ips_00014_payload_logscaled_length_value"
    out = feat.character_features(fixture(spark, sf_dir, "traffic"), "payload", keep=ID)
    return out.withColumn(name, F.round(name, 9))


def _keyword_sql() -> str:
    cols = []
    for no, (group, word, shape) in enumerate(feat.KEYWORDS, start=33):
        hits = " OR ".join(
            f"instr(lower(coalesce(payload, '')), {quoted(t)}) > 0"
            for t in {
                "between": [f"{s}{word}{s}" for s in (" ", "%20", "+")],
                "before": [f"{word}{s}" for s in (" ", "%20", "+")],
                "call": [f"{word}("],
                "inside": [word],
            }[shape]
        )
        cols.append(
            f"CASE WHEN {hits} THEN 1 ELSE 0 END AS ips_{no:05d}_payload_{group}_{word}_flag"
        )
    return f"SELECT event_id, {', '.join(cols)} FROM traffic"


@query(sql(_keyword_sql()))
def keyword_features(spark, sf_dir):
    """Keywords next to a separator."""
    return feat.keyword_features(fixture(spark, sf_dir, "traffic"), "payload", keep=ID)


@query(
    sql(
        "SELECT event_type, CAST(sum(ips_payload_sql_01_comb) AS BIGINT) AS sql_hits, "
        "CAST(sum(ips_payload_ampersand_count) AS BIGINT) AS ampersands, count(*) AS n "
        "FROM f GROUP BY event_type",
        f=rule_sql.features("ips", "traffic", "payload", "event_type"),
    )
)
def ips_sql_hits_by_type(spark, sf_dir):
    """SQL-injection hits per event type."""
    rows = feat.rule_features(
        fixture(spark, sf_dir, "traffic"), "payload", "ips", keep=["event_type"]
    )
    return rows.groupBy("event_type").agg(
        F.sum("ips_payload_sql_01_comb").alias("sql_hits"),
        F.sum("ips_payload_ampersand_count").alias("ampersands"),
        F.count("*").alias("n"),
    )


def _totals_sql(fam: str, keep: str) -> str:
    cols = ", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in family(fam).features)
    return f"SELECT {keep}, {cols} FROM f GROUP BY {keep}"


@query(
    sql(
        _totals_sql("ips", "source"),
        f=rule_sql.features("ips", "documents", "text", "source"),
    )
)
def document_rule_totals(spark, sf_dir):
    """IPS features over whole documents, summed per source."""
    rows = feat.rule_features(
        read_table(spark, sf_dir, "documents"), "text", "ips", keep=["source"]
    )
    return rows.groupBy("source").agg(*(F.sum(f).alias(f) for f in family("ips").features))


@query(features_sql("web", "pages", "html", "page_id"))
def page_rule_features(spark, sf_dir):
    """Log features over raw web pages."""
    return feat.rule_features(read_table(spark, sf_dir, "pages"), "html", "web", keep=["page_id"])


def _unpivot_sql(fam: str, keep: str, zero: bool = False) -> str:
    cols = family(fam).features
    where = "" if zero else " WHERE value <> 0"
    return (
        f"SELECT {keep}, feature, CAST(value AS DOUBLE) AS value FROM "
        f"(UNPIVOT f ON {', '.join(cols)} INTO NAME feature VALUE value){where}"
    )


@query(
    sql(
        "SELECT event_id, substr(feature, 5) AS feature, value FROM u",
        f=rule_sql.features("ips", "traffic", "payload", "event_id"),
        u=_unpivot_sql("ips", "event_id"),
    )
)
def nonzero_features_long(spark, sf_dir):
    """Feature rows with a value, the device prefix cut off."""
    wide = feat.rule_features(fixture(spark, sf_dir, "traffic"), "payload", "ips", keep=ID)
    rows = feat.to_long(wide, ID, family("ips").features, nonzero=True)
    return rows.select("event_id", feat.strip_prefix(F.col("feature"), "ips_").alias("feature"), "value")


@query(
    sql(
        "SELECT label, feature, CAST(sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS BIGINT) AS hit_rows, "
        "CAST(sum(value) AS BIGINT) AS total_value FROM u GROUP BY label, feature",
        f=rule_sql.features("ips", "traffic", "payload", "event_id, label"),
        u=_unpivot_sql("ips", "label", zero=True),
    )
)
def rule_hits_by_label(spark, sf_dir):
    """Hit counts of every rule per label."""
    wide = feat.rule_features(fixture(spark, sf_dir, "traffic"), "payload", "ips", keep=["label"])
    return feat.hits_by_label(wide, "label", family("ips").features)


_TRAINING = family("ips_training")
_FLAGS = [f for f in _TRAINING.features if not f.endswith("whitelist")]
_WHITELIST = _TRAINING.prefix + "whitelist"
_REFINED = (
    f"SELECT *, CASE WHEN {_WHITELIST} >= 2 OR ({_WHITELIST} <= 1 AND {' + '.join(_FLAGS)} = 0) "
    "THEN 'normal' ELSE label END AS new_label FROM f"
)
_TRAINING_SQL = rule_sql.features("ips_training", "traffic", "payload", "event_id, label")


def refined(spark, sf_dir):
    wide = feat.rule_features(
        fixture(spark, sf_dir, "traffic"), "payload", "ips_training", keep=["event_id", "label"]
    )
    return feat.refine_labels(
        wide.withColumn("new_label", F.col("label")), "new_label", _WHITELIST, _FLAGS
    )


@query(
    sql(
        "SELECT label, new_label, count(*) AS n FROM r GROUP BY label, new_label",
        f=_TRAINING_SQL,
        r=_REFINED,
    )
)
def refined_label_counts(spark, sf_dir):
    """Label counts before and after the refinement."""
    return profile.value_counts(refined(spark, sf_dir), "label", "new_label")


@query(
    sql(
        f"SELECT {_WHITELIST} AS requests, new_label, count(*) AS n FROM r "
        f"WHERE {_WHITELIST} >= 2 OR {' + '.join(_FLAGS)} = 0 GROUP BY 1, 2",
        f=_TRAINING_SQL,
        r=_REFINED,
    )
)
def relabelled_rows_by_requests(spark, sf_dir):
    """Rows that the refinement looks at, by number of requests."""
    # counted before the filter: a filter on features would be pushed below the
    # projection and compute every rule twice
    looked_at = (F.col(_WHITELIST) >= 2) | (feat.row_sum(_FLAGS) == 0)
    return (
        refined(spark, sf_dir)
        .groupBy(F.col(_WHITELIST).alias("requests"), "new_label")
        .agg(F.count_if(looked_at).alias("n"))
        .where("n > 0")
    )


@query(
    sql(
        "SELECT " + ", ".join(
            f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {c}"
            for c in ("event_id", "payload", "label")
        ) + ", count(*) AS n_rows FROM traffic"
    )
)
def null_counts(spark, sf_dir):
    """NULLs per column and the row count."""
    rows = fixture(spark, sf_dir, "traffic")
    return profile.null_counts(rows, ["event_id", "payload", "label"])


_DESCRIBED = list(family("ips").features)


def _describe_sql() -> str:
    one = (
        "SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, "
        "round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        "CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q25, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS q50, "
        "CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM f"
    )
    return " UNION ALL ".join(one.format(c=c) for c in _DESCRIBED)


@query(sql(_describe_sql(), f=rule_sql.features("ips", "traffic", "payload", "event_id")))
def describe_features(spark, sf_dir):
    """Count, mean, deviation and quartiles per feature."""
    wide = feat.rule_features(fixture(spark, sf_dir, "traffic"), "payload", "ips", keep=ID)
    return profile.describe(wide, _DESCRIBED)


@query(
    sql(
        f"SELECT min({_WHITELIST}) AS least_requests, max({_WHITELIST}) AS most_requests FROM f",
        f=_TRAINING_SQL,
    )
)
def request_count_range(spark, sf_dir):
    """Least and most requests in one payload."""
    wide = feat.rule_features(
        fixture(spark, sf_dir, "traffic"), "payload", "ips_training", keep=ID
    )
    return wide.agg(
        F.min(_WHITELIST).alias("least_requests"), F.max(_WHITELIST).alias("most_requests")
    )


def _catalogue_sql(fam: str) -> str:
    return rulebook.rule_dim(FAMILIES[fam]).sql()


@query(
    sql(
        "SELECT c.feature, c.kind, c.n_alternatives, c.keywords, h.hit_rows FROM "
        "(SELECT feature, max(kind) AS kind, count(*) AS n_alternatives, "
        "string_agg(pretty, ', ' ORDER BY alt_no) AS keywords FROM rules GROUP BY feature) c "
        "JOIN (SELECT feature, CAST(sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS BIGINT) AS hit_rows "
        "FROM u GROUP BY feature) h ON c.feature = h.feature",
        rules="SELECT *, replace(regexp_replace(replace(replace(pattern, '(.*?)', '[~]'), '[%%]', '%'), "
        r"'\[\\(.)\]', '\1', 'g'), '[^a-zA-Z0-9가-힣]', '') AS pretty FROM (" + _catalogue_sql("ips") + ")",
        f=rule_sql.features("ips", "traffic", "payload", "event_id"),
        u=_unpivot_sql("ips", "feature".replace("feature", "event_id"), zero=True),
    )
)
def rule_catalogue(spark, sf_dir):
    """Every feature with its keywords in readable form and its hits."""
    fam = family("ips")
    catalogue = rulebook.catalogue(spark, fam)
    wide = feat.rule_features(fixture(spark, sf_dir, "traffic"), "payload", "ips", keep=ID)
    hits = feat.hits_by_label(wide.withColumn("all_rows", F.lit(1)), "all_rows", fam.features)
    return catalogue.join(hits, "feature").select(
        "feature", "kind", "n_alternatives", "keywords", "hit_rows"
    )


@query(
    sql(
        "SELECT word FROM (SELECT DISTINCT word FROM pieces WHERE NOT contains(word, '(.*?)') "
        r"AND word <> '' AND NOT regexp_matches(word, '\(.*?\)')) "
        "EXCEPT SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) FROM documents",
        r=r"SELECT replace(regexp_replace(pattern, '\[\\(.)\]', '\1', 'g'), '[%%]', '%') AS plain FROM ("
        + _catalogue_sql("waf_v1") + ")",
        pieces="SELECT unnest(string_split(plain, '(.*?)')) AS word FROM r UNION ALL SELECT plain FROM r",
    )
)
def new_rule_words(spark, sf_dir):
    """Pieces of the rule patterns that the documents do not use as words."""
    vocabulary = rulebook.vocabulary(spark, family("waf_v1"))
    known = rulebook.known_words(vocabulary, read_table(spark, sf_dir, "documents"), "text")
    return vocabulary.join(known, "word", "left_anti")


@query(
    sql(
        "SELECT t.event_id, t.ips_payload_sql_01_comb, t.ips_payload_semicolon_count, "
        "w.weblog_sql_01_comb, w.weblog_dir_count FROM f t JOIN g w ON t.event_id = w.event_id",
        f=rule_sql.features("ips", "traffic", "payload", "event_id"),
        g=rule_sql.features("web", "weblogs", "web_log", "event_id"),
    )
)
def features_side_by_side(spark, sf_dir):
    """Two feature sets put together by id, never by position."""
    left = feat.rule_features(fixture(spark, sf_dir, "traffic"), "payload", "ips", keep=ID)
    right = feat.rule_features(fixture(spark, sf_dir, "weblogs"), "web_log", "web", keep=ID)
    return left.select("event_id", "ips_payload_sql_01_comb", "ips_payload_semicolon_count").join(
        right.select("event_id", "weblog_sql_01_comb", "weblog_dir_count"), "event_id"
    )
