"""Trained models and the stream.  Fits are not comparable with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import httpparse
from packetloom.functions.rulesets import family
from packetloom.functions.text import recode
from packetloom.operators import evaluate, explain, learn, scoring, splits, vectorize
from packetloom.operators import features as feat
from packetloom.plans import rule_sql
from packetloom.plans.model_queries import COEFS, INTERCEPT
from packetloom.plans.registry import query, sql
from packetloom.plans.text_queries import PAYLOAD_KINDS, chain_sql
from packetloom.sources import samples
from packetloom.sources.fixtures import fixture, spread
from packetloom.sources.scratch import scratch_path
from packetloom.streaming import detect

# Names of the agent classes in the report.
AGENT_NAMES = {
    "bad_bot_crawler": "악성 봇 크롤러",
    "normal_bot_crawler": "정상 봇 크롤러",
    "application": "애플리케이션",
}

IPS = family("ips")
WEB = family("web")
TRAINING = family("ips_training")


def _attack_table(spark, sf_dir):
    """Features with refined labels, as a table that a fit can read often."""
    rows = fixture(spark, sf_dir, "traffic")
    wide = feat.rule_features(rows, "payload", "ips_training", keep=["event_id", "label"])
    flags = [f for f in TRAINING.features if not f.endswith("whitelist")]
    refined = feat.refine_labels(wide, "label", TRAINING.prefix + "whitelist", flags)
    refined = refined.withColumn("target", (F.col("label") == "anomalies").cast("double"))
    # the split reads its rows four times
    features = scratch_path(spark, "attack-features")
    refined.write.parquet(features)
    table = spark.read.schema(refined.schema).parquet(features)
    path = scratch_path(spark, "attack-parts")
    splits.stratified_split(table, "event_id", "label", "7171", 20).write.parquet(path)
    return spread(spark.read.parquet(path))


def _both_parts(table):
    return table.where("part = 'train'"), table.where("part = 'test'")


@query()
def boosted_tree_scores(spark, sf_dir):
    """Boosted trees on the training features, scored on the held-out part."""
    train, test = _both_parts(_attack_table(spark, sf_dir))
    model = learn.fit_boosted_trees(train, TRAINING.features, "target")
    p = F.get("proba", F.lit(1))
    return learn.score(model, test).select(
        "event_id", "label", F.round(p, 6).alias("attack_proba"), scoring.binary_comment(p).alias("comment")
    )


@query()
def logistic_model_report(spark, sf_dir):
    """Quality of a weighted logistic model on the held-out part."""
    train, test = _both_parts(_attack_table(spark, sf_dir))
    weighted = evaluate.with_class_weight(train, "target")
    model = learn.fit_logistic(
        weighted, TRAINING.features, "target", weight_col="weight", maxIter=20
    )
    return evaluate.classification_report(learn.score(model, test), "target", "prediction")


@query()
def saved_model_scores(spark, sf_dir):
    """A model saved, loaded again and used on every payload."""
    table = _attack_table(spark, sf_dir)
    path = scratch_path(spark, "model")
    learn.save(learn.fit_logistic(table.where("part = 'train'"), TRAINING.features, "target", maxIter=20), path)
    scored = learn.score(learn.load(path), table)
    return scored.select(
        "event_id", "prediction", scoring.as_percent(F.get("proba", F.lit(1))).alias("attack_percent")
    )


@query()
def tree_attributions(spark, sf_dir):
    """Occlusion attributions of the boosted trees on the held-out part."""
    train, test = _both_parts(_attack_table(spark, sf_dir))
    model = learn.fit_boosted_trees(train, TRAINING.features, "target")
    means = explain.feature_means(train, TRAINING.features)
    baseline = {f: float(round(m)) for f, m in means.items()}
    out = learn.occlusion(model, test, ["event_id"], TRAINING.features, baseline)
    return out.withColumn("phi", F.round("phi", 6))


def _log_class():
    def fired(*names: str):
        out = F.col(WEB.prefix + names[0]) > 0
        for n in names[1:]:
            out = out | (F.col(WEB.prefix + n) > 0)
        return out

    return (
        F.when(fired("xss_01_comb"), 3)
        .when(fired("sql_01_comb", "sql_02_comb", "sql_03_comb", "sql_04_comb", "sql_05_comb"), 2)
        .when(fired("cmd_01_comb", "cmd_02_comb", "cmd_03_comb"), 0)
        .otherwise(1)
        .cast("double")
    )


@query()
def weblog_class_scores(spark, sf_dir):
    """Four-class forest on log features, in percent, with the other classes' label."""
    logs = fixture(spark, sf_dir, "weblogs")
    wide = feat.rule_features(logs, "web_log", "web", keep=["event_id"]).withColumn("target", _log_class())
    path = scratch_path(spark, "log-features")
    wide.write.parquet(path)
    table = spread(spark.read.parquet(path))
    model = learn.fit_forest(table, WEB.features, "target")
    scored = learn.score(model, table).select(
        "event_id", "prediction", *scoring.class_percentages(F.col("proba"))
    )
    best = F.greatest("cmd_percent", "normal_percent", "sql_percent", "xss_percent")
    return scored.select(
        "event_id",
        scoring.class_name(F.col("prediction")).alias("predicted"),
        scoring.other_classes(F.col("prediction")).alias("others"),
        scoring.class_comment(F.col("prediction"), best).alias("comment"),
        "cmd_percent",
        "normal_percent",
        "sql_percent",
        "xss_percent",
    )


@query()
def agent_class_model(spark, sf_dir):
    """Three-class model on the TF-IDF of user agents."""
    logs = httpparse.parse_weblogs(fixture(spark, sf_dir, "weblogs"), "web_log")
    words = vectorize.tokens(
        F.coalesce(httpparse.agent_words(F.col("user_agent")), F.lit("")), vectorize.AGENT_SEPARATORS
    )
    classes = ["application", "bad_bot_crawler", "normal_bot_crawler"]
    path = scratch_path(spark, "agents")
    logs.select(
        "event_id", "parse_status", words.alias("words"), learn.numbered_labels(F.col("agent_class"), classes).alias("target")
    ).write.parquet(path)
    table = spread(spark.read.parquet(path)).where("parse_status = 'web log'")
    vocabulary = [(w, idf) for _, w, idf in samples.AGENT_VOCABULARY.rows]
    model = learn.fit_agent_classifier(table, "words", "target", vocabulary)
    scored = learn.score(model, table).withColumn(
        "name", F.element_at(F.array(*(F.lit(c) for c in classes)), F.col("prediction").cast("int") + 1)
    )
    return scored.select("event_id", recode(F.col("name"), AGENT_NAMES).alias("agent_class"))


@query()
def text_model_scores(spark, sf_dir):
    """Class-weighted linear model on hashed payload tokens."""
    rows = fixture(spark, sf_dir, "traffic").fillna("", ["payload"])
    path = scratch_path(spark, "texts")
    evaluate.with_class_weight(rows, "label").select(
        "event_id", "payload", "weight", (F.col("label") == "anomalies").cast("double").alias("target")
    ).write.parquet(path)
    table = spread(spark.read.parquet(path))
    model = learn.fit_text_classifier(
        table, "payload", "target", separators=vectorize.KEPT_SEPARATORS, weight_col="weight"
    )
    return learn.score(model, table).select(
        "event_id",
        F.when(F.col("prediction") == 1, "POSITIVE").otherwise("NEGATIVE").alias("predicted"),
        scoring.as_percent(F.array_max("proba")).alias("percent"),
    )


# --- stream -----------------------------------------------------------------

_FLAGS = [f for f in IPS.features if f not in IPS.counts]
_LOGIT = f"{INTERCEPT} + " + " + ".join(f"{f} * ({w})" for f, w in COEFS.items())


@query(
    sql(
        f"SELECT event_id, masked, {' + '.join(_FLAGS)} AS fired, round(1 / (1 + exp(-({_LOGIT}))), 9) AS attack_proba FROM f",
        c=chain_sql(PAYLOAD_KINDS, "traffic", "payload", "event_id"),
        m="SELECT event_id, m7 AS masked FROM c",
        f=rule_sql.features("ips", "m", "masked", "event_id, masked"),
    )
)
def stream_detections(spark, sf_dir):
    """Detection over a stream of payload files."""
    source = scratch_path(spark, "stream-source")
    rows = fixture(spark, sf_dir, "traffic").select("event_id", "payload")
    rows.write.parquet(source)
    stream = detect.stream_table(spark, source, rows.schema)
    found = detect.detections(stream, "payload", COEFS, INTERCEPT, keep=["event_id"])
    target = scratch_path(spark, "detections")
    run = detect.write_available(found, target, scratch_path(spark, "stream-checkpoint"))
    run.awaitTermination()
    return spark.read.parquet(target).withColumn("attack_proba", F.round("attack_proba", 9))
