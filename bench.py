"""Headline queries on local cores; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.  With
``--compare`` the 32 payload features are also timed as the plain SQL that
spells out every pattern, on the same rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from packetloom.plans import QUERIES  # noqa: E402
from packetloom.sources import fixtures  # noqa: E402

HEADLINES = [
    "ips_rule_features",
    "weblog_rule_features",
    "document_rule_totals",
    "rule_hits_by_label",
    "decoded_payloads",
    "mask_payloads",
    "mask_documents",
    "parsed_requests",
    "parsed_weblogs",
    "source_countries",
    "logistic_scores",
    "keyword_evidence",
    "explanation_top10",
    "payload_tfidf",
    "document_idf",
    "stratified_split",
    "document_halves",
    "nearest_vectors",
    "turn_pairs",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    fixtures.SPREAD = True  # one small file would use one core
    timed(lambda: QUERIES["character_features"].build(spark, sf_dir))  # warm the JVM
    seconds = {}
    for name in HEADLINES:
        build = QUERIES[name].build
        seconds[name] = round(min(timed(lambda: build(spark, sf_dir)) for _ in range(2)), 3)
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    if "--compare" in sys.argv:
        from packetloom.plans.spelled_out import payload_features

        result["compare"] = {
            "spelled_out_sql": round(
                min(timed(lambda: payload_features(spark, sf_dir)) for _ in range(2)), 3
            ),
            "ips_rule_features": seconds["ips_rule_features"],
        }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
