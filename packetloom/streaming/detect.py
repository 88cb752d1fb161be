"""The batch operators on a stream of payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from packetloom.functions.masking import with_masked
from packetloom.functions.rulesets import family
from packetloom.operators import scoring
from packetloom.operators.features import rule_features


def detections(
    payloads: DataFrame,
    text_col: str,
    coefs: dict[str, float],
    intercept: float,
    *,
    keep: list[str],
    rules: str = "ips",
) -> DataFrame:
    """Masked text, number of fired rules and attack probability.

    Stateless, so it is the same function for a table and for a stream.
    """
    masked = with_masked(payloads, text_col, "masked")
    scored = rule_features(masked, text_col, rules, keep=[*keep, "masked"])
    flags = [f for f in family(rules).features if f not in family(rules).counts]
    scored = scored.withColumn("fired", sum((F.col(f) for f in flags[1:]), F.col(flags[0])))
    return scoring.with_probability(scored, coefs, intercept).select(
        *keep, "masked", "fired", "attack_proba"
    )


def stream_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; files are committed exactly once."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
