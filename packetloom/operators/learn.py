"""Trained models: Spark ML pipelines over features and texts."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    HashingTF,
    RegexTokenizer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def fit_boosted_trees(df: DataFrame, features: list[str], label_col: str, **params) -> PipelineModel:
    """Two-class gradient boosted trees."""
    settings = {"maxIter": 20, "maxDepth": 5, "seed": 127127, **params}
    trees = GBTClassifier(labelCol=label_col, featuresCol="features", **settings)
    return Pipeline(stages=[assembler(features), trees]).fit(df)


def fit_logistic(
    df: DataFrame, features: list[str], label_col: str, *, weight_col: str | None = None, **params
) -> PipelineModel:
    settings = {"maxIter": 50, "regParam": 0.001, **params}
    if weight_col:
        settings["weightCol"] = weight_col
    model = LogisticRegression(labelCol=label_col, featuresCol="features", **settings)
    return Pipeline(stages=[assembler(features), model]).fit(df)


def fit_forest(df: DataFrame, features: list[str], label_col: str, **params) -> PipelineModel:
    """More than two classes."""
    settings = {"numTrees": 20, "maxDepth": 6, "seed": 127127, **params}
    forest = RandomForestClassifier(labelCol=label_col, featuresCol="features", **settings)
    return Pipeline(stages=[assembler(features), forest]).fit(df)


def fit_text_classifier(
    df: DataFrame,
    text_col: str,
    label_col: str,
    *,
    separators: str,
    weight_col: str | None = None,
    cells: int = 1 << 16,
) -> PipelineModel:
    """Hashed tokens and a linear model, rows weighted by class."""
    words = RegexTokenizer(
        inputCol=text_col, outputCol="__words", pattern=separators, toLowercase=True, minTokenLength=1
    )
    hashed = HashingTF(inputCol="__words", outputCol="features", numFeatures=cells)
    settings = {"weightCol": weight_col} if weight_col else {}
    model = LogisticRegression(
        labelCol=label_col, featuresCol="features", maxIter=20, regParam=0.01, **settings
    )
    return Pipeline(stages=[words, hashed, model]).fit(df)


def fit_agent_classifier(
    df: DataFrame, words_col: str, label_col: str, vocabulary: list[tuple[str, float]]
) -> PipelineModel:
    """TF-IDF of a stored vocabulary and a linear model."""
    counts = CountVectorizerModel.from_vocabulary(
        [w for w, _ in vocabulary], inputCol=words_col, outputCol="__counts"
    )
    weighted = ElementwiseProduct(
        scalingVec=Vectors.dense([i for _, i in vocabulary]),
        inputCol="__counts",
        outputCol="features",
    )
    model = LogisticRegression(
        labelCol=label_col, featuresCol="features", maxIter=30, regParam=0.001
    )
    return Pipeline(stages=[counts, weighted, model]).fit(df)


def probabilities(c: str = "probability") -> Column:
    return vector_to_array(F.col(c))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``proba`` (array, one entry per class)."""
    out = model.transform(df).withColumn("proba", probabilities())
    return out.drop("features", "rawPrediction", "probability", "__words", "__counts")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def occlusion(
    model: PipelineModel,
    df: DataFrame,
    ids: list[str],
    features: list[str],
    baseline: dict[str, float],
) -> DataFrame:
    """Attribution for any model: change of the probability without a feature.

    ``phi`` is the class-1 probability of the row minus that of the row with
    one feature at its baseline.  Every row has all features; those already at
    the baseline change nothing, so their 0 needs no scoring.  Scoring stays in
    the JVM.
    """
    numbers = F.array(*(F.col(f).cast("double") for f in features))
    base = F.array(*(F.lit(float(baseline[f])) for f in features))
    rows = df.select(*ids, numbers.alias("__x"), F.monotonically_increasing_id().alias("__row"))
    changed = F.filter(
        F.transform(
            F.arrays_zip(F.col("__x").alias("x"), base.alias("b")),
            lambda z, i: F.struct(i.alias("no"), (~z["x"].eqNullSafe(z["b"])).alias("differs")),
        ),
        lambda z: z["differs"],
    )
    variants = F.concat(F.array(F.lit(-1)), F.transform(changed, lambda z: z["no"]))
    exploded = rows.select(*ids, "__row", "__x", F.explode(variants).alias("__no"))
    inputs = exploded.select(
        *ids,
        "__row",
        "__no",
        *(
            F.when(F.col("__no") == i, F.lit(float(baseline[f])))
            .otherwise(F.get("__x", F.lit(i)))
            .alias(f)
            for i, f in enumerate(features)
        ),
    )
    scored = score(model, inputs).select(*ids, "__row", "__no", F.get("proba", F.lit(1)).alias("__p"))
    # all variants of a row; at most one per feature
    whole = F.max(F.when(F.col("__no") == -1, F.col("__p")))
    changed_p = F.collect_list(F.when(F.col("__no") >= 0, F.struct("__no", "__p")))
    gathered = scored.groupBy(*ids, "__row").agg(
        whole.alias("__whole"), F.map_from_entries(changed_p).alias("__v")
    )
    each = F.array(
        *(
            F.struct(
                F.lit(f).alias("feature"),
                F.coalesce(F.col("__whole") - F.try_element_at("__v", F.lit(i)), F.lit(0.0)).alias("phi"),
            )
            for i, f in enumerate(features)
        )
    )
    return gathered.select(*ids, F.inline(each))


def numbered_labels(c: Column, classes: list[str]) -> Column:
    """Class number by position in the list."""
    return (F.array_position(F.array(*(F.lit(x) for x in classes)), c) - 1).cast("double")


