"""Training, scoring and evaluation of the boosted-tree regressor on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from hazelake.constants import FEATURES, display_name
from hazelake.functions.scalar import clip_at_zero
from hazelake.functions.trees import Ensemble
from hazelake.operators.splits import complete_cases
from hazelake.operators.stats import to_long
from hazelake.plans import boosting
from hazelake.plans.boosting import Boosted, Settings
from hazelake.session import fresh_path, shared_folder

# --- fixed values: published hyper-parameters of the two variants ---------------------------
FULL_PARAMS = {
    "maxIter": 1000, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8", "minInstancesPerNode": 5, "seed": 42,
}
SIMPLE_PARAMS = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1, "seed": 42}
PATIENCE = 50
#: the same two for ``fit_boosted``, with penalties, least gain and columns per level
FULL = Settings(
    rounds=1000, depth=6, step=0.05, row_share=0.8, tree_columns=0.8, level_columns=0.8, min_rows=5, l1=0.1, l2=1.0, min_gain=0.1, patience=PATIENCE, seed=42
)
SIMPLE = Settings(rounds=200, depth=6, step=0.1, row_share=1.0, tree_columns=1.0, level_columns=1.0, min_rows=1, l1=0.0, l2=1.0, min_gain=0.0, patience=PATIENCE, seed=42)


@dataclass(frozen=True)
class Fitted:
    """``rounds`` is the prefix that scores, forecasts and explains; all rounds if it is not given."""

    model: GBTRegressionModel | None
    ensemble: Ensemble
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    rounds: int | None = None
    boosted: Boosted | None = None


def assemble(df: DataFrame, features=FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit(train: DataFrame, label: str = "PM25", features=FEATURES, most_rows: int | None = None, **params) -> Fitted:
    """Fit on rows that have every feature and the label; on ``most_rows`` of them, drawn by hash, if that is given.

    The rows are written once and read back: boosting scans them in every round, and a lost
    executor then rereads files instead of recomputing all windows.
    """
    spark = train.sparkSession
    shared_folder(spark)  # tree growing checkpoints below it
    rows = complete_cases(train, [*features, label]).select(*features, F.col(label).alias("label"))
    if most_rows is not None:
        rows = rows.orderBy(F.xxhash64(*rows.columns), "label").limit(most_rows)
    path = fresh_path(spark, "training-rows")
    rows.write.parquet(path)
    settings = {**FULL_PARAMS, **params}
    learner = GBTRegressor(featuresCol="features", labelCol="label", predictionCol="prediction", **settings)
    model = learner.fit(assemble(spark.read.parquet(path), features).select("features", "label"))
    return Fitted(model, flatten(model), list(features))


def fit_boosted(train: DataFrame, validation: DataFrame, label: str = "PM25", features=FEATURES, settings: Settings = FULL, path: str | None = None) -> Fitted:
    """Fit on all rows that have every feature and the label, until the validation error stops falling.

    The rounds up to the best one score, forecast and explain. ``path`` makes the fit resumable.
    """
    boosted = boosting.fit(train, validation, label, list(features), settings, path)
    ensemble = boosted.ensemble()
    return Fitted(None, ensemble, list(features), len(ensemble.roots), boosted)


def save(fitted: Fitted, path: str) -> None:
    fitted.model.write().overwrite().save(path)


def load(spark: SparkSession, path: str, features=FEATURES) -> Fitted:
    model = GBTRegressionModel.load(path)
    return Fitted(model, _read_nodes(spark, path, model.treeWeights), list(features))


def flatten(model: GBTRegressionModel) -> Ensemble:
    spark = SparkSession.getActiveSession()
    path = fresh_path(spark, "model")
    model.write().save(path)
    return _read_nodes(spark, path, model.treeWeights)


def _read_nodes(spark: SparkSession, path: str, weights) -> Ensemble:
    """The saved nodes; rounds x 2^(depth + 1) rows at most."""
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("id"),
        node["split"]["featureIndex"].alias("feature"),
        F.try_element_at(node["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["prediction"].alias("value"),
        node["rawCount"].alias("cover"),
    )
    return Ensemble.from_nodes(nodes.toPandas(), weights)


def score(df: DataFrame, fitted: Fitted, trees: int | None = None, name: str = "predicted", clip: bool = True) -> DataFrame:
    """Predictions of the first ``trees`` rounds (by default those chosen, else all), clipped at zero."""
    trees = trees or fitted.rounds
    if trees is None:
        scored = fitted.model.transform(assemble(df, fitted.features)).drop("features")
        scored = scored.withColumnRenamed("prediction", name)
    else:
        # columns that no tree cuts are neither computed nor sent to Python
        ensemble, used = fitted.ensemble.first(trees).over_used(fitted.features)

        @F.pandas_udf("double")
        def predict(x: pd.DataFrame) -> pd.Series:
            return pd.Series(ensemble.predict(x.to_numpy(dtype=float)))

        scored = df.withColumn(name, predict(F.struct(*[fitted.features[i] for i in used])))
    return scored.withColumn(name, clip_at_zero(name)) if clip else scored


def _errors(fitted: Fitted, df: DataFrame, label: str) -> list[float]:
    rows = complete_cases(df, [*fitted.features, label]).withColumn("label", F.col(label))
    return fitted.model.evaluateEachIteration(assemble(rows, fitted.features), "absolute")


def early_stopped(fitted: Fitted, validation: DataFrame, label: str = "PM25", patience: int = PATIENCE) -> Fitted:
    """The same model, cut to the rounds that are best on the validation rows."""
    rounds = best_round(_errors(fitted, validation, label), patience) + 1
    return replace(fitted, ensemble=fitted.ensemble.first(rounds), rounds=rounds)


def learning_curve(fitted: Fitted, train: DataFrame, validation: DataFrame, label: str = "PM25", patience: int = PATIENCE) -> DataFrame:
    """MAE per round on both parts, the best round marked; as noted while fitting if the model was boosted here."""
    if fitted.boosted:
        errors, best = fitted.boosted.state.errors[1:], fitted.boosted.best
        rows = [(i, a, b, i == best) for i, (a, b) in enumerate(errors, 1)]
        return train.sparkSession.createDataFrame(rows, "round int, train_mae double, validation_mae double, is_best boolean")
    on_train, on_validation = _errors(fitted, train, label), _errors(fitted, validation, label)
    best = best_round(on_validation, patience)
    rows = [
        (i + 1, float(a), float(b), i == best) for i, (a, b) in enumerate(zip(on_train, on_validation))
    ]
    spark = train.sparkSession
    return spark.createDataFrame(rows, "round int, train_mae double, validation_mae double, is_best boolean")


def best_round(errors, patience: int = PATIENCE) -> int:
    """Index of the smallest error seen before ``patience`` rounds bring no better one."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best


def feature_importance(fitted: Fitted, n: int = 20) -> DataFrame:
    """Normalised gain per feature, the ``n`` largest, with the kind of signal they carry."""
    gains = fitted.boosted.gains() if fitted.boosted else fitted.model.featureImportances.toArray()
    rows = [(f, display_name(f), float(g)) for f, g in zip(fitted.features, gains)]
    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame(rows, "feature string, display string, importance double")
    kind = (
        F.when(F.col("feature").rlike("lag|roll"), "history")
        .when(F.col("feature").rlike("hotspot|frp"), "fire")
        .otherwise("other")
    )
    return table.withColumn("kind", kind).orderBy(F.desc("importance"), "feature").limit(n)


def fit_scaler(df: DataFrame, columns=FEATURES) -> DataFrame:
    """Mean and population standard deviation per column; a constant column gets scale 1."""
    long = to_long(df, columns, name="feature")
    scale = F.stddev_pop("value")
    return long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.when(scale == 0, 1.0).otherwise(scale).alias("scale")
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, columns=FEATURES) -> DataFrame:
    """Standardised columns; the scaler has one row per column and is looked up by scalar subqueries."""

    def of(c, what):
        return scaler.where(F.col("feature") == c).select(what).scalar()

    return df.withColumns({c: (F.col(c) - of(c, "mean")) / of(c, "scale") for c in columns})
