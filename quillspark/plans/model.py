"""Pair classifiers: training, cross-validation, saving, scoring, coefficients."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


def classifiers(n: int) -> dict[str, list]:
    """Stages after assembling, by name: boosted trees, one tree, and logistic regression on scaled features, whose penalty goes by the n rows it is trained on."""
    return {
        "boosted_trees": [GBTClassifier(labelCol="label", featuresCol="features", maxIter=100, stepSize=0.1, maxDepth=6, subsamplingRate=0.8, seed=42)],
        "decision_tree": [DecisionTreeClassifier(labelCol="label", featuresCol="features", maxDepth=10, minInstancesPerNode=2, seed=42)],
        "logistic_regression": [StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(labelCol="label", featuresCol="scaled", regParam=1 / max(n, 1), standardization=False)],
    }


def train(df: DataFrame, features: list[str], name: str = "logistic_regression") -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), *classifiers(df.count())[name]]).fit(df.withColumn("label", F.col("label").cast("double")))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with `score`, the probability of a match."""
    return model.transform(df.withColumn("label", F.lit(0.0)) if "label" not in df.columns else df).withColumn("score", F.round(vector_to_array("probability")[1], 9))


def cross_validate(df: DataFrame, features: list[str], names: tuple[str, ...] = ("boosted_trees", "decision_tree", "logistic_regression"), k: int = 5) -> DataFrame:
    """(model, accuracy, f1, auc): means over the folds in column `fold`. The loop goes over models and folds, not over rows."""
    df = df.select("fold", *features, F.col("label").cast("double").alias("label"))
    # a round of boosting is many small jobs: no more tasks each than the rows ask for
    df = df.coalesce(1 + df.count() // 50_000).cache()
    auc = BinaryClassificationEvaluator(labelCol="label")

    def one(job: tuple[str, int]) -> tuple[float, float, float]:
        name, i = job
        p = train(df.filter(F.col("fold") != i), features, name).transform(df.filter(F.col("fold") == i)).cache()
        m = MulticlassClassificationEvaluator(labelCol="label")
        got = m.evaluate(p, {m.metricName: "accuracy"}), m.evaluate(p, {m.metricName: "f1"}), auc.evaluate(p)
        p.unpersist()
        return got

    # fits are independent of each other: some are trained at the same time, so that small ones fill the cluster
    with ThreadPoolExecutor(k) as pool:
        got = list(pool.map(one, [(name, i) for name in names for i in range(k)]))
    df.unpersist()
    rows = [(name, *(round(sum(x) / k, 6) for x in zip(*got[n * k : (n + 1) * k]))) for n, name in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "model string, accuracy double, f1 double, auc double")


def best_model(metrics: DataFrame, df: DataFrame, features: list[str], name: str | None = None) -> tuple[str, PipelineModel]:
    """The model of the best F1 (of `metrics`, as cross_validate() gives them), or the one named, trained on all rows."""
    if name is None:
        name = metrics.orderBy(F.desc("f1"), "model").first()["model"]
    return name, train(df, features, name)


def coefficients(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by the size of their coefficient in a logistic regression."""
    return sorted(zip(features, map(float, model.stages[-1].coefficients)), key=lambda x: -abs(x[1]))
