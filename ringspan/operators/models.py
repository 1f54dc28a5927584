"""Behaviour and onboarding models (L1-L3): gradient-boosted trees over feature columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import refuse_evaluation_columns
from .metrics import enough_positives, threshold_at_fpr
from .windows import FEATURES, stream_features


def behaviour_dataset(auth: DataFrame, truth: DataFrame | None = None, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """Features of every event over the history of ``keys``, and ``y`` where a truth (account, is_synthetic, first_fraud) is given: events of
    synthetic accounts from their first fraud on."""
    rows = stream_features(refuse_evaluation_columns(auth), keys)
    if truth is None:
        return rows
    known = truth.select("account", (F.col("is_synthetic")).alias("_s"), F.col("first_fraud").alias("_f"))
    return rows.join(known, "account", "left").withColumn("y", F.coalesce(F.col("_s") & (F.col("ts") >= F.col("_f")), F.lit(False)).cast("int")).drop("_s", "_f")


def to_matrix(rows: DataFrame, names: list[str] = FEATURES, out: str = "features") -> DataFrame:
    """L2"""
    return VectorAssembler(inputCols=list(names), outputCol=out, handleInvalid="error").transform(rows)


@dataclass
class TrainedModel:
    """L3"""

    pipeline: PipelineModel
    feature_names: list[str]
    threshold_at_target_fpr: float = float("inf")
    metrics: dict = field(default_factory=dict)

    def predict(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """Adds the probability of fraud, 0 to 1."""
        scored = self.pipeline.transform(rows)
        return scored.withColumn(out, F.get(vector_to_array("probability"), 1)).drop("features", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> str:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        SparkSession.active().createDataFrame([(self.feature_names, self.threshold_at_target_fpr, {k: str(v) for k, v in self.metrics.items()})], "names array<string>, threshold double, metrics map<string,string>").write.mode("overwrite").parquet(f"{path}/meta")
        return path

    @staticmethod
    def load(spark, path: str) -> TrainedModel:
        meta = spark.read.parquet(f"{path}/meta").first()
        return TrainedModel(PipelineModel.load(f"{path}/pipeline"), list(meta["names"]), meta["threshold"], dict(meta["metrics"]))


def train(rows: DataFrame, names: list[str] = FEATURES, fpr: float = 0.001, split_ts=None, trees: int = 20, depth: int = 4) -> TrainedModel:
    """Fits on rows (names, y); refuses fewer than 25 positives (L9). With ``split_ts`` it fits on rows up to that time and
    takes the threshold from the later ones, else the threshold holds the budget on what it was fit on."""
    fit = rows if split_ts is None else rows.filter(F.col("ts") <= split_ts)
    judged = rows if split_ts is None else rows.filter(F.col("ts") > split_ts)
    enough_positives(fit)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="features"), GBTClassifier(labelCol="y", maxIter=trees, maxDepth=depth, seed=7)]).fit(fit)
    model = TrainedModel(fitted, list(names), metrics={"split_ts": split_ts} if split_ts else {})
    model.threshold_at_target_fpr = threshold_at_fpr(model.predict(judged), fpr).first()["threshold"]
    return model
