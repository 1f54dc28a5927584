"""Event streams on disk (S1-S6, S9, S10, S12): one JSON object a line, schemas enforced on read."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import STREAMS, VIEWS

SCOPED = ("onboarding_events", "auth_events", "session_telemetry", "labels")


def read_stream(spark: SparkSession, root: str, stream: str, limit: int | None = None) -> DataFrame:
    """A malformed line fails the read. ``limit`` keeps the first lines of the file, in file order."""
    schema, path = STREAMS[stream], f"{root}/{stream}.jsonl"
    if limit is None:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    # files by name, splits by their start; within a split ids rise with the lines
    place = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n")]
    lines = spark.read.text(path).select("value", *place).filter(F.trim("value") != "").orderBy("_f", "_b", "_n").limit(limit)
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


@dataclass
class Dataset:
    """Five streams seen from one place."""

    view: str
    institution_id: str | None
    streams: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["streams"][name]
        except KeyError:
            raise AttributeError(name) from None

    def summary(self) -> DataFrame:
        """S4"""
        counts = [df.agg(F.lit(name).alias("stream"), F.count(F.lit(1)).alias("n")) for name, df in self.streams.items()]
        out = counts[0]
        for c in counts[1:]:
            out = out.union(c)
        return out


def load(spark: SparkSession, root: str, view: str = "network", institution_id: str | None = None, limit: int | None = None) -> Dataset:
    """Any view but the network's needs an institution and sees its rows only, below every window. The limit counts
    before the scope; the truth ignores both."""
    if view not in VIEWS:
        raise ValueError(f"no view {view!r}; there are {', '.join(VIEWS)}")
    if view != "network" and not institution_id:
        raise ValueError(f"the {view} view needs an institution_id")
    found = {s: read_stream(spark, root, s, limit) for s in SCOPED}
    if view != "network":
        found = {s: df.filter(F.col("institution_id") == institution_id) for s, df in found.items()}
    return Dataset(view, institution_id, found | {"ground_truth": read_stream(spark, root, "ground_truth")})


def institutions_in(spark: SparkSession, root: str) -> DataFrame:
    """S3"""
    return read_stream(spark, root, "auth_events").select("institution_id").distinct().orderBy("institution_id")


def write_stream(df: DataFrame, root: str, stream: str) -> None:
    """Timestamps to the microsecond."""
    micros = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    df.write.mode("overwrite").options(**micros).json(f"{root}/{stream}.jsonl")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """One JSON document, through Spark so that any of its file systems will do."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def manifest(data: Dataset, config: dict) -> dict:
    """Counts, fraud rate, ring sizes and configuration of a generated scenario."""
    counts = {r["stream"]: r["n"] for r in data.summary().collect()}
    truth = data.ground_truth
    rings = {r["ring_id"]: r["count"] for r in truth.filter("ring_id IS NOT NULL").groupBy("ring_id").count().collect()}
    fraud = data.auth_events.join(truth.filter("is_synthetic").select("account_id", "first_fraud_ts"), "account_id").filter("ts >= first_fraud_ts").count()
    return {"counts": counts, "n_fraud_events": fraud, "fraud_rate": fraud / max(1, counts["auth_events"]), "ring_sizes": rings, "config": config}


def paced(first: DataFrame, order: tuple[str, ...], speed: float = 200.0) -> DataFrame:
    """The rows of a limited read, with the milliseconds after the start at which each is due."""
    nth = F.row_number().over(Window.orderBy(*order)) - 1  # as many rows as the caller's limit
    return first.withColumn("due_ms", nth * (1000.0 / max(1.0, speed)))


def replay(spark: SparkSession, path: str, schema, limit_files: int = 1) -> DataFrame:
    """Stored files as a stream, in the order they were written."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", limit_files).parquet(path)


class Vault:
    """Tokens never resolve."""

    def resolve(self, token: str):
        raise PermissionError("tokens are not resolved here")

    def __len__(self) -> int:
        return 0
