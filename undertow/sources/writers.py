"""Sinks for decisions, runs and alerts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.functions import scalars as S

DECISION_COLUMNS = [
    "flow_id", "entity_id", "ts", "actual_label", "predicted_label", "drift_score", "threshold", "scoring_mode", "split",
]


def write_decisions(df: DataFrame, run_dir: str) -> None:
    """All decisions as parquet and CSV, a folder per split."""
    out = df.select(*[c for c in DECISION_COLUMNS if c in df.columns])
    parts = ["split"] if "split" in out.columns else []
    for kind in ("parquet", "csv"):
        writer = out.write.mode("errorifexists").format(kind)
        if kind == "csv":
            writer = writer.option("header", "true")
        (writer.partitionBy(*parts) if parts else writer).save(f"{run_dir}/decisions_{kind}")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def config_hash(params: dict) -> str:
    """First 16 hex digits of the SHA-256 of the sorted JSON."""
    import hashlib

    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]


def config_hash_column(config_json: str):
    return F.substring(F.sha2(F.col(config_json), 256), 1, 16)


def write_run(run_dir: str, config: dict, metrics: DataFrame, decisions: DataFrame | None = None) -> None:
    """A run folder that is never overwritten: config, metrics and decisions."""
    spark = metrics.sparkSession
    if exists(spark, run_dir):
        raise FileExistsError(f"run folder {run_dir} exists")
    text = json.dumps(config, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).write.mode("errorifexists").text(f"{run_dir}/config")
    hashed = metrics.withColumn("experiment", F.struct(
        F.lit(config.get("dataset")).alias("dataset"), F.lit(config.get("model")).alias("model"),
        F.lit(config.get("seed")).cast("long").alias("random_seed"), F.lit(config_hash(config)).alias("config_hash")))
    hashed.write.mode("errorifexists").json(f"{run_dir}/metrics")
    if decisions is not None:
        write_decisions(decisions, run_dir)


def alert_lines(df: DataFrame, **cef) -> DataFrame:
    """One text line per positive decision."""
    hits = df.filter(F.col("is_anomaly"))
    return hits.select(S.cef_alert("entity_id", "ts", "drift_score", "threshold", **cef).alias("value"))


def write_alerts(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Append alert lines of a decision stream to text files."""
    writer = alert_lines(stream).writeStream.format("text").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
