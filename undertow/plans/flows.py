"""Maps stored tables to flows, state vectors and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_CATS = ["hour", "weekday"]
EVENT_NUMS = ["value", "k"]
ENCODER_CATS = ["clock", "weekday"]
LINE_CATS = ["l_linestatus", "p_brand"]
LINE_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, bytes_per_task: int = 1 << 20) -> DataFrame:
    """Deal the rows of a small, unsplittable file to more tasks; no effect once files fill the cores."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = min(spark.sparkContext.defaultParallelism, size // bytes_per_task)
    return df.repartition(wanted) if wanted > df.rdd.getNumPartitions() else df


def _seconds(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """events as flows: entity = user, label = error events; the event type itself is no feature."""
    at = F.col("ts").cast("timestamp")
    return read(spark, folder, "events").select(
        F.col("event_id").alias("flow_id"),
        F.col("user_id").cast("string").alias("entity_id"),
        _seconds("ts").alias("ts"),
        F.hour(at).cast("string").alias("hour"),
        (F.dayofweek(at) - 1).cast("string").alias("weekday"),
        F.date_format(at, "HH:mm").alias("clock"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.col("event_type"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with its part as flows: entity = supplier, time = ship date, label = returned."""
    part = read(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    # (l_orderkey, l_linenumber) repeats, so the id is (scan split, row), given before anything moves rows
    raw = spread(read(spark, folder, "lineitem").withColumn("_i", F.monotonically_increasing_id()))
    return raw.join(part, "l_partkey").select(
        F.col("_i").alias("flow_id"),
        F.col("l_suppkey").cast("string").alias("entity_id"),
        _seconds("l_shipdate").alias("ts"),
        *LINE_CATS,
        *LINE_NUMS,
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def states(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings as 64-wide states; the first five classes count as normal."""
    return read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("flow_id"),
        F.concat(F.lit("e"), (F.col("vec_id") % 20).cast("string")).alias("entity_id"),
        F.col("embedding").cast("array<double>").alias("h"),
        (F.col("label") >= 5).cast("int").alias("label"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """events as a labelled score table."""
    return events(spark, folder).select("flow_id", "entity_id", "ts", F.col("value").alias("score"), "label")


def text_scores(spark: SparkSession, folder: str) -> DataFrame:
    """labelled documents as a second score table: length against the toxic flag."""
    docs = read(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return read(spark, folder, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("flow_id"), "score", F.col("toxic").alias("label")
    )
