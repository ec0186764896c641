"""Live scoring: source, encoding, state, score, verdict, alerts and windows."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from undertow.operators import encode as enc
from undertow.operators import ewma, recurrent, scoring, vectors
from undertow.session import shared_dir
from undertow.streaming.state import BUCKETS, END, bounded_backlog, reordered_scan, stream_scan, use_rocksdb

DOUBLES = T.ArrayType(T.DoubleType())
STATE_FIELDS = [T.StructField("h", DOUBLES), T.StructField("z", DOUBLES), T.StructField("dt", T.DoubleType())]


def stream_flows(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_trigger: int | None = None, **options) -> DataFrame:
    """Flow files as a stream, or a topic when kind is kafka (path is then the topic name)."""
    reader = spark.readStream.format(kind).options(**options)
    if kind == "kafka":
        raw = reader.option("subscribe", path).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("f")).select("f.*")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.schema(schema).load(path)


def stream_state_scan(stream: DataFrame, cell: recurrent.CfCCell, read: recurrent.Reader, keep=None, ttl_ms: int | None = None) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    kept = [c for c in (keep or stream.columns) if c != "dt"]
    return stream_scan(stream, recurrent.CfCFold(cell, read), STATE_FIELDS, keep=kept, ttl_ms=ttl_ms)


def stream_ewma(stream: DataFrame, value: str, alpha: float = 0.05, k: float = 3.0, warmup: int = 0, initial: float = 1.0, delay: str | None = None) -> DataFrame:
    """Adaptive thresholds on a stream; with a delay, rows are put in order behind the watermark first."""
    use_rocksdb(stream.sparkSession)
    fold = ewma.EwmaFold(value, alpha, k, warmup, initial)
    if delay:
        return reordered_scan(stream, fold, ewma.FIELDS, delay)
    return stream_scan(stream, fold, ewma.FIELDS)


def live_score(stream: DataFrame, model: enc.EncoderModel, cell: recurrent.CfCCell, scorer: scoring.Scorer, threshold: float, kind: str = "record") -> DataFrame:
    """Decisions for each flow: encode and fold with carried state, score, verdict.

    Token lookup is a static join; the vocabulary is part of the trained model.
    """
    use_rocksdb(stream.sparkSession)
    looked = enc.lookup(stream, model.vocabulary, model.cat_cols)
    read = recurrent.encoder_reader(model, kind)
    keep = ["flow_id", "entity_id", "ts", "label"]
    needed = [*dict.fromkeys([*keep, *model.cat_cols, *model.num_cols, *[f"{c}_id" for c in model.cat_cols]])]
    states = stream_scan(looked.select(*needed), recurrent.CfCFold(cell, read), STATE_FIELDS, keep=keep)
    z = "z" if scorer.fusion is not None else None
    scored = states.withColumn("score", scoring.score(scorer, "h", z))
    return scoring.decide(scored, threshold, mode=scorer.mode()).drop("score", "h", "z")


def route_alerts(decisions: DataFrame) -> DataFrame:
    """Positive decisions only, with their alert line."""
    from undertow.functions.scalars import cef_alert

    return decisions.filter(F.col("is_anomaly")).withColumn("line", cef_alert("entity_id", "ts", "drift_score", "threshold"))


def running_totals(decisions: DataFrame, label: str = "label") -> DataFrame:
    """Confusion counts and rates of a decision stream so far (update or complete mode)."""
    from undertow.operators.evaluate import confusion

    return confusion(decisions, F.col("is_anomaly"), label)


def alert_windows(decisions: DataFrame, size: str, slide: str | None = None, gap: str | None = None, time: str = "event_time") -> DataFrame:
    """Alerts and highest score per entity and window: tumbling, sliding, or sessions when gap is given."""
    frame = F.session_window(time, gap) if gap else F.window(time, size, slide or size)
    grouped = decisions.groupBy("entity_id", frame.alias("w")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("is_anomaly").cast("long")).alias("alerts"),
        F.max("drift_score").alias("max_score"),
    )
    return grouped.select("entity_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "row_count", "alerts", "max_score")


def stream_alert_windows(decisions: DataFrame, delay: str, size: str = "", slide: str | None = None, gap: str | None = None, time: str = "event_time") -> DataFrame:
    """The same windows of a stream, each emitted once, when the watermark has passed its end (append mode)."""
    use_rocksdb(decisions.sparkSession)
    return alert_windows(decisions.withWatermark(time, delay), size, slide, gap, time)


def stream_backlog(stream: DataFrame, capacity: int) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    return bounded_backlog(stream, capacity)


def settled_backlog(out: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Newest `capacity` rows of an ended backlog stream, and how many were dropped in all."""
    from undertow.operators.prep import keep_latest

    kept, dropped = keep_latest(out.filter("NOT dropped").drop("dropped"), capacity)
    return kept, dropped + out.filter("dropped").count()


def run_bounded(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Process everything available now into files, stop, and return the result as a table."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode(mode)
    query = writer.option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


#: Rows of a chunk of a replayed stream, and of a task that cuts one.
CHUNK_ROWS = 1_000_000


def stage_stream(df: DataFrame, order: str = "ts", chunks: int = 4, chunk_rows: int | None = CHUNK_ROWS) -> str:
    """Write a table as files in time order, one chunk after another, for replay as a stream; rows without a time first.

    A file is a chunk, so that a trigger of one file reads a stretch of time whole; chunks grow in number, not in size,
    or keep their number when chunk_rows is None. The table is read once and cut into chunks by one shuffle; files must
    appear one after another to be read in order, so each chunk is then copied from what was cut.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    n = df.count()
    chunks = max(chunks, -(-n // chunk_rows)) if chunk_rows else chunks
    edges = df.agg(F.percentile_approx(order, [i / chunks for i in range(1, chunks)], 100 * chunks)).first()[0] if chunks > 1 else []
    # edges at or above the value are not passed; a null passes none
    passed = [F.coalesce((F.col(order) > e).cast("int"), F.lit(0)) for e in edges or []]
    pieces = max(1, -(-n // (chunks * CHUNK_ROWS)))
    cut = df.withColumn("_chunk", sum(passed, F.lit(0))).repartition(chunks * pieces, "_chunk", F.pmod(F.xxhash64(order), F.lit(pieces)))
    cut.write.partitionBy("_chunk").parquet(f"{base}-cut")
    stored = spark.read.schema(cut.schema).parquet(f"{base}-cut")
    for i in range(chunks):
        stored.filter(F.col("_chunk") == i).drop("_chunk").coalesce(1).write.mode("append").parquet(base)
    return base


def end_stream(base: str, schema: T.StructType, spark: SparkSession, buckets: int = BUCKETS, **values) -> None:
    """Append rows that end a replayed stream: one for each bucket, of infinite time. `values` fills other columns."""
    rows = spark.range(buckets).select(
        *[
            F.lit(values[f.name]).cast(f.dataType).alias(f.name)
            if f.name in values
            else (F.lit(END) if f.name == "ts" else F.col("id") if f.name == "flow_id" else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
    rows.coalesce(1).write.mode("append").parquet(base)


# --------------------------------------------------------------------------- rates


RATES = "query_id string, name string, batch_id long, started string, input_rows long, input_rate double, processed_rate double, duration_ms long, state_rows long"


class RateListener(StreamingQueryListener):
    """Progress of running streams as rows: what each micro-batch read, how fast, and the state it left.

    Rows wait in memory until `flush_rows` of them are written to the folder, so a stream that runs for ever holds few.
    """

    def __init__(self, spark: SparkSession, flush_rows: int = 1000):
        self.spark, self.flush_rows, self.waiting, self.done = spark, flush_rows, [], set()
        self.path = f"{shared_dir(spark)}/rates-{uuid.uuid4().hex}"
        self.written = False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = sum(s.numRowsTotal for s in p.stateOperators)
        self.waiting.append((str(p.id), p.name, p.batchId, p.timestamp, p.numInputRows, float(p.inputRowsPerSecond), float(p.processedRowsPerSecond), p.batchDuration, state))
        if len(self.waiting) >= self.flush_rows:
            self._flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.done.add(str(event.id))

    def _flush(self) -> None:
        rows, self.waiting = self.waiting, []
        self.spark.createDataFrame(rows, RATES).coalesce(1).write.mode("append").parquet(self.path)
        self.written = True

    def rates(self) -> DataFrame:
        """A row per micro-batch so far."""
        if self.waiting or not self.written:
            self._flush()
        return self.spark.read.schema(RATES).parquet(self.path)


@contextmanager
def rate_table(spark: SparkSession, wait: float = 30.0):
    """A RateListener for the streams that run inside; on leaving it has heard of the end of those it heard of."""
    listener = RateListener(spark)
    spark.streams.addListener(listener)
    try:
        yield listener
        until = time.monotonic() + wait
        while time.monotonic() < until and (not listener.waiting or {r[0] for r in listener.waiting} - listener.done):
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
