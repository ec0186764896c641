"""Per-entity folds over streams. The same Fold classes run in batch and here.

Entities are dealt into buckets; a bucket keeps its entities' states in one map, so one call advances all the entities that
a micro-batch brings to the bucket side by side. A row whose time is infinite ends the stream of the bucket that its
flow_id names: what is held back comes out, so that a bounded run returns every row it was given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from undertow.operators.ordered import Fold, _runs

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets that entities are dealt into; fixed for the life of a checkpoint.
BUCKETS = 64
#: A watermark delay is cut into so many slots, which are held and released whole.
SLOTS = 16
END = float("inf")


def use_rocksdb(spark) -> None:
    """State lives in RocksDB on executors and is checkpointed to the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def bucket(key: str, buckets: int) -> Column:
    """The bucket of an entity; the row that ends a bucket's stream names it."""
    return F.when(F.col("ts") == END, F.col("flow_id")).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])


class _Folding(StatefulProcessor):
    def __init__(self, fold: Fold, key: str, rows: T.StructType, kept: list[str], added: list[str], ttl_ms: int | None):
        self.fold, self.key, self.rows, self.kept, self.added, self.ttl_ms = fold, key, rows, kept, added, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("fold", "entity string", "bytes binary", self.ttl_ms)

    def _table(self, frames: Iterator[pd.DataFrame]) -> pa.Table:
        schema = to_arrow_schema(self.rows)
        return pa.concat_tables([pa.Table.from_pandas(f[self.rows.names], schema=schema, preserve_index=False) for f in frames])

    def _advance(self, rows: pa.Table) -> pd.DataFrame:
        """Fold rows in (ts, flow_id) order from the stored states, all entities side by side."""
        names = rows.column(self.key).cast(pa.string())
        code = pc.coalesce(pc.binary_join_element_wise("=", names, ""), pa.scalar(""))
        rows = rows.append_column("_code", code)
        rows = rows.take(pc.sort_indices(rows, [("_code", "ascending"), ("ts", "ascending"), ("flow_id", "ascending")], null_placement="at_start"))
        batch = rows.combine_chunks().to_batches()[0]
        starts = _runs(batch.column("_code"))
        entities = batch.column("_code").take(pa.array(starts)).to_pylist()
        state = self.fold.start(len(starts))
        for i, entity in enumerate(entities):
            held = self.state.getValue((entity,))
            if held is not None:
                state[i] = np.frombuffer(held[0])
        outs, ends = self.fold.run(self.fold.inputs(batch), starts, np.diff(np.append(starts, batch.num_rows)), state)
        for entity, end in zip(entities, ends):
            self.state.updateValue((entity,), (np.ascontiguousarray(end, float).tobytes(),))
        out = rows.select(self.kept).to_pandas()
        for name, values in zip(self.added, self.fold.outputs(outs)):
            out[name] = values.to_pylist() if pa.types.is_list(values.type) else values.to_numpy(zero_copy_only=False)
        return out

    def close(self) -> None:
        pass


class FoldProcessor(_Folding):
    """Rows of a micro-batch are applied in time order at once."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self._advance(self._table(rows))


class OrderedFoldProcessor(_Folding):
    """Rows are held until the watermark has passed their slot of time, then applied in time order.

    A slot's rows lie under keys of their own, so a new row is added without touching older ones and a release reads no
    more than what it releases. A row whose slot has been passed, or without a time, comes out unfolded with late = true:
    the engine does not see the time column behind the watermark, so it drops none of them.
    """

    def __init__(self, *args, slot: float):
        super().__init__(*args)
        self.slot = slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getMapState("held", "slot long, part long", "rows binary")
        self.parts = handle.getMapState("parts", "slot long", "parts long")
        self.over = handle.getValueState("over", "slot long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = self._table(rows)
        ts = new.column("ts").to_numpy(zero_copy_only=False).astype(float)
        last = ts == END
        slot = np.floor(np.where(np.isfinite(ts), ts, 0.0) / self.slot).astype(np.int64)
        passed = self.over.get()[0] if self.over.exists() else np.iinfo(np.int64).min
        passed = max(passed, int(timerValues.getCurrentWatermarkInMs() / 1000.0 // self.slot) - 1)
        late = ~last & (~np.isfinite(ts) | (slot <= passed))
        if late.any():
            yield self._blank(new.filter(pa.array(late)))
        for s in np.unique(slot[~late & ~last]).tolist():
            part = self.parts.getValue((s,))
            part = 0 if part is None else part[0]
            self.held.updateValue((s, part), (_packed(new.filter(pa.array(~late & ~last & (slot == s)))),))
            self.parts.updateValue((s,), (part + 1,))
            self.handle.registerTimer(int(np.ceil((s + 1) * self.slot * 1000)))
        if last.any():
            yield from self._release(np.iinfo(np.int64).max)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(int(timerValues.getCurrentWatermarkInMs() / 1000.0 // self.slot) - 1)

    def _release(self, upto: int) -> Iterator[pd.DataFrame]:
        """Fold the rows of all slots up to this one."""
        ready = sorted(s for (s,) in list(self.parts.keys()) if s <= upto)
        if not ready:
            return
        blobs = []
        for s in ready:
            for part in range(self.parts.getValue((s,))[0]):
                blobs.append(self.held.getValue((s, part))[0])
                self.held.removeKey((s, part))
            self.parts.removeKey((s,))
        self.over.update((ready[-1],))
        out = self._advance(_unpacked(blobs))
        out["late"] = False
        yield out

    def _blank(self, rows: pa.Table) -> pd.DataFrame:
        out = rows.select(self.kept).to_pandas()
        for name in self.added:
            out[name] = None
        out["late"] = True
        return out


class BacklogProcessor(StatefulProcessor):
    """Keeps a bucket's newest rows; what falls out, and at the end what is left, comes out marked."""

    def __init__(self, capacity: int, rows: T.StructType):
        self.capacity, self.rows = capacity, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        schema = to_arrow_schema(self.rows)
        new = pa.concat_tables([pa.Table.from_pandas(f[self.rows.names], schema=schema, preserve_index=False) for f in rows])
        last = pc.fill_null(pc.equal(new.column("ts"), END), False)
        if self.state.exists():
            new, last = pa.concat_tables([new, old := _unpacked([self.state.get()[0]])]), pa.chunked_array([*last.chunks, pa.array([False] * len(old))])
        ending = pc.any(last).as_py()
        new = new.filter(pc.invert(last))
        new = new.take(pc.sort_indices(new, [("ts", "descending"), ("flow_id", "descending")], null_placement="at_end"))
        if len(new) > self.capacity:
            yield new.slice(self.capacity).to_pandas().assign(dropped=True)
        kept = new.slice(0, self.capacity)
        if ending and len(kept):
            yield kept.to_pandas().assign(dropped=False)
            kept = kept.slice(0, 0)
        self.state.update((_packed(kept),))

    def close(self) -> None:
        pass


def stream_scan(
    stream: DataFrame,
    fold: Fold,
    out_fields: list[T.StructField],
    key: str = "entity_id",
    keep: list[str] | None = None,
    ttl_ms: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The carry scan on a stream: state per key survives micro-batches; ttl_ms bounds idle keys."""
    kept = keep or stream.columns
    schema = T.StructType([stream.schema[c] for c in kept] + out_fields)
    processor = FoldProcessor(fold, key, stream.schema, kept, [f.name for f in out_fields], ttl_ms)
    dealt = stream.withColumn("_bucket", bucket(key, buckets)).groupBy("_bucket")
    return dealt.transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if ttl_ms else "None")


def reordered_scan(
    stream: DataFrame,
    fold: Fold,
    out_fields: list[T.StructField],
    delay: str,
    key: str = "entity_id",
    keep: list[str] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The same for streams out of order by up to `delay`; needs an event_time timestamp column that follows ts."""
    plain = T.StructType([f for f in stream.schema.fields if f.name != "event_time"])
    kept = [c for c in (keep or stream.columns) if c != "event_time"]
    schema = T.StructType([stream.schema[c] for c in kept] + out_fields + [T.StructField("late", T.BooleanType())])
    seconds = stream.sparkSession.sql(f"SELECT unix_seconds(timestamp_seconds(0) + INTERVAL {delay}) AS s").first()["s"]
    processor = OrderedFoldProcessor(fold, key, plain, kept, [f.name for f in out_fields], None, slot=max(1.0, seconds / SLOTS))
    marked = stream.withWatermark("event_time", delay).select(*plain.names, bucket(key, buckets).alias("_bucket"))
    return marked.groupBy("_bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def bounded_backlog(stream: DataFrame, capacity: int, key: str = "entity_id", buckets: int = BUCKETS) -> DataFrame:
    """Rows of a stream with dropped = true as they fall out of their bucket's newest `capacity`, and with false the rest,
    when the stream ends. The newest rows of all buckets hold the newest of the stream: see `live.settled_backlog`."""
    schema = T.StructType([*stream.schema.fields, T.StructField("dropped", T.BooleanType())])
    dealt = stream.withColumn("_bucket", bucket(key, buckets)).groupBy("_bucket")
    return dealt.transformWithStateInPandas(BacklogProcessor(capacity, stream.schema), schema, "Append", "None")
