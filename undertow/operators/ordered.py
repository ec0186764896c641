"""Order-dependent work without a one-partition window and without a whole key in one task.

Three tools, all exact:

* ``prefix_sums`` / ``row_numbers``: running totals over a global order.
* ``sliced_order``: lag, row number and running sums inside each key. A key's rows are cut into time
  slices; each slice is one window group and a small slice table carries what crosses a border.
* ``carry_scan``: a sequential fold inside each key. Rows are range partitioned by (key, order), so a
  hot key lies on many partitions; the folds of those partitions run in parallel. Affine folds are composed over the
  partitions in one pass; others start from guessed states and are repeated only where a predecessor's end differs.
* ``exact_quantiles`` / ``value_at_rank``: order statistics by narrowing, no sort and no collected column.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.session import cut_lineage

ROWS_PER_SLICE = 2_000_000
NARROW = 8  # keys up to which plain numbers are faster than arrays
FOLD_ROWS = 32_768  # rows folded side by side; more rows hold more keys, so steps are wider


def share_of(n: int, share: float) -> int:
    """Whole part of a share of n, the share taken as it is written: 0.7 of 90,000 is 63,000, where floats give 62,999."""
    return math.floor(Fraction(repr(float(share))) * n)


# --------------------------------------------------------------------------- global order


def range_layout(df: DataFrame, order: list[Column | str], partitions: int | None = None) -> DataFrame:
    """Range partition, sort, number the partitions and fix the result, so every later pass agrees on it.

    Without a count the session's shuffle partitions are used, and adaptive execution merges small ones.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    laid = ranged.sortWithinPartitions(*order)
    return cut_lineage(laid.withColumn("_pid", F.spark_partition_id()))


def prefix_sums(
    df: DataFrame,
    order: list[Column | str],
    sums: dict[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running totals over `order`; columns of `sums` are long or double expressions."""
    return prefix_sums_and_totals(df, order, sums, partitions)[0]


def prefix_sums_and_totals(
    df: DataFrame,
    order: list[Column | str],
    sums: dict[str, Column],
    partitions: int | None = None,
) -> tuple[DataFrame, dict]:
    """prefix_sums, and the grand total of each column, which falls out of the offsets."""
    names = list(sums)
    laid = range_layout(df.withColumns({f"_v_{n}": sums[n] for n in names}), order, partitions)
    totals = laid.groupBy("_pid").agg(*[F.sum(f"_v_{n}").alias(n) for n in names]).collect()
    offsets, running = {}, {n: 0 for n in names}
    for row in sorted(totals, key=lambda r: r["_pid"]):
        offsets[row["_pid"]] = dict(running)
        for n in names:
            running[n] = running[n] + (row[n] or 0)
    keep = [f for f in laid.schema.fields if not f.name.startswith("_v_") and f.name != "_pid"]
    kinds = {n: laid.schema[f"_v_{n}"].dataType for n in names}
    out_schema = T.StructType(
        keep + [T.StructField(n, T.DoubleType() if isinstance(kinds[n], T.DoubleType) else T.LongType()) for n in names]
    )
    keep_names = [f.name for f in keep]
    whole = {n: not isinstance(kinds[n], T.DoubleType) for n in names}

    def add_running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if at is None:
                at = dict(offsets[batch.column("_pid")[0].as_py()])
            cols = [batch.column(n) for n in keep_names]
            for n in names:
                dtype = np.int64 if whole[n] else np.float64
                v = batch.column(f"_v_{n}").fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)
                v[0] += dtype(at[n])
                total = np.cumsum(v)
                at[n] = total[-1]
                cols.append(pa.array(total))
            yield pa.RecordBatch.from_arrays(cols, names=keep_names + names)

    return laid.mapInArrow(add_running, out_schema), running


def row_numbers(df: DataFrame, order: list[Column | str], name: str = "row_num") -> DataFrame:
    """1-based position of every row in the global order."""
    return prefix_sums(df, order, {name: F.lit(1).cast("long")})


# --------------------------------------------------------------------------- order inside keys


def _number(by: str) -> Column:
    """A column as a number for cutting: null orders before, NaN after every number, as in the window."""
    number = F.col(by).cast("double")
    return F.when(number.isNull(), float("-inf")).when(F.isnan(number), float("inf")).otherwise(number)


def _with_slices(df: DataFrame, order: list[str], rows_per_slice: int) -> tuple[DataFrame, int]:
    """Add _slice, where in the order a row falls; slices hold about rows_per_slice rows over all keys.

    Slices are cut on the first column. A value of it that fills several slices is cut further by the second one, if that
    is a number: into parts of equal width between its least and largest value there.
    """
    slices = max(1, math.ceil(df.count() / rows_per_slice))
    whole = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("at", "side", "part")])
    if slices == 1:
        return df.withColumn("_slice", whole), 1
    edges = df.agg(F.percentile_approx(_number(order[0]), [i / slices for i in range(1, slices)], 10 * slices)).first()[0]
    bounds = [float("-inf"), *sorted({e for e in edges if math.isfinite(e)}), float("inf")]
    at = F.lit(0).cast("long")
    work = df.withColumn("_by", _number(order[0]))
    if len(bounds) > 2:
        work = Bucketizer(splits=bounds, inputCol="_by", outputCol="_bucket").transform(work)
        at = F.col("_bucket").cast("long")
    fills = Counter(edges)
    heavy = [v for v, n in fills.items() if n > 1]
    side, part = F.lit(1), F.lit(0).cast("long")
    if heavy and len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.NumericType):
        inner = F.col(order[1]).cast("double")
        found = work.filter(F.col("_by").isin(heavy)).groupBy("_by").agg(F.min(inner).alias("_lo"), F.max(inner).alias("_hi"))
        rows = [(r["_by"], r["_lo"], r["_hi"], 2.0 * fills[r["_by"]]) for r in found.collect() if r["_lo"] is not None and r["_lo"] < r["_hi"]]
        if rows:  # no more rows than slices
            spans = df.sparkSession.createDataFrame(rows, "_heavy double, _lo double, _hi double, _parts double")
            work = work.join(F.broadcast(spans), F.col("_by") == F.col("_heavy"), "left")
            share = F.floor((_number(order[1]) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_parts"))
            part = F.when(F.col("_heavy").isNull(), 0).when(F.col(order[1]).isNull(), -1).when(F.isnan(inner), F.col("_parts") + 1).otherwise(share).cast("long")
            # a value is an edge, so the others of its slice come after it; infinity alone ends one
            side = F.when(F.col("_heavy").isNull(), 1).when(F.col("_by") == float("inf"), 2).otherwise(0)
    cut = work.withColumn("_slice", F.struct(at.alias("at"), side.cast("long").alias("side"), part.alias("part")))
    return cut.drop("_by", "_bucket", "_heavy", "_lo", "_hi", "_parts"), slices


def sliced_order(
    df: DataFrame,
    key: str | list[str],
    order: list[str],
    lags: dict[str, str] | None = None,
    row_number: str | None = None,
    sums: dict[str, Column] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """lag(1), row number and running sums per key, with a hot key spread over its slices.

    `order[0]` must be numeric; the rest breaks ties. `lags` maps output name to input column. Null keys are one key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    lags, sums = lags or {}, sums or {}
    work = df.withColumns({f"_s_{n}": c for n, c in sums.items()}) if sums else df
    work, slices = _with_slices(work, list(order), rows_per_slice)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {out: F.lag(src).over(inside) for out, src in lags.items()}
    if lags or row_number:
        added["_rn"] = F.row_number().over(inside).cast("long")
    for n in sums:
        added[n] = F.sum(f"_s_{n}").over(upto)
    local = work.withColumns(added)

    if slices == 1:
        out = local
        if row_number:
            out = out.withColumn(row_number, F.col("_rn"))
        return out.drop("_slice", "_rn", *[f"_s_{n}" for n in sums])

    last = F.struct(*order)
    table = work.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(F.struct(F.col(src).alias("v")), last).alias(f"_last_{out}") for out, src in lags.items()],
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums],
    )
    # one row per (key, slice)
    across = Window.partitionBy(*keys).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = table.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        *[F.lag(f"_last_{out}").over(across)["v"].alias(f"_prev_{out}") for out in lags],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )
    # keys may be null
    carry = carry.withColumnsRenamed({k: f"_k_{k}" for k in keys}).withColumnRenamed("_slice", "_at")
    same = F.col("_slice") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = local.join(carry, same)
    fixed = {out: F.when(F.col("_rn") == 1, F.col(f"_prev_{out}")).otherwise(F.col(out)) for out in lags}
    if row_number:
        fixed[row_number] = F.col("_rn") + F.col("_base")
    for n in sums:
        fixed[n] = F.col(n) + F.col(f"_off_{n}")
    extra = ["_slice", "_at", *[f"_k_{k}" for k in keys], "_rn", "_base", *[f"_prev_{o}" for o in lags], *[f"_off_{n}" for n in sums], *[f"_s_{n}" for n in sums]]
    return joined.withColumns(fixed).drop(*extra)


# --------------------------------------------------------------------------- folds with carried state


class Fold:
    """A sequential fold over rows of one key. Subclasses stay small and are pure NumPy.

    `width` is the state length. `inputs` turns an Arrow batch into per-row arrays once; `step` advances
    a set of keys by one row each and returns (new states, list of per-row outputs).

    A fold whose end state is an affine map of its start state sets `affine` and says what a run that was read from an
    `opening` state would have ended at, had it begun at another: so one pass and a prefix over partitions suffice.
    """

    width: int
    affine = False
    #: Optional: (state, rows of one key) -> (outputs, end state), row by row and bit for bit as `step` would.
    walk: Callable | None = None

    def start(self, n: int) -> np.ndarray:
        return np.zeros((n, self.width))

    def inputs(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        raise NotImplementedError

    def step(self, state: np.ndarray, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
        raise NotImplementedError

    def outputs(self, arrays: list[np.ndarray]) -> list[pa.Array]:
        raise NotImplementedError

    def run(self, rows: tuple[np.ndarray, ...], starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Per-row outputs, and the end state of each run, of runs that begin at `starts` in the states given."""
        total = int(lengths.sum())
        by_length = np.argsort(-lengths, kind="stable")
        starts_s, lengths_s = starts[by_length], lengths[by_length]
        state = state[by_length]
        outs: list[np.ndarray] | None = None
        active = len(starts_s)
        for t in range(int(lengths_s[0])):
            while active and lengths_s[active - 1] <= t:
                active -= 1
            if active <= NARROW and t and self.walk is not None:
                for i in range(active):
                    stretch = slice(starts_s[i] + t, starts_s[i] + lengths_s[i])
                    produced, state[i] = self.walk(state[i], tuple(r[stretch] for r in rows))
                    for o, p in zip(outs, produced):
                        o[stretch] = p
                break
            at = starts_s[:active] + t
            new, produced = self.step(state[:active], tuple(r[at] for r in rows))
            state[:active] = new
            if outs is None:
                outs = [np.empty((total, *p.shape[1:]), dtype=p.dtype) for p in produced]
            for o, p in zip(outs, produced):
                o[at] = p
        ends = np.empty_like(state)
        ends[by_length] = state
        return outs, ends

    # for affine folds only

    def opening(self, first: tuple[np.ndarray, ...]) -> np.ndarray:
        """State (1 row) to read a run from while its own is unknown; `first` holds the run's first row."""
        raise NotImplementedError

    def gain(self, rows: tuple[np.ndarray, ...]) -> np.ndarray:
        """What `moved` must know of a stretch of rows; gains of stretches add up."""
        raise NotImplementedError

    def moved(self, start: np.ndarray, opened: np.ndarray, gain: np.ndarray, end: np.ndarray) -> np.ndarray:
        """End of a run from `start`, given its end from `opened`."""
        raise NotImplementedError


def _runs(keys: pa.Array) -> np.ndarray:
    """Start offsets of equal-key runs in a sorted key column; nulls are equal."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])


def fold_batch(fold: Fold, batch: pa.RecordBatch, key: str, first: np.ndarray | None, rows: tuple[np.ndarray, ...] | None = None):
    """Fold all runs of a batch side by side; `first` is the state carried into the first run."""
    starts = _runs(batch.column(key))
    state = fold.start(len(starts))
    if first is not None:
        state[0] = first
    lengths = np.diff(np.append(starts, batch.num_rows))
    outs, ends = fold.run(fold.inputs(batch) if rows is None else rows, starts, lengths, state)
    return outs, ends[-1].copy()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Join small Arrow batches into batches of about `rows` rows."""
    waiting, n = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, n = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _fold_partition(fold: Fold, batches, key: str, carried: dict):
    """Yield (batch, outputs, end state, last key) over one partition, streaming."""
    begun, held_key, held = False, None, None
    for batch in _gathered(batches, FOLD_ROWS):
        first_key = batch.column(key)[0].as_py()
        if not begun:
            carry = carried.get(batch.column("_pid")[0].as_py())
            first = np.frombuffer(carry).copy() if carry is not None else None
        else:
            first = held if first_key == held_key else None
        outs, held = fold_batch(fold, batch, key, first)
        begun, held_key = True, batch.column(key)[batch.num_rows - 1].as_py()
        yield batch, outs, held, held_key


def carry_scan(
    df: DataFrame,
    fold: Fold,
    out_fields: list[T.StructField],
    key: str = "entity_id",
    order: tuple[str, ...] = ("ts", "flow_id"),
    keep: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Run `fold` over each key's rows in order and append its outputs to every row. Null keys are one key."""
    laid = range_layout(df, [key, *order], partitions)
    # within a struct, null orders before every key
    least, most = F.min(F.struct(F.col(key).alias("k")))["k"], F.max(F.struct(F.col(key).alias("k")))["k"]
    borders = sorted(laid.groupBy("_pid").agg(least.alias("lo"), most.alias("hi")).collect(), key=lambda r: r["_pid"])
    carried = _border_states(laid, fold, key, borders)
    kept = keep if keep is not None else [c for c in df.columns]
    schema = T.StructType([laid.schema[c] for c in kept] + out_fields)
    names = [f.name for f in out_fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, outs, _, _ in _fold_partition(fold, batches, key, carried):
            cols = [batch.column(c) for c in kept] + fold.outputs(outs)
            yield pa.RecordBatch.from_arrays(cols, names=kept + names)

    return laid.mapInArrow(run, schema)


def _border_states(laid: DataFrame, fold: Fold, key: str, borders: list) -> dict[int, bytes]:
    """State to start each partition's first key with, for keys that began on an earlier partition.

    Only rows of keys that cross a border are folded here; they are few unless keys are hot. One state per partition
    comes to the driver.
    """
    follows = {nxt["_pid"]: cur["_pid"] for cur, nxt in zip(borders, borders[1:]) if cur["hi"] == nxt["lo"]}
    if not follows:
        return {}
    crossing = {b["hi"] for b in borders if b["_pid"] in set(follows.values())}
    inside = F.col(key).isin([k for k in crossing if k is not None])
    if None in crossing:
        inside = F.coalesce(inside, F.lit(False)) | F.col(key).isNull()
    rows = laid.filter(inside)
    single = {b["_pid"] for b in borders if b["lo"] == b["hi"]}
    last_key = {b["_pid"]: b["hi"] for b in borders}
    if fold.affine:
        return _composed_states(rows, fold, key, follows, single, last_key)
    return _settled_states(rows, fold, key, follows, single, last_key)


def _tails(rows: DataFrame, fold: Fold, key: str, last_key: dict, wanted: set[int], known: dict[int, bytes], unknown: set[int]) -> list:
    """(pid, state, opened, gain) of the last run of each wanted partition: its end state from what is known of its start,
    or from an opening state where that is not known."""

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, held_key, held, opened, gain = None, None, None, None, None
        for batch in _gathered(batches, FOLD_ROWS):
            rows = fold.inputs(batch)
            first = held if held is not None and batch.column(key)[0].as_py() == held_key else None
            if pid is None:
                pid = batch.column("_pid")[0].as_py()
                if pid in unknown:
                    first = opened = fold.opening(tuple(r[:1] for r in rows))[0]
                elif pid in known:
                    first = np.frombuffer(known[pid])
            _, held = fold_batch(fold, batch, key, first, rows)
            held_key = batch.column(key)[batch.num_rows - 1].as_py()
            if opened is not None:
                more = fold.gain(rows)
                gain = more if gain is None else gain + more
        if pid in wanted and held_key == last_key[pid]:
            parts = [None if x is None else np.ascontiguousarray(x, float).tobytes() for x in (held, opened, gain)]
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), *[pa.array([p], pa.binary()) for p in parts]], names=["pid", "state", "opened", "gain"])

    return rows.filter(F.col("_pid").isin(sorted(wanted))).mapInArrow(tail, "pid int, state binary, opened binary, gain binary").collect()


def _composed_states(rows: DataFrame, fold: Fold, key: str, follows: dict[int, int], single: set[int], last_key: dict) -> dict[int, bytes]:
    """Two passes, however many partitions a key fills. In the first, a partition whose start is not known is read from an
    opening state; the ends are then moved, partition by partition, on the driver. The second folds those partitions from
    these starts row by row, so that what moving has rounded differently fades as the fold forgets."""
    wanted = set(follows.values())
    unknown = {p for p in wanted if p in single and p in follows}
    ends = {}
    found = {r["pid"]: r for r in _tails(rows, fold, key, last_key, wanted, {}, unknown)}
    carried: dict[int, bytes] = {}
    for pid in sorted(follows):
        before = found[follows[pid]]
        end = bytes(before["state"])
        if before["opened"] is not None:
            end = fold.moved(*(np.frombuffer(x) for x in (carried[before["pid"]], before["opened"], before["gain"], before["state"]))).tobytes()
        carried[pid] = ends[before["pid"]] = end
    if unknown:
        ends |= {r["pid"]: bytes(r["state"]) for r in _tails(rows, fold, key, last_key, unknown, carried, set())}
    return {pid: ends[before] for pid, before in follows.items()}


def _settled_states(rows: DataFrame, fold: Fold, key: str, follows: dict[int, int], single: set[int], last_key: dict) -> dict[int, bytes]:
    """Rounds: only partitions whose start state was wrong are folded again, over rows that were cut out once."""
    rows = cut_lineage(rows)
    carried: dict[int, bytes] = {}
    ends: dict[int, bytes] = {}
    todo = set(follows.values())
    while todo:
        found = _tails(rows, fold, key, last_key, todo, carried, set())
        ends.update({r["pid"]: bytes(r["state"]) for r in found})
        changed = set()
        for pid, before in follows.items():
            if carried.get(pid) != ends[before]:
                carried[pid] = ends[before]
                changed.add(pid)
        # a partition's end depends on its start only where one key fills it
        todo = {p for p in changed if p in single and p in set(follows.values())}
    return carried


# --------------------------------------------------------------------------- order statistics


RANK_LIMIT = 200_000  # distinct values that are ranked in one window


def value_at_rank(df: DataFrame, value: str, ranks: list[int], limit: int = RANK_LIMIT, rows: int | None = None) -> dict[int, float]:
    """Exact order statistics: rank (0-based, ascending) -> value. `rows` is how many values there are, when known.

    Each pass brackets the wanted ranks with a quantile sketch of guaranteed error, counts what lies
    below and inside each bracket and goes on inside it; the last bracket is ranked by its distinct values.
    """
    values = df.select(F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    return _narrow(values, sorted(set(ranks)), values.count() if rows is None else rows, limit)


def _narrow(rows: DataFrame, ranks: list[int], n: int, limit: int, accuracy: int = 10_000) -> dict[int, float]:
    if n <= limit:
        return _rank_distinct(rows, ranks)
    eps = 2.0 / accuracy
    probs = [min(1.0, max(0.0, (r + 1) / n + d)) for r in ranks for d in (-eps, eps)]
    distinct, edges = rows.agg(F.approx_count_distinct("_x"), F.percentile_approx("_x", probs, accuracy)).first()
    if distinct <= limit:
        return _rank_distinct(rows, ranks)
    merged: list[list] = []
    for i, r in enumerate(ranks):
        lo, hi = edges[2 * i], edges[2 * i + 1]
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
            merged[-1][2].append(r)
        else:
            merged.append([lo, hi, [r]])
    x = F.col("_x")
    counts = rows.agg(
        *[F.sum((x < lo).cast("long")) for lo, _, _ in merged],
        *[F.sum(((x >= lo) & (x <= hi)).cast("long")) for lo, hi, _ in merged],
    ).first()
    out: dict[int, float] = {}
    for i, (lo, hi, group) in enumerate(merged):
        under, inside = counts[i], counts[len(merged) + i]
        if lo == hi:
            out.update({r: float(lo) for r in group})
        elif inside == n and len(group) > 1:  # the brackets cover everything: take the ranks in two halves
            half = len(group) // 2
            out.update(_narrow(rows, group[:half], n, limit, accuracy))
            out.update(_narrow(rows, group[half:], n, limit, accuracy))
        else:
            found = _narrow(rows.filter((x >= lo) & (x <= hi)), [r - under for r in group], inside, limit, accuracy)
            out.update({r + under: v for r, v in found.items()})
    return out


def _rank_distinct(rows: DataFrame, ranks: list[int]) -> dict[int, float]:
    """Ranks from counts per distinct value; called for about RANK_LIMIT values at most."""
    by_value = rows.groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.array(*[F.lit(r).cast("long") for r in ranks])
    here = F.filter(wanted, lambda r: (r < F.col("_c")) & (r >= F.col("_c") - F.col("_n")))
    hits = by_value.withColumn("_c", F.sum("_n").over(Window.orderBy("_x"))).withColumn("_r", F.explode(here))
    return {h["_r"]: h["_x"] for h in hits.select("_r", "_x").collect()}


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], limit: int = RANK_LIMIT) -> list[float]:
    """Exact quantiles with linear interpolation between neighbouring ranks."""
    rows = df.select(F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    n = rows.count()
    if n == 0:
        return [float("nan")] * len(probabilities)
    spots = [p * (n - 1) for p in probabilities]
    ranks = sorted({math.floor(s) for s in spots} | {math.ceil(s) for s in spots})
    at = _narrow(rows, ranks, n, limit)
    return [at[math.floor(s)] + (at[math.ceil(s)] - at[math.floor(s)]) * (s - math.floor(s)) for s in spots]
