"""Per-entity state over time: cells as small folds, run by the carry scan in batch and by state in streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.functions import hypervec as H
from undertow.operators import ordered, vectors
from undertow.operators.ordered import Fold

DOUBLES = T.ArrayType(T.DoubleType())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def seeded(name: str, rows: int, cols: int, seed: int, bound: float | None = None) -> np.ndarray:
    """Uniform weights in +-bound (default 1/sqrt(cols)) from hashes."""
    bound = 1.0 / np.sqrt(cols) if bound is None else bound
    return ((2.0 * H.uniforms(name, rows * cols, seed) - 1.0) * bound).reshape(rows, cols)


# --------------------------------------------------------------------------- cells


@dataclass
class CfCCell:
    """Closed-form continuous-time cell: a backbone z of [x, h], two candidates, and a gate over dt."""

    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    heads: np.ndarray
    head_bias: np.ndarray

    @staticmethod
    def seeded(inputs: int, hidden: int = 64, units: int = 128, seed: int = H.SEED) -> "CfCCell":
        back = seeded("cfc:backbone", units, inputs + hidden, seed)
        bound = 1.0 / np.sqrt(units)
        return CfCCell(
            back[:, :inputs].T.copy(),
            back[:, inputs:].T.copy(),
            seeded("cfc:backbone_bias", 1, units, seed, 1.0 / np.sqrt(inputs + hidden))[0],
            seeded("cfc:heads", 4 * hidden, units, seed, bound).T.copy(),
            seeded("cfc:head_bias", 1, 4 * hidden, seed, bound)[0],
        )

    @property
    def hidden(self) -> int:
        return self.wh.shape[0]

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.wx + self.b

    def step(self, projected: np.ndarray, h: np.ndarray, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = 1.7159 * np.tanh(0.666 * (projected + h @ self.wh))
        f1, f2, a, b = np.split(z @ self.heads + self.head_bias, 4, axis=1)
        t = sigmoid(a * dt[:, None] + b)
        return np.tanh(f1) * (1.0 - t) + t * np.tanh(f2), z


@dataclass
class LSTMCell:
    """Gated cell without dt; its state is [h, c]."""

    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray

    @staticmethod
    def seeded(inputs: int, hidden: int = 64, seed: int = H.SEED) -> "LSTMCell":
        bound = 1.0 / np.sqrt(hidden)
        return LSTMCell(
            seeded("lstm:x", inputs, 4 * hidden, seed, bound),
            seeded("lstm:h", hidden, 4 * hidden, seed, bound),
            seeded("lstm:b", 1, 4 * hidden, seed, bound)[0],
        )

    @property
    def hidden(self) -> int:
        return self.wh.shape[0]

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.wx + self.b

    def step(self, projected: np.ndarray, state: np.ndarray) -> np.ndarray:
        h, c = state[:, : self.hidden], state[:, self.hidden :]
        i, f, g, o = np.split(projected + h @ self.wh, 4, axis=1)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        return np.concatenate([sigmoid(o) * np.tanh(c), c], axis=1)


@dataclass
class SSMCell:
    """Diagonal selective state space: h' = exp(delta A) h + delta B x, y = C h + D x."""

    a: np.ndarray
    w_delta: np.ndarray
    b_delta: np.ndarray
    w_b: np.ndarray
    w_c: np.ndarray
    d: np.ndarray

    @staticmethod
    def seeded(inputs: int, states: int = 16, seed: int = H.SEED) -> "SSMCell":
        return SSMCell(
            -np.arange(1, states + 1, dtype=float),
            seeded("ssm:delta", inputs, inputs, seed),
            seeded("ssm:delta_bias", 1, inputs, seed)[0],
            seeded("ssm:b", inputs, states, seed),
            seeded("ssm:c", inputs, states, seed),
            np.ones(inputs),
        )

    def delta(self, x: np.ndarray) -> np.ndarray:
        """Step length of each input, from the row itself."""
        return np.logaddexp(0.0, x @ self.w_delta + self.b_delta)

    def step(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width, size = len(x), x.shape[1], len(self.a)
        h = state.reshape(n, width, size)
        delta = self.delta(x)
        drive = delta[:, :, None] * (x @ self.w_b)[:, None, :] * x[:, :, None]
        h = np.exp(delta[:, :, None] * self.a) * h + drive
        y = (h * (x @ self.w_c)[:, None, :]).sum(-1) + x * self.d
        return h.reshape(n, -1), y


@dataclass
class ConvCell:
    """Causal convolution over the last rows: tanh(window @ kernel + b). Its state is the rows before, zeros at first."""

    kernel: np.ndarray
    b: np.ndarray

    @staticmethod
    def seeded(inputs: int, taps: int = 3, seed: int = H.SEED) -> "ConvCell":
        return ConvCell(seeded("conv:kernel", taps * inputs, inputs, seed, 1.0 / np.sqrt(taps * inputs)), seeded("conv:bias", 1, inputs, seed)[0])

    @property
    def hidden(self) -> int:
        return len(self.b)

    @property
    def taps(self) -> int:
        return len(self.kernel) // len(self.b)

    def step(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        window = np.column_stack([state, x])
        return window[:, self.hidden :], np.tanh(window @ self.kernel + self.b)


@dataclass
class ProjectedCell:
    """A cell over a narrow projection of wide rows, so that its own weights do not grow with their width."""

    wx: np.ndarray
    b: np.ndarray
    inner: SSMCell | ConvCell

    @staticmethod
    def seeded(kind: str, inputs: int, hidden: int = 64, seed: int = H.SEED) -> "ProjectedCell":
        bound = 1.0 / np.sqrt(inputs)
        inner = {"ssm": SSMCell.seeded, "conv": ConvCell.seeded}[kind](hidden, seed=seed)
        return ProjectedCell(seeded(f"{kind}:in", inputs, hidden, seed, bound), seeded(f"{kind}:in_bias", 1, hidden, seed, bound)[0], inner)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.wx + self.b


# --------------------------------------------------------------------------- folds

Reader = Callable[[pa.RecordBatch], np.ndarray]


def columns_reader(cols: list[str], scale: list[float] | None = None) -> Reader:
    factors = np.ones(len(cols)) if scale is None else np.asarray(scale)

    def read(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols]) * factors

    return read


def vector_reader(vec: str) -> Reader:
    return lambda batch: vectors.matrix(batch.column(vec))


class EncodedReader:
    """Encodes inside the scan, so that wide vectors are never shuffled or stored.

    Weights are rounded to multiples of 2 ** -30 once. The inputs are 0 and 1, so in double precision every sum of such
    weights is exact, in any order of addition: a row's result does not depend on the batch it came in.
    """

    BLOCK, GRAIN = 256, float(1 << 30)

    def __init__(self, model, kind: str = "record"):
        self.model, self.kind, self.kernel, self.weights = model.light(), kind, None, None

    def _kernel(self):
        from undertow.operators.encode import Kernel

        self.kernel = self.kernel or Kernel(self.model, self.kind)
        return self.kernel

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        return self._kernel()(batch)

    def project(self, batch: pa.RecordBatch, wx: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """x @ wx + bias for x = 1 - 2 bits."""
        width = self.model.width
        bits = self._kernel().packed(batch)
        if self.weights is None:
            exact = np.round(np.asarray(wx, np.float64) * self.GRAIN) / self.GRAIN
            self.weights = -2.0 * exact, exact.sum(0) + bias
        minus_two_w, base = self.weights
        block = np.zeros((self.BLOCK, width), dtype=np.float64)
        out = np.empty((len(bits), wx.shape[1]))
        for at in range(0, len(bits), self.BLOCK):
            part = bits[at : at + self.BLOCK]
            block[: len(part)] = np.unpackbits(part, axis=1, count=width)
            out[at : at + self.BLOCK] = (block @ minus_two_w)[: len(part)] + base
        return out


def encoder_reader(model, kind: str = "record") -> Reader:
    return EncodedReader(model, kind)


def projected(cell, read: Reader, batch: pa.RecordBatch) -> np.ndarray:
    """The cell's input projection of a whole batch."""
    if isinstance(read, EncodedReader):
        return read.project(batch, cell.wx, cell.b)
    return cell.project(read(batch).astype(np.float64, copy=False))


def _gap(state: np.ndarray, ts: np.ndarray) -> np.ndarray:
    """Seconds since the last row, from the last two state columns (last ts, started)."""
    return np.where(state[:, -1] > 0, np.maximum(ts - state[:, -2], 0.0), 0.0)


class CfCFold(Fold):
    """State: [h, last ts, started]. Outputs h, z and dt."""

    def __init__(self, cell: CfCCell, read: Reader, ts: str = "ts"):
        self.cell, self.read, self.ts = cell, read, ts
        self.width = cell.hidden + 2

    def inputs(self, batch):
        return projected(self.cell, self.read, batch), batch.column(self.ts).to_numpy(zero_copy_only=False)

    def step(self, state, rows):
        projected, ts = rows
        dt = _gap(state, ts)
        h, z = self.cell.step(projected, state[:, :-2], dt)
        return np.column_stack([h, ts, np.ones(len(ts))]), [h, z, dt]

    def outputs(self, arrays):
        return [vectors.list_column(arrays[0]), vectors.list_column(arrays[1]), pa.array(arrays[2])]


class LSTMFold(Fold):
    def __init__(self, cell: LSTMCell, read: Reader):
        self.cell, self.read = cell, read
        self.width = 2 * cell.hidden

    def inputs(self, batch):
        return (projected(self.cell, self.read, batch),)

    def step(self, state, rows):
        new = self.cell.step(rows[0], state)
        return new, [new[:, : self.cell.hidden]]

    def outputs(self, arrays):
        return [vectors.list_column(arrays[0])]


class SSMFold(Fold):
    affine = True

    def __init__(self, cell: SSMCell, read: Reader):
        self.cell, self.read = cell, read
        self.width = len(cell.d) * len(cell.a)

    def inputs(self, batch):
        return (self.read(batch),)

    def step(self, state, rows):
        new, y = self.cell.step(rows[0], state)
        return new, [y]

    def opening(self, first):
        return np.zeros((1, self.width))

    def gain(self, rows):
        return self.cell.delta(rows[0]).sum(0)

    def moved(self, start, opened, gain, end):
        return end + np.exp(gain[:, None] * self.cell.a).reshape(-1) * start

    def outputs(self, arrays):
        return [vectors.list_column(arrays[0])]


class ConvFold(Fold):
    def __init__(self, cell: ConvCell, read: Reader):
        self.cell, self.read = cell, read
        self.width = (cell.taps - 1) * cell.hidden

    def inputs(self, batch):
        return (self.read(batch),)

    def step(self, state, rows):
        new, y = self.cell.step(rows[0], state)
        return new, [y]

    def outputs(self, arrays):
        return [vectors.list_column(arrays[0])]


class DecayFold(Fold):
    """s' = exp(-rate dt) s + x. State: [s, last ts, started]."""

    width, affine = 3, True

    def __init__(self, value: str, rate: float, ts: str = "ts"):
        self.value, self.rate, self.ts = value, rate, ts

    def inputs(self, batch):
        return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (self.value, self.ts))

    def step(self, state, rows):
        x, ts = rows
        s = np.exp(-self.rate * _gap(state, ts)) * state[:, 0] + x
        return np.column_stack([s, ts, np.ones(len(ts))]), [s]

    def walk(self, state, rows):
        x, ts = rows
        kept = np.exp(-self.rate * np.maximum(ts - np.r_[state[1], ts[:-1]], 0.0))
        s, out = float(state[0]), []
        for a, b in zip(kept.tolist(), x.tolist()):
            s = a * s + b
            out.append(s)
        return [np.array(out)], np.array([s, ts[-1], 1.0])

    def opening(self, first):
        return np.array([[0.0, first[1][0], 1.0]])

    def gain(self, rows):
        return np.zeros(1)

    def moved(self, start, opened, gain, end):
        return np.array([end[0] + np.exp(-self.rate * max(end[1] - start[1], 0.0)) * start[0], end[1], 1.0])

    def outputs(self, arrays):
        return [pa.array(arrays[0])]


# --------------------------------------------------------------------------- operators


def state_scan(df: DataFrame, cell, read: Reader, keep: list[str] | None = None, emit=("h", "z", "dt"), **kw) -> DataFrame:
    """Append the state after each row. A CfC cell gives h, z and dt; an LSTM or a projected cell h; others y."""
    if isinstance(cell, CfCCell):
        fields = [T.StructField("h", DOUBLES), T.StructField("z", DOUBLES), T.StructField("dt", T.DoubleType())]
        df = df.drop("dt")
        keep = [c for c in (keep or df.columns) if c != "dt"]
        out = ordered.carry_scan(df, CfCFold(cell, read), fields, keep=keep, **kw)
        return out.drop(*[f.name for f in fields if f.name not in emit])
    if isinstance(cell, ProjectedCell):
        fold = (SSMFold if isinstance(cell.inner, SSMCell) else ConvFold)(cell.inner, lambda batch: projected(cell, read, batch))
        return ordered.carry_scan(df, fold, [T.StructField("h", DOUBLES)], keep=keep, **kw)
    if isinstance(cell, ConvCell):
        return ordered.carry_scan(df, ConvFold(cell, read), [T.StructField("y", DOUBLES)], keep=keep, **kw)
    if isinstance(cell, LSTMCell):
        return ordered.carry_scan(df, LSTMFold(cell, read), [T.StructField("h", DOUBLES)], keep=keep, **kw)
    return ordered.carry_scan(df, SSMFold(cell, read), [T.StructField("y", DOUBLES)], keep=keep, **kw)


def encode_and_scan(df: DataFrame, model, cell: CfCCell, kind: str = "record", keep=("flow_id", "entity_id", "ts", "label"), emit=("h", "dt"), **kw) -> DataFrame:
    """Look up tokens, shuffle ids and numbers once, then encode and fold inside the same task."""
    from undertow.operators.encode import lookup

    looked = lookup(df, model.vocabulary, model.cat_cols)
    needed = [*dict.fromkeys([*keep, *model.cat_cols, *model.num_cols, *[f"{c}_id" for c in model.cat_cols]])]
    kw.setdefault("partitions", encoding_tasks(df))
    return state_scan(looked.select(*needed), cell, encoder_reader(model, kind), keep=list(keep), emit=emit, **kw)


def encoding_tasks(df: DataFrame, rows_per_task: int = 8_192) -> int:
    """Tasks for work that costs far more per row than its bytes suggest: as many as the cluster runs at once, more for
    inputs that would give each of them over 32 times rows_per_task."""
    spark = df.sparkSession
    usual = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.count()
    return max(1, min(usual, rows // rows_per_task), rows // (32 * rows_per_task))


def decay_state(df: DataFrame, value: str, rate: float, out: str = "decayed", **kw) -> DataFrame:
    return ordered.carry_scan(df, DecayFold(value, rate), [T.StructField(out, T.DoubleType())], **kw)


def state_deltas(df: DataFrame, *vecs: str, laid: str | None = None) -> DataFrame:
    """<vec>_delta: change since the entity's previous row (the previous of the first row is zero).

    `laid` names the column that numbers the partitions of a fixed frame whose rows lie as carry_scan leaves them. The
    changes are then taken where the rows lie: nothing is shuffled or stored, and a row per partition comes to the driver.
    """
    if laid is not None:
        schema = T.StructType([*df.schema.fields, *[T.StructField(f"{v}_delta", DOUBLES) for v in vecs]])
        return df.mapInArrow(laid_deltas(df, vecs, laid), schema)
    seen = ordered.sliced_order(df, "entity_id", ["ts", "flow_id"], lags={f"_p_{v}": v for v in vecs})
    return seen.withColumns(
        {
            f"{v}_delta": F.when(F.col(f"_p_{v}").isNull(), F.col(v)).otherwise(
                F.zip_with(v, f"_p_{v}", lambda a, b: a - b)
            )
            for v in vecs
        }
    ).drop(*[f"_p_{v}" for v in vecs])


def laid_deltas(df: DataFrame, vecs: tuple[str, ...], laid: str) -> Callable[[vectors.Batches], vectors.Batches]:
    """What state_deltas runs over the batches of a partition of df, for tasks that go on with them at once.

    The batches need `laid`, entity_id and the vectors; changes are appended.
    """
    ends = df.select(laid, "entity_id", *vecs)

    def last(batches: vectors.Batches) -> vectors.Batches:
        held = None
        for batch in batches:
            held = batch.slice(batch.num_rows - 1) if batch.num_rows else held
        if held is not None:
            yield held

    rows = sorted(ends.mapInArrow(last, ends.schema).collect(), key=lambda r: r[laid])
    before = {b[laid]: (a["entity_id"], [np.array(a[v]) for v in vecs]) for a, b in zip(rows, rows[1:])}

    def run(batches: vectors.Batches) -> vectors.Batches:
        begun, held = False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("entity_id")
            if not begun:
                begun, held = True, before.get(batch.column(laid)[0].as_py())
            opens = ordered._runs(keys)
            if held is not None and held[0] == keys[0].as_py():
                opens = opens[1:]
            out, ends_at = [], []
            for i, v in enumerate(vecs):
                x = vectors.matrix(batch.column(v))
                previous = np.concatenate([np.zeros_like(x[:1]) if held is None else held[1][i][None, :], x[:-1]])
                previous[opens] = 0.0
                out.append(vectors.list_column(x - previous))
                ends_at.append(x[-1].copy())
            held = keys[batch.num_rows - 1].as_py(), ends_at
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *[f"{v}_delta" for v in vecs]])

    return run


def causal_conv(df: DataFrame, cols: list[str], kernel: np.ndarray, bias: np.ndarray, out: str = "conv") -> DataFrame:
    """Convolution over the last k rows of each entity, zeros before its start.

    kernel is [outputs, inputs, k], its last tap on the current row.
    """
    taps = kernel.shape[2]
    work, names = df, [list(cols)]
    for t in range(1, taps):
        lagged = {f"_{c}_{t}": src for c, src in zip(cols, names[-1])}
        work = ordered.sliced_order(work, "entity_id", ["ts", "flow_id"], lags=lagged)
        names.append(list(lagged))
    outputs = []
    for o in range(kernel.shape[0]):
        total = F.lit(float(bias[o]))
        for t in range(taps):
            for i in range(len(cols)):
                x = F.coalesce(F.col(names[t][i]).cast("double"), F.lit(0.0))
                total = total + F.lit(float(kernel[o, i, taps - 1 - t])) * x
        outputs.append(total)
    return work.withColumn(out, F.array(*outputs)).drop(*[n for group in names[1:] for n in group])


# --------------------------------------------------------------------------- readout and prediction


@dataclass
class Readout:
    """Linear map from the state to the next input vector."""

    weights: np.ndarray
    bias: np.ndarray

    def predict(self, h: np.ndarray) -> np.ndarray:
        return h @ self.weights + self.bias


def next_pairs(df: DataFrame, h: str, x: str) -> DataFrame:
    """Each row's x with the state before it; the first row of an entity has none and is left out."""
    seen = ordered.sliced_order(df, "entity_id", ["ts", "flow_id"], lags={"_h_prev": h})
    return seen.filter(F.col("_h_prev").isNotNull()).select("flow_id", "label", F.col("_h_prev").alias("h_prev"), F.col(x).alias("x_next"))


def fit_readout(pairs: DataFrame, positive_weight: float = 1.0, negative_weight: float = 1.0, ridge: float = 1e-3) -> Readout:
    """Weighted least squares of the next vector on the state, from summed normal equations."""

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        h, x = vectors.matrix(batch.column("h_prev")), vectors.matrix(batch.column("x_next"))
        label = batch.column("label").to_numpy(zero_copy_only=False)
        w = np.where(label == 1, positive_weight, negative_weight)[:, None]
        a = np.column_stack([h, np.ones(len(h))])
        return np.concatenate([(a.T @ (w * a)).reshape(-1), (a.T @ (w * x)).reshape(-1)])

    flat = vectors.summed(pairs, ["h_prev", "x_next", "label"], partial)[0]
    width = pairs.select(F.size("h_prev")).first()[0] + 1
    gram, cross = flat[: width * width].reshape(width, width), flat[width * width :].reshape(width, -1)
    penalty = ridge * np.eye(width)
    penalty[-1, -1] = 0.0
    solved = np.linalg.solve(gram + penalty, cross)
    return Readout(solved[:-1], solved[-1])


def predict_next(df: DataFrame, readout: Readout, h: str = "h", out: str = "predicted") -> DataFrame:
    return vectors.map_vectors(df, out, readout.predict, h)


# --------------------------------------------------------------------------- linear auto-encoder


@dataclass
class LinearAE:
    mean: np.ndarray
    basis: np.ndarray

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis @ self.basis.T + self.mean


def fit_linear_ae(normals: DataFrame, vec: str, k: int) -> LinearAE:
    m = vectors.moments(normals, vec)[0]
    values, basis = np.linalg.eigh(m.scatter)
    return LinearAE(m.mean, basis[:, np.argsort(-values)[:k]])


def reconstruct(df: DataFrame, ae: LinearAE, vec: str, out: str = "reconstruction") -> DataFrame:
    return vectors.map_vectors(df, out, ae.reconstruct, vec)


def reconstruction_score(df: DataFrame, ae: LinearAE, vec: str, out: str = "score") -> DataFrame:
    error = vectors.scalar_udf(lambda x: ((ae.reconstruct(x) - x) ** 2).mean(1))
    return df.withColumn(out, error(F.col(vec)))


# --------------------------------------------------------------------------- separation diagnostics


def separation_loss(df: DataFrame, vec: str, margin: float = 4.0, boundary_margin: float = 3.0, batch: int = 1024) -> DataFrame:
    """Per block of `batch` consecutive ids: compactness of normals, hinge of attacks from the normal
    centre, and hinge of attacks from their nearest normal. A block is bounded by construction.
    """
    schema = "block long, row_count long, compactness double, separation double, boundary double"

    def block_loss(key, table):
        x, label = vectors.matrix(table.column(vec).combine_chunks()), table.column("label").to_numpy()
        good, bad = x[label == 0], x[label == 1]
        if len(good) < 2 or len(bad) < 1:
            values = (0.0, 0.0, 0.0)
        else:
            centre = good.mean(0)
            far = np.linalg.norm(bad - centre, axis=1)
            near = np.array([np.sqrt(((good - b) ** 2).sum(1).min()) for b in bad])
            values = (((good - centre) ** 2).mean(), np.maximum(margin - far, 0).mean(), np.maximum(boundary_margin - near, 0).mean())
        row = (key[0].as_py(), len(x), *[float(v) for v in values])
        return pa.table({n: [v] for n, v in zip(("block", "row_count", "compactness", "separation", "boundary"), row)})

    blocks = df.select(F.floor(F.col("flow_id") / batch).cast("long").alias("block"), "label", vec)
    return blocks.groupBy("block").applyInArrow(block_loss, schema)
