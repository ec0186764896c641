"""Logistic regressions fitted side by side: a step reads the rows once for all of them and stores none.

The fit is the one of Spark's StandardScaler (not centred) and LogisticRegression behind it: an L2 penalty on the scaled
weights, L-BFGS with a strong Wolfe search, and the same tests of convergence. Spark keeps a scaled copy of the rows for
each fit, in memory and then on disk; here only sums as long as the features are wide leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from undertow.operators import vectors

#: Changes that L-BFGS remembers; values over which it must stop falling; trials of a search along one direction.
MEMORY, FALLING, TRIALS = 10, 20, 10


@dataclass
class Regression:
    """Weights in the units of the features."""

    weights: np.ndarray
    intercept: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of the label 1. Added up row by row alike, so equal rows have equal scores wherever they lie."""
        with np.errstate(over="ignore"):
            return 1.0 - 1.0 / (1.0 + np.exp(np.einsum("ij,j->i", x, self.weights) + self.intercept))


class _Failed(Exception):
    """The search along a direction found no step."""


#: What a minimisation asks (a point) and is told (value and gradient there), and how it ends.
Asking = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def _between(a: tuple, b: tuple) -> float:
    """Minimum of the cubic through two steps (step, value, slope), off their ends."""
    (ta, fa, da), (tb, fb, db) = a, b
    d1 = da + db - 3 * (fa - fb) / (ta - tb)
    d2 = np.sqrt(d1 * d1 - da * db)
    t = tb - (tb - ta) * (db + d2 - d1) / (db - da + 2 * d2)
    low, high = ta + 0.1 * (tb - ta), ta + 0.9 * (tb - ta)
    return low if t < low else high if t > high else t


def _searched(x: np.ndarray, value: float, grad: np.ndarray, way: np.ndarray, t: float):
    """(point, value, gradient) of a step along `way` that meets the strong Wolfe conditions."""
    slope = float(grad @ way)
    if slope > 0:
        raise _Failed("not a way down")
    low, high = (0.0, value, slope), None
    for trial in range(TRIALS):
        at = x + t * way
        f, g = yield at
        if not np.isfinite(f):
            t /= 2.0
            continue
        c = (t, f, float(g @ way))
        if f > value + 1e-4 * t * slope or (f >= low[1] and trial > 0):
            high = c
            break
        if abs(c[2]) <= 0.9 * abs(slope):
            return at, f, g
        if c[2] >= 0:
            low, high = c, low
            break
        low, t = c, t * 1.5
    if high is None:
        raise _Failed("no step")
    for _ in range(TRIALS):
        t = _between(high, low) if low[0] > high[0] else _between(low, high)
        at = x + t * way
        f, g = yield at
        c = (t, f, float(g @ way))
        if f > value + 1e-4 * t * slope or f >= low[1]:
            high = c
            continue
        if abs(c[2]) <= 0.9 * abs(slope):
            return at, f, g
        if c[2] * (high[0] - low[0]) >= 0:
            high = low
        low = c
    raise _Failed("no step between")


def _direction(grad: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Minus the gradient times the inverse Hessian that the steps and changes of the gradient, newest first, stand for."""
    way, scale = grad.copy(), 1.0
    if steps:
        scale = (steps[0] @ changes[0]) / (changes[0] @ changes[0])
        if not scale >= 0:
            raise _Failed("bent the wrong way")
    rho = [s @ c for s, c in zip(steps, changes)]
    shares = []
    for s, c, p in zip(steps, changes, rho):
        shares.append((s @ way) / p)
        way -= shares[-1] * c
    way *= scale
    for s, c, p, a in reversed([*zip(steps, changes, rho, shares)]):
        way += (a - (c @ way) / p) * s
    return -way


def minimised(x: np.ndarray, most: int, tolerance: float) -> Asking:
    """L-BFGS as a generator: it asks for value and gradient at points, so that several can be answered by one pass."""
    value, grad = yield x
    first, done, failed = value, 0, False
    seen, steps, changes = [np.inf], [], []
    while done < most:
        if len(seen) > 1 and abs(value - max(seen)) <= tolerance * first or np.linalg.norm(grad) <= max(tolerance * value, 1e-8):
            break
        try:
            way = _direction(grad, steps, changes)
            length = 1.0 if done else 1.0 / np.linalg.norm(way)
            at, new, slope = yield from _searched(x, value, grad, way, length)
            if np.linalg.norm(at - x) / np.linalg.norm(way) * np.linalg.norm(grad) < 1e-10:
                raise _Failed("a step too small")
        except _Failed:
            if failed:
                break
            failed, steps, changes = True, [], []
            continue
        steps, changes = [at - x, *steps][:MEMORY], [slope - grad, *changes][:MEMORY]
        x, value, grad, done, failed = at, new, slope, done + 1, False
        seen = [*seen, value][-FALLING:]
    return x


@dataclass
class Source:
    """Rows to fit on or to score: columns of a frame, and what a task makes of their batches before it reads them."""

    rows: DataFrame
    columns: list[str]
    made: Callable[[vectors.Batches], vectors.Batches] = iter

    def summed(self, partial: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
        return vectors.summed(self.rows, self.columns, partial, made=self.made).get(0)

    def mapped(self, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
        made = self.made
        return self.rows.select(*self.columns).mapInArrow(lambda batches: (fn(b) for b in made(batches) if b.num_rows), schema)


def _read(features: dict[str, tuple[str, ...]]) -> list[str]:
    return [*dict.fromkeys(c for parts in features.values() for c in parts)]


def fit(source: Source, features: dict[str, tuple[str, ...]], label: str = "label", most: int = 500, tolerance: float = 1e-6) -> dict[str, Regression]:
    """A regression for each name, on its array columns put end to end, with a penalty of 1 / rows.

    Labels must be 0 or 1, and numbers finite. With one label only, all scores are that label.
    """
    columns = _read(features)
    head = source.mapped(lambda batch: batch.slice(0, 1).select(columns), T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in columns])).first()
    if head is None:
        raise ValueError("a regression needs at least one row")
    ends = np.cumsum([0, *[len(head[c]) for c in columns]])
    spans = {c: np.arange(a, b) for c, a, b in zip(columns, ends, ends[1:])}
    places = {name: np.concatenate([spans[c] for c in parts]) for name, parts in features.items()}

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = batch.column(label).cast(pa.float64()).to_numpy(zero_copy_only=False)
        if not np.isin(y, (0, 1)).all():
            raise ValueError("labels must be 0 or 1")
        return np.concatenate([vectors.matrix(batch.column(c)) for c in columns], axis=1), y

    # from a row's own values, so that a column that never changes has no spread at all
    near = np.concatenate([np.asarray(head[c], np.float64) for c in columns])

    def about(batch: pa.RecordBatch) -> np.ndarray:
        x, y = read(batch)
        return np.concatenate([[len(y), y.sum()], (x - near).sum(0)])

    sums = source.summed(about)
    if not np.isfinite(sums).all():
        raise ValueError("features must be finite")
    n, ones = sums[:2]
    mean = near + sums[2:] / n
    if ones in (0, n):
        return {name: Regression(np.zeros(len(at)), np.inf if ones else -np.inf) for name, at in places.items()}
    squares = source.summed(lambda batch: ((read(batch)[0] - mean) ** 2).sum(0))
    spread = np.sqrt(squares / (n - 1))
    inverse = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)

    def answers(asked: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray]]:
        names = list(asked)
        weights, offsets = np.zeros((len(mean), len(names))), np.array([asked[name][-1] for name in names])
        for k, name in enumerate(names):
            weights[places[name], k] = asked[name][:-1] * inverse[places[name]]

        def partial(batch: pa.RecordBatch) -> np.ndarray:
            x, y = read(batch)
            x = x - mean
            margin = x @ weights + offsets
            off = 0.5 * (1.0 + np.tanh(0.5 * margin)) - y[:, None]
            loss = np.logaddexp(0.0, margin) - y[:, None] * margin
            return np.concatenate([loss.sum(0), off.sum(0), (x.T @ off).T.reshape(-1)])

        total = source.summed(partial) / n
        loss, off, slopes = total[: len(names)], total[len(names) : 2 * len(names)], total[2 * len(names) :].reshape(len(names), -1)
        out = {}
        for k, name in enumerate(names):
            u, at = asked[name][:-1], places[name]
            out[name] = (loss[k] + 0.5 * (u @ u) / n, np.append(slopes[k, at] * inverse[at] + u / n, off[k]))
        return out

    start = np.log(ones / (n - ones))
    fits = {name: minimised(np.append(np.zeros(len(at)), start), most, tolerance) for name, at in places.items()}
    asked, found = {name: next(fitting) for name, fitting in fits.items()}, {}
    while asked:
        told, asked = answers(asked), {}
        for name, answer in told.items():
            try:
                asked[name] = fits[name].send(answer)
            except StopIteration as end:
                weights = end.value[:-1] * inverse[places[name]]
                found[name] = Regression(weights, float(end.value[-1] - weights @ mean[places[name]]))
    return found


def scores(source: Source, features: dict[str, tuple[str, ...]], fitted: dict[str, Regression], keep: list[str]) -> DataFrame:
    """`keep`, and a column of each name with its probability of the label 1."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = {c: vectors.matrix(batch.column(c)) for c in _read(features)}
        found = [pa.array(fitted[name].probability(np.concatenate([of[c] for c in parts], axis=1))) for name, parts in features.items()]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *found], names=[*keep, *features])

    kept = [source.rows.schema[c] for c in keep]
    return source.mapped(run, T.StructType([*kept, *[T.StructField(name, T.DoubleType()) for name in features]]))
