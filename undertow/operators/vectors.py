"""Moments of vector columns: Arrow partial sums per task, added up by Spark.

Groups (classes, clusters) are few; what reaches the driver is the size of a model, never of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix; null lists are refused, for flattening skips them."""
    if column.null_count:
        raise ValueError("null vectors cannot be stacked; filter or fill them first")
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def list_column(values: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column."""
    n, width = values.shape
    offsets = np.arange(0, n * width + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


Batches = Iterator[pa.RecordBatch]


def summed(
    df: DataFrame, columns: list[str], partial: Callable[[pa.RecordBatch], dict[int, np.ndarray]], by: str | None = None, made: Callable[[Batches], Batches] = iter
) -> dict[int, np.ndarray]:
    """Add up per-batch partial vectors by group over the whole frame.

    Each task emits one vector per group; Spark sums them position by position with map-side combining. `made` makes the
    batches that are added up from a partition's own, inside the same task.
    """
    rows = df.select(*columns, (F.col(by).cast("int") if by else F.lit(0)).alias("_g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in made(batches):
            if batch.num_rows == 0:
                continue
            groups = batch.column("_g").to_numpy(zero_copy_only=False)
            for g in np.unique(groups):
                part = batch if by is None else batch.filter(pa.array(groups == g))
                vector = partial(part)
                held[int(g)] = vector if int(g) not in held else held[int(g)] + vector
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))],
                names=["g", "v"],
            )

    parts = rows.mapInArrow(run, "g int, v array<double>")
    totals = parts.select("g", F.posexplode("v")).groupBy("g", "pos").agg(F.sum("col").alias("s")).collect()
    out: dict[int, dict[int, float]] = {}
    for row in totals:
        out.setdefault(row["g"], {})[row["pos"]] = row["s"]
    return {g: np.array([d[i] for i in range(len(d))]) for g, d in out.items()}


def vector_means(df: DataFrame, vec: str, by: str | None = None) -> dict[int, tuple[int, np.ndarray]]:
    """group -> (rows, mean vector)."""
    sums = summed(df, [vec], lambda b: np.concatenate([[b.num_rows], matrix(b.column(vec)).sum(0)]), by)
    return {g: (int(s[0]), s[1:] / s[0]) for g, s in sums.items()}


def vector_mean(df: DataFrame, vec: str) -> np.ndarray:
    return vector_means(df, vec)[0][1]


@dataclass
class Moments:
    """Rows, mean, centred scatter matrix and sum of fourth powers of the centred norms."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    quartic: float

    def covariance(self, ddof: int = 1, eps: float = 0.0) -> np.ndarray:
        return self.scatter / (self.n - ddof) + eps * np.eye(len(self.mean))


def moments(df: DataFrame, vec: str, by: str | None = None) -> dict[int, Moments]:
    """group -> Moments; a mean pass, then a centred pass, so large means lose no digits."""
    means = vector_means(df, vec, by)
    if not means:
        return {}
    centre = {g: m for g, (_, m) in means.items()}

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        g = int(batch.column("_g")[0].as_py())
        x = matrix(batch.column(vec)) - centre[g]
        norms = np.einsum("ij,ij->i", x, x)
        return np.concatenate([[(norms**2).sum()], (x.T @ x).reshape(-1)])

    sums = summed(df, [vec], partial, by)
    return {
        g: Moments(means[g][0], centre[g], s[1:].reshape(len(centre[g]), -1), float(s[0])) for g, s in sums.items()
    }


def dim_moments(df: DataFrame, vec: str, by: str | None = None) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """group -> (rows, mean, centred sum of squares per dimension), without the full scatter matrix."""
    means = vector_means(df, vec, by)
    centre = {g: m for g, (_, m) in means.items()}

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(vec)) - centre[int(batch.column("_g")[0].as_py())]
        return (x**2).sum(0)

    sums = summed(df, [vec], partial, by)
    return {g: (means[g][0], centre[g], s) for g, s in sums.items()}


def map_vectors(df: DataFrame, out: str, fn: Callable[[np.ndarray], np.ndarray], vec: str) -> DataFrame:
    """Append a vector column computed from another, one Arrow batch at a time."""
    compute = F.arrow_udf(lambda col: list_column(np.asarray(fn(matrix(col)), dtype=np.float64)), "array<double>")
    return df.withColumn(out, compute(F.col(vec)))


def scalar_udf(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A column function from vectors to one double each."""
    return F.arrow_udf(lambda col: pa.array(np.asarray(fn(matrix(col)), dtype=np.float64)), "double")


def sparse_parts(features: Column | str) -> Column:
    """An ML vector as struct<indices, values>, however many zeros it leaves out; a dense one has all indices."""
    features = F.col(features) if isinstance(features, str) else features
    read = F.from_json(F.to_json(F.struct(features.alias("v"))), "v struct<indices:array<int>,values:array<double>>")["v"]
    # a dense vector is written without indices
    places = F.when(F.size(read["values"]) > 0, F.sequence(F.lit(0), F.size(read["values"]) - 1)).otherwise(F.array().cast("array<int>"))
    return F.struct(F.coalesce(read["indices"], places).alias("indices"), read["values"].alias("values"))
