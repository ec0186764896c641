"""Adaptive per-entity thresholds from exponentially weighted mean and variance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.operators import ordered
from undertow.operators.ordered import Fold

FIELDS = [
    T.StructField("ewma_mean", T.DoubleType()),
    T.StructField("ewma_var", T.DoubleType()),
    T.StructField("ewma_threshold", T.DoubleType()),
    T.StructField("is_anomaly", T.BooleanType()),
]


class EwmaFold(Fold):
    """State: [mean, variance, rows seen up to warm-up + 2].

    The mean is an affine map of the mean before. The variance is one of the variance before; where the mean began
    elsewhere it differs by the spread between the old rows and the new ones, as in pooling two groups.
    """

    width, affine = 3, True

    def __init__(self, value: str, alpha: float, k: float, warmup: int, initial: float):
        self.value, self.alpha, self.k, self.warmup, self.initial = value, alpha, k, warmup, initial

    def inputs(self, batch):
        return (batch.column(self.value).to_numpy(zero_copy_only=False).astype(float),)

    def step(self, state, rows):
        d = rows[0]
        mean, var, count = state[:, 0], state[:, 1], state[:, 2]
        first = count == 0
        diff = d - mean
        new_mean = np.where(first, d, mean + self.alpha * diff)
        new_var = np.where(first, 0.0, (1 - self.alpha) * (var + self.alpha * (diff * diff)))
        new_count = np.minimum(count + 1, self.warmup + 2)
        threshold = np.where(first, self.initial, new_mean + self.k * np.sqrt(new_var))
        early = (d > self.initial) if (self.warmup == 0 and self.initial < 1.0) else np.zeros(len(d), dtype=bool)
        hit = np.where(first, early, (d > threshold) & (new_count > self.warmup))
        return np.column_stack([new_mean, new_var, new_count]), [new_mean, new_var, threshold, hit]

    def walk(self, state, rows):
        """A key that has begun: the same sums on plain numbers."""
        alpha, rest = self.alpha, 1 - self.alpha
        mean, var = float(state[0]), float(state[1])
        means, variances = [], []
        for d in rows[0].tolist():
            diff = d - mean
            mean = mean + alpha * diff
            var = rest * (var + alpha * (diff * diff))
            means.append(mean)
            variances.append(var)
        means, variances = np.array(means), np.array(variances)
        count = np.minimum(state[2] + 1 + np.arange(len(means)), self.warmup + 2)
        threshold = means + self.k * np.sqrt(variances)
        hit = (rows[0] > threshold) & (count > self.warmup)
        return [means, variances, threshold, hit], np.array([mean, var, count[-1]])

    def opening(self, first):
        return np.array([[first[0][0], 0.0, self.warmup + 2.0]])

    def gain(self, rows):
        return np.array([float(len(rows[0]))])

    def moved(self, start, opened, gain, end):
        left = (1.0 - self.alpha) ** gain[0]
        off = start[0] - opened[0]
        spread = left * off * ((1.0 - left) * (start[0] + opened[0]) - 2.0 * (end[0] - left * opened[0]))
        return np.array([end[0] + left * off, max(left * start[1] + end[1] + spread, 0.0), min(start[2] + gain[0], self.warmup + 2.0)])

    def outputs(self, arrays):
        return [pa.array(a) for a in arrays]


def ewma_drift(
    df: DataFrame,
    value: str,
    alpha: float = 0.05,
    k: float = 3.0,
    warmup: int = 0,
    initial: float = 1.0,
    key: str = "entity_id",
    partitions: int | None = None,
) -> DataFrame:
    """Append mean, variance, threshold and strict verdict after each row of each entity.

    The first row sets the mean and uses the initial threshold; verdicts are held back during warm-up.
    """
    return ordered.carry_scan(df, EwmaFold(value, alpha, k, warmup, initial), FIELDS, key=key, partitions=partitions)


def initial_threshold(df: DataFrame, value: str) -> DataFrame:
    """Mean plus one population deviation of the normals' values."""
    return df.filter(F.col("label") == 0).agg((F.avg(value) + F.stddev_pop(value)).alias("initial_threshold"))


def fit_k(df: DataFrame, value: str, alpha: float = 0.05, warmup: int = 0, initial: float = 1.0, label: str = "label") -> DataFrame:
    """Best F1 over k = 0.1 .. 4.0 in 40 steps, the first winning.

    A row's verdict can only switch off as k grows, so rows are counted once under the number of k that
    still flag them; the first row of an entity does not depend on k.
    """
    tracked = ewma_drift(df.withColumn("_label", F.col(label)), value, alpha, 1.0, warmup, initial)
    ks = [float(x) for x in np.linspace(0.1, 4.0, 40)]
    numbered = ordered.sliced_order(tracked, "entity_id", ["ts", "flow_id"], row_number="_seen")
    flagged = F.lit(0)
    for k in ks:
        flagged = flagged + (F.col(value) > F.col("ewma_mean") + F.lit(k) * F.sqrt("ewma_var")).cast("int")
    late = F.when(F.col("_seen") <= max(warmup, 1), F.lit(0)).otherwise(flagged)
    always = F.when((F.col("_seen") == 1) & F.col("is_anomaly"), F.lit(len(ks))).otherwise(late)
    counts = numbered.groupBy(always.alias("flags")).agg(
        F.sum((F.col("_label") == 1).cast("long")).alias("pos"), F.sum((F.col("_label") == 0).cast("long")).alias("neg")
    ).collect()
    total = sum(r["pos"] for r in counts)
    best = (-1.0, 1.0)
    if total:
        for i, k in enumerate(ks):
            tp = sum(r["pos"] for r in counts if r["flags"] > i)
            fp = sum(r["neg"] for r in counts if r["flags"] > i)
            f1 = 2 * tp / (2 * tp + fp + (total - tp)) if tp else 0.0
            if f1 > best[0]:
                best = (f1, k)
    return df.sparkSession.createDataFrame([(best[1], max(best[0], 0.0))], "k double, f1 double")
