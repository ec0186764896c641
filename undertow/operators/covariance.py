"""Covariance estimators from moments. The matrices are model-sized and solved on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.operators import ordered, vectors
from undertow.operators.vectors import Moments
from undertow.session import cut_lineage


def ledoit_wolf(m: Moments) -> tuple[np.ndarray, float]:
    """(covariance, shrinkage) of Ledoit and Wolf (2004) from sums only."""
    n, p = m.n, len(m.mean)
    s = m.scatter / n
    mu = np.trace(s) / p
    delta = ((s**2).sum() - p * mu**2) / p
    beta = (m.quartic / n - (s**2).sum()) / (p * n)
    rho = 0.0 if delta <= 0 else float(min(max(beta, 0.0), delta) / delta)
    return (1 - rho) * s + rho * mu * np.eye(p), rho


def oas(m: Moments) -> tuple[np.ndarray, float]:
    """(covariance, shrinkage) of Chen et al. (2010)."""
    n, p = m.n, len(m.mean)
    s = m.scatter / n
    mu = np.trace(s) / p
    alpha = (s**2).mean()
    denominator = (n + 1) * (alpha - mu**2 / p)
    rho = 1.0 if denominator <= 0 else float(min((alpha + mu**2) / denominator, 1.0))
    return (1 - rho) * s + rho * mu * np.eye(p), rho


def whitened_ledoit_wolf(m: Moments, quartic_of_scaled: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(scale, covariance of the standardised data, shrinkage)."""
    scale = np.sqrt(np.diag(m.scatter) / m.n)
    scale = np.where(scale == 0, 1.0, scale)
    scaled = Moments(m.n, np.zeros_like(m.mean), m.scatter / np.outer(scale, scale), quartic_of_scaled)
    cov, rho = ledoit_wolf(scaled)
    return scale, cov, rho


def fit_whitened(df: DataFrame, vec: str) -> tuple[Moments, np.ndarray, np.ndarray, float]:
    """Standardise by the population deviation, then shrink; one more pass for the fourth moment."""
    m = vectors.moments(df, vec)[0]
    scale = np.sqrt(np.diag(m.scatter) / m.n)
    scale = np.where(scale == 0, 1.0, scale)
    mean = m.mean

    def quartic(batch):
        z = (vectors.matrix(batch.column(vec)) - mean) / scale
        return np.array([(np.einsum("ij,ij->i", z, z) ** 2).sum()])

    q = float(vectors.summed(df, [vec], quartic)[0][0])
    scale, cov, rho = whitened_ledoit_wolf(m, q)
    return m, scale, cov, rho


def minimum_covariance_determinant(
    df: DataFrame, vec: str, support: float = 0.8, steps: int = 30, starts: int = 2, seed: int = 42
) -> tuple[Moments, list[float]]:
    """Robust moments: the best of several starts of concentration steps, with its log-determinants.

    A step keeps the share of rows nearest to the current centre and refits, while the determinant falls.
    The first start is all rows, the others are fifths picked by hash; they only choose where to begin, the
    steps always rank every row. All starts step side by side: a step reads the vectors twice, once for the distances
    to every start's centre and once for the moments of what is near, and the vectors are fixed once.
    """
    df = cut_lineage(df.select(vec))
    whole = vectors.moments(df, vec)[0]
    keep = int(np.ceil(support * whole.n))
    begin = [whole]
    for start in range(1, starts):
        fifth = df.filter(F.pmod(F.xxhash64(F.col(vec), F.lit(seed + start)), F.lit(5)) == 0)
        begin.append(vectors.moments(fifth, vec).get(0, whole))
    found = _concentrate(df, vec, begin, keep, whole.n, steps)
    squared, cut, dets = min(found, key=lambda f: f[2][-1])
    near = df.withColumn("_d2", vectors.scalar_udf(squared)(F.col(vec))).filter(F.col("_d2") <= cut)
    return vectors.moments(near, vec)[0], dets


def _squared(m: Moments) -> Callable[[np.ndarray], np.ndarray]:
    precision, mean = np.linalg.pinv(m.covariance(0, 1e-9)), m.mean
    return lambda x: np.einsum("ij,ij->i", (x - mean) @ precision, x - mean)


def _concentrate(df: DataFrame, vec: str, begin: list[Moments], keep: int, rows: int, steps: int) -> list[tuple[Callable, float, list[float]]]:
    """(distance, cut, log-determinants) of each start's last step."""
    found: list = [(None, 0.0, [])] * len(begin)
    models = dict(enumerate(begin))
    for _ in range(steps):
        squared = {k: _squared(m) for k, m in models.items()}
        stored = cut_lineage(df.select(*[vectors.scalar_udf(f)(F.col(vec)).alias(f"_d{k}") for k, f in squared.items()]))
        cuts = {k: ordered.value_at_rank(stored, f"_d{k}", [keep - 1], rows=rows)[keep - 1] for k in models}
        for k, nxt in _near_moments(df, vec, {k: (squared[k], cuts[k], models[k].mean) for k in models}).items():
            dets = found[k][2]
            _, logdet = np.linalg.slogdet(nxt.covariance(0, 1e-9))
            if dets and logdet >= dets[-1] - 1e-9:
                del models[k]
                continue
            models[k] = nxt
            found[k] = squared[k], cuts[k], [*dets, float(logdet)]
        if not models:
            break
    return found


def _near_moments(df: DataFrame, vec: str, near: dict[int, tuple[Callable, float, np.ndarray]]) -> dict[int, Moments]:
    """Rows, mean and scatter of what lies within each cut, in one pass: sums about the centre given, moved to the mean."""

    def partial(batch) -> np.ndarray:
        x = vectors.matrix(batch.column(vec))
        parts = []
        for squared, cut, centre in near.values():
            part = x[squared(x) <= cut] - centre
            parts += [[len(part)], part.sum(0), (part.T @ part).reshape(-1)]
        return np.concatenate(parts)

    out = {}
    flat = vectors.summed(df, [vec], partial)[0].reshape(len(near), -1)
    for (k, (_, _, centre)), s in zip(near.items(), flat):
        n, p = int(s[0]), len(centre)
        shift = s[1 : p + 1] / n
        out[k] = Moments(n, centre + shift, s[p + 1 :].reshape(p, p) - n * np.outer(shift, shift), float("nan"))
    return out


def effective_rank(m: Moments) -> float:
    """exp of the entropy of the normalised singular values."""
    values = np.sqrt(np.clip(np.linalg.eigvalsh(m.scatter), 0.0, None))
    share = values / (values.sum() + 1e-9)
    share = share[share > 1e-12]
    return float(np.exp(-(share * np.log(share)).sum()))
