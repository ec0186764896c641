"""The model of normal behaviour: one or more centres with precisions, distances to it, and thresholds."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.operators import covariance, ordered, vectors
from undertow.session import cut_lineage

#: Default width above which the distance is cosine to the mean; None for never.
WIDE = 1000
#: Defaults of the trim: largest share, and rows from which on it is done.
MOST_TRIMMED, TRIM_ROWS = 0.20, 50
#: Default rows per cluster that several clusters need.
CLUSTER_ROWS = 20


@dataclass
class Manifold:
    """Centres [K, H] with precisions; kind is full, shared, diagonal or cosine."""

    means: np.ndarray
    precisions: np.ndarray | None
    kind: str = "full"
    shrinkage: list[float] = field(default_factory=list)
    n: int = 0

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (self.kind, k, self.means[k].tolist(), None if self.precisions is None else self._precision(k).reshape(-1).tolist(),
             float(self.shrinkage[k]) if k < len(self.shrinkage) else None, self.n)
            for k in range(len(self.means))
        ]
        return spark.createDataFrame(
            rows, "kind string, cluster int, mean array<double>, precision array<double>, shrinkage double, n long"
        )

    def _precision(self, k: int) -> np.ndarray:
        return self.precisions[0 if self.kind == "shared" else k]

    @staticmethod
    def from_table(table: DataFrame) -> "Manifold":
        rows = table.orderBy("cluster").collect()
        means = np.array([r["mean"] for r in rows])
        width, kind = means.shape[1], rows[0]["kind"]
        if kind == "cosine":
            return Manifold(means, None, kind, n=rows[0]["n"])
        shape = (-1,) if kind == "diagonal" else (width, width)
        precisions = np.array([np.reshape(r["precision"], shape) for r in rows])
        return Manifold(means, precisions[:1] if kind == "shared" else precisions, kind, [r["shrinkage"] for r in rows], rows[0]["n"])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Smallest distance of each row to a centre."""
        if self.kind == "cosine":
            q = self.means[0]
            sim = x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
            return np.clip(1.0 - sim, 0.0, None)
        best = None
        for k, mean in enumerate(self.means):
            d = x - mean
            if self.kind == "diagonal":
                sq = (d**2) @ self.precisions[k]
            else:
                sq = np.einsum("ij,ij->i", d @ self._precision(k), d)
            best = sq if best is None else np.minimum(best, sq)
        return np.sqrt(np.clip(best, 0.0, None))

    def expanded_distances(self, x: np.ndarray) -> np.ndarray:
        """The same distance by x'Px - 2q'x + c, all centres from one product each."""
        best = None
        for k, mean in enumerate(self.means):
            p = self._precision(k)
            q = p @ mean
            sq = np.einsum("ij,ij->i", x @ p, x) - 2.0 * (x @ q) + mean @ q
            best = sq if best is None else np.minimum(best, sq)
        return np.sqrt(np.clip(best, 0.0, None))


def trim_core(df: DataFrame, vec: str, ratio: float = 0.02, clusters: int = 1, centre: tuple[int, np.ndarray] | None = None, min_rows: int = TRIM_ROWS) -> DataFrame:
    """Drop rows far from the mean, beyond the (1 - ratio) percentile of squared distance.

    A ratio outside 0 to MOST_TRIMMED is refused. Under min_rows rows, or where too few would stay for the clusters and
    the width, nothing is dropped and a warning says so. The distances are stored once, as one double per row, before the
    percentile is searched.
    """
    if not 0.0 <= ratio <= MOST_TRIMMED:
        raise ValueError(f"the trim ratio must lie in 0 to {MOST_TRIMMED}, not {ratio}")
    if ratio == 0.0:
        return df
    n, mean = centre or vectors.vector_means(df, vec).get(0, (0, np.zeros(0)))
    if n < min_rows:
        warnings.warn(f"not trimmed: {n} rows are under {min_rows}", stacklevel=2)
        return df
    far = vectors.scalar_udf(lambda x: ((x - mean) ** 2).sum(1))
    squared = far(F.col(vec))
    stored = cut_lineage(df.select(squared.alias("_d2")))
    cut = ordered.exact_quantiles(stored, "_d2", [1.0 - ratio])[0]
    left = stored.filter(F.col("_d2") <= cut).count()
    if left < max(clusters * 10, len(mean)):
        warnings.warn(f"not trimmed: {left} rows would be left for {clusters} clusters of width {len(mean)}", stacklevel=2)
        return df
    return df.withColumn("_d2", squared).filter(F.col("_d2") <= cut).drop("_d2")


def from_moments(m: vectors.Moments, estimator: str = "ledoit_wolf", eps: float = 1e-5) -> Manifold:
    """One full-covariance centre."""
    precision, rho = _precision(m, estimator, eps)
    return Manifold(m.mean[None, :], precision[None, :, :], "full", [rho], m.n)


def fit_manifold(
    df: DataFrame,
    vec: str,
    clusters: int = 1,
    kind: str = "full",
    trim: float = 0.02,
    estimator: str = "ledoit_wolf",
    seed: int = 42,
    eps: float = 1e-5,
    centre: tuple[int, np.ndarray] | None = None,
    wide: int | None = WIDE,
    cluster_rows: int = CLUSTER_ROWS,
) -> Manifold:
    """Fit on the rows given (normals, or attacks with trim=0). `centre` is (rows, mean) when known.

    Vectors wider than `wide` get a cosine model. Several clusters need cluster_rows rows each; with fewer there is one,
    and a warning.
    """
    core = trim_core(df, vec, trim, clusters, centre)
    head = core.select(F.size(vec)).first()
    if head is None:
        raise ValueError("a manifold needs at least one row")
    if wide is not None and head[0] > wide:
        n, mean = vectors.vector_means(core, vec)[0]
        return Manifold(mean[None, :], None, "cosine", n=n)
    pooled = vectors.moments(core, vec)[0]
    n, mean = pooled.n, pooled.mean
    if clusters > 1 and n < clusters * cluster_rows:
        warnings.warn(f"one cluster: {n} rows are too few for {clusters} of {cluster_rows}", stacklevel=2)
    if clusters <= 1 or n < clusters * cluster_rows:
        single = from_moments(pooled, estimator, eps)
        if kind == "diagonal" and clusters > 1:
            return Manifold(single.means, np.diag(single.precisions[0])[None, :], "diagonal", single.shrinkage, n)
        return single
    assigned, centres = assign_clusters(core, vec, clusters, seed)
    pooled_precision, pooled_rho = _precision(pooled, estimator, eps)
    if kind == "shared":
        return Manifold(centres, pooled_precision[None, :, :], "shared", [pooled_rho] * clusters, n)
    by_cluster = vectors.moments(assigned, vec, by="_cluster")
    precisions, rhos = [], []
    for k in range(clusters):
        part = by_cluster.get(k)
        if part is not None and part.n >= len(mean):
            p, rho = _precision(part, estimator, eps)
        else:
            p, rho = pooled_precision, pooled_rho
        precisions.append(np.diag(p) if kind == "diagonal" else p)
        rhos.append(rho)
    return Manifold(centres, np.array(precisions), "diagonal" if kind == "diagonal" else "full", rhos, n)


def _precision(m: vectors.Moments, estimator: str, eps: float) -> tuple[np.ndarray, float]:
    if estimator == "ledoit_wolf":
        cov, rho = covariance.ledoit_wolf(m)
    elif estimator == "oas":
        cov, rho = covariance.oas(m)
    elif estimator == "empirical":
        cov, rho = m.covariance(1, eps), 0.0
    else:
        raise ValueError(f"unknown estimator {estimator!r}")
    return np.linalg.pinv(cov, hermitian=True), rho


def assign_clusters(df: DataFrame, vec: str, clusters: int, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """k-means labels in _cluster and the centres."""
    with_vector = df.withColumn("_features", array_to_vector(F.col(vec)))
    model = KMeans(k=clusters, seed=seed, featuresCol="_features", predictionCol="_cluster", maxIter=50).fit(with_vector)
    return model.transform(with_vector).drop("_features"), np.array(model.clusterCenters())


def distance(model: Manifold, vec: Column | str) -> Column:
    """Distance column; the model is small and travels with the task."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    return vectors.scalar_udf(model.distances)(vec)


def distance_expression(model: Manifold, vec: Column | str) -> Column:
    """The same distance as a Catalyst expression; for narrow vectors only."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    options = []
    for k, mean in enumerate(model.means):
        width = len(mean)
        d = [vec[i].cast("double") - F.lit(float(mean[i])) for i in range(width)]
        p = model._precision(k) if model.kind != "diagonal" else np.diag(model.precisions[k])
        total = F.lit(0.0)
        for i in range(width):
            for j in range(width):
                if p[i, j] != 0.0:
                    total = total + d[i] * F.lit(float(p[i, j])) * d[j]
        options.append(F.sqrt(F.greatest(total, F.lit(0.0))))
    return options[0] if len(options) == 1 else F.least(*options)


def min_distance(df: DataFrame, vec: str, centres: np.ndarray, out: str = "min_distance") -> DataFrame:
    """Euclidean distance to the nearest of a few centres; the centres are part of the expression."""
    nearest = vectors.scalar_udf(
        lambda x: np.sqrt(np.min(np.stack([((x - c) ** 2).sum(1) for c in centres]), axis=0))
    )
    return df.withColumn(out, nearest(F.col(vec)))


def nn_overlap(df: DataFrame, vec: str) -> DataFrame:
    """Share of normals that lie nearer to an attack than to another normal, over all rows."""
    from undertow.operators.nearest import nearest_distance

    good, bad = df.filter(F.col("label") == 0).select("flow_id", vec), df.filter(F.col("label") == 1).select("flow_id", vec)
    near = nearest_distance(nearest_distance(good, vec, good, "_dn"), vec, bad, "_da")
    return near.agg(F.avg((F.col("_da") < F.col("_dn")).cast("double")).alias("nn_overlap"))
