"""Scores from state vectors: likelihood ratio, discriminants, fitted heads, and one dispatch for all."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.functions import scalars as S
from undertow.operators import evaluate, ordered, vectors
from undertow.operators.manifold import WIDE, Manifold, fit_manifold, from_moments
from undertow.operators.recurrent import sigmoid
from undertow.session import cut_lineage

#: Rows of a class from which on an attack model or a discriminant is fitted, unless the caller names another number.
MIN_CLASS_ROWS = 10


# --------------------------------------------------------------------------- likelihood ratio and discriminant


def lr_score(normal: Column | str, attack: Column | str, eps: float = 0.5) -> Column:
    normal = F.col(normal) if isinstance(normal, str) else normal
    attack = F.col(attack) if isinstance(attack, str) else attack
    return normal / (attack + F.lit(eps))


@dataclass
class Fisher:
    """Unit direction between the classes, with median and spread of the normals along it."""

    direction: np.ndarray
    shift: float
    scale: float


def fisher_direction(by: dict[int, vectors.Moments], eps: float = 1e-4, min_rows: int = MIN_CLASS_ROWS) -> np.ndarray | None:
    """(half the summed class covariances + eps I)^-1 (attack mean - normal mean), unit length.

    None, with a warning, where a class has under min_rows rows (two at least are needed for a covariance).
    """
    short = {c: by[c].n if c in by else 0 for c in (0, 1) if c not in by or by[c].n < max(2, min_rows)}
    if short:
        warnings.warn(f"no discriminant: class rows {short} are under {max(2, min_rows)}", stacklevel=2)
        return None
    pooled = 0.5 * (by[0].covariance(1) + by[1].covariance(1)) + eps * np.eye(len(by[0].mean))
    w = np.linalg.solve(pooled, by[1].mean - by[0].mean)
    return w / np.linalg.norm(w)


def fit_fisher(df: DataFrame, vec: str, label: str = "label", by: dict[int, vectors.Moments] | None = None, min_rows: int = MIN_CLASS_ROWS) -> Fisher | None:
    w = fisher_direction(by or vectors.moments(df, vec, by=label), min_rows=min_rows)
    if w is None:
        return None
    normal = cut_lineage(df.filter(F.col(label) == 0).select(projection(w, vec).alias("_p")))
    q1, median, q3 = ordered.exact_quantiles(normal, "_p", [0.25, 0.5, 0.75])
    spread = q3 - q1
    if spread <= 1e-4:
        spread = float(normal.agg(F.stddev_samp("_p")).first()[0] or 0.0) + 1e-4
    return Fisher(w, median, spread)


def projection(direction: np.ndarray, vec: Column | str) -> Column:
    vec = F.col(vec) if isinstance(vec, str) else vec
    return vectors.scalar_udf(lambda x: x @ direction)(vec)


def lr_boost(lr: Column | str, proj: Column | str, fisher: Fisher) -> Column:
    """lr * (1 + 0.5 sigmoid of the standardised projection)."""
    lr = F.col(lr) if isinstance(lr, str) else lr
    proj = F.col(proj) if isinstance(proj, str) else proj
    z = (proj - F.lit(fisher.shift)) / F.lit(fisher.scale)
    return lr * (F.lit(1.0) + 0.5 * S.sigmoid(z))


# --------------------------------------------------------------------------- gates and blends


def gate(lr: Column | str, other: Column | str, centre: float, margin: float) -> Column:
    """Outside the margin around the gate the ratio itself is the score."""
    lr = F.col(lr) if isinstance(lr, str) else lr
    other = F.col(other) if isinstance(other, str) else other
    away = F.abs(lr - F.lit(centre)) / F.lit(max(centre, 1e-4)) >= F.lit(margin)
    return F.when(away, lr).otherwise(other)


def fit_gate(df: DataFrame, lr: str = "lr", label: str = "label", candidates: int = 80) -> DataFrame:
    """Best F1 over evenly spaced percentiles (10..90) of the ratio, verdict lr >= candidate.

    Each row counts once under the number of candidates it reaches, so the shuffle is tiny.
    """
    probs = [0.10 + 0.80 * i / (candidates - 1) for i in range(candidates)]
    cuts = ordered.exact_quantiles(df, lr, probs)
    reached = F.lit(0)
    for c in cuts:
        reached = reached + (F.col(lr) >= F.lit(c)).cast("int")
    counts = df.groupBy(reached.alias("r")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    ).collect()
    total_pos = sum(r["pos"] for r in counts)
    best = (-1.0, None)
    for i, c in enumerate(cuts):
        tp = sum(r["pos"] for r in counts if r["r"] > i)
        hits = sum(r["n"] for r in counts if r["r"] > i)
        p, q = tp / max(hits, 1), tp / max(total_pos, 1)
        f1 = 2 * p * q / max(p + q, 1e-9)
        if f1 > best[0]:
            best = (f1, c)
    return df.sparkSession.createDataFrame([(float(best[1]), float(best[0]))], "gate double, f1 double")


def blend_base(lr: Column | str, mean: float, std: float) -> Column:
    lr = F.col(lr) if isinstance(lr, str) else lr
    return S.sigmoid((lr - F.lit(mean)) / F.lit(std + 1e-5))


def blend(lr: Column | str, probability: Column | str, mean: float, std: float, alpha: float) -> Column:
    """base + alpha (p - base), with base the sigmoid of the standardised ratio."""
    probability = F.col(probability) if isinstance(probability, str) else probability
    base = blend_base(lr, mean, std)
    return base + F.lit(alpha) * (probability - base)


# --------------------------------------------------------------------------- heads


@dataclass
class Head:
    """A fitted classifier over a feature array; weights are plain arrays, so scoring is one Arrow call."""

    kind: str
    layers: list[tuple[np.ndarray, np.ndarray]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Hidden layers are sigmoids, as the fitted network has; the last layer gives the class odds."""
        for w, b in self.layers[:-1]:
            x = sigmoid(x @ w + b)
        w, b = self.layers[-1]
        z = x @ w + b
        logit = z[:, 0] if z.shape[1] == 1 else z[:, 1] - z[:, 0]
        return sigmoid(logit)

    def score(self, features: Column | str) -> Column:
        features = F.col(features) if isinstance(features, str) else features
        return vectors.scalar_udf(self.probability)(features)


def _training(df: DataFrame, features: str, label: str) -> DataFrame:
    return df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(features)).alias("features"))


def fit_logistic(df: DataFrame, features: str, label: str = "label", c: float = 1.0, max_iter: int = 500) -> Head:
    """Ridge-penalised logistic regression; c is the inverse penalty on the summed loss."""
    train = _training(df, features, label).cache()
    try:
        n = train.count()
        model = LogisticRegression(
            regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8
        ).fit(train)
    finally:
        train.unpersist()
    return Head("logistic", [(model.coefficients.toArray()[:, None], np.array([model.intercept]))])


def fit_mlp(df: DataFrame, features: str, hidden: list[int], label: str = "label", seed: int = 42, max_iter: int = 100) -> Head:
    """Small network on standardised features; the scaling is folded into the first layer afterwards."""
    n, mean, squares = vectors.dim_moments(df, features)[0]
    scale = np.sqrt(squares / n)
    scale = np.where(scale < 1e-9, 1.0, scale)
    unit = vectors.map_vectors(df.select(label, features), "_unit", lambda x: (x - mean) / scale, features)
    train = _training(unit, "_unit", label).cache()
    try:
        sizes = [len(mean), *hidden, 2]
        model = MultilayerPerceptronClassifier(layers=sizes, seed=seed, maxIter=max_iter).fit(train)
    finally:
        train.unpersist()
    flat, at, layers = model.weights.toArray(), 0, []
    for a, b in zip(sizes, sizes[1:]):
        # stored column-major as (outputs x inputs), then the biases
        w = flat[at : at + a * b].reshape(a, b)
        at += a * b
        layers.append((w, flat[at : at + b]))
        at += b
    w, b = layers[0]
    layers[0] = (w / scale[:, None], b - (mean / scale) @ w)
    return Head("mlp", layers)


# --------------------------------------------------------------------------- features for the heads


@dataclass
class Scorer:
    """All fitted parts; which score is used follows from what is present."""

    normal: Manifold
    attack: Manifold | None = None
    fisher: Fisher | None = None
    fisher_z: np.ndarray | None = None
    head: Head | None = None
    teacher: Head | None = None
    student: Head | None = None
    student_basis: np.ndarray | None = None
    quadratic: Head | None = None
    linear: Head | None = None
    fusion: Head | None = None
    fusion_dim: int | None = None
    fusion_basis: np.ndarray | None = None
    eps: float = 0.5
    alpha: float = 0.0
    base_mean: float = 0.0
    base_std: float = 1.0
    gate: float = 1.0
    gate_margin: float = 0.0

    # ----- per-batch numbers, shared by batch and stream

    def ratio(self, h: np.ndarray) -> np.ndarray:
        return self.normal.distances(h) / (self.attack.distances(h) + self.eps)

    def features66(self, h: np.ndarray) -> np.ndarray:
        proj = h @ self.fisher.direction if self.fisher else np.zeros(len(h))
        return np.column_stack([h, proj, self.ratio(h)])

    def features_quadratic(self, h: np.ndarray) -> np.ndarray:
        f = h @ self.fisher.direction if self.fisher else np.zeros(len(h))
        lr = self.ratio(h)
        return np.column_stack([f, lr, f**2, lr**2, f * lr])

    def features_student(self, h: np.ndarray) -> np.ndarray:
        return np.column_stack([h @ self.student_basis, self.ratio(h)])

    def features_fusion(self, h: np.ndarray, z: np.ndarray) -> np.ndarray:
        if self.fusion_dim == -1:
            return np.column_stack([h, z])
        lr = self.ratio(h)
        fh = h @ self.fisher.direction if self.fisher else np.zeros(len(h))
        fz = z @ self.fisher_z if self.fisher_z is not None else np.zeros(len(h))
        if self.fusion_dim == 0:
            return np.column_stack([h, fh, lr, fz])
        if self.fusion_dim:
            return np.column_stack([h, z @ self.fusion_basis, fh, fz, lr])
        return np.column_stack([h, z, fh, fz, lr])

    def _blended(self, lr: np.ndarray, p: np.ndarray) -> np.ndarray:
        if self.alpha <= 0.0:
            return p
        base = sigmoid((lr - self.base_mean) / (self.base_std + 1e-5))
        return base + self.alpha * (p - base)

    def numbers(self, h: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
        """The score of each state by the first part present:
        fusion, head, teacher (gated), student, quadratic, linear, boosted ratio, distance."""
        if self.attack is None:
            return self.normal.distances(h)
        if self.fusion is not None and z is not None:
            return self._blended(self.ratio(h), self.fusion.probability(self.features_fusion(h, z)))
        if self.head is not None:
            return self.head.probability(self.features66(h))
        if self.teacher is not None:
            lr = self.ratio(h)
            p = self._blended(lr, self.teacher.probability(self.features66(h)))
            if self.gate_margin > 0.0:
                away = np.abs(lr - self.gate) / max(self.gate, 1e-4) >= self.gate_margin
                p = np.where(away, lr, p)
            return p
        if self.student is not None:
            return self.student.probability(self.features_student(h))
        if self.quadratic is not None:
            return self.quadratic.probability(self.features_quadratic(h))
        if self.linear is not None:
            return self.linear.probability(self.features66(h))
        lr = self.ratio(h)
        if self.fisher is not None:
            return lr * (1.0 + 0.5 * sigmoid((h @ self.fisher.direction - self.fisher.shift) / self.fisher.scale))
        return lr

    def mode(self) -> str:
        if self.attack is None:
            return "mahalanobis"
        for name in ("fusion", "head", "teacher", "student", "quadratic", "linear"):
            if getattr(self, name) is not None:
                return name
        return "boosted_ratio" if self.fisher is not None else "ratio"


def score(scorer: Scorer, h: Column | str, z: Column | str | None = None) -> Column:
    """The one score expression; vectors cross into Python once whatever parts are fitted."""
    h = F.col(h) if isinstance(h, str) else h
    if z is None:
        return vectors.scalar_udf(scorer.numbers)(h)
    z = F.col(z) if isinstance(z, str) else z
    both = F.arrow_udf(lambda a, b: pa.array(scorer.numbers(vectors.matrix(a), vectors.matrix(b))), "double")
    return both(h, z)


def features(scorer: Scorer, which: str, h: str, z: str | None = None) -> Column:
    """Feature array for fitting one head."""
    fn = getattr(scorer, f"features{which}" if which == "66" else f"features_{which}")
    if z is None:
        return F.arrow_udf(lambda a: vectors.list_column(fn(vectors.matrix(a))), "array<double>")(F.col(h))
    return F.arrow_udf(
        lambda a, b: vectors.list_column(fn(vectors.matrix(a), vectors.matrix(b))), "array<double>"
    )(F.col(h), F.col(z))


# --------------------------------------------------------------------------- fitting


def fit_base(
    df: DataFrame, vec: str = "h", clusters: int = 1, kind: str = "full", trim: float = 0.02, eps: float = 0.5,
    min_class_rows: int = MIN_CLASS_ROWS, wide: int | None = WIDE,
) -> Scorer:
    """Normal manifold, attack manifold and discriminant, as far as the classes allow; a warning names what is left out.

    The class moments are summed once and serve the trim centre, the attack manifold and the discriminant. Vectors wider
    than `wide` get the normals' cosine model alone, before any matrix of their width squared is summed.
    """
    head = df.select(F.size(vec)).first()
    if wide is not None and head is not None and head[0] > wide:
        warnings.warn(f"vectors of {head[0]} elements are wider than {wide}: cosine to the normals' mean only", stacklevel=2)
        return Scorer(normal=fit_manifold(df.filter(F.col("label") == 0), vec, 1, kind, trim, wide=wide), eps=eps)
    by = vectors.moments(df, vec, by="label")
    centre = (by[0].n, by[0].mean) if 0 in by else None
    normal = fit_manifold(df.filter(F.col("label") == 0), vec, clusters, kind, trim, centre=centre, wide=None)
    scorer = Scorer(normal=normal, eps=eps)
    if 1 in by and by[1].n >= max(2, min_class_rows):
        scorer.attack = from_moments(by[1])
        scorer.fisher = fit_fisher(df, vec, by=by, min_rows=min_class_rows)
    else:
        warnings.warn(f"no attack model: {by[1].n if 1 in by else 0} attack rows are under {max(2, min_class_rows)}", stacklevel=2)
    return scorer


def fit_linear(scorer: Scorer, df: DataFrame, vec: str = "h") -> Scorer:
    scorer.linear = fit_logistic(df.withColumn("_f", features(scorer, "66", vec)), "_f")
    return scorer


def fit_quadratic(scorer: Scorer, df: DataFrame, vec: str = "h") -> Scorer:
    scorer.quadratic = fit_logistic(df.withColumn("_f", features(scorer, "quadratic", vec)), "_f")
    return scorer


def fit_student(scorer: Scorer, df: DataFrame, vec: str = "h", hidden: int = 4) -> Scorer:
    """Discriminant plus the leading directions between normal centres and the attack mean."""
    attack_mean = vectors.vector_mean(df.filter(F.col("label") == 1), vec)
    between = scorer.normal.means - attack_mean
    _, _, vt = np.linalg.svd(between, full_matrices=False)
    basis = np.column_stack([scorer.fisher.direction, vt[:3].T])
    scorer.student_basis, _ = np.linalg.qr(basis)
    scorer.student = fit_mlp(df.withColumn("_f", features(scorer, "student", vec)), "_f", [hidden])
    return scorer


def fit_teacher(scorer: Scorer, df: DataFrame, vec: str = "h", alpha: float = 0.0, gate_margin: float = 0.0) -> Scorer:
    scorer.teacher = fit_mlp(df.withColumn("_f", features(scorer, "66", vec)), "_f", [16])
    return _fit_extras(scorer, df, vec, alpha, gate_margin)


def fit_head(scorer: Scorer, df: DataFrame, vec: str = "h") -> Scorer:
    scorer.head = fit_mlp(df.withColumn("_f", features(scorer, "66", vec)), "_f", [32, 16])
    return scorer


def fit_fusion(scorer: Scorer, df: DataFrame, h: str = "h", z: str = "z", dim: int | None = -1, alpha: float = 0.0) -> Scorer:
    """dim -1: linear on [h, z]; 0: compact; k > 0: z reduced to k components; None: all features."""
    scorer.fusion_dim = dim
    if dim != -1:
        scorer.fisher_z = fisher_direction(vectors.moments(df, z, by="label"))
    if dim and dim > 0:
        m = vectors.moments(df, z)[0]
        values, basis = np.linalg.eigh(m.scatter)
        scorer.fusion_basis = basis[:, np.argsort(-values)[:dim]]
    rows = df.withColumn("_f", features(scorer, "fusion", h, z))
    scorer.fusion = fit_logistic(rows, "_f") if dim == -1 else fit_mlp(rows, "_f", [16])
    return _fit_extras(scorer, df, h, alpha, 0.0)


def _fit_extras(scorer: Scorer, df: DataFrame, vec: str, alpha: float, gate_margin: float) -> Scorer:
    if alpha <= 0.0 and gate_margin <= 0.0:
        return scorer
    rows = df.select("label", vectors.scalar_udf(scorer.ratio)(F.col(vec)).alias("lr"))
    if alpha > 0.0:
        scorer.alpha = alpha
        scorer.base_mean, scorer.base_std = rows.agg(F.avg("lr"), F.stddev_pop("lr")).first()
    if gate_margin > 0.0:
        scorer.gate_margin = gate_margin
        scorer.gate = fit_gate(rows).first()["gate"]
    return scorer


def decide(df: DataFrame, threshold: float, score: str = "score", mode: str = "mahalanobis", strict: bool = False) -> DataFrame:
    """Append the decision columns; score >= threshold is an anomaly."""
    hit = F.col(score) > threshold if strict else F.col(score) >= threshold
    return df.withColumns(
        {
            "drift_score": F.col(score),
            "threshold": F.lit(float(threshold)),
            "is_anomaly": hit,
            "scoring_mode": F.lit(mode),
        }
    )


def geometric_separability(df: DataFrame, vec: str, label: str = "label") -> DataFrame:
    """Centre distance, summed class variances (population) and their ratio."""
    by = vectors.dim_moments(df, vec, by=label)
    if 0 not in by or 1 not in by:
        row = (0.0, 0.0, 0.0, 0.0)
    else:
        d = float(np.linalg.norm(by[1][1] - by[0][1]))
        v0, v1 = (float(by[c][2].sum() / by[c][0]) for c in (0, 1))
        row = (d, v0, v1, d**2 / (v0 + v1 + 1e-9))
    return df.sparkSession.createDataFrame([row], "centroid_dist double, var_norm double, var_att double, fdr double")
