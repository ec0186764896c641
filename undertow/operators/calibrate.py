"""Choosing one threshold from validation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.operators import evaluate, ordered

METHODS = ("f1_max", "precision_priority", "recall_priority", "security_constrained", "tpr_95", "normal_percentile")


def _ranked(points: DataFrame, *keys) -> DataFrame:
    return points.orderBy(*keys).limit(1)


def _filtered(points: DataFrame, condition) -> DataFrame:
    """Rows meeting the condition; all rows when none does."""
    best = points.agg(F.max(condition.cast("int"))).first()[0]
    return points.filter(condition) if best == 1 else points


def calibrate(
    df: DataFrame,
    method: str = "f1_max",
    min_precision: float = 0.95,
    target_tpr: float = 0.95,
    target_fpr: float = 0.05,
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """One row: the chosen threshold with its confusion counts and rates."""
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown calibration method {method!r}")
    if not evaluate.has_both_classes(df, label):
        raise ValueError("calibration needs normal and anomalous rows")
    columns = ["threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr"]
    if method == "normal_percentile":
        cut = ordered.exact_quantiles(df.filter(F.col(label) == 0), score, [1.0 - target_fpr])[0]
        return evaluate.metrics_at(df, cut, label, score).select(*columns)
    points = evaluate.threshold_sweep(df, label, score).select(*columns)
    p, r, fpr = F.col("precision"), F.col("recall"), F.col("fpr")
    if method == "f1_max":
        return _ranked(points, F.col("f1").desc(), p.desc(), r.desc(), fpr)
    if method == "precision_priority":
        return _ranked(_filtered(points, p >= min_precision), r.desc(), p.desc(), fpr)
    if method == "recall_priority":
        return _ranked(points, r.desc(), p.desc(), fpr)
    return _ranked(_filtered(points, r >= target_tpr), fpr, p.desc(), r.desc())


def mean_k_std(df: DataFrame, k: float, score: str = "score", population: bool = False) -> DataFrame:
    """mean + k deviations of the rows given; sample deviation unless population is asked for."""
    deviation = F.stddev_pop(score) if population else F.stddev_samp(score)
    return df.agg((F.avg(score) + k * F.coalesce(deviation, F.lit(0.0))).alias("threshold"))


def threshold_or_fallback(df: DataFrame, method: str = "f1_max", k: float = 3.0, label: str = "label", score: str = "score", **kw) -> float:
    """Calibrated threshold; with one class only, the normals' mean + k population deviations."""
    if evaluate.has_both_classes(df, label):
        return float(calibrate(df, method, label=label, score=score, **kw).first()["threshold"])
    return float(mean_k_std(df.filter(F.col(label) == 0), k, score, population=True).first()["threshold"])


def rescale_threshold(df: DataFrame, k: float, score: str = "score") -> DataFrame:
    """Sensitivity setting: mean + (k / 3) * 2 sample deviations."""
    return df.agg((F.avg(score) + F.lit(k / 3.0) * (2.0 * F.stddev_samp(score))).alias("threshold"))


def best_grid_f1(df: DataFrame, candidates: int = 1000, label: str = "label", score: str = "score") -> DataFrame:
    """First evenly spaced threshold with the best F1."""
    return _ranked(evaluate.grid_sweep(df, candidates, label, score), F.col("f1").desc(), "candidate")


def operating_points(val: DataFrame, test: DataFrame, candidates: int = 1000) -> DataFrame:
    """Five thresholds chosen on validation, each applied once to test with score > threshold."""
    grid = evaluate.grid_sweep(val, candidates)
    p, r, f1, fpr, j = F.col("precision"), F.col("recall"), F.col("f1"), F.col("fpr"), F.col("candidate")
    first = lambda condition, metric: F.max_by(
        F.col("threshold"), F.when(condition, F.struct(metric.alias("m"), (-j).alias("o")))
    )
    always = F.lit(True)
    picks = grid.agg(
        first(always, f1).alias("f1_max"),
        F.coalesce(first(p >= 0.95, r), first(always, p)).alias("precision_priority"),
        first(r >= 0.95, p).alias("recall_priority"),
        first(r >= 0.70, -fpr).alias("security_constrained"),
    ).first()
    chosen = dict(picks.asDict())
    chosen["tpr_95"] = evaluate.fpr_at_tprs(val, (0.95,)).first()["threshold"]
    # all five verdicts are counted in one pass over test
    names = [n for n, t in chosen.items() if t is not None]
    hit, pos = {n: F.col("score") > float(chosen[n]) for n in names}, F.col("label") == 1
    count = lambda c: F.sum(c.cast("long"))
    sums = test.agg(
        *[
            F.struct(
                F.lit(n).alias("name"),
                F.lit(float(chosen[n])).alias("threshold"),
                count(hit[n] & pos).alias("tp"),
                count(hit[n] & ~pos).alias("fp"),
                count(~hit[n] & pos).alias("fn"),
                count(~hit[n] & ~pos).alias("tn"),
            ).alias(n)
            for n in names
        ]
    )
    return evaluate._rates(sums.select(F.inline(F.array(*names))))
