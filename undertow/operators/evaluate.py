"""Score sweeps, ranking metrics and score diagnostics.

Scores are counted per distinct value first (map-side combined), so tied scores never travel twice.
One descending running total over those counts then gives every threshold metric at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.operators import ordered



def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(2.0 * precision * recall, precision + recall)


def _rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and fpr from tp, fp, fn, tn."""
    with_pr = df.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn")),
        }
    )
    return with_pr.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def validate_scores(df: DataFrame, label: str = "label", score: str = "score") -> None:
    """Labels must be 0/1 and scores finite."""
    bad = df.filter(
        ~F.coalesce(F.col(label).isin(0, 1), F.lit(False))
        | F.col(score).isNull()
        | F.isnan(score)
        | (F.abs(F.col(score)) == float("inf"))
    )
    if bad.limit(1).count():
        raise ValueError("labels must be 0/1 and scores must be finite")


def confusion(df: DataFrame, predicted: Column, label: str = "label", by: list[str] | None = None) -> DataFrame:
    hit, pos = predicted.cast("boolean"), F.col(label) == 1
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    counts = df.groupBy(*(by or [])).agg(
        count(hit & pos).alias("tp"),
        count(hit & ~pos).alias("fp"),
        count(~hit & pos).alias("fn"),
        count(~hit & ~pos).alias("tn"),
    )
    return _rates(counts)


def metrics_at(df: DataFrame, threshold: float, label: str = "label", score: str = "score", strict: bool = False) -> DataFrame:
    """Confusion counts and rates with the verdict score >= threshold (or > when strict)."""
    hit = F.col(score) > threshold if strict else F.col(score) >= threshold
    return confusion(df, hit, label).withColumn("threshold", F.lit(float(threshold)))


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")
    )


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score, with the verdict score >= threshold."""
    swept, totals = ordered.prefix_sums_and_totals(
        score_counts(df, label, score), [F.col("threshold").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}
    )
    return _rates(
        swept.withColumns({"fn": F.lit(totals["tp"]).cast("long") - F.col("tp"), "tn": F.lit(totals["fp"]).cast("long") - F.col("fp")})
    )


def has_both_classes(df: DataFrame, label: str = "label") -> bool:
    low, high = df.agg(F.min(label), F.max(label)).first()
    return low == 0 and high == 1


# --------------------------------------------------------------------------- curves


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, after the (0, 0) point at infinity."""
    spark = df.sparkSession
    origin = spark.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    if not has_both_classes(df, label):
        return origin
    return origin.unionByName(threshold_sweep(df, label, score).select("threshold", "fpr", F.col("recall").alias("tpr")))


def pr_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return threshold_sweep(df, label, score).select("threshold", "precision", "recall")


def tradeoff_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return threshold_sweep(df, label, score).select("threshold", "precision", "recall", "f1")


def roc_coordinates(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC path with one step per row (ties not merged), padded with (0,0) and (1,1)."""
    walked, totals = ordered.prefix_sums_and_totals(
        df.select("flow_id", F.col(score).alias("score"), F.col(label).alias("label")),
        [F.col("score").desc(), F.col("flow_id").desc()],
        {"idx": F.lit(1).cast("long"), "tps": F.col("label").cast("long"), "fps": (1 - F.col("label")).cast("long")},
    )
    pos, neg = totals["tps"], totals["fps"]
    path = walked.select(
        "idx",
        (F.col("fps") / F.lit(neg) if neg else F.lit(0.0)).alias("fpr"),
        (F.col("tps") / F.lit(pos) if pos else F.lit(0.0)).alias("tpr"),
    )
    ends = df.sparkSession.createDataFrame([(0, 0.0, 0.0), (totals["idx"] + 1, 1.0, 1.0)], "idx long, fpr double, tpr double")
    return path.unionByName(ends)


# --------------------------------------------------------------------------- ranking metrics


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score", target_tpr: float = 0.95) -> DataFrame:
    """auroc (ties half), pr_auc (average precision) and the lowest FPR whose TPR meets the target."""
    if not 0.0 < target_tpr <= 1.0:
        raise ValueError("target_tpr must be in (0, 1]")
    if not has_both_classes(df, label):
        return df.sparkSession.range(1).select(
            F.lit(0.5).alias("auroc"), F.lit(0.0).alias("pr_auc"), F.lit(1.0).alias("fpr_at_tpr")
        )
    s = threshold_sweep(df, label, score)
    p, n = F.max("tp"), F.max("fp")
    return s.agg(
        (F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / (p * n)).alias("auroc"),
        (F.sum(F.col("pos") * F.col("precision")) / p).alias("pr_auc"),
        F.coalesce(F.min(F.when(F.col("recall") >= target_tpr, F.col("fpr"))), F.lit(1.0)).alias("fpr_at_tpr"),
    )


def auroc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(df, label, score).select("auroc")


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(df, label, score).select("pr_auc")


def fpr_at_tpr(df: DataFrame, target: float = 0.95, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(df, label, score, target).select("fpr_at_tpr")


def fpr_at_pos_quantile(df: DataFrame, share: float = 0.05, label: str = "label", score: str = "score") -> DataFrame:
    """FPR at the positive score of rank floor(share * positives)."""
    pos = df.filter(F.col(label) == 1)
    n = pos.count()
    if n == 0:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"))
    rank = ordered.share_of(n, share)
    cut = ordered.value_at_rank(pos, score, [rank])[rank]
    return df.filter(F.col(label) == 0).agg(
        F.lit(cut).alias("threshold"), F.coalesce(F.avg((F.col(score) >= cut).cast("double")), F.lit(0.0)).alias("fpr")
    )


def fpr_at_tprs(df: DataFrame, targets=(0.90, 0.95, 0.99), label: str = "label", score: str = "score") -> DataFrame:
    """For each target, the first threshold (from above) whose TPR meets it; one pass over the sweep."""
    point = lambda t: F.max(F.when(F.col("recall") >= t, F.struct("threshold", "fpr", "recall")))
    picked = threshold_sweep(df, label, score).agg(*[point(t).alias(f"p{i}") for i, t in enumerate(targets)])
    rows = [
        F.struct(
            F.lit(float(t)).alias("target_tpr"),
            F.col(f"p{i}.threshold").alias("threshold"),
            F.coalesce(F.col(f"p{i}.fpr"), F.lit(1.0)).alias("fpr"),
            F.coalesce(F.col(f"p{i}.recall"), F.lit(1.0)).alias("tpr"),
        )
        for i, t in enumerate(targets)
    ]
    return picked.select(F.inline(F.array(*rows)))


def classification_metrics(df: DataFrame, label: str = "label", score: str = "score", predicted: str = "predicted_label") -> DataFrame:
    """The whole metric suite on one row: confusion and ranking metrics."""
    validate_scores(df, label, score)
    counts = confusion(df, F.col(predicted) == 1, label).first()
    ranks = ranking_metrics(df, label, score)
    return ranks.select(
        *[F.lit(counts[c]).alias(c) for c in ("tp", "fp", "fn", "tn", "precision", "recall")],
        F.lit(counts["f1"]).alias("f1_score"),
        "auroc",
        "pr_auc",
        F.col("fpr_at_tpr").alias("fpr_at_95_tpr"),
        F.lit(sum(counts[c] for c in ("tp", "fp", "fn", "tn"))).cast("long").alias("sample_size"),
    )


def rate_metrics(df: DataFrame, rows: str, seconds: str) -> DataFrame:
    """throughput_flows_sec and latency_ms_per_flow; 0 where undefined."""
    return df.withColumns(
        {
            "throughput_flows_sec": F.when(F.col(seconds) > 0, F.col(rows) / F.col(seconds)).otherwise(F.lit(0.0)),
            "latency_ms_per_flow": F.when(F.col(rows) > 0, F.col(seconds) / F.col(rows) * 1000.0).otherwise(F.lit(0.0)),
        }
    )


# --------------------------------------------------------------------------- distributions


def score_histogram(df: DataFrame, bins: int = 30, label: str = "label", score: str = "score") -> DataFrame:
    """(label, bin, lower, rows) over equal bins; the right edge belongs to the last bin. Empty in, empty out."""
    lo, hi = df.agg(F.coalesce(F.min(score), F.lit(0.0)), F.coalesce(F.max(score), F.lit(0.0))).first()
    step = (hi - lo) / bins or 1.0
    which = F.least(F.floor((F.col(score) - lo) / F.lit(step)), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(F.col(label).alias("label"), which.alias("bin")).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.withColumn("lower", F.lit(lo) + F.col("bin") * F.lit(step))


def score_stats(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Mean, population deviation, median, min, max, p95 and p99 per class."""
    base = df.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
    )
    out = None
    for cls in (0, 1):
        med, p95, p99 = ordered.exact_quantiles(df.filter(F.col(label) == cls), score, [0.5, 0.95, 0.99])
        part = base.filter(F.col("label") == cls).withColumns(
            {"median": F.lit(med), "p95": F.lit(p95), "p99": F.lit(p99)}
        )
        out = part if out is None else out.unionByName(part)
    return out


def score_overlap(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Share of anomalies scored below the normals' p95 and below their median."""
    median, p95 = ordered.exact_quantiles(df.filter(F.col(label) == 0), score, [0.5, 0.95])
    return df.filter(F.col(label) == 1).agg(
        F.lit(p95).alias("normal_p95"),
        F.lit(median).alias("normal_median"),
        F.avg((F.col(score) < p95).cast("double")).alias("below_p95"),
        F.avg((F.col(score) < median).cast("double")).alias("below_median"),
    )


# --------------------------------------------------------------------------- running metrics


def running_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """Confusion counts, precision, recall and F1 after each flow in time order."""
    hit, pos = F.col(predicted) == 1, F.col(label) == 1
    walked = ordered.prefix_sums(
        df,
        ["ts", "flow_id"],
        {
            "processed": F.lit(1).cast("long"),
            "tp": (hit & pos).cast("long"),
            "fp": (hit & ~pos).cast("long"),
            "fn": (~hit & pos).cast("long"),
            "tn": (~hit & ~pos).cast("long"),
        },
    )
    floor = lambda c, least: F.greatest(c, F.lit(least))
    return walked.withColumns(
        {
            "anomalies": F.col("tp") + F.col("fp"),
            "precision": F.col("tp") / floor(F.col("tp") + F.col("fp"), 1),
            "recall": F.col("tp") / floor(F.col("tp") + F.col("fn"), 1),
        }
    ).withColumn(
        "f1_score",
        2.0 * F.col("precision") * F.col("recall") / floor(F.col("precision") + F.col("recall"), 1e-6),
    )


def stream_summary(df: DataFrame, label: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """Final totals of a scored stream."""
    c = confusion(df, F.col(predicted) == 1, label)
    return c.select(
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("total_processed"),
        (F.col("tp") + F.col("fp")).alias("total_anomalies"),
        F.col("f1").alias("f1_score"),
        "precision",
        "recall",
        "tp",
        "fp",
        "fn",
        "tn",
    )


# --------------------------------------------------------------------------- audits


def parity(a: DataFrame, b: DataFrame, score: str = "drift_score", tolerance: float = 1e-5) -> DataFrame:
    """Compare two decision tables by flow_id, counting rows missing on either side."""
    both = a.select("flow_id", F.col(score).alias("_a")).join(
        b.select("flow_id", F.col(score).alias("_b")), "flow_id", "full_outer"
    )
    diff = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum((F.col("_a").isNull() | F.col("_b").isNull()).cast("long")), F.lit(0)).alias("unmatched"),
        F.coalesce(F.max(diff), F.lit(0.0)).alias("max_abs_diff"),
        F.coalesce(F.avg(diff), F.lit(0.0)).alias("mean_abs_diff"),
    ).withColumn("passed", (F.col("unmatched") == 0) & (F.col("max_abs_diff") <= tolerance))


def reverify(decisions: DataFrame) -> DataFrame:
    """All metrics again from a stored decision table."""
    return classification_metrics(decisions, "actual_label", "drift_score", "predicted_label")


def audit_arithmetic(runs: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Runs whose stored F1 disagrees with their precision and recall."""
    expected = f1_of(F.col("precision"), F.col("recall"))
    return (
        runs.withColumn("expected_f1", expected)
        .withColumn("diff", F.abs(F.col("f1_score") - F.col("expected_f1")))
        .withColumn("passed", F.col("diff") <= tolerance)
    )


def grid_sweep(df: DataFrame, candidates: int = 1000, label: str = "label", score: str = "score") -> DataFrame:
    """Metrics at evenly spaced thresholds with the strict verdict score > threshold.

    Each row is counted once under the number of thresholds it exceeds; the running totals then run over
    at most candidates + 1 rows. A single candidate is the smallest score; a table without scores has none.
    """
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    if lo is None:
        lo = hi = 0.0
        candidates = 0
    if candidates == 1:
        hi = lo
    step = (hi - lo) / max(1, candidates - 1)
    x = F.col(score)
    edge = lambda j: F.when(j >= candidates - 1, F.lit(hi)).otherwise(F.lit(lo) + j * F.lit(step))
    guess = F.floor((x - lo) / F.lit(step or 1.0)).cast("long")
    above = guess - 1
    for k in (-1, 0, 1):
        above = above + (edge(guess + k) < x).cast("long")
    above = F.least(F.greatest(above, F.lit(0)), F.lit(candidates))
    counts = df.groupBy(above.cast("long").alias("above")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")
    )
    slots = df.sparkSession.range(candidates + 1).withColumnRenamed("id", "above").join(counts, "above", "left")
    down = Window.orderBy(F.col("above").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    summed = slots.select(
        "above",
        F.sum(zero("pos")).over(down).alias("tp"),
        F.sum(zero("neg")).over(down).alias("fp"),
        F.sum(zero("pos")).over(whole).alias("_p"),
        F.sum(zero("neg")).over(whole).alias("_n"),
    ).filter(F.col("above") >= 1)
    j = F.col("above") - 1
    return _rates(
        summed.select(
            j.alias("candidate"),
            edge(j).alias("threshold"),
            "tp",
            "fp",
            (F.col("_p") - F.col("tp")).alias("fn"),
            (F.col("_n") - F.col("fp")).alias("tn"),
        )
    )
