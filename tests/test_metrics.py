import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.operators import calibrate, evaluate


def table(spark, labels, scores):
    return spark.createDataFrame([(i, int(l), float(s)) for i, (l, s) in enumerate(zip(labels, scores))], "flow_id long, label int, score double")


EIGHT = [0, 0, 0, 0, 1, 1, 1, 1]


@pytest.mark.parametrize(
    "labels,scores,auroc,fpr",
    [
        (EIGHT, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8], 1.0, 0.0),
        (EIGHT, [0.1, 0.2, 0.3, 0.6, 0.5, 0.6, 0.7, 0.8], None, 0.25),
        ([0, 0, 1, 1], [0.2, 0.8, 0.8, 0.9], 0.875, 0.5),
        ([0, 0], [0.2, 0.8], 0.5, 1.0),
        ([1, 1], [0.2, 0.8], 0.5, 1.0),
    ],
)
def test_ranking(spark, labels, scores, auroc, fpr):
    row = evaluate.ranking_metrics(table(spark, labels, scores)).first()
    if auroc is not None:
        assert row["auroc"] == pytest.approx(auroc)
    assert row["fpr_at_tpr"] == pytest.approx(fpr)
    if len(set(labels)) == 1:
        assert row["pr_auc"] == 0.0


def test_suite(spark):
    df = table(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]).withColumn("predicted_label", F.element_at(F.array(*[F.lit(x) for x in (0, 1, 1, 0)]), (F.col("flow_id") + 1).cast("int")))
    row = evaluate.classification_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1_score"], row["auroc"], row["pr_auc"]) == (0.5, 0.5, 0.5, 1.0, 1.0)
    rates = evaluate.rate_metrics(df.sparkSession.createDataFrame([(4, 1.0)], "n long, s double"), "n", "s").first()
    assert rates["throughput_flows_sec"] == 4 and rates["latency_ms_per_flow"] == 250


def test_bad_scores_are_refused(spark):
    with pytest.raises(ValueError):
        evaluate.validate_scores(table(spark, [0, 2], [0.1, 0.2]))
    with pytest.raises(ValueError):
        evaluate.validate_scores(table(spark, [0, 1], [0.1, float("nan")]))


def _brute(labels, scores, t):
    p = scores >= t
    tp, fp = ((labels == 1) & p).sum(), ((labels == 0) & p).sum()
    pr = tp / (tp + fp) if tp + fp else 0.0
    rc = tp / (labels == 1).sum()
    return pr, rc, (2 * pr * rc / (pr + rc) if pr + rc else 0.0), fp / (labels == 0).sum()


def test_calibration_against_brute_force(spark):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 400)
    scores = np.round(rng.normal(labels * 0.8, 1.0), 1)  # many ties
    df = table(spark, labels, scores)
    points = {t: _brute(labels, scores, t) for t in np.unique(scores)}
    best = max(points, key=lambda t: (points[t][2], points[t][0], points[t][1], -points[t][3]))
    assert calibrate.calibrate(df, "f1_max").first()["threshold"] == best
    strict = [t for t in points if points[t][1] >= 0.95]
    best = min(strict, key=lambda t: (points[t][3], -points[t][0], -points[t][1]))
    assert calibrate.calibrate(df, "security_constrained").first()["threshold"] == best
    cut = np.percentile(scores[labels == 0], 90)
    assert calibrate.calibrate(df, "normal_percentile", target_fpr=0.1).first()["threshold"] == pytest.approx(cut)


def test_grid_counts_are_strict(spark):
    rng = np.random.default_rng(5)
    scores, labels = np.round(rng.random(300), 2), rng.integers(0, 2, 300)
    rows = evaluate.grid_sweep(table(spark, labels, scores), 101).orderBy("candidate").collect()
    assert len(rows) == 101
    for r in rows:
        p = scores > r["threshold"]
        assert r["tp"] == ((labels == 1) & p).sum() and r["fp"] == ((labels == 0) & p).sum()


def test_constant_scores(spark):
    df = table(spark, [0, 1, 0, 1], [0.5] * 4)
    assert evaluate.ranking_metrics(df).first()["auroc"] == 0.5
    assert evaluate.grid_sweep(df, 10).count() == 10
    assert evaluate.score_histogram(df, 5).agg(F.sum("row_count")).first()[0] == 4


def test_single_class_fallback(spark):
    df = table(spark, [0] * 5, [1, 2, 3, 4, 5])
    assert calibrate.threshold_or_fallback(df, k=2.0) == pytest.approx(3 + 2 * np.std([1, 2, 3, 4, 5]))
    with pytest.raises(ValueError):
        calibrate.calibrate(df)


def test_sweeps_of_empty_tables_and_single_candidates(spark):
    none = table(spark, [], [])
    assert evaluate.grid_sweep(none).count() == 0
    assert evaluate.score_histogram(none).count() == 0
    (row,) = evaluate.grid_sweep(table(spark, [0, 1, 1], [0.1, 0.5, 0.9]), candidates=1).collect()
    assert (row["threshold"], row["tp"], row["fp"], row["fn"], row["tn"]) == (0.1, 2, 0, 0, 1)
