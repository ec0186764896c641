"""Queries over calibration and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertow.operators import calibrate, evaluate
from undertow.plans import flows as src
from undertow.plans.queries_prep import _decisions
from undertow.plans.registry import FLOWS, SCORES, SWEEP, TAGGED, query, r, r6, rounded

RATES = ("precision", "recall", "f1", "fpr")
_POINT = f"threshold, tp, fp, fn, tn, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, {r('fpr')} AS fpr"
_AT = (
    "CAST(count(*) FILTER (hit AND label=1) AS BIGINT) AS tp, CAST(count(*) FILTER (hit AND label=0) AS BIGINT) AS fp, "
    "CAST(count(*) FILTER (NOT hit AND label=1) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT hit AND label=0) AS BIGINT) AS tn"
)
_AT_RATES = (
    "CASE WHEN tp+fp=0 THEN 0.0 ELSE CAST(tp AS DOUBLE)/(tp+fp) END AS precision, CASE WHEN tp+fn=0 THEN 0.0 ELSE CAST(tp AS DOUBLE)/(tp+fn) END AS recall, "
    "CASE WHEN fp+tn=0 THEN 0.0 ELSE CAST(fp AS DOUBLE)/(fp+tn) END AS fpr"
)


def _f1(p="precision", q="recall"):
    return f"CASE WHEN {p}+{q}=0 THEN 0.0 ELSE 2.0*{p}*{q}/({p}+{q}) END"


def _point(df):
    return rounded(df.select("threshold", "tp", "fp", "fn", "tn", *RATES), *RATES)


@query(f"WITH {SCORES}, c AS (SELECT {_AT} FROM (SELECT score >= 75 AS hit, label FROM scores)), m AS (SELECT *, {_AT_RATES} FROM c), sweep AS (SELECT 75.0::DOUBLE AS threshold, *, {_f1()} AS f1 FROM m) SELECT {_POINT} FROM sweep")
def c01_metrics_at(spark, sf):
    return _point(evaluate.metrics_at(src.scores(spark, sf), 75.0))


@query(f"WITH {SWEEP} SELECT {_POINT} FROM sweep")
def c02_threshold_sweep(spark, sf):
    return _point(evaluate.threshold_sweep(src.scores(spark, sf)))


def _calibrated(method, order, keep=None, **kw):
    pool = "sweep" if keep is None else f"(SELECT * FROM sweep WHERE {keep} OR NOT EXISTS (SELECT 1 FROM sweep WHERE {keep}))"

    @query(f"WITH {SWEEP} SELECT {_POINT} FROM {pool} ORDER BY {order} LIMIT 1", name=kw.pop("name"))
    def run(spark, sf):
        return _point(calibrate.calibrate(src.scores(spark, sf), method, **kw))

    return run


_calibrated("f1_max", "f1 DESC, precision DESC, recall DESC, fpr", name="c03_f1_max")
_calibrated("precision_priority", "recall DESC, precision DESC, fpr", "precision >= 0.95", name="c04_precision_priority")
_calibrated("precision_priority", "recall DESC, precision DESC, fpr", "precision >= 0.2", min_precision=0.2, name="c04_precision_reachable")
_calibrated("recall_priority", "recall DESC, precision DESC, fpr", name="c05_recall_priority")
_calibrated("tpr_95", "fpr, precision DESC, recall DESC", "recall >= 0.95", name="c06_tpr_95")


@query(f"WITH {SCORES}, q AS (SELECT quantile_cont(score, 0.95) AS threshold FROM scores WHERE label = 0), "
       f"c AS (SELECT threshold, {_AT} FROM (SELECT threshold, score >= threshold AS hit, label FROM scores, q) GROUP BY threshold), m AS (SELECT *, {_AT_RATES} FROM c), sweep AS (SELECT *, {_f1()} AS f1 FROM m) "
       f"SELECT {_POINT.replace('threshold', r('threshold') + ' AS threshold', 1)} FROM sweep")
def c07_normal_percentile(spark, sf):
    return rounded(_point(calibrate.calibrate(src.scores(spark, sf), "normal_percentile")), "threshold")


@query(f"WITH {SCORES} SELECT {r('avg(score) + 3.0 * stddev_pop(score)')} AS threshold FROM scores WHERE label = 0")
def c08_single_class_fallback(spark, sf):
    normal = src.scores(spark, sf).filter("label = 0")
    cut = calibrate.threshold_or_fallback(normal)
    return spark.range(1).select(r6(F.lit(cut)).alias("threshold"))


def _grid(n):
    return f"""WITH {SCORES}, b AS (SELECT min(score) AS lo, max(score) AS hi, (max(score) - min(score)) / {n - 1} AS step FROM scores),
  cand AS (SELECT j, CASE WHEN j = {n - 1} THEN hi ELSE lo + j * step END AS threshold FROM b, range(0, {n}) g(j)),
  c AS (SELECT j, threshold, {_AT} FROM (SELECT j, threshold, score > threshold AS hit, label FROM cand, scores) GROUP BY j, threshold),
  m AS (SELECT *, {_AT_RATES} FROM c), grid AS (SELECT *, {_f1()} AS f1 FROM m)"""


@query(_grid(100) + f" SELECT CAST(j AS BIGINT) AS candidate, {r('threshold')} AS threshold, tp, fp, fn, tn, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, {r('fpr')} AS fpr FROM grid")
def c09_grid_sweep(spark, sf):
    return rounded(evaluate.grid_sweep(src.scores(spark, sf), 100), "threshold", *RATES)


@query(_grid(500) + f" SELECT CAST(j AS BIGINT) AS candidate, {r('threshold')} AS threshold, {r('f1')} AS f1 FROM grid ORDER BY f1 DESC, j LIMIT 1")
def c09_grid_best_f1(spark, sf):
    best = calibrate.best_grid_f1(src.scores(spark, sf), 500)
    return rounded(best.select("candidate", "threshold", "f1"), "threshold", "f1")


_SPLIT_SCORES = TAGGED + ", scores AS (SELECT flow_id, value AS score, label FROM tagged WHERE split = 'val'), test AS (SELECT value AS score, label FROM tagged WHERE split = 'test')"


@query(f"""WITH {_SPLIT_SCORES}, b AS (SELECT min(score) AS lo, max(score) AS hi, (max(score) - min(score)) / 999 AS step FROM scores),
  cand AS (SELECT j, CASE WHEN j = 999 THEN hi ELSE lo + j * step END AS threshold FROM b, range(0, 1000) g(j)),
  c AS (SELECT j, threshold, {_AT} FROM (SELECT j, threshold, score > threshold AS hit, label FROM cand, scores) GROUP BY j, threshold),
  m AS (SELECT *, {_AT_RATES} FROM c), grid AS (SELECT *, {_f1()} AS f1 FROM m),
  tp95 AS (SELECT max(score) AS threshold FROM (SELECT score, (SELECT count(*) FROM scores s2 WHERE s2.label = 1 AND s2.score >= d.score) * 1.0 /
     (SELECT count(*) FROM scores WHERE label = 1) AS tpr FROM (SELECT DISTINCT score FROM scores) d) WHERE tpr >= 0.95),
  chosen AS (
   (SELECT 'f1_max' AS name, threshold FROM grid ORDER BY f1 DESC, j LIMIT 1) UNION ALL
   (SELECT 'precision_priority', threshold FROM grid WHERE precision >= 0.95 OR NOT EXISTS (SELECT 1 FROM grid WHERE precision >= 0.95)
     ORDER BY CASE WHEN EXISTS (SELECT 1 FROM grid WHERE precision >= 0.95) THEN recall ELSE precision END DESC, j LIMIT 1) UNION ALL
   (SELECT 'recall_priority', threshold FROM grid WHERE recall >= 0.95 ORDER BY precision DESC, j LIMIT 1) UNION ALL
   (SELECT 'security_constrained', threshold FROM grid WHERE recall >= 0.70 ORDER BY fpr, j LIMIT 1) UNION ALL
   SELECT 'tpr_95', threshold FROM tp95),
  t AS (SELECT name, threshold, {_AT} FROM (SELECT name, threshold, score > threshold AS hit, label FROM chosen, test) GROUP BY name, threshold), tm AS (SELECT *, {_AT_RATES} FROM t)
  SELECT name, {r('threshold')} AS threshold, tp, fp, fn, tn, {r('precision')} AS precision, {r('recall')} AS recall, {r(_f1())} AS f1, {r('fpr')} AS fpr FROM tm""")
def c10_operating_points(spark, sf):
    from undertow.plans.queries_prep import _tagged

    t = _tagged(spark, sf).withColumn("score", F.col("value"))
    out = calibrate.operating_points(t.filter("split = 'val'"), t.filter("split = 'test'"))
    return rounded(out.select("name", "threshold", "tp", "fp", "fn", "tn", *RATES), "threshold", *RATES)


@query(f"WITH {SCORES} SELECT {r('avg(score) + (2.5 / 3.0) * 2.0 * stddev_samp(score)')} AS threshold FROM scores WHERE label = 0")
def c11_rescale_threshold(spark, sf):
    return rounded(calibrate.rescale_threshold(src.scores(spark, sf).filter("label = 0"), 2.5), "threshold")


# --------------------------------------------------------------------------- metrics

_AUROC = "sum(neg * (tp - pos / 2.0)) / (max(p) * max(n))"
_AP = "sum(pos * precision) / max(p)"
_FPR95 = "coalesce(min(fpr) FILTER (recall >= 0.95), 1.0)"


@query(f"WITH {SWEEP}, c AS (SELECT {_AT}, count(*) AS sample_size FROM (SELECT score >= 50 AS hit, label FROM scores)), m AS (SELECT *, {_AT_RATES} FROM c), "
       f"k AS (SELECT {_AUROC} AS auroc, {_AP} AS ap, {_FPR95} AS fpr95 FROM sweep) "
       f"SELECT tp, fp, fn, tn, {r('precision')} AS precision, {r('recall')} AS recall, {r(_f1())} AS f1_score, {r('auroc')} AS auroc, {r('ap')} AS pr_auc, {r('fpr95')} AS fpr_at_95_tpr, sample_size FROM m, k")
def e01_classification_metrics(spark, sf):
    out = evaluate.classification_metrics(_decisions(spark, sf), "actual_label", "drift_score", "predicted_label")
    return rounded(out, "precision", "recall", "f1_score", "auroc", "pr_auc", "fpr_at_95_tpr")


@query(f"WITH {SWEEP} SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT threshold, {r('fpr')}, {r('recall')} FROM sweep")
def e02_roc_points(spark, sf):
    return rounded(evaluate.roc_points(src.scores(spark, sf)), "fpr", "tpr")


@query(f"WITH {SWEEP} SELECT {r(_AUROC)} AS auroc FROM sweep")
def e03_auroc(spark, sf):
    return rounded(evaluate.auroc(src.scores(spark, sf)), "auroc")


@query(f"WITH {SWEEP} SELECT {r(_AP)} AS pr_auc FROM sweep")
def e04_average_precision(spark, sf):
    return rounded(evaluate.average_precision(src.scores(spark, sf)), "pr_auc")


@query(f"WITH {SWEEP} SELECT {r(_FPR95)} AS fpr_at_tpr FROM sweep")
def e05_fpr_at_tpr(spark, sf):
    return rounded(evaluate.fpr_at_tpr(src.scores(spark, sf)), "fpr_at_tpr")


@query(f"WITH {SCORES}, p AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS rk, count(*) OVER () AS c FROM scores WHERE label = 1), "
       f"t AS (SELECT score AS threshold FROM p WHERE rk = floor(0.05 * c)) SELECT threshold, {r('avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END)')} AS fpr FROM scores, t WHERE label = 0 GROUP BY threshold")
def e06_fpr_at_pos_quantile(spark, sf):
    return rounded(evaluate.fpr_at_pos_quantile(src.scores(spark, sf)), "fpr")


@query(f"WITH {FLOWS}, t AS (SELECT entity_id, count(*) AS n, max(ts) - min(ts) AS s FROM flows GROUP BY 1) SELECT entity_id, n, "
       f"{r('CASE WHEN s > 0 THEN n / s ELSE 0.0 END', 9)} AS throughput_flows_sec, {r('CASE WHEN n > 0 THEN s / n * 1000.0 ELSE 0.0 END', 3)} AS latency_ms_per_flow FROM t")
def e07_rate_metrics(spark, sf):
    f = src.events(spark, sf).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), (F.max("ts") - F.min("ts")).alias("s"))
    out = rounded(evaluate.rate_metrics(f, "n", "s").drop("s"), "throughput_flows_sec", digits=9)
    return rounded(out, "latency_ms_per_flow", digits=3)


@query(f"WITH {SCORES}, w AS (SELECT row_number() OVER o AS idx, sum(1 - label) OVER o * 1.0 / sum(1 - label) OVER () AS fpr, sum(label) OVER o * 1.0 / sum(label) OVER () AS tpr FROM scores WINDOW o AS (ORDER BY score DESC, flow_id DESC)) "
       f"SELECT CAST(idx AS BIGINT) AS idx, {r('fpr')} AS fpr, {r('tpr')} AS tpr FROM w UNION ALL SELECT 0, 0.0, 0.0 UNION ALL SELECT count(*) + 1, 1.0, 1.0 FROM scores")
def e08_roc_coordinates(spark, sf):
    return rounded(evaluate.roc_coordinates(src.scores(spark, sf)), "fpr", "tpr")


@query(f"WITH {SWEEP} SELECT threshold, {r('precision')} AS precision, {r('recall')} AS recall FROM sweep")
def e09_pr_points(spark, sf):
    return rounded(evaluate.pr_points(src.scores(spark, sf)), "precision", "recall")


@query(f"WITH {SWEEP} SELECT threshold, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM sweep")
def e10_tradeoff_curve(spark, sf):
    return rounded(evaluate.tradeoff_curve(src.scores(spark, sf)), "precision", "recall", "f1")


@query(f"WITH {SCORES}, b AS (SELECT min(score) AS lo, (max(score) - min(score)) / 60 AS step FROM scores) SELECT label, CAST(least(floor((score - lo) / step), 59) AS INTEGER) AS bin, count(*) AS row_count, "
       f"{r('any_value(lo) + CAST(least(floor((score - lo) / step), 59) AS INTEGER) * any_value(step)')} AS lower FROM scores, b GROUP BY label, least(floor((score - lo) / step), 59)")
def e11_score_histogram(spark, sf):
    return rounded(evaluate.score_histogram(src.scores(spark, sf), 60), "lower")


@query(f"WITH {SCORES} SELECT label, count(*) AS n, {r('avg(score)')} AS mean, {r('stddev_pop(score)')} AS std, min(score) AS min, max(score) AS max, {r('median(score)')} AS median, "
       f"{r('quantile_cont(score, 0.95)')} AS p95, {r('quantile_cont(score, 0.99)')} AS p99 FROM scores GROUP BY label")
def e12_score_stats(spark, sf):
    return rounded(evaluate.score_stats(src.scores(spark, sf)), "mean", "std", "median", "p95", "p99")


@query(f"WITH {SCORES}, q AS (SELECT quantile_cont(score, 0.95) AS p95, median(score) AS med FROM scores WHERE label = 0) SELECT {r('any_value(p95)')} AS normal_p95, {r('any_value(med)')} AS normal_median, "
       f"{r('avg(CASE WHEN score < p95 THEN 1.0 ELSE 0.0 END)')} AS below_p95, {r('avg(CASE WHEN score < med THEN 1.0 ELSE 0.0 END)')} AS below_median FROM scores, q WHERE label = 1")
def e13_score_overlap(spark, sf):
    return rounded(evaluate.score_overlap(src.scores(spark, sf)), "normal_p95", "normal_median", "below_p95", "below_median")


@query(f"WITH {SWEEP} SELECT CAST(t AS DOUBLE) AS target_tpr, max(threshold) AS threshold, {r('arg_max(fpr, threshold)')} AS fpr, {r('arg_max(recall, threshold)')} AS tpr FROM sweep, (VALUES (0.9), (0.95), (0.99)) v(t) WHERE recall >= t GROUP BY t")
def e14_fpr_at_tprs(spark, sf):
    return rounded(evaluate.fpr_at_tprs(src.scores(spark, sf)), "fpr", "tpr")


@query("WITH t AS (SELECT l.doc_id, CAST(d.n_chars AS DOUBLE) AS score, l.toxic AS label FROM labels l JOIN documents d USING (doc_id)), "
       "c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM t GROUP BY 1), w AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c) "
       f"SELECT {r('sum(neg * (tp - pos / 2.0)) / (max(p) * max(n))')} AS auroc, {r('sum(pos * (tp * 1.0 / (tp + fp))) / max(p)')} AS pr_auc, {r('min(fp * 1.0 / n) FILTER (tp * 1.0 / p >= 0.95)')} AS fpr_at_tpr FROM w")
def e03_text_score_ranking(spark, sf):
    return rounded(evaluate.ranking_metrics(src.text_scores(spark, sf)), "auroc", "pr_auc", "fpr_at_tpr")


_KEPT = "{}(CASE WHEN NOT (event_type = 'click' AND value > 200) THEN abs(value - (value + (flow_id % 10) * 1e-7)) END)"


@query(f"WITH {FLOWS} SELECT count(*) AS row_count, CAST(count(*) FILTER (event_type = 'click' AND value > 200) AS BIGINT) AS unmatched, "
       f"{r(_KEPT.format('max'), 9)} AS max_abs_diff, {r(_KEPT.format('avg'), 9)} AS mean_abs_diff, "
       "count(*) FILTER (event_type = 'click' AND value > 200) = 0 AS passed FROM flows")
def e28_decision_parity(spark, sf):
    a = _decisions(spark, sf)
    kinds = src.events(spark, sf).select("flow_id", "event_type")
    b = a.join(kinds, "flow_id").filter("NOT (event_type = 'click' AND drift_score > 200)").withColumn("drift_score", F.col("drift_score") + (F.col("flow_id") % 10) * F.lit(1e-7))
    return rounded(evaluate.parity(a, b), "max_abs_diff", "mean_abs_diff", digits=9)


@query(f"WITH {SCORES}, d AS (SELECT *, score >= 50 AS hit FROM scores), c AS (SELECT flow_id, row_number() OVER o AS processed, CAST(sum(CAST(hit AND label=1 AS INT)) OVER o AS BIGINT) AS tp, "
       "CAST(sum(CAST(hit AND label=0 AS INT)) OVER o AS BIGINT) AS fp, CAST(sum(CAST(NOT hit AND label=1 AS INT)) OVER o AS BIGINT) AS fn, CAST(sum(CAST(NOT hit AND label=0 AS INT)) OVER o AS BIGINT) AS tn FROM d WINDOW o AS (ORDER BY ts, flow_id)), "
       "m AS (SELECT *, tp + fp AS anomalies, tp * 1.0 / greatest(tp + fp, 1) AS precision, tp * 1.0 / greatest(tp + fn, 1) AS recall FROM c) "
       f"SELECT flow_id, processed, tp, fp, fn, tn, anomalies, {r('precision')} AS precision, {r('recall')} AS recall, {r('2.0 * precision * recall / greatest(precision + recall, 1e-6)')} AS f1_score FROM m")
def r06_running_metrics(spark, sf):
    out = evaluate.running_metrics(_decisions(spark, sf), "actual_label")
    out = out.select("flow_id", "processed", "tp", "fp", "fn", "tn", "anomalies", "precision", "recall", "f1_score")
    return rounded(out, "precision", "recall", "f1_score")


@query(f"WITH {SCORES}, c AS (SELECT {_AT} FROM (SELECT score >= 50 AS hit, label FROM scores)), m AS (SELECT *, {_AT_RATES} FROM c) SELECT tp + fp + fn + tn AS total_processed, tp + fp AS total_anomalies, {r(_f1())} AS f1_score, "
       f"{r('precision')} AS precision, {r('recall')} AS recall, tp, fp, fn, tn FROM m")
def r07_stream_summary(spark, sf):
    return rounded(evaluate.stream_summary(_decisions(spark, sf), "actual_label"), "f1_score", "precision", "recall")
