"""Queries that run as streams over replayed event files, checked against the batch results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertow.operators import encode, evaluate, recurrent, scoring
from undertow.plans import experiment, study
from undertow.plans import flows as src
from undertow.plans.queries_prep import STATES, _CEF, _decisions, _tagged
from undertow.plans.queries_vectors import _READ, _cfc_sql, _HID, _small_cell, _small_states, ewma_sql, fitted
from undertow.plans.registry import FLOWS, SCORES, query, r, r6, rounded
from undertow.session import shared_dir
from undertow.streaming import live

_COLS = ["flow_id", "entity_id", "ts", "value", "k", "label"]


def _stream(spark, sf, cols=_COLS, **kw):
    f = src.events(spark, sf).select(*cols)
    return live.stream_flows(spark, live.stage_stream(f, **kw), f.schema, files_per_trigger=1)


@query(f"WITH {FLOWS} SELECT flow_id, entity_id, value FROM flows")
def s12_stream_source(spark, sf):
    return live.run_bounded(_stream(spark, sf).select("flow_id", "entity_id", "value"), spark)


@query(_cfc_sql() + f" SELECT flow_id, {r('h[1]')} AS h1, {r('h[2]')} AS h2, {r('h[3]')} AS h3, {r('h[4]')} AS h4, {r('dt')} AS dt FROM walk WHERE rn > 0")
def t04_stream_state_scan(spark, sf):
    out = live.run_bounded(live.stream_state_scan(_stream(spark, sf), _small_cell(), _READ), spark)
    return out.select("flow_id", *[r6(F.col("h")[i]).alias(f"h{i + 1}") for i in range(_HID)], r6("dt").alias("dt"))


@query(ewma_sql(warmup=3, value="ln(1 + value)") + f" SELECT flow_id, {r('mean')} AS ewma_mean, {r('threshold')} AS ewma_threshold, hit AS is_anomaly FROM walk")
def r04_stream_ewma(spark, sf):
    s = _stream(spark, sf).withColumn("value", F.log1p("value"))
    out = live.run_bounded(live.stream_ewma(s, "value", warmup=3), spark)
    return rounded(out.select("flow_id", "ewma_mean", "ewma_threshold", "is_anomaly"), "ewma_mean", "ewma_threshold")


@query(f"WITH {FLOWS} SELECT {_CEF} AS line FROM flows WHERE value >= 50")
def r05_route_alerts(spark, sf):
    s = _stream(spark, sf).withColumns({"drift_score": F.col("value"), "threshold": F.lit(50.0), "is_anomaly": F.col("value") >= 50})
    return live.run_bounded(live.route_alerts(s).select("line"), spark)


@query(f"WITH {FLOWS} SELECT {_CEF} AS value FROM flows WHERE value >= 50")
def s13_alert_sink(spark, sf):
    import uuid

    from undertow.sources import writers

    base = f"{shared_dir(spark)}/alerts-{uuid.uuid4().hex}"
    s = _stream(spark, sf).withColumns({"drift_score": F.col("value"), "threshold": F.lit(50.0), "is_anomaly": F.col("value") >= 50})
    writers.write_alerts(s, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.text(f"{base}/out")


def _decided(df):
    return df.select("entity_id", F.timestamp_micros((F.col("ts") * 1e6).cast("long")).alias("event_time"), (F.col("value") >= 50).alias("is_anomaly"), F.col("value").alias("drift_score"))


def _shown(df):
    return df.select("entity_id", F.unix_seconds("window_start").alias("window_start"), "row_count", "alerts", "max_score")


_TUMBLING = f"WITH {FLOWS} SELECT entity_id, CAST(floor(floor(ts) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS row_count, count(*) FILTER (value >= 50) AS alerts, max(value) AS max_score FROM flows GROUP BY 1, 2"
_SLIDING = f"WITH {FLOWS}, w AS (SELECT *, CAST((floor(floor(ts) / 1800) - j) * 1800 AS BIGINT) AS window_start FROM flows, range(0, 2) g(j)) SELECT entity_id, window_start, count(*) AS row_count, count(*) FILTER (value >= 50) AS alerts, max(value) AS max_score FROM w GROUP BY 1, 2"
_SESSION = f"""WITH {FLOWS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < 1800 THEN 0 ELSE 1 END AS fresh FROM flows WINDOW w AS (PARTITION BY entity_id ORDER BY ts, flow_id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY entity_id ORDER BY ts, flow_id) AS sid FROM g)
 SELECT entity_id, CAST(floor(min(ts)) AS BIGINT) AS window_start, count(*) AS row_count, count(*) FILTER (value >= 50) AS alerts, max(value) AS max_score FROM s GROUP BY entity_id, sid"""


@query(_TUMBLING)
def r11_tumbling_windows(spark, sf):
    return _shown(live.alert_windows(_decided(src.events(spark, sf)), "1 hour"))


@query(_SLIDING)
def r11_sliding_windows(spark, sf):
    return _shown(live.alert_windows(_decided(src.events(spark, sf)), "1 hour", slide="30 minutes"))


@query(_SESSION)
def r11_session_windows(spark, sf):
    return _shown(live.alert_windows(_decided(src.events(spark, sf)), "", gap="30 minutes"))


def _windows_of_stream(spark, sf, **frame):
    """Windows in append mode; a row far behind the last one moves the watermark past all of them."""
    d = _decided(src.events(spark, sf))
    path = live.stage_stream(d, order="event_time", chunks=4)
    far = d.agg(F.max("event_time") + F.expr("INTERVAL 30 days")).first()[0]
    live.end_stream(path, d.schema, spark, buckets=1, event_time=far)
    stream = live.stream_flows(spark, path, d.schema, files_per_trigger=1)
    return _shown(live.run_bounded(live.stream_alert_windows(stream, "10 minutes", **frame), spark))


@query(_TUMBLING)
def r11_stream_tumbling(spark, sf):
    return _windows_of_stream(spark, sf, size="1 hour")


@query(_SLIDING)
def r11_stream_sliding(spark, sf):
    return _windows_of_stream(spark, sf, size="1 hour", slide="30 minutes")


@query(_SESSION)
def r11_stream_sessions(spark, sf):
    return _windows_of_stream(spark, sf, gap="30 minutes")


def _replayed(spark, mixed, **kw):
    """Rows in order of `arrival`, then the end of the stream, through the reordering scan."""
    path = live.stage_stream(mixed, order="arrival")
    live.end_stream(path, mixed.schema, spark)
    s = live.stream_flows(spark, path, mixed.schema, files_per_trigger=1).drop("arrival")
    return live.run_bounded(live.stream_ewma(s, "value", delay="2 days", **kw), spark)


def _with_event_time(f):
    return f.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))


def _released(out):
    return rounded(out.select("flow_id", "ewma_mean", "ewma_var", "is_anomaly", "late"), "ewma_mean", "ewma_var")


@query(ewma_sql(warmup=3, value="ln(1 + value)") + f" SELECT flow_id, {r('mean')} AS ewma_mean, {r('var')} AS ewma_var, hit AS is_anomaly, FALSE AS late FROM walk")
def r10_reordered_parity(spark, sf):
    """Events replayed with each block of ten reversed: every row comes out once, with the numbers of the ordered pass."""
    f = _with_event_time(src.events(spark, sf).select("flow_id", "entity_id", "ts", F.log1p("value").alias("value")))
    mixed = f.withColumn("arrival", F.floor(F.col("flow_id") / 10) * 10 + 9 - F.col("flow_id") % 10)
    return _released(_replayed(spark, mixed, warmup=3))


#: Every 50th event of the first fifth of the time comes with the last ones.
_LATE = "flow_id % 50 = 7 AND ts < (SELECT min(ts) + 0.2 * (max(ts) - min(ts)) FROM flows)"


@query(ewma_sql(warmup=3, value="ln(1 + value)").replace("FROM flows)", f"FROM flows WHERE NOT ({_LATE}))", 1)
       + f" SELECT flow_id, {r('mean')} AS ewma_mean, {r('var')} AS ewma_var, hit AS is_anomaly, FALSE AS late FROM walk UNION ALL SELECT flow_id, NULL, NULL, NULL, TRUE FROM flows WHERE {_LATE}")
def r10_late_rows(spark, sf):
    """Rows that come after their time was released are given back as late; the others are folded as if they had never been."""
    f = _with_event_time(src.events(spark, sf).select("flow_id", "entity_id", "ts", F.log1p("value").alias("value")))
    lo, hi = f.agg(F.min("ts"), F.max("ts")).first()
    late = (F.col("flow_id") % 50 == 7) & (F.col("ts") < lo + 0.2 * (hi - lo))
    return _released(_replayed(spark, f.withColumn("arrival", F.when(late, hi + 1).otherwise(F.col("ts"))), warmup=3))


@query(f"WITH {FLOWS} SELECT flow_id, entity_id, value, (SELECT greatest(count(*) - 500, 0) FROM flows) AS dropped FROM flows QUALIFY row_number() OVER (ORDER BY ts DESC, flow_id DESC) <= 500")
def d19_stream_backlog(spark, sf):
    f = src.events(spark, sf).select("flow_id", "entity_id", "ts", "value")
    path = live.stage_stream(f)
    live.end_stream(path, f.schema, spark)
    out = live.run_bounded(live.stream_backlog(live.stream_flows(spark, path, f.schema, files_per_trigger=1), 500), spark)
    kept, dropped = live.settled_backlog(out, 500)
    return kept.select("flow_id", "entity_id", "value", F.lit(dropped).cast("long").alias("dropped"))


@query(f"WITH {FLOWS} SELECT count(*) AS input_rows, CAST(4 AS BIGINT) AS batches, TRUE AS rated FROM flows")
def r07_stream_rates(spark, sf):
    """Progress of a bounded stream of four files, from the listener's table."""
    with live.rate_table(spark) as listener:
        live.run_bounded(_stream(spark, sf, chunks=4, chunk_rows=None), spark)
    fed = listener.rates().filter("input_rows > 0")
    rated = (F.col("processed_rate") > 0) & (F.col("duration_ms") > 0)
    return fed.agg(F.sum("input_rows").alias("input_rows"), F.count_distinct("batch_id").alias("batches"), F.every(rated).alias("rated"))


@query(_cfc_sql() + f", s AS (SELECT flow_id, h[1] + 2.0 * h[2] AS score FROM walk WHERE rn > 0) SELECT flow_id, {r('score')} AS drift_score, round(score, 6) >= 0.05 AS is_anomaly, 'linear' AS scoring_mode FROM s")
def r01_live_decisions(spark, sf):
    """State, score and verdict of a stream, with weights that SQL can follow."""
    states = live.stream_state_scan(_stream(spark, sf), _small_cell(), _READ, keep=["flow_id", "entity_id", "ts"])
    scored = states.withColumn("score", F.round(F.col("h")[0] + 2.0 * F.col("h")[1], 6))
    out = live.run_bounded(scoring.decide(scored, 0.05, mode="linear").select("flow_id", "drift_score", "is_anomaly", "scoring_mode"), spark)
    return rounded(out, "drift_score")


@query("SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS unmatched, TRUE AS passed FROM events")
def r09_batch_stream_parity(spark, sf):
    out = live.run_bounded(live.stream_state_scan(_stream(spark, sf), _small_cell(), _READ), spark)
    score = lambda d: d.select("flow_id", (F.col("h")[0] + F.col("h")[1] * 2).alias("drift_score"))
    return evaluate.parity(score(out), score(_small_states(spark, sf))).select("row_count", "unmatched", "passed")


@query(f"WITH {SCORES} SELECT count(*) FILTER (score >= 50 AND label=1) AS tp, count(*) FILTER (score >= 50 AND label=0) AS fp, count(*) FILTER (score < 50 AND label=1) AS fn, count(*) FILTER (score < 50 AND label=0) AS tn FROM scores")
def r06_stream_running_totals(spark, sf):
    """Last complete-mode totals of a decision stream."""
    import uuid

    s = _stream(spark, sf).withColumn("is_anomaly", F.col("value") >= 50)
    base = f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}"
    keep = lambda df, batch_id: df.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/out")
    q = live.running_totals(s).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    stored = spark.read.parquet(f"{base}/out")
    return stored.orderBy(F.col("batch").desc()).limit(1).select("tp", "fp", "fn", "tn")


# --------------------------------------------------------------------------- end to end


def _params(**kw):
    base = dict(cat_cols=tuple(src.ENCODER_CATS), num_cols=tuple(src.EVENT_NUMS), width=512, levels=64, hidden=16, units=32, method="f1_max")
    return experiment.Params(**{**base, **kw})


@query(None)
def run_experiment(spark, sf):
    """Flows to split, encoding, state, manifold, calibrated threshold and test metrics."""
    _, _, metrics = experiment.run(src.events(spark, sf), _params(likelihood_ratio=True))
    return metrics


@query(None)
def r01_live_scoring_parity(spark, sf):
    """The stream's decisions equal the batch decisions on the test split."""
    p = _params(width=128, levels=32)
    tagged = experiment.prepare(src.events(spark, sf), p)
    trained = experiment.train(tagged, p)
    batch = experiment.score_split(tagged, "test", trained)
    test = tagged.filter("split = 'test'").drop("split")
    s = live.stream_flows(spark, live.stage_stream(test), test.schema, files_per_trigger=1)
    out = live.run_bounded(live.live_score(s, trained.encoder, trained.cell, trained.scorer, trained.threshold), spark)
    return evaluate.parity(out.select("flow_id", "drift_score"), batch.select("flow_id", "drift_score")).select("row_count", "unmatched", "passed")


@query(None)
def e31_ablation(spark, sf):
    variants = {"cfc": {}, "lstm": {"cell": "lstm"}, "state_space": {"cell": "ssm"}, "convolution": {"cell": "conv"}, "vector_only": {"cell": "none", "width": 1200}, "cosine": {"mode": "cosine"}, "autoencoder": {"mode": "autoencoder"}}
    out = experiment.ablate(src.events(spark, sf), _params(width=128, levels=32), variants)
    return out.select("variant", "f1_score", "auroc", "sample_size")


def _state_splits(spark, sf):
    st = src.states(spark, sf)
    return st.withColumn("split", F.when(F.col("flow_id") % 10 < 5, "train").when(F.col("flow_id") % 10 < 8, "val").otherwise("test"))


@query(None)
def e18_diagnostic_classifier(spark, sf):
    return study.diagnostic_classifier(_state_splits(spark, sf), "h")


@query(None)
def e19_family_audit(spark, sf):
    t = _tagged(spark, sf).select("flow_id", "split", "label", F.col("weekday").alias("proto"), F.col("hour").alias("state"), F.col("value").alias("sbytes"), F.col("k").alias("dur"))
    return study.family_audit(t, ["proto", "state"], ["sbytes", "dur"]).select("family", "f1", "auroc")


_ROLES = dict(duration="value", count="k", rate="k", size="value", proto="weekday", service="hour")


def _encoded(spark, sf):
    p = _params(width=128, levels=32, cat_cols=("hour", "weekday"))
    tagged = experiment.prepare(src.events(spark, sf), p)
    return tagged, encode.fit_encoder(tagged.filter("split = 'train'"), p.cat_cols, p.num_cols, p.width, p.levels), experiment.make_cell(p)


@query(None)
def e20_stage_audit(spark, sf):
    """All nine stages from raw features to the final score."""
    return study.stage_audit(study.representations(*_encoded(spark, sf), _ROLES))


@query(None)
def e20_temporal_audit(spark, sf):
    return study.temporal_audit(study.temporal_representations(*_encoded(spark, sf), joined=False), fixed=True)


_REPS = {"raw": "[value, k]", "raw_interactions": "[value, k, value * k, k * k]", "z": "z", "h": "h", "h_z": "list_concat(h, z)", "dh": "dh", "h_dh": "list_concat(h, dh)", "all": "list_concat(z, h, dz, dh)"}


@query(_cfc_sql() + ", m AS (SELECT a.flow_id, a.h, a.z, list_transform(a.h, lambda v, i: v - coalesce(b.h[i], 0.0)) AS dh, list_transform(a.z, lambda v, i: v - CASE WHEN b.rn > 0 THEN b.z[i] ELSE 0.0 END) AS dz "
       "FROM walk a JOIN walk b ON a.entity_id = b.entity_id AND a.rn = b.rn + 1), x AS (SELECT m.*, f.value, f.k, f.label FROM m JOIN flows f USING (flow_id)), reps AS ("
       + " UNION ALL ".join(f"SELECT '{n}' AS stage, label, {e} AS v FROM x" for n, e in _REPS.items())
       + "), c AS (SELECT stage, i, avg(v[i]) FILTER (label = 0) AS m0, avg(v[i]) FILTER (label = 1) AS m1, var_pop(v[i]) FILTER (label = 0) AS v0, var_pop(v[i]) FILTER (label = 1) AS v1 FROM reps, range(1, 65) t(i) WHERE i <= len(v) GROUP BY 1, 2), "
       "g AS (SELECT stage, sqrt(sum((m1 - m0) ** 2)) AS d, sum(v0) AS v0, sum(v1) AS v1 FROM c GROUP BY stage) "
       f"SELECT stage, {r('d')} AS centroid_dist, {r('v0', 3)} AS var_norm, {r('v1', 3)} AS var_att, {r('d * d / (v0 + v1 + 1e-9)')} AS fdr FROM g")
def e20_stage_geometry(spark, sf):
    """Geometry of raw, interacting and temporal representations, all in one pass, where SQL can follow the state."""
    f = src.events(spark, sf).select("flow_id", "entity_id", "ts", "value", "k", "label")
    d = recurrent.state_deltas(recurrent.state_scan(f, _small_cell(), _READ), "h", "z")
    value, k = F.col("value"), F.col("k")
    reps = d.select(
        "label", F.array(value, k).alias("raw"), F.array(value, k, value * k, k * k).alias("raw_interactions"), "z", "h", F.concat("h", "z").alias("h_z"),
        F.col("h_delta").alias("dh"), F.concat("h", "h_delta").alias("h_dh"), F.concat("z", "h", "z_delta", "h_delta").alias("all"))
    return rounded(rounded(study.fused_geometry(reps, list(_REPS)), "centroid_dist", "fdr"), "var_norm", "var_att", digits=3)


@query(None)
def e21_upper_bound(spark, sf):
    return study.upper_bound(_state_splits(spark, sf), "h", trees=5, depth=3)


@query(None)
def e30_manifold_study(spark, sf):
    return study.manifold_study(_state_splits(spark, sf))


_HALF = "CASE WHEN flow_id % 2 = 0 THEN 'even' ELSE 'odd' END"


@query(f"WITH {STATES}, c AS (SELECT {_HALF} AS g, i, avg(h[i]) FILTER (label=0) AS m0, avg(h[i]) FILTER (label=1) AS m1, var_pop(h[i]) FILTER (label=0) AS v0, var_pop(h[i]) FILTER (label=1) AS v1 FROM states, range(1, 65) t(i) GROUP BY 1, 2), "
       f"f AS (SELECT g, sum((m1 - m0) ** 2) / (sum(v0) + sum(v1) + 1e-9) AS fdr FROM c GROUP BY g) SELECT g AS \"group\", 'h' AS stage, {r('fdr')} AS fdr, CASE WHEN fdr >= 2.0 THEN 'clearly separable' WHEN fdr >= 0.8 THEN 'weakly separable' WHEN fdr >= 0.2 THEN 'strong overlap' ELSE 'indistinguishable' END AS verdict FROM f")
def e15_information_loss(spark, sf):
    st = src.states(spark, sf).withColumn("half", F.when(F.col("flow_id") % 2 == 0, "even").otherwise("odd"))
    return rounded(study.information_loss(st, "half", {"h": "h"}), "fdr")
