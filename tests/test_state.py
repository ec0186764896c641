import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.operators import encode, evaluate, ewma, recurrent
from undertow.operators.ewma import EwmaFold
from undertow.plans import experiment, study
from undertow.plans import flows as src
from undertow.streaming import live


def one_entity(spark, values):
    return spark.createDataFrame([(i, "E", float(i), float(v), 0) for i, v in enumerate(values)], "flow_id long, entity_id string, ts double, d double, label int")


def test_ewma_by_hand(spark):
    rows = ewma.ewma_drift(one_entity(spark, [1, 1, 1, 5]), "d", alpha=0.5, k=3.0).orderBy("ts").collect()
    assert [r["ewma_mean"] for r in rows] == [1, 1, 1, 3] and [r["ewma_var"] for r in rows] == [0, 0, 0, 4]
    assert [r["ewma_threshold"] for r in rows] == [1.0, 1, 1, 9] and not any(r["is_anomaly"] for r in rows)
    last = ewma.ewma_drift(one_entity(spark, [1, 1, 5]), "d", alpha=0.05, k=3.0).orderBy(F.col("ts").desc()).first()
    assert last["ewma_var"] == pytest.approx(0.76) and last["ewma_threshold"] == pytest.approx(3.815339, abs=1e-6) and last["is_anomaly"]


def test_first_verdict_needs_a_low_initial_threshold(spark):
    df = one_entity(spark, [2.0])
    assert not ewma.ewma_drift(df, "d", initial=1.0).first()["is_anomaly"]
    assert ewma.ewma_drift(df, "d", initial=0.5).first()["is_anomaly"]
    assert not ewma.ewma_drift(df, "d", initial=0.5, warmup=1).first()["is_anomaly"]


def test_batch_scan_equals_single_steps(spark):
    rng = np.random.default_rng(1)
    x, gaps = rng.normal(size=(4, 5, 128)), rng.uniform(0.1, 1.1, (4, 5))
    ts = np.cumsum(gaps, axis=1)
    rows = [(e * 5 + t, f"s{e}", float(ts[e, t]), [float(v) for v in x[e, t]]) for e in range(4) for t in range(5)]
    df = spark.createDataFrame(rows, "flow_id long, entity_id string, ts double, x array<double>")
    cell = recurrent.CfCCell.seeded(128, 64, 128)
    got = {r["flow_id"]: np.array(r["h"]) for r in recurrent.state_scan(df, cell, recurrent.vector_reader("x"), partitions=3).collect()}
    for e in range(4):
        h = np.zeros((1, 64))
        for t in range(5):
            dt = 0.0 if t == 0 else ts[e, t] - ts[e, t - 1]
            h, _ = cell.step(cell.project(x[e, t][None, :]), h, np.array([dt]))
            assert np.allclose(got[e * 5 + t], h[0], atol=1e-6)


def test_stream_of_one_entity(spark):
    df = one_entity(spark, [0.5, 0.7]).withColumn("ts", F.col("ts") + 100.0)
    stream = live.stream_flows(spark, live.stage_stream(df, chunks=2), df.schema, files_per_trigger=1)
    out = live.run_bounded(live.stream_state_scan(stream, recurrent.CfCCell.seeded(1, 4, 4), recurrent.columns_reader(["d"])), spark).orderBy("ts").collect()
    assert [r["dt"] for r in out] == [0.0, 1.0]


def test_stream_equals_batch_bit_for_bit(spark, sf):
    f = src.events(spark, sf).select("flow_id", "entity_id", "ts", "value")
    stream = live.stream_flows(spark, live.stage_stream(f), f.schema, files_per_trigger=1)
    a = live.run_bounded(live.stream_ewma(stream, "value", warmup=2), spark).select("flow_id", F.col("ewma_var").alias("drift_score"))
    b = ewma.ewma_drift(f, "value", warmup=2).select("flow_id", F.col("ewma_var").alias("drift_score"))
    row = evaluate.parity(a, b, tolerance=0.0).first()
    assert row["passed"] and row["row_count"] == f.count()


def test_late_rows_are_marked_not_folded(spark, sf):
    """A row older than what was already released comes out late, unless the engine dropped it before."""
    f = src.events(spark, sf).select("flow_id", "entity_id", "ts", "value")
    f = f.withColumns({"entity_id": F.lit("E"), "event_time": F.timestamp_micros((F.col("ts") * 1e6).cast("long"))})
    arrival = f.withColumn("arrival", F.when(F.col("flow_id") == 10, 10_000).otherwise(F.col("flow_id")))
    stream = live.stream_flows(spark, live.stage_stream(arrival, order="arrival"), arrival.schema, files_per_trigger=1).drop("arrival")
    out = live.run_bounded(live.stream_ewma(stream, "value", delay="10 minutes"), spark)
    folded = out.filter(~F.col("late"))
    assert folded.filter("flow_id = 10").count() == 0
    n, ids = out.agg(F.count(F.lit(1)), F.count_distinct("flow_id")).first()
    assert n == ids > 0
    batch = ewma.ewma_drift(f.drop("event_time").filter("flow_id <> 10"), "value").select("flow_id", F.col("ewma_mean").alias("m"))
    assert folded.join(batch, "flow_id").filter(F.abs(F.col("ewma_mean") - F.col("m")) > 1e-9).count() == 0


def test_projection_does_not_depend_on_the_batch(spark, sf):
    import pyarrow as pa

    f = src.events(spark, sf)
    model = encode.fit_encoder(f, src.ENCODER_CATS, src.EVENT_NUMS, 256, 64)
    looked = encode.lookup(f, model.vocabulary, model.cat_cols).limit(600).toPandas()
    batch = pa.RecordBatch.from_pandas(looked, preserve_index=False)
    cell = recurrent.CfCCell.seeded(256, 8, 16)
    whole = recurrent.encoder_reader(model).project(batch, cell.wx, cell.b)
    single = np.concatenate([recurrent.encoder_reader(model).project(batch.slice(i, 1), cell.wx, cell.b) for i in range(0, 600, 50)])
    assert np.array_equal(whole[::50], single)
    dense = cell.project(recurrent.encoder_reader(model)(batch).astype(float))
    assert np.allclose(whole, dense, atol=1e-4)


def test_small_experiment_and_modes(spark, sf):
    p = experiment.Params(tuple(src.ENCODER_CATS), tuple(src.EVENT_NUMS), width=128, levels=32, hidden=8, units=16)
    out = experiment.ablate(src.events(spark, sf), p, {"a": {}, "fusion": {"likelihood_ratio": True, "heads": ("fusion",)}, "cosine": {"mode": "cosine"}})
    rows = {r["variant"]: r for r in out.collect()}
    assert set(rows) == {"a", "fusion", "cosine"} and len({r["sample_size"] for r in rows.values()}) == 1


def test_families_follow_column_names():
    fams = study.families(["proto", "state", "flag"], ["sbytes", "spkts", "dur"])
    assert fams["TCP/state"] == (["state", "flag"], []) and fams["Bytes"] == ([], ["sbytes"]) and fams["Duration/timing"] == ([], ["dur"])


def test_every_row_of_a_shuffled_stream_comes_out(spark):
    """Null entities, a null time, rows behind the watermark: all are given back, each once."""
    rows = [(i, [None, "a", "b"][i % 3], float(i * 60), float(i % 9)) for i in range(300)] + [(1000, "a", None, 1.0)]
    df = spark.createDataFrame(rows, "flow_id long, entity_id string, ts double, value double")
    df = df.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    mixed = df.withColumn("arrival", F.when(F.col("flow_id") == 5, 1e9).otherwise(F.col("flow_id") - F.col("flow_id") % 7 * 2))
    path = live.stage_stream(mixed, order="arrival", chunks=3)
    live.end_stream(path, mixed.schema, spark)
    stream = live.stream_flows(spark, path, mixed.schema, files_per_trigger=1).drop("arrival")
    out = live.run_bounded(live.stream_ewma(stream, "value", delay="20 minutes"), spark)
    got = {r["flow_id"]: r for r in out.collect()}
    assert out.count() == len(got) == 301
    assert sorted(i for i, r in got.items() if r["late"]) == [5, 1000]
    want = ewma.ewma_drift(df.drop("event_time").filter("flow_id NOT IN (5, 1000)"), "value").collect()
    assert all(got[r["flow_id"]]["ewma_var"] == r["ewma_var"] for r in want)


def test_backlog_of_a_stream_equals_the_batch_one(spark):
    from undertow.operators import prep

    rows = [(i, f"e{i % 40}" if i % 11 else None, float(i % 50), 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "flow_id long, entity_id string, ts double, value double")
    for capacity in (1, 30, 1000):
        path = live.stage_stream(df, order="flow_id", chunks=3)
        live.end_stream(path, df.schema, spark)
        out = live.run_bounded(live.stream_backlog(live.stream_flows(spark, path, df.schema, files_per_trigger=1), capacity), spark)
        kept, dropped = live.settled_backlog(out, capacity)
        want, lost = prep.keep_latest(df, capacity)
        assert dropped == lost and {r["flow_id"] for r in kept.collect()} == {r["flow_id"] for r in want.collect()}


@pytest.mark.parametrize("kind", ["ssm", "conv"])
def test_projected_cells_equal_single_steps(spark, kind):
    rng = np.random.default_rng(4)
    rows = [(i, f"e{i % 3}" if i < 60 else "long", float(i), [float(v) for v in rng.normal(size=7)]) for i in range(200)]
    df = spark.createDataFrame(rows, "flow_id long, entity_id string, ts double, x array<double>")
    cell = recurrent.ProjectedCell.seeded(kind, 7, 4)
    got = {r["flow_id"]: r["h"] for r in recurrent.state_scan(df, cell, recurrent.vector_reader("x"), partitions=9).collect()}
    width = 4 * 16 if kind == "ssm" else 2 * 4
    state = {}
    for i, e, _, x in rows:
        state[e], y = cell.inner.step(cell.project(np.array([x])), state.get(e, np.zeros((1, width))))
        assert np.allclose(got[i], y[0], atol=1e-12)


def test_fused_geometry_and_information_loss(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, f"g{i % 3}", [float(v) for v in rng.normal(i % 2, 1, 5)], [float(i % 2)]) for i in range(120)] + [(500, 0, "lone", [0.0] * 5, [0.0])]
    df = spark.createDataFrame(rows, "flow_id long, label int, g string, a array<double>, b array<double>")
    got = {r["stage"]: r for r in study.fused_geometry(df, ["a", "b"]).collect()}
    x, y = np.array([r[3] for r in rows]), np.array([r[1] for r in rows])
    apart, spread = x[y == 1].mean(0) - x[y == 0].mean(0), [x[y == c].var(0).sum() for c in (0, 1)]
    assert got["a"]["centroid_dist"] == pytest.approx(np.linalg.norm(apart)) and got["a"]["var_att"] == pytest.approx(spread[1])
    assert got["b"]["centroid_dist"] == pytest.approx(1.0) and got["a"]["fdr"] == pytest.approx((apart**2).sum() / (sum(spread) + 1e-9))
    loss = {r["group"]: r["fdr"] for r in study.information_loss(df, "g", {"a": "a"}).collect()}
    assert set(loss) == {"g0", "g1", "g2", "lone"} and loss["lone"] == 0.0 and all(loss[g] > 0.2 for g in ("g0", "g1", "g2"))


def test_stage_cuts_in_one_pass_and_keeps_the_number_of_files(spark):
    import glob

    rows = [(i, "E1", None if i == 0 else float(i % 97), 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "flow_id long, entity_id string, ts double, d double")
    fixed = live.stage_stream(df, chunks=4, chunk_rows=None)
    assert len(glob.glob(f"{fixed}/*.parquet")) == 4
    grown = live.stage_stream(df, chunks=4, chunk_rows=50)
    files = sorted(glob.glob(f"{grown}/*.parquet"), key=os.path.getmtime)
    assert len(files) == 8
    times = [[r["ts"] for r in spark.read.parquet(f).collect()] for f in files]
    assert sorted((t for part in times for t in part), key=lambda t: -1 if t is None else t) == sorted((r[2] for r in rows), key=lambda t: -1 if t is None else t)
    assert None in times[0]
    known = [[t for t in part if t is not None] for part in times]
    assert all(max(a) < min(b) for a, b in zip(known, known[1:]))


def test_r07_feeds_four_files_whatever_the_rows(spark, sf, monkeypatch):
    from undertow.plans import queries_streaming as q

    monkeypatch.setattr(live.stage_stream, "__defaults__", ("ts", 4, 100))  # files of 100 rows: ten of them at sf0.001
    assert q.r07_stream_rates(spark, sf).first().asDict() == {"input_rows": 1000, "batches": 4, "rated": True}
