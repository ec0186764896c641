"""Order-dependent operators: exact under any partitioning, with a key that holds a third of the rows."""

import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.operators import ewma, ordered, recurrent
from undertow.plans import flows as src


@pytest.fixture(scope="module")
def hot(spark):
    f = src.events(spark, "/root/testdata/sf0.01").select("flow_id", "entity_id", "ts", "value", "label")
    return f.withColumn("entity_id", F.when(F.col("flow_id") % 3 == 0, "hot").otherwise(F.col("entity_id"))).cache()


@pytest.fixture(scope="module")
def hot_pdf(hot):
    return hot.toPandas().sort_values(["entity_id", "ts", "flow_id"]).reset_index(drop=True)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_prefix_sums_do_not_depend_on_partitions(hot, hot_pdf, partitions):
    out = ordered.prefix_sums(hot, ["value", "flow_id"], {"n": F.lit(1).cast("long"), "total": F.col("value")}, partitions)
    got = out.select("flow_id", "n", "total").toPandas().sort_values("n")
    want = hot_pdf.sort_values(["value", "flow_id"])
    assert got["flow_id"].tolist() == want["flow_id"].tolist()
    assert got["n"].tolist() == list(range(1, len(want) + 1))
    assert np.allclose(got["total"], want["value"].cumsum())


@pytest.mark.parametrize("rows_per_slice", [10**9, 700, 97])
def test_sliced_order_matches_plain_windows(hot, hot_pdf, rows_per_slice):
    out = ordered.sliced_order(
        hot, "entity_id", ["ts", "flow_id"], lags={"prev": "ts"}, row_number="rn", sums={"run": F.col("value")}, rows_per_slice=rows_per_slice
    ).toPandas().sort_values(["entity_id", "ts", "flow_id"])
    by = hot_pdf.groupby("entity_id")
    assert np.array_equal(out["prev"].fillna(-1), by["ts"].shift(1).fillna(-1))
    assert np.array_equal(out["rn"], by.cumcount() + 1)
    assert np.allclose(out["run"], by["value"].cumsum())


def _ewma_by_hand(values, alpha, k, warmup, initial=1.0):
    out, mean, var = [], 0.0, 0.0
    for n, d in enumerate(values, 1):
        if n == 1:
            mean, var, cut = d, 0.0, initial
            hit = d > cut if warmup == 0 and cut < 1.0 else False
        else:
            diff = d - mean
            mean, var = mean + alpha * diff, (1 - alpha) * (var + alpha * diff**2)
            cut = mean + k * var**0.5
            hit = n > warmup and d > cut
        out.append((mean, var, cut, hit))
    return out


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_scan_of_a_hot_key_equals_one_pass(hot, hot_pdf, partitions):
    out = ewma.ewma_drift(hot, "value", k=2.0, warmup=3, partitions=partitions).toPandas().sort_values(["entity_id", "ts", "flow_id"])
    want = np.array([r for _, g in hot_pdf.groupby("entity_id") for r in _ewma_by_hand(g["value"], 0.05, 2.0, 3)], dtype=float)
    assert np.allclose(out["ewma_mean"], want[:, 0], rtol=1e-12)
    assert np.allclose(out["ewma_var"], want[:, 1], rtol=1e-12)
    assert np.array_equal(out["is_anomaly"].astype(float), want[:, 3])


def memory_fold():
    class Memory(ordered.Fold):
        """A fold that never forgets: parity of all values so far and the first value. Guesses never converge early."""

        width = 3

        def inputs(self, batch):
            return (batch.column("flow_id").to_numpy(),)

        def step(self, state, rows):
            x = rows[0].astype(float)
            first = np.where(state[:, 2] > 0, state[:, 1], x)
            parity = (state[:, 0] + x) % 2
            return np.column_stack([parity, first, np.ones(len(x))]), [parity, first]

        def outputs(self, arrays):
            return [pa.array(a) for a in arrays]

    return Memory()


def test_scan_is_exact_for_a_fold_that_never_forgets(hot, hot_pdf):
    fields = [T.StructField("parity", T.DoubleType()), T.StructField("first", T.DoubleType())]
    out = ordered.carry_scan(hot, memory_fold(), fields, partitions=24).toPandas().sort_values(["entity_id", "ts", "flow_id"])
    by = hot_pdf.groupby("entity_id")["flow_id"]
    assert np.array_equal(out["parity"], by.cumsum() % 2)
    assert np.array_equal(out["first"], by.transform("first"))


def test_scan_of_a_single_key(spark, hot, hot_pdf):
    one = hot.withColumn("entity_id", F.lit("only"))
    out = recurrent.decay_state(one, "value", 0.001, partitions=8).toPandas().sort_values(["ts", "flow_id"])
    s, last, want = 0.0, None, []
    for ts, v in hot_pdf.sort_values(["ts", "flow_id"])[["ts", "value"]].to_numpy():
        s = v if last is None else np.exp(-0.001 * max(ts - last, 0)) * s + v
        last = ts
        want.append(s)
    assert np.allclose(out["decayed"], want, rtol=1e-10)


@pytest.mark.parametrize("limit", [200_000, 500, 20])
def test_quantiles_are_exact(hot, hot_pdf, limit):
    qs = [0.0, 0.013, 0.25, 0.5, 0.77, 0.95, 1.0]
    assert np.allclose(ordered.exact_quantiles(hot, "value", qs, limit), np.quantile(hot_pdf["value"], qs), rtol=1e-12)


def test_quantiles_with_one_heavy_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") / 10.0).alias("v"))
    v = df.toPandas()["v"]
    qs = [0.01, 0.05, 0.3, 0.5, 0.9]
    assert np.allclose(ordered.exact_quantiles(df, "v", qs, limit=50), np.quantile(v, qs))


def _odd_rows(spark):
    """Null keys, null and NaN times, and one time that most rows share."""
    rows = [(i, [None, "a", "b"][i % 3], [None, float("nan"), 7.0, 7.0, 7.0, 7.0, float(i)][i % 7], float(i % 5)) for i in range(210)]
    return spark.createDataFrame(rows, "flow_id long, entity_id string, ts double, value double")


@pytest.mark.parametrize("rows_per_slice", [1, 7, 97])
def test_sliced_order_cuts_the_whole_order(spark, rows_per_slice):
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id").orderBy("ts", "flow_id")
    for df in (_odd_rows(spark), _odd_rows(spark).withColumn("ts", F.lit(None).cast("double")), _odd_rows(spark).withColumn("ts", F.lit(3.0))):
        run = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
        want = df.select("flow_id", F.lag("flow_id").over(w).alias("p"), F.row_number().over(w).alias("n"), run.alias("r")).collect()
        got = ordered.sliced_order(df, "entity_id", ["ts", "flow_id"], lags={"p": "flow_id"}, row_number="n", sums={"r": F.col("value")}, rows_per_slice=rows_per_slice)
        assert sorted(tuple(r) for r in got.select("flow_id", "p", "n", "r").collect()) == sorted(tuple(r) for r in want)


def test_a_heavy_time_lies_on_many_slices(spark):
    df = _odd_rows(spark).withColumn("ts", F.lit(3.0))
    cut, _ = ordered._with_slices(df, ["ts", "flow_id"], 10)
    assert max(r["count"] for r in cut.groupBy("_slice").count().collect()) <= 20


@pytest.mark.parametrize("partitions", [1, 9, 64])
def test_null_keys_are_one_key_of_a_scan(spark, partitions):
    df = _odd_rows(spark).withColumn("ts", F.col("flow_id").cast("double"))
    named = df.withColumn("entity_id", F.coalesce("entity_id", F.lit("none")))
    for scan in (lambda d: recurrent.decay_state(d, "value", 0.1, partitions=partitions).select("flow_id", F.round("decayed", 9)),
                 lambda d: ewma.ewma_drift(d, "value", partitions=partitions).select("flow_id", F.round("ewma_mean", 9), F.round("ewma_var", 9)),
                 lambda d: ordered.carry_scan(d, memory_fold(), [T.StructField("parity", T.DoubleType()), T.StructField("first", T.DoubleType())], partitions=partitions).select("flow_id", "parity", "first")):
        assert sorted(map(tuple, scan(df).collect())) == sorted(map(tuple, scan(named).collect()))


def _jobs(spark, run) -> int:
    group = f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_affine_folds_of_one_key_take_a_fixed_number_of_jobs(spark, hot, hot_pdf):
    one = hot.withColumn("entity_id", F.lit("only"))
    pdf = hot_pdf.sort_values(["ts", "flow_id"])
    cell = recurrent.SSMCell.seeded(2, 3)
    read = recurrent.columns_reader(["value", "label"], [0.01, 1.0])
    scans = {
        "decay": lambda n: recurrent.decay_state(one, "value", 0.001, partitions=n),
        "ewma": lambda n: ewma.ewma_drift(one, "value", partitions=n),
        "ssm": lambda n: recurrent.state_scan(one, cell, read, partitions=n),
    }
    for name, scan in scans.items():
        counts = {n: _jobs(spark, lambda n=n: scan(n)) for n in (4, 64)}
        assert counts[4] == counts[64] <= 8, (name, counts)
    got = scans["ewma"](64).toPandas().sort_values(["ts", "flow_id"])
    want = np.array(_ewma_by_hand(pdf["value"], 0.05, 3.0, 0), dtype=float)
    assert np.allclose(got["ewma_mean"], want[:, 0], rtol=1e-12) and np.allclose(got["ewma_var"], want[:, 1], rtol=1e-11)
    state, ys = np.zeros((1, 6)), []
    for x in pdf[["value", "label"]].to_numpy(float) * [0.01, 1.0]:
        state, y = cell.step(x[None], state)
        ys.append(y[0])
    assert np.allclose(np.stack(scans["ssm"](64).toPandas().sort_values(["ts", "flow_id"])["y"]), ys, rtol=1e-10, atol=1e-12)
