"""Regressions fitted side by side against Spark's, and the temporal audit that stores states alone."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from undertow.operators import logistic, recurrent
from undertow.plans import queries_streaming, study
from undertow.session import cut_lineage


def table(spark, seed, n=600, width=12, scale=1.0, alike=0.0):
    rng = np.random.default_rng(seed)
    x = (np.sqrt(1 - alike) * rng.normal(size=(n, width)) + np.sqrt(alike) * rng.normal(size=(n, 1)) + 5) * scale
    x[:, 1] = 0.1
    y = rng.random(n) < 1 / (1 + np.exp(1 - x[:, 0] / scale + 5))
    rows = [(i, int(y[i]), x[i, :5].tolist(), x[i, 5:].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "flow_id long, label int, a array<double>, b array<double>").repartition(3)


def spark_fit(df, vec, n):
    rows = df.select(F.col("label").cast("double").alias("label"), array_to_vector(vec).alias("_x"))
    scale = StandardScaler(withMean=False, withStd=True, inputCol="_x", outputCol="_z")
    model = Pipeline(stages=[scale, LogisticRegression(featuresCol="_z", labelCol="label", regParam=1.0 / n, standardization=False, maxIter=500)]).fit(rows)
    std = np.array(model.stages[0].std.toArray())
    return model.stages[1].coefficients.toArray() * np.divide(1.0, std, out=np.zeros_like(std), where=std > 0), model.stages[1].intercept


@pytest.mark.parametrize("seed, scale, alike", [(1, 1.0, 0.0), (2, 100.0, 0.99), (3, 1e-3, 0.9)])
def test_fits_are_those_of_spark(spark, seed, scale, alike):
    df = cut_lineage(table(spark, seed, scale=scale, alike=alike))
    got = logistic.fit(logistic.Source(df, ["a", "b", "label"]), {"b": ("b",), "b_a": ("b", "a")})
    for name, vec in (("b", F.col("b")), ("b_a", F.concat("b", "a"))):
        weights, intercept = spark_fit(df, vec, 600)
        assert np.allclose(got[name].weights, weights, rtol=0, atol=1e-7 * np.abs(weights).max())
        assert np.isclose(got[name].intercept, intercept, rtol=1e-7)


def test_what_cannot_be_fitted(spark):
    one = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "label int, a array<double>")
    fit = lambda df: logistic.fit(logistic.Source(df, ["a", "label"]), {"a": ("a",)})["a"]
    assert fit(one).probability(np.ones((1, 1))).tolist() == [1.0]
    assert fit(one.withColumn("label", F.lit(0))).probability(np.ones((1, 1))).tolist() == [0.0]
    for bad in ("SELECT 2 AS label, array(1d) AS a", "SELECT CAST(NULL AS INT) AS label, array(1d) AS a", "SELECT 0 AS label, array(double('NaN')) AS a"):
        with pytest.raises(Exception, match="labels must be 0 or 1|features must be finite"):
            fit(spark.sql(bad))
    with pytest.raises(ValueError, match="at least one row"):
        fit(one.limit(0))


def test_changes_taken_where_rows_lie(spark):
    rng = np.random.default_rng(5)
    keys = [None] * 7 + ["a"] * 40 + ["b"] + ["c"] * 30 + ["d"] * 2
    rows = [(i, k, float(i // 2), rng.normal(size=2).tolist(), rng.normal(size=3).tolist()) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "flow_id long, entity_id string, ts double, h array<double>, z array<double>")
    wanted = {r["flow_id"]: r for r in recurrent.state_deltas(df, "h", "z").collect()}
    # eight partitions, so that keys lie across their borders and one key fills some
    laid = df.repartitionByRange(8, "entity_id", "ts", "flow_id").sortWithinPartitions("entity_id", "ts", "flow_id")
    laid = cut_lineage(laid.withColumn("_pid", F.spark_partition_id()))
    assert laid.select("_pid").distinct().count() > 4
    moved = recurrent.state_deltas(laid, "h", "z", laid="_pid")
    assert "Exchange" not in moved._jdf.queryExecution().executedPlan().toString()
    got = {r["flow_id"]: r for r in moved.collect()}
    assert got.keys() == wanted.keys() and all(got[k][c] == r[c] for k, r in wanted.items() for c in ("h_delta", "z_delta"))


def test_temporal_audit_stores_states_alone(spark, sf, monkeypatch):
    """Changes, joined vectors and copies for the fits were stored too; scores were stored for train rows and once per fit."""
    made = queries_streaming._encoded(spark, sf)
    stored = []

    def seen(df):
        stored.append(df)
        return cut_lineage(df)

    monkeypatch.setattr(study, "cut_lineage", seen)
    states = study.temporal_representations(*made, joined=False)
    found = {r["stage"]: r.asDict() for r in study.temporal_audit(states, fixed=True).collect()}
    vecs = [c for df in stored for c, kind in df.dtypes if kind.startswith(("array", "vector"))]
    assert sorted(vecs) == ["h", "z"] and len(stored) == 2
    assert {r["split"] for r in stored[1].select("split").distinct().collect()} == {"val", "test"}
    monkeypatch.undo()
    joined = cut_lineage(study.temporal_representations(*made))
    for name in ("dh", "all"):
        alone = study.diagnostic_classifier(joined, name, fixed=True).first().asDict()
        assert all(np.isclose(v, found[name][c], rtol=1e-6) for c, v in alone.items())
    again = {r["stage"]: r.asDict() for r in study.temporal_audit(joined, ("h", "all"), fixed=True).collect()}
    assert all(np.isclose(v, found[k][c], rtol=1e-6) for k, r in again.items() for c, v in r.items() if c != "stage")
