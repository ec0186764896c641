"""Slices of one key: null keys, null times and ties give the same rows at any slice size."""

import pytest
from pyspark.sql import functions as F

from undertow.operators import ordered


@pytest.mark.parametrize("per_slice", [1, 7, 97])
def test_sliced_order_loses_no_row(spark, per_slice):
    rows = [(i, None if i % 10 == 0 else f"e{i % 3}", None if i % 17 == 0 else float(i // 4), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "flow_id long, entity_id string, ts double, v double")

    def run(n):
        out = ordered.sliced_order(df, "entity_id", ["ts", "flow_id"], lags={"before": "v"}, row_number="rn", sums={"total": F.col("v")}, rows_per_slice=n)
        return sorted((r["flow_id"], r["entity_id"] or "", r["ts"] is None, r["before"], r["rn"], r["total"]) for r in out.collect())

    whole = run(1000)
    assert len(whole) == 100
    assert run(per_slice) == whole
