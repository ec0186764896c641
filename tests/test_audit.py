"""The audit of representations: they are at work at the same time, with the results of each alone."""

import threading

import numpy as np
import pytest

from undertow.plans import study
from undertow.session import side_by_side


def test_side_by_side_keeps_the_order_and_raises(spark):
    both = threading.Barrier(2)

    def meet(i):
        both.wait(30)
        return i

    assert side_by_side(spark, meet, [3, 1, 2, 0], at_once=2) == [3, 1, 2, 0]
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, lambda i: 1 // i, [1, 0])


def test_stage_audit_does_not_wait_for_one_representation_after_the_other(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, ("train", "train", "val", "test")[i % 4], int(i // 4 % 3 == 0), *(rng.normal(i // 4 % 3 == 0, 1, n).tolist() for n in (2, 3)), [0.0]) for i in range(160)]
    df = spark.createDataFrame(rows, "flow_id long, split string, label int, a array<double>, b array<double>, unread array<double>")
    alone = {k: study.stage_audit(df, (k,)).first().asDict() for k in "ab"}
    both, classify, stored = threading.Barrier(2), study.diagnostic_classifier, []

    def meet(data, name):
        both.wait(60)
        stored.append(data.columns)
        return classify(data, name)

    monkeypatch.setattr(study, "diagnostic_classifier", meet)
    found = {r["stage"]: r.asDict() for r in study.stage_audit(df, ("a", "b")).collect()}
    assert found.keys() == alone.keys() and all("unread" not in c for c in stored)
    for k, r in alone.items():
        assert all(v == found[k][c] if isinstance(v, str) else np.isclose(v, found[k][c], rtol=1e-9) for c, v in r.items())
