"""What the physical plans must and must not contain."""

import io
import re
from contextlib import redirect_stdout
from pathlib import Path

from pyspark.sql import functions as F

from undertow.operators import encode, evaluate, prep
from undertow.plans import flows as src


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_gap_needs_one_shuffle(spark, sf):
    assert len(re.findall(r"^\(\d+\) Exchange", plan(prep.with_dt(src.events(spark, sf))), re.M)) == 1


def test_small_tables_are_broadcast_and_nothing_is_crossed(spark, sf):
    f = src.events(spark, sf)
    text = plan(prep.tag_split(f, prep.split_map(f)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    model = encode.fit_encoder(f, src.ENCODER_CATS, src.EVENT_NUMS, 64, 32)
    text = plan(encode.encode(f, model, keep=["flow_id"]))
    assert text.count("BroadcastHashJoin LeftOuter") >= 2
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_large_side_is_not_broadcast(spark, sf):
    from undertow.session import broadcast_if_small

    f = src.events(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(f.join(broadcast_if_small(f.select("flow_id"), max_rows=10), "flow_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scans_read_only_needed_columns(spark, sf):
    text = plan(prep.normals(src.events(spark, sf)).select("flow_id", "value"))
    schema = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "props" not in schema and "user_id" not in schema
    assert "PushedFilters" in text and "event_type" in text


def test_confusion_is_one_pass_with_partial_sums(spark, sf):
    text = plan(evaluate.metrics_at(src.scores(spark, sf), 50.0))
    assert text.count("HashAggregate") >= 2 and "partial_sum" in text


def test_no_forbidden_calls():
    for path in Path(__file__).parent.parent.joinpath("undertow").rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text and ".toPandas(" not in text, path
