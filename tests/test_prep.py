import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from undertow.functions import scalars as S
from undertow.operators import ordered, prep, quality
from undertow.session import shared_dir
from undertow.sources import readers, writers
from undertow.spec import CATALOG, KDD, ZEEK


def flows(spark, rows):
    return spark.createDataFrame([(i, e, float(t), l) for i, (e, t, l) in enumerate(rows)], "flow_id long, entity_id string, ts double, label int")


SIX = [("E1", 10, 0), ("E1", 5, 0), ("E1", 15, 0), ("E2", 20, 1), ("E2", 22, 1), ("E3", 30, 0)]


def test_split_is_disjoint_and_gaps_follow_time(spark):
    tagged = prep.split_entities(prep.with_dt(flows(spark, SIX)), (0.34, 0.33, 0.33))
    rows = tagged.orderBy("entity_id", "ts").collect()
    assert [r["dt"] for r in rows] == [0, 5, 5, 0, 2, 0]
    assert {len({r["split"] for r in rows if r["entity_id"] == e}) for e in ("E1", "E2", "E3")} == {1}
    assert {r["split"] for r in rows} == {"train", "val", "test"}
    report = quality.quality_report(tagged, []).collect()
    assert all(r["violations"] == 0 for r in report)
    quality.assert_no_leakage(tagged, ["dur"])


def test_leakage_is_refused(spark):
    bad = flows(spark, SIX).withColumn("split", F.when(F.col("ts") > 10, "test").otherwise("train"))
    with pytest.raises(ValueError):
        quality.assert_no_leakage(bad, ["dur"])
    with pytest.raises(ValueError):
        quality.audit_features(["dur", "attack_cat"])


@pytest.mark.parametrize("n,want", [(0, (0, 0)), (1, (1, 1)), (2, (1, 2)), (3, (1, 2)), (4, (2, 3)), (10, (7, 8)), (100, (70, 85))])
def test_cut_points(n, want):
    got = prep.cut_points(n, 0.70, 0.15)
    assert got == want


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        prep.split_map(flows(spark, SIX), (0.5, 0.2, 0.2))


def test_split_does_not_depend_on_partitions(spark, sf):
    from undertow.plans import flows as src

    f = src.events(spark, sf)
    a = {tuple(r) for r in prep.split_map(f).collect()}
    b = {tuple(r) for r in prep.split_map(f.repartition(7)).collect()}
    assert a == b


def test_injection(spark):
    base = spark.createDataFrame(
        [(0, "E1", 100.0, "tcp", 0.1, 0), (1, "E2", 200.0, "udp", 0.2, 0), (2, "E3", 300.0, "tcp", 0.3, 0)],
        "flow_id long, entity_id string, ts double, proto string, dur double, label int",
    )
    rows = prep.inject(base, ["proto"], ["dur"]).orderBy("ts").collect()
    assert len(rows) == 9 and sum(r["label"] for r in rows) == 6
    at = lambda e: [r["ts"] for r in rows if r["entity_id"] == e]
    assert at("10.0.0.901") == [110, 560, 1910] and at("10.0.0.902") == [120, 130, 135]
    assert len({r["flow_id"] for r in rows}) == 9


def test_injection_of_nothing(spark):
    empty = spark.createDataFrame([], "flow_id long, entity_id string, ts double, label int")
    assert prep.inject(empty, [], []).count() == 0


def test_labels(spark):
    cases = {" Normal ": 0, "BENIGN": 0, "": 0, None: 0, "nan": 0, "0.0": 0, "-": 0, "1": 1, "True": 1, "2.5": 1, "-1": 1, "neptune": 1}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(S.normalize_label("t")).collect()] == list(cases.values())


@pytest.mark.parametrize("n,starts", [(16, []), (17, [0]), (24, [0]), (25, [0, 8]), (33, [0, 8, 16])])
def test_window_starts(spark, n, starts):
    f = prep.with_dt(flows(spark, [("E", i, i % 2) for i in range(n)]))
    rows = prep.sequence_windows(f, "ts", 16).orderBy("start").collect()
    assert [r["start"] for r in rows] == starts
    for r in rows:
        assert r["x"] == [r["start"] + i for i in range(16)] and r["y"] == [v + 1 for v in r["x"]]


def test_window_fallback_to_single_steps(spark):
    f = prep.with_dt(flows(spark, [("A", 1, 0), ("B", 2, 1)]))
    assert prep.window_length(f) == 1
    assert prep.sequence_windows(f, "ts", 1).count() == 2


def test_backlog_keeps_the_newest(spark):
    f = spark.createDataFrame([(i, f"10.0.0.{i}", float(i)) for i in range(10)], "flow_id long, entity_id string, ts double")
    kept, dropped = prep.keep_latest(f, 5)
    assert dropped == 5 and kept.orderBy("ts").first()["entity_id"] == "10.0.0.5"


def test_hybrid_log(spark):
    path = f"{shared_dir(spark)}/hybrid-test"
    head = ",".join(ZEEK.columns[:20]) + ",tunnel_parents   label   detailed-label"
    line = lambda i, tail: ",".join([f"{i}.5", "u", f"192.168.0.{i}", "1", "r", "2", "tcp", "http", "0.5", "10"] + ["0"] * 10) + "," + tail
    lines = [head, "# note", "", line(1, "(empty)   Malicious   C&C"), line(2, "(empty)   Benign   -"), "   "]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    rows = readers.read_flows(spark, path, ZEEK).orderBy("flow_id").collect()
    assert [(r["flow_id"], r["entity_id"], r["ts"], r["label"]) for r in rows] == [(0, "192.168.0.1", 1.5, 1), (1, "192.168.0.2", 2.5, 0)]


def test_bom_missing_columns_and_synthetic_clock(spark):
    path = f"{shared_dir(spark)}/bom-test"
    lines = ["﻿duration,protocol_type,src_bytes,labels", "0.5,tcp,10,normal", ",udp,x,neptune"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    rows = readers.read_flows(spark, path, KDD).orderBy("flow_id").collect()
    assert [r["label"] for r in rows] == [0, 1]
    assert [r["entity_id"] for r in rows] == ["10.0.0.1", "10.0.0.2"]
    assert [round(r["ts"], 6) for r in rows] == [0.5, 0.501]
    assert rows[1]["src_bytes"] == 0.0 and rows[0]["flag"] == "-"


def test_row_numbers_over_many_splits(spark):
    path = f"{shared_dir(spark)}/splits-test"
    spark.range(20_000).select(F.lpad(F.col("id").cast("string"), 40, "0").alias("value")).coalesce(1).write.mode("overwrite").text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        numbered = readers.number_rows(readers._located(spark.read.text(path)))
        assert numbered.filter(F.col("value").cast("long") != F.col("flow_id")).count() == 0
        assert numbered.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_catalog_shapes():
    assert {k: (len(s.columns), len(s.cat_cols), len(s.num_cols)) for k, s in CATALOG.items()} == {
        "unsw_nb15": (45, 5, 37), "unsw_nb15_raw49": (49, 5, 36), "kdd": (42, 7, 34),
        "iot23": (23, 4, 8), "ton_iot": (45, 19, 21), "unsw_botnet": (35, 13, 19),
    }
    for s in CATALOG.values():
        assert set(s.cat_cols) | set(s.num_cols) <= set(s.columns)


def test_runs_skip_unreadable_files_and_refuse_overwrites(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "metrics.json").write_text(json.dumps({"f1_score": 0.5, "precision": 0.5, "recall": 0.5}))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "metrics.json").write_text("{ not json")
    runs = readers.read_runs(spark, f"{tmp_path}/*/metrics.json").collect()
    assert [(r["run_id"], r["f1_score"]) for r in runs] == [("good", 0.5)]
    with pytest.raises(FileExistsError):
        writers.write_run(str(tmp_path / "good"), {}, spark.range(1))


def test_sql_functions(spark):
    S.register_sql(spark)
    row = spark.sql(
        "SELECT normalize_label('neptune') a, safe_float('x') b, hd_bind(array(1,-1), array(-1,-1)) c, hd_bundle(array(array(1,-1), array(1,1))) d, "
        "hd_permute(array(1,2,3), 1) e, hd_hamming(5L, 3L) f, cosine_sim(array(1D,0D), array(1D,0D)) g, sax_symbol(0.0D) h, cef_alert('e', 1.5D, 2D, 1D) i"
    ).first()
    assert row[:8] == (1, 0.0, [-1, 1], [1, 1], [3, 1, 2], 2, 1.0, 4) and "rt=1500 driftScore=2.0000" in row["i"]


def test_first_line_after_many_comments(spark, tmp_path):
    from undertow.sources import readers

    (tmp_path / "log.csv").write_text("\n".join(["# note", "", "\t"] * 40 + ["a,b", "1,2"]))
    assert readers.first_line(spark, str(tmp_path)) == "a,b"
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "log.csv").write_text("# note\n\n")
    assert readers.first_line(spark, str(tmp_path / "none")) == ""


def test_flows_without_entity_keep_their_split(spark):
    rows = [(i, None if i % 5 == 0 else f"e{i % 7}", float(i), 0) for i in range(30)]
    f = spark.createDataFrame(rows, "flow_id long, entity_id string, ts double, label int")
    splits = prep.split_map(f)
    assert splits.count() == splits.select("entity_id").distinct().count() == 8
    tagged = prep.tag_split(f, splits)
    assert tagged.count() == 30 and tagged.columns == [*f.columns, "split"]
    assert tagged.filter("entity_id IS NULL").select("split").distinct().count() == 1
    assert prep.split_map(f.filter("entity_id IS NULL")).count() == 1


def test_shares_are_cut_exactly():
    assert prep.cut_points(90_000, 0.70, 0.15) == (63_000, 76_500)  # 0.7 * 90_000 is 62,999.99... in floats
    assert [ordered.share_of(n, s) for n, s in ((90, 0.7), (100, 0.29), (10, 0.6), (7, 0.5))] == [63, 29, 6, 3]


def test_a_log_in_several_files_is_read_in_path_order(spark, tmp_path):
    path = str(tmp_path / "log")
    (tmp_path / "log").mkdir()
    for name, lines in (("part-1", ["# only notes"]), ("part-2", ["head,line"]), ("part-3", ["x" * 500])):
        (tmp_path / "log" / name).write_text("\n".join(lines) + "\n")
    assert readers.first_line(spark, path) == "head,line"


def test_written_events_are_no_single_file(spark, sf):
    from undertow.plans import queries_io as q

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = q._write_csv(spark, sf, True)
        assert len(spark.read.text(path).inputFiles()) > 1
        got = {r["flow_id"]: r["service"] for r in readers.read_flows(spark, path, q.SPEC).collect()}
        row = q.s06_dataset_manifest(spark, sf).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    from undertow.plans import flows as src

    assert got == {r["flow_id"]: r["event_type"] for r in src.events(spark, sf).collect()}
    assert [(r["row_count"], r["columns_count"], r["hash_length"]) for r in row] == [(1000, 7, 64)]


def test_runs_are_written_from_rows_joined_once(spark, sf, monkeypatch):
    from undertow.plans import queries_io as q

    seen = []
    monkeypatch.setattr(q.writers, "write_run", lambda folder, config, metrics, decisions: seen.append(decisions))
    q._runs(spark, sf)
    assert seen and not any("Join" in d._jdf.queryExecution().optimizedPlan().toString() for d in seen)


def test_curriculum_computes_its_windows_once(spark):
    seen = spark.sparkContext.accumulator(0)
    hard = F.udf(lambda i: seen.add(1) or float(i % 3), "double")
    rows = spark.range(60).select(F.lit("E").alias("entity_id"), F.col("id").alias("start"), hard("id").alias("hardness"))
    assert prep.curriculum_sample(rows, 1).count() == 60
    assert seen.value == 60
