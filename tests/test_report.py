"""Reports over runs that are planned, done, or both."""

from undertow.operators import quality, report


def _tables(spark):
    runs = spark.createDataFrame([("a", "m", 0.5, "x"), ("a", "n", None, "y"), (None, "m", 0.25, "z"), ("b", "m", 0.75, None), ("b", "m", 0.85, "w")], "dataset string, model string, f1 double, note string")
    planned = spark.createDataFrame([("a", "m", "plan"), ("c", "m", "plan"), (None, "m", "plan"), ("b", "m", "plan")], "dataset string, model string, note string")
    return runs, planned


def test_assembly_keeps_what_is_missing_and_what_nobody_planned(spark):
    runs, planned = _tables(spark)
    got = report.assemble_report(runs, planned).collect()
    assert sorted((str(r["dataset"]), r["model"], r["status"], r["note"]) for r in got) == [
        ("None", "m", "ok", "z"), ("a", "m", "ok", "x"), ("a", "n", "unlisted", "y"), ("b", "m", "ok", "plan"), ("b", "m", "ok", "w"), ("c", "m", "missing", "plan")]


def test_grid_fills_every_cell(spark):
    runs, planned = _tables(spark)
    got = {r["dataset"]: tuple(r)[1:] for r in report.report_grid(report.assemble_report(runs, planned), "f1", ["m", "n", "never"], digits=2, bold_from=0.6).collect()}
    assert got == {"a": ("0.50", "-", "-"), None: ("0.25", "-", "-"), "b": ("**0.80**", "-", "-"), "c": ("-", "-", "-")}


def test_feature_report_finds_the_label_under_another_name(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (0, 0, 0.0), (None, None, 1.0)], "label int, copy int, x double")
    got = {r["feature"]: (r["forbidden"], r["agreeing"], r["row_count"]) for r in quality.feature_report(df, ["label", "copy", "x"]).collect()}
    assert got == {"label": (True, 3, 3), "copy": (False, 3, 3), "x": (False, 0, 3)}
