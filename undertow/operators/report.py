"""Tables over stored runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions import scalars as S

METRICS = ["f1_score", "precision", "recall", "auroc", "pr_auc", "fpr_at_95_tpr", "throughput_flows_sec"]


def macro_average(runs: DataFrame, metrics: list[str], maxima: list[str] = (), seed: str = "seed") -> DataFrame:
    """Mean over datasets per seed, then mean and sample deviation over seeds; maxima stay maxima."""
    per_seed = runs.groupBy(seed).agg(*[F.avg(m).alias(m) for m in metrics], *[F.max(m).alias(m) for m in maxima])
    return per_seed.agg(
        *[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
        *[F.max(m).alias(f"max_{m}") for m in maxima],
    )


def model_summary(runs: DataFrame, metrics: list[str], params: str = "params_m", model: str = "model") -> DataFrame:
    """Mean metrics per model, with F1 and recall per million parameters."""
    out = runs.groupBy(model).agg(*[F.avg(m).alias(m) for m in metrics], F.max(params).alias(params), F.count(F.lit(1)).alias("runs"))
    per = lambda c: F.when(F.col(params) > 0, F.col(c) / F.col(params)).otherwise(F.lit(0.0))
    return out.withColumns({"f1_per_m": per("f1_score"), "recall_per_m": per("recall")})


def comparison_table(runs: DataFrame, metrics: dict[str, int], search: str | None = None, order: str = "run_id") -> DataFrame:
    """Runs as text rows with fixed decimals; an optional search keeps run ids containing a text."""
    rows = runs.filter(F.lower("run_id").contains(search.lower())) if search else runs
    sort = F.col(order) if order == "run_id" else F.col(f"_{order}").desc()
    shown = rows.select("run_id", *[S.fmt_metric(m, d).alias(m) for m, d in metrics.items()], *([F.col(order).alias(f"_{order}")] if order != "run_id" else []))
    return shown.orderBy(sort, "run_id").select("run_id", *metrics)


def metric_grid(runs: DataFrame, metric: str, row: str = "dataset", column: str = "model", values: list[str] | None = None) -> DataFrame:
    """One metric by dataset and model. Without given values the models are read first (they are few)."""
    return runs.groupBy(row).pivot(column, values).agg(F.first(metric))


def dataset_summary(catalog: DataFrame, runs: DataFrame, key: str = "dataset") -> DataFrame:
    """Every known dataset with its run, or an error row; latency follows from throughput."""
    joined = catalog.join(runs, key, "full_outer")
    return joined.withColumns(
        {
            "status": F.when(F.col("f1_score").isNull(), "ERROR").otherwise("OK"),
            "latency_ms": F.when(F.col("throughput_flows_sec") > 0, 1000.0 / F.col("throughput_flows_sec")),
        }
    )


def assemble_report(runs: DataFrame, catalogue: DataFrame, keys: tuple[str, ...] = ("dataset", "model")) -> DataFrame:
    """Every run that the catalogue plans and every run there is, by a full outer join on the keys, null keys included.

    status is ok, missing (planned, not run) or unlisted (run, not planned). Columns of both tables keep their names;
    of a name in both, that of the run is taken first.
    """
    both = [c for c in catalogue.columns if c in runs.columns and c not in keys]
    planned = catalogue.select(*[F.col(c).alias(f"_p_{c}") for c in catalogue.columns], F.lit(True).alias("_planned"))
    done = runs.withColumn("_done", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_p_{k}"))
    out = done.join(planned, same, "full_outer")
    status = F.when(F.col("_done").isNull(), "missing").when(F.col("_planned").isNull(), "unlisted").otherwise("ok")
    key = [F.when(F.col("_done").isNull(), F.col(f"_p_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    rest = [F.coalesce(F.col(c), F.col(f"_p_{c}")).alias(c) if c in both else F.col(c) for c in runs.columns if c not in keys]
    more = [F.col(f"_p_{c}").alias(c) for c in catalogue.columns if c not in keys and c not in both]
    return out.select(*key, *rest, *more, status.alias("status"))


def report_grid(assembled: DataFrame, metric: str, columns: list[str], row: str = "dataset", column: str = "model", digits: int = 4, bold_from: float | None = None, absent: str = "-") -> DataFrame:
    """One metric as text, a row per dataset and a column per model asked for, every cell filled.

    A cell without a run shows `absent`; of several runs it shows the mean; from `bold_from` on it is set in bold.
    """
    shown = F.format_number(F.avg(metric), digits)
    cell = F.regexp_replace(shown, ",", "")
    if bold_from is not None:
        cell = F.when(F.avg(metric) >= bold_from, F.concat(F.lit("**"), cell, F.lit("**"))).otherwise(cell)
    grid = assembled.groupBy(row).pivot(column, columns).agg(cell)
    return grid.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(absent)).alias(c) for c in columns])


def error_taxonomy(errors: DataFrame, service: str = "service", attack: str | None = None) -> DataFrame:
    """Counts of false alarms by service and of misses by attack class, one column each."""
    s = F.lower(F.col(service))
    fp, fn = F.col("error_type") == "FP", F.col("error_type") == "FN"
    family = S.service_family(service)
    rule = (
        F.when(s.contains("dns"), "Probe")
        .when(s.contains("telnet") | s.contains("ftp"), "R2L")
        .when(F.col("entity_id") == "10.0.0.901", "Probe")
        .when(F.col("entity_id") == "10.0.0.902", "R2L")
        .otherwise("DoS")
    )
    missed = F.coalesce(S.attack_family(attack), rule) if attack else rule
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    return errors.agg(
        *[count(fp & (family == n)).alias(f"{n}_FP") for n in ("HTTP", "FTP", "Telnet", "DNS")],
        *[count(fn & (missed == n)).alias(f"{n}_FN") for n in ("Probe", "R2L", "DoS", "U2R")],
    )
