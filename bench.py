"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from undertow.operators import calibrate, encode, evaluate, ewma, manifold, prep, recurrent, scoring  # noqa: E402
from undertow.plans import flows as src  # noqa: E402
from undertow.session import build_session, cut_lineage  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WIDTH = int(os.environ.get("BENCH_WIDTH", "10000"))


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    rates: dict[str, float] = {}

    def timed(name: str, work, rows: int | None = None):
        start = time.perf_counter()
        out = work()
        times[name] = round(time.perf_counter() - start, 3)
        if rows:
            rates[name] = round(rows / times[name], 1)
        return out

    events, lines = src.events(spark, SF_DIR), src.lines(spark, SF_DIR)
    n_events, n_lines = events.count(), lines.count()
    drain(lines.mapInArrow(lambda it: it, lines.schema))  # start Python workers before timing

    timed("inter_arrival", lambda: drain(prep.with_dt(lines)), n_lines)
    tagged = timed("split_and_audit", lambda: cut_lineage(prep.split_entities(lines)), n_lines)
    model = timed("fit_encoder", lambda: encode.fit_encoder(tagged.filter("split = 'train'"), src.LINE_CATS, src.LINE_NUMS, WIDTH, 100))
    timed("record_encode", lambda: drain(encode.encode(tagged, model, packed=True, keep=["flow_id"])), n_lines)
    cell = recurrent.CfCCell.seeded(WIDTH, 64, 128)
    val = timed("encode_and_scan_val", lambda: cut_lineage(recurrent.encode_and_scan(tagged.filter("split = 'val'"), model, cell)))
    scorer = timed("fit_scorer", lambda: scoring.fit_base(val))
    scored = timed("score_val", lambda: cut_lineage(val.select("label", scoring.score(scorer, "h").alias("score"))))
    cut = timed("calibrate_f1_max", lambda: float(calibrate.calibrate(scored, "f1_max").first()["threshold"]))

    def detect():
        states = recurrent.encode_and_scan(tagged, model, cell)
        drain(scoring.decide(states.withColumn("score", scoring.score(scorer, "h")), cut).drop("h"))

    timed("detect_end_to_end", detect, n_lines)

    # the published region: state update, score and threshold over rows already encoded
    small = recurrent.CfCCell.seeded(len(src.LINE_NUMS), 64, 128)
    read = recurrent.columns_reader(src.LINE_NUMS, [0.02, 1e-5, 10.0, 10.0])
    narrow = timed("state_scan_64", lambda: cut_lineage(recurrent.state_scan(lines.select("flow_id", "entity_id", "ts", "label", *src.LINE_NUMS), small, read, keep=["flow_id", "label"], emit=("h",))), n_lines)
    base = manifold.fit_manifold(prep.normals(narrow), "h")
    timed("mahalanobis_64", lambda: drain(scoring.decide(narrow.withColumn("score", manifold.distance(base, "h")), cut).drop("h")), n_lines)

    timed("ewma_drift", lambda: drain(ewma.ewma_drift(events, "value")), n_events)
    timed("ewma_drift_lines", lambda: drain(ewma.ewma_drift(lines.select("flow_id", "entity_id", "ts", "l_quantity"), "l_quantity")), n_lines)
    scores = cut_lineage(lines.select("flow_id", F.col("l_extendedprice").alias("score"), "label"))
    timed("threshold_sweep_f1", lambda: calibrate.calibrate(scores, "f1_max").collect(), n_lines)
    timed("ranking_metrics", lambda: evaluate.ranking_metrics(scores).collect(), n_lines)
    timed("score_stats", lambda: evaluate.score_stats(scores).collect(), n_lines)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows_per_second": rates,
                "rows": {"lineitem": n_lines, "events": n_events},
                "width": WIDTH,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
