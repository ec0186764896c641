"""Session helpers: the shared checkpoint folder, lineage cuts, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

# Rows up to which a side of a join is small enough to hint for broadcast.
BROADCAST_ROWS = 100_000

# Pieces of work on the driver that send their jobs at the same time.
AT_ONCE = 6


def build_session(app: str = "undertow", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files go once nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once, so that Python tasks can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_undertow_shipped", False):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="undertow-code-"), "undertow_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("undertow", os.path.relpath(path, package)))
    context.addPyFile(archive)
    # the helper process that sets up stateful streams on the driver reads only this variable
    known = context.environment.get("PYTHONPATH", "")
    context.environment["PYTHONPATH"] = archive + (os.pathsep + known if known else "")
    context._undertow_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only for local sessions without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="undertow-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that later passes see the very same partitions."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when the frame has at most max_rows rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a frame whose size was checked; else the planner shuffles."""
    return F.broadcast(df) if is_small(df, max_rows) else df



def side_by_side(spark: SparkSession, work: Callable, items: Iterable, at_once: int = AT_ONCE) -> list:
    """work(item) of each item, in their order, from at_once threads: jobs of one fill cores that another leaves idle."""
    # wrapped one by one, for each call needs local properties of its own
    calls = [inheritable_thread_target(spark)(partial(work, item)) for item in items]
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda call: call(), calls))
