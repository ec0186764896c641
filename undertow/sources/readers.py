"""Reading flow logs, dataset folders and stored runs."""

from __future__ import annotations

import csv
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.operators.prep import to_canonical
from undertow.session import broadcast_if_small
from undertow.spec import CATALOG, FlowSpec

BOM = "﻿"


# --------------------------------------------------------------------------- row numbers in file order


def number_rows(df: DataFrame, name: str = "flow_id") -> DataFrame:
    """0-based row number over files in path order; no row is moved.

    Rows of one split are read in order by one task, so a row's number is its offset inside the split plus
    the rows of all earlier splits, which is a table of one row per split. `df` must carry _path, _start
    and _mid (see `_located`).
    """
    table = df.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offsets = table.select("_path", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (
        df.join(broadcast_if_small(offsets), ["_path", "_start"])
        .withColumn(name, F.col("_mid") - F.col("_first") + F.col("_base"))
        .drop("_path", "_start", "_mid", "_first", "_base")
    )


def _located(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"),
    )


# --------------------------------------------------------------------------- flow logs


def first_line(spark: SparkSession, path: str) -> str:
    """The first line in path order that is neither blank nor a comment, however many of those come before it."""
    line = F.trim(F.regexp_replace("value", f"[{BOM}\t\r]", " "))
    for file in sorted(spark.read.text(path).inputFiles()):
        found = spark.read.text(file).filter((line != "") & ~line.startswith("#")).head(1)
        if found:
            return found[0]["value"].lstrip(BOM).strip()
    return ""


def _cells(line: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([line]), [])]


def is_hybrid(line: str) -> bool:
    """Comma-separated with a blank-separated tail, as connection logs with labels are shipped."""
    return ("tunnel_parents" in line or "label" in line) and ("\t" in line or "  " in line)


def read_raw(spark: SparkSession, path: str, spec: FlowSpec, header: str | bool = "auto", multi_line: bool = False) -> DataFrame:
    """Text columns named by the header, or by the declared schema when the first row is data."""
    line = first_line(spark, path)
    cells = _cells(line)
    if header == "auto":
        header = bool({*spec.cat_cols, *spec.num_cols, spec.label_col} & set(cells))
    names = cells if header else list(spec.columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("header", bool(header)).option("encoding", "UTF-8")
    reader = reader.option("multiLine", multi_line).option("mode", "PERMISSIVE").option("enforceSchema", True)
    return number_rows(_located(reader.csv(path)))


def read_hybrid_raw(spark: SparkSession, path: str, spec: FlowSpec) -> DataFrame:
    """20 comma fields, then a tail split on blanks; blank lines and comments are dropped."""
    line = first_line(spark, path)
    names = _hybrid_names(line)
    parts = F.split("value", ",", 21)
    fields = F.when(
        F.size(parts) == 21, F.concat(F.slice(parts, 1, 20), F.split(F.trim(parts[20]), r"\s+"))
    ).otherwise(F.transform(F.split("value", ","), lambda x: F.trim(x)))
    lines = _located(spark.read.text(path)).withColumn("value", F.trim(F.regexp_replace("value", BOM, "")))
    rows = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#") & (F.col("value") != line))
    # the filter leaves gaps in the per-split numbers, so positions are counted again
    numbered = _renumber(rows.withColumn("_f", fields))
    return numbered.select("flow_id", *[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _renumber(df: DataFrame, name: str = "flow_id") -> DataFrame:
    """Row numbers where a filter left gaps: position inside the split by window, then split offsets."""
    inside = Window.partitionBy("_path", "_start").orderBy("_mid")
    placed = df.withColumn("_mid", F.row_number().over(inside).cast("long"))
    return number_rows(placed, name)


def _hybrid_names(line: str) -> list[str]:
    parts = line.split(",", 20)
    if len(parts) == 21:
        return parts[:20] + parts[20].split()
    return [p.strip() for p in line.split(",")]


def read_flows(spark: SparkSession, path: str, spec: FlowSpec, header: str | bool = "auto", stride: int = 1, limit: int | None = None) -> DataFrame:
    """A flow log as typed flows: layout by the first line, then canonical columns."""
    from undertow.operators.prep import limit_rows, stride_sample

    hybrid = is_hybrid(first_line(spark, path))
    raw = read_hybrid_raw(spark, path, spec) if hybrid else read_raw(spark, path, spec, header)
    raw = stride_sample(raw, stride)
    flows = to_canonical(raw, spec)
    return limit_rows(flows, limit) if limit else flows


# --------------------------------------------------------------------------- dataset folders


def detect_schema(lines: DataFrame, line: str = "first_line") -> DataFrame:
    """Name the dataset a first line belongs to (column `spec`); null when unknown."""
    tokens = F.transform(F.split(F.lower(F.trim(F.col(line))), r",|\s{2,}"), lambda x: F.trim(x))
    t = F.col("_t")
    has = lambda *names: _all([F.array_contains(t, n) for n in names])
    second = F.get(t, F.lit(1))
    numeric_first = F.get(t, F.lit(0)).try_cast("double").isNotNull()
    spec = (
        F.when(has("ts", "uid", "id.orig_h"), "iot23")
        .when(has("src_ip", "dst_ip", "label"), "ton_iot")
        .when(has("label", "sttl"), "unsw_nb15")
        .when(F.size(t) == 49, "unsw_nb15_raw49")
        .when(has("protocol_type") | has("dst_host_count") | has("labels"), "kdd")
        .when(F.size(t).isin(42, 43) & second.isin("tcp", "udp", "icmp"), "kdd")
        .when(((F.size(t) == 35) & numeric_first) | has("attack", "seq"), "unsw_botnet")
    )
    return lines.withColumn("_t", tokens).withColumn("spec", spec).drop("_t")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, first_line) per file."""
    lines = _located(spark.read.text(path)).filter(F.col("_start") == 0)
    return lines.groupBy(F.col("_path").alias("path")).agg(
        F.regexp_replace(F.min_by("value", "_mid"), BOM, "").alias("first_line")
    )


def list_datasets(spark: SparkSession, folder: str, min_bytes: int = 1_048_576) -> DataFrame:
    """(path, bytes) of usable CSV files: no name tables, no bracketed duplicates, no dataset* under min_bytes (0: any).

    Any part of the path below `folder` counts, since a name table may itself be a folder of part files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    inner = F.element_at(F.split("path", F.lit(f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/")), -1)
    return files.select("path", F.col("length").alias("bytes")).filter(
        ~inner.contains("_Names") & ~inner.contains("_Feature_Names") & ~inner.contains("(")
        & ~(name.startswith("dataset") & (F.col("bytes") < min_bytes))
    )


def dataset_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, data rows, column count and the first eight column names, per file.

    Each file's hash is streamed in blocks by one task; files are hashed side by side.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def digest(frames):
        from pyarrow import fs

        for pdf in frames:
            out = []
            for uri in pdf["path"]:
                clean = uri.replace("file:///", "/").replace("file:/", "/") if uri.startswith("file:") else uri
                store, inner = (fs.LocalFileSystem(), clean) if clean.startswith("/") else fs.FileSystem.from_uri(clean)
                h = hashlib.sha256()
                with store.open_input_stream(inner) as stream:
                    while block := stream.read(8 << 20):
                        h.update(block)
                out.append(h.hexdigest())
            yield pd.DataFrame({"path": pdf["path"], "sha256": out})

    hashes = files.mapInPandas(digest, "path string, sha256 string")
    lines = _located(spark.read.text(path))
    counts = lines.groupBy(F.col("_path").alias("path")).agg(
        (F.count(F.lit(1)) - 1).alias("row_count"),
        F.regexp_replace(F.min_by("value", F.struct("_start", "_mid")), BOM, "").alias("_h"),
    )
    names = F.transform(F.split("_h", ","), lambda x: F.trim(x))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    left = hashes.select(plain("path").alias("path"), "sha256")
    right = counts.select(plain("path").alias("path"), "row_count", F.size(names).alias("columns_count"), F.slice(names, 1, 8).alias("columns_sample"))
    return left.join(right, "path")


# --------------------------------------------------------------------------- stored runs

RUN_SCHEMA = (
    "score_direction string, confusion_matrix struct<tp:bigint,fp:bigint,fn:bigint,tn:bigint>, precision double, recall double, "
    "f1_score double, auroc double, pr_auc double, fpr_at_95_tpr double, latency_ms_per_flow double, throughput_flows_sec double, "
    "peak_rss_mb double, sample_size bigint, parameters struct<total_params:bigint,params_m:double>, "
    "calibration struct<method:string,threshold:double>, experiment struct<dataset:string,model:string,random_seed:bigint,config_hash:string>, "
    "_corrupt string"
)


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Every run's metrics in one table; run_id is the folder name, unreadable files are left out."""
    raw = (
        spark.read.schema(RUN_SCHEMA)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(pattern)
    )
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    # several metric files may share a folder when runs are written by Spark: the folder above then names the run
    named = F.when(run == "metrics", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)).otherwise(run)
    return raw.withColumn("run_id", named).filter(F.col("_corrupt").isNull() & F.col("f1_score").isNotNull()).drop("_corrupt")


def catalog_table(spark: SparkSession) -> DataFrame:
    """The known dataset layouts as a table."""
    rows = [(s.name, len(s.columns), len(s.cat_cols), len(s.num_cols), s.label_col, s.log) for s in CATALOG.values()]
    return spark.createDataFrame(rows, "spec string, columns int, cat_cols int, num_cols int, label_col string, log boolean")
