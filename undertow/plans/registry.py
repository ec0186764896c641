"""Registered queries, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding 0.0 turns a negative zero into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in cols})


# --------------------------------------------------------------------------- shared SQL views

FLOWS = """flows AS (
  SELECT event_id AS flow_id, CAST(user_id AS VARCHAR) AS entity_id, epoch_us(ts) / 1e6 AS ts,
         CAST(hour(ts) AS VARCHAR) AS hour, CAST(dayofweek(ts) AS VARCHAR) AS weekday, strftime(ts, '%H:%M') AS clock, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(event_type = 'error' AS INTEGER) AS label, event_type
  FROM events)"""

SCORES = FLOWS + """,
scores AS (SELECT flow_id, entity_id, ts, value AS score, label FROM flows)"""

DT = FLOWS + """,
gaps AS (
  SELECT *, greatest(coalesce(ts - lag(ts) OVER (PARTITION BY entity_id ORDER BY ts, flow_id), 0.0), 0.0) AS dt
  FROM flows)"""

SPLITS = FLOWS + """,
entities AS (SELECT DISTINCT entity_id FROM flows),
ranked AS (
  SELECT entity_id, row_number() OVER (ORDER BY md5('42|' || entity_id), entity_id) AS rn, count(*) OVER () AS n
  FROM entities),
splits AS (
  SELECT entity_id,
         CASE WHEN rn <= floor(0.7 * n) THEN 'train'
              WHEN rn <= least(floor(0.7 * n) + greatest(floor(0.15 * n), 1), n - 1) THEN 'val' ELSE 'test' END AS split
  FROM ranked)"""

TAGGED = SPLITS + """,
tagged AS (
  SELECT f.*, s.split,
         greatest(coalesce(f.ts - lag(f.ts) OVER (PARTITION BY f.entity_id ORDER BY f.ts, f.flow_id), 0.0), 0.0) AS dt
  FROM flows f JOIN splits s USING (entity_id))"""

SWEEP = SCORES + """,
counted AS (SELECT score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY score),
running AS (
  SELECT threshold, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
         CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n
  FROM counted WINDOW w AS (ORDER BY threshold DESC)),
rates AS (
  SELECT threshold, pos, neg, tp, fp, p - tp AS fn, n - fp AS tn, p, n,
         CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
         CASE WHEN p = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / p END AS recall,
         CASE WHEN n = 0 THEN 0.0 ELSE CAST(fp AS DOUBLE) / n END AS fpr
  FROM running),
sweep AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1
  FROM rates)"""


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of r6."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"
