"""The functions that SQL users call, each run by SQL text over registered names."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertow.functions import scalars as S
from undertow.functions.tables import register_tables
from undertow.operators import prep, quality
from undertow.plans import flows as src
from undertow.plans.queries_prep import _LABEL_CASE, _WIN, ATTACK_TEXTS, LABEL_TEXTS, STATES, _CEF, _pick, _sql_pick
from undertow.plans.registry import FLOWS, query, r, r6


def _called(spark, sf, expression, view=None):
    """flow_id and an expression over the flows (or another view), as SQL text."""
    S.register_sql(spark)
    (view if view is not None else src.events(spark, sf)).createOrReplaceTempView("undertow_flows")
    return spark.sql(f"SELECT flow_id, {expression} FROM undertow_flows")


@query(f"WITH {FLOWS} SELECT flow_id, coalesce(TRY_CAST(CASE WHEN flow_id % 3 = 0 THEN ' ' || CAST(value AS VARCHAR) || ' ' WHEN flow_id % 3 = 1 THEN 'n/a' END AS DOUBLE), 0.0) AS parsed FROM flows")
def u01_safe_float(spark, sf):
    return _called(spark, sf, "safe_float(CASE WHEN flow_id % 3 = 0 THEN ' ' || CAST(value AS STRING) || ' ' WHEN flow_id % 3 = 1 THEN 'n/a' END) AS parsed")


@query(f"WITH {FLOWS}, raw AS (SELECT flow_id, {_sql_pick(LABEL_TEXTS)} AS t FROM flows) SELECT flow_id, {_LABEL_CASE} AS label FROM raw")
def u01_normalize_label(spark, sf):
    return _called(spark, sf, "normalize_label(t) AS label", src.events(spark, sf).select("flow_id", _pick(LABEL_TEXTS).alias("t")))


_BITS = "list_transform(range(0, 8), lambda i: CASE WHEN (flow_id // CAST(power(2, i) AS BIGINT)) % 2 = 1 THEN 1 ELSE -1 END)"
_SPARK_BITS = "transform(sequence(0, 7), i -> IF(shiftright(flow_id, i) % 2 = 1, 1, -1))"
_OTHER = "list_transform(range(0, 8), lambda i: CASE WHEN i % 3 = 0 THEN 1 ELSE -1 END)"
_SPARK_OTHER = "transform(sequence(0, 7), i -> IF(i % 3 = 0, 1, -1))"
_TEXT = "array_to_string({}, ',')"


@query(f"WITH {FLOWS}, v AS (SELECT flow_id, {_BITS} AS a, {_OTHER} AS b FROM flows) SELECT flow_id, {_TEXT.format('list_transform(a, lambda x, i: x * b[i])')} AS bound FROM v")
def u01_hd_bind(spark, sf):
    return _called(spark, sf, f"array_join(transform(hd_bind({_SPARK_BITS}, {_SPARK_OTHER}), x -> CAST(x AS STRING)), ',') AS bound")


@query(f"WITH {FLOWS}, v AS (SELECT flow_id, {_BITS} AS a, {_OTHER} AS b FROM flows) SELECT flow_id, {_TEXT.format('list_transform(a, lambda x, i: CASE WHEN 2 * x + b[i] >= 0 THEN 1 ELSE -1 END)')} AS bundled FROM v")
def u01_hd_bundle(spark, sf):
    return _called(spark, sf, f"array_join(transform(hd_bundle(array({_SPARK_BITS}, {_SPARK_OTHER}, {_SPARK_BITS})), x -> CAST(x AS STRING)), ',') AS bundled")


@query(f"WITH {FLOWS}, v AS (SELECT flow_id, {_BITS} AS a FROM flows) SELECT flow_id, {_TEXT.format('list_transform(range(0, 8), lambda i: a[((i + 5) % 8) + 1])')} AS moved FROM v")
def u01_hd_permute(spark, sf):
    return _called(spark, sf, f"array_join(transform(hd_permute({_SPARK_BITS}, 3), x -> CAST(x AS STRING)), ',') AS moved")


@query(f"WITH {FLOWS} SELECT flow_id, CAST(bit_count(xor(flow_id, CAST(1365 AS BIGINT))) AS INTEGER) AS hamming FROM flows")
def u01_hd_hamming(spark, sf):
    return _called(spark, sf, "hd_hamming(flow_id, 1365) AS hamming")


@query(f"WITH {STATES} SELECT flow_id, {r('list_cosine_similarity(h, list_reverse(h))')} AS cosine FROM states")
def u01_cosine_sim(spark, sf):
    return _called(spark, sf, "round(cosine_sim(h, reverse(h)), 6) + 0.0D AS cosine", src.states(spark, sf))


@query(f"WITH {FLOWS}, m AS (SELECT (value - 50.0) / 25.0 AS z, flow_id FROM flows) SELECT flow_id, CAST(len(list_filter([{', '.join(f'CAST({b!r} AS DOUBLE)' for b in S.SAX_BREAKPOINTS_8)}], lambda b: z >= b)) AS INTEGER) AS symbol FROM m")
def u01_sax_symbol(spark, sf):
    return _called(spark, sf, "sax_symbol((value - 50.0D) / 25.0D) AS symbol")


@query(f"WITH {FLOWS} SELECT flow_id, {_CEF} AS line FROM flows")
def u01_cef_alert(spark, sf):
    return _called(spark, sf, "cef_alert(entity_id, ts, value, 50.0D) AS line")


@query(_WIN + f" SELECT entity_id, CAST(start AS BIGINT) AS start, {r('sum(value * (pos + 1)) FILTER (pos < L)')} AS x_sum, "
       f"{r('sum(value * pos) FILTER (pos >= 1)')} AS y_sum, {r('sum(dt) FILTER (pos < L)')} AS dt_sum FROM mem GROUP BY entity_id, start")
def u01_sequence_windows(spark, sf):
    """The windows of D12 from a table function over a partitioned table argument."""
    register_tables(spark)
    f = src.events(spark, sf)
    length = prep.window_length(f, 16)
    f.select("flow_id", "entity_id", "ts", "value", "label").createOrReplaceTempView("undertow_flows")
    w = spark.sql(f"SELECT * FROM sequence_windows(TABLE(undertow_flows) PARTITION BY entity_id ORDER BY (ts, flow_id), {length})")
    weigh = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return w.select("entity_id", "start", r6(weigh("x")).alias("x_sum"), r6(weigh("y")).alias("y_sum"), r6(F.aggregate("dts", F.lit(0.0), lambda a, v: a + v)).alias("dt_sum"))


@query(f"""WITH {FLOWS}, f AS (SELECT *, label AS attack_cat FROM flows)
 SELECT 'value' AS feature, FALSE AS forbidden, count(*) FILTER (CAST(value AS VARCHAR) = CAST(label AS VARCHAR)) AS agreeing, count(*) AS row_count FROM f
 UNION ALL SELECT 'weekday', FALSE, count(*) FILTER (weekday = CAST(label AS VARCHAR)), count(*) FROM f
 UNION ALL SELECT 'label', TRUE, count(*), count(*) FROM f UNION ALL SELECT 'attack_cat', TRUE, count(*), count(*) FROM f""")
def d08_feature_audit(spark, sf):
    f = src.events(spark, sf).withColumn("attack_cat", F.col("label"))
    return quality.feature_report(f, ["value", "weekday", "label", "attack_cat"])
