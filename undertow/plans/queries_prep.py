"""Queries over scalar functions and flow preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertow.functions import scalars as S
from undertow.operators import evaluate, ordered, prep, quality
from undertow.plans import flows as src
from undertow.plans.registry import DT, FLOWS, SCORES, SPLITS, TAGGED, query, r, r6, rounded

# Texts as they occur in label columns of flow logs; which one a row carries follows from its id.
LABEL_TEXTS = [" Normal ", "BENIGN", "", "nan", "0.0", "-", "1", "True", "2.5", "-1", "neptune", None]
SERVICE_TEXTS = ["http", "8080", "ftp-data", "21", "telnet", "23", "dns", "53", "smtp", "-"]
ATTACK_TEXTS = ["neptune", "nmap", "guess_passwd", "rootkit", "Smurf", "unknown"]


def _pick(texts, key="flow_id"):
    items = F.array(*[F.lit(t) for t in texts])
    return F.element_at(items, (F.col(key) % len(texts) + 1).cast("int"))


def _sql_pick(texts, key="flow_id"):
    items = ", ".join("NULL" if t is None else f"'{t}'" for t in texts)
    return f"([{items}])[CAST({key} % {len(texts)} + 1 AS BIGINT)]"


@query(f"WITH {FLOWS} SELECT flow_id, coalesce(TRY_CAST(CASE WHEN flow_id % 7 = 0 THEN '' WHEN flow_id % 7 = 1 THEN 'n/a' "
       "WHEN flow_id % 7 = 2 THEN NULL ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0.0) AS parsed FROM flows")
def n01_safe_float(spark, sf):
    raw = (
        F.when(F.col("flow_id") % 7 == 0, "").when(F.col("flow_id") % 7 == 1, "n/a")
        .when(F.col("flow_id") % 7 == 2, F.lit(None)).otherwise(F.col("value").cast("string"))
    )
    return src.events(spark, sf).select("flow_id", S.safe_float(raw).alias("parsed"))


_LABEL_CASE = """CASE WHEN t IS NULL OR lower(trim(t)) IN ('0','0.0','normal','benign','legit','legitimate','false','','-','nan','null','none') THEN 0
  WHEN lower(trim(t)) IN ('1','1.0','attack','malicious','true') THEN 1
  WHEN TRY_CAST(trim(t) AS DOUBLE) IS NULL THEN 1
  WHEN isnan(TRY_CAST(trim(t) AS DOUBLE)) OR TRY_CAST(trim(t) AS DOUBLE) = 0 THEN 0 ELSE 1 END"""


@query(f"WITH {FLOWS}, raw AS (SELECT flow_id, {_sql_pick(LABEL_TEXTS)} AS t FROM flows) SELECT flow_id, {_LABEL_CASE} AS label FROM raw")
def n02_normalize_label(spark, sf):
    return src.events(spark, sf).select("flow_id", S.normalize_label(_pick(LABEL_TEXTS)).alias("label"))


@query(f"WITH {FLOWS}, raw AS (SELECT flow_id, {_sql_pick(LABEL_TEXTS)} AS l, {_sql_pick(ATTACK_TEXTS)} AS s FROM flows), "
       "eff AS (SELECT flow_id, CASE WHEN l IS NULL OR l = '' THEN s ELSE l END AS t FROM raw) "
       f"SELECT flow_id, {_LABEL_CASE} AS label FROM eff")
def n03_label_fallback(spark, sf):
    return src.events(spark, sf).select(
        "flow_id", S.resolve_label(_pick(LABEL_TEXTS), _pick(ATTACK_TEXTS)).alias("label")
    )


@query(f"WITH {FLOWS}, raw AS (SELECT flow_id, CASE WHEN flow_id % 5 = 0 THEN '-' WHEN flow_id % 5 = 1 THEN 'NaN' "
       "WHEN flow_id % 5 = 2 THEN NULL ELSE entity_id END AS e FROM flows) "
       "SELECT flow_id, CASE WHEN e IS NULL OR lower(e) IN ('', '-', 'nan') THEN '10.0.0.' || CAST(flow_id % 254 + 1 AS VARCHAR) ELSE e END AS entity_id FROM raw")
def n04_entity_fallback(spark, sf):
    raw = F.when(F.col("flow_id") % 5 == 0, "-").when(F.col("flow_id") % 5 == 1, "NaN").when(
        F.col("flow_id") % 5 == 2, F.lit(None)).otherwise(F.col("entity_id"))
    return src.events(spark, sf).select("flow_id", S.resolve_entity(raw, "flow_id").alias("entity_id"))


@query(f"WITH {FLOWS} SELECT flow_id, {r('sum(greatest(value / 1000.0, 0.001)) OVER (ORDER BY flow_id)', 5)} AS ts FROM flows")
def n05_synthetic_clock(spark, sf):
    dur = src.events(spark, sf).select("flow_id", (F.col("value") / 1000.0).alias("dur"))
    return rounded(prep.synthetic_clock(dur, "dur").select("flow_id", "ts"), "ts", digits=5)


@query(f"WITH {FLOWS} SELECT flow_id, coalesce(CASE WHEN flow_id % 4 = 0 THEN NULL ELSE hour END, '-') AS hour, "
       "coalesce(CASE WHEN flow_id % 3 = 0 THEN NULL ELSE value END, 0.0) AS value FROM flows")
def n06_fill_missing(spark, sf):
    holes = src.events(spark, sf).select(
        "flow_id", F.when(F.col("flow_id") % 4 != 0, F.col("hour")).alias("hour"),
        F.when(F.col("flow_id") % 3 != 0, F.col("value")).alias("value"))
    return prep.fill_missing(holes, ["hour"], ["value"])


@query(f"WITH {FLOWS} SELECT flow_id, entity_id, {r('ts')} AS ts, hour, weekday, value, k, label FROM flows")
def n07_canonical_maps(spark, sf):
    f = src.events(spark, sf)
    maps = prep.flows_to_maps(f, src.EVENT_CATS, src.EVENT_NUMS)
    back = prep.maps_to_flows(maps, src.EVENT_CATS, src.EVENT_NUMS)
    return rounded(back.select("flow_id", "entity_id", "ts", "hour", "weekday", "value", "k", "label"), "ts")


@query(f"WITH {FLOWS} SELECT flow_id, {r('ln(1 + greatest(value - 50.0, 0.0))')} AS v FROM flows")
def n08_log_clip(spark, sf):
    return src.events(spark, sf).select("flow_id", r6(S.log_clip(F.col("value") - 50.0)).alias("v"))


_RANGES = f"WITH {TAGGED}, ranges AS (SELECT min(value) AS lo, max(value) AS hi FROM tagged WHERE split = 'train')"
_UNIT = "least(greatest((value - lo) / (CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END), 0.0), 1.0)"


def _tagged(spark, sf):
    f = src.events(spark, sf)
    # entities are split without the gaps, which would be computed anew in every pass over them
    return prep.tag_split(prep.with_dt(f), prep.split_map(f))


def _value_range(df):
    lo, hi = df.filter(F.col("split") == "train").agg(F.min("value"), F.max("value")).first()
    return lo, hi


@query(f"{_RANGES} SELECT flow_id, {r(_UNIT)} AS unit FROM tagged, ranges")
def n09_minmax(spark, sf):
    t = _tagged(spark, sf)
    return t.select("flow_id", r6(S.minmax("value", *_value_range(t))).alias("unit"))


@query(f"{_RANGES} SELECT flow_id, CAST(round_even({_UNIT} * 99, 0) AS INTEGER) AS level FROM tagged, ranges")
def n10_level(spark, sf):
    t = _tagged(spark, sf)
    return t.select("flow_id", S.to_level(S.minmax("value", *_value_range(t)), 100).alias("level"))


_BREAKS = ", ".join(f"CAST({b!r} AS DOUBLE)" for b in S.SAX_BREAKPOINTS_8)


@query(f"WITH {TAGGED}, m AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM tagged WHERE split = 'train') "
       f"SELECT flow_id, CAST(len(list_filter([{_BREAKS}], lambda b: (value - mu) / (CASE WHEN sd > 1e-6 THEN sd ELSE 1.0 END) >= b)) AS INTEGER) AS symbol FROM tagged, m")
def n11_sax_symbol(spark, sf):
    t = _tagged(spark, sf)
    mu, sd = t.filter(F.col("split") == "train").agg(F.avg("value"), F.stddev_pop("value")).first()
    return t.select("flow_id", S.sax_symbol("value", mu, sd if sd > 1e-6 else 1.0).alias("symbol"))


_FAMILY_ROWS = ", ".join(f"('{name}', '{family}')" for name, family in S.ATTACK_FAMILIES.items())


@query(f"WITH {FLOWS}, raw AS (SELECT flow_id, {_sql_pick(ATTACK_TEXTS)} AS a FROM flows), known(name, family) AS (VALUES {_FAMILY_ROWS}) "
       "SELECT flow_id, family FROM raw LEFT JOIN known ON lower(a) = name")
def n14_attack_family(spark, sf):
    return src.events(spark, sf).select("flow_id", S.attack_family(_pick(ATTACK_TEXTS)).alias("family"))


@query(f"WITH {FLOWS}, raw AS (SELECT flow_id, {_sql_pick(SERVICE_TEXTS)} AS s FROM flows) SELECT flow_id, "
       "CASE WHEN contains(s,'http') OR s IN ('80','8080') THEN 'HTTP' WHEN contains(s,'ftp') OR s IN ('20','21') THEN 'FTP' "
       "WHEN contains(s,'telnet') OR s='23' THEN 'Telnet' WHEN contains(s,'dns') OR s='53' THEN 'DNS' END AS family FROM raw")
def n15_service_family(spark, sf):
    return src.events(spark, sf).select("flow_id", S.service_family(_pick(SERVICE_TEXTS)).alias("family"))


@query(f"WITH {FLOWS} SELECT flow_id, CASE WHEN value / 50.0 >= 2.0 THEN 'clearly separable' WHEN value / 50.0 >= 0.8 THEN 'weakly separable' "
       "WHEN value / 50.0 >= 0.2 THEN 'strong overlap' ELSE 'indistinguishable' END AS bucket FROM flows")
def n16_fdr_bucket(spark, sf):
    return src.events(spark, sf).select("flow_id", S.fdr_bucket(F.col("value") / 50.0).alias("bucket"))


@query(f"WITH {FLOWS} SELECT flow_id, CASE WHEN flow_id % 6 IN (0, 1, 2) THEN 0.0 ELSE value END AS value FROM flows")
def n17_sanitize(spark, sf):
    odd = F.when(F.col("flow_id") % 6 == 0, F.lit(float("nan"))).when(F.col("flow_id") % 6 == 1, F.lit(float("inf"))).when(
        F.col("flow_id") % 6 == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return S.sanitize(src.events(spark, sf).select("flow_id", odd.alias("value")))


_CEF = ("'CEF:0|undertow|BehavioralDrift|1.0|ANOMALY_DETECTED|Behavioral drift anomaly detected for entity ' || entity_id || "
        "'|10|src=' || entity_id || ' rt=' || CAST(CAST(floor(ts * 1000) AS BIGINT) AS VARCHAR) || "
        "' driftScore=' || printf('%.4f', value) || ' threshold=' || printf('%.4f', 50.0) || "
        "' msg=Continuous-time sequence drift exceeded validation-calibrated threshold'")


@query(f"WITH {FLOWS} SELECT flow_id, {_CEF} AS line FROM flows WHERE value >= 50")
def n18_cef_alert(spark, sf):
    f = src.events(spark, sf).filter(F.col("value") >= 50)
    return f.select("flow_id", S.cef_alert("entity_id", "ts", "value", F.lit(50.0)).alias("line"))


@query(f"WITH {FLOWS} SELECT flow_id, CASE WHEN flow_id % 9 = 0 THEN 'nan' ELSE printf('%.4f', value) END AS shown FROM flows")
def n19_fmt_metric(spark, sf):
    return src.events(spark, sf).select("flow_id", S.fmt_metric(F.when(F.col("flow_id") % 9 != 0, F.col("value"))).alias("shown"))


@query(f"WITH {FLOWS}, raw AS (SELECT flow_id, label, coalesce(nullif({_sql_pick(LABEL_TEXTS)}, ''), nullif({_sql_pick(SERVICE_TEXTS)}, ''), 'Attack Threat') AS c FROM flows) "
       "SELECT flow_id, CASE WHEN label <> 1 THEN 'Normal' WHEN c IN ('-', 'normal', '0') THEN 'Exploit Threat' ELSE c END AS category FROM raw")
def n20_threat_category(spark, sf):
    return src.events(spark, sf).select(
        "flow_id", S.threat_category("label", _pick(LABEL_TEXTS), _pick(SERVICE_TEXTS)).alias("category"))


STATES = """states AS (
  SELECT vec_id AS flow_id, 'e' || CAST(vec_id % 20 AS VARCHAR) AS entity_id, CAST(embedding AS DOUBLE[]) AS h,
         CAST(label >= 5 AS INTEGER) AS label FROM embeddings)"""


@query(f"WITH {STATES}, mu AS (SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(h[i]) AS m FROM states, range(1, 65) t(i) GROUP BY i)) "
       f"SELECT flow_id, {r('list_dot_product(h, q) / (sqrt(list_dot_product(h, h)) * sqrt(list_dot_product(q, q)))')} AS cosine FROM states, mu")
def n21_cosine(spark, sf):
    from undertow.operators import vectors

    st = src.states(spark, sf)
    mean = vectors.vector_mean(st, "h")
    return st.select("flow_id", r6(S.cosine("h", S.double_array(mean))).alias("cosine"))


@query(f"WITH {STATES} SELECT flow_id, {r('1.0 / (1.0 + exp(-(list_sum(list_transform(h, lambda x, i: x * (i - 32) / 10.0)) + 0.25)))')} AS p FROM states")
def n22_linear_score(spark, sf):
    return src.states(spark, sf).select(
        "flow_id", r6(S.linear_score("h", [(i + 1 - 32) / 10.0 for i in range(64)], 0.25)).alias("p"))


# --------------------------------------------------------------------------- injection, gaps, splits

_INJECTED = [
    (e, off, f.get("service", "-") if True else "-", {**s, **c}, n)
    for _, e, s, steps in prep.SCENARIOS for off, c, n in steps for f in [{**s, **c}]
]
_INJ_VALUES = ", ".join(
    f"({i}, '{e}', {off}, '{f.get('service', '-')}', '{f.get('state', '-')}', CAST({n['dur']} AS DOUBLE), CAST({n['sbytes']} AS DOUBLE))"
    for i, (e, off, _, f, n) in enumerate(_INJECTED))


@query(f"WITH {FLOWS}, b AS (SELECT min(ts) AS t0, max(flow_id) AS m FROM flows), "
       f"s(i, e, off, service, state, dur, sbytes) AS (VALUES {_INJ_VALUES}) "
       f"SELECT flow_id, entity_id, {r('ts')} AS ts, event_type AS service, '-' AS state, value AS dur, k AS sbytes, label FROM flows "
       f"UNION ALL SELECT m + i + 1, e, {r('t0 + off')}, service, state, dur, sbytes, 1 FROM s, b")
def d01_inject(spark, sf):
    f = src.events(spark, sf).select(
        "flow_id", "entity_id", "ts", F.col("event_type").alias("service"), F.lit("-").alias("state"),
        F.col("value").alias("dur"), F.col("k").alias("sbytes"), "label")
    return rounded(prep.inject(f, ["service", "state"], ["dur", "sbytes"]), "ts")


@query(f"WITH {DT} SELECT flow_id, {r('dt')} AS dt FROM gaps")
def d02_inter_arrival(spark, sf):
    return rounded(prep.with_dt(src.events(spark, sf)).select("flow_id", "dt"), "dt")


@query(f"WITH {SPLITS} SELECT entity_id, split FROM splits")
def d03_split_map(spark, sf):
    return prep.split_map(src.events(spark, sf))


@query(f"""WITH {FLOWS}, f2 AS (SELECT *, CASE WHEN user_num % 10 = 0 THEN '10.0.0.901' ELSE entity_id END AS e2
  FROM (SELECT *, CAST(entity_id AS BIGINT) AS user_num FROM flows)),
  ents AS (SELECT DISTINCT e2 FROM f2),
  rk AS (SELECT e2, row_number() OVER (ORDER BY md5('42|' || e2), e2) AS rn, count(*) OVER () AS n FROM ents WHERE e2 <> '10.0.0.901')
  SELECT e2 AS entity_id, CASE WHEN rn <= floor(0.7 * n) THEN 'train' WHEN rn <= least(floor(0.7 * n) + greatest(floor(0.15 * n), 1), n - 1) THEN 'val' ELSE 'test' END AS split FROM rk
  UNION ALL SELECT '10.0.0.901', 'test' WHERE EXISTS (SELECT 1 FROM ents WHERE e2 = '10.0.0.901')""")
def d04_pinned_entities(spark, sf):
    f = src.events(spark, sf).withColumn(
        "entity_id", F.when(F.col("entity_id").cast("long") % 10 == 0, "10.0.0.901").otherwise(F.col("entity_id")))
    return prep.split_map(f)


@query(f"WITH {TAGGED} SELECT flow_id, entity_id, split, {r('dt')} AS dt FROM tagged")
def d05_split_tags(spark, sf):
    return rounded(_tagged(spark, sf).select("flow_id", "entity_id", "split", "dt"), "dt")


_BAD_SPLIT = "CASE WHEN flow_id % 50 = 0 THEN 'val' ELSE split END"


@query(f"WITH {TAGGED}, bad AS (SELECT entity_id, {_BAD_SPLIT} AS split FROM tagged), "
       "e AS (SELECT entity_id, bool_or(split='train') AS a, bool_or(split='val') AS b, bool_or(split='test') AS c FROM bad GROUP BY 1) "
       "SELECT 'train' AS left_split, 'val' AS right_split, count(*) FILTER (a AND b) AS entities FROM e UNION ALL "
       "SELECT 'train', 'test', count(*) FILTER (a AND c) FROM e UNION ALL SELECT 'val', 'test', count(*) FILTER (b AND c) FROM e")
def d06_entity_overlap(spark, sf):
    bad = _tagged(spark, sf).withColumn("split", F.when(F.col("flow_id") % 50 == 0, "val").otherwise(F.col("split")))
    return quality.entity_overlap(bad)


@query(f"WITH {TAGGED}, bad AS (SELECT CASE WHEN flow_id % 40 = 0 THEN 'dev' ELSE split END AS split, "
       "CASE WHEN flow_id % 60 = 0 THEN 2 ELSE label END AS label, CASE WHEN flow_id % 70 = 0 THEN -1.0 ELSE dt END AS dt, "
       "flow_id % 80 = 0 AS isn, flow_id % 90 = 0 AS isi FROM tagged) "
       "SELECT 'split_tag' AS rule, count(*) FILTER (split NOT IN ('train','val','test')) AS violations FROM bad UNION ALL "
       "SELECT 'label_binary', count(*) FILTER (label NOT IN (0,1)) FROM bad UNION ALL SELECT 'dt_non_negative', count(*) FILTER (dt < 0) FROM bad UNION ALL "
       "SELECT 'no_nan', count(*) FILTER (isn) FROM bad UNION ALL SELECT 'no_infinity', count(*) FILTER (isi) FROM bad")
def d07_quality_report(spark, sf):
    i = F.col("flow_id")
    bad = _tagged(spark, sf).withColumns({
        "split": F.when(i % 40 == 0, "dev").otherwise(F.col("split")),
        "label": F.when(i % 60 == 0, 2).otherwise(F.col("label")),
        "dt": F.when(i % 70 == 0, -1.0).otherwise(F.col("dt")),
        "value": F.when(i % 80 == 0, float("nan")).otherwise(F.col("value")),
        "k": F.when(i % 90 == 0, float("inf")).otherwise(F.col("k"))})
    return quality.quality_report(bad, src.EVENT_NUMS)


@query(f"WITH {TAGGED} SELECT split, count(*) AS row_count, CAST(sum(label) AS BIGINT) AS attacks FROM tagged GROUP BY split")
def d09_leakage_gate(spark, sf):
    t = _tagged(spark, sf)
    quality.assert_no_leakage(t, [*src.EVENT_CATS, *src.EVENT_NUMS])
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("label").cast("long")).alias("attacks"))


@query(f"WITH {TAGGED}, t AS (SELECT flow_id FROM tagged WHERE event_type <> 'error' OR value < 80 UNION ALL SELECT flow_id FROM tagged WHERE value > 120), "
       "c AS (SELECT f.flow_id, count(t.flow_id) AS b FROM flows f LEFT JOIN t USING (flow_id) GROUP BY 1) "
       "SELECT count(*) AS source_rows, CAST(sum(b) AS BIGINT) AS tagged_rows, count(*) FILTER (b = 0) AS missing_rows, CAST(0 AS BIGINT) AS added_rows, "
       "count(*) FILTER (b > 1) AS repeated_rows FROM c")
def d10_split_completeness(spark, sf):
    t = _tagged(spark, sf)
    broken = t.filter("event_type <> 'error' OR value < 80").unionByName(t.filter("value > 120"))
    return quality.split_completeness(src.events(spark, sf), broken)


@query(f"WITH {TAGGED} SELECT coalesce(split, 'all') AS split_name, count(*) AS row_count, count(*) FILTER (label = 0) AS normals, "
       f"count(*) FILTER (label = 1) AS attacks, {r('100.0 * count(*) FILTER (label = 1) / count(*)')} AS attack_pct, "
       "count(DISTINCT entity_id) AS split_entities FROM tagged GROUP BY ROLLUP (split)")
def d11_split_profile(spark, sf):
    return rounded(quality.split_profile(_tagged(spark, sf)), "attack_pct")


_WIN = f"""WITH {DT}, num AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, flow_id) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM gaps),
  lens AS (SELECT CASE WHEN max(n) > 16 THEN 16 WHEN max(n) > 8 THEN 8 WHEN max(n) > 4 THEN 4 ELSE 2 END AS L FROM num),
  starts AS (SELECT DISTINCT entity_id, i AS start, L FROM num, lens WHERE i % (L // 2) = 0 AND i < n - L),
  mem AS (SELECT s.entity_id, s.start, s.L, m.i - s.start AS pos, m.value, m.dt, m.label FROM starts s
          JOIN num m ON m.entity_id = s.entity_id AND m.i BETWEEN s.start AND s.start + s.L)"""


@query(_WIN + f" SELECT entity_id, CAST(start AS BIGINT) AS start, {r('sum(value * (pos + 1)) FILTER (pos < L)')} AS x_sum, "
       f"{r('sum(value * pos) FILTER (pos >= 1)')} AS y_sum, {r('sum(dt) FILTER (pos < L)')} AS dt_sum FROM mem GROUP BY entity_id, start")
def d12_sequence_windows(spark, sf):
    f = prep.with_dt(src.events(spark, sf))
    w = prep.sequence_windows(f, "value", prep.window_length(f, 16))
    weigh = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return w.select("entity_id", "start", r6(weigh("x")).alias("x_sum"), r6(weigh("y")).alias("y_sum"),
                    r6(F.aggregate("dts", F.lit(0.0), lambda a, v: a + v)).alias("dt_sum"))


@query(f"WITH {FLOWS}, c AS (SELECT entity_id, least(count(*), 7) AS n FROM flows GROUP BY 1), m AS (SELECT max(n) AS mx FROM c) "
       "SELECT CASE WHEN mx > 16 THEN 16 WHEN mx > 8 THEN 8 WHEN mx > 4 THEN 4 WHEN mx > 2 THEN 2 ELSE 1 END AS length, "
       "CAST(sum(CASE WHEN n > 4 THEN ceil((n - 4) / 2.0) ELSE 0 END) AS BIGINT) AS windows FROM c, m GROUP BY mx")
def d13_window_fallback(spark, sf):
    short = ordered.sliced_order(src.events(spark, sf), "entity_id", ["ts", "flow_id"], row_number="rn").filter("rn <= 7")
    f = prep.with_dt(short.drop("rn"))
    length = prep.window_length(f, 16)
    w = prep.sequence_windows(f, "value", length)
    return w.agg(F.lit(length).alias("length"), F.count(F.lit(1)).alias("windows"))


@query(_WIN + """, hard AS (SELECT entity_id, start, avg(CAST(label AS DOUBLE)) AS hardness FROM mem WHERE pos >= 1 GROUP BY 1, 2),
  e AS (SELECT *, row_number() OVER (ORDER BY entity_id, start) - 1 AS rk, count(*) OVER () AS sz FROM hard WHERE hardness = 0),
  h AS (SELECT *, row_number() OVER (ORDER BY entity_id, start) - 1 AS rk, count(*) OVER () AS sz FROM hard WHERE hardness > 0),
  tot AS (SELECT count(*) AS total, CAST(floor(count(*) * 0.6) AS BIGINT) AS nh FROM hard),
  s AS (SELECT slot, total - nh AS ne FROM tot, range(0, (SELECT total FROM tot)) g(slot))
  SELECT entity_id, CAST(start AS BIGINT) AS start, round(hardness, 6) + 0.0 AS hardness, CAST(slot AS BIGINT) AS slot
  FROM s JOIN e ON slot < ne AND slot % sz = rk
  UNION ALL SELECT entity_id, CAST(start AS BIGINT), round(hardness, 6) + 0.0, CAST(slot AS BIGINT) FROM s JOIN h ON slot >= ne AND (slot - ne) % sz = rk""")
def d14_curriculum(spark, sf):
    f = prep.with_dt(src.events(spark, sf))
    hardness = prep.window_hardness(f, prep.window_length(f, 16))
    return rounded(prep.curriculum_sample(hardness, 1), "hardness")


@query(f"WITH {FLOWS}, n AS (SELECT flow_id, row_number() OVER (ORDER BY flow_id) AS rn, count(*) OVER () AS c FROM flows WHERE label = 0), "
       "a AS (SELECT flow_id, row_number() OVER (ORDER BY flow_id) AS rn FROM flows WHERE label = 1), q AS (SELECT max(c) - floor(max(c) * 0.6) AS rest FROM n) "
       "SELECT flow_id, CASE WHEN rn <= floor(c * 0.6) THEN 'fit' ELSE 'eval_normal' END AS role FROM n UNION ALL SELECT flow_id, 'eval_attack' FROM a, q WHERE rn <= rest")
def d15_normal_holdout(spark, sf):
    return prep.normal_holdout(src.events(spark, sf).select("flow_id", "label")).select("flow_id", "role")


@query(f"WITH {FLOWS} SELECT flow_id, label FROM flows WHERE label = 0")
def d16_class_filter(spark, sf):
    return prep.normals(src.events(spark, sf)).select("flow_id", "label")


@query(f"WITH {FLOWS} SELECT flow_id, label FROM flows QUALIFY row_number() OVER (PARTITION BY label ORDER BY flow_id) <= 200")
def d17_head_per_class(spark, sf):
    return prep.head_per_class(src.events(spark, sf).select("flow_id", "label"), 200)


@query(f"WITH {TAGGED}, c AS (SELECT count(*) FILTER (split='val' AND label=0) AS vn, count(*) FILTER (split='train' AND label=0) AS tn FROM tagged) "
       "SELECT flow_id, split FROM tagged, c WHERE CASE WHEN vn > 0 THEN split='val' AND label=0 WHEN tn > 0 THEN split='train' AND label=0 ELSE split='val' END")
def d18_calibration_rows(spark, sf):
    return prep.calibration_rows(_tagged(spark, sf)).select("flow_id", "split")


@query(f"WITH {FLOWS} SELECT flow_id, (SELECT greatest(count(*) - 500, 0) FROM flows) AS dropped FROM flows QUALIFY row_number() OVER (ORDER BY ts DESC, flow_id DESC) <= 500")
def d19_keep_latest(spark, sf):
    kept, dropped = prep.keep_latest(src.events(spark, sf).select("flow_id", "ts"), 500)
    return kept.select("flow_id", F.lit(dropped).cast("long").alias("dropped"))


def _decisions(spark, sf, threshold=50.0):
    f = src.scores(spark, sf)
    return f.select("flow_id", "entity_id", "ts", F.col("label").alias("actual_label"),
                    (F.col("score") >= threshold).cast("int").alias("predicted_label"),
                    F.col("score").alias("drift_score"), F.lit(threshold).alias("threshold"))


@query(f"WITH {FLOWS} SELECT flow_id, CASE WHEN value >= 50 THEN 'FP' ELSE 'FN' END AS error_type, value AS final_score, entity_id, {r('ts')} AS ts, event_type, k "
       "FROM flows WHERE (value >= 50) <> (label = 1)")
def d20_hard_errors(spark, sf):
    return rounded(quality.hard_errors(_decisions(spark, sf), src.events(spark, sf), ["event_type", "k"]), "ts")


@query(f"WITH {SPLITS} SELECT flow_id, split FROM flows JOIN splits USING (entity_id)")
def j02_entity_split(spark, sf):
    f = src.events(spark, sf).select("flow_id", "entity_id")
    return prep.tag_split(f, prep.split_map(f)).select("flow_id", "split")


@query(f"WITH {FLOWS} SELECT flow_id, value AS drift_score, event_type FROM flows")
def j04_align(spark, sf):
    return quality.align(_decisions(spark, sf), src.events(spark, sf).select("flow_id", "event_type")).select(
        "flow_id", "drift_score", "event_type")


@query(f"WITH {TAGGED}, a AS (SELECT DISTINCT entity_id FROM tagged WHERE label = 1), n AS (SELECT DISTINCT entity_id FROM tagged WHERE label = 0) "
       "SELECT entity_id FROM a INTERSECT SELECT entity_id FROM n")
def j03_entity_intersection(spark, sf):
    t = src.events(spark, sf)
    return prep.attacks(t).select("entity_id").intersect(prep.normals(t).select("entity_id"))


@query("WITH " + FLOWS + " SELECT flow_id, value FROM flows ORDER BY flow_id LIMIT 1000")
def s07_limit_rows(spark, sf):
    return prep.limit_rows(src.events(spark, sf).select("flow_id", "value"), 1000)


@query("WITH " + FLOWS + " SELECT flow_id, value FROM flows WHERE flow_id % 3 = 0")
def s08_stride_sample(spark, sf):
    return prep.stride_sample(src.events(spark, sf).select("flow_id", "value"), 3)


@query(f"WITH {SCORES} SELECT flow_id, {r('sum(score) OVER (ORDER BY ts, flow_id)', 4)} AS total, row_number() OVER (ORDER BY ts, flow_id) AS row_num FROM scores")
def g01_prefix_sums(spark, sf):
    s = src.scores(spark, sf)
    out = ordered.prefix_sums(s, ["ts", "flow_id"], {"total": F.col("score"), "row_num": F.lit(1).cast("long")})
    return rounded(out.select("flow_id", "total", "row_num"), "total", digits=4)


@query(f"WITH {SCORES} SELECT q, {r('v')} AS v FROM (SELECT unnest([0.01,0.25,0.5,0.75,0.95,0.999]::DOUBLE[]) AS q, unnest(quantile_cont(score, [0.01,0.25,0.5,0.75,0.95,0.999])) AS v FROM scores)")
def g02_exact_quantiles(spark, sf):
    qs = [0.01, 0.25, 0.5, 0.75, 0.95, 0.999]
    vs = ordered.exact_quantiles(src.scores(spark, sf), "score", qs)
    return spark.createDataFrame(list(zip(qs, vs)), "q double, v double").select("q", r6("v").alias("v"))
