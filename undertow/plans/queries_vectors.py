"""Queries over hypervector encoding and entity state."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from undertow.functions import hypervec as H
from undertow.functions import scalars as S
from undertow.operators import encode, ewma, prep, recurrent, vectors
from undertow.plans import flows as src
from undertow.plans.queries_prep import STATES, _tagged
from undertow.plans.registry import DT, FLOWS, TAGGED, query, r, r6, rounded
from undertow.session import cut_lineage

D, L = 64, 32
CATS, NUMS = src.ENCODER_CATS, src.EVENT_NUMS


def sql_hv(key: str, width: int = D) -> str:
    return (
        f"list_transform(range({width}), lambda i: CASE WHEN substr(md5('42|' || {key} || '|' || CAST(i // 32 AS VARCHAR)), "
        "CAST(i % 32 AS INTEGER) + 1, 1) < '8' THEN 1 ELSE -1 END)"
    )


def sql_uniforms(name: str, count: int) -> str:
    return (
        f"list_transform(range({count}), lambda e: (CAST('0x' || substr(md5('42|{name}|' || CAST(e // 4 AS VARCHAR)), "
        "CAST(e % 4 AS INTEGER) * 8 + 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    )


_TEXT = "array_to_string(list_transform(hv, lambda x: CASE WHEN x < 0 THEN '1' ELSE '0' END), '')"

_CODE = f"""{TAGGED},
known AS (SELECT 'clock' AS col, clock AS token, min(flow_id) AS first_seen FROM tagged WHERE split = 'train' GROUP BY 1, 2
          UNION ALL SELECT 'weekday', weekday, min(flow_id) FROM tagged WHERE split = 'train' GROUP BY 1, 2),
alltok AS (SELECT DISTINCT 'clock' AS col, clock AS token FROM tagged UNION ALL SELECT DISTINCT 'weekday', weekday FROM tagged),
raw AS (SELECT a.col, a.token, k.token IS NOT NULL AS seen FROM alltok a LEFT JOIN known k USING (col, token)),
cat0 AS (SELECT col, token, seen, {sql_hv("CASE WHEN seen THEN 'tok:' || col || ':' || token ELSE 'oov:' || col END")} AS v, {sql_hv("'key:' || col")} AS kv FROM raw),
cat AS (SELECT col, token, seen, list_transform(v, lambda x, i: x * kv[i]) AS v FROM cat0),
ranges AS (SELECT 'value' AS col, min(value) AS lo, max(value) AS hi, avg(value) AS mu, stddev_pop(value) AS sd FROM tagged WHERE split = 'train'
           UNION ALL SELECT 'k', min(k), max(k), avg(k), stddev_pop(k) FROM tagged WHERE split = 'train'),
nums AS (SELECT flow_id, 'value' AS col, value AS x FROM tagged UNION ALL SELECT flow_id, 'k', k FROM tagged),
units AS (SELECT flow_id, col, x, mu, sd, least(greatest((x - lo) / (CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END), 0.0), 1.0) AS unit FROM nums JOIN ranges USING (col)),
lev0 AS (SELECT col, CAST(l AS INTEGER) AS level, {sql_hv("'level'")} AS b, {sql_hv("'key:' || col")} AS kv FROM ranges, range(0, {L}) g(l)),
lev AS (SELECT col, level, list_transform(b, lambda x, i: (CASE WHEN i <= level * {D // L} THEN -x ELSE x END) * kv[i]) AS v FROM lev0),
pick AS (SELECT flow_id, max(CASE WHEN col = 'value' THEN CAST(round_even(unit * {L - 1}, 0) AS INTEGER) END) AS lv, max(CASE WHEN col = 'k' THEN CAST(round_even(unit * {L - 1}, 0) AS INTEGER) END) AS lk FROM units GROUP BY 1),
enc AS (SELECT t.flow_id, t.label, NOT (a.seen AND b.seen) AS is_oov,
   list_transform(range({D}), lambda i: CASE WHEN a.v[i+1] + b.v[i+1] + c.v[i+1] + d.v[i+1] >= 0 THEN 1 ELSE -1 END) AS hv
 FROM tagged t JOIN pick p USING (flow_id) JOIN cat a ON a.col = 'clock' AND a.token = t.clock JOIN cat b ON b.col = 'weekday' AND b.token = t.weekday
 JOIN lev c ON c.col = 'value' AND c.level = p.lv JOIN lev d ON d.col = 'k' AND d.level = p.lk)"""


def fitted(spark, sf, width=D, levels=L):
    t = cut_lineage(_tagged(spark, sf).drop("dt"))  # read by every pass of the fit
    model = encode.fit_encoder(t.filter("split = 'train'"), CATS, NUMS, width, levels)
    return t, model


@query(f"WITH {_CODE} SELECT DISTINCT token, array_to_string(list_transform({sql_hv('token')}, lambda x: CASE WHEN x < 0 THEN '1' ELSE '0' END), '') AS hv FROM alltok")
def h01_base_vectors(spark, sf):
    tokens = src.events(spark, sf).select(F.explode(F.array(*CATS)).alias("token")).distinct()
    return tokens.select("token", H.as_text(H.base_hv("token", D)).alias("hv"))


@query(f"WITH {_CODE} SELECT DISTINCT lv AS level, array_to_string(list_transform(b, lambda x, i: CASE WHEN (CASE WHEN i <= lv * {D // L} THEN -x ELSE x END) < 0 THEN '1' ELSE '0' END), '') AS hv FROM pick, (SELECT {sql_hv(chr(39) + 'level' + chr(39))} AS b)")
def h02_level_vectors(spark, sf):
    t = _tagged(spark, sf)
    lo, hi = encode.fit_ranges(t.filter("split = 'train'"), ["value"])["value"]
    levels = t.select(S.to_level(S.minmax("value", lo, hi), L).alias("level")).distinct()
    return levels.select("level", H.as_text(H.level_hv("level", D, L)).alias("hv"))


@query(f"WITH {_CODE} SELECT col, {r('lo')} AS lo, {r('hi')} AS hi FROM ranges")
def h03_fit_ranges(spark, sf):
    ranges = encode.fit_ranges(_tagged(spark, sf).filter("split = 'train'"), NUMS)
    return spark.createDataFrame([(c, *b) for c, b in ranges.items()], "col string, lo double, hi double").select("col", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(f"WITH {_CODE} SELECT col, token, CAST(row_number() OVER (PARTITION BY col ORDER BY first_seen, token) AS INTEGER) AS token_id FROM known")
def h04_item_memory(spark, sf):
    return encode.fit_item_memory(_tagged(spark, sf).filter("split = 'train'"), CATS)


_IDS = "ids AS (SELECT col, token, CAST(row_number() OVER (PARTITION BY col ORDER BY first_seen, token) AS INTEGER) AS token_id FROM known)"


@query(f"WITH {_CODE}, {_IDS} SELECT t.flow_id, coalesce(a.token_id, 0) AS clock_id, coalesce(b.token_id, 0) AS weekday_id, a.token_id IS NULL OR b.token_id IS NULL AS is_oov "
       "FROM tagged t LEFT JOIN ids a ON a.col = 'clock' AND a.token = t.clock LEFT JOIN ids b ON b.col = 'weekday' AND b.token = t.weekday")
def h05_lookup(spark, sf):
    t = _tagged(spark, sf)
    vocab = encode.fit_item_memory(t.filter("split = 'train'"), CATS)
    return encode.lookup(t, vocab, CATS).select("flow_id", "clock_id", "weekday_id", "is_oov")


@query(f"WITH {_CODE} SELECT t.flow_id, {_TEXT} AS hv FROM (SELECT t.flow_id, a.v AS hv FROM tagged t JOIN cat a ON a.col = 'clock' AND a.token = t.clock) t")
def h06_bind(spark, sf):
    t, model = fitted(spark, sf)
    looked = encode.lookup(t, model.vocabulary, CATS)
    return looked.select("flow_id", H.as_text(encode._bound_categories(model)[0]).alias("hv"))


@query(f"WITH {_CODE} SELECT flow_id, {_TEXT} AS hv FROM (SELECT t.flow_id, list_transform(range({D}), lambda i: CASE WHEN a.v[i+1] + b.v[i+1] >= 0 THEN 1 ELSE -1 END) AS hv FROM tagged t JOIN cat a ON a.col='clock' AND a.token=t.clock JOIN cat b ON b.col='weekday' AND b.token=t.weekday)")
def h07_bundle(spark, sf):
    t, model = fitted(spark, sf)
    looked = encode.lookup(t, model.vocabulary, CATS)
    return looked.select("flow_id", H.as_text(H.bundle(*encode._bound_categories(model))).alias("hv"))


@query(f"WITH {_CODE} SELECT flow_id, is_oov, {_TEXT} AS hv FROM enc")
def h08_record_encoder(spark, sf):
    t, model = fitted(spark, sf)
    return encode.encode(t, model, keep=["flow_id"]).select("flow_id", "is_oov", H.as_text("hv").alias("hv"))


@query(f"WITH {_CODE} SELECT flow_id, is_oov, {_TEXT} AS hv FROM enc")
def h08_record_encoder_expression(spark, sf):
    t, model = fitted(spark, sf)
    return encode.encode_expression(t, model).select("flow_id", "is_oov", H.as_text("hv").alias("hv"))


_BREAKS = ", ".join(f"CAST({b!r} AS DOUBLE)" for b in S.SAX_BREAKPOINTS_8)


@query(f"""WITH {_CODE}, sym AS (SELECT flow_id, max(CASE WHEN col='value' THEN s END) AS sv, max(CASE WHEN col='k' THEN s END) AS sk FROM
  (SELECT flow_id, col, len(list_filter([{_BREAKS}], lambda b: (x - mu) / (CASE WHEN sd > 1e-6 THEN sd ELSE 1.0 END) >= b)) AS s FROM units) GROUP BY 1),
  sv0 AS (SELECT col, s, {sql_hv("'sym:' || CAST(s AS VARCHAR)")} AS b, {sql_hv("'key:' || col")} AS kv FROM ranges, range(0, 8) g(s)), sv AS (SELECT col, s, list_transform(b, lambda x, i: x * kv[i]) AS v FROM sv0)
  SELECT flow_id, {_TEXT} AS hv FROM (SELECT t.flow_id, list_transform(range({D}), lambda i: CASE WHEN a.v[i+1] + b.v[i+1] + c.v[i+1] + d.v[i+1] >= 0 THEN 1 ELSE -1 END) AS hv
  FROM tagged t JOIN sym p USING (flow_id) JOIN cat a ON a.col='clock' AND a.token=t.clock JOIN cat b ON b.col='weekday' AND b.token=t.weekday JOIN sv c ON c.col='value' AND c.s=p.sv JOIN sv d ON d.col='k' AND d.s=p.sk)""")
def h09_sax_encoder(spark, sf):
    t, model = fitted(spark, sf)
    return encode.encode(t, model, "sax", keep=["flow_id"]).select("flow_id", H.as_text("hv").alias("hv"))


@query(f"""WITH {_CODE}, g AS (SELECT {sql_uniforms('rff:w:u', 2 * D)} AS u, {sql_uniforms('rff:w:v', 2 * D)} AS v, {sql_uniforms('rff:b', D)} AS b),
  w AS (SELECT list_transform(u, lambda x, i: sqrt(-2.0 * ln(x)) * cos(2.0 * pi() * v[i])) AS w, list_transform(b, lambda x: x * 2.0 * pi()) AS b FROM g),
  un AS (SELECT flow_id, max(CASE WHEN col='value' THEN unit END) AS uv, max(CASE WHEN col='k' THEN unit END) AS uk FROM units GROUP BY 1)
  SELECT flow_id, {_TEXT} AS hv FROM (SELECT t.flow_id, list_transform(range({D}), lambda i: CASE WHEN a.v[i+1] + c.v[i+1] + sqrt(2.0 / {D}) * cos(un.uv * w.w[i+1] + un.uk * w.w[{D}+i+1] + w.b[i+1]) >= 0 THEN 1 ELSE -1 END) AS hv
  FROM tagged t JOIN un USING (flow_id) JOIN cat a ON a.col='clock' AND a.token=t.clock JOIN cat c ON c.col='weekday' AND c.token=t.weekday, w)""")
def h10_rff_encoder(spark, sf):
    t, model = fitted(spark, sf)
    return encode.encode(t, model, "rff", keep=["flow_id"]).select("flow_id", H.as_text("hv").alias("hv"))


@query(f"WITH {_CODE}, kk AS (SELECT list_transform({sql_hv(chr(39) + 'key:clock' + chr(39))}, lambda x, i: x * ({sql_hv(chr(39) + 'key:weekday' + chr(39))})[i]) AS p) "
       f"SELECT flow_id, {_TEXT} AS hv FROM (SELECT flow_id, list_transform(hv, lambda x, i: CASE WHEN x + x * p[i] >= 0 THEN 1 ELSE -1 END) AS hv FROM enc, kk)")
def h11_structured_encoder(spark, sf):
    t, model = fitted(spark, sf)
    out = encode.structured(encode.encode(t, model, keep=["flow_id"]), model)
    return out.select("flow_id", H.as_text("structured_hv").alias("hv"))


@query(f"WITH {_CODE} SELECT flow_id, lower(array_to_string(list_transform(range(0, {D}, 4), lambda j: printf('%x', CAST((CASE WHEN hv[j+1]<0 THEN 8 ELSE 0 END) + (CASE WHEN hv[j+2]<0 THEN 4 ELSE 0 END) + (CASE WHEN hv[j+3]<0 THEN 2 ELSE 0 END) + (CASE WHEN hv[j+4]<0 THEN 1 ELSE 0 END) AS INTEGER))), '')) AS bits FROM enc")
def h12_packed_encoder(spark, sf):
    t, model = fitted(spark, sf)
    return encode.encode(t, model, packed=True, keep=["flow_id"]).select("flow_id", F.lower(F.hex("hv")).alias("bits"))


@query(f"WITH {_CODE} SELECT flow_id, {_TEXT} AS hv, TRUE AS same FROM enc")
def h13_unpack(spark, sf):
    t, model = fitted(spark, sf)
    packed = encode.encode(t, model, packed=True, keep=["flow_id"])
    opened = packed.withColumn("x", encode.unpack("hv", D))
    return opened.select("flow_id", H.as_text("x").alias("hv"), (encode.pack("x") == F.col("hv")).alias("same"))


@query(f"WITH {_CODE} SELECT flow_id, {_TEXT} AS hv FROM (SELECT flow_id, list_concat(hv[{D - 4}:{D}], hv[1:{D - 5}]) AS hv FROM enc)")
def h14_permute(spark, sf):
    t, model = fitted(spark, sf)
    return encode.encode(t, model, keep=["flow_id"]).select("flow_id", H.as_text(H.permute("hv", 5)).alias("hv"))


@query(f"WITH {_CODE}, q AS (SELECT {sql_hv(chr(39) + 'query' + chr(39))} AS q) SELECT flow_id, CAST(len(list_filter(list_transform(hv, lambda x, i: x * q[i]), lambda y: y < 0)) AS INTEGER) AS distance FROM enc, q")
def h15_hamming(spark, sf):
    t, model = fitted(spark, sf)
    target = H.pack_bits(H.base_vector("query", D)[None, :])[0].tobytes()
    packed = encode.encode(t, model, packed=True, keep=["flow_id"])
    return packed.select("flow_id", encode.hamming_packed("hv", target).alias("distance"))


@query(f"WITH {_CODE}, q AS (SELECT {sql_hv(chr(39) + 'query' + chr(39))} AS q) SELECT flow_id, {r(f'list_sum(list_transform(hv, lambda x, i: x * q[i])) / {D}.0')} AS similarity FROM enc, q ORDER BY list_sum(list_transform(hv, lambda x, i: x * q[i])) DESC, flow_id LIMIT 25")
def h16_most_similar(spark, sf):
    t, model = fitted(spark, sf)
    hv = encode.encode(t, model, keep=["flow_id"])
    return encode.most_similar(hv, H.base_vector("query", D), 25).select("flow_id", r6("similarity").alias("similarity"))


@query(f"""WITH {_CODE}, dims AS (SELECT label, i, avg(hv[i]) AS m, var_samp(hv[i]) AS v FROM enc, range(1, {D + 1}) g(i) GROUP BY 1, 2),
  c AS (SELECT a.i, a.m AS m0, b.m AS m1, a.v + b.v AS v FROM dims a JOIN dims b ON a.i = b.i AND a.label = 0 AND b.label = 1),
  u AS (SELECT label, i, avg(hv[i] / sqrt({D}.0)) AS m FROM enc, range(1, {D + 1}) g(i) GROUP BY 1, 2),
  s AS (SELECT sum(a.m * a.m) AS intra, sum(a.m * b.m) AS inter FROM u a JOIN u b ON a.i = b.i AND a.label = 0 AND b.label = 1),
  f AS (SELECT 1.0 - sum(m0 * m1) / (sqrt(sum(m0 * m0)) * sqrt(sum(m1 * m1))) AS cd, sqrt(sum((m0 - m1) ** 2)) AS gap, sum(v) AS v FROM c)
  SELECT {r('cd')} AS cos_dist, {r(f'gap / sqrt({D}.0)')} AS eucl_dist, {r('gap * gap / (v + 1e-8)')} AS fisher_ratio, {r('intra')} AS intra_sim, {r('inter')} AS inter_sim, {r('intra - inter')} AS margin FROM f, s""")
def h17_encoder_separability(spark, sf):
    t, model = fitted(spark, sf)
    hv = encode.encode(t, model, keep=["flow_id", "label"])
    return rounded(encode.encoder_separability(hv), "cos_dist", "eucl_dist", "fisher_ratio", "intra_sim", "inter_sim", "margin")


@query(f"WITH {_CODE}, {_IDS}, n AS (SELECT count(*) FILTER (col='clock') AS nc FROM ids) SELECT t.flow_id, CAST(2 + coalesce(a.token_id, 0) AS INTEGER) AS clock_slot, CAST(2 + nc + 1 + coalesce(b.token_id, 0) AS INTEGER) AS weekday_slot, t.value, t.k "
       "FROM tagged t LEFT JOIN ids a ON a.col='clock' AND a.token=t.clock LEFT JOIN ids b ON b.col='weekday' AND b.token=t.weekday, n")
def n12_raw_features(spark, sf):
    """The vector's own indices and values are read; it is never filled up to its width."""
    t, model = fitted(spark, sf)
    out = encode.raw_features(t, model).withColumn("a", vectors.sparse_parts("features"))
    at = F.map_from_arrays("a.indices", "a.values")
    slots = F.filter("a.indices", lambda i: (i >= 2) & (F.element_at(at, i) == 1.0))
    number = lambda i: F.coalesce(F.element_at(at, F.lit(i)), F.lit(0.0))
    return out.select("flow_id", F.element_at(slots, 1).alias("clock_slot"), F.element_at(slots, 2).alias("weekday_slot"), number(0).alias("value"), number(1).alias("k"))


@query(f"WITH {FLOWS}, f AS (SELECT *, hour || '_' || weekday AS pair FROM flows), v AS (SELECT pair, CAST(row_number() OVER (ORDER BY pair) - 1 AS INTEGER) AS slot FROM (SELECT DISTINCT pair FROM f)) "
       f"SELECT flow_id, {r('value * k')} AS dur_x_count, {r('k * (value / 10.0)')} AS count_x_rate, {r('(k + 1) * (value / 10.0)')} AS bytes_x_rate, slot FROM f JOIN v USING (pair)")
def n13_interactions(spark, sf):
    f = src.events(spark, sf).withColumns({"rate": F.col("value") / 10.0, "size": F.col("k") + 1})
    out, _ = encode.interactions(f, "value", "k", "rate", "size", "hour", "weekday")
    return rounded(out.select("flow_id", "dur_x_count", "count_x_rate", "bytes_x_rate", "slot"), "dur_x_count", "count_x_rate", "bytes_x_rate")


@query(f"WITH {_CODE} SELECT t.flow_id, coalesce(array_to_string(list_transform(a.v, lambda x: CASE WHEN x < 0 THEN '1' ELSE '0' END), ''), '') AS hv FROM tagged t LEFT JOIN (SELECT * FROM cat WHERE seen) a ON a.col = 'clock' AND a.token = t.clock")
def j01_codebook_lookup(spark, sf):
    t, model = fitted(spark, sf)
    book = model.vocabulary.filter("col = 'clock'").select(F.col("token").alias("clock"), H.as_text(H.bind(
        H.base_hv(F.concat(F.lit("tok:clock:"), "token"), D), H.literal_hv(H.base_vector("key:clock", D)))).alias("hv"))
    from undertow.session import broadcast_if_small

    return t.join(broadcast_if_small(book), "clock", "left").select("flow_id", F.coalesce("hv", F.lit("")).alias("hv"))


# --------------------------------------------------------------------------- entity state

_HID, _UNITS, _IN = 4, 6, 2


def _weights(name, rows, cols, bound):
    return f"list_transform({sql_uniforms(name, rows * cols)}, lambda u: (2.0 * u - 1.0) * {bound!r}::DOUBLE)"


def _cfc_sql():
    b1, b2 = 1.0 / float(np.sqrt(_IN + _HID)), 1.0 / float(np.sqrt(_UNITS))
    width = _IN + _HID
    xs = ["value / 100.0", "k / 100.0"]
    back = " + ".join([f"wb[CAST(u * {width} + {i + 1} AS BIGINT)] * x[{i + 1}]" for i in range(_IN)] + [f"wb[CAST(u * {width} + {_IN + i + 1} AS BIGINT)] * h[{i + 1}]" for i in range(_HID)])
    head = " + ".join(f"wh[CAST(j * {_UNITS} + {u + 1} AS BIGINT)] * z[{u + 1}]" for u in range(_UNITS))
    return f"""WITH RECURSIVE {DT},
num AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, flow_id) AS rn, [{xs[0]}, {xs[1]}] AS x FROM gaps),
w AS (SELECT {_weights('cfc:backbone', _UNITS, width, b1)} AS wb, {_weights('cfc:backbone_bias', 1, _UNITS, b1)} AS bb,
             {_weights('cfc:heads', 4 * _HID, _UNITS, b2)} AS wh, {_weights('cfc:head_bias', 1, 4 * _HID, b2)} AS hb),
walk AS (
  SELECT entity_id, CAST(0 AS BIGINT) AS flow_id, CAST(0 AS BIGINT) AS rn, list_transform(range({_HID}), lambda i: 0.0::DOUBLE) AS h, [0.0::DOUBLE] AS z, 0.0::DOUBLE AS dt FROM num GROUP BY entity_id
  UNION ALL
  SELECT entity_id, flow_id, rn,
    list_transform(range({_HID}), lambda i: tanh(y[i+1]) * (1.0 - 1.0 / (1.0 + exp(-(y[i+1+{2 * _HID}] * dt + y[i+1+{3 * _HID}])))) + (1.0 / (1.0 + exp(-(y[i+1+{2 * _HID}] * dt + y[i+1+{3 * _HID}])))) * tanh(y[i+1+{_HID}])) AS h, z, dt
  FROM (SELECT entity_id, flow_id, rn, dt, z, list_transform(range({4 * _HID}), lambda j: {head} + hb[j+1]) AS y, wh, hb
        FROM (SELECT entity_id, flow_id, rn, dt, wh, hb, list_transform(range({_UNITS}), lambda u: 1.7159 * tanh(0.666 * ({back} + bb[u+1]))) AS z
              FROM (SELECT n.entity_id, n.flow_id, n.rn, n.dt, n.x, walk.h, w.wb, w.bb, w.wh, w.hb FROM walk JOIN num n ON n.entity_id = walk.entity_id AND n.rn = walk.rn + 1, w)))
)"""


def _small_cell():
    return recurrent.CfCCell.seeded(_IN, _HID, _UNITS)


_READ = recurrent.columns_reader(["value", "k"], [0.01, 0.01])


def _small_states(spark, sf, **kw):
    f = src.events(spark, sf).select("flow_id", "entity_id", "ts", "value", "k", "label")
    return recurrent.state_scan(f, _small_cell(), _READ, **kw)


_HSUM = "list_sum(list_transform(h, lambda v, i: v * i))"


def _weighted(c):
    return F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)


@query(_cfc_sql() + f" SELECT flow_id, {r('h[1]')} AS h1, {r('h[2]')} AS h2, {r('h[3]')} AS h3, {r('h[4]')} AS h4 FROM walk WHERE rn > 0")
def t02_state_scan(spark, sf):
    s = _small_states(spark, sf)
    return s.select("flow_id", *[r6(F.col("h")[i]).alias(f"h{i + 1}") for i in range(_HID)])


@query(_cfc_sql() + f" SELECT flow_id, {r('list_sum(list_transform(z, lambda v, i: v * i))')} AS z_sum, {r('dt')} AS dt FROM walk WHERE rn > 0")
def t03_backbone_output(spark, sf):
    return _small_states(spark, sf).select("flow_id", r6(_weighted("z")).alias("z_sum"), r6("dt").alias("dt"))


@query(_cfc_sql() + f", d AS (SELECT a.flow_id, list_transform(a.h, lambda v, i: v - b.h[i]) AS h FROM walk a JOIN walk b ON a.entity_id = b.entity_id AND a.rn = b.rn + 1) SELECT flow_id, {r(_HSUM)} AS delta_sum FROM d")
def t05_state_deltas(spark, sf):
    s = recurrent.state_deltas(_small_states(spark, sf), "h")
    return s.select("flow_id", r6(_weighted("h_delta")).alias("delta_sum"))


@query(None)
def t01_cell_step_parity(spark, sf):
    """Largest difference between the scan and single cell steps on its own previous states."""
    from undertow.operators import ordered

    s = _small_states(spark, sf)
    seen = ordered.sliced_order(s, "entity_id", ["ts", "flow_id"], lags={"prev": "h"})
    cell = _small_cell()

    def again(x1, x2, dt, prev):
        p = prev.fill_null(vectors.pa.scalar([0.0] * _HID, prev.type))
        x = np.column_stack([x1.to_numpy(zero_copy_only=False), x2.to_numpy(zero_copy_only=False)])
        return vectors.list_column(cell.step(cell.project(x), vectors.matrix(p), dt.to_numpy(zero_copy_only=False))[0])

    step = F.arrow_udf(again, "array<double>")
    out = seen.withColumn("again", step(F.col("value") / 100.0, F.col("k") / 100.0, "dt", "prev"))
    gap = F.array_max(F.transform(F.arrays_zip("h", "again"), lambda p: F.abs(p["h"] - p["again"])))
    return out.agg(F.count(F.lit(1)).alias("row_count"), (F.max(gap) < 1e-9).alias("same"))


_RW = [[0.3, -0.2, 0.1, 0.4], [-0.1, 0.25, 0.05, -0.3]]


@query(_cfc_sql() + " SELECT flow_id, " + ", ".join(
    r(" + ".join(f"{_RW[o][i]} * h[{i + 1}]" for i in range(_HID)) + f" + {0.1 * (o + 1)}") + f" AS y{o + 1}" for o in range(2)) + " FROM walk WHERE rn > 0")
def t06_predict_next(spark, sf):
    readout = recurrent.Readout(np.array(_RW).T, np.array([0.1, 0.2]))
    out = recurrent.predict_next(_small_states(spark, sf), readout)
    return out.select("flow_id", *[r6(F.col("predicted")[i]).alias(f"y{i + 1}") for i in range(2)])


def sql_solve(source: str, name: str, size: int) -> str:
    """Gauss-Jordan on an augmented matrix m (list of rows) held in one row of `source`."""
    return f"""{name} AS (
  SELECT 0 AS step, m FROM {source}
  UNION ALL
  SELECT step + 1, list_transform(m, lambda row, i: CASE WHEN i = step + 1 THEN list_transform(row, lambda x: x / d)
           ELSE list_transform(row, lambda x, j: x - row[step + 1] * p[j] / d) END)
  FROM (SELECT step, m, m[step + 1] AS p, m[step + 1][step + 1] AS d FROM {name} WHERE step < {size}))"""


@query(_cfc_sql() + f""", pairs AS (SELECT [b.h[1], b.h[2], b.h[3], b.h[4], 1.0] AS a, n.x AS y, CASE WHEN n.label = 1 THEN 2.0 ELSE 1.0 END AS wt FROM walk b JOIN num n ON n.entity_id = b.entity_id AND n.rn = b.rn + 1 WHERE b.rn > 0),
 g AS (SELECT i, j, sum(wt * a[i] * (CASE WHEN j <= 5 THEN a[least(j, 5)] ELSE y[greatest(j - 5, 1)] END)) + CASE WHEN i = j AND i <= 4 THEN 0.001 ELSE 0.0 END AS v FROM pairs, range(1, 6) p(i), range(1, 8) q(j) GROUP BY i, j),
 mat AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM g GROUP BY i)), {sql_solve('mat', 'gj', 5)}
 SELECT CAST(i AS INTEGER) AS term, {r('m[i][6]')} AS y1, {r('m[i][7]')} AS y2 FROM gj, range(1, 6) t(i) WHERE step = 5""")
def t07_fit_readout(spark, sf):
    s = _small_states(spark, sf).withColumn("x", F.array(F.col("value") / 100.0, F.col("k") / 100.0))
    ro = recurrent.fit_readout(recurrent.next_pairs(s, "h", "x"), positive_weight=2.0)
    rows = [(i + 1, float(w[0]), float(w[1])) for i, w in enumerate([*ro.weights, ro.bias])]
    return rounded(spark.createDataFrame(rows, "term int, y1 double, y2 double"), "y1", "y2")


@query(f"""WITH {STATES}, b AS (SELECT *, flow_id // 128 AS block FROM states), mu AS (SELECT block, i, avg(h[i]) AS m FROM b, range(1, 65) g(i) WHERE label = 0 GROUP BY 1, 2),
 mv AS (SELECT block, list(m ORDER BY i) AS m FROM mu GROUP BY 1), cnt AS (SELECT block, count(*) AS row_count, count(*) FILTER (label=0) AS ng, count(*) FILTER (label=1) AS nb FROM b GROUP BY 1),
 good AS (SELECT block, avg(list_sum(list_transform(h, lambda x, i: (x - m[i]) ** 2)) / 64.0) AS c FROM b JOIN mv USING (block) WHERE label = 0 GROUP BY 1),
 far AS (SELECT block, avg(greatest(4.0 - sqrt(list_sum(list_transform(h, lambda x, i: (x - m[i]) ** 2))), 0.0)) AS s FROM b JOIN mv USING (block) WHERE label = 1 GROUP BY 1),
 near AS (SELECT a.block, a.flow_id, min(sqrt(list_sum(list_transform(a.h, lambda x, i: (x - n.h[i]) ** 2)))) AS d FROM b a JOIN b n ON a.block = n.block AND a.label = 1 AND n.label = 0 GROUP BY 1, 2),
 bd AS (SELECT block, avg(greatest(3.0 - d, 0.0)) AS s FROM near GROUP BY 1)
 SELECT block, row_count, {r('c')} AS compactness, {r('far.s')} AS separation, {r('bd.s')} AS boundary FROM cnt JOIN good USING (block) JOIN far USING (block) JOIN bd USING (block)""")
def t08_separation_loss(spark, sf):
    out = recurrent.separation_loss(src.states(spark, sf), "h", batch=128)
    return rounded(out, "compactness", "separation", "boundary")


@query(None)
def t09_gated_scan(spark, sf):
    f = src.events(spark, sf).select("flow_id", "entity_id", "ts", "value", "k")
    out = recurrent.state_scan(f, recurrent.LSTMCell.seeded(2, 4), _READ)
    return out.select("flow_id", *[r6(F.col("h")[i]).alias(f"h{i + 1}") for i in range(4)])


_CK = [[[0.2, -0.1, 0.5], [0.1, 0.3, -0.2]], [[-0.4, 0.2, 0.1], [0.05, -0.15, 0.25]]]


def _conv_sql():
    outs = []
    for o in range(2):
        terms = [str(0.01 * (o + 1))]
        for i, c in enumerate(("value", "k")):
            for t in range(3):
                x = c if t == 0 else f"coalesce(lag({c}, {t}) OVER w, 0.0)"
                terms.append(f"{_CK[o][i][2 - t]} * {x}")
        outs.append(r(" + ".join(terms)) + f" AS c{o + 1}")
    return f"WITH {FLOWS} SELECT flow_id, {', '.join(outs)} FROM flows WINDOW w AS (PARTITION BY entity_id ORDER BY ts, flow_id)"


@query(_conv_sql())
def t10_causal_conv(spark, sf):
    out = recurrent.causal_conv(src.events(spark, sf), ["value", "k"], np.array(_CK), np.array([0.01, 0.02]))
    return out.select("flow_id", *[r6(F.col("conv")[i]).alias(f"c{i + 1}") for i in range(2)])


def _ssm_sql(states=2):
    u = lambda n, k: f"({sql_uniforms(n, k)})"
    h_new = ", ".join(f"exp(delta * -{n + 1}.0) * h[{n + 1}] + delta * (x * wb[{n + 1}]) * x" for n in range(states))
    y = " + ".join(f"h[{n + 1}] * (px * pc[{n + 1}])" for n in range(states))
    b = 1.0 / float(np.sqrt(states))
    return f"""WITH RECURSIVE {FLOWS}, num AS (SELECT flow_id, entity_id, value / 100.0 AS x, row_number() OVER (PARTITION BY entity_id ORDER BY ts, flow_id) AS rn FROM flows),
 w AS (SELECT 2.0 * {u('ssm:delta', 1)}[1] - 1.0 AS wd, 2.0 * {u('ssm:delta_bias', 1)}[1] - 1.0 AS bd, {_weights('ssm:b', 1, states, b)} AS wb, {_weights('ssm:c', 1, states, b)} AS wc),
 inp AS (SELECT num.*, ln(1.0 + exp(x * wd + bd)) AS delta, wb, wc FROM num, w),
 walk AS (SELECT entity_id, CAST(0 AS BIGINT) AS flow_id, CAST(0 AS BIGINT) AS rn, list_transform(range({states}), lambda i: 0.0::DOUBLE) AS h, 0.0::DOUBLE AS px, [0.0::DOUBLE] AS pc FROM num GROUP BY 1
  UNION ALL SELECT n.entity_id, n.flow_id, n.rn, [{h_new}], n.x, n.wc FROM walk JOIN inp n ON n.entity_id = walk.entity_id AND n.rn = walk.rn + 1)
 SELECT flow_id, {r(y + ' + px')} AS y FROM walk WHERE rn > 0"""


@query(_ssm_sql())
def t11_state_space_scan(spark, sf):
    f = src.events(spark, sf).select("flow_id", "entity_id", "ts", "value")
    out = recurrent.state_scan(f, recurrent.SSMCell.seeded(1, 2), recurrent.columns_reader(["value"], [0.01]))
    return out.select("flow_id", r6(F.col("y")[0]).alias("y"))


@query(None)
def t12_linear_ae(spark, sf):
    st = src.states(spark, sf)
    ae = recurrent.fit_linear_ae(prep.normals(st), "h", 16)
    out = recurrent.reconstruct(st, ae, "h")
    return out.select("flow_id", "label", r6(_weighted("reconstruction")).alias("checksum"))


@query(f"WITH {FLOWS} SELECT a.flow_id, {r('sum(b.value * exp(-0.0005 * (a.ts - b.ts)))', 4)} AS decayed FROM flows a JOIN flows b ON a.entity_id = b.entity_id AND (b.ts < a.ts OR (b.ts = a.ts AND b.flow_id <= a.flow_id)) GROUP BY a.flow_id")
def t13_decay_state(spark, sf):
    f = src.events(spark, sf).select("flow_id", "entity_id", "ts", "value")
    return rounded(recurrent.decay_state(f, "value", 0.0005).select("flow_id", "decayed"), "decayed", digits=4)


# --------------------------------------------------------------------------- adaptive thresholds


def ewma_sql(alpha=0.05, k=3.0, warmup=0, initial=1.0, value="value"):
    return f"""WITH RECURSIVE {FLOWS}, num AS (SELECT flow_id, entity_id, label, {value} AS d, row_number() OVER (PARTITION BY entity_id ORDER BY ts, flow_id) AS rn FROM flows),
 walk AS (SELECT flow_id, entity_id, label, rn, d, d AS mean, 0.0::DOUBLE AS var, {initial}::DOUBLE AS threshold, ({str(warmup == 0 and initial < 1.0).upper()} AND d > {initial}) AS hit FROM num WHERE rn = 1
  UNION ALL SELECT flow_id, entity_id, label, rn, d, mean, var, mean + {k}::DOUBLE * sqrt(var), d > mean + {k}::DOUBLE * sqrt(var) AND rn > {warmup}
  FROM (SELECT n.flow_id, n.entity_id, n.label, n.rn, n.d, w.mean + {alpha}::DOUBLE * (n.d - w.mean) AS mean, (1 - {alpha}::DOUBLE) * (w.var + {alpha}::DOUBLE * (n.d - w.mean) * (n.d - w.mean)) AS var
        FROM walk w JOIN num n ON n.entity_id = w.entity_id AND n.rn = w.rn + 1))"""


@query(ewma_sql(warmup=3, value="ln(1 + value)") + f" SELECT flow_id, {r('mean')} AS ewma_mean, {r('var')} AS ewma_var, {r('threshold')} AS ewma_threshold, hit AS is_anomaly FROM walk")
def m28_ewma_drift(spark, sf):
    f = src.events(spark, sf).select("flow_id", "entity_id", "ts", S.log_clip("value").alias("value"))
    out = ewma.ewma_drift(f, "value", warmup=3).drop("entity_id", "ts", "value")
    return rounded(out, "ewma_mean", "ewma_var", "ewma_threshold")


@query(f"WITH {FLOWS} SELECT {r('avg(value) + stddev_pop(value)')} AS initial_threshold FROM flows WHERE label = 0")
def m29_ewma_initial(spark, sf):
    return rounded(ewma.initial_threshold(src.events(spark, sf), "value"), "initial_threshold")


@query(ewma_sql(k=1.0) + """, ks AS (SELECT j, 0.1::DOUBLE + j * 0.1::DOUBLE AS k FROM range(0, 40) g(j)),
 c AS (SELECT j, k, count(*) FILTER (hit AND label = 1) AS tp, count(*) FILTER (hit AND label = 0) AS fp, count(*) FILTER (NOT hit AND label = 1) AS fn
   FROM (SELECT j, k, label, rn > 1 AND d > mean + k * sqrt(var) AS hit FROM walk, ks) GROUP BY j, k)
 SELECT round(k, 6) AS k, """ + r("CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END") + " AS f1 FROM c ORDER BY f1 DESC, j LIMIT 1")
def m30_ewma_k(spark, sf):
    f = src.events(spark, sf).select("flow_id", "entity_id", "ts", "value", "label")
    return rounded(ewma.fit_k(f, "value"), "k", "f1")


@query(ewma_sql(warmup=3) + f""", c AS (SELECT count(*) FILTER (hit AND label=1) AS tp, count(*) FILTER (hit AND label=0) AS fp, count(*) FILTER (NOT hit AND label=1) AS fn, count(*) FILTER (NOT hit AND label=0) AS tn FROM walk),
 m AS (SELECT *, CASE WHEN tp+fp=0 THEN 0.0 ELSE tp*1.0/(tp+fp) END AS precision, CASE WHEN tp+fn=0 THEN 0.0 ELSE tp*1.0/(tp+fn) END AS recall, CASE WHEN fp+tn=0 THEN 0.0 ELSE fp*1.0/(fp+tn) END AS fpr FROM c)
 SELECT tp, fp, fn, tn, {r('precision')} AS precision, {r('recall')} AS recall, {r('CASE WHEN precision+recall=0 THEN 0.0 ELSE 2*precision*recall/(precision+recall) END')} AS f1, {r('fpr')} AS fpr FROM m""")
def flagship_drift_metrics(spark, sf):
    """Events to adaptive per-user thresholds to verdicts to metrics."""
    from undertow.operators import evaluate

    f = src.events(spark, sf).select("flow_id", "entity_id", "ts", "value", "label")
    scored = ewma.ewma_drift(f, "value", warmup=3)
    return rounded(evaluate.confusion(scored, F.col("is_anomaly")), "precision", "recall", "f1", "fpr")
