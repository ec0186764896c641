"""Queries over the normal manifold, scores and heads. All vectors are used at their full 64 dimensions."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import functions as F

from undertow.functions import scalars as S
from undertow.operators import calibrate, covariance, evaluate, manifold, nearest, prep, recurrent, scoring, vectors
from undertow.plans import flows as src
from undertow.plans.queries_prep import STATES
from undertow.plans.queries_vectors import sql_solve
from undertow.plans.registry import query, r, r6, rounded
from undertow.session import cut_lineage

P = 64


def _mean(src_, name):
    return f"{name} AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(h[i]) AS m FROM {src_}, range(1, {P + 1}) g(i) GROUP BY i))"


def _trimmed(source, name, ratio=0.02):
    return (
        f"{_mean(source, name + '_m0')}, {name}_d AS (SELECT s.*, list_sum(list_transform(h, lambda x, i: (x - mu[i]) ** 2)) AS d2 FROM {source} s, {name}_m0), "
        f"{name} AS (SELECT * FROM {name}_d WHERE d2 <= (SELECT quantile_cont(d2, {1 - ratio}) FROM {name}_d))"
    )


def _scatter(source, name):
    """Mean, centred rows, covariance cells and scalar sums."""
    return f"""{_mean(source, name + '_mu')},
 {name}_c AS (SELECT list_transform(h, lambda x, i: x - mu[i]) AS c FROM {source}, {name}_mu),
 {name}_s AS (SELECT i, j, avg(c[i] * c[j]) AS s FROM {name}_c, range(1, {P + 1}) a(i), range(1, {P + 1}) b(j) GROUP BY i, j),
 {name}_t AS (SELECT sum(s) FILTER (i = j) / {P} AS m, sum(s * s) AS fro, (SELECT count(*) FROM {name}_c) AS n,
    (SELECT avg(list_sum(list_transform(c, lambda x: x * x)) ** 2) FROM {name}_c) AS q FROM {name}_s)"""


def _lw(source, name):
    """Shrinkage and precision of Ledoit-Wolf, the inverse by elimination."""
    return f"""{_scatter(source, name)},
 {name}_r AS (SELECT m, n, CASE WHEN fro - {P} * m * m <= 0 THEN 0.0 ELSE least(greatest((q - fro) / ({P} * n), 0.0), (fro - {P} * m * m) / {P}) / ((fro - {P} * m * m) / {P}) END AS rho FROM {name}_t),
 {name}_a AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list_concat(list((1 - rho) * s + CASE WHEN i = j THEN rho * m ELSE 0.0 END ORDER BY j), list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j)) AS row FROM {name}_s, {name}_r GROUP BY i)),
 {sql_solve(name + '_a', name + '_gj', P)},
 {name}_p AS (SELECT list_transform(m, lambda row: row[{P + 1}:{2 * P}]) AS p FROM {name}_gj WHERE step = {P})"""


def _dist(name):
    """Distance of h to the fitted mean; expects h, mu and p in scope as {name}_mu.mu and {name}_p.p."""
    d = f"list_transform(h, lambda x, i: x - {name}_mu.mu[i])"
    return f"sqrt(greatest(list_dot_product({d}, list_transform({name}_p.p, lambda row: list_dot_product(row, {d}))), 0.0))"


_N = "n0 AS (SELECT * FROM states WHERE label = 0), " + _trimmed("n0", "core")
_A = "a0 AS (SELECT * FROM states WHERE label = 1)"
_NORMAL = f"{STATES}, {_N}, {_lw('core', 'nm')}"
_BOTH = f"{_NORMAL}, {_A}, {_lw('a0', 'at')}, dist AS (SELECT flow_id, label, h, {_dist('nm')} AS dn, {_dist('at')} AS da FROM states, nm_mu, nm_p, at_mu, at_p), lrs AS (SELECT *, dn / (da + 0.5) AS lr FROM dist)"
_REC = "WITH RECURSIVE "


def _normal_model(spark, sf, **kw):
    st = src.states(spark, sf)
    return st, manifold.fit_manifold(prep.normals(st), "h", **kw)


@query(f"WITH {STATES}, {_N} SELECT flow_id FROM core")
def m01_trim_core(spark, sf):
    return manifold.trim_core(prep.normals(src.states(spark, sf)), "h").select("flow_id")


@query(f"WITH {STATES} SELECT CAST(i AS INTEGER) AS dim, {r('avg(h[i])')} AS mean FROM states, range(1, {P + 1}) g(i) GROUP BY i")
def m02_vector_mean(spark, sf):
    mean = vectors.vector_mean(src.states(spark, sf), "h")
    return rounded(spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(mean)], "dim int, mean double"), "mean")


@query(f"WITH {STATES}, {_scatter('states', 'x')} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('s', 8)} AS pop, {r('s * n / (n - 1) + CASE WHEN i = j THEN 1e-5 ELSE 0 END', 8)} AS samp FROM x_s, x_t")
def m03_covariance(spark, sf):
    m = vectors.moments(src.states(spark, sf), "h")[0]
    a, b = m.covariance(0), m.covariance(1, 1e-5)
    rows = [(i + 1, j + 1, float(a[i, j]), float(b[i, j])) for i in range(P) for j in range(P)]
    return rounded(spark.createDataFrame(rows, "i int, j int, pop double, samp double"), "pop", "samp", digits=8)


@query(f"{_REC}{STATES}, n0 AS (SELECT * FROM states WHERE label = 0), {_lw('n0', 'nm')} SELECT n, {r('rho')} AS shrinkage, (SELECT {r(f'list_sum(list_transform(p, lambda row, i: row[i])) / {P}', 4)} FROM nm_p) AS mean_precision FROM nm_r")
def m04_ledoit_wolf(spark, sf):
    m = vectors.moments(prep.normals(src.states(spark, sf)), "h")[0]
    cov, rho = covariance.ledoit_wolf(m)
    row = (m.n, rho, float(np.trace(np.linalg.inv(cov)) / P))
    return rounded(rounded(spark.createDataFrame([row], "n long, shrinkage double, mean_precision double"), "shrinkage"), "mean_precision", digits=4)


@query(f"WITH {STATES}, n0 AS (SELECT * FROM states WHERE label = 0), {_scatter('n0', 'x')} SELECT {r(f'least((fro / {P * P} + m * m) / ((n + 1) * (fro / {P * P} - m * m / {P})), 1.0)')} AS shrinkage FROM x_t")
def m05_oas(spark, sf):
    _, rho = covariance.oas(vectors.moments(prep.normals(src.states(spark, sf)), "h")[0])
    return rounded(spark.createDataFrame([(rho,)], "shrinkage double"), "shrinkage")


@query(f"""WITH {STATES}, n0 AS (SELECT * FROM states WHERE label = 0), sd AS (SELECT list(s ORDER BY i) AS sd FROM (SELECT i, stddev_pop(h[i]) AS s FROM n0, range(1, {P + 1}) g(i) GROUP BY i)),
 {_mean('n0', 'mm')}, z AS (SELECT list_transform(h, lambda x, i: (x - mu[i]) / sd[i]) AS h FROM n0, mm, sd), {_scatter('z', 'x')}
 SELECT {r(f'least(greatest((q - fro) / ({P} * n), 0.0), (fro - {P} * m * m) / {P}) / ((fro - {P} * m * m) / {P})')} AS shrinkage FROM x_t""")
def m06_whitened_ledoit_wolf(spark, sf):
    *_, rho = covariance.fit_whitened(prep.normals(src.states(spark, sf)), "h")
    return rounded(spark.createDataFrame([(rho,)], "shrinkage double"), "shrinkage")


@query(None)
def m07_robust_covariance(spark, sf):
    """Log-determinants of the concentration steps; they fall."""
    _, dets = covariance.minimum_covariance_determinant(prep.normals(src.states(spark, sf)), "h")
    return spark.createDataFrame([(i, float(d)) for i, d in enumerate(dets)], "step int, log_det double")


def _clustered(kind):
    def run(spark, sf):
        st, model = _normal_model(spark, sf, clusters=3, kind=kind)
        return st.select("flow_id", "label", r6(manifold.distance(model, "h")).alias("distance"))

    return run


query(None, name="m08_multi_mode")(_clustered("full"))
query(None, name="m09_shared_covariance")(_clustered("shared"))
query(None, name="m10_diagonal_covariance")(_clustered("diagonal"))


@query(f"{_REC}{_NORMAL} SELECT flow_id, {r(_dist('nm'))} AS distance FROM states, nm_mu, nm_p")
def m11_mahalanobis(spark, sf):
    st, model = _normal_model(spark, sf)
    return st.select("flow_id", r6(manifold.distance(model, "h")).alias("distance"))


@query(f"{_REC}{_NORMAL} SELECT flow_id, {r(_dist('nm'), 5)} AS distance FROM states, nm_mu, nm_p")
def m12_expanded_distance(spark, sf):
    st, model = _normal_model(spark, sf)
    return st.select("flow_id", r6(vectors.scalar_udf(model.expanded_distances)(F.col("h")), 5).alias("distance"))


@query(f"WITH {STATES}, n0 AS (SELECT * FROM states WHERE label = 0), {_mean('n0', 'mm')} SELECT flow_id, {r('greatest(1.0 - list_cosine_similarity(h, mu), 0.0)')} AS distance FROM states, mm")
def m13_cosine_to_mean(spark, sf):
    st = src.states(spark, sf)
    mean = vectors.vector_mean(prep.normals(st), "h")
    model = manifold.Manifold(mean[None, :], None, "cosine")
    return st.select("flow_id", r6(manifold.distance(model, "h")).alias("distance"))


@query(f"{_REC}{_NORMAL}, d AS (SELECT {_dist('nm')} AS d FROM n0, nm_mu, nm_p) SELECT {r('avg(d) + 3.0 * stddev_samp(d)')} AS threshold FROM d")
def m14_mean_k_std(spark, sf):
    st, model = _normal_model(spark, sf)
    d = prep.normals(st).select(manifold.distance(model, "h").alias("score"))
    return rounded(calibrate.mean_k_std(d, 3.0), "threshold")


@query(f"{_REC}{STATES}, {_A}, {_lw('a0', 'at')} SELECT flow_id, {r(_dist('at'))} AS distance FROM states, at_mu, at_p")
def m15_attack_manifold(spark, sf):
    st = src.states(spark, sf)
    model = manifold.fit_manifold(prep.attacks(st), "h", trim=0.0)
    return st.select("flow_id", r6(manifold.distance(model, "h")).alias("distance"))


def _scorer(spark, sf):
    st = src.states(spark, sf)
    return st, scoring.fit_base(st)


@query(f"{_REC}{_BOTH} SELECT flow_id, {r('lr')} AS lr FROM lrs")
def m16_likelihood_ratio(spark, sf):
    st, s = _scorer(spark, sf)
    dn, da = manifold.distance(s.normal, "h"), manifold.distance(s.attack, "h")
    return st.select("flow_id", dn.alias("dn"), da.alias("da")).select("flow_id", r6(scoring.lr_score("dn", "da", s.eps)).alias("lr"))


def _fisher_cte():
    return f"""{_scatter('n0', 'fn')}, {_scatter('a0', 'fa')},
 fs AS (SELECT list(row ORDER BY i) AS m FROM (SELECT a.i, list_append(list(0.5 * (a.s * fn_t.n / (fn_t.n - 1) + b.s * fa_t.n / (fa_t.n - 1)) + CASE WHEN a.i = a.j THEN 1e-4::DOUBLE ELSE 0.0::DOUBLE END ORDER BY a.j), any_value(fa_mu.mu[a.i] - fn_mu.mu[a.i])) AS row
   FROM fn_s a JOIN fa_s b ON a.i = b.i AND a.j = b.j, fn_t, fa_t, fn_mu, fa_mu GROUP BY a.i)),
 {sql_solve('fs', 'fgj', P)},
 fw0 AS (SELECT list_transform(m, lambda row: row[{P + 1}]) AS w FROM fgj WHERE step = {P}),
 fw AS (SELECT list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS w FROM fw0),
 fq AS (SELECT median(list_dot_product(h, w)) AS shift, quantile_cont(list_dot_product(h, w), 0.75) - quantile_cont(list_dot_product(h, w), 0.25) AS iqr FROM n0, fw)"""


_FISHER = f"{_REC}{STATES}, n0 AS (SELECT * FROM states WHERE label = 0), {_A}, {_fisher_cte()}"
_BOOST = f"{_REC}{_BOTH}, {_fisher_cte()}, boosted AS (SELECT flow_id, label, lr * (1.0 + 0.5 / (1.0 + exp(-(list_dot_product(h, w) - shift) / iqr))) AS score FROM lrs, fw, fq)"


@query(_FISHER + f" SELECT flow_id, {r('list_dot_product(h, w)')} AS projection, {r('shift')} AS shift, {r('iqr')} AS scale FROM states, fw, fq")
def m17_fisher(spark, sf):
    st = src.states(spark, sf)
    f = scoring.fit_fisher(st, "h")
    out = st.select("flow_id", scoring.projection(f.direction, "h").alias("projection"), F.lit(f.shift).alias("shift"), F.lit(f.scale).alias("scale"))
    return rounded(out, "projection", "shift", "scale")


@query(_BOOST + f" SELECT flow_id, {r('score')} AS score FROM boosted")
def m18_lr_boost(spark, sf):
    st, s = _scorer(spark, sf)
    lr = vectors.scalar_udf(s.ratio)(F.col("h"))
    out = st.select("flow_id", lr.alias("lr"), scoring.projection(s.fisher.direction, "h").alias("proj"))
    return out.select("flow_id", r6(scoring.lr_boost("lr", "proj", s.fisher)).alias("score"))


def _head_query(name, fit):
    @query(None, name=name)
    def run(spark, sf):
        st, s = _scorer(spark, sf)
        fit(s, st)
        return st.select("flow_id", "label", r6(scoring.score(s, "h")).alias("score"))

    return run


_head_query("m19_linear_boundary", scoring.fit_linear)
_head_query("m20_quadratic_boundary", scoring.fit_quadratic)
_head_query("m21_student", scoring.fit_student)
_head_query("m22_teacher", lambda s, d: scoring.fit_teacher(s, d, alpha=0.5, gate_margin=0.3))
_head_query("m23_discriminative_head", scoring.fit_head)


@query(_BOOST + f", fx AS (SELECT flow_id, list_dot_product(h, w) AS f, lr FROM lrs, fw) SELECT flow_id, {r('f')} AS f, {r('lr')} AS lr, {r('f * f')} AS f2, {r('lr * lr')} AS lr2, {r('f * lr')} AS flr FROM fx")
def m20_quadratic_features(spark, sf):
    st, s = _scorer(spark, sf)
    x = st.select("flow_id", scoring.features(s, "quadratic", "h").alias("x"))
    return x.select("flow_id", *[r6(F.col("x")[i]).alias(n) for i, n in enumerate(("f", "lr", "f2", "lr2", "flr"))])


def _fusion_query(name, dim):
    @query(None, name=name)
    def run(spark, sf):
        """Heads over the state and the backbone output of one scan of the events."""
        f = src.events(spark, sf).select("flow_id", "entity_id", "ts", "value", "k", "label")
        cell = recurrent.CfCCell.seeded(2, 8, 16)
        st = cut_lineage(recurrent.state_scan(f, cell, recurrent.columns_reader(["value", "k"], [0.01, 0.01]), keep=["flow_id", "label"], emit=("h", "z")))
        s = scoring.fit_base(st)
        scoring.fit_fusion(s, st, "h", "z", dim, alpha=0.4 if dim is None else 0.0)
        return st.select("flow_id", "label", r6(scoring.score(s, "h", "z")).alias("score"))

    return run


_fusion_query("m24_fusion_linear", -1)
_fusion_query("m24_fusion_full", None)
_fusion_query("m24_fusion_compact", 0)
_fusion_query("m24_fusion_subspace", 16)


@query(f"{_REC}{_BOTH} SELECT flow_id, {r('CASE WHEN abs(lr - 1.0) / 1.0 >= 0.2 THEN lr ELSE dn / (dn + da) END')} AS gated FROM lrs")
def m25_gate(spark, sf):
    st, s = _scorer(spark, sf)
    d = st.select("flow_id", manifold.distance(s.normal, "h").alias("dn"), manifold.distance(s.attack, "h").alias("da"))
    d = d.withColumn("lr", scoring.lr_score("dn", "da"))
    return d.select("flow_id", r6(scoring.gate("lr", F.col("dn") / (F.col("dn") + F.col("da")), 1.0, 0.2)).alias("gated"))


@query(f"""{_REC}{_BOTH}, cand AS (SELECT CAST(i AS INTEGER) AS i, quantile_cont(lr, 0.10 + 0.80 * i / 79) AS c FROM lrs, range(0, 80) g(i) GROUP BY i),
 m AS (SELECT i, c, count(*) FILTER (lr >= c AND label = 1) AS tp, count(*) FILTER (lr >= c) AS hits, count(*) FILTER (label = 1) AS p FROM cand, lrs GROUP BY i, c),
 f AS (SELECT i, c, tp * 1.0::DOUBLE / greatest(hits, 1) AS pr, tp * 1.0::DOUBLE / greatest(p, 1) AS rc FROM m)
 SELECT {r('c')} AS gate, {r('2 * pr * rc / greatest(pr + rc, 1e-9)')} AS f1 FROM f ORDER BY 2 * pr * rc / greatest(pr + rc, 1e-9) DESC, i LIMIT 1""".replace("quantile_cont(lr, 0.10 + 0.80 * i / 79) AS c FROM lrs, range(0, 80) g(i) GROUP BY i", "c FROM (SELECT unnest(range(0, 80)) AS i, unnest(quantile_cont(lr, [" + ", ".join(repr(0.10 + 0.80 * i / 79) for i in range(80)) + "])) AS c FROM lrs)"))
def m26_fit_gate(spark, sf):
    st, s = _scorer(spark, sf)
    d = st.select("label", vectors.scalar_udf(s.ratio)(F.col("h")).alias("lr"))
    return rounded(scoring.fit_gate(d), "gate", "f1")


@query(f"{_REC}{_BOTH}, b AS (SELECT avg(lr) AS m, stddev_pop(lr) AS s FROM lrs), x AS (SELECT flow_id, 1.0 / (1.0 + exp(-(lr - m) / (s + 1e-5))) AS base, dn / (dn + da) AS p FROM lrs, b) SELECT flow_id, {r('base + 0.3 * (p - base)')} AS blended FROM x")
def m27_blend(spark, sf):
    st, s = _scorer(spark, sf)
    d = st.select("flow_id", manifold.distance(s.normal, "h").alias("dn"), manifold.distance(s.attack, "h").alias("da"))
    d = d.withColumn("lr", scoring.lr_score("dn", "da"))
    mean, std = d.agg(F.avg("lr"), F.stddev_pop("lr")).first()
    return d.select("flow_id", r6(scoring.blend("lr", F.col("dn") / (F.col("dn") + F.col("da")), mean, std, 0.3)).alias("blended"))


@query(None)
def m31_reconstruction_score(spark, sf):
    from undertow.operators import recurrent

    st = src.states(spark, sf)
    ae = recurrent.fit_linear_ae(prep.normals(st), "h", 16)
    scored = recurrent.reconstruction_score(st, ae, "h")
    cut = calibrate.mean_k_std(prep.normals(scored), 3.0).first()["threshold"]
    return scoring.decide(scored, cut, mode="reconstruction").select("flow_id", "label", r6("drift_score").alias("drift_score"), "is_anomaly")


@query(f"{_REC}{_NORMAL}, d AS (SELECT flow_id, {_dist('nm')} AS d FROM states, nm_mu, nm_p) SELECT flow_id, {r('d')} AS drift_score, 8.0::DOUBLE AS threshold, d >= 8.0 AS is_anomaly, 'mahalanobis' AS scoring_mode FROM d")
def m32_verdict(spark, sf):
    st, model = _normal_model(spark, sf)
    out = scoring.decide(st.withColumn("score", manifold.distance(model, "h")), 8.0)
    return rounded(out.select("flow_id", "drift_score", "threshold", "is_anomaly", "scoring_mode"), "drift_score")


@query(_BOOST + f" SELECT flow_id, {r('score')} AS score, 'boosted_ratio' AS mode FROM boosted")
def m33_score_dispatch(spark, sf):
    st, s = _scorer(spark, sf)
    return st.select("flow_id", r6(scoring.score(s, "h")).alias("score"), F.lit(s.mode()).alias("mode"))


#: Fixed weights, so that SQL can follow every head: element i of a row j.
def _w(i, j=0):
    return ((i + j) % 5 - 2) / 10.0


def _head(width):
    return scoring.Head("logistic", [(np.array([[_w(i)] for i in range(width)]), np.array([0.1]))])


def _net(width, hidden=3):
    first = np.array([[_w(i, j) for j in range(hidden)] for i in range(width)]), np.array([0.05 * j for j in range(hidden)])
    return scoring.Head("mlp", [first, (np.array([[-0.5, 0.25 * (j + 1)] for j in range(hidden)]), np.array([0.0, -0.2]))])


def _branches(s):
    """Scorers that reach each branch of the dispatch, over the fitted distances and discriminant."""
    with_ = lambda **kw: dataclasses.replace(s, **kw)
    return {
        "distance": with_(attack=None), "ratio": with_(fisher=None), "boosted": s, "linear": with_(linear=_head(P + 2)), "quadratic": with_(quadratic=_head(5)),
        "student": with_(student=_net(5), student_basis=np.eye(P)[:, :4]),
        "teacher": with_(teacher=_net(P + 2), alpha=0.5, base_mean=1.0, base_std=0.5, gate=1.0, gate_margin=0.3),
        "head": with_(head=_net(P + 2)), "fusion": with_(fusion=_head(2 * P), fusion_dim=-1),
        "fusion_full": with_(fusion=_net(2 * P + 3), fusion_dim=None, fisher_z=np.ones(P) / 8.0),
    }


def _sql_head(x):
    return f"1.0 / (1.0 + exp(-(list_sum(list_transform({x}, lambda v, i: v * ((i - 1) % 5 - 2) / 10.0)) + 0.1)))"


def _sql_net(x, hidden=3):
    cell = lambda j: f"{0.25 * (j + 1) + 0.5} / (1.0 + exp(-(list_sum(list_transform({x}, lambda v, i: v * ((i - 1 + {j}) % 5 - 2) / 10.0)) + {0.05 * j})))"
    return f"1.0 / (1.0 + exp(-({' + '.join(cell(j) for j in range(hidden))} - 0.2)))"


_BRANCH_SQL = _BOOST + f""", x AS (SELECT flow_id, h, dn, lr, f, score, list_transform(h, lambda v: tanh(v * 3.0)) AS z FROM (SELECT lrs.flow_id, h, dn, lr, list_dot_product(h, w) AS f, score FROM lrs JOIN boosted USING (flow_id), fw)),
 y AS (SELECT *, list_concat(h, [f, lr]) AS x66, [f, lr, f * f, lr * lr, f * lr] AS x5, list_concat(h[1:4], [lr]) AS xs, list_concat(h, z) AS hz, list_sum(z) / 8.0 AS fz, 1.0 / (1.0 + exp(-(lr - 1.0) / (0.5 + 1e-5))) AS base FROM x),
 t AS (SELECT *, {_sql_net('x66')} AS p FROM y)
 SELECT flow_id, {r('dn')} AS distance, {r('lr')} AS ratio, {r('score')} AS boosted, {r(_sql_head('x66'))} AS linear, {r(_sql_head('x5'))} AS quadratic, {r(_sql_net('xs'))} AS student,
  {r('CASE WHEN abs(lr - 1.0) / 1.0 >= 0.3 THEN lr ELSE base + 0.5 * (p - base) END')} AS teacher, {r('p')} AS head, {r(_sql_head('hz'))} AS fusion, {r(_sql_net('list_concat(hz, [f, fz, lr])'))} AS fusion_full FROM t"""


@query(_BRANCH_SQL)
def m33_all_branches(spark, sf):
    """Every branch of the score dispatch, with heads of fixed weights."""
    st, s = _scorer(spark, sf)
    st = st.withColumn("z", F.transform("h", lambda x: F.tanh(x * 3.0)))
    scored = {n: scoring.score(b, "h", "z" if b.fusion is not None else None) for n, b in _branches(s).items()}
    return st.select("flow_id", *[r6(c).alias(n) for n, c in scored.items()])


@query(f"WITH {STATES}, c AS (SELECT i, label, avg(h[i]) AS m FROM states, range(1, {P + 1}) g(i) GROUP BY 1, 2), cv AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY label) "
       f"SELECT flow_id, {r('min(sqrt(list_sum(list_transform(h, lambda x, i: (x - m[i]) ** 2))))')} AS min_distance FROM states, cv GROUP BY flow_id")
def j05_min_distance(spark, sf):
    st = src.states(spark, sf)
    centres = np.array([m for _, m in vectors.vector_means(st, "h", by="label").values()])
    return manifold.min_distance(st, "h", centres).select("flow_id", r6("min_distance").alias("min_distance"))


_CLASSES = "g AS (SELECT * FROM states WHERE label = 0), b AS (SELECT * FROM states WHERE label = 1)"
_L2 = "list_distance(x.h, y.h)"


@query(f"WITH {STATES}, {_CLASSES} SELECT x.flow_id, {r(f'min({_L2})')} AS nearest FROM g x, b y GROUP BY x.flow_id")
def j06_nearest_pairs(spark, sf):
    st = src.states(spark, sf)
    return nearest.nearest_distance(prep.normals(st), "h", prep.attacks(st), "nearest").select("flow_id", r6("nearest").alias("nearest"))


@query(f"WITH {STATES} SELECT x.flow_id, {r(f'min({_L2})')} AS nearest FROM states x JOIN states y ON x.flow_id <> y.flow_id GROUP BY x.flow_id")
def j06_nearest_others(spark, sf):
    st = src.states(spark, sf)
    return nearest.nearest_distance(st, "h", st, "nearest").select("flow_id", r6("nearest").alias("nearest"))


@query(f"WITH {STATES}, c AS (SELECT i, avg(h[i]) FILTER (label=0) AS m0, avg(h[i]) FILTER (label=1) AS m1, var_pop(h[i]) FILTER (label=0) AS v0, var_pop(h[i]) FILTER (label=1) AS v1 FROM states, range(1, {P + 1}) g(i) GROUP BY i), "
       f"t AS (SELECT sqrt(sum((m1 - m0) ** 2)) AS d, sum(v0) AS v0, sum(v1) AS v1 FROM c) SELECT {r('d')} AS centroid_dist, {r('v0')} AS var_norm, {r('v1')} AS var_att, {r('d * d / (v0 + v1 + 1e-9)')} AS fdr FROM t")
def e15_geometric_separability(spark, sf):
    return rounded(scoring.geometric_separability(src.states(spark, sf), "h"), "centroid_dist", "var_norm", "var_att", "fdr")


@query(None)
def e16_effective_rank(spark, sf):
    rank = covariance.effective_rank(vectors.moments(src.states(spark, sf), "h")[0])
    return rounded(spark.createDataFrame([(rank,)], "effective_rank double"), "effective_rank")


@query(f"WITH {STATES}, {_CLASSES}, nn AS (SELECT x.flow_id, min({_L2}) AS d FROM g x JOIN g y ON x.flow_id <> y.flow_id GROUP BY 1), na AS (SELECT x.flow_id, min({_L2}) AS d FROM g x, b y GROUP BY 1) "
       f"SELECT {r('avg(CASE WHEN na.d < nn.d THEN 1.0 ELSE 0.0 END)')} AS nn_overlap FROM nn JOIN na USING (flow_id)")
def e17_nn_overlap(spark, sf):
    return rounded(manifold.nn_overlap(src.states(spark, sf), "h"), "nn_overlap")
