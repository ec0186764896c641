import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from undertow.operators import covariance, manifold, scoring, vectors


def states(spark, x, labels=None):
    labels = np.zeros(len(x), int) if labels is None else labels
    return spark.createDataFrame([(i, int(l), [float(v) for v in row]) for i, (l, row) in enumerate(zip(labels, x))], "flow_id long, label int, h array<double>")


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(0).normal((1, 2, 3), 1.0, (100, 3))


def test_distance_is_zero_at_the_mean(spark, cloud):
    m = manifold.fit_manifold(states(spark, cloud), "h", trim=0.0)
    d = m.distances(np.array([m.means[0], (1, 2, 3), (10, 20, 30)]))
    assert d[0] == pytest.approx(0.0, abs=1e-9) and d[1] < d[2]


def test_collinear_points_keep_a_finite_precision(spark):
    x = np.array([(v, 2 * v) for v in np.linspace(-5, 5, 20)])
    m = manifold.fit_manifold(states(spark, x), "h", trim=0.0)
    assert np.isfinite(m.precisions).all()


def _ledoit_wolf_by_rows(x):
    """Shrinkage from its definition, row by row."""
    c = x - x.mean(0)
    n, p = c.shape
    s = c.T @ c / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = sum(((np.outer(r, r) - s) ** 2).sum() / p for r in c) / n**2
    return min(b2, d2) / d2


def test_shrinkage_from_sums_equals_the_definition(spark):
    x = np.random.default_rng(2).normal(size=(80, 6)) @ np.diag([1, 2, 3, 4, 5, 6.0]) + 100
    m = vectors.moments(states(spark, x).repartition(5), "h")[0]
    assert np.allclose(m.covariance(1), np.cov(x.T)) and np.allclose(m.mean, x.mean(0))
    assert covariance.ledoit_wolf(m)[1] == pytest.approx(_ledoit_wolf_by_rows(x), rel=1e-9)
    z = (x - x.mean(0)) / x.std(0)
    assert covariance.fit_whitened(states(spark, x), "h")[3] == pytest.approx(_ledoit_wolf_by_rows(z), rel=1e-9)


def test_clusters_kinds_and_tables(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (150, 4)), rng.normal(12, 1, (150, 4))])
    df = states(spark, x)
    for kind in ("full", "shared", "diagonal"):
        m = manifold.fit_manifold(df, "h", clusters=2, kind=kind)
        assert sorted(np.round(m.means[:, 0] / 12).astype(int)) == [0, 1]
        again = manifold.Manifold.from_table(m.to_table(spark))
        got = [r[0] for r in df.select(manifold.distance(again, "h")).collect()]
        assert np.allclose(got, m.distances(x)) and np.median(got) < 3
        if kind == "full":
            assert np.allclose(m.distances(x), m.expanded_distances(x), atol=1e-6)
            expr = [r[0] for r in df.select(manifold.distance_expression(m, "h")).collect()]
            assert np.allclose(expr, got)
    assert len(manifold.fit_manifold(states(spark, x[:30]), "h", clusters=3).means) == 1


def test_trim_drops_the_far_tail(spark, cloud):
    x = np.concatenate([cloud, [[100, 100, 100]]])
    kept = manifold.trim_core(states(spark, x), "h", 0.02).count()
    d = ((x - x.mean(0)) ** 2).sum(1)
    assert kept == (d <= np.percentile(d, 98)).sum()
    assert manifold.trim_core(states(spark, x[:20]), "h", 0.02).count() == 20


def test_wide_vectors_use_cosine(spark):
    x = np.random.default_rng(5).normal(1, 1, (30, 1001))
    m = manifold.fit_manifold(states(spark, x), "h", trim=0.0)
    assert m.kind == "cosine"
    mean = x.mean(0)
    assert np.allclose(m.distances(x), 1 - x @ mean / np.linalg.norm(x, axis=1) / np.linalg.norm(mean))


def test_robust_covariance_ignores_outliers(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (200, 2)), rng.normal(30, 1, (20, 2))])
    m, dets = covariance.minimum_covariance_determinant(states(spark, x), "h", 0.8)
    assert np.abs(m.mean).max() < 0.5 and all(b <= a for a, b in zip(dets, dets[1:]))


@pytest.fixture(scope="module")
def two_classes(spark):
    rng = np.random.default_rng(7)
    labels = np.repeat([0, 1], 120)
    x = rng.normal(0, 1, (240, 4)) + labels[:, None] * np.array([2.5, 0, -1, 0])
    return states(spark, x, labels).cache(), x, labels


def test_heads_separate_the_classes(two_classes):
    df, x, labels = two_classes
    base = scoring.fit_base(df)
    assert base.mode() == "boosted_ratio"
    for fit, name in [(scoring.fit_linear, "linear"), (scoring.fit_quadratic, "quadratic"), (scoring.fit_student, "student"), (scoring.fit_teacher, "teacher"), (scoring.fit_head, "head")]:
        s = fit(scoring.Scorer(base.normal, base.attack, base.fisher), df)
        assert s.mode() == name
        p = np.array([r[0] for r in df.orderBy("flow_id").select(scoring.score(s, "h")).collect()])
        order = np.argsort(np.argsort(p)) + 1
        auroc = (order[labels == 1].sum() - 120 * 121 / 2) / 120**2
        assert auroc > 0.9, name


def test_folded_network_equals_the_fitted_model(two_classes):
    df, x, _ = two_classes
    head = scoring.fit_mlp(df, "h", [5])
    n, mean, squares = vectors.dim_moments(df, "h")[0]
    scale = np.sqrt(squares / n)
    unit = vectors.map_vectors(df, "u", lambda v: (v - mean) / scale, "h").select("flow_id", F.col("label").cast("double").alias("label"), array_to_vector("u").alias("features"))
    model = MultilayerPerceptronClassifier(layers=[4, 5, 2], seed=42, maxIter=100).fit(unit.select("label", "features"))
    want = [r[0] for r in model.transform(unit).orderBy("flow_id").select(F.element_at(vector_to_array("probability"), 2)).collect()]
    assert np.allclose(head.probability(x), want, atol=1e-5)


def _brute_nearest(rows, refs):
    out = {}
    for i, x in rows:
        d = [float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())) for j, y in refs if j != i and y is not None] if x is not None else []
        out[i] = min(d) if d else None
    return out


@pytest.mark.parametrize("block_rows, visitors, most", [(2048, 131_072, 1024), (7, 5, 1024), (7, 50, 2)])
def test_nearest_neighbours_are_exact(spark, monkeypatch, block_rows, visitors, most):
    from undertow.operators import nearest

    monkeypatch.setattr(nearest, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(nearest, "VISITORS", visitors)
    monkeypatch.setattr(nearest, "MOST_CENTRES", most)
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.2, (60, 3)) for c in (0, 3, 3.5, 50)] + [np.full((70, 3), 9.0)])  # a third are copies
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)] + [(900, None), (901, [1e6, 0.0, 0.0]), (902, [1e6, 0.0, 1e-3])]
    df = spark.createDataFrame(rows, "flow_id long, h array<double>")
    got = {r["flow_id"]: r["d"] for r in nearest.nearest_distance(df, "h", df, "d").collect()}
    assert got == pytest.approx(_brute_nearest(rows, rows), abs=1e-12)
    refs = rows[100:140] + [(2000, rows[3][1])]
    got = nearest.nearest_distance(df, "h", spark.createDataFrame(refs, df.schema), "d").collect()
    assert {r["flow_id"]: r["d"] for r in got} == pytest.approx(_brute_nearest(rows, refs), abs=1e-12)


def test_nearest_of_few_and_none(spark):
    from undertow.operators.nearest import nearest_distance

    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 5.0])], "flow_id long, h array<double>")
    one = df.filter("flow_id = 1")
    assert nearest_distance(one, "h", one, "d").first()["d"] is None
    assert nearest_distance(df, "h", df.limit(0), "d").filter("d IS NULL").count() == 2
    assert sorted(r["d"] for r in nearest_distance(df, "h", df, "d").collect()) == [5.0, 5.0]
    assert nearest_distance(df.limit(0), "h", df, "d").count() == 0


def test_switches_speak_up(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=3)], 0 if i < 60 else 1) for i in range(65)]
    df = spark.createDataFrame(rows, "flow_id long, h array<double>, label int")
    with pytest.warns(UserWarning, match="no attack model"):
        assert scoring.fit_base(df).attack is None
    assert scoring.fit_base(df, min_class_rows=5).attack is not None
    with pytest.raises(ValueError, match="trim ratio"):
        manifold.fit_manifold(df, "h", trim=0.5)
    with pytest.warns(UserWarning, match="not trimmed"):
        manifold.fit_manifold(df.limit(20), "h", trim=0.02)
    with pytest.warns(UserWarning, match="one cluster"):
        assert len(manifold.fit_manifold(df, "h", clusters=5, trim=0.0).means) == 1
    assert len(manifold.fit_manifold(df, "h", clusters=5, trim=0.0, cluster_rows=5).means) == 5
    with pytest.warns(UserWarning, match="wider than 2"):
        assert scoring.fit_base(df, wide=2).normal.kind == "cosine"
    assert manifold.fit_manifold(df, "h", wide=None).kind == "full"


def test_neighbours_of_scattered_vectors_travel_by_group(spark, monkeypatch):
    from undertow.operators import nearest

    monkeypatch.setattr(nearest, "BLOCK_ROWS", 100)
    monkeypatch.setattr(nearest, "HELD", 60)  # ten rows of six numbers leave a task at a time
    size = np.full(30, 10)
    group = nearest._groups(np.random.default_rng(1).normal(size=(30, 6)), size)
    assert np.bincount(group, size).tolist() == [100, 100, 100]
    seen = []
    compared = nearest._compared
    monkeypatch.setattr(nearest, "_compared", lambda members, visits, blocks: seen.append(visits.count()) or compared(members, visits, blocks))
    rows = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(2).normal(size=(300, 6)))]
    df = spark.createDataFrame(rows, "flow_id long, h array<double>")
    got = {r["flow_id"]: r["d"] for r in nearest.nearest_distance(df, "h", df, "d").collect()}
    x = np.array([v for _, v in rows])
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag(np.full(300, np.inf))
    assert got == pytest.approx(dict(enumerate(gap.min(1))), abs=1e-12)
    assert seen[0] == 300 and seen[1] <= 300 * (len(set(group)) + 1)


def test_robust_steps_read_the_source_once_and_match_brute_force(spark, monkeypatch, tmp_path):
    from undertow.operators import covariance

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(400, 3)), rng.normal(5, 3, (90, 3))])
    spark.createDataFrame([(v.tolist(),) for v in x], "h array<double>").write.parquet(f"{tmp_path}/x")
    plans, cut = [], covariance.cut_lineage

    def fixed(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(covariance, "cut_lineage", fixed)
    got, dets = covariance.minimum_covariance_determinant(spark.read.parquet(f"{tmp_path}/x"), "h", starts=1)
    assert [("parquet" in p.lower()) for p in plans] == [True] + [False] * (len(plans) - 1) and len(plans) > 2
    keep, want, mean, cov = 392, [], x.mean(0), np.cov(x.T, bias=True) + 1e-9 * np.eye(3)
    for _ in range(30):
        d = np.einsum("ij,ij->i", (x - mean) @ np.linalg.pinv(cov), x - mean)
        near = x[d <= np.sort(d)[keep - 1]]
        new = np.cov(near.T, bias=True) + 1e-9 * np.eye(3)
        if want and np.linalg.slogdet(new)[1] >= want[-1] - 1e-9:
            break
        want.append(np.linalg.slogdet(new)[1])
        mean, cov, best = near.mean(0), new, near
    assert np.allclose(dets, want) and got.n == len(best) and np.allclose(got.mean, best.mean(0))
    assert np.isclose(got.quartic, (((best - best.mean(0)) ** 2).sum(1) ** 2).sum())


def test_manifold_study_reads_the_vectors_once_for_all_variants(spark, monkeypatch, tmp_path):
    from undertow.plans import study

    rng = np.random.default_rng(5)
    rows = [(k, ("val", "test", "train")[k % 3], int(k % 7 == 0), rng.normal(3 * (k % 7 == 0), 1, 3).tolist()) for k in range(420)]
    spark.createDataFrame(rows, "flow_id long, split string, label int, h array<double>").write.parquet(f"{tmp_path}/x")
    plans, cut = [], study.cut_lineage

    def fixed(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(study, "cut_lineage", fixed)
    assert study.manifold_study(spark.read.parquet(f"{tmp_path}/x")).count() == 5
    assert sum("parquet" in p.lower() for p in plans) == 1 and sum("ArrowEvalPython" in p or "<lambda>" in p or "distances" in p for p in plans) == 1
