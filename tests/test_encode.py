import numpy as np
import pytest
from pyspark.sql import functions as F

from undertow.functions import hypervec as H
from undertow.operators import encode, vectors
from undertow.operators.encode import EncoderModel, majority


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame([(0, "tcp", "CON", 0.1, 100.0), (1, "udp", "CON", 0.5, 500.0)], "flow_id long, proto string, state string, dur double, sbytes double")


@pytest.fixture(scope="module")
def model(train):
    return encode.fit_encoder(train, ["proto", "state"], ["dur", "sbytes"], width=1000, levels=100)


def test_fit(model):
    assert model.ranges == {"dur": (0.1, 0.5), "sbytes": (100.0, 500.0)}
    rows = {(r["col"], r["token"]): r["token_id"] for r in model.vocabulary.collect()}
    assert rows == {("proto", "tcp"): 1, ("proto", "udp"): 2, ("state", "CON"): 1}


def test_unseen_tokens_share_one_vector_per_column(spark, model):
    df = spark.createDataFrame([(0, "icmp", "CON", 0.3, 300.0), (1, "ospf", "CON", 0.3, 300.0), (2, "tcp", "CON", 0.3, 300.0)], "flow_id long, proto string, state string, dur double, sbytes double")
    rows = encode.encode(df, model, keep=["flow_id"]).orderBy("flow_id").collect()
    assert [r["is_oov"] for r in rows] == [True, True, False]
    assert rows[0]["hv"] == rows[1]["hv"] and rows[0]["hv"] != rows[2]["hv"]
    assert set(rows[0]["hv"]) <= {-1, 1}
    assert not np.array_equal(H.base_vector("oov:proto", 1000), H.base_vector("oov:state", 1000))


def test_similarity_falls_with_distance(spark, model):
    df = spark.createDataFrame([(i, "tcp", "CON", 0.1 + 0.05 * i, 300.0) for i in range(9)], "flow_id long, proto string, state string, dur double, sbytes double")
    hv = [np.array(r["hv"]) for r in encode.encode(df, model, keep=["flow_id"]).orderBy("flow_id").collect()]
    assert hv[0] @ hv[2] > hv[0] @ hv[4] > hv[0] @ hv[8]


def _dense(model, row, kind="record"):
    total = np.zeros(model.width, int)
    known = {(r["col"], r["token"]) for r in model.vocabulary.collect()}
    for c in model.cat_cols:
        key = f"tok:{c}:{row[c]}" if (c, row[c]) in known else f"oov:{c}"
        total += H.base_vector(key, model.width).astype(int) * H.base_vector(f"key:{c}", model.width)
    levels = H.level_vectors(model.width, model.levels)
    for c in model.num_cols:
        lo, hi = model.ranges[c]
        level = int(np.rint(np.clip((row[c] - lo) / (hi - lo), 0, 1) * (model.levels - 1)))
        total += levels[level].astype(int) * H.base_vector(f"key:{c}", model.width)
    return np.where(total >= 0, 1, -1)


@pytest.mark.parametrize("width", [64, 100, 1000, 1024])
def test_packed_dense_and_expression_agree(spark, train, width):
    model = encode.fit_encoder(train, ["proto", "state"], ["dur", "sbytes"], width=width, levels=32)
    df = spark.createDataFrame([(i, ["tcp", "udp", "gre"][i % 3], "CON", 0.02 * i, 37.0 * i) for i in range(20)], "flow_id long, proto string, state string, dur double, sbytes double")
    rows = df.orderBy("flow_id").collect()
    dense = [_dense(model, r).tolist() for r in rows]
    assert [r["hv"] for r in encode.encode(df, model, keep=["flow_id"]).orderBy("flow_id").collect()] == dense
    packed = encode.encode(df, model, packed=True, keep=["flow_id"])
    assert len(packed.first()["hv"]) == -(-width // 8)
    assert [r[0] for r in packed.orderBy("flow_id").select(encode.unpack("hv", width)).collect()] == dense
    if width <= 100:
        assert [r["hv"] for r in encode.encode_expression(df, model).orderBy("flow_id").collect()] == dense


@pytest.mark.parametrize("kind", ["sax", "rff"])
def test_other_encoders_give_signs(spark, train, kind):
    model = encode.fit_encoder(train, ["proto", "state"], ["dur", "sbytes"], width=1024)
    rows = encode.encode(train, model, kind).collect()
    assert len(rows) == 2 and all(set(r["hv"]) <= {-1, 1} and len(r["hv"]) == 1024 for r in rows)


def test_pack_identity():
    x = np.where(np.random.default_rng(1).random((3, 16384)) < 0.5, -1, 1)
    bits = H.pack_bits(x)
    assert bits.shape == (3, 2048) and np.array_equal(H.unpack_bits(bits, 16384), x)
    assert H.pack_bits(np.array([[-1] + [1] * 7]))[0, 0] == 128


@pytest.mark.parametrize("votes", [1, 2, 3, 4, 5, 6, 7, 8, 15, 16, 17, 42])
def test_majority_counts_exactly(votes):
    bits = np.random.default_rng(votes).integers(0, 2, (votes, 5, 64)).astype(np.uint8)
    words = [np.packbits(b, axis=1).view(np.uint64) for b in bits]
    want = bits.sum(0) * 2 > votes
    assert np.array_equal(np.unpackbits(majority(words).view(np.uint8), axis=1).astype(bool), want)


def test_levels_change_linearly():
    v = H.level_vectors(1000, 100).astype(int)
    assert [(1000 - v[0] @ v[l]) // 2 for l in (0, 1, 50, 99)] == [0, 10, 500, 990]
    with pytest.raises(ValueError):
        H.level_vectors(50, 100)


def test_long_packing_and_permutation(spark):
    x = [1, -1, -1, 1, -1]
    row = spark.range(1).select(
        H.unpack_long(H.pack_long(F.array(*[F.lit(i) for i in x])), 5).alias("a"),
        H.permute(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]), 1).alias("b"),
        H.hamming(F.lit(5).cast("long"), F.lit(3).cast("long")).alias("c"),
    ).first()
    assert row["a"] == x and row["b"] == [4, 1, 2, 3] and row["c"] == 2


def test_kernel_rejects_unknown_kind(model):
    with pytest.raises(ValueError):
        encode.Kernel(EncoderModel(["a"], [], 64), "other")


def test_a_million_tokens_fit_into_features(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("flow_id"), F.concat(F.lit("t"), "id").alias("token"), (F.col("id") % 7).cast("double").alias("x"))
    vocabulary = df.select(F.lit("token").alias("col"), "token", (F.col("flow_id") + 1).cast("int").alias("token_id"))
    model = encode.EncoderModel(["token"], ["x"], vocabulary=vocabulary)
    some = df.filter("flow_id % 100000 = 5").unionByName(spark.createDataFrame([(-1, "never seen", 2.0)], df.schema))
    got = {r["flow_id"]: r["features"] for r in encode.raw_features(some, model).collect()}
    assert len(got) == 11 and all(v.size == 1 + 1_000_001 for v in got.values())
    assert got[300_005].indices.tolist() == [0, 1 + 300_006] and got[-1].indices.tolist() == [0, 1]


def test_features_without_categories(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "flow_id long, a double, b double")
    model = encode.EncoderModel([], ["a", "b"], vocabulary=spark.createDataFrame([], "col string, token string, token_id int"))
    assert encode.raw_features(df, model).first()["features"].toArray().tolist() == [2.0, 3.0]


def test_codebook_gives_the_same_vectors_when_it_starts_again(monkeypatch):
    import pyarrow as pa

    model = EncoderModel(["c"], ["x"], width=200, levels=10, ranges={"x": (0.0, 1.0)})
    names = [f"t{i % 3000}" for i in range(9000)]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array([0 if n == "t7" else 1 for n in names], pa.int32()), pa.array([0.5] * 9000)], ["c", "c_id", "x"])
    encode._books.clear()
    whole = encode.Kernel(model).packed(batch)
    encode._books.clear()
    monkeypatch.setattr(encode, "CODEBOOK_BYTES", 1)  # 1,024 tokens
    parts = [encode.Kernel(model).packed(batch.slice(a, 500)) for a in range(0, 9000, 500)]
    assert np.array_equal(whole, np.concatenate(parts))
    assert len(encode._codebook(200, model.seed, "c").known) <= 1024
    keys = ["tok:c:t1", "", "é"]
    assert np.array_equal(H.base_bits(keys, 77), H.pack_bits(np.stack([H.base_vector(k, 77) for k in keys])))


def test_sparse_parts_of_sparse_and_dense_vectors(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(1, Vectors.sparse(1_000_000, {0: 2.5, 7: 1.0, 999_999: -0.1})), (2, Vectors.dense([0.0, 3.0])), (3, Vectors.sparse(5, {})), (4, Vectors.dense([]))]
    got = {r["id"]: r["p"] for r in spark.createDataFrame(rows, ["id", "v"]).select("id", vectors.sparse_parts("v").alias("p")).collect()}
    want = {1: ([0, 7, 999_999], [2.5, 1.0, -0.1]), 2: ([0, 1], [0.0, 3.0]), 3: ([], []), 4: ([], [])}
    assert {k: (p["indices"], p["values"]) for k, p in got.items()} == want


def test_raw_features_query_never_fills_its_vectors(spark, sf):
    from undertow.plans.queries_vectors import n12_raw_features

    out = n12_raw_features(spark, sf)
    assert "vector_to_array" not in out._jdf.queryExecution().toString() and "UDF(features" not in out._jdf.queryExecution().toString()
    assert out.filter("clock_slot IS NULL OR weekday_slot IS NULL").count() == 0


def test_the_fit_reads_fixed_flows(spark, sf):
    from undertow.plans.queries_vectors import fitted

    tagged, _ = fitted(spark, sf)
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "parquet" not in plan  # neither the gaps nor the events are computed anew
