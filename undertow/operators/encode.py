"""Record encoders: a flow's categories and numbers bundled into one hypervector.

Fitting yields ranges (a few numbers) and a vocabulary table. Encoding is a narrow map: the vocabulary is
joined for the seen/unseen flag, and vectors are derived from hashes inside the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.functions import hypervec as H
from undertow.functions import scalars as S
from undertow.operators import ordered, vectors
from undertow.session import broadcast_if_small, cut_lineage


@dataclass
class EncoderModel:
    cat_cols: list[str]
    num_cols: list[str]
    width: int = 10_000
    levels: int = 100
    seed: int = H.SEED
    log: bool = False
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)
    gamma: float = 0.5
    vocabulary: DataFrame | None = None

    def light(self) -> "EncoderModel":
        """Without the table, for shipping to tasks."""
        return EncoderModel(self.cat_cols, self.num_cols, self.width, self.levels, self.seed, self.log, self.ranges, self.stats, self.gamma)


# --------------------------------------------------------------------------- fitting (train rows only)


def fit_ranges(train: DataFrame, num_cols, log: bool = False) -> dict[str, tuple[float, float]]:
    """Bounds of each number in one pass; an empty range is widened by one."""
    value = (lambda c: S.log_clip(c)) if log else (lambda c: F.col(c).cast("double"))
    aggs = [f(value(c)).alias(f"{n}_{i}") for i, c in enumerate(num_cols) for n, f in (("lo", F.min), ("hi", F.max))]
    row = train.agg(*aggs).first()
    out = {}
    for i, c in enumerate(num_cols):
        lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
        lo, hi = (0.0, 1.0) if lo is None else (lo, hi)
        out[c] = (lo, hi if hi > lo else lo + 1.0)
    return out


def fit_stats(train: DataFrame, num_cols) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each number; a tiny deviation counts as 1."""
    aggs = [f(c).alias(f"{n}_{i}") for i, c in enumerate(num_cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = train.agg(*aggs).first()
    out = {}
    for i, c in enumerate(num_cols):
        m, s = row[f"m_{i}"], row[f"s_{i}"]
        out[c] = (0.0, 1.0) if m is None else (m, s if s > 1e-6 else 1.0)
    return out


def fit_item_memory(train: DataFrame, cat_cols) -> DataFrame:
    """(col, token, token_id): ids from 1 in first-seen order per column; 0 is kept for unseen tokens."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("token")) for c in cat_cols])
    seen = (
        train.select("flow_id", F.inline(pairs)).groupBy("col", "token").agg(F.min("flow_id").alias("first_seen"))
    )
    ranked = ordered.sliced_order(seen, "col", ["first_seen", "token"], row_number="token_id")
    return cut_lineage(ranked.select("col", "token", F.col("token_id").cast("int").alias("token_id")))


def fit_encoder(train: DataFrame, cat_cols, num_cols, width: int = 10_000, levels: int = 100, seed: int = H.SEED, log: bool = False) -> EncoderModel:
    return EncoderModel(
        list(cat_cols), list(num_cols), width, levels, seed, log,
        ranges=fit_ranges(train, num_cols, log),
        stats=fit_stats(train, num_cols),
        vocabulary=fit_item_memory(train, cat_cols),
    )


# --------------------------------------------------------------------------- lookup


def lookup(df: DataFrame, vocabulary: DataFrame, cat_cols, keep_ids: bool = True) -> DataFrame:
    """Token ids per column as <col>_id (0 when unseen) and is_oov.

    Each column's part of the vocabulary is joined on its own; it is broadcast only if its size was
    checked to be small, otherwise it is a shuffled join.
    """
    out = df
    for c in cat_cols:
        part = vocabulary.filter(F.col("col") == c).select(F.col("token").alias(c), F.col("token_id").alias(f"{c}_id"))
        out = out.join(broadcast_if_small(part), c, "left").withColumn(f"{c}_id", F.coalesce(F.col(f"{c}_id"), F.lit(0)))
    oov = F.lit(False)
    for c in cat_cols:
        oov = oov | (F.col(f"{c}_id") == 0)
    out = out.withColumn("is_oov", oov)
    return out if keep_ids else out.drop(*[f"{c}_id" for c in cat_cols])


# --------------------------------------------------------------------------- Catalyst path (narrow vectors)


def _unit(model: EncoderModel, c: str) -> Column:
    value = S.log_clip(c) if model.log else F.col(c)
    return S.minmax(value, *model.ranges[c])


def _bound_categories(model: EncoderModel) -> list[Column]:
    out = []
    for c in model.cat_cols:
        name = F.when(F.col(f"{c}_id") == 0, F.lit(f"oov:{c}")).otherwise(F.concat(F.lit(f"tok:{c}:"), F.col(c)))
        key = H.literal_hv(H.base_vector(f"key:{c}", model.width, model.seed))
        out.append(H.bind(H.base_hv(name, model.width, model.seed), key))
    return out


def encode_expression(df: DataFrame, model: EncoderModel, kind: str = "record") -> DataFrame:
    """Append hv as an array expression; stays in the JVM and suits widths up to a few hundred."""
    looked = lookup(df, model.vocabulary, model.cat_cols)
    parts = _bound_categories(model)
    for c in model.num_cols:
        key = H.literal_hv(H.base_vector(f"key:{c}", model.width, model.seed))
        if kind == "sax":
            symbol = S.sax_symbol(c, *model.stats[c])
            value = H.base_hv(F.concat(F.lit("sym:"), symbol.cast("string")), model.width, model.seed)
        else:
            value = H.level_hv(S.to_level(_unit(model, c), model.levels), model.width, model.levels, model.seed)
        parts.append(H.bind(value, key))
    return looked.withColumn("hv", H.bundle(*parts)).drop(*[f"{c}_id" for c in model.cat_cols])


# --------------------------------------------------------------------------- Arrow path (any width)


def _as_words(packed: np.ndarray, words: int) -> np.ndarray:
    return np.pad(packed, ((0, 0), (0, words * 8 - packed.shape[1]))).view(np.uint64)


#: Bytes of token vectors that a worker keeps for one column.
CODEBOOK_BYTES = 128 << 20


class Codebook:
    """Bound vectors of a column's tokens, kept by a worker from batch to batch; full, it starts again. Slot 0: unseen."""

    def __init__(self, width: int, column: str):
        self.column, self.words = column, -(-width // 64)
        self.most = max(1024, CODEBOOK_BYTES // (8 * self.words))
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, self.words), np.uint64)

    def slots(self, names: list[str], vectors_of: Callable[[list[str]], np.ndarray]) -> np.ndarray:
        """The slot of each name, new ones made by vectors_of; slots of earlier calls hold only as long as the book does."""
        new = [n for n in names if n not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, self.table, new = {}, np.zeros((0, self.words), np.uint64), list(names)
        if not len(self.table):
            self.table = np.zeros((max(64, len(new) + 1), self.words), np.uint64)
            self.table[0] = vectors_of([f"oov:{self.column}"])[0]
        if new:
            at = len(self.known) + 1
            if at + len(new) > len(self.table):
                grown = np.zeros((max(at + len(new), 2 * len(self.table)), self.words), np.uint64)
                grown[:at] = self.table[:at]
                self.table = grown
            self.table[at : at + len(new)] = vectors_of([f"tok:{self.column}:{n}" for n in new])
            self.known.update(zip(new, range(at, at + len(new))))
        return np.fromiter((self.known[n] for n in names), np.int64, len(names))


_books: dict[tuple[int, int, str], Codebook] = {}


def _codebook(width: int, seed: int, column: str) -> Codebook:
    key = (width, seed, column)
    if key not in _books:
        if len(_books) >= 16:
            _books.clear()
        _books[key] = Codebook(width, column)
    return _books[key]


class Kernel:
    """Turns an Arrow batch of tokens, seen flags and numbers into hypervectors. Built once per task.

    Vectors are kept as bits (set = -1) in 64-bit words: binding is XOR, and the majority is taken with
    bit-sliced counters, so a row costs a few word operations per field instead of one per element.
    """

    def __init__(self, model: EncoderModel, kind: str = "record"):
        self.model, self.kind = model, kind
        self.words = -(-model.width // 64)
        self.keys = {c: self._bits([f"key:{c}"]) for c in [*model.cat_cols, *model.num_cols]}
        self.tables: dict[str, np.ndarray] = {}
        if kind == "record":
            levels = self._words(H.level_vectors(model.width, model.levels, model.seed))
            self.tables = {c: levels ^ self.keys[c] for c in model.num_cols}
        elif kind == "sax":
            symbols = self._bits([f"sym:{a}" for a in range(len(S.SAX_BREAKPOINTS_8) + 1)])
            self.tables = {c: symbols ^ self.keys[c] for c in model.num_cols}
        elif kind == "rff":
            n = len(model.num_cols)
            w = H.gaussians("rff:w", n * model.width, model.seed).reshape(n, model.width) * np.sqrt(2.0 * model.gamma)
            self.weights, self.phase = w, H.uniforms("rff:b", model.width, model.seed) * 2.0 * np.pi
        else:
            raise ValueError(f"unknown encoder {kind!r}")

    def _words(self, vectors_: np.ndarray) -> np.ndarray:
        return _as_words(H.pack_bits(vectors_), self.words)

    def _bits(self, keys: list[str]) -> np.ndarray:
        return _as_words(H.base_bits(keys, self.model.width, self.model.seed), self.words)

    def _tokens(self, batch: pa.RecordBatch, c: str) -> tuple[np.ndarray, np.ndarray]:
        """Bound vectors of tokens, and which one each row uses: of the worker's codebook, the unseen one first."""
        seen = batch.column(f"{c}_id").to_numpy(zero_copy_only=False) > 0
        coded = batch.column(c).dictionary_encode()
        names, book = coded.dictionary.to_pylist(), _codebook(self.model.width, self.model.seed, c)
        slots = book.slots(names, lambda keys: self._bits(keys) ^ self.keys[c])
        index = np.where(seen, coded.indices.fill_null(0).to_numpy(zero_copy_only=False), len(names))
        return book.table, np.append(slots, 0)[index]

    def _units(self, batch: pa.RecordBatch, c: str) -> np.ndarray:
        x = batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
        if self.model.log:
            x = np.log1p(np.maximum(x, 0.0))
        lo, hi = self.model.ranges[c]
        return np.clip((x - lo) / (hi - lo), 0.0, 1.0)

    def _fields(self, batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        m = self.model
        fields = [self._tokens(batch, c) for c in m.cat_cols]
        for c in m.num_cols if self.kind != "rff" else []:
            if self.kind == "record":
                index = np.rint(self._units(batch, c) * (m.levels - 1)).astype(np.int64)
            else:
                mean, std = m.stats[c]
                z = (batch.column(c).to_numpy(zero_copy_only=False) - mean) / std
                index = (z[:, None] >= np.array(S.SAX_BREAKPOINTS_8)[None, :]).sum(1)
            fields.append((self.tables[c], index))
        return fields

    def packed(self, batch: pa.RecordBatch) -> np.ndarray:
        """Bytes of the bundled vectors, most significant bit first."""
        if self.kind == "rff":
            return H.pack_bits(self._rff(batch))
        fields = self._fields(batch)
        step = max(1, 65_536 // self.words)  # keeps the counters in cache
        out = np.empty((batch.num_rows, self.words), dtype=np.uint64)
        for at in range(0, batch.num_rows, step):
            out[at : at + step] = majority([table[index[at : at + step]] for table, index in fields])
        return out.view(np.uint8)[:, : -(-self.model.width // 8)]

    def _rff(self, batch: pa.RecordBatch) -> np.ndarray:
        m = self.model
        total = np.zeros((batch.num_rows, m.width))
        for table, index in self._fields(batch):
            used, place = np.unique(index, return_inverse=True)
            total += H.unpack_bits(table[used].view(np.uint8), m.width)[place]
        units = np.column_stack([self._units(batch, c) for c in m.num_cols])
        total += np.sqrt(2.0 / m.width) * np.cos(units @ self.weights + self.phase)
        return np.where(total >= 0, 1, -1).astype(np.int8)

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        """The vectors as rows of +1/-1."""
        return H.unpack_bits(self.packed(batch), self.model.width)


def majority(votes: list[np.ndarray]) -> np.ndarray:
    """Bits set in more than half of the votes, by counting in bit planes."""
    planes: list[np.ndarray] = []
    for carry in votes:
        for i, plane in enumerate(planes):
            planes[i], carry = plane ^ carry, plane & carry
        if len(planes) < len(votes).bit_length():
            planes.append(carry)
    more, equal = np.zeros_like(votes[0]), ~np.zeros_like(votes[0])
    for i in reversed(range(len(planes))):
        if len(votes) // 2 >> i & 1:
            equal &= planes[i]
        else:
            more |= equal & planes[i]
            equal &= ~planes[i]
    return more


def chunk_rows(width: int) -> int:
    """Rows unpacked at a time: about 8 MB of elements."""
    return max(1, min(4096, 8_000_000 // width))


def encode(df: DataFrame, model: EncoderModel, kind: str = "record", packed: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Append hv: array<tinyint> of +1/-1, or packed bits. kind is record, sax or rff."""
    kept = keep if keep is not None else df.columns
    looked = lookup(df, model.vocabulary, model.cat_cols)
    needed = [*dict.fromkeys([*kept, *model.cat_cols, *model.num_cols, *[f"{c}_id" for c in model.cat_cols], "is_oov"])]
    rows = looked.select(*needed)
    light, step = model.light(), chunk_rows(model.width) * (8 if packed else 1)
    hv_type = T.BinaryType() if packed else T.ArrayType(T.ByteType())
    schema = T.StructType([rows.schema[c] for c in [*kept, "is_oov"]] + [T.StructField("hv", hv_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = None
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                kernel = kernel or Kernel(light, kind)
                batch = whole.slice(at, step)
                hv = binary_column(kernel.packed(batch)) if packed else vectors.list_column(kernel(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in [*kept, "is_oov"]] + [hv], names=[*kept, "is_oov", "hv"]
                )

    return rows.mapInArrow(run, schema)


def structured(df: DataFrame, model: EncoderModel, hv: str = "hv") -> DataFrame:
    """Blend a record vector with itself bound to the product of the first two category keys."""
    a, b = (H.base_vector(f"key:{c}", model.width, model.seed) for c in model.cat_cols[:2])
    pair = (a * b).astype(np.int16)

    def blend(col: pa.Array) -> pa.Array:
        x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.int16)
        return vectors.list_column(np.where(x + x * pair >= 0, 1, -1).astype(np.int8))

    return df.withColumn("structured_hv", F.arrow_udf(blend, "array<tinyint>")(F.col(hv)))


def binary_column(rows: np.ndarray) -> pa.Array:
    """Byte rows of one length as an Arrow binary column, without a Python object per row."""
    n, width = rows.shape
    offsets = pa.py_buffer(np.arange(0, n * width + 1, width, dtype=np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def unpack(hv: Column | str, width: int) -> Column:
    """Packed bits back to +1/-1."""
    hv = F.col(hv) if isinstance(hv, str) else hv

    def run(col: pa.Array) -> pa.Array:
        bits = np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(len(col), -1)
        return vectors.list_column(H.unpack_bits(bits, width))

    return F.arrow_udf(run, "array<tinyint>")(hv)


def pack(hv: Column | str) -> Column:
    hv = F.col(hv) if isinstance(hv, str) else hv

    def run(col: pa.Array) -> pa.Array:
        x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
        return binary_column(H.pack_bits(x))

    return F.arrow_udf(run, "binary")(hv)


def hamming_packed(hv: Column | str, query: bytes) -> Column:
    """Differing bits between packed vectors of any width and one query."""
    hv = F.col(hv) if isinstance(hv, str) else hv
    target = np.frombuffer(query, dtype=np.uint8)

    def run(col: pa.Array) -> pa.Array:
        bits = np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(len(col), -1)
        return pa.array(np.unpackbits(bits ^ target, axis=1).sum(1).astype(np.int32))

    return F.arrow_udf(run, "int")(hv)


def most_similar(df: DataFrame, query, k: int, hv: str = "hv") -> DataFrame:
    """The k rows most similar to a query vector; a top-k, not a sort."""
    q = np.asarray(query, dtype=np.float64)
    similarity = vectors.scalar_udf(lambda x: x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)))
    return df.withColumn("similarity", similarity(F.col(hv))).orderBy(F.col("similarity").desc(), "flow_id").limit(k)


def encoder_separability(df: DataFrame, hv: str = "hv") -> DataFrame:
    """Class separation of encodings: centre distances, Fisher ratio, and mean pairwise cosines.

    The mean of all pairwise cosines equals the dot product of the mean unit vectors, so all rows count and no pair is
    formed.
    """
    by = vectors.dim_moments(df, hv, by="label")
    (n0, mu0, ss0), (n1, mu1, ss1) = by[0], by[1]
    width = len(mu0)
    cos = float(mu0 @ mu1 / (np.linalg.norm(mu0) * np.linalg.norm(mu1)))
    gap = float(np.linalg.norm(mu0 - mu1))
    fisher = gap**2 / (ss0.sum() / (n0 - 1) + ss1.sum() / (n1 - 1) + 1e-8)

    def unit_sum(batch: pa.RecordBatch) -> np.ndarray:
        x = vectors.matrix(batch.column(hv))
        units = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        return np.concatenate([[len(x)], units.sum(0)])

    sums = vectors.summed(df, [hv], unit_sum, by="label")
    u0, u1 = (sums[c][1:] / sums[c][0] for c in (0, 1))
    intra, inter = float(u0 @ u0), float(u0 @ u1)
    row = (1.0 - cos, gap / np.sqrt(width), fisher, intra, inter, intra - inter)
    return df.sparkSession.createDataFrame(
        [tuple(float(v) for v in row)],
        "cos_dist double, eucl_dist double, fisher_ratio double, intra_sim double, inter_sim double, margin double",
    )


# --------------------------------------------------------------------------- raw features


def raw_features(df: DataFrame, model: EncoderModel, sizes: dict[str, int] | None = None) -> DataFrame:
    """Numbers followed by one-hot categories as an ML vector; slot 0 of each category is 'unseen'.

    The categories are index and value alone, so a vector costs as much for a million tokens as for ten.
    """
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    looked = lookup(df, model.vocabulary, model.cat_cols)
    if not model.cat_cols:
        return VectorAssembler(inputCols=list(model.num_cols), outputCol="features").transform(looked)
    sizes = sizes or vocabulary_sizes(model)
    ids, hot = [f"{c}_id" for c in model.cat_cols], [f"{c}_hot" for c in model.cat_cols]
    # the last slot of each category stands for its size; no slot is dropped
    last = df.sparkSession.createDataFrame([tuple(float(max(sizes[c], 1)) for c in model.cat_cols)], ids)
    encoder = OneHotEncoder(inputCols=ids, outputCols=hot, dropLast=False).fit(last)
    out = VectorAssembler(inputCols=[*model.num_cols, *hot], outputCol="features").transform(encoder.transform(looked))
    return out.drop(*hot)


def vocabulary_sizes(model: EncoderModel) -> dict[str, int]:
    """Distinct tokens per column."""
    sizes = {r["col"]: r["n"] for r in model.vocabulary.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: sizes.get(c, 0) for c in model.cat_cols}


def interactions(df: DataFrame, duration: str, count: str, rate: str, size: str, proto: str, service: str, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Products of numbers and the index of the (protocol, service) pair; unseen pairs get the last slot.

    Returns the rows and the pair table, so that other splits can reuse the one fitted on train.
    """
    key = F.concat_ws("_", F.col(proto), F.col(service))
    if pairs is None:
        distinct = df.select(key.alias("pair")).distinct()
        pairs = cut_lineage(
            ordered.row_numbers(distinct, ["pair"], "slot").withColumn("slot", (F.col("slot") - 1).cast("int"))
        )
    unseen = pairs.count()
    out = (
        df.withColumns(
            {
                "dur_x_count": F.col(duration) * F.col(count),
                "count_x_rate": F.col(count) * F.col(rate),
                "bytes_x_rate": F.col(size) * F.col(rate),
                "pair": key,
            }
        )
        .join(broadcast_if_small(pairs), "pair", "left")
        .withColumn("slot", F.coalesce(F.col("slot"), F.lit(unseen)))
    )
    return out, pairs
