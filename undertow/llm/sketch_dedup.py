"""Near-duplicate documents by sketches of word shingles: bands of minima find pairs, the smallest values estimate them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.graph import linked_components, within
from undertow.llm.tables import Tables
from undertow.llm.text import Words, mix, signed, slices
from undertow.session import broadcast_if_small

#: Values kept of each set.
SKETCH = 32
#: Bands of a set and minima of a band: sets of similarity 0.8 share no band with chance (1 - 0.8 ** 8) ** 80, 4e-7.
BANDS, ROWS = 80, 8
#: What turns a band's hash into that of each of its minima: the smallest h ^ turn is the h nearest to a random point.
TURNS = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
#: Values of sets whose bands are computed at a time.
BLOCK = 1 << 17
#: Words of 64 bits of a set's parities. They settle pairs of sets of up to some ODD * 64 values; larger ones differ less.
ODD = 16
#: A pair goes on to the exact check when the union sketch estimates this share of the threshold or more.
SLACK = 0.45


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; a text of fewer words is one shingle, without words none."""
    for lo, hi, data, at in slices(column):
        words = Words(data, at, fold=True)
        grams = words.grams(size)
        for r in range(hi - lo):
            first, last = words.bounds[r], words.bounds[r + 1]
            if last - first >= size:
                yield lo + r, np.unique(grams[first : last - size + 1])
            elif last > first:
                tag = np.uint64(last - first)
                whole = words.hash[first:last] * np.cumprod(np.full(last - first, np.uint64(0x9FB21C651E98DF25)))
                yield lo + r, mix(np.array([np.bitwise_xor.reduce(mix(whole)) + tag], dtype=np.uint64))
            else:
                yield lo + r, np.zeros(0, np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int64()))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), BANDS) keys of sets that are not empty; a band's key is a hash of its minima."""
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), BANDS), np.uint64)
    seeds = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for b in range(BANDS):
        h = mix(values + seeds[b])
        key = np.full(len(sets), b, np.uint64)
        for turn in TURNS:
            key = mix(key * np.uint64(0xD1342543DE82EF95) + np.minimum.reduceat(h ^ turn, starts))
        out[:, b] = key
    return out


def parities(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's values fall on each of ODD * 64 places; two sets differ in as many places as values at most."""
    at = (mix(s ^ np.uint64(0x3C79AC492BA7B653)) % np.uint64(ODD * 64)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=ODD * 64) & 1).astype(np.uint8)).view(np.int64)


def _sketches(size: int):
    def run(batches):
        for batch in batches:
            n, one, two, keep, bands, odd = [], [], [], [], [], []
            wait: list[tuple[int, np.ndarray]] = []
            held = 0

            def settle():
                for (r, _), keys in zip(wait, band_keys([s for _, s in wait]) if wait else (), strict=True):
                    bands[r] = signed(keys)
                wait.clear()

            for _, s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                one.append(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))))
                two.append(np.add.reduce(mix(s + np.uint64(0x14057B7EF767814F))))
                # a uniform hash of the shingle: its own bits, made positive so that signed order is its order
                keep.append(signed(np.sort(s >> np.uint64(1))[:SKETCH]))
                odd.append(parities(s))
                bands.append(np.zeros(0, np.int64))
                if len(s):
                    wait.append((len(bands) - 1, s))
                    held += len(s)
                if held > BLOCK:
                    settle()
                    held = 0
            settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(signed(np.array(one, np.uint64))), pa.array(signed(np.array(two, np.uint64))), _lists(keep), _lists(odd), _lists(bands)],
                ["doc_id", "n_shingles", "one", "two", "sketch", "odd", "bands"],
            )

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            ids, parts, held = [], [], 0
            for r, s in shingle_sets(batch.column(1), size):
                ids.append(r)
                parts.append(signed(s))
                held += len(s)
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), _lists(parts)], ["id", "items"])
                    ids, parts, held = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), _lists(parts)], ["id", "items"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document; links are 100 * intersection >= percent * union.

    Documents with equal sets form a class. Each set has BANDS keys, a hash of ROWS minima each; classes that share a key
    are compared. The minima of one band come from one hash h as the smallest h ^ turn: each is that of a shared value
    with chance J (the similarity) on average, and all of them with J ** ROWS at least, as they depend on one another
    only through h. Bands have hashes of their own, so nothing is assumed about which values are rare: a pair at 0.8 is
    missed with a chance of 4e-7 at most, one of 0.5 meets with 0.3 or a little more, one of 0.3 hardly ever; so a bucket
    grows with a group of like documents, not with those that share a passage. Of two sets of different size the
    smaller must have the share of the larger; and where their parities differ in more places than linked sets have values
    apart, they are not linked, which loses none. Each set also keeps its SKETCH smallest values: the sketch of the union estimates
    the similarity (a pair at the threshold falls short with a chance of 3e-8), the full sets of the pairs left confirm it.

    Null, empty and blank texts have an empty set and link with nothing. Rows that repeat a doc_id and text get equal
    rows; a null doc_id stays alone with a null component and is kept. Other columns are ignored. Empty in, empty out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = percent / 100
    tables = Tables(docs.sparkSession)
    sketched = tables.write(docs.mapInArrow(_sketches(size), "doc_id long, n_shingles long, one long, two long, sketch array<long>, odd array<long>, bands array<long>"), "sketches")
    real = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = [F.first(c).alias(c) for c in ("sketch", "odd", "bands")]
    classes = real.groupBy("one", "two").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *same)
    classes = tables.write(classes, "classes")
    members = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("node"))
    tags = classes.select(F.col("rep").alias("node"), F.struct("n", *[F.col("odd")[k].alias(f"w{k}") for k in range(ODD)]).alias("tag"))

    def alike(x: str, y: str):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    def likely(x: str, y: str):
        return within(x, y, ODD, percent)

    reps = classes.select("rep", "n", "sketch")

    def near(pairs: DataFrame) -> DataFrame:
        left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
        overlap = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
        close = (
            pairs.join(left, "a")
            .join(right, "b")
            .filter(alike("na", "nb"))
            .filter(overlap >= SLACK * share * F.size(union))
            .select("a", "b", "na", "nb")
        )
        close = tables.write(close, "close")
        if close.isEmpty():
            return close
        ids = close.select(F.col("a").alias("doc_id")).union(close.select(F.col("b").alias("doc_id"))).distinct()
        # the sets of the candidates alone, read from their texts once more
        texts = docs.join(broadcast_if_small(ids), "doc_id")
        sets = tables.write(texts.mapInArrow(_sets(size), "id long, items array<long>").dropDuplicates(["id"]), "sets")
        both = F.size(F.array_intersect("ia", "ib"))
        return (
            close.join(sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b")
            .withColumn("both", both)
            .filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both")))
        )

    found = linked_components(members, near, likely, None, tags)
    tables.drop("close", "sets")
    named = classes.select("one", "two", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = named.select("one", "two", F.coalesce("component", "rep").alias("component"))
    lonely = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = sketched.select("doc_id", "n_shingles", "one", "two").join(named, ["one", "two"], "left")
    component = F.when(lonely, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
