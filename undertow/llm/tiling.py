"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.text import PUNCTUATION, WORD_BASE, Words, prefix_hash, slices, span_hash

#: Bytes of benchmark text that one pass over the documents holds; more items take more passes of the same plan.
BLOCK_BYTES = 8 << 20


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> int:
    """Words of `item` under greedy tiles: longest common runs first, none overlapping, none under `least` words.

    Running Karp-Rabin: windows of one length are compared by rolling hash, matches are extended and marked from the
    longest on, then the length shrinks.
    """
    used_i, used_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    hash_i, hash_d = prefix_hash(item, WORD_BASE), prefix_hash(doc, WORD_BASE)
    length = max(least, len(item) // 2)
    if len(item) < least or len(doc) < least:
        return 0

    def free(used: np.ndarray) -> np.ndarray:
        n = len(used) - length + 1
        marks = np.r_[0, np.cumsum(used)]
        return np.flatnonzero(marks[length : length + n] == marks[:n]) if n > 0 else np.zeros(0, int)

    while True:
        a, b = free(used_i), free(used_d)
        before = used_i.sum()
        found = []
        if len(a) and len(b):
            ha, hb = (span_hash(h, WORD_BASE, x, x + length) for h, x in ((hash_i, a), (hash_d, b)))
            order = np.argsort(ha, kind="stable")
            left, right = np.searchsorted(ha[order], hb, "left"), np.searchsorted(ha[order], hb, "right")
            begun = set()
            for k in np.flatnonzero(right > left):
                for i in a[order[left[k] : right[k]]]:
                    d = b[k]
                    if (i - 1, d - 1) in begun:  # inside a match that is already there
                        begun.add((i, d))
                        continue
                    begun.add((i, d))
                    n = length
                    while i + n < len(item) and d + n < len(doc) and not used_i[i + n] and not used_d[d + n] and item[i + n] == doc[d + n]:
                        n += 1
                    found.append((-n, d, i))
        for n, d, i in sorted(found):
            n = -n
            # what earlier tiles of this round left of the match
            blocked = np.flatnonzero(used_i[i : i + n] | used_d[d : d + n])
            n = int(blocked[0]) if len(blocked) else n
            if n >= length:
                used_i[i : i + n] = used_d[d : d + n] = True
        if length == least:
            # what is left of a match that lost words to an earlier tile may be one itself
            if used_i.sum() == before:
                return int(before)
            continue
        length = max(least, length // 2)


class Bench:
    """One block of benchmark items with the seeds that open a comparison."""

    def __init__(self, items: list[tuple[object, str]], least: int):
        self.least = least
        self.ids = [i for i, _ in items]
        self.words: list[np.ndarray] = []
        seeds, owners, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)]), fold=True, breaks=PUNCTUATION)
            self.words.append(words.hash)
            grams, often = np.unique(words.grams(least), return_counts=True)
            seeds.append(grams)
            times.append(often)
            owners.append(np.full(len(grams), k))
        seed, owner = np.concatenate(seeds), np.concatenate(owners)
        order = np.argsort(seed, kind="stable")
        self.owner, self.times = owner[order], np.concatenate(times)[order]
        self.seed, self.first = np.unique(seed[order], return_index=True)
        self.last = np.r_[self.first[1:], len(order)]

    def best(self, column: pa.Array, threshold: float):
        """(coverage, item, items at or over the threshold) of each text."""
        for a, b, data, at in slices(column):
            words = Words(data, at, fold=True, breaks=PUNCTUATION)
            grams = words.grams(self.least)
            spot = np.minimum(np.searchsorted(self.seed, grams), max(0, len(self.seed) - 1))
            hits = np.flatnonzero(self.seed[spot] == grams) if len(self.seed) and len(grams) else np.zeros(0, np.int64)
            hits = hits[hits + self.least <= words.bounds[words.row[hits] + 1]]
            rows = words.row[hits]
            for r in range(b - a):
                best, item, over = 0.0, None, 0
                own = hits[np.searchsorted(rows, r, "left") : np.searchsorted(rows, r, "right")]
                if len(own):
                    entries = np.concatenate([np.arange(self.first[s], self.last[s]) for s in np.unique(spot[own])])
                    candidates, place = np.unique(self.owner[entries], return_inverse=True)
                    doc = words.hash[words.bounds[r] : words.bounds[r + 1]]
                    for k, seeds in zip(candidates, np.bincount(place, self.times[entries])):
                        whole = self.words[k]
                        # each place of a shared seed in the item brings `least` words to the tiles at most
                        if seeds * self.least < threshold * len(whole):
                            continue
                        part = tiles(whole, doc, self.least) / len(whole)
                        over += part >= threshold
                        if part > best:
                            best, item = part, self.ids[k]
                yield best, item, over


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = 4, threshold: float = 0.6) -> DataFrame:
    """docs with `coverage`, `item_id` and `contaminated`: the benchmark item that greedy tiles cover best, and how far.

    Words are runs of letters, digits and non-ASCII characters, A-Z folded. Items that share too few seeds of `least`
    words to reach the threshold are not tiled and count 0. Tiles may come in any order, so reordered passages count. A document is
    contaminated at `threshold` or more; ties go to the first item by id. Null and empty texts, and items shorter than
    `least` words, match nothing. The benchmark is read in blocks of BLOCK_BYTES, each its own operator of one plan.
    Columns of these names are replaced, other columns and repeated rows stay. Empty in, empty out.
    """
    docs = docs.drop("coverage", "item_id", "contaminated")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    out = docs.withColumns({"coverage": F.lit(0.0), "item_id": F.lit(None).cast("long"), "contaminated": F.lit(False)})
    schema = out.schema
    at = docs.columns.index("text")
    for k in range(blocks):
        some = sorted(((r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))

        def run(batches, some=some):
            bench = Bench(some, least)
            for batch in batches:
                n = batch.num_columns
                had = list(zip(*(batch.column(i).to_pylist() for i in range(n - 3, n))))
                new = []
                for (cover, item, bad), (part, which, over) in zip(had, bench.best(batch.column(at), threshold)):
                    if part > cover or (part == cover and which is not None and (item is None or which < item)):
                        cover, item = part, which
                    new.append((float(cover), item, bool(bad or over)))
                cover, item, bad = zip(*new) if new else ([], [], [])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: n - 3], pa.array(cover, pa.float64()), pa.array(item, pa.int64()), pa.array(bad, pa.bool_())], batch.schema.names
                )

        out = out.mapInArrow(run, schema)
    return out
