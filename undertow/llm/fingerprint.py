"""Fingerprints of documents from their improbable features.

Every window of WINDOW bytes has an entropy; how rare its entropy is among all texts ranks it. A window that is the rarest
(the first of equals) of at least POPULAR of the REACH neighbourhoods it lies in is a feature. The features of a text, in
order, each once, fill a chain of Bloom filters. Two chains are compared filter by filter by the bits they share beyond
chance. Whether a window is a feature depends on the bytes around it alone, so an edit changes features near it only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.tables import Tables
from undertow.llm.text import BYTE_BASE, SLICE_BYTES, byte_prefix, sliding_min, span_hash

#: Bytes of a window; windows of a neighbourhood; neighbourhoods that a feature is the rarest window of.
WINDOW, REACH, POPULAR = 32, 64, 16
#: Bits of a filter, bits that a feature sets, and features of a filter.
BITS, PROBES, PER_FILTER = 2048, 5, 160
#: Steps that entropies are counted in, and text bytes of one partition.
LEVELS, PARTITION_BYTES = 1000, 64 << 20
#: Overlap beyond chance, in standard deviations, that counts.
SURE = 3.0

_COUNTS = np.arange(WINDOW + 1)
#: c log c in whole numbers, so that sums are exact; and what the c-th equal byte adds to it.
_LOGS = np.round(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * (1 << 20)).astype(np.int64)
_ADDS = np.diff(_LOGS, prepend=0)

# --------------------------------------------------------------------------- features


def entropy_levels(sums: np.ndarray) -> np.ndarray:
    """Step of the entropy, from the windows' sums of c log c over byte counts: 0 for equal bytes, LEVELS for distinct ones."""
    return LEVELS - sums * LEVELS // _LOGS[-1]


def window_levels(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, level) of every window of the pieces at[k]:at[k + 1] of data; no window crosses pieces."""
    size = np.diff(at)
    piece = np.repeat(np.arange(len(size)), size)
    order = np.argsort(data, kind="stable")
    # places of equal bytes side by side, with pieces a window apart
    key = (data[order].astype(np.int64) << 40) + order + piece[order] * WINDOW
    n = np.arange(len(data))
    ahead, behind = np.empty(len(data), np.int64), np.empty(len(data), np.int64)
    ahead[order] = _ADDS[np.searchsorted(key, key + WINDOW) - n]
    behind[order] = _ADDS[n + 1 - np.searchsorted(key, key - WINDOW, "right")]
    come, gone = np.r_[0, np.cumsum(behind)], np.r_[0, np.cumsum(ahead)]
    start = n[n + WINDOW <= at[1:][piece]]
    first = at[:-1][piece[start]]
    return start, entropy_levels(come[start + WINDOW] - come[first] - gone[start] + gone[first])


def features(pieces: list[tuple[bytes, int, int]], ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the features of each piece that start at lo <= place < hi, for pieces (bytes, lo, hi)."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    at, held = 0, 0
    for k, (raw, _, _) in enumerate(pieces):
        held += len(raw)
        if held >= SLICE_BYTES or k + 1 == len(pieces):
            out += _features(pieces[at : k + 1], ranks)
            at, held = k + 1, 0
    return out


def _features(pieces: list[tuple[bytes, int, int]], ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    data = np.frombuffer(b"".join(p[0] for p in pieces), np.uint8)
    size = np.array([len(p[0]) for p in pieces])
    at = np.r_[0, np.cumsum(size)]
    start, level = window_levels(data, at)
    count = np.maximum(size - WINDOW + 1, 0)
    # windows of each piece with the width of a neighbourhood between pieces and around them
    place = np.arange(len(start)) + np.repeat(np.arange(1, len(size) + 1), count) * (REACH - 1)
    key = np.full(len(start) + (len(size) + 1) * (REACH - 1), np.iinfo(np.int64).max)
    key[place] = (ranks[level].astype(np.int64) << 40) + np.arange(len(start))
    best = sliding_min(key, REACH)
    wins = np.bincount(best[best < np.iinfo(np.int64).max] & ((1 << 40) - 1), minlength=len(start))
    chosen = start[wins >= POPULAR]
    short = at[:-1][(size > 0) & (size < WINDOW)]
    chosen = np.sort(np.r_[chosen, short])
    home = np.searchsorted(at, chosen, "right") - 1
    end = np.minimum(chosen + WINDOW, at[1:][home])
    hashes = span_hash(byte_prefix(data), BYTE_BASE, chosen, end)
    cut = np.searchsorted(home, np.arange(len(pieces) + 1))
    out = []
    for k, (_, lo, hi) in enumerate(pieces):
        places = chosen[cut[k] : cut[k + 1]] - at[k]
        a, b = np.searchsorted(places, (lo, hi))
        out.append((places[a:b], hashes[cut[k] + a : cut[k] + b]))
    return out


def _around(raw: bytes, lo: int, hi: int) -> tuple[bytes, int, int]:
    """A piece of raw that decides which of the windows lo <= place < hi are features."""
    a = max(0, lo - REACH + 1)
    return raw[a : max(0, hi + REACH - 1) + WINDOW], lo - a, hi - a


def text_features(texts: list[bytes], ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the features of each text; long ones are read in slices."""
    pieces, owner = [], []
    for k, raw in enumerate(texts):
        for lo in range(0, max(len(raw), 1), SLICE_BYTES):
            pieces.append(_around(raw, lo, min(lo + SLICE_BYTES, len(raw))) if len(raw) > SLICE_BYTES else (raw, 0, len(raw)))
            owner.append((k, max(0, lo - REACH + 1) if len(raw) > SLICE_BYTES else 0))
    out: list[list] = [[] for _ in texts]
    for (k, shift), (places, hashes) in zip(owner, features(pieces, ranks)):
        out[k].append((places + shift, hashes))
    return [x[0] if len(x) == 1 else (np.concatenate([p for p, _ in x]), np.concatenate([h for _, h in x])) for x in out]


def _edited_pieces(head: int, own: bytes, after: bytes, taken: int) -> tuple[int, list[tuple[bytes, int, int]], int, int]:
    """What the features of own[:head] + after[:taken] are made of: the own ones before a place, pieces to read anew, and
    the ones of `after` in a range of places, which stand before the last piece if there are two."""
    lo = max(0, head - WINDOW - REACH + 2)
    total = head + taken
    if taken <= 4 * (WINDOW + REACH):
        whole = own[max(0, lo - REACH + 1) : head] + after[:taken]
        a = max(0, lo - REACH + 1)
        return lo, [(whole, lo - a, total - a)], 0, 0
    a = max(0, lo - REACH + 1)
    near = 2 * REACH + WINDOW
    pieces = [(own[a:head] + after[:near], lo - a, head + REACH - 1 - a)]
    if taken == len(after):
        return lo, pieces, REACH - 1, taken
    stop = taken - WINDOW - REACH + 2
    pieces.append((after[stop - REACH + 1 : taken], REACH - 1, taken))
    return lo, pieces, REACH - 1, stop


def edited(texts: list[str], raws: list[bytes], found: list[tuple[np.ndarray, np.ndarray]], ranks: np.ndarray) -> tuple[list[str], list[np.ndarray]]:
    """Text and feature hashes of every text but the last, its last quarter replaced by the start of the next one."""
    pieces, made, spans = [], [], []
    for k in range(len(texts) - 1):
        n = len(texts[k])
        start, rest = texts[k][: n - n // 4], texts[k + 1][: n // 4]
        made.append(start + rest)
        lo, parts, x, y = _edited_pieces(len(start.encode()), raws[k], raws[k + 1], len(rest.encode()))
        spans.append((lo, len(parts), x, y))
        pieces += parts
    new = iter(features(pieces, ranks))
    out = []
    for k, (lo, n, x, y) in enumerate(spans):
        places, hashes = found[k]
        chain = [hashes[: np.searchsorted(places, lo)], next(new)[1]]
        if y:
            a, b = np.searchsorted(found[k + 1][0], (x, y))
            chain.append(found[k + 1][1][a:b])
        if n == 2:
            chain.append(next(new)[1])
        out.append(np.concatenate(chain))
    return made, out


# --------------------------------------------------------------------------- filters


def filters(chains: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(features, rows of filter bytes) of each chain of hashes, equal hashes once."""
    owner = np.repeat(np.arange(len(chains)), [len(c) for c in chains])
    hashes = np.concatenate(chains) if chains else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, owner))  # stable: the first of equal ones comes first
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    keep = np.sort(order[new])
    owner, hashes = owner[keep], hashes[keep]
    count = np.bincount(owner, minlength=len(chains))
    many = -(-count // PER_FILTER)
    first = np.r_[0, np.cumsum(many)]
    rank = np.arange(len(owner)) - np.r_[0, np.cumsum(count)][owner]
    row = first[owner] + rank // PER_FILTER
    bits = np.zeros((int(first[-1]), BITS), bool)
    for k in range(PROBES):
        bits[row, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [(int(count[k]), packed[first[k] : first[k + 1]]) for k in range(len(chains))]


def shown(digest: tuple[int, np.ndarray]) -> str:
    """A digest as text: its number of features, and its filters in base 64."""
    return f"{digest[0]}:{base64.b64encode(digest[1].tobytes()).decode()}"


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1: for each filter of the shorter chain, the largest share of bits beyond chance with one of the other."""
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    (n, few), (_, many) = sorted((a, b), key=lambda d: (len(d[1]), d[0]))
    ones = np.bitwise_count(many).sum(1, dtype=np.int64)
    total = 0.0
    for k, row in enumerate(few):
        own = int(np.bitwise_count(row).sum(dtype=np.int64))
        most, rate = np.minimum(own, ones), np.maximum(own, ones) / BITS
        chance = most * rate
        common = np.bitwise_count(many & row).sum(1, dtype=np.int64)
        over = common - chance
        sure = over > SURE * np.sqrt(chance * (1 - rate))
        share = float((np.where(sure, over, 0.0) / (most - chance)).max())
        total += min(PER_FILTER, n - k * PER_FILTER) * share
    return min(1.0, total / n)


# --------------------------------------------------------------------------- documents


def level_counts(texts: list[bytes]) -> np.ndarray:
    """Windows per level over every window of every text, SLICE_BYTES of text or so at a time."""
    seen = np.zeros(LEVELS + 1, np.int64)
    pieces, held = [], 0
    for raw in texts:
        # slices of a long text overlap, so that each window lies in one of them
        for a in range(0, len(raw) - WINDOW + 1, SLICE_BYTES):
            pieces.append(raw[a : a + SLICE_BYTES + WINDOW - 1])
            held += len(pieces[-1])
            if held >= SLICE_BYTES:
                seen += _levels_of(pieces)
                pieces, held = [], 0
    return seen + _levels_of(pieces)


def _levels_of(pieces: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    _, level = window_levels(data, np.r_[0, np.cumsum([len(p) for p in pieces], dtype=np.int64)])
    return np.bincount(level, minlength=LEVELS + 1)


def _end_to_end(texts: list[bytes]) -> np.ndarray:
    """Windows per level where each text is cut into windows end to end; the last one overlaps."""
    seen = np.zeros(LEVELS + 1, np.int64)
    for raw in texts:
        data = np.frombuffer(raw, np.uint8)
        for a in range(0, len(raw), SLICE_BYTES):
            piece = data[a : a + SLICE_BYTES]
            if len(piece) >= WINDOW:
                starts = np.unique(np.r_[np.arange(0, len(piece) - WINDOW + 1, WINDOW), len(piece) - WINDOW])
                seen += np.bincount(entropy_levels(_block_sums(piece[starts[:, None] + np.arange(WINDOW)])), minlength=LEVELS + 1)
    return seen


def entropy_counts(docs: DataFrame, text: str = "text", every: bool = False) -> tuple[np.ndarray, int]:
    """Windows per level over all texts, and all bytes: every window, or windows end to end."""
    counted = level_counts if every else _end_to_end

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = np.zeros(LEVELS + 1, np.int64), 0
        for batch in batches:
            raws = [t.encode() for t in batch.column(0).to_pylist()]
            size += sum(map(len, raws))
            seen += counted(raws)
        level = np.r_[np.arange(LEVELS + 1), -1]
        yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(np.r_[seen, size])], names=["level", "n"])

    rows = docs.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(count, "level long, n long")
    found = {r["level"]: r["n"] for r in rows.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(k, 0) for k in range(LEVELS + 1)]), found.get(-1, 0)


def _block_sums(blocks: np.ndarray) -> np.ndarray:
    """Sum of c log c over the byte counts of each row."""
    ordered = np.sort(blocks, axis=1)
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first = np.flatnonzero(new)
    runs = np.diff(np.r_[first, blocks.size])
    return np.add.reduceat(_LOGS[runs], np.searchsorted(first, np.arange(len(blocks)) * WINDOW))


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: 0 the least frequent; of equals, the higher entropy."""
    order = np.lexsort((-np.arange(len(counts)), counts))
    ranks = np.empty(len(counts), np.int64)
    ranks[order] = np.arange(len(counts))
    return ranks


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


class Reader:
    """Rows of the result for texts that come one after another; the last one waits for the next."""

    def __init__(self, ranks: np.ndarray):
        self.ranks = ranks
        self.ids: list = []
        self.texts: list[str] = []
        self.found: list = []
        self.digests: list = []

    def add(self, ids: list, texts: list[str]) -> list[list]:
        """Columns of the rows that are complete now."""
        raws = [t.encode() for t in texts]
        found = text_features(raws, self.ranks)
        self.ids, self.texts, self.found = self.ids + ids, self.texts + texts, self.found + found
        raws = [t.encode() for t in self.texts[: len(self.texts) - len(raws)]] + raws
        made, chains = edited(self.texts, raws, self.found, self.ranks)
        digests = filters([h for _, h in found] + chains)
        own, other = self.digests + digests[: len(found)], digests[len(found) :]
        n = len(made)
        columns = [
            self.ids[:n], [len(t) for t in self.texts[:n]], [hashlib.sha256(t.encode()).hexdigest() for t in made], [shown(d) for d in own[:n]],
            [shown(d) for d in other], [likeness(own[k], other[k]) for k in range(n)], [likeness(own[k], own[k + 1]) for k in range(n)],
        ]
        self.ids, self.texts, self.found, self.digests = self.ids[-1:], self.texts[-1:], self.found[-1:], own[-1:]
        return columns


def _portions(batch: pa.RecordBatch, ids: int, texts: int) -> Iterator[tuple[list, list[str]]]:
    """Rows of a batch, some SLICE_BYTES of text at a time."""
    size = np.cumsum([len(t) for t in batch.column(texts).to_pylist()])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        part = batch.slice(at, end - at)
        yield part.column(ids).to_pylist(), part.column(texts).to_pylist()
        at = end


def fingerprints(docs: DataFrame, every: bool = False) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    Documents are ordered by doc_id, null first; rows of one doc_id by a digest of the text, so rows that repeat a
    document wholly follow each other. The one after the last is the first, for a single document itself. Null texts are
    empty; an empty text has no feature and is like an empty text alone. A text of under WINDOW bytes is one feature.
    Other columns are not read. Empty in, empty out.

    How rare an entropy is, is counted over every window of every text if `every` is set, else over windows end to end.
    Either way every window is ranked by it.

    Texts are shuffled once, by ranges; a partition gives the rows of all its documents but the last, whose next document
    opens the partition after it. The first and last texts of the partitions are kept and meet in a join.
    """
    spark = docs.sparkSession
    counts, size = entropy_counts(docs, every=every)
    ranks = rarity(counts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_t": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), "_t", "_at"]
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part = Reader(ranks), None
        for batch in batches:
            for ids, texts in _portions(batch, 0, 1):
                if part is None:
                    part = batch.column(2)[0].as_py()
                    yield _edge(part, True, ids[0], texts[0])
                yield _done(reader.add(ids, texts), part)
        if part is not None:
            yield _edge(part, False, reader.ids[-1], reader.texts[-1])

    kept = Tables(spark).write(laid.mapInArrow(read, f"{_RESULT}, part int, opens boolean, text string"), "rows")
    edges = kept.filter("opens IS NOT NULL").select("part", "opens", "doc_id", "text")
    known = sorted(r["part"] for r in edges.filter("opens").select("part").collect())
    if not known:
        return kept.select(*_NAMES)
    follows = spark.createDataFrame(list(zip(known, known[1:] + known[:1])), "part int, next_part int")
    first = edges.filter("opens").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    last = edges.filter("NOT opens").join(F.broadcast(follows), "part").join(first.hint("merge"), "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own, after in zip(*(batch.column(k).to_pylist() for k in range(3))):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(Reader(ranks).add([ids, None], [own, after]), _TYPES)], names=_NAMES)

    closed = last.select("doc_id", "text", "next_text").mapInArrow(close, _RESULT)
    return kept.filter("opens IS NULL").select(*_NAMES).union(closed)


_EDGE_NAMES = [*_NAMES, "part", "opens", "text"]


def _done(columns: list[list], part: int) -> pa.RecordBatch:
    n = len(columns[0])
    arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES)] + [pa.array([part] * n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=_EDGE_NAMES)


def _edge(part: int, opens: bool, doc_id: int | None, text: str) -> pa.RecordBatch:
    arrays = [pa.array([doc_id], pa.int64()), *(pa.nulls(1, t) for t in _TYPES[1:]), pa.array([part], pa.int32()), pa.array([opens]), pa.array([text], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=_EDGE_NAMES)
