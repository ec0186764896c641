"""Repeated word sequences by suffix trees, one for each memory-sized group of suffixes with a common prefix."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from undertow.llm.spans import NO_ID, Windows, cover, repeated
from undertow.llm.text import Words, slices

GRAM = 5
#: Suffixes of one subtree at most, unless they share the whole window.
SUBTREE = 1 << 16


def prefix_groups(tokens: np.ndarray, limit: int) -> np.ndarray:
    """Group of each suffix: prefixes grow by a word where more than `limit` suffixes share them; small ones are packed."""
    group = np.zeros(len(tokens), np.int64)
    for depth in range(tokens.shape[1]):
        size = np.bincount(group)
        large = size[group] > limit
        if not large.any():
            break
        _, group = np.unique(np.stack([group, np.where(large, tokens[:, depth].astype(np.int64) + 1, 0)], 1), axis=0, return_inverse=True)
    size = np.bincount(group)
    return (np.cumsum(size) // limit)[group]


def subtree(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subtree over some suffixes: their order, and the depth, in words, at which each branches off the one before."""
    order = np.lexsort(tokens.T[::-1])
    near = tokens[order]
    apart = near[1:] != near[:-1]
    depth = np.where(apart.any(axis=1), apart.argmax(axis=1), tokens.shape[1])
    return order, np.r_[0, depth]


def deep_nodes(depth: np.ndarray, least: int) -> np.ndarray:
    """The internal node of `least` words or more above each leaf; a leaf without one is a node of its own."""
    return np.cumsum(depth < least)


def resolver(size: int):
    def resolve(table: pa.Table):
        gram, doc, lo = (table.column(c).combine_chunks().to_numpy() for c in ("gram", "doc", "lo"))
        marks: list[tuple[np.ndarray, ...]] = []
        for a, b, data, at in slices(table.column("snip"), 1 << 62):
            words = Words(data, at)
            _, ids = np.unique(words.hash, return_inverse=True)
            begin = np.flatnonzero(np.arange(len(words.row)) + size <= words.bounds[words.row + 1])
            if not len(begin):
                continue
            tokens = np.lib.stride_tricks.sliding_window_view(ids.astype(np.int32), size)[begin]
            owner = words.row[begin]
            group = prefix_groups(tokens, SUBTREE)
            by = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(group[by]) > 0])
            for x, y in zip(cuts, np.r_[cuts[1:], len(by)]):
                some = by[x:y]
                order, depth = subtree(tokens[some])
                some = some[order]
                node = deep_nodes(depth, size)
                head = np.flatnonzero(np.r_[True, np.diff(node) > 0])
                least = np.minimum.reduceat(doc[owner[some]], head)
                later = some[doc[owner[some]] > np.repeat(least, np.diff(np.r_[head, len(some)]))]
                row = owner[later]
                marks.append((doc[row], lo[row] + words.start[begin[later]] - at[row], lo[row] + words.end[begin[later] + size - 1] - at[row]))
        if not marks:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*marks))

    return resolve


def repeated_words(docs: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): words under windows of `size` words that a smaller doc_id holds go.

    Words are kept as written; windows are judged on the input. Null and blank texts have no words. Equal rows
    get equal results and do not remove each other; different texts of one doc_id are documents of their own, in the
    order of their digests. A null doc_id orders first. Other columns are
    ignored. Empty in, empty out.
    """
    spans = repeated(docs, Windows(size, min(GRAM, size), words=True, strict=True), resolver(size))

    def finish(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            n, gone, kept = [], [], []
            for a, b, data, at in slices(batch.column(1)):
                words = Words(data, at)
                raw = data.tobytes()
                for r in range(b - a):
                    first, last = words.bounds[r], words.bounds[r + 1]
                    start, end = words.start[first:last], words.end[first:last]
                    lo, hi = cover(batch.column(2), a + r)
                    drop = np.zeros(last - first, dtype=bool)
                    if len(lo):
                        # a range covers whole words
                        i = np.searchsorted(lo + at[r], start, "right") - 1
                        drop = (i >= 0) & (end <= hi[np.maximum(i, 0)] + at[r])
                    digest = hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(start[~drop].tolist(), end[~drop].tolist())]))
                    n.append(last - first)
                    gone.append(int(drop.sum()))
                    kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, mask=key == NO_ID), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return spans.select("key", "text", "spans").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
