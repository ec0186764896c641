"""Repeated byte strings by suffix arrays that are built in two stages."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from undertow.llm.spans import NO_ID, Windows, cover, repeated
from undertow.llm.text import slices

GRAM = 32


def _words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number that sorts like them."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(text)]
    return out


def sort_direct(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """`at` in the order of the suffixes that start there, as far as `depth` bytes tell."""
    order = at[np.argsort(words[at], kind="stable")]
    n = len(words)
    block = np.zeros(len(order), np.int64)
    if len(order):
        block[1:] = np.cumsum(words[order[1:]] != words[order[:-1]])
    for step in range(8, depth, 8):
        tied = np.r_[False, block[1:] == block[:-1]]
        tied |= np.r_[tied[1:], False]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        # only suffixes that are tied so far are looked at again
        subject, group = order[places], block[places]
        further = subject + step
        key = np.where(further < n, words[np.minimum(further, n - 1)], np.uint64(0))
        again = np.lexsort((key, group))
        order[places] = subject[again]
        changed = np.zeros(len(order), np.int64)
        key, group = key[again], group[again]
        changed[places] = np.r_[False, (key[1:] != key[:-1]) & (group[1:] == group[:-1])]
        block = block + np.cumsum(changed)
    return order


def two_stage(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, 8-byte words) of text, right as far as `depth` bytes tell; the text must end in its smallest byte.

    Suffixes smaller than their successors are sorted directly. The others follow from one scan of the buckets in
    order: a suffix puts its predecessor, if that is larger, at the next free place of its bucket. A bucket's own scan
    comes in waves, since runs of one byte feed the bucket that is being read.
    """
    n = len(text)
    words = _words8(text)
    # smaller than its successor: the next different byte is larger; the last suffix counts as smaller
    differs = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.ones(n, dtype=bool)
    if len(differs):
        nxt = differs[np.minimum(np.searchsorted(differs, np.arange(n)), len(differs) - 1)]
        known = np.arange(n) <= differs[-1]
        smaller[known] = text[nxt[known]] < text[nxt[known] + 1]
    out = np.full(n, -1, np.int64)
    size = np.bincount(text, minlength=256)
    begin = np.concatenate([[0], np.cumsum(size)])
    direct = sort_direct(words, np.flatnonzero(smaller), depth)
    per = np.bincount(text[direct], minlength=256)
    split = begin[1:] - per  # where the directly sorted part of a bucket begins
    done = np.concatenate([[0], np.cumsum(per)])
    for c in np.flatnonzero(per):
        out[split[c] : begin[c + 1]] = direct[done[c] : done[c + 1]]
    free = begin[:-1].copy()

    def induce(entries: np.ndarray) -> None:
        before = entries[entries > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        first = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
        for a, b in zip(first, np.r_[first[1:], len(chars)]):
            c = chars[a]
            out[free[c] : free[c] + b - a] = before[a:b]
            free[c] += b - a

    for c in np.flatnonzero(size):
        read = begin[c]
        while read < free[c]:
            upto = free[c]
            induce(out[read:upto].copy())
            read = upto
        induce(out[split[c] : begin[c + 1]])
    return out, words


def common_prefixes(order: np.ndarray, words: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before it, `limit` at most."""
    n = len(words)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for step in range(0, limit, 8):
        if not len(live):
            break
        a, b = order[live] + step, order[live - 1] + step
        x = np.where(a < n, words[np.minimum(a, n - 1)], np.uint64(0)) ^ np.where(b < n, words[np.minimum(b, n - 1)], np.uint64(0))
        same = np.full(len(x), 8)
        for j in range(7, -1, -1):
            same[(x >> np.uint64(8 * (7 - j))) & np.uint64(0xFF) != 0] = j
        out[live] = step + same
        live = live[same == 8]
    return np.minimum(out, limit)


def resolver(size: int):
    def resolve(table: pa.Table):
        gram, doc, lo = (table.column(c).combine_chunks().to_numpy() for c in ("gram", "doc", "lo"))
        snips = table.column("snip").combine_chunks()
        fresh = np.r_[True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1])]
        doc, lo, snips = doc[fresh], lo[fresh], snips.filter(pa.array(fresh))
        found = [np.zeros(0, np.int64)] * 2
        for _, _, data, at in slices(snips, 1 << 62):
            # snippets one after another, each closed by a zero byte; a text may hold such bytes as well
            length = np.diff(at)
            owner = np.repeat(np.arange(len(length)), length + 1)
            place = np.arange(len(owner)) - np.repeat(at[:-1] + np.arange(len(length)), length + 1)
            text = np.zeros(len(owner), np.uint8)
            text[place < length[owner]] = data
            order, words = two_stage(text, size + 8)
            deep = common_prefixes(order, words, size) >= size
            # a run of deep neighbours is one window of `size` bytes, counted before windows that reach over a border go
            run = np.cumsum(~deep)
            whole = length[owner[order]] - place[order] >= size
            order, run = order[whole], run[whole]
            if not len(order):
                continue
            # the rows come by document and place, so the first of a run is the smallest
            head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            earliest = np.minimum.reduceat(order, head)
            first = np.repeat(earliest, np.diff(np.r_[head, len(order)]))
            later = order[order != first]
            found = [owner[later], lo[owner[later]] + place[later]]
        which, start = found
        return doc[which], start, start + size

    return resolve


def repeated_bytes(docs: DataFrame, size: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): bytes under `size`-byte strings that also start earlier go.

    Earlier is a smaller doc_id, or an earlier start in the same document; strings overlap and are judged on the input.
    Null is the empty text. Equal rows get equal results and do not remove each other; different texts of one doc_id are
    documents of their own, in the order of their digests. A null doc_id orders first. Other columns are ignored. Empty in, empty out.
    """
    spans = repeated(docs, Windows(size, min(GRAM, size), words=False, strict=False), resolver(size))

    def finish(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            rows: list[tuple[int, int, int, str]] = []
            for a, b, data, at in slices(batch.column(1)):
                for r in range(b - a):
                    text = data[at[r] : at[r + 1]]
                    lo, hi = cover(batch.column(2), a + r)
                    lo, hi = np.minimum(lo, len(text)), np.minimum(hi, len(text))
                    digest, last = hashlib.sha256(), 0
                    for x, y in zip(lo, hi):
                        digest.update(text[last:x])
                        last = y
                    digest.update(text[last:])
                    rows.append((len(text), int((hi - lo).sum()), int((hi > lo).sum()), digest.hexdigest()))
            n, gone, count, kept = zip(*rows) if rows else ([], [], [], [])
            ids = pa.array(key, mask=key == NO_ID)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return spans.select("key", "text", "spans").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
