"""Repeated windows of texts: content-defined anchors find where they may lie, a resolver given by the caller decides.

A window is a fixed number of consecutive units (bytes or words) of one text. Its anchor is the unit gram in it with the
smallest hash, so equal windows have equal anchors at equal places. The windows of one anchor are consecutive: the text
under them is the anchor's snippet. A snippet met before is a repeat as a whole. Different snippets round one anchor
gram may share some of their windows: these texts are gathered by that gram and go to the resolver.

Only hashes and places are shuffled for the bulk; repeats within one task's rows are settled there, so a passage that
a third of all documents hold reaches its key once a task. Positions are bytes of the UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.text import BYTE_BASE, WORD_BASE, Words, byte_prefix, prefix_hash, signed, sliding_min, slices, span_hash

#: Stands for a null doc_id: orders first, and keeps the join key non-null.
NO_ID = -(1 << 63)
_LOW = np.uint64(0xFFFFFFFF)
RESOLVE_BYTES = 2 << 20


@dataclass(frozen=True)
class Windows:
    """size: units of a window; gram: units of an anchor; words: units are words, else bytes; strict: a repeat must lie
    in a document with a smaller id, else an earlier place in the same one counts too."""

    size: int
    gram: int
    words: bool
    strict: bool


def anchors(data: np.ndarray, at: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """(row, gram hash, snippet hash, first byte, end byte) of the anchors of a run of texts."""
    if w.words:
        units = Words(data, at)
        n, bounds, starts, ends = len(units.hash), units.bounds, units.start, units.end
        base, prefix = WORD_BASE, prefix_hash(units.hash, WORD_BASE)
    else:
        n, bounds = len(data), at
        base, prefix = BYTE_BASE, byte_prefix(data)
    none = np.zeros(0, np.int64)
    if n < w.size:
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    where = np.arange(n - w.gram + 1)
    grams = span_hash(prefix, base, where, where + w.gram)
    packed = (grams & ~_LOW) | where.astype(np.uint64)
    least = (sliding_min(packed, w.size - w.gram + 1) & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(bounds))[: len(least)]
    inside = np.arange(len(least)) + w.size <= bounds[row + 1]
    keep = np.flatnonzero(inside)
    if not len(keep):
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    spot, owner = least[keep], row[keep]
    new = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (owner[1:] != owner[:-1])])
    first = keep[new]
    last = keep[np.r_[new[1:] - 1, len(keep) - 1]] + w.size
    owner = owner[new]
    shift = at[owner]
    begin, end = (starts[first], ends[last - 1]) if w.words else (first, last)
    return owner, grams[spot[new]], span_hash(prefix, base, first, last), begin - shift, end - shift


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the ranges of each document."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    fresh = np.r_[True, doc[1:] != doc[:-1]]
    block = np.cumsum(fresh) - 1
    span = np.int64(hi.max() + 1)
    reach = np.maximum.accumulate(hi + block * span) - block * span
    start = fresh | np.r_[True, lo[1:] > reach[:-1]]
    begin = np.flatnonzero(start)
    return doc[begin], lo[begin], reach[np.r_[begin[1:] - 1, len(doc) - 1]]


def _settle(gram, snip, doc, lo, hi, strict):
    """Marks of whole snippets met before, and the mask of rows left: one of each snippet, or all of its first document."""
    order = np.lexsort((lo, doc, snip, gram))
    gram, snip, doc, lo, hi = gram[order], snip[order], doc[order], lo[order], hi[order]
    fresh = np.r_[True, (gram[1:] != gram[:-1]) | (snip[1:] != snip[:-1])]
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    later = doc > doc[head]
    same = ~fresh & ~later & (lo == np.r_[-1, lo[:-1]])  # the same place met twice: a repeated row
    if not strict:
        later |= ~fresh & (lo > lo[head])
    left = ~later & ~same
    return (doc[later], lo[later], hi[later]), (gram[left], snip[left], doc[left], lo[left], hi[left])


_FOUND = "gram long, snip long, doc long, dig long, lo long, hi long, mark boolean"


def _ranked(doc: np.ndarray, dig: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Numbers of texts in the order of (doc_id, digest), and what they stand for: rows may share a doc_id, not a number."""
    order = np.lexsort((dig, doc))
    doc, dig = doc[order], dig[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (dig[1:] != dig[:-1])][: len(doc)]
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return rank, (doc[fresh], dig[fresh])


def _found(gram, snip, rank, lo, hi, texts, mark: bool) -> pa.RecordBatch:
    n, doc, dig = len(rank), texts[0][rank], texts[1][rank]
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(np.asarray(x))) for x in (gram, snip)] + [pa.array(x) for x in (doc, dig, lo, hi)] + [pa.array(np.full(n, mark))],
        ["gram", "snip", "doc", "dig", "lo", "hi", "mark"],
    )


def _scan(w: Windows):
    def run(batches):
        for batch in batches:
            ranks, texts = _ranked(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            parts = []
            for a, b, data, at in slices(batch.column(2)):
                row, gram, snip, lo, hi = anchors(data, at, w)
                parts.append((gram, snip, ranks[a:b][row], lo, hi))
            if not parts:
                continue
            marks, left = _settle(*(np.concatenate(x) for x in zip(*parts)), w.strict)
            marks = merged(*marks)
            # marks take part in the same shuffle; their key only spreads them
            yield _found(texts[0][marks[0]], marks[1], *marks, texts, True)
            yield _found(*left, texts, False)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], limit: int, weight: Callable[[pa.RecordBatch], int]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut again so that no value of it is in two of them."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        total += weight(batch)
        if total < limit:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            total = sum(map(weight, held))
    if held:
        yield pa.Table.from_batches(held)


def _compare(w: Windows):
    def run(batches):
        for table in _grouped(batches, 1 << 17, lambda b: b.num_rows):
            gram, snip, doc, dig, lo, hi = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("gram", "snip", "doc", "dig", "lo", "hi"))
            doc, texts = _ranked(doc, dig)
            known = doc, lo, hi
            mark = table.column("mark").combine_chunks().to_numpy(zero_copy_only=False)
            marks, (gram, snip, doc, lo, hi) = _settle(gram[~mark], snip[~mark], doc[~mark], lo[~mark], hi[~mark], w.strict)
            out = merged(*(np.concatenate([a, b[mark]]) for a, b in zip(marks, known)))
            yield _found(texts[0][out[0]], out[1], *out, texts, True)
            if not len(gram):
                continue
            # sorted by gram, then snippet: a gram with more than one snippet needs the texts
            edge = np.r_[True, gram[1:] != gram[:-1]]
            kinds = np.add.reduceat(np.r_[True, (snip[1:] != snip[:-1])] | edge, np.flatnonzero(edge))
            several = (kinds > 1)[np.cumsum(edge) - 1]
            yield _found(gram[several], snip[several], doc[several], lo[several], hi[several], texts, False)

    return run


def repeated(docs: DataFrame, w: Windows, resolve: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """docs (key, dig, text) with `spans`: the byte ranges, as array<struct<lo, hi>>, under windows that occur earlier.

    `resolve` gets rows (gram, doc, lo, snip) of whole grams, sorted by (gram, doc, lo), and returns the ranges
    (doc, lo, hi) of the windows among them that occur earlier. There doc numbers the texts by (doc_id, digest of the
    text): equal rows share their spans, different texts of one doc_id or of none do not.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("key", F.xxhash64("text").alias("dig"), "text")
    # neither column can be null, so no filter is inferred and both joins read one exchange of the texts
    found = docs.mapInArrow(_scan(w), _FOUND).repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare(w), _FOUND)
    asked = found.filter("NOT mark").select(F.col("doc").alias("key"), "dig", "gram", "lo", "hi")
    snippet = F.expr("substring(cast(text AS binary), cast(lo + 1 AS int), cast(hi - lo AS int))")
    texts = asked.join(docs, ["key", "dig"], "left").select("gram", F.col("key").alias("doc"), "dig", "lo", snippet.alias("snip")).filter("octet_length(snip) > 0")

    def resolved(batches):
        for table in _grouped(batches, RESOLVE_BYTES, lambda b: b.column("snip").nbytes):
            rank, names = _ranked(*(table.column(c).combine_chunks().to_numpy() for c in ("doc", "dig")))
            rank, lo, hi = merged(*resolve(table.set_column(table.column_names.index("doc"), "doc", pa.array(rank))))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[0][rank], names[1][rank], lo, hi)], ["doc", "dig", "lo", "hi"])

    partial = texts.repartition("gram").sortWithinPartitions("gram", "doc", "dig", "lo").mapInArrow(resolved, "doc long, dig long, lo long, hi long")
    marks = found.filter("mark").select("doc", "dig", "lo", "hi").union(partial)
    spans = marks.groupBy(F.col("doc").alias("key"), "dig").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return docs.join(spans, ["key", "dig"], "left")


def cover(spans: pa.Array, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged ranges of one row of `spans`."""
    if not spans[r].is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = spans[r].values
    lo, hi = part.field("lo").to_numpy(), part.field("hi").to_numpy()
    _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, hi)
    return lo, hi
