"""Vectorised bytes and words of Arrow text columns: the inner loops of the text operators.

Texts are read as UTF-8 bytes. A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit polynomials
of table-mapped bytes, taken from prefix sums and mixed, so a window of any length costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD1342543DE82EF95)
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Spaces and ASCII punctuation: what parts words where only letters and digits count.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_FOLDED = _TABLE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverses modulo 2**64 for i < n."""
    kept = _powers.get(int(base))
    if kept is None or len(kept[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base), np.full(size, inverse)
        up[0] = down[0] = 1
        kept = _powers[int(base)] = (np.cumprod(up), np.cumprod(down))
    return kept


def prefix_hash(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix sums from which `span_hash` takes the hash of any span of values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, base: np.uint64, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(base, len(prefix))[1][start])


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `limit` bytes; a longer text is one run. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    at = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a run of texts: start, end (bytes), row and hash, plus bounds: words of row r are bounds[r]:bounds[r + 1]."""

    def __init__(self, data: np.ndarray, at: np.ndarray, fold: bool = False, breaks: np.ndarray = _SPACE):
        n = len(data)
        solid = ~breaks[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        before = np.ones(n, dtype=bool)
        after = np.ones(n, dtype=bool)
        if n:
            before[1:] = ~solid[:-1] | edge[1:n]
            after[:-1] = ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.bounds = np.searchsorted(self.start, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.bounds))
        table = _FOLDED if fold else _TABLE
        self.hash = span_hash(prefix_hash(table[data], BYTE_BASE), BYTE_BASE, self.start, self.end)

    def grams(self, size: int) -> np.ndarray:
        """Hash of the `size` words from each word on; meaningless where a text ends sooner."""
        n = max(0, len(self.hash) - size + 1)
        first = np.arange(n)
        return span_hash(prefix_hash(self.hash, WORD_BASE), WORD_BASE, first, first + size)


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix_hash(_TABLE[data], BYTE_BASE)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
