"""Hypervectors of +1/-1 derived from hashes: the same values in Catalyst, NumPy and SQL.

Element i of the vector for a key is +1 when hex digit i % 32 of md5('seed|key|block'), block = i div 32,
is below 8. Nothing depends on generator state or partitioning, so no codebook has to be shipped.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


# --------------------------------------------------------------------------- NumPy twins for kernels


def base_vector(key: str, width: int, seed: int = SEED) -> np.ndarray:
    blocks = math.ceil(width / 32)
    text = "".join(hashlib.md5(f"{seed}|{key}|{b}".encode()).hexdigest() for b in range(blocks))
    digits = np.frombuffer(text.encode(), dtype=np.uint8)[:width]
    return np.where(digits < ord("8"), 1, -1).astype(np.int8)


def base_bits(keys: list[str], width: int, seed: int = SEED) -> np.ndarray:
    """Packed base vectors of many keys, as pack_bits gives them: a hex digit is 8 or more where its first bit is set."""
    blocks = math.ceil(width / 32)
    tails = [f"|{b}".encode() for b in range(blocks)]
    parts = []
    for key in keys:
        head = hashlib.md5(f"{seed}|{key}".encode())
        for tail in tails:
            h = head.copy()
            h.update(tail)
            parts.append(h.digest())
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(len(keys), blocks * 16)
    bits = np.empty((len(keys), blocks * 32), np.uint8)
    bits[:, 0::2], bits[:, 1::2] = raw >> 7, (raw >> 3) & 1
    return np.packbits(bits[:, :width], axis=1)


def level_vectors(width: int, levels: int = 100, seed: int = SEED) -> np.ndarray:
    """Level l is the base vector with its first l * (width div levels) positions flipped."""
    if levels > width:
        raise ValueError("levels must not exceed the vector width")
    stride = width // levels
    flips = np.where(np.arange(width)[None, :] < np.arange(levels)[:, None] * stride, -1, 1).astype(np.int8)
    return flips * base_vector("level", width, seed)


def uniforms(name: str, count: int, seed: int = SEED) -> np.ndarray:
    """Numbers in (0, 1): eight hex digits each, four to a hash."""
    blocks = math.ceil(count / 4)
    text = "".join(hashlib.md5(f"{seed}|{name}|{b}".encode()).hexdigest() for b in range(blocks))
    words = [int(text[8 * i : 8 * i + 8], 16) for i in range(count)]
    return (np.array(words, dtype=np.float64) + 0.5) / 4294967296.0


def gaussians(name: str, count: int, seed: int = SEED) -> np.ndarray:
    u, v = uniforms(name + ":u", count, seed), uniforms(name + ":v", count, seed)
    return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * math.pi * v)


def pack_bits(x: np.ndarray) -> np.ndarray:
    """+1/-1 rows as bits, -1 being 1, most significant bit first."""
    return np.packbits((x < 0).astype(np.uint8), axis=1)


def unpack_bits(bits: np.ndarray, width: int) -> np.ndarray:
    return 1 - 2 * np.unpackbits(bits, axis=1, count=width).view(np.int8)


# --------------------------------------------------------------------------- Catalyst expressions


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_hv(key: Column | str, width: int, seed: int = SEED) -> Column:
    """Hypervector of a key column."""
    key = _col(key)
    text = F.concat(*[F.md5(F.concat(F.lit(f"{seed}|"), key, F.lit(f"|{b}"))) for b in range(math.ceil(width / 32))])
    return F.transform(
        F.sequence(F.lit(1), F.lit(width)), lambda i: F.when(F.substr(text, i, F.lit(1)) < "8", 1).otherwise(-1)
    )


def literal_hv(values: np.ndarray) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def level_hv(level: Column | str, width: int, levels: int = 100, seed: int = SEED) -> Column:
    flipped = _col(level) * (width // levels)
    return F.transform(
        literal_hv(base_vector("level", width, seed)), lambda v, p: F.when(p < flipped, -v).otherwise(v)
    )


def bind(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x * y)


def bundle(*vectors: Column | str) -> Column:
    """Sign of the sum; a tie is +1."""
    total = _col(vectors[0])
    for v in vectors[1:]:
        total = F.zip_with(total, _col(v), lambda x, y: x + y)
    return F.transform(total, lambda x: F.when(x >= 0, 1).otherwise(-1))


def permute(hv: Column | str, k: int) -> Column:
    """Cyclic shift to the right by k."""
    hv = _col(hv)
    n = F.size(hv)
    k_ = F.pmod(F.lit(k), n)
    return F.when(k_ == 0, hv).otherwise(F.concat(F.slice(hv, n - k_ + 1, k_), F.slice(hv, F.lit(1), n - k_)))


def pack_long(hv: Column | str) -> Column:
    """Up to 64 elements as one long, first element in the highest bit used; -1 is a set bit."""
    return F.aggregate(
        _col(hv), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x < 0, 1).otherwise(0).cast("long"))
    )


def unpack_long(bits: Column | str, width: int) -> Column:
    bits = _col(bits)
    return F.transform(
        F.sequence(F.lit(width - 1), F.lit(0)),
        lambda i: F.when(F.call_function("getbit", bits, i) == 0, 1).otherwise(-1),
    )


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two packed longs."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def as_text(hv: Column | str) -> Column:
    """'0' for +1 and '1' for -1, joined; a compact form for reports."""
    return F.array_join(F.transform(_col(hv), lambda x: F.when(x < 0, "1").otherwise("0")), "")
