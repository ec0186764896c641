"""Fingerprints against a slow version that looks at every window of every whole text."""

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from undertow.llm import fingerprint as fp
from undertow.llm.text import BYTE_BASE, byte_prefix, span_hash

COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _level(window: bytes) -> int:
    sums = sum(round(c * math.log2(c) * (1 << 20)) for c in Counter(window).values())
    return 1000 - sums * 1000 // round(32 * 5 * (1 << 20))


def _brute_features(raw: bytes, rank) -> list[int]:
    """Hashes of the features in order, equal ones once."""
    if not raw:
        return []
    if len(raw) < 32:
        places = [0]
    else:
        ranks = [rank[_level(raw[i : i + 32])] for i in range(len(raw) - 31)]
        wins = Counter()
        for at in range(-63, len(ranks)):
            inside = range(max(0, at), min(len(ranks), at + 64))
            wins[min(inside, key=lambda i: (ranks[i], i))] += 1
        places = sorted(i for i, n in wins.items() if n >= 16)
    prefix = byte_prefix(np.frombuffer(raw, np.uint8))
    hashes = span_hash(prefix, BYTE_BASE, np.array(places), np.minimum(np.array(places) + 32, len(raw)))
    return list(dict.fromkeys(int(h) for h in hashes))


def _brute_print(raw: bytes, rank) -> str:
    hashes = _brute_features(raw, rank)
    out = b""
    for at in range(0, len(hashes), 160):
        bits = [0] * 2048
        for h in hashes[at : at + 160]:
            for k in range(5):
                bits[(h >> (11 * k)) & 2047] = 1
        out += bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, 2048, 8))
    return f"{len(hashes)}:{base64.b64encode(out).decode()}"


def _brute_ranks(texts):
    counts = Counter()
    for raw in (t.encode() for t in texts):
        starts = {*range(0, len(raw) - 31, 32), len(raw) - 32} if len(raw) >= 32 else ()
        counts.update(_level(raw[i : i + 32]) for i in starts)
    order = sorted(range(1001), key=lambda k: (counts[k], -k))
    return {level: r for r, level in enumerate(order)}


def brute(rows):
    texts = [t or "" for _, t in rows]
    rank = _brute_ranks(texts)
    out = []
    for k, text in enumerate(texts):
        quarter = len(text) // 4
        after = texts[(k + 1) % len(texts)]
        made = text[: len(text) - quarter] + after[:quarter]
        out.append((rows[k][0], len(text), hashlib.sha256(made.encode()).hexdigest(), _brute_print(text.encode(), rank), _brute_print(made.encode(), rank)))
    return out


def _prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghiklmnoprstu éñ"), rng.integers(2, 9))) for _ in range(n))


def _documents():
    rng = np.random.default_rng(6)
    rows = [(10 * k, _prose(rng, int(n))) for k, n in enumerate([3, 400, 40, 1, 90, 25, 260, 12, 600, 7, 70, 30])]
    rows += [(11, None), (21, ""), (22, "x"), (23, "ab" * 300), (24, "a" * 900), (25, "é" * 31), (301, rows[1][1]), (302, rows[1][1] + " and a tail"), (303, "\x00" * 40 + "日本語" * 30)]
    return sorted(rows)


def _run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        df = df.selectExpr("*", "1 AS part", "true AS opens", "'x' AS fingerprint", "2 AS n_chars", "3 AS _t", "4 AS _at")
    out = fp.fingerprints(df).collect()
    return sorted(((r["doc_id"], *[r[c] for c in COLUMNS]) for r in out), key=lambda r: (r[0] is not None, r))


def test_fingerprints_equal_the_slow_version(spark):
    rows = _documents()
    got, want = _run(spark, rows), brute(rows)
    assert [g[:5] for g in got] == want
    by_id = {g[0]: g for g in got}
    assert by_id[10][3] == by_id[301][3]  # equal texts
    assert all(0 <= g[5] <= 1 and 0 <= g[6] <= 1 for g in got)
    assert _run(spark, rows, extra=True) == got


def test_likeness_follows_the_shared_part(spark):
    rng = np.random.default_rng(1)
    rows = [(k, _prose(rng, int(n))) for k, n in enumerate(rng.integers(60, 3000, 40))]
    got = _run(spark, rows)
    assert min(g[5] for g in got) > 0.5 and max(g[6] for g in got) < 0.2
    assert abs(np.mean([g[5] for g in got]) - 0.75) < 0.08


def test_repeated_rows_null_ids_single_and_empty_tables(spark):
    text = _prose(np.random.default_rng(3), 50)
    got = _run(spark, [(5, text)] * 7 + [(None, "nobody"), (None, None)])
    assert len(got) == 9 and [g[0] for g in got[:2]] == [None, None]
    assert sum(g[6] == 1.0 for g in got) == 6  # all but the last are followed by themselves
    (one,) = _run(spark, [(1, text)])
    assert one[6] == 1.0 and one[2] == hashlib.sha256((text[: len(text) - len(text) // 4] + text[: len(text) // 4]).encode()).hexdigest()
    assert _run(spark, []) == []


def test_long_texts_are_read_in_slices(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [_prose(rng, n) for n in (2000, 30, 900, 1)]
    ranks = fp.rarity(rng.integers(0, 50, 1001))
    whole = fp.Reader(ranks).add(list(range(4)), texts)
    for size in (700, 64, 1):
        monkeypatch.setattr(fp, "SLICE_BYTES", size)
        assert fp.Reader(ranks).add(list(range(4)), texts) == whole


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 95, 500])
def test_edited_features_equal_those_of_the_edited_text(n):
    rng = np.random.default_rng(n)
    ranks = fp.rarity(rng.integers(0, 50, 1001))
    for after in (0, 5, 60, 300, 3000):
        texts = [_prose(rng, 200)[:n] + _prose(rng, n), _prose(rng, 800)[:after]]
        raws = [t.encode() for t in texts]
        made, chains = fp.edited(texts, raws, fp.text_features(raws, ranks), ranks)
        assert chains[0].tolist() == fp.text_features([made[0].encode()], ranks)[0][1].tolist()


def _every_level(texts):
    return Counter(_level(raw[i : i + 32]) for raw in texts for i in range(len(raw) - 31))


@pytest.mark.parametrize("size", [1 << 20, 700, 32, 1])
def test_every_window_is_counted_once(monkeypatch, size):
    texts = [(t or "").encode() for _, t in _documents()]
    monkeypatch.setattr(fp, "SLICE_BYTES", size)
    counts = fp.level_counts(texts)
    assert {k: int(n) for k, n in enumerate(counts) if n} == _every_level(texts)
    assert not fp.level_counts([]).any()


def test_the_query_ranks_by_every_window(spark, tmp_path):
    from undertow.llm.queries import QUERIES

    rows = _documents()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["fingerprint"] for r in QUERIES["op11_improbable_features"](spark, str(tmp_path)).collect()}
    texts = [(t or "").encode() for _, t in rows]
    counts = _every_level(texts)
    rank = {level: r for r, level in enumerate(sorted(range(1001), key=lambda k: (counts[k], -k)))}
    want = {doc_id: _brute_print(raw, rank) for (doc_id, _), raw in zip(rows, texts)}
    ends = _brute_ranks([t or "" for _, t in rows])
    assert got == want
    assert got != {doc_id: _brute_print(raw, ends) for (doc_id, _), raw in zip(rows, texts)}
