"""The conversation trie against a brute-force one, at any size of the shards."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from undertow.llm.prefix_trie import DoubleArray, prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in turns.items()}
    members, ended = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        head = abs(c) - abs(c) % 100
        seq = own.get(head if c >= 0 else -head, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
        ended[tuple(seq)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        last = len(node[-1][1]) if node else 0
        saved[node] = (len(members[node]) - 1) * last + sum(saved[k] for k in kids[node])
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, sorted(ended[n]))).encode()).hexdigest())
        for n, m in members.items()
    )


def _run(spark, rows, extra=False, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        df = df.selectExpr("*", "1 AS rep", "2 AS depth", "3 AS a", "4 AS place", "'x' AS ends", "5 AS head", "6 AS k0")
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie(df, **kw).collect())


def _conversations():
    rng = np.random.default_rng(8)
    words = ["hello", "Grüße", "", None, "what", "x" * 5000]
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 215), -7, -100, -150, 5000]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, str(rng.choice(["user", "assistant"])) if t % 3 else None, words[int(rng.integers(0, 2 if t < 3 else 6))]))
    rows += [(700 + k, t, "user", f"same {t}") for k in range(25) for t in range(7)]  # copies
    rows += [(303, 0, "user", "alone"), (None, 0, "user", "nobody"), (0, None, "user", "first"), (0, 3, "user", "again"), (0, 3, "user", "again"), (100, 2, None, None)]
    rows += [(900, t, "user", f"turn {t % 5}") for t in range(200)]  # a long one
    return rows


@pytest.mark.parametrize("shard_turns", [1, 9, 150, 65_536])
def test_trie_equals_brute_force(spark, shard_turns):
    rows = _conversations()
    assert _run(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_turnless_conversations_extra_columns_and_empty_tables(spark):
    # less turns than would be replaced, and nothing to replace them by
    rows = [(c, 0, "user", "only") for c in range(301, 330)]
    got = _run(spark, rows, extra=True, shard_turns=4)
    assert got == brute(rows) and got[0][1] == 0 and got[0][3] == 29
    turnless = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 6 > 0]
    assert _run(spark, turnless) == brute(turnless) and len(brute(turnless)) == 1
    assert _run(spark, []) == []


def test_double_array_holds_every_prefix_once():
    rng = np.random.default_rng(2)
    sequences = [tuple(rng.integers(0, 40, rng.integers(1, 12))) for _ in range(3000)] + [(5,) * 300] + [(k,) for k in range(2000)]
    seq = np.concatenate([[i] * len(s) for i, s in enumerate(sequences)])
    level = np.concatenate([np.arange(len(s)) for s in sequences])
    code = np.concatenate([np.array(s) for s in sequences])
    trie = DoubleArray(seq, level, code)
    named = defaultdict(set)
    node = trie.walk()
    for row in range(len(seq)):
        named[int(node[row])].add(sequences[seq[row]][: level[row] + 1])
    assert all(len(v) == 1 for v in named.values())
    assert len(named) == len({s[: d + 1] for s in sequences for d in range(len(s))}) == (trie.check >= 0).sum() - 1
    assert len(trie.check) < 8 * len(named) + 10_000
