"""Different texts without a doc_id, or with the same one, keep what is theirs."""

import hashlib

import numpy as np

from undertow.llm.line_dedup import dedup_lines
from undertow.llm.suffix_dedup import repeated_bytes
from undertow.llm.tree_dedup import repeated_words

SCHEMA = "doc_id long, text string"


def test_lines_of_null_ids(spark):
    rows = [(None, "q\nz"), (None, "z\nq"), (None, "x\ny"), (None, "x\ny"), (7, "own line\nz"), (7, "other text\nsome line")]
    got = [(r["doc_id"], r["text"]) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got.count((None, "x\ny")) == 2 and (7, "own line") in got and (7, "other text\nsome line") in got
    left = [line for i, t in got for line in t.split("\n") if line]
    assert left.count("q") == left.count("z") == 1


def test_spans_of_null_ids(spark):
    rng = np.random.default_rng(15)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(n))
    shared = prose(40)
    rows = [(1, shared)]
    own = {}
    for i in (5, 5, 9, 9):
        a, b = prose(60), prose(60)
        own[f"{a} {shared} {b}"] = (i - 5 or None, a, b)
        rows.append((i - 5 or None, f"{a} {shared} {b}"))
    alone = [prose(200), prose(200)]
    rows += [(None, alone[0]), (4, alone[1]), (None, alone[0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for got in (repeated_bytes(frame).collect(), repeated_words(frame).collect()):
        kept = [r["kept_sha256"] for r in got]
        assert kept.count(sha(alone[0])) == 2 and sha(alone[1]) in kept
        assert sum(r["n_removed"] > 0 for r in got) == 4
    words = [r["kept_sha256"] for r in repeated_words(frame).collect()]
    # of the documents without an id the first keeps the passage, the others and the later ids keep their own words
    cut = sum(sha(f"{a} {b}") in words for _, a, b in own.values())
    assert cut == 3


def test_zero_bytes_are_text(spark):
    """A text that joins the end of one with the start of another by a zero byte repeats neither."""
    rng = np.random.default_rng(21)
    a, b = ("".join(rng.choice(list("abcdefgh"), 400)) for _ in range(2))
    rows = [(1, a), (2, b), (3, a[-60:] + "\0" + b[:60]), (4, "x" * 5 + "\0" * 150), (5, a[:150] + "\0" + a[-60:] + "\0" + b[:60])]
    seen, want = set(), {}
    for k, text in rows:
        gone, windows = np.zeros(len(text), bool), [text[i : i + 100] for i in range(len(text) - 99)]
        for i, window in enumerate(windows):
            gone[i : i + 100] |= window in seen
            seen.add(window)
        want[k] = int(gone.sum())
    got = {r["doc_id"]: r["n_removed"] for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_mix_of_null_members_and_clashing_names(spark):
    """A null array is of the null source; the input's own size, target and inner names neither double nor vanish."""
    from pyspark.sql import functions as F

    from undertow.llm.mixing import mix

    rows = [(1, ["a"], 10, 7, "k"), (2, None, 20, 8, "l"), (None, [None], 30, 9, "m"), (3, ["a", "b"], 5, 1, None), (3, ["a", "b"], 5, 1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, of array<string>, n long, target long, _key string")
    out = mix(frame, F.col("n"), F.col("of"), [3.0, 1.0, 2.0])
    assert out.columns == ["doc_id", "of", "n", "_key", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, out.select("n", "_key", "source_size", "taken").collect()), key=str)
    assert [(n, k) for n, k, *_ in got] == [(10, "k"), (20, "l"), (30, "m"), (5, None), (5, None)]
    assert all(0 <= t <= 2 * n for n, _, _, t in got)
    assert {s for n, _, s, _ in got if n in (20, 30)} == {50}
    assert mix(frame.limit(0), F.col("n"), F.col("of"), [3.0]).count() == 0
