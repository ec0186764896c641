"""Rows of the pipeline's stages against brute force on a small fixture; language_id, a trained network, has its accuracy test."""

import itertools
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, source string, n_chars long"


def _prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n))


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, ["s1", "s2", "s3"][i % 3], len(t)) for i, t in enumerate(texts)], SCHEMA)


def _ids(frame):
    return {r["doc_id"] for r in frame.collect()}


def _lowest(n, linked):
    low = list(range(n))
    for _ in range(n):
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
    return low


def _near(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def test_line_stage(spark):
    rng = np.random.default_rng(20)
    lines = [_prose(rng, 15) for _ in range(6)]
    typo = [f"{t[:40]}#{t[41:]}" for t in lines]
    texts = [f"{lines[0]}\n{lines[1]}", f"{typo[0]}\n{lines[2]}", typo[1], f"{lines[3]}\n\n{lines[3]}\n{typo[2]}", lines[4], lines[5]]
    flat = [(d, line) for d, t in enumerate(texts) for line in t.split("\n")]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for _, t in flat]
    low = _lowest(len(flat), [(a, b) for a, b in itertools.combinations(range(len(flat)), 2) if sets[a] and sets[b] and _near(sets[a], sets[b])])
    kept = ["\n".join(t for k, (d, t) in enumerate(flat) if d == doc and low[k] == k) for doc in range(len(texts))]
    want = {(d, t, len(t)) for d, t in enumerate(kept) if t.strip()}
    got = STAGES["line_dedup"](spark, _frame(spark, texts), "")
    assert len(want) == 5 and {(r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()} == want


def test_near_copy_stage(spark):
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(5):
        words = _prose(rng, 120).split()
        texts.append(" ".join(words))
        for changes in (1, 2, 8):
            other = list(words)
            for j in rng.choice(110, changes, replace=False):
                other[j] = "changed"
            texts.append(" ".join(other))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    low = _lowest(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if _near(sets[a], sets[b])])
    want = {k for k in range(len(texts)) if low[k] == k}
    assert 5 < len(want) < 15 and _ids(STAGES["near_duplicates"](spark, _frame(spark, texts), "")) == want


def test_decontamination_stage(spark, tmp_path):
    rng = np.random.default_rng(22)
    items = [_prose(rng, 30) for _ in range(4)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    part = lambda t, n: " ".join(t.split()[:n])
    texts = [f"{_prose(rng, 9)} {part(items[k % 4], n)} {_prose(rng, 9)}" for k, n in enumerate((3, 10, 17, 18, 25, 30))]

    def covered(item, doc):
        # the fixture's words are unique within an item, so tiles are its runs of four words or more
        item, doc = item.split(), doc.split()
        grams = {tuple(doc[i : i + 4]) for i in range(len(doc))}
        return len({j for i in range(len(item) - 3) if tuple(item[i : i + 4]) in grams for j in range(i, i + 4)}) / len(item)

    want = {d for d, t in enumerate(texts) if all(covered(i, t) < 0.6 for i in items)}
    assert want == {0, 1, 2} and _ids(STAGES["decontamination"](spark, _frame(spark, texts), str(tmp_path))) == want


def test_mixing_stage_takes_effect(spark):
    from undertow.llm.mixing import mix, word_count

    rng = np.random.default_rng(23)
    # sources of one size: the share of the second is less than its words
    frame = _frame(spark, [_prose(rng, 20) for _ in range(90)])
    whole = {r["doc_id"]: r["taken"] for r in mix(frame, word_count(), F.array("source"), [3.0, 1.0, 2.0], share=1.5, most=2.0).collect()}
    got = {r["doc_id"]: r["taken"] for r in STAGES["mixing"](spark, frame, "").collect()}
    assert 0 in whole.values() and got == {i: n for i, n in whole.items() if n > 0}


def test_clashing_names_and_empty_tables(spark, sf):
    """Columns named like an operator's own come back as they were, and an empty table stays one."""
    rng = np.random.default_rng(31)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    one = prose(60)
    rows = [(1, one, "en", "s", 7), (2, prose(50), "en", "s", 8), (3, one, "xx", None, 9), (4, None, None, None, 10), (4, "", "xx", "t", 11), (None, prose(20), "xx", "t", 12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_removed long")
    frame = frame.selectExpr("*", "n_removed AS n_lines", "n_removed AS score", "n_removed AS coverage", "n_removed AS contaminated", "n_removed AS _kept_id", "n_removed AS _rest")
    own = ["n_removed", "n_lines", "score", "coverage", "contaminated", "_kept_id", "_rest"]
    for name, stage in corpus_pipeline.STAGES[1:4]:
        done = stage(spark, frame, sf)
        assert done.columns == frame.columns, name
        # the copy goes, or what is left of it
        want = [7, 8, 10, 11, 12] if name != "decontamination" else [7, 8, 9, 10, 11, 12]
        assert sorted(tuple(r) for r in done.select(*own).collect()) == [(k,) * len(own) for k in want], name
        assert stage(spark, frame.limit(0), sf).count() == 0, name
