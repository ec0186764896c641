"""The filter audit against a brute-force count over every order."""

import itertools
import re
from collections import Counter

from undertow.llm.filter_audit import filter_audit

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _fails(doc_id, text, smallest):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if doc_id is not None and doc_id > smallest.get(text, doc_id):
        out.add("E")
    return out


def brute(docs, labels):
    smallest = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failed = [(s or "", _fails(d, t, smallest), d in good, d in toxic) for d, t, s in docs]
    out = {}
    for part in {f[0] for f in failed}:
        rows = [f for f in failed if f[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                lost = [f for f in rows if letter in f[1] and not f[1] & before]
                shapley[letter] += len(lost)
                out[part, order, step] = [
                    sum(not f[1] & (before | {letter}) for f in rows), len(lost), sum(letter in f[1] and bool(f[1] & before) for f in rows),
                    sum(f[1] == {letter} for f in rows), sum(f[2] for f in lost), sum(f[3] for f in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _run(spark, docs, labels, extra=False):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    if extra:  # columns named like those of the result and of the steps
        d = d.selectExpr("*", "1 AS part", "2 AS mask", "'x' AS kept", "3 AS n", "4 AS step", "5 AS cell")
        lab = lab.selectExpr("*", "'y' AS text", "7 AS good")
    rows = filter_audit(d, lab).collect()
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in rows}, len(rows)


def _corpus():
    plain = " ".join(f"w{i}" for i in range(220))
    return [
        (1, plain, "a"), (2, plain, "a"), (3, plain, "b"), (3, plain, "b"), (1, plain, "a"), (4, "x " * 300, "b"), (5, None, "a"), (6, "", None),
        (7, plain + " Ünïcode 　 $", None), (8, "ABC " * 250, "a"), (9, " \t\n", ""), (10, "a|b" + plain * 200, "c"), (None, plain, "a"), (None, plain, None),
        (None, "solo", "a"), (0, "tail " + plain, "c"), (11, "É" * 100 + "AB", "c"), (12, "É" * 99 + "AB", "c"),
    ] + [(100 + i, "same text", "hot") for i in range(60)]


LABELS = [(1, 1, 0), (2, None, 1), (2, 1, None), (3, 0, 1), (4, 1, 1), (999, 1, 1), (None, 1, 1), (100, 1, 0), (101, 1, 1), (8, 1, 1), (8, 1, 1)]


def test_audit_equals_brute_force(spark):
    docs = _corpus()
    want = brute(docs, LABELS)
    got, n = _run(spark, docs, LABELS)
    assert n == len(got) == 600 * 5
    assert got == want
    assert _run(spark, docs, LABELS, extra=True)[0] == want


def test_empty_tables(spark):
    assert _run(spark, [], LABELS)[1] == 0
    got, _ = _run(spark, _corpus(), [])
    assert got == brute(_corpus(), [])
