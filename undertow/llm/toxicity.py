"""Toxicity by a learnt lexicon that Levenshtein automata match within one edit, weighed by the words around a match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.text import PUNCTUATION, Words, slices

#: Labelled rows that are learnt from at most (a seeded sample beyond it), and terms of the lexicon at most.
TRAIN_ROWS, TERMS = 12_000, 300
#: Bytes from which a term is matched with one edit; words on each side that make the context.
FUZZY_FROM, CONTEXT = 5, 6
FEATURES = 8


class Automaton:
    """The determinised union of the Levenshtein automata of all terms, intersected with the trie of the lexicon.

    A state is a set of (trie node, edits so far); reading a byte follows the matching child, and with an edit left any
    child (substitution), the same node (insertion) or a grandchild (deletion). Only terms of FUZZY_FROM bytes or more
    allow an edit. Words then run through one table, all at once.
    """

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.width = max(map(len, raw), default=0) + 1
        kinds = sorted({b for t in raw for b in t})
        self.kind = np.zeros(256, np.int64)
        for i, b in enumerate(kinds):
            self.kind[b] = i + 1
        # two tries: all terms, and those that allow an edit
        nodes: list[dict[int, int]] = [{}, {}]
        final: list[int] = [-1, -1]
        for k, t in enumerate(raw):
            for root in (0, 1) if len(t) >= FUZZY_FROM else (0,):
                at = root
                for b in t:
                    if b not in nodes[at]:
                        nodes[at][b] = len(nodes)
                        nodes.append({})
                        final.append(-1)
                    at = nodes[at][b]
                final[at] = k
        loose = {1}
        for at in range(len(nodes)):
            if at in loose:
                loose.update(nodes[at].values())

        def closed(states: set[tuple[int, int]]) -> frozenset:
            # a missing byte of the word: go to a child without reading
            more = {(c, 1) for n, e in states if e == 0 and n in loose for c in nodes[n].values()}
            return frozenset(states | more)

        start = closed({(0, 0), (1, 0)})
        number, table, out = {start: 1, frozenset(): 0}, [[0] * (len(kinds) + 1)], [(-1, 0)]
        work = [start]
        while work:
            states = work.pop(0)
            exact = [final[n] for n, e in states if e == 0 and final[n] >= 0]
            near = [final[n] for n, e in states if e == 1 and final[n] >= 0]
            out.append((min(exact), 0) if exact else (min(near), 1) if near else (-1, 0))
            row = []
            spread = {(n, 1) for n, e in states if e == 0 and n in loose} | {(c, 1) for n, e in states if e == 0 and n in loose for c in nodes[n].values()}
            for b in [None, *kinds]:
                nxt = {(nodes[n][b], e) for n, e in states if b in nodes[n]} if b is not None else set()
                key = closed(nxt | spread)
                if key not in number:
                    number[key] = len(number)
                    work.append(key)
                row.append(number[key])
            table.append(row)
        self.table = np.array(table, np.int32).ravel()
        self.symbols = len(kinds) + 1
        self.term = np.array([t for t, _ in out])
        self.edits = np.array([e for _, e in out])

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the words, term, edits) of the words that match."""
        live = np.flatnonzero(end - start <= self.width)
        state = np.ones(len(live), np.int32)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for t in range(self.width + 1):
            over = end[live] - start[live] == t
            if over.any():
                done.append((live[over], state[over]))
                live, state = live[~over], state[~over]
            if not len(live):
                break
            state = self.table[state.astype(np.int64) * self.symbols + self.kind[data[start[live] + t]]]
            alive = state > 0
            live, state = live[alive], state[alive]
        if not done:
            return (np.zeros(0, np.int64),) * 3
        place, state = (np.concatenate(x) for x in zip(*done))
        hit = self.term[state] >= 0
        place, state = place[hit], state[hit]
        order = np.argsort(place)
        return place[order], self.term[state[order]], self.edits[state[order]]


def _quotes(data: np.ndarray) -> np.ndarray:
    """Where quotation marks end: the plain one, and the paired ones of UTF-8."""
    out = data == 0x22
    out[2:] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & ((data[2:] == 0x9C) | (data[2:] == 0x9D) | (data[2:] == 0x9E))
    out[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))
    return out


class Scorer:
    def __init__(self, terms: list[str], weights: list[float]):
        self.automaton = Automaton(terms)
        self.weights = np.array(weights, float)

    def features(self, column: pa.Array) -> Iterator[np.ndarray]:
        """A block of rows of FEATURES numbers for each run of texts."""
        for a, b, data, at in slices(column):
            n = b - a
            words = Words(data, at, fold=True, breaks=PUNCTUATION)
            low = np.where((data >= 65) & (data <= 90), data | 32, data)
            place, term, edits = self.automaton.run(low, words.start, words.end)
            x = np.zeros((n, FEATURES))
            if len(place):
                row = words.row[place]
                first = np.maximum(place - CONTEXT, words.bounds[row])
                last = np.minimum(place + CONTEXT, words.bounds[row + 1] - 1)
                marks = np.r_[0, np.cumsum(_quotes(data))]
                # quoted: a mark on either side within the context
                left = marks[words.start[place]] - marks[np.maximum(words.start[first] - 3, at[row])]
                right = marks[np.minimum(words.end[last] + 3, at[row + 1])] - marks[words.end[place]]
                quoted = (left > 0) & (right > 0)
                hits = np.r_[0, np.cumsum(np.bincount(place, minlength=len(words.start)))]
                company = hits[last + 1] - hits[first] - 1
                exact, w = edits == 0, self.weights[term]
                add = lambda v: np.bincount(row, v, n)
                x[:, 0] = np.log1p(add(w * (exact & ~quoted)))
                x[:, 1] = np.log1p(add(w * (exact & quoted)))
                x[:, 2] = np.log1p(add(w * ~exact))
                x[:, 3] = np.log1p(add(company > 0))
                top = np.zeros(n)
                np.maximum.at(top, row[exact], w[exact])
                x[:, 4] = top
                kinds = np.unique(np.stack([row[exact], term[exact]], 1), axis=0)[:, 0] if exact.any() else np.zeros(0, int)
                x[:, 5] = np.log1p(np.bincount(kinds, minlength=n))
                x[:, 6] = add(w * exact) / np.log1p(np.maximum(1, np.diff(words.bounds)))
            x[:, 7] = np.log1p(np.diff(words.bounds)) / 10
            yield x


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the last one constant, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(x) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Scorer, np.ndarray]:
    """Lexicon and weights from labelled documents that are not held out, at most some TRAIN_ROWS of them."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    n = marked.count()
    share = min(1.0, TRAIN_ROWS / max(1, n))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    some = marked.filter(draw < share)
    # a bounded number of ids
    train = docs.filter(F.col("text").isNotNull()).join(F.broadcast(some), "doc_id").select("text", F.col("toxic").cast("double").alias("toxic"))
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "))
    counted = train.select("toxic", F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    base = train.agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")).first()
    bad, fine = float(base["bad"] or 0), float((base["all"] or 0) - (base["bad"] or 0))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (fine + 1))
    terms = (
        counted.withColumn("odds", odds)
        .filter((F.col("bad") >= max(3.0, 0.01 * bad)) & (F.col("odds") > 1.5) & (F.octet_length("word") <= 40))
        .orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "word")
        .limit(TERMS)
        .collect()
    )
    scorer = Scorer([r["word"] for r in terms], [r["odds"] for r in terms])

    def run(batches):
        for batch in batches:
            blocks = list(scorer.features(batch.column(0)))
            x = np.concatenate(blocks) if blocks else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    rows = train.mapInArrow(run, "x array<double>, toxic double").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), FEATURES)
    y = np.array([r["toxic"] for r in rows], float)
    return scorer, logistic(x, y) if len(rows) else np.zeros(FEATURES + 1)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Lexicon and weights are learnt from labels whose crc32(doc_id) % 5 is not 0 and used on text alone. Words are runs of
    letters, digits and non-ASCII characters; an edit is one byte. Null, empty and wordless texts get the score of a
    text without terms and words. Rows repeat as given; without labels every score is 0.5. Empty in, empty out.
    """
    scorer, weights = fit(docs, labels)

    def run(batches):
        for batch in batches:
            blocks = list(scorer.features(batch.column(1)))
            x = np.concatenate(blocks) if blocks else np.zeros((0, FEATURES))
            score = 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
