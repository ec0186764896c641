"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a segment of bytes from both ends, labels every position from both states, and a document's
probabilities pool those of all its positions. Segments are the words of the text, closed by a space and cut at SEGMENT
bytes, A-Z folded, each read from a fresh state; equal segments have equal outputs, so a task computes each distinct one once and
counts it as often as it occurs. Every byte of every text takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from undertow.llm.text import Words, slices

#: Bytes of a segment at most.
SEGMENT = 24
#: Documents of each language that are read for training at most, and segments of each.
TRAIN_DOCS, TRAIN_SEGMENTS = 300, 6000
HIDDEN, EMBED = 8, 8
#: Distinct segments whose outputs a task keeps before it starts anew.
CACHE = 400_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class BiGru:
    """Two gated recurrent layers over byte embeddings, one for each direction, and a softmax over both states."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"E": rng.normal(0, 0.3, (256, EMBED)), "V": scale(2 * HIDDEN, classes), "c": np.zeros(classes)}
        for d in ("f", "b"):
            self.p |= {f"W{d}": scale(EMBED, 3 * HIDDEN), f"U{d}": scale(HIDDEN, 3 * HIDDEN), f"k{d}": np.zeros(3 * HIDDEN)}

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        """States (n, t, HIDDEN) of one direction; masked steps keep the state."""
        p, kind = self.p, self.p["E"].dtype
        h = np.zeros((len(x), HIDDEN), kind)
        table = p["E"] @ p[f"W{d}"] + p[f"k{d}"]
        out = np.zeros((*x.shape, HIDDEN), kind)
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        u_gate, u_new = p[f"U{d}"][:, : 2 * HIDDEN], p[f"U{d}"][:, 2 * HIDDEN :]
        for t in steps:
            a = table[x[:, t]]
            gate = _sigmoid(a[:, : 2 * HIDDEN] + h @ u_gate)
            z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
            new = np.tanh(a[:, 2 * HIDDEN :] + (r * h) @ u_new)
            m = mask[:, t : t + 1]
            if tape is not None:
                tape.append((t, h, z, r, new, m))
            h = h + m * (1 - z) * (new - h)
            out[:, t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self._pass(x, mask, d, tapes[i] if tapes else None) for i, d in enumerate("fb")], axis=2)
        logits = both @ self.p["V"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=2, keepdims=True), both

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, by backpropagation through time."""
        p, tapes = self.p, ([], [])
        prob, both = self.forward(x, mask, tapes)
        d_logit = prob.copy()
        d_logit[np.arange(len(x)), :, y] -= 1
        d_logit *= (mask / mask.sum())[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["V"] = np.tensordot(both, d_logit, ((0, 1), (0, 1)))
        g["c"] = d_logit.sum((0, 1))
        d_both = d_logit @ p["V"].T
        for i, d in enumerate("fb"):
            u, w = p[f"U{d}"], p[f"W{d}"]
            carry = np.zeros((len(x), HIDDEN))
            d_input = np.zeros((256, 3 * HIDDEN))
            for t, h, z, r, new, m in reversed(tapes[i]):
                dh = d_both[:, t, i * HIDDEN : (i + 1) * HIDDEN] * m + carry
                d_new = dh * m * (1 - z) * (1 - new**2)
                d_z = dh * m * (h - new) * z * (1 - z)
                d_rh = d_new @ u[:, 2 * HIDDEN :].T
                d_r = d_rh * h * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r], 1)
                g[f"U{d}"][:, : 2 * HIDDEN] += h.T @ d_gate
                g[f"U{d}"][:, 2 * HIDDEN :] += (r * h).T @ d_new
                np.add.at(d_input, x[:, t], np.concatenate([d_gate, d_new], 1))
                carry = dh * (1 - m * (1 - z)) + d_rh * r + d_gate @ u[:, : 2 * HIDDEN].T
            g[f"k{d}"] = d_input.sum(0)
            g[f"W{d}"] = p["E"].T @ d_input
            g["E"] += d_input @ w.T
        return g

    def fit(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.01) -> None:
        rng = np.random.default_rng(11)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                step += 1
                for k, g in self.gradients(x[some], mask[some], y[some]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def single(self) -> BiGru:
        """The same network in single precision, for labelling."""
        out = BiGru(len(self.p["c"]))
        out.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return out

    def pooled(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Sum over positions of the probabilities of each class, for each segment."""
        prob, _ = self.forward(x, mask)
        return (prob * mask[:, :, None]).sum(1)


def _pad(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments as rows, each with the space that closes it."""
    width = max(map(len, parts)) + 1
    x = np.frombuffer(b"".join(p.ljust(width) for p in parts), np.uint8).reshape(len(parts), width)
    length = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    return x, (np.arange(width) < length[:, None]).astype(np.float32)


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z: the case of a text says nothing about its language."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the segments of a run of texts: its words, long ones cut."""
    words = Words(data, at)
    pieces = np.maximum(1, -(-(words.end - words.start) // SEGMENT))
    which = np.repeat(np.arange(len(pieces)), pieces)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = words.start[which] + turn * SEGMENT
    return words.row[which], start, np.minimum(start + SEGMENT, words.end[which])


class Labeller:
    """Pooled probabilities of texts, with the outputs of the segments met so far."""

    def __init__(self, net: BiGru, languages: list[str]):
        self.net, self.languages = net, languages
        self.known: dict[bytes, int] = {}
        self.outputs = np.zeros((0, len(languages)))

    def _look(self, parts: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
            self.outputs = self.outputs[:0]
        new = [p for p in dict.fromkeys(parts) if p not in known]
        if new:
            new.sort(key=len)
            found = []
            for a in range(0, len(new), 4096):
                x, mask = _pad(new[a : a + 4096])
                found.append(self.net.pooled(x, mask))
            for p in new:
                known[p] = len(known)
            self.outputs = np.concatenate([self.outputs, *found]).astype(float)
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def label(self, column: pa.Array) -> Iterator[tuple[str, float]]:
        for a, b, data, at in slices(column):
            raw = data.tobytes()
            row, start, end = segments(data, at)
            low = folded(data).tobytes()
            total = np.zeros((b - a, len(self.languages)))
            if len(row):
                spot = self._look([low[x:y] for x, y in zip(start.tolist(), end.tolist())])
                for k in range(total.shape[1]):
                    total[:, k] = np.bincount(row, self.outputs[spot, k], b - a)
            for r in range(b - a):
                text = raw[at[r] : at[r + 1]]
                if not any(map(str.isalpha, text.decode("utf-8", "replace"))):
                    yield "und", 0.0
                else:
                    share = total[r] / total[r].sum()
                    yield self.languages[int(share.argmax())], float(min(1.0, share.max()))


#: The labeller of a worker process, which serves its tasks one after another.
_kept: dict[bytes, Labeller] = {}


def _labeller(net: BiGru, languages: list[str]) -> Labeller:
    key = b"".join(net.p[k].tobytes() for k in sorted(net.p))
    if key not in _kept:
        _kept.clear()
        _kept[key] = Labeller(net, languages)
    return _kept[key]


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, seed: int = 5) -> tuple[BiGru, list[str]]:
    """The network learnt from documents that are not held out: of each language a seeded sample, bounded by TRAIN_*."""
    train = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), "text", F.xxhash64("doc_id", F.lit(seed)).alias("draw"))
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return BiGru(1), ["und"]
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, 1.5 * TRAIN_DOCS / counts[k]))])
    draw = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    # some 1.5 * TRAIN_DOCS rows of a language pass
    rows = train.filter(draw < share[F.col("lang")]).orderBy("draw").limit(2 * TRAIN_DOCS * len(languages)).collect()
    x, y = [], []
    for k, lang in enumerate(languages):
        parts: list[bytes] = []
        for r in rows:
            if r["lang"] == lang and len(parts) < TRAIN_SEGMENTS:
                raw = folded(np.frombuffer(r["text"].encode(), np.uint8))
                _, start, end = segments(raw, np.array([0, len(raw)]))
                some = np.unique(np.linspace(0, len(start) - 1, 100).astype(int)) if len(start) else []
                parts += [raw[start[i] : end[i]].tobytes() for i in some]
        parts = parts[:TRAIN_SEGMENTS]
        x += parts
        y += [k] * len(parts)
    net = BiGru(len(languages))
    if x and len(languages) > 1:
        padded, mask = _pad([*x, b"-" * SEGMENT])
        net.fit(padded[:-1], mask[:-1], np.array(y))
    return net, languages


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """docs with `lang_pred` and `score`, the pooled share of the predicted language.

    Learnt from `learn_from` (docs by default): rows with text and lang whose crc32(doc_id) % 5 is not 0. A null text or
    one without letters gives `und` with score 0. Columns of these two names are replaced; others stay. Rows repeat as
    given. Without any labelled row every text with letters is `und` as well. Empty in, empty out.
    """
    net, languages = fit(learn_from if learn_from is not None else docs)
    net = net.single()
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        labeller = _labeller(net, languages)
        for batch in batches:
            found = list(labeller.label(batch.column(at)))
            names, scores = zip(*found) if found else ([], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"]
            )

    return docs.mapInArrow(run, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    from_rows = docs.select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), from_rows).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
