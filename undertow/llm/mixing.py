"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.session import cut_lineage

#: Bins of the seeded order of a pattern's documents, and of one bin again.
BINS = 4096


def quotas(sizes: dict[str, int], weights: dict[str, float], total: float, most: float) -> dict[str, float]:
    """`total` shared by weight; a source stops at `most` times its size, the excess goes to the others by weight."""
    out = {k: 0.0 for k in sizes}
    open_, left = {k for k in sizes if sizes[k] > 0 and weights[k] > 0}, total
    while open_ and left > 1e-9:
        unit = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if unit * weights[k] >= most * sizes[k]}
        if not full:
            for k in open_:
                out[k] = unit * weights[k]
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        open_ -= full
    return out


def min_cost_flow(supply: dict[tuple, float], quota: dict[str, float], epochs: int) -> dict[tuple, list[float]]:
    """Words of each pattern to take in its first, second, ... round, so that sources get their quotas at least cost.

    Nodes: patterns, sources, a sink. A pattern has one arc into the network for each round, which costs the number of
    the round (repeats cost more and more) and holds its size; it may feed every source it belongs to. Successive
    shortest paths with potentials; the graph is as large as the number of patterns and sources, not of documents.
    """
    names = ["s", *(("p", p) for p in supply), *(("q", q) for q in quota), "t"]
    number = {n: i for i, n in enumerate(names)}
    arcs: list[list] = []
    out: list[list[int]] = [[] for _ in names]

    def arc(a, b, room, cost):
        out[number[a]].append(len(arcs))
        arcs.append([number[b], room, cost])
        out[number[b]].append(len(arcs))
        arcs.append([number[a], 0.0, -cost])

    rounds: dict[tuple, list[int]] = {}
    for p, size in sorted(supply.items(), key=lambda x: [str(y) for y in x[0]]):
        rounds[p] = []
        for e in range(epochs):
            rounds[p].append(len(arcs))
            arc("s", ("p", p), float(size), float(e))
        for q in p:
            arc(("p", p), ("q", q), float("inf"), 0.0)
    for q, need in quota.items():
        arc(("q", q), "t", float(need), 0.0)
    high = [0.0] * len(names)
    tiny = 1e-6
    while True:
        far = [float("inf")] * len(names)
        via = [-1] * len(names)
        far[0] = 0.0
        heap = [(0.0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for k in out[u]:
                v, room, cost = arcs[k]
                if room > tiny and d + cost + high[u] - high[v] < far[v] - 1e-12:
                    far[v] = d + cost + high[u] - high[v]
                    via[v] = k
                    heapq.heappush(heap, (far[v], v))
        end = number["t"]
        if via[end] < 0:
            break
        high = [h + (d if d < float("inf") else 0.0) for h, d in zip(high, far)]
        path, v = [], end
        while v:
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    return {p: [arcs[k ^ 1][1] for k in ks] for p, ks in rounds.items()}


def mix(docs: DataFrame, size: Column, members: Column, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """docs with size, source_size, target and taken: how many of its words the mix takes of each document.

    `members` is the array of the sources a document belongs to (null among them counts as a source, a null array is one
    of the null source alone). Columns of these four names in the input are replaced, all others stay. Documents are
    counted by membership pattern; sources in code point order, null last, get the weights in turn and share `share`
    times all words, none above `most` times its size. The flow gives each pattern its words per round: full rounds take
    every document, the last one a seeded selection: documents in the order of a hash of (doc_id, seed) while they fit, and
    the one whose size comes nearest to what is then missing. Reruns agree.

    source_size and target are sums over the document's sources. A null or blank text has size 0 and takes 0; rows that
    repeat a doc_id stand at one place of the order and are taken together. Empty in, empty out.
    """
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), F.lit(BINS * BINS))
    key = F.concat_ws("\u0001", F.transform("_of", lambda q: F.coalesce(F.concat(F.lit("="), q), F.lit("-"))))
    # the input's columns travel in one struct, so that none meets a name used here
    mine = ("size", "source_size", "target", "taken")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine])
    of = F.coalesce(members, F.array(F.lit(None).cast("string")))
    tagged = docs.select(row.alias("_row"), "doc_id", size.cast("long").alias("size"), of.alias("_of"), place.alias("_place")).withColumn("_key", key)
    # what the decisions need, read from the texts once
    slim = cut_lineage(tagged.select("doc_id", "size", "_of", "_key", "_place"))
    supply, keys = {}, {}
    for r in slim.groupBy("_key").agg(F.first("_of").alias("_of"), F.sum("size").alias("words")).collect():
        supply[tuple(r["_of"])] = int(r["words"] or 0)
        keys[tuple(r["_of"])] = r["_key"]
    sources = sorted({q for p in supply for q in p}, key=lambda q: (q is None, q or ""))
    sizes = {q: sum(n for p, n in supply.items() if q in p) for q in sources}
    weight = {q: weights[i % len(weights)] for i, q in enumerate(sources)}
    target = quotas(sizes, weight, share * sum(supply.values()), most)
    flow = min_cost_flow(supply, target, int(-(-most // 1)))
    full = {p: sum(1 for x in flow[p] if n and x >= n - 1e-3) for p, n in supply.items()}
    part = {keys[p]: sum(x for x in flow[p] if not (n and x >= n - 1e-3)) for p, n in supply.items()}
    # where the last round's selection ends: a bin of the order, then a place within that bin
    end = _ends(slim.groupBy("_key", F.floor(F.col("_place") / BINS).alias("at")).agg(F.sum("size").alias("words")).collect(), part)
    spark = docs.sparkSession
    first = _small(spark, [(k, at, left) for k, (at, left) in end.items()], "_key string, _bin long, _left double")
    inner = slim.join(F.broadcast(first), "_key").filter(F.floor(F.col("_place") / BINS) == F.col("_bin"))
    stop = _ends(inner.groupBy("_key", F.pmod("_place", F.lit(BINS)).alias("at")).agg(F.sum("size").alias("words")).collect(), {k: left for k, (_, left) in end.items()})
    border = {k: at * BINS + stop.get(k, (0, 0.0))[0] for k, (at, _) in end.items()}
    gap = {k: stop.get(k, (0, left))[1] for k, (_, left) in end.items()}
    # of the documents after the end, the one whose size comes nearest to what is missing closes the gap
    second = _small(spark, [(k, border[k], gap[k]) for k in border], "_key string, _border long, _gap double")
    after = slim.join(F.broadcast(second), "_key").filter("_place >= _border AND size > 0 AND doc_id IS NOT NULL AND abs(size - _gap) < _gap")
    closing = {r["_key"]: r["c"]["doc_id"] for r in after.groupBy("_key").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_gap")).alias("d"), "doc_id")).alias("c")).collect()}
    # a row per pattern: as few as the flow's own nodes
    rows = [(keys[p], full[p], border[keys[p]], closing.get(keys[p]), sum(sizes[q] for q in p), float(sum(target[q] for q in p))) for p in supply]
    plan = _small(spark, rows, "_key string, _full int, _border long, _closing long, source_size long, target double")
    out = tagged.join(F.broadcast(plan), "_key")
    inside = (F.col("_place") < F.col("_border")) | F.coalesce(F.col("doc_id") == F.col("_closing"), F.lit(False))
    taken = F.col("size") * (F.col("_full") + F.when(inside, 1).otherwise(0))
    return out.select("_row.*", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _ends(rows: list, amount: dict[str, float]) -> dict[str, tuple[int, float]]:
    """For each pattern the first bin that would exceed its amount, and what is left of the amount before it."""
    words: dict[str, dict[int, int]] = {}
    for r in rows:
        words.setdefault(r["_key"], {})[int(r["at"])] = int(r["words"] or 0)
    out = {}
    for k, per in words.items():
        left, at = float(amount[k]), 0
        while at < BINS and per.get(at, 0) <= left:
            left -= per.get(at, 0)
            at += 1
        out[k] = (at, left)
    return out


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
