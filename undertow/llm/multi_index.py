"""Near-duplicate embeddings by an inverted multi-index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.graph import components
from undertow.llm.tables import Tables
from undertow.session import broadcast_if_small

#: Vectors that the codebooks are fitted on at most, vectors a cell should hold on average, codewords of a half at most.
FIT_ROWS, CELL, CODES = 16384, 1024, 256
#: Members of one block of a cell.
BLOCK = 2048
#: Vectors drawn to measure the recall against all rows, the share of their links that the traversal must reach, and steps of the measured scale.
QUERIES, RECALL, STEPS = 2048, 0.999, 4096


def codebook(x: np.ndarray, k: int, seed: int = 3, steps: int = 25) -> np.ndarray:
    """k-means centres of the rows of x."""
    rng = np.random.default_rng(seed)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(steps):
        near = distances(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1))


def bounds(d: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance at least from each row to each codeword's region: that to the farthest bisector in between."""
    gap = np.sqrt(distances(centres, centres)) + np.eye(len(centres))
    out = np.zeros_like(d)
    for j in range(len(centres)):
        # a vector of region i lies on i's side of the bisector of i and j
        out = np.maximum(out, (d - d[:, j : j + 1]) / (2 * gap[:, j]) * (np.arange(len(centres)) != j))
    return np.maximum(out, 0) ** 2


def traverse(low_a: np.ndarray, low_b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b): cells in the order of a multi-sequence, by rising sum of both halves' bounds, up to limit."""
    order_a, order_b = np.argsort(low_a, 1, kind="stable"), np.argsort(low_b, 1, kind="stable")
    total = np.take_along_axis(low_a, order_a, 1)[:, :, None] + np.take_along_axis(low_b, order_b, 1)[:, None, :]
    row, i, j = np.nonzero(total <= limit)
    by = np.lexsort((total[row, i, j], row))
    row, i, j = row[by], i[by], j[by]
    return row, order_a[row, i], order_b[row, j]


def _good() -> Column:
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return x / np.sqrt((x**2).sum(1))[:, None]


def _local(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest id connected to each link (a[i], b[i]) by these links."""
    ids, place = np.unique(np.r_[a, b], return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    low = np.arange(len(ids))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == low).all():
            return ids[low[x]]
        low = new


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of one label with this cosine or more are linked.

    Equal vectors of a label form a class that stands in the index once. Each half has its codebook, fitted on a seeded
    sample of FIT_ROWS vectors at most; a cell is a pair of codewords, and codewords grow with the root of the rows, so
    that a cell holds CELL vectors on average (up to CODES codewords a half). A vector visits cells by rising lower bound
    of the distance, each pair of cells from one side. How far is measured: QUERIES vectors drawn by hash are compared
    with all rows, and the traversal ends at the bound within which RECALL of their links lie (all of them where there
    are under 1 / (1 - RECALL)). A table of QUERIES classes or fewer is therefore measured whole. Links outside the bound are missed, so
    the result has a recall near RECALL, not of 1; no link below the threshold is made. Cells of more than BLOCK members
    are dealt out to several tasks, visitors stream past them. Cosines are computed in double precision.

    Null labels, and vectors that are null, zero, empty or hold null or non-finite components, link with nothing, nor
    do vectors of different width. A null vec_id stays alone with a null component. Rows that repeat a vec_id count as
    one vector if they are equal; different vectors under one vec_id are one vertex of the components, and where that id
    is the smallest of their classes their links are added. Other columns are ignored. Empty in, empty out.
    """
    # single precision travels as it is; wider numbers as doubles
    kept = vectors.schema["embedding"].dataType.simpleString()
    kind = kept if kept == "array<float>" else "array<double>"
    tables = Tables(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    rows = rows.withColumn("good", _good())
    digest = F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")
    good = rows.filter("good").select("vec_id", "label", F.size("embedding").alias("width"), "embedding", digest[0].alias("d0"), digest[1].alias("d1"))
    classes = good.groupBy("label", "width", "d0", "d1").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("embedding").alias("embedding"))
    classes = tables.write(classes, "classes")
    reach = 2 - 2 * cosine + 1e-9
    found = None
    for width, n in sorted(map(tuple, classes.groupBy("width").count().collect())):
        part = classes.filter(F.col("width") == width).select("label", "rep", "copies", "embedding")
        sample = _drawn(part, n, FIT_ROWS, 9)
        x = _matrix(sample.column("embedding").combine_chunks()) if len(sample) else np.ones((1, width))
        half = width // 2
        codes = int(np.clip(np.ceil(np.sqrt(n / CELL)), 1, CODES))
        books = codebook(x[:, :half], codes), codebook(x[:, half:], codes)
        limit = _measured(part, n, books, half, reach, cosine)
        links = _cell_links(part, books, half, limit, cosine, kind)
        found = links if found is None else found.union(links)
    if found is None:
        found = classes.select(F.col("rep").alias("id"), F.lit(0).cast("long").alias("links"), F.col("rep").alias("low"))
    found = tables.write(found.groupBy("id", "low").agg(F.sum("links").alias("links")), "found")
    groups = components(found, "id", "low", tables=tables).withColumnRenamed("id", "rep")
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.select("label", "width", "d0", "d1", "rep", "copies").join(groups, "rep", "left").join(counts, "rep", "left")
    named = named.select("label", "width", "d0", "d1", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    key = rows.select(
        "vec_id", F.when(F.col("good"), F.col("label")).alias("label"), F.size("embedding").alias("width"), digest[0].alias("d0"), digest[1].alias("d1")
    )
    out = key.join(named, ["label", "width", "d0", "d1"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _drawn(part: DataFrame, n: int, most: int, seed: int) -> pa.Table:
    """`most` of the n rows at most, drawn by a hash of rep."""
    draw = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return part.filter(draw < min(1.0, 1.1 * most / n)).orderBy(draw, "rep").limit(most).select("label", "rep", "embedding").toArrow()


def _codes(x: np.ndarray, books, half: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distances to both codebooks, and the own cell of each row."""
    d = [distances(h, b) for h, b in zip((x[:, :half], x[:, half:]), books)]
    return d, d[0].argmin(1) * len(books[1]) + d[1].argmin(1)


def _measured(part: DataFrame, n: int, books, half: int, reach: float, cosine: float) -> float:
    """The bound within which RECALL of the links of QUERIES drawn vectors lie, seen from the side that visits."""
    drawn = _drawn(part, n, QUERIES, 11)
    if not len(drawn):
        return 0.0
    names = drawn.column("label").to_numpy()
    ids, q = drawn.column("rep").to_numpy(), _matrix(drawn.column("embedding").combine_chunks())
    d, cell = _codes(q, books, half)
    low_q = bounds(d[0], books[0]), bounds(d[1], books[1])
    codes = len(books[1])

    def count(batches):
        total = np.zeros(STEPS + 2, dtype=np.int64)
        for batch in batches:
            labels, rep = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            if not len(rep):
                continue
            x = _matrix(batch.column(2))
            for label in np.unique(labels):
                ours, theirs = np.flatnonzero(names == label), np.flatnonzero(labels == label)
                for a in range(0, len(theirs), 1024):
                    some = theirs[a : a + 1024]
                    i, j = np.nonzero((q[ours] @ x[some].T >= cosine) & (ids[ours][:, None] != rep[some]))
                    if not len(i):
                        continue
                    i = ours[i]
                    hit, place = np.unique(some[j], return_inverse=True)
                    e, own = _codes(x[hit], books, half)
                    low_x = bounds(e[0], books[0]), bounds(e[1], books[1])
                    # a vector visits the cells after its own, so the one of the smaller cell must reach the other's
                    there = cell[i] <= own[place]
                    of_q = low_q[0][i, own[place] // codes] + low_q[1][i, own[place] % codes]
                    of_x = low_x[0][place, cell[i] // codes] + low_x[1][place, cell[i] % codes]
                    need = np.where(cell[i] == own[place], 0, np.where(there, of_q, of_x))
                    total += np.bincount(np.ceil(np.minimum(need / reach, 1) * STEPS).astype(int), minlength=STEPS + 2)
        step = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(step, pa.int64()), pa.array(total[step], pa.int64())], ["step", "links"])

    seen = part.select("label", "rep", "embedding").mapInArrow(count, "step long, links long").groupBy("step").agg(F.sum("links").alias("links"))
    steps = sorted(map(tuple, seen.collect()))
    allowed, missed = (1 - RECALL) * sum(c for _, c in steps), 0
    for step, links in reversed(steps):
        missed += links
        if missed > allowed:
            return step / STEPS * reach * (1 + 1e-9)
    return 0.0


def _cell_links(part: DataFrame, books, half: int, limit: float, cosine: float, kind: str) -> DataFrame:
    """(id, links, low): linked vectors of each representative, and an id it is connected with, per block."""
    codes = len(books[1])

    def home(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_codes(_matrix(batch.column(1)), books, half)[1])], ["label", "cell"])

    def visit(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                piece = batch.slice(a, 1024)
                d, own = _codes(_matrix(piece.column(3)), books, half)
                row, i, j = traverse(bounds(d[0], books[0]), bounds(d[1], books[1]), limit)
                cell = i * codes + j
                # the own cell always, whatever rounding says of its bound
                once = cell > own[row]
                row, cell = np.r_[np.arange(len(own)), row[once]], np.r_[own, cell[once]]
                by = np.argsort(row, kind="stable")
                row, cell = row[by], cell[by]
                yield pa.RecordBatch.from_arrays([*piece.take(pa.array(row)).columns, pa.array(cell), pa.array(own[row] == cell)], ["label", "rep", "copies", "embedding", "cell", "own"])

    # cells without a member of the label are visited in vain and fall out here
    sizes = part.select("label", "embedding").mapInArrow(home, "label string, cell long").groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    visits = part.mapInArrow(visit, f"label string, rep long, copies long, embedding {kind}, cell long, own boolean")
    dealt = visits.join(broadcast_if_small(sizes), ["label", "cell"])
    home_block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    # a member of a cell is held in its block, and passes by all blocks as a visitor; in a cell of one block it needs no second row
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), (F.col("own") & (b == home_block)).alias("held")))
    dealt = dealt.withColumn("at", F.explode(every))
    group = F.xxhash64("label", "cell", "at.block")
    rows = dealt.select(group.alias("group"), F.when(F.col("at.held"), 0).otherwise(1).alias("role"), "rep", "copies", "own", "embedding")
    rows = rows.repartition("group").sortWithinPartitions("group", "role", "rep")

    def compare(batches):
        held: dict = {"group": None, "x": [], "id": [], "copies": []}
        for batch in batches:
            group = batch.column(0).to_numpy()
            for a in np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else ():
                b = int(np.searchsorted(group, group[a], "right"))
                piece = batch.slice(int(a), b - int(a))
                role = piece.column(1).to_numpy()
                if held["group"] != group[a]:
                    held = {"group": group[a], "x": [], "id": [], "copies": []}
                cut = int(np.searchsorted(role, 1))
                x, rep, copies = _matrix(piece.column(5)), piece.column(2).to_numpy(), piece.column(3).to_numpy()
                own = piece.column(4).to_numpy(zero_copy_only=False)
                if cut:
                    held["x"].append(x[:cut]), held["id"].append(rep[:cut]), held["copies"].append(copies[:cut])
                if not held["x"]:
                    continue
                home, ids, many = (np.concatenate(held[k]) for k in ("x", "id", "copies"))
                for c in range(0, len(rep), 1024):
                    near = x[c : c + 1024] @ home.T >= cosine
                    # each pair once: a member of the block with those before it, one of another block with those after it
                    who, ours, inside = rep[c : c + 1024, None], own[c : c + 1024, None], (role[c : c + 1024] == 0)[:, None]
                    near &= np.where(inside, who > ids, ~ours | (who < ids))
                    v, m = np.nonzero(near)
                    if not len(v):
                        continue
                    v += c
                    low = _local(rep[v], ids[m])
                    # a row for each vector, not for each link
                    who, first, place = np.unique(np.r_[rep[v], ids[m]], return_index=True, return_inverse=True)
                    links = np.bincount(place, np.r_[many[m], copies[v]]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(links), pa.array(np.r_[low, low][first])], ["id", "links", "low"])

    return rows.mapInArrow(compare, "id long, links long, low long").groupBy("id", "low").agg(F.sum("links").alias("links"))
