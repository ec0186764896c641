"""A trie of conversations: what they share from their first turn on, counted for every shared prefix.

Conversations of equal turns become one sequence with a weight. A node is named by 128 bits that are summed over the turns
before it, so no task holds a whole conversation. Where the turns under a node fit into memory, that prefix is a shard:
its sequences are packed into a double array (BASE and CHECK over dense turn ids) and the nodes come from traversing it.
The nodes above the shards belong to many of them; their counts are merged from the shards' totals by sums along paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.tables import Tables
from undertow.operators.ordered import sliced_order
from undertow.session import broadcast_if_small

#: Turns under a node up to which it is a shard, and turns of whole shards that are packed together.
SHARD_TURNS = 65_536
#: Turns of another conversation that one may start with, and conversations that start alike.
MOST_SHARED, FAMILY = 5, 100
NOTHING = hashlib.sha256(b"").hexdigest()

# --------------------------------------------------------------------------- the double array


class DoubleArray:
    """A trie of integer sequences: the child of node s by code c is BASE[s] + c, if CHECK there is s. Node 0 is the root."""

    def __init__(self, seq: np.ndarray, level: np.ndarray, code: np.ndarray):
        """Rows (sequence, level from 0 on, code); each sequence has its levels without a gap."""
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.check[0] = 0
        self.low = self.end = 1
        order = np.lexsort((seq, level))
        cuts = np.searchsorted(level[order], np.arange(int(level.max()) + 2)) if len(level) else np.zeros(1, np.int64)
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        self.seq, self.code = seq, code
        width = int(code.max()) + 1 if len(code) else 1
        state = np.zeros(int(seq.max()) + 1 if len(seq) else 0, np.int64)
        for rows in self.levels:
            key, place = np.unique(state[seq[rows]] * width + code[rows], return_inverse=True)
            parent, kid = key // width, key % width
            self._put(parent, kid)
            state[seq[rows]] = (self.base[parent] + kid)[place]

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots."""
        self._grow(self.end + n)
        while self.low < len(self.check) and self.check[self.low] >= 0:
            self.low += 1
        at, size = self.low, 4 * n + 64
        while True:
            slots = at + np.flatnonzero(self.check[at : at + size] < 0)
            if len(slots) >= n or at + size >= len(self.check):
                return slots[:n]
            size *= 2

    def _take(self, slots: np.ndarray, parent: np.ndarray | int) -> None:
        self.check[slots] = parent
        self.end = max(self.end, int(slots.max()) + 1)

    def _put(self, parent: np.ndarray, kid: np.ndarray) -> None:
        """Place the children of one level, sorted by parent: large families first, only children last."""
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(parent)])
        for f in first[size > 1][np.argsort(-size[size > 1], kind="stable")]:
            kids = kid[f : f + int(size[first.searchsorted(f)])]
            base = self._fit(kids)
            self.base[parent[f]] = base
            self._take(base + kids, parent[f])
        alone = first[size == 1]
        if len(alone):
            slots = self._free(len(alone))
            self.base[parent[alone]] = slots - kid[alone]
            self._take(slots, parent[alone])

    def _fit(self, kids: np.ndarray) -> int:
        """A base at which all these codes are free: among the first free slots, else behind everything."""
        span = int(kids[-1] - kids[0])
        tries = max(1, (1 << 16) // len(kids))
        slots = self._free(tries)
        self._grow(int(slots[-1]) + span + 1)
        free = (self.check[slots[:, None] + (kids - kids[0])[None, :]] < 0).all(1)
        at = int(slots[free.argmax()]) if free.any() else self.end
        self._grow(at + span + 1)
        return at - int(kids[0])

    def walk(self) -> np.ndarray:
        """The node of each row, from following BASE and verifying CHECK."""
        state = np.zeros(int(self.seq.max()) + 1 if len(self.seq) else 0, np.int64)
        node = np.zeros(len(self.seq), np.int64)
        for rows in self.levels:
            at = state[self.seq[rows]]
            to = self.base[at] + self.code[rows]
            if (self.check[to] != at).any():
                raise ValueError("a packed sequence is not in its trie")
            state[self.seq[rows]] = node[rows] = to
        return node


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Ids 0, 1, ... of the distinct rows of these columns."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _shard_nodes(rows: pa.Table) -> pa.RecordBatch:
    """Nodes of whole shards: rows (s0, s1, top, rep, depth, a, b, chars, copies, ends) sorted by shard, rep and depth."""
    s0, s1, top, rep, depth, a, b, chars, copies = (rows.column(i).to_numpy() for i in range(9))
    shard = np.cumsum(np.r_[False, (s0[1:] != s0[:-1]) | (s1[1:] != s1[:-1])])
    seq = np.cumsum(np.r_[False, (rep[1:] != rep[:-1]) | (shard[1:] != shard[:-1])])
    level = depth - top
    turn = _dense(a, b)
    code = np.where(level == 0, turn.max() + 1 + shard, turn)
    trie = DoubleArray(seq, level, code)
    node = trie.walk()
    slots, place = np.unique(node, return_inverse=True)
    conv, n_convs = np.full(len(slots), np.iinfo(np.int64).max), np.zeros(len(slots), np.int64)
    np.minimum.at(conv, place, rep)
    np.add.at(n_convs, place, copies)
    one = np.empty(len(slots), np.int64)
    one[place] = np.arange(len(node))
    up = trie.check[slots]
    inside = level[one] > 0
    parent = np.searchsorted(slots, up)
    children = np.bincount(parent[inside], minlength=len(slots))
    leaves, saved = (children == 0).astype(np.int64), (n_convs - 1) * chars[one]
    for k in range(len(trie.levels) - 1, 0, -1):
        own = np.unique(place[trie.levels[k]])
        np.add.at(leaves, parent[own], leaves[own])
        np.add.at(saved, parent[own], saved[own])
    ended = rows.column(9)
    at = np.flatnonzero(ended.is_valid().to_numpy(zero_copy_only=False))
    end_at = np.full(len(slots), -1)
    end_at[place[at]] = at
    ends = ended.combine_chunks().take(pa.array(end_at, mask=end_at < 0))
    over = pa.array(np.where(inside, conv[np.where(inside, parent, 0)], 0), mask=~inside)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv), pa.array(depth[one]), over, *map(pa.array, (n_convs, children, leaves, saved)), ends], names=_NODE
    )


_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
_NODE_SCHEMA = ", ".join(f"{c} long" for c in _NODE[:-1]) + ", ends string"


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole shards, of some SHARD_TURNS rows."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= SHARD_TURNS:
            rows = pa.Table.from_batches(held)
            s0, s1 = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            cut = int(np.flatnonzero(np.r_[True, (s0[1:] != s0[:-1]) | (s1[1:] != s1[:-1])])[-1])
            if cut:
                yield rows.slice(0, cut)
                held, n = rows.slice(cut).to_batches(), len(rows) - cut
    if held:
        yield pa.Table.from_batches(held)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_shards(batches):
        yield _shard_nodes(rows)


# --------------------------------------------------------------------------- conversations

_ROWS = "array<struct<depth:bigint,a:bigint,b:bigint,chars:bigint>>"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, chars): turns numbered from 1 on, a and b naming role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(F.lit(0), role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.length(text).cast("long").alias("chars"),
    )
    return sliced_order(rows, "conv_id", ["turn", "role", "a", "b"], row_number="place").select("conv_id", "place", "a", "b", "chars")


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, chars) of every rebuilt conversation, with a row of depth 0 that every one of them has.

    The rows that go into others are MOST_SHARED of one conversation in FAMILY, gathered into one row each.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED + 1)).cast("int")
    part = [F.col(c) for c in ("a", "b", "chars")]
    heads = turns.filter(f"conv_id % {FAMILY} = 0 AND place <= {MOST_SHARED}").groupBy(F.col("conv_id").alias("head"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("place", *part))).alias("first"))
    own = turns.withColumns({"h": h, "head": F.col("conv_id") - F.col("conv_id") % FAMILY})
    own = own.join(heads.hint("merge"), "head", "left")
    none = F.array().cast(_ROWS)
    copied = F.coalesce(F.slice("first", F.lit(1), F.col("h")).cast(_ROWS), none)
    zero = F.lit(0).cast("long")
    start = F.concat(F.array(F.struct(zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("chars"))), copied)
    moved = (F.size(copied) + F.col("place") - F.col("h")).cast("long")
    rows = F.concat(
        F.when(F.col("place") == 1, start).otherwise(none),
        F.when(F.col("place") > F.col("h"), F.array(F.struct(moved.alias("depth"), *part))).otherwise(none),
    )
    return own.select("conv_id", F.inline(rows))


def _pieces() -> dict[str, Column]:
    """Two hashes of a turn at its depth, as halves whose sums stay in range: summed over a prefix they name it."""
    out = {}
    for k in (2, 3):
        x = F.xxhash64(F.lit(k), "depth", "a", "b")
        out |= {f"p{k}h": F.shiftrightunsigned(x, 32), f"p{k}l": x.bitwiseAND(F.lit((1 << 32) - 1))}
    return out


def _named(*names: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), *names).alias(f"k{k}") for k in (0, 1)]


def _sequences(turns: DataFrame) -> DataFrame:
    """(rep, copies, length, ends): conversations of equal turns under the smallest of their ids.

    ends is the SHA-256 of their ids. The rows of one sequence are read in order as they come from the sort; a hash over
    a list is taken in its order, so one task reads a sequence's ids, eight bytes each, and holds none of them.
    """
    pieces = _pieces()
    convs = turns.groupBy("conv_id").agg(F.max("depth").alias("length"), *[F.sum(c).alias(n) for n, c in pieces.items()])
    convs = convs.select("conv_id", "length", *_named("length", *pieces))
    rows = convs.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "conv_id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = None, None
        for batch in batches:
            conv, length, k0, k1 = (batch.column(i).to_numpy() for i in range(4))
            if not len(conv):
                continue
            first = np.flatnonzero(np.r_[True, (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])])
            done = []
            for i, j in zip(first, np.r_[first[1:], len(conv)]):
                text = ",".join(map(str, conv[i:j].tolist())).encode()
                if key == (k0[i], k1[i]):
                    open_[1] += int(j - i)
                    open_[3].update(b"," + text)
                    continue
                if open_:
                    done.append(open_)
                key, open_ = (k0[i], k1[i]), [int(conv[i]), int(j - i), int(length[i]), hashlib.sha256(text)]
            yield _closed(done)
        if open_:
            yield _closed([open_])

    return rows.mapInArrow(gather, "rep long, copies long, length long, ends string")


def _closed(groups: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    columns = [[g[0] for g in groups], [g[1] for g in groups], [g[2] for g in groups], [g[3].hexdigest() for g in groups]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["rep", "copies", "length", "ends"])


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node.

    Turns are ordered by turn (null first), then role, then a digest of the text, which settles ties; rows that repeat a
    turn are turns each. Null role or text is empty. Rows without conv_id belong to no conversation. conv_id % 100 is
    SQL's, so it has the sign of conv_id. Other columns are not read. Without any conversation there is no root: empty
    in, empty out.
    """
    tables = Tables(conversations.sparkSession)
    turns = tables.write(rebuilt_turns(numbered_turns(conversations)), "turns")
    reps = tables.write(_sequences(turns), "sequences")
    last = F.when(F.col("depth") == F.col("length"), F.col("ends"))
    own = turns.withColumnRenamed("conv_id", "rep").join(reps.hint("merge"), "rep").withColumn("ends", last)
    own = tables.write(own, "own")
    tables.drop("turns", "sequences")
    pieces = _pieces()
    paths = sliced_order(own, "rep", ["depth"], sums={f"s_{n}": c for n, c in pieces.items()})
    paths = paths.select("rep", "copies", "length", "depth", "a", "b", "chars", "ends", *_named("depth", *[f"s_{n}" for n in pieces]))
    paths = tables.write(paths, "paths")
    tables.drop("own")
    node = ["depth", "k0", "k1"]
    under = paths.groupBy(*node).agg(F.sum(F.col("length") - F.col("depth") + 1).alias("turns"))
    large = tables.write(under.filter((F.col("depth") == 0) | (F.col("turns") > shard_turns)).select(*node, F.lit(True).alias("large")), "large")
    marked = paths.join(broadcast_if_small(large), node, "left")
    marked = tables.write(marked.withColumn("large", F.col("large").isNotNull()), "marked")
    tables.drop("paths", "large")

    # the shards
    below = marked.filter("NOT large")
    tops = below.groupBy("rep").agg(F.min(F.struct("depth", "k0", "k1")).alias("t"))
    tops = tops.select("rep", F.col("t.depth").alias("top"), F.col("t.k0").alias("s0"), F.col("t.k1").alias("s1"))
    rows = below.join(tops.hint("merge"), "rep").select("s0", "s1", "top", "rep", "depth", "a", "b", "chars", "copies", "ends")
    packed = rows.repartition("s0", "s1").sortWithinPartitions("s0", "s1", "rep", "depth").mapInArrow(_pack, _NODE_SCHEMA)
    packed = tables.write(packed, "packed")

    # the nodes above them
    above = marked.filter("large").select("rep", "copies", "depth", "chars", "ends", "k0", "k1")
    shared = above.groupBy(*node).agg(F.min("rep").alias("conv_id"), F.sum("copies").alias("n_convs"), F.max("chars").alias("chars"), F.max("ends").alias("ends"))
    shared = tables.write(shared, "shared")
    path = above.select("rep", *node).join(broadcast_if_small(shared.select(*node, "conv_id", "n_convs", "chars")), node)
    own_saved = F.when(F.col("rep") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)
    path = tables.write(path.select("rep", "depth", "conv_id", own_saved.alias("saved")), "path")
    hung = packed.filter("parent_conv_id IS NULL").select(F.col("conv_id").alias("rep"), "depth", "n_leaves", "saved_tokens")
    worth = path.select("rep", "depth", "conv_id", "saved", F.lit(0).cast("long").alias("leaves")).union(
        hung.select("rep", "depth", F.lit(None).cast("long"), "saved_tokens", "n_leaves")
    )
    worth = tables.write(worth.withColumn("back", -F.col("depth")), "worth")
    summed = sliced_order(worth, "rep", ["back"], sums={"all_saved": F.col("saved"), "all_leaves": F.col("leaves")})
    totals = summed.filter("conv_id IS NOT NULL").groupBy("conv_id", "depth").agg(F.sum("all_saved").alias("saved_tokens"), F.sum("all_leaves").alias("n_leaves"))
    # a node's parent is the node before it on the path of its smallest member
    children = hung.select(F.col("rep").alias("child"), "depth").union(shared.filter("depth > 0").select(F.col("conv_id").alias("child"), "depth"))
    over = path.select(F.col("rep").alias("child"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("over"))
    linked = tables.write(children.join(over.hint("merge"), ["child", "depth"]), "linked")
    counts = linked.groupBy(F.col("over").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    linked = linked.withColumnRenamed("child", "conv_id")
    top = shared.select("conv_id", "depth", "n_convs", "ends").join(totals, ["conv_id", "depth"]).join(counts, ["conv_id", "depth"], "left").join(linked, ["conv_id", "depth"], "left")
    n_children = F.coalesce("n_children", F.lit(0))
    top = top.select("conv_id", "depth", F.col("over").alias("parent_conv_id"), "n_convs", n_children.alias("n_children"), F.when(n_children == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"), "saved_tokens", "ends")
    hanging = packed.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(linked.hint("merge"), ["conv_id", "depth"])
    hanging = hanging.select(*[F.col("over" if c == "parent_conv_id" else c).alias(c) for c in _NODE])
    out = packed.filter("parent_conv_id IS NOT NULL").union(hanging).union(top.select(*_NODE))
    return out.select(*[F.col(c).cast("long").alias(c) for c in _NODE[:-1]], F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


SQL = r"""
WITH RECURSIVE crc_table(i, k, v) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(0, 256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END FROM crc_table WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS entries FROM crc_table WHERE k = 8),
numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]),
             lambda x, y: xor(x // 256, entries[CAST(xor(x % 256, y) AS INTEGER) + 1])), CAST(4294967295 AS BIGINT)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM numbered), crc),
built AS (
  SELECT c.conv_id, n.place, 0 AS half, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.head AND n.place <= c.h
  UNION ALL
  SELECT c.conv_id, n.place, 1 AS half, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.place > c.h),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY half, place) AS depth, sha256(length(role) || ':' || role || text) AS turn, length(text) AS chars FROM built),
sequences AS (SELECT conv_id, list(turn ORDER BY depth) AS seq, list(chars ORDER BY depth) AS chars FROM turns GROUP BY conv_id),
whole AS (SELECT c.conv_id, coalesce(seq, []) AS seq, coalesce(chars, []) AS chars FROM convs c LEFT JOIN sequences s ON s.conv_id = c.conv_id),
prefixes AS (
  SELECT conv_id, d AS depth, sha256(array_to_string(list_slice(seq, 1, d), ',')) AS node,
         CASE WHEN d > 0 THEN sha256(array_to_string(list_slice(seq, 1, d - 1), ',')) END AS over, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, d = len(seq) AS ended
  FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM whole)),
nodes AS (
  SELECT node, depth, over, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth, over),
kids AS (SELECT n.node, n.depth, count(k.node) AS n_children FROM nodes n LEFT JOIN nodes k ON k.over = n.node AND k.depth = n.depth + 1 GROUP BY n.node, n.depth),
paths(node, depth, top, top_depth) AS (
  SELECT node, depth, node, depth FROM nodes
  UNION ALL
  SELECT p.node, p.depth, n.over, p.top_depth - 1 FROM paths p JOIN nodes n ON n.node = p.top AND n.depth = p.top_depth WHERE p.top_depth > 0),
summed AS (
  SELECT top AS node, top_depth AS depth, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (k.n_children = 0) AS n_leaves
  FROM paths p JOIN nodes n ON n.node = p.node AND n.depth = p.depth JOIN kids k ON k.node = p.node AND k.depth = p.depth GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN kids k ON k.node = n.node AND k.depth = n.depth JOIN summed s ON s.node = n.node AND s.depth = n.depth
LEFT JOIN nodes o ON o.node = n.over AND o.depth = n.depth - 1
"""
