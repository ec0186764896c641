"""Distributed union-find over a table of links, and links within buckets of any size without all their pairs.

Joins are asked to be sort-merge joins: adaptive execution splits their skewed sides, and the many small steps build no
relation on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.tables import Tables

#: Up to this many members a bucket is compared pairwise at once; larger ones against one pivot a round.
PAIRWISE = 32
#: Rows of links or vertices, two numbers each, that one task writes at least.
TASK_ROWS = 20_000


def _gathered(df: DataFrame, rows: int) -> DataFrame:
    """df in no more tasks than `rows` are worth, the rows that it reads at most; small steps would else be mostly empty tasks."""
    return df.coalesce(max(1, math.ceil(rows / TASK_ROWS)))


def components(links: DataFrame, a: str = "a", b: str = "b", tables: Tables | None = None, rows: int | None = None) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has a link to another.

    Each round every vertex follows its neighbour of the smallest hash, if that is smaller than its own, for two steps;
    the links move along, and a link between two vertices survives as one between their images. Hashes are a random
    order, so steps to a local minimum are few even on a path of rising ids, and vertices at least halve. Empty links
    give an empty result; null ends and self-links are ignored; repeated links count once. The result reads the tables
    edges, up and tops of `tables`, so it must be written before they are made anew. `rows`, if known, is the number of
    rows at most that links are made from.
    """
    tables = tables or Tables(links.sparkSession)
    edges = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), (F.col(a) != F.col(b)).alias("two"))
    edges = edges.filter("two").select("lo", "hi").distinct()
    edges = tables.write(edges if rows is None else _gathered(edges, rows), "edges")
    found: DataFrame | None = None
    held = 0
    while n := edges.count():
        ends = edges.select(F.col("hi").alias("id"), F.col("lo").alias("to")).union(edges.select(F.col("lo").alias("id"), F.col("hi").alias("to")))
        best = ends.groupBy("id").agg(F.min(F.struct(F.xxhash64("to").alias("h"), F.col("to"))).alias("n"))
        up = best.select("id", F.least(F.col("n"), F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("to")))["to"].alias("to"))
        again = up.select(F.col("id").alias("to"), F.col("to").alias("top"))
        up = tables.write(_gathered(up.join(again.hint("merge"), "to").select("id", F.col("top").alias("to")), 2 * n), "up")
        low, high = up.select(F.col("id").alias("lo"), F.col("to").alias("l")), up.select(F.col("id").alias("hi"), F.col("to").alias("h"))
        moved = edges.join(low.hint("merge"), "lo").join(high.hint("merge"), "hi").select(F.least("l", "h").alias("lo"), F.greatest("l", "h").alias("hi"))
        edges = tables.write(_gathered(moved.filter("lo < hi").distinct(), n), "edges")
        if found is None:
            held = 2 * n
            found = tables.write(up, "tops")
        else:
            step = up.select(F.col("id").alias("to"), F.col("to").alias("top"))
            found = tables.write(_gathered(found.join(step.hint("merge"), "to", "left").select("id", F.coalesce("top", "to").alias("to")), held), "tops")
    if found is None:
        return edges.select(F.col("lo").alias("id"), F.col("hi").alias("component"))
    least = found.groupBy("to").agg(F.min("id").alias("component"))
    return found.join(least.hint("merge"), "to").select("id", "component")


def joined(found: DataFrame, links: DataFrame, tables: Tables, rows: int) -> DataFrame:
    """The components `found` after more links, which are followed between components only; both have `rows` rows at most."""
    ends = {x: found.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")) for x in ("a", "b")}
    coarse = links.join(ends["a"].hint("merge"), "a", "left").join(ends["b"].hint("merge"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    tops = components(coarse, tables=tables, rows=rows).withColumnRenamed("component", "top")
    known = found.join(tops.withColumnRenamed("id", "component").hint("merge"), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return known.union(tops.join(found, "id", "left_anti").select("id", F.col("top").alias("component")))


def within(x: str, y: str, words: int, percent: int) -> Column:
    """Whether two sets may have 100 * intersection >= percent * union, by their tags: n, the size, and w0, w1, ..., words of
    64 parities of the values that fall on each place. A place that differs takes a value of one set alone, so a pair that is
    ruled out is not linked."""
    x, y = F.col(x), F.col(y)
    apart = F.lit(0)
    for k in range(words):
        apart = apart + F.bit_count(x[f"w{k}"].bitwiseXOR(y[f"w{k}"]))
    alike = 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])
    # what two linked sets do not share is (100 - percent) / (100 + percent) of their sizes at most
    return alike & ((100 + percent) * apart <= (100 - percent) * (x["n"] + y["n"]))


def linked_components(
    members: DataFrame,
    near: Callable[[DataFrame], DataFrame],
    likely: Callable[[str, str], Column] | None = None,
    prepare: Callable[[DataFrame], None] | None = None,
    tags: DataFrame | None = None,
    finer: Callable[[DataFrame], DataFrame] | None = None,
    closer: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """(id, component) of the links that `near` confirms between members of one bucket; a missing id is on its own.

    `members` has a row (key, node, tag) per bucket and member; wide tags come apart, as `tags` (node, tag), and meet only
    members that share a bucket. For the members of large buckets `finer` (given nodes) makes other tags, which `closer`
    reads as `likely` does its own. Pairs whose tags `likely` (given the names of two tag columns) rules out are left. `prepare` gets the nodes (node) that may be compared, before any is. `near` gets distinct
    pairs (a, b), a < b, and returns the linked ones.
    First each node is compared with one other, the smallest it may be paired with in any bucket, which joins most of a
    group of copies at the cost of its size. After that only members that are not yet known to be connected are compared:
    small buckets at once, a larger bucket with some drawn pivots; each round draws 64 times as many, until every member is
    one. So no link between components is lost, and rounds grow with the logarithm of a bucket.
    """
    tables = Tables(members.sparkSession)
    if tags is None and "tag" not in members.columns:
        members = members.withColumn("tag", F.lit(0).cast("byte"))
    fits = likely("tag", "tag_b") if likely else F.lit(True)
    # dealt by bucket once, for the sizes and for the members
    members = members.repartition("key")
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("p")).filter("size > 1")
    shared = members.join(sizes.hint("merge"), "key")
    members = tables.write(shared if tags is None else shared.join(tags.hint("merge"), "node"), "members")
    small = members.filter(F.col("size") <= PAIRWISE).select("key", F.col("node").alias("a"), "tag")
    pairs = small.join(small.withColumnsRenamed({"a": "b", "tag": "tag_b"}).hint("merge"), "key").filter("a < b").filter(fits).select("a", "b").distinct()
    pairs = tables.write(pairs, "pairs")
    large = members.filter(F.col("size") > PAIRWISE)
    led = large.join(large.filter("node = p").select("key", F.col("tag").alias("tag_b")).dropDuplicates(["key"]).hint("merge"), "key")
    if prepare:
        prepare(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct())
    ahead = pairs.union(led.filter("p < node").filter(fits).select("p", "node")).groupBy("b").agg(F.min("a").alias("a"))
    links = tables.write(near(ahead.select("a", "b")).select("a", "b"), "links")
    n = held = links.count()
    found = tables.write(_gathered(components(links, tables=tables, rows=n), 2 * n), "found")
    ends = {x: found.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")).hint("merge") for x in ("a", "b")}
    apart = pairs.join(ends["a"], "a", "left").join(ends["b"], "b", "left").filter("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
    links = tables.write(near(apart).select("a", "b"), "links")
    if n := links.count():
        held += n
        found = tables.write(_gathered(joined(found, links, tables, n + 2 * held), 2 * held), "found")
    tables.drop("pairs")
    # one row per node, so that a component is looked up once and not once per bucket
    nodes = large.select("node", "tag").dropDuplicates(["node"])
    nodes = tables.write(finer(nodes.select("node")) if finer else nodes, "nodes")
    fits = closer("tag", "tag_b") if closer else fits
    done, count = 1, PAIRWISE
    while True:
        known = found.select(F.col("id").alias("node"), "component")
        named = tables.write(nodes.join(known.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
        rest = large.filter(F.col("size") > done).select("key", "node", "size").join(named.hint("merge"), "node")
        parts = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
        draw = (F.xxhash64("node", F.lit(count)).bitwiseAND(F.lit((1 << 20) - 1))) / float(1 << 20)
        # count >= size takes every member
        opened = tables.write(rest.join(parts.hint("merge"), "key").withColumn("pivot", draw * F.col("size") < count), "opened")
        if opened.isEmpty():
            break
        pivots = opened.filter("pivot").select("key", F.col("node").alias("p"), F.col("component").alias("pc"), F.col("tag").alias("tag_b"))
        pairs = opened.join(pivots.hint("merge"), "key").filter("component <> pc").filter(fits).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        links = tables.write(near(pairs).select("a", "b"), "links")
        if n := links.count():
            held += n
            found = tables.write(_gathered(joined(found, links, tables, n + 2 * held), 2 * held), "found")
        done, count = count, count * 64
    tables.drop("members", "nodes", "named", "opened", "links", "edges", "up", "tops")
    return found
