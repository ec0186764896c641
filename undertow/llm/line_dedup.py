"""Fuzzy line deduplication by MinHash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.graph import linked_components, within
from undertow.llm.spans import NO_ID
from undertow.llm.tables import Tables
from undertow.session import broadcast_if_small

#: Characters of a shingle; rows of a band and bands: a pair of similarity 0.8 shares a band with chance 0.9988, one of 0.3
#: with chance 0.04 and one of 0.1, as unlike lines of a language may be, with chance 0.0002, so buckets hold like lines.
SHINGLE, ROWS, BANDS = 5, 5, 17
#: What turns a band's hash into that of each of its rows: the minimum of h ^ c is the hash that is nearest to a random point.
TURNS = (0x00000000, 0x5A3C96E1, 0x2F81D37B, -0x4D1A6F33, -0x1B7E2A55)
#: Shingles that one row carries, so that a row of the aggregation serves several.
STEP = 2
#: Hashes of a tag, four bits of each, 16 to a number; a candidate agrees in AGREE of them: at 0.8 with chance 0.9998, were
#: they independent (those of one band depend on one another a little), at 0.5 with chance 0.02.
TAGGED, AGREE = 80, 52
#: Words of 64 parities of a line's shingles, where large buckets are compared.
ODD = 16
#: Bytes of a character in the encoding that shingles are cut from, where a place is found without counting.
WIDE = 4
#: Digests of candidate lines, 8 bytes each, that are broadcast at most.
IDS = 200_000


def _plain(line: str) -> Column:
    """The words, lower-cased and one space apart."""
    low, space = F.lower(line), F.lit(" ")
    # most lines are so already; looking for it is cheaper than parting them
    loose = F.contains(low, F.lit("  ")) | F.startswith(low, space) | F.endswith(low, space)
    return F.when(loose, F.array_join(F.array_remove(F.split(low, " "), ""), " ")).otherwise(low)


def _lines(docs: DataFrame) -> DataFrame:
    """(key, dig, pos, plain, node) of every line that is not blank: its words, and a 64-bit digest of them."""
    # few texts hold other white space; looking for it is cheaper than translating every character
    other = F.lit(False)
    for space in "\t\u000b\f\r":
        other = other | F.contains("text", F.lit(space))
    plain = F.when(other, F.translate("text", "\t\u000b\f\r", "    ")).otherwise(F.col("text"))
    return (
        docs.select("key", "dig", F.posexplode(F.split(plain, "\n")).alias("pos", "line"))
        .filter("trim(line) <> ''")
        .select("key", "dig", "pos", _plain("line").alias("plain"))
        .withColumn("node", F.xxhash64("plain"))
    )


def _shingle(wide: Column, i: Column) -> Column:
    """Hash of the characters from one on."""
    return F.xxhash64(F.substring(wide, i * WIDE + 1, F.lit(SHINGLE * WIDE)))


def _runs(plain: str) -> Column:
    """Hashes of the distinct shingles; a shorter line counts as a whole."""
    last = F.greatest(F.length(plain) - SHINGLE, F.lit(0))
    # the outer step encodes a line once for all its places
    each = F.transform(F.array(F.encode(plain, "UTF-32")), lambda wide: F.transform(F.sequence(F.lit(0), last), lambda i: _shingle(wide, i)))
    return F.array_distinct(F.element_at(each, 1))


def line_verdicts(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(key, dig, drop): the numbers of the lines, from 0, that each document (doc_id and digest of the text) loses."""
    tables = Tables(docs.sparkSession)
    lines = _lines(docs)
    # equal lines meet as text, which takes less room than their minima, and are hashed once
    plain = lines.select("node", "plain").dropDuplicates(["node"])
    # below the explosion, so that a line is encoded once
    last = F.greatest(F.length("plain") - SHINGLE, F.lit(0))
    wide = plain.select("node", F.encode("plain", "UTF-32").alias("wide"), last.alias("last"), F.sequence(F.lit(0), last, F.lit(STEP)).alias("places"))
    wide = wide.select("node", "wide", "last", F.explode("places").alias("i"))
    # past the end the last shingle is met again, which changes no minimum
    shingles = wide.select("node", *[_shingle(F.col("wide"), F.least(F.col("i") + k, F.col("last"))).alias(f"h{k}") for k in range(STEP)])
    shingles = shingles.select("node", *[F.hash(f"h{k}", F.lit(b)).alias(f"g{b}_{k}") for b in range(BANDS) for k in range(STEP)])

    def least(b: int, turn: int) -> Column:
        return F.min(F.least(*[F.col(f"g{b}_{k}").bitwiseXOR(F.lit(turn)) for k in range(STEP)]))

    signature = [least(b, turn).alias(f"m{b * ROWS + r}") for b in range(BANDS) for r, turn in enumerate(TURNS)]
    # lines are dealt by node already, so nothing moves; all buffers are numbers, so they are hashed
    distinct = shingles.groupBy("node").agg(*signature)
    bands = F.array(*[F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)])

    def bits(hashes: range) -> Column:
        packed = F.lit(0).cast("long")
        for at, k in enumerate(hashes):
            packed = packed.bitwiseOR(F.shiftleft(F.col(f"m{k}").cast("long").bitwiseAND(F.lit(15)), 4 * at))
        return packed

    parts = [f"t{k}" for k in range(TAGGED // 16)]
    tag = F.struct(*[bits(range(16 * k, 16 * k + 16)).alias(part) for k, part in enumerate(parts)])
    distinct = tables.write(distinct.select("node", bands.alias("bands"), tag.alias("tag")), "distinct")
    members = distinct.select("node", F.explode("bands").alias("key"))

    def likely(x: str, y: str) -> Column:
        differ = F.lit(0)
        for part in parts:
            apart = F.col(x)[part].bitwiseXOR(F.col(y)[part])
            for step in (1, 2):
                apart = apart.bitwiseOR(F.shiftrightunsigned(apart, step))
            differ = differ + F.bit_count(apart.bitwiseAND(F.lit(0x1111111111111111)))
        return differ <= TAGGED - AGREE

    texts: dict[str, DataFrame] = {}

    def prepare(nodes: DataFrame) -> None:
        # only digests are sent round, up to IDS of them; beyond it lines meet them in a shuffle, as text
        some = lines.select("node", "plain").join(broadcast_if_small(nodes, IDS), "node").dropDuplicates(["node"])
        texts["all"] = tables.write(some, "texts")

    def finer(nodes: DataFrame) -> DataFrame:
        # within the row of its line, so that no shingle becomes a row
        runs = texts["all"].join(nodes, "node").select("node", _runs("plain").alias("runs"))

        def parities(k: int) -> Column:
            mine = F.filter("runs", lambda h: h.bitwiseAND(F.lit(ODD - 1)) == k)
            place = lambda h: F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(63)).cast("int")
            one = F.lit(1).cast("long")
            return F.aggregate(mine, F.lit(0).cast("long"), lambda x, h: x.bitwiseXOR(F.call_function("shiftleft", one, place(h))))

        # written by `linked_components`; the sets themselves are not
        words = [parities(k).alias(f"w{k}") for k in range(ODD)]
        return runs.select("node", F.struct(F.size("runs").cast("long").alias("n"), *words).alias("tag"))

    def closer(x: str, y: str) -> Column:
        return within(x, y, ODD, percent)

    def near(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("ia", "ib"))
        return (
            pairs.join(texts["all"].withColumnsRenamed({"node": "a", "plain": "pa"}).hint("merge"), "a")
            .join(texts["all"].withColumnsRenamed({"node": "b", "plain": "pb"}).hint("merge"), "b")
            .select("a", "b", _runs("pa").alias("ia"), _runs("pb").alias("ib"))
            .withColumn("both", both)
            .filter(100 * F.col("both") >= percent * (F.size("ia") + F.size("ib") - F.col("both")))
        )

    found = linked_components(members, near, likely, prepare, distinct.select("node", "tag"), finer, closer)
    tables.drop("texts")
    found = found.withColumnRenamed("id", "node")
    place = F.struct("key", "dig", "pos")
    places = lines.select("key", "dig", "pos", "node").join(found.hint("merge"), "node", "left").select("key", "dig", "pos", F.coalesce("component", "node").alias("component"))
    # the first line of the first document stays; most components are one line
    kept = places.groupBy("component").agg(F.min(place).alias("keep"), F.count("*").alias("n")).filter("n > 1").select("component", "keep")
    drop = places.join(kept, "component").filter(place != F.col("keep"))
    return drop.groupBy("key", "dig").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with text less its repeated lines, and n_lines and n_removed.

    Lines are parted by \\n and compared by their words, lower-cased. Similarity is the Jaccard index, percent / 100 or
    more, of their shingles: the SHINGLE characters from each character on, one space between words. Similar lines form components; of each,
    the line with the smallest (doc_id, number) stays, in one document. Blank lines stay. Null and empty texts stay as
    they are with 0 lines removed. Equal rows share verdicts; different texts of one doc_id are documents of their
    own, in the order of their digests; a null doc_id orders first. Columns n_lines and n_removed are replaced, other columns stay. Empty in, empty out.
    """
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = slim.select("key", F.xxhash64("text").alias("dig"), "text")
    verdict = line_verdicts(slim, percent).withColumnsRenamed({"key": "_key", "dig": "_dig", "drop": "_drop"})
    joined = docs.drop("n_lines", "n_removed").withColumns(
        {"_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_dig": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    )
    joined = joined.join(verdict, ["_key", "_dig"], "left")
    parts = F.split("text", "\n")
    gone = F.map_from_arrays("_drop", F.transform("_drop", lambda p: F.lit(True)))
    left = F.filter("_parts", lambda x, i: ~F.coalesce(F.try_element_at(F.col("_gone"), i), F.lit(False)))
    out = joined.withColumn("_parts", parts).withColumn("_gone", gone)
    out = out.withColumn("text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    count = F.coalesce(F.size("_parts"), F.lit(0))
    return out.withColumns({"n_lines": F.greatest(count, F.lit(0)), "n_removed": F.coalesce(F.size("_drop"), F.lit(0))}).withColumn(
        "n_removed", F.greatest("n_removed", F.lit(0))
    ).drop("_key", "_dig", "_drop", "_parts", "_gone")
