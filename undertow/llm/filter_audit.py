"""How quality filters interact: what each removes in every order they may be applied in.

Documents are counted by (part, mask), the mask having a bit for each filter that a document fails. A recursive query
extends filter prefixes by unused letters, one level for each step; a prefix carries the bits applied so far and the mask
cell it was joined with, so every level says of every cell whether it is kept, removed or redundant there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
#: Counts that a document adds to at a step, in the order of the result.
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

SPACE = r"[\x20\x09-\x0D]+"


def text_mask(text: Column, letters: str = LETTERS) -> Column:
    """Bits of the filters that look at one text alone: A words, B variety, C capitals, D marks."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, SPACE), "")
    n = F.size(words)
    fails = {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(whole, F.lit("[A-Z]")) > 2 * F.length(whole),
        "D": whole.rlike("[#$%&*|]"),
    }
    mask = F.lit(0)
    for letter, fail in fails.items():
        mask = mask + F.when(fail, 1 << letters.index(letter)).otherwise(0)
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, with those labelled good or toxic.

    Texts are read once and stand for by their SHA-256 from there on. A document fails E if its text also occurs under a
    smaller doc_id; of the rows of one text, only those of the smallest doc_id pass, so they are counted apart by a
    minimum and a sum, both partial, and no text's rows meet in one task.
    """
    number = F.col("doc_id").cast("long")
    rows = docs.select(
        number.alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
        text_mask(F.col("text")).alias("mask"),
    )
    once = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = labels.select(number.alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    no = F.lit(False)
    # null ids have no label, and would meet in one partition of the join
    known = once.filter("doc_id IS NOT NULL").join(said, "doc_id", "left")
    known = known.withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    flagged = known.unionByName(once.filter("doc_id IS NULL").withColumns({"good": no, "toxic": no}))
    same = flagged.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = same.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    dealt = same.join(least.hint("merge"), "digest")
    passing = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    fails_e = 1 << LETTERS.index("E")
    sides = F.array(F.struct(F.col("mask").alias("mask"), passing.alias("n")), F.struct((F.col("mask") + fails_e).alias("mask"), (F.col("n") - passing).alias("n")))
    cells = dealt.select("part", "good", "toxic", F.inline(sides)).filter("n > 0")
    return cells.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def grown_prefixes(spark, letters: str = LETTERS) -> DataFrame:
    """(prefix, letter, step, cell, alive, fails, only) of every prefix of every order and every mask cell.

    The recursion starts from the cells with no filter applied; each level takes an unused letter, and the bits applied
    before it say whether the cell is still there. The rows are sum(n! / (n - k)!) * 2 ** n, whatever the data.
    """
    pool = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters))
    return spark.sql(
        f"""WITH RECURSIVE grown(prefix, letter, step, cell, before, bit) AS (
              SELECT '', '', 0, cell, 0, 0 FROM (SELECT explode(sequence(0, {(1 << len(letters)) - 1})) AS cell)
              UNION ALL
              SELECT concat(prefix, taken.letter), taken.letter, step + 1, cell, before | bit, taken.bit
              FROM grown LATERAL VIEW explode(filter(array({pool}), x -> ((before | bit) & x.bit) = 0)) free AS taken
              WHERE step < {len(letters)})
            SELECT prefix, letter, step, cell, (cell & before) = 0 AS alive, (cell & bit) <> 0 AS fails, cell = bit AS only
            FROM grown WHERE step > 0"""
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A row for each part that occurs, each of the 120 orders of the five filters and each step, zeros included. shapley is
    what the step's filter removes in the part, summed over all orders.

    Null texts are empty, a null part is the empty string. Rows that repeat a document count each; none of them is
    smaller than the other, so E passes both. A row without doc_id is neither smaller than others nor fails E, and has no
    label. A document is good or toxic if any of its label rows says so; labels of no document are ignored. Other columns
    are not read. Empty in, empty out.
    """
    spark = docs.sparkSession
    cells = mask_cells(docs, labels, part)
    # constant size: 325 prefixes by 32 cells
    steps = F.broadcast(grown_prefixes(spark))
    met = cells.withColumnRenamed("mask", "cell").join(steps, "cell")
    lost = F.col("alive") & F.col("fails")
    adds = {
        "kept": F.when(F.col("alive") & ~F.col("fails"), F.col("n")),
        "removed": F.when(lost, F.col("n")),
        "redundant": F.when(F.col("fails") & ~F.col("alive"), F.col("n")),
        "unique_fails": F.when(F.col("only"), F.col("n")),
        "good_lost": F.when(lost, F.col("good")),
        "toxic_lost": F.when(lost, F.col("toxic")),
    }
    at = met.groupBy("part", "prefix", "letter", "step").agg(*[F.sum(F.coalesce(adds[m], F.lit(0))).alias(m) for m in METRICS])
    size = len(LETTERS)
    orders_with = F.element_at(F.array(*[F.lit(math.factorial(size - k)) for k in range(1, size + 1)]), F.col("step"))
    worth = at.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_with).alias("shapley"))
    at = at.join(worth, ["part", "letter"])
    # constant size: 120 orders by 5 steps
    whole = grown_prefixes(spark).filter(f"step = {size} AND cell = 0").select(F.col("prefix").alias("filter_order"))
    whole = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    whole = whole.select("filter_order", F.substring("filter_order", F.lit(1), F.col("step")).alias("prefix"))
    out = at.join(F.broadcast(whole), "prefix")
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in (*METRICS, "shapley")])


SQL = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN split.doc_id > min(split.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM split LEFT JOIN said ON split.doc_id = said.doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, mask),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
grown(prefix, letter, step, before, bit) AS (
  SELECT '', '', 0, 0, 0
  UNION ALL
  SELECT prefix || l.letter, l.letter, step + 1, before | grown.bit, l.bit FROM grown JOIN letters l ON ((before | grown.bit) & l.bit) = 0 WHERE step < 5),
met AS (
  SELECT part, prefix, letter, step,
         coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0) AS removed,
         coalesce(sum(n) FILTER ((mask & before) <> 0 AND (mask & bit) <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0) AS toxic_lost
  FROM cells JOIN grown ON step > 0 GROUP BY part, prefix, letter, step),
steps AS (
  SELECT met.*, o.prefix AS filter_order FROM (SELECT prefix FROM grown WHERE step = 5) o JOIN met ON met.prefix = substr(o.prefix, 1, met.step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM steps
"""
