"""A training corpus from documents: five stages, each an operator of undertow.llm at work on what the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm.langid import identify
from undertow.llm.line_dedup import dedup_lines
from undertow.llm.mixing import mix, word_count
from undertow.llm.sketch_dedup import near_duplicates
from undertow.llm.tiling import contamination
from undertow.session import shared_dir

#: A document stays if the network names a language and gives it this share of its positions.
LEAST_SHARE = 0.3


def _apart(docs: DataFrame, *needed: str) -> DataFrame:
    """docs as the columns that a stage needs, and all others in one struct, where they meet no column of an operator."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(F.lit(True).alias("_"), *rest).alias("_rest"))


def _whole(done: DataFrame, docs: DataFrame, *needed: str, **changed: Column) -> DataFrame:
    """The columns of docs, in their order, from what _apart made; `changed` are computed anew."""
    return done.select(*[changed[c].alias(c) if c in changed else F.col(c) if c in needed else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the network learns from these documents' own labels.

    Null, empty and letterless texts go. Rows that repeat stay or go alike. Null labels are not learnt from.
    """
    needed = "doc_id", "text", "lang"
    named = identify(_apart(docs, *needed), docs)
    return _whole(named.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)), docs, *needed)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less lines that an earlier document holds; a document with no line left was made of copies and goes.

    Null and empty texts have no line to lose and stay; n_chars, if there, follows the text. Rows that repeat a doc_id
    and text share their verdict; of ties the smaller doc_id keeps its line, null first.
    """
    needed = "doc_id", "text"
    done = dedup_lines(_apart(docs, *needed))
    done = done.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    changed = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return _whole(done, docs, *needed, **changed)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words to a shingle, similarity 0.8.

    Null, empty and blank texts and null ids are near nothing and stay; rows that repeat a kept doc_id all stay.
    """
    kept = near_duplicates(docs, size=5, percent=80).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows go alike."""
    needed = "doc_id", "text"
    found = contamination(_apart(docs, *needed), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _whole(found.filter("NOT contaminated"), docs, *needed)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with their number (twice a document's size: two rounds).

    Null and blank texts have no words and go. Columns size, source_size, target and taken of the input are replaced.
    """
    return mix(docs, word_count(), F.array("source"), [3.0, 1.0, 2.0], share=1.5, most=2.0).filter("taken > 0")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_copies),
    ("decontamination", decontaminate),
    ("mixing", mixture),
]

#: No stage but the last can be said in SQL; tests hold the rows of all but language_id against brute force (tests/llm/test_stages.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; between two of them the rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{spark.sql('SELECT uuid()').first()[0]}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
