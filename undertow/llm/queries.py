"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm import filter_audit as audit
from undertow.llm import prefix_trie as trie
from undertow.llm.extract import extract
from undertow.llm.fingerprint import fingerprints
from undertow.llm.langid import predictions
from undertow.llm.line_dedup import dedup_lines
from undertow.llm.mixing import mix, word_count
from undertow.llm.multi_index import near_vectors
from undertow.llm.sketch_dedup import near_duplicates
from undertow.llm.suffix_dedup import repeated_bytes
from undertow.llm.tiling import contamination
from undertow.llm.toxicity import toxicity
from undertow.llm.tree_dedup import repeated_words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_sketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"), size=100)


@query
def op9_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"), size=13)


@query
def op1_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("n_words"))
    mixed = mix(docs, F.col("n_words"), F.array("source"), [3.0, 1.0, 2.0], share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_gru_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents"))


@query
def op4_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "coverage", "contaminated")


@query
def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op7_multi_index_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


@query
def op10_automaton_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_host_suffix_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query
def op11_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), every=True)


@query
def op12_double_array_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_double_array_conversation_trie"] = trie.SQL


@query
def op13_recursive_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_recursive_filter_audit"] = audit.SQL


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
