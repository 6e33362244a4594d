"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestmill.llm.bpe import bpe_digests
from digestmill.llm.chosen_path import near_documents
from digestmill.llm.divergence import source_divergence
from digestmill.llm.exact_dedup import exact_duplicates
from digestmill.llm.ngram_join import near_duplicates
from digestmill.llm.oracles import COLLOCATIONS, EXACT_DEDUP, QUALITY_RULES, SHARDING, SOURCE_DIVERGENCE
from digestmill.llm.packing import pack_documents
from digestmill.llm.phrases import collocations
from digestmill.llm.pii import personal_data_digests
from digestmill.llm.quality_rules import quality_rules
from digestmill.llm.registry import ORACLES, QUERIES, query, table
from digestmill.llm.secrets import secret_digests
from digestmill.llm.sharding import place
from digestmill.llm.token_counts import token_counts
from digestmill.llm.toxicity import THRESHOLD, held_out, learn_toxicity, toxicity

__all__ = ["ORACLES", "QUERIES"]


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir), table(spark, sf_dir, "labels")
    model = learn_toxicity(documents, labels.filter(~held_out(F.col("doc_id"))))
    scored = toxicity(documents, model)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "n_hits")


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir))


@query("op3_personal_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digests(table(spark, sf_dir))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir))


@query("op5_exact_dedup", EXACT_DEDUP)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir), keep="largest")


@query("op6_quality_rules", QUALITY_RULES)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir))


@query("op7_ngram_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir))


@query("op8_sharding", SHARDING)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir), [f"shard-{number:03d}" for number in range(16)], slots=1021)


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir))


@query("op11_collocations", COLLOCATIONS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir))


@query("op12_chosen_path")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir))


@query("op13_source_divergence", SOURCE_DIVERGENCE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir))
