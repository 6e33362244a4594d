"""The training-data pipeline: what each stage keeps is what the next one reads.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` applies
them to ``documents``; between stages the rows are cut off through a table in the shared checkpoint folder, so a
lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from digestmill.functions.scale import shared_folder
from digestmill.llm.exact_dedup import drop_duplicates
from digestmill.llm.ngram_join import one_of_each
from digestmill.llm.packing import pack_documents
from digestmill.llm.quality_rules import keep_good
from digestmill.llm.secrets import without_secrets
from digestmill.session import prepare


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, by themselves and by their host."""
    return keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the smallest id."""
    return drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, the one with the smallest id."""
    return one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; ``n_chars`` follows the masked text."""
    return without_secrets(docs, n_chars_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token windows of the documents, a row per piece."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("secret scan", secrets_stage),
    ("packing", packing_stage),
]

# Near-duplicate components, guess costs and token ids are beyond SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables.

    Each stage's rows are written to a new folder under ``spark.checkpoint.dir`` and read again; a stage's table is
    removed once the next one is written. The last table is the caller's to remove with the folder.
    """
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if place == len(STAGES) - 1:
            return result
        path = f"{folder}/stage-{place}"
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        if place:
            remove(spark, f"{folder}/stage-{place - 1}")
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of this run, on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

