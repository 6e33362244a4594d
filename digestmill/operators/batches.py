"""Batches of jobs. Membership is a long table ``(batch_id, seq, job_id)``, never one list in a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestmill.functions.scale import newest
from digestmill.operators.ledger import default_next_steps


def make_batches(submissions: DataFrame) -> DataFrame:
    """Membership rows for submissions ``(batch_id, seq, url)``: one job id per row, order kept in ``seq``."""
    token = F.sha2(F.concat_ws("\n", F.col("batch_id").cast("string"), F.col("seq").cast("string"), "url"), 256)
    return submissions.select("batch_id", "seq", F.concat(F.lit("job_"), F.left(token, F.lit(32))).alias("job_id"), "url")


def batch_status(members: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts and status per batch. A member without a job still counts in the total."""
    state = members.join(jobs.select("job_id", "status"), "job_id", "left")

    def of(status: str):
        return F.count_if(F.coalesce(F.col("status") == status, F.lit(False))).alias(status)

    counted = state.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count("status").alias("found"),
        of("queued"), of("running"), of("succeeded"), of("failed"), of("canceled"),
    )
    status = (
        F.when((F.col("failed") > 0) & (F.col("failed") == F.col("total")), "failed")
        .when(F.col("succeeded") == F.col("total"), "succeeded")
        .when((F.col("failed") > 0) | (F.col("succeeded") > 0), "partial")
        .otherwise("running")
    )
    return counted.withColumn("status", status)


def batch_summary(members: DataFrame, jobs: DataFrame) -> DataFrame:
    """One entry per found member, with its section: succeeded, failed or running."""
    section = F.when(F.col("status").isin("succeeded", "failed"), F.col("status")).otherwise("running")
    failed = F.col("status") == "failed"
    result = F.from_json("result_json", "output_markdown_path STRING, resource_package_path STRING")
    steps = F.coalesce(F.from_json("error_next_steps_json", "array<string>"), default_next_steps(F.coalesce("error_code", F.lit(""))))
    entry = jobs.select(
        "job_id", "url", "title", "status", "stage",
        result["output_markdown_path"].alias("output_markdown_path"),
        result["resource_package_path"].alias("resource_package_path"),
        F.when(failed, F.col("error_code")).alias("error_code"), F.when(failed, F.col("error_message")).alias("error_message"),
        F.when(failed, steps).alias("error_next_steps"),
    )
    return members.join(entry, "job_id").withColumn("section", section)


def list_batches(batches: DataFrame, members: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """The batches with their status, newest first: all, or ``limit`` of them."""
    order = [F.desc("created_at"), F.desc("batch_id")]
    headers, chosen = batches, members
    if limit is not None:
        headers = newest(batches, order, limit)
        chosen = members.join(headers.select("batch_id"), "batch_id", "left_semi")
    return headers.join(batch_status(chosen, jobs), "batch_id").orderBy(*order)
