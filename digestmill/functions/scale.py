"""Helpers that keep a single hot group from landing in one task."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of one group that a task may hold at once.
CHUNK_ROWS = 65536


def exploded(frame: DataFrame, keep: list[str | Column], array: Column, item: str, pos: str | None = None) -> DataFrame:
    """One row per array element.

    The outer form plus a filter on the position: the inner form makes the optimizer add a size filter
    on the array below the generator, which computes an expensive array twice.
    """
    rows = frame.select(*keep, F.posexplode_outer(array).alias("_pos", item)).filter("_pos IS NOT NULL")
    return rows.withColumnRenamed("_pos", pos) if pos else rows.drop("_pos")


def newest(frame: DataFrame, order: list, limit: int | None) -> DataFrame:
    """``frame`` in order: all rows, or the first ``limit`` where a caller asks for a number."""
    ordered = frame.orderBy(*order)
    return ordered if limit is None else ordered.limit(max(int(limit), 1))


def numbered_within(frame: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``row_number`` over ``keys`` ordered by a unique column of any type, without one task per key.

    Slim rows are cut by rank into ranges of (keys, order), each range is numbered on its own and shifted by
    the rows of its keys in the ranges before it. The cut is kept through the checkpoint folder, because both
    the numbers and the shifts depend on it.
    """
    slim = frame.select(*keys, order).repartitionByRange(*keys, order)
    cut = materialize(slim.withColumn("_range", F.spark_partition_id()))
    counts = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that span several ranges need a shift, so the joined side stays small.
    shifts = counts.withColumn("_shift", F.sum("_rows").over(before)).filter("_shift IS NOT NULL").drop("_rows")
    local = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(order))
    same = [F.col(f"n.{key}").eqNullSafe(F.col(f"s.{key}")) for key in (*keys, "_range")]
    numbered = cut.withColumn("_local", local).alias("n").join(shifts.alias("s"), same, "left").select(
        F.col(f"n.{order}").alias("_order"), (F.col("n._local") + F.coalesce("s._shift", F.lit(0))).cast("bigint").alias(name)
    )
    return frame.join(numbered, F.col(order) == F.col("_order")).drop("_order")


def in_order(frame: DataFrame, key: str, order: str, value: Column, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per key: whether ``value`` never falls along ``order`` (NULL values are left out).

    Neighbours are compared inside ranges of ``order``, then across range borders, where only one row
    per range is left.
    """
    rows = frame.select(key, F.col(order).alias("_order"), value.alias("_value")).filter("_value IS NOT NULL").withColumn(
        "_chunk", F.floor(F.col("_order") / chunk_rows)
    )
    previous = F.lag("_value").over(Window.partitionBy(key, "_chunk").orderBy("_order"))
    ranges = rows.withColumn("_ok", F.coalesce(F.col("_value") >= previous, F.lit(True))).groupBy(key, "_chunk").agg(
        F.bool_and("_ok").alias("_ok"), F.min_by("_value", "_order").alias("_first"), F.max_by("_value", "_order").alias("_last")
    )
    border = F.lag("_last").over(Window.partitionBy(key).orderBy("_chunk"))
    return ranges.withColumn("_ok", F.col("_ok") & F.coalesce(F.col("_first") >= border, F.lit(True))).groupBy(key).agg(
        F.bool_and("_ok").alias(name)
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a session that is one process on one machine may do
    without: there a folder is made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="digestmill-checkpoint-"))
    return context.getCheckpointDir()


def materialize(frame: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the session."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
