"""Removal of old artifacts: preview, survivors, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cutoff(days: int, now: Column | None) -> Column:
    moment = F.current_timestamp() if now is None else now.cast("timestamp")
    return F.timestamp_micros(F.unix_micros(moment) - max(0, days) * 86_400_000_000)


def retention_preview(
    temp: DataFrame, outputs: DataFrame, jobs: DataFrame, days: int = 14, now: Column | None = None,
    dry_run: bool = True, include_temp: bool = True, include_outputs: bool = True, include_jobs: bool = False,
) -> DataFrame:
    """What a cleanup removes: ``category, item, updated_at, removed``, oldest first.

    ``temp(path, updated_at)``, ``outputs(date, updated_at)``, ``jobs(job_id, updated_at)``. Applying with a
    window of no days is refused. A dry run is the default and marks nothing as removed.
    """
    if days <= 0 and not dry_run:
        raise ValueError("unsafe_cleanup_window: Refusing to delete artifacts with days <= 0.")
    parts = [
        (include_temp, "temp", temp, "path"), (include_outputs, "outputs", outputs, "date"), (include_jobs, "jobs", jobs, "job_id"),
    ]
    frames = [
        frame.filter(F.col("updated_at").cast("timestamp") < _cutoff(days, now)).select(
            F.lit(category).alias("category"), F.col(key).alias("item"), F.col("updated_at").cast("timestamp").alias("updated_at"),
            F.lit(not dry_run).alias("removed"),
        )
        for wanted, category, frame, key in parts if wanted
    ]
    if not frames:
        frames = [temp.filter(F.lit(False)).select(
            F.lit("").alias("category"), F.col("path").alias("item"), F.col("updated_at").cast("timestamp").alias("updated_at"), F.lit(False).alias("removed")
        )]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result.orderBy("category", "updated_at", "item")


def retention_apply(table: DataFrame, key: str, category: str, preview: DataFrame) -> DataFrame:
    """Survivors of one table. Written to a new version by the caller; nothing is deleted in place."""
    gone = preview.filter((F.col("category") == category) & F.col("removed")).select(F.col("item").alias(key))
    return table.join(gone, key, "left_anti")


def kept_recent(temp: DataFrame, days: int = 14, now: Column | None = None) -> DataFrame:
    """Number of temporary entries that are too recent to go."""
    return temp.agg(F.count_if(F.col("updated_at").cast("timestamp") >= _cutoff(days, now)).alias("kept_recent_count"))
