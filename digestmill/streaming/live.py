"""Structured Streaming: live job state, request reuse, live index, notification feed.

Every sink writes one folder per micro-batch, replacing that folder when a batch is retried, so a
restart repeats no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from digestmill import constants as K
from digestmill.functions.scale import materialize
from digestmill.operators import library as L
from digestmill.operators.ledger import job_deltas, job_fields, job_states, merge_states
from digestmill.operators.notify import notification_feed
from digestmill.sources.packages import stored_partitions


def _folder(root: str, batch_id: int) -> str:
    return f"{root}/batch={batch_id:012d}"


def _start(stream: DataFrame, write_batch, checkpoint: str, once: bool):
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


# ---- job state -----------------------------------------------------------------------------


# Folders the job log is split into by a hash of the job.
JOB_BUCKETS = 64


def _job_bucket() -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(JOB_BUCKETS)).cast("int")


def stream_jobs(events: DataFrame, root: str, checkpoint: str, once: bool = False, close_every: int | None = None, delay: str = "1 hour"):
    """Live job state as a log of slim events, bucketed by job, whose older part is folded to one state per job.

    A micro-batch costs what it brings. Every ``close_every`` batches (never, unless asked for) the events that are
    older than ``delay`` before the newest one are folded by ``close_jobs``, so a read costs the states and the open
    tail, not the history.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        job_deltas(batch).withColumn("bucket", _job_bucket()).write.mode("overwrite").partitionBy("bucket").parquet(_folder(root, batch_id))
        if close_every and (batch_id + 1) % close_every == 0:
            close_jobs(batch.sparkSession, root, delay)

    return _start(events, write, checkpoint, once)


def _job_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", root).parquet(f"{root}/batch=*")


def _closed(spark: SparkSession, root: str) -> Row | None:
    """The newest whole closing: ``version``, the last ``batch`` it read and the time up to which it folded."""
    manifests = f"{root}/_closed/manifest"
    if not stored_partitions(spark, manifests):
        return None
    return spark.read.parquet(manifests).orderBy(F.desc("version")).first()


def _open_log(spark: SparkSession, root: str, closed: Row | None) -> tuple[DataFrame | None, DataFrame]:
    """The states of the newest closing and the events that are not in them."""
    log = _job_log(spark, root)
    if closed is None:
        return None, log.drop("batch")
    at = f"{root}/_closed/version={closed['version']:012d}"
    tail = spark.read.parquet(f"{at}/tail").unionByName(log.filter(F.col("batch") > closed["batch"]).drop("batch"))
    return spark.read.parquet(f"{at}/states"), tail


def _merged(spark: SparkSession, root: str, states: DataFrame | None, tail: DataFrame) -> DataFrame:
    """States of all jobs from closed ones and the tail.

    Late writes merge by their times. Only a cancel from before a write that is folded already cannot: the jobs it
    concerns are folded from the whole log again, whose other buckets are not read.
    """
    if states is None:
        return job_states(tail.drop("bucket"))
    cancels = tail.filter("op = 'cancel'").groupBy("job_id").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    broken = materialize(states.join(cancels, "job_id").filter("at < plain_at").select("job_id", "bucket"))
    buckets = [row["bucket"] for row in broken.select("bucket").distinct().collect()]  # at most JOB_BUCKETS
    stored = states.drop("bucket")
    fresh = job_states(tail.drop("bucket"), stored.filter("canceled_at IS NOT NULL").select("job_id", "canceled_at"))
    merged = merge_states(stored.unionByName(fresh))
    if not buckets:
        return merged
    history = _job_log(spark, root).filter(F.col("bucket").isin(buckets)).join(broken.select("job_id"), "job_id", "left_semi")
    return merged.join(broken, "job_id", "left_anti").unionByName(job_states(history.drop("batch", "bucket")))


def close_jobs(spark: SparkSession, root: str, delay: str = "1 hour") -> None:
    """Fold all events that are older than ``delay`` before the newest one into one state per job.

    The states and the open rest are written to a new folder and count once their manifest is there, so a reader sees
    whole closings only and a broken one has no effect. The log stays for late cancels; only they read it.
    """
    closed = _closed(spark, root)
    states, tail = _open_log(spark, root, closed)
    last = _job_log(spark, root).agg(F.max("batch").alias("batch")).first()["batch"]
    newest = tail.agg((F.max(F.col("ts").cast("timestamp")) - F.expr(f"INTERVAL {delay}")).alias("until")).first()["until"]
    if newest is None:
        return
    is_old = F.col("ts").cast("timestamp") <= F.lit(newest)
    version = 0 if closed is None else closed["version"] + 1
    at = f"{root}/_closed/version={version:012d}"
    done = _merged(spark, root, states, tail.filter(is_old))
    done.withColumn("bucket", _job_bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/states")
    tail.filter(~is_old).write.mode("overwrite").parquet(f"{at}/tail")
    manifest = spark.createDataFrame([(version, int(last), newest)], "version LONG, batch LONG, until TIMESTAMP")
    manifest.coalesce(1).write.mode("append").parquet(f"{root}/_closed/manifest")


def current_jobs(spark: SparkSession, root: str, jobs: DataFrame | None = None) -> DataFrame:
    """State of every job so far, or of the jobs in ``jobs`` (``job_id``), whose buckets alone are read.

    Reads the newest closing and the events after it; without a closing, the whole log.
    """
    states, tail = _open_log(spark, root, _closed(spark, root))
    if jobs is not None:
        buckets = [row["bucket"] for row in jobs.select(_job_bucket().alias("bucket")).distinct().collect()]  # at most JOB_BUCKETS
        wanted = jobs.select("job_id").distinct()
        tail = tail.filter(F.col("bucket").isin(buckets)).join(wanted, "job_id", "left_semi")
        states = None if states is None else states.filter(F.col("bucket").isin(buckets)).join(wanted, "job_id", "left_semi")
    return job_fields(_merged(spark, root, states, tail))


def compact_jobs(spark: SparkSession, root: str, target: str) -> None:
    """The log in fewer, larger files, sorted by job, in a new folder; no event is folded away and the old folder stays."""
    log = _job_log(spark, root).drop("batch")
    ranged = log.repartitionByRange("bucket", "job_id", "ts").sortWithinPartitions("bucket", "job_id", "ts")
    ranged.write.mode("errorifexists").partitionBy("bucket").parquet(_folder(target, 0))


# ---- request reuse -------------------------------------------------------------------------


def stream_dedupe(requests: DataFrame, time_column: str = "ts", window: str = "7 days") -> DataFrame:
    """First request per cache key inside the window; later ones are dropped. ``stream_reuse`` answers them."""
    return requests.withWatermark(time_column, window).dropDuplicatesWithinWatermark(["cache_key"])


_REUSE_ROWS = "cache_key STRING, request_id STRING, ts TIMESTAMP, hit BOOLEAN, result_json STRING"
_REUSE_STATE = "result_json STRING, updated_at TIMESTAMP"


def reuse_rows(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests and results as one stream for ``stream_reuse``, from ``cache_key, request_id, ts, force_refresh`` and ``cache_key, ts, result_json``."""
    asked = requests.select("cache_key", "ts", "request_id", F.coalesce("force_refresh", F.lit(False)).alias("force_refresh"), F.lit(None).cast("string").alias("result_json"))
    return asked.unionByName(results.select("cache_key", "ts", F.lit(None).cast("string").alias("request_id"), F.lit(False).alias("force_refresh"), "result_json"))


def stream_reuse(rows: DataFrame, ttl_seconds: int = K.CACHE_TTL_SECONDS, delay: str = "1 hour") -> DataFrame:
    """``cache_key, request_id, ts, hit, result_json`` for every request: a repeat is answered with the stored result.

    State is one result per key and lives ``ttl_seconds`` from its last write; a write starts the time anew. A forced
    request is never answered, and the result that follows it replaces the stored one. Rows of a micro-batch are taken
    in the order of their times, results before requests of the same time; of results that arrive out of order the one
    with the latest time stays. ``delay`` is how far the watermark, which removes expired state, stays behind.
    """

    def answer(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        result, updated_at = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).assign(_turn=lambda frame: frame["request_id"].notna()).sort_values(["ts", "_turn", "request_id"], kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            if row.request_id is None:
                if updated_at is None or row.ts >= updated_at:
                    result, updated_at = row.result_json, row.ts
                continue
            age = None if updated_at is None else (row.ts - updated_at).total_seconds()
            hit = result is not None and not row.force_refresh and age <= ttl_seconds
            out.append((key[0], row.request_id, row.ts, hit, result if hit else None))
        if updated_at is not None:
            state.update((result, updated_at))
            until = int((updated_at.timestamp() + ttl_seconds) * 1000) + 1
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["cache_key", "request_id", "ts", "hit", "result_json"])

    keyed = rows.withWatermark("ts", delay).groupBy("cache_key")
    return keyed.applyInPandasWithState(answer, _REUSE_ROWS, _REUSE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---- library index -------------------------------------------------------------------------


def read_library_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New Markdown files under a folder as ``relative_path, content, mtime, size``."""
    files = (
        spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.md").schema("value STRING").load(folder)
    )
    return _read_files(files, folder)


def _read_files(files: DataFrame, folder: str) -> DataFrame:
    seen = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"),
        (F.unix_micros("_metadata.file_modification_time") / 1_000_000).alias("mtime"), F.col("_metadata.file_size").alias("size"),
    )
    return _relative(seen, F.col("path"), folder).select("relative_path", "content", "mtime", "size")


def _index_batch(rows: DataFrame, root: str, batch_id: int) -> None:
    """Library rows and postings of files as one folder pair."""
    L.library_rows(rows).write.mode("overwrite").parquet(_folder(f"{root}/library", batch_id))
    stored = rows.sparkSession.read.parquet(_folder(f"{root}/library", batch_id))
    L.build_postings(stored).sortWithinPartitions("token").write.mode("overwrite").parquet(_folder(f"{root}/postings", batch_id))


def stream_index(files: DataFrame, root: str, checkpoint: str, once: bool = False):
    """Library rows and postings of new files, one folder pair per micro-batch.

    A file stream meets each path once; ``sync_library`` also follows files that change, go, or come back.
    """
    return _start(files, lambda batch, batch_id: _index_batch(batch, root, batch_id), checkpoint, once)


# Changed paths are named in the scan up to this number, so that no other file is opened; more are joined.
MOST_PATHS = 10_000


def sync_library(spark: SparkSession, folder: str, root: str) -> dict[str, int]:
    """One trigger of the live index: a full listing is compared with it; returns the numbers of ``changed`` and ``removed`` paths.

    New and changed files come in as the next batch. A path that is gone gets a note that hides its versions up to the
    last batch, so a file that comes back later is seen again. The listing reads no content. One such writer per index.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    listed = _relative(listing.select("path", "modificationTime", F.col("length").alias("size")), F.col("path"), folder).select(
        "relative_path", (F.unix_micros("modificationTime") / 1_000_000).alias("mtime"), "size"
    )
    last = -1
    known = spark.createDataFrame([], "relative_path STRING, mtime DOUBLE, size LONG")
    if stored_partitions(spark, f"{root}/library"):
        rows = spark.read.option("basePath", f"{root}/library").parquet(f"{root}/library")
        last = int(rows.agg(F.max("batch").alias("batch")).first()["batch"])
        known = rows.select("relative_path", "batch", "mtime", "size").join(_versions(spark, root), ["relative_path", "batch"], "left_semi")
    delta = materialize(L.index_delta(listed, known).filter("change <> 'unchanged'"))
    counts = {row["change"]: row["n"] for row in delta.groupBy("change").agg(F.count("*").alias("n")).collect()}
    if counts.get("removed"):
        delta.filter("change = 'removed'").select("relative_path", F.lit(last).cast("long").alias("hidden_to")).write.mode("append").parquet(f"{root}/removed")
    if counts.get("changed"):
        changed = delta.filter("change = 'changed'").select("relative_path")
        files = _read_files(spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").schema("value STRING").load(folder), folder)
        if counts["changed"] <= MOST_PATHS:
            files = files.filter(F.col("relative_path").isin([row["relative_path"] for row in changed.collect()]))
        else:
            files = files.join(changed, "relative_path", "left_semi")
        _index_batch(files, root, last + 1)
    return {"changed": counts.get("changed", 0), "removed": counts.get("removed", 0)}


def _relative(rows: DataFrame, path: Column, folder: str) -> DataFrame:
    root = folder.rstrip("/") + "/"
    plain = F.regexp_replace(path, "^[a-z]+:/+", "/")
    return rows.withColumn("relative_path", F.substr(plain, F.locate(root, plain) + len(root)))


def _versions(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of each path that is not removed: ``relative_path, batch``. Content is not read here."""
    rows = spark.read.option("basePath", f"{root}/library").parquet(f"{root}/library").select("relative_path", "mtime", "batch")
    if stored_partitions(spark, f"{root}/removed"):
        hidden = spark.read.parquet(f"{root}/removed").groupBy("relative_path").agg(F.max("hidden_to").alias("hidden_to"))
        rows = rows.join(hidden, "relative_path", "left").filter("hidden_to IS NULL OR batch > hidden_to")
    return rows.groupBy("relative_path").agg(F.max_by("batch", F.struct("mtime", "batch")).alias("batch"))


def current_library(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{root}/library").parquet(f"{root}/library")
    return rows.join(_versions(spark, root), ["relative_path", "batch"], "left_semi").drop("batch")


def current_postings(spark: SparkSession, root: str, tokens: Sequence[str] | None = None) -> DataFrame:
    """Postings of the newest versions, of all tokens or of those a search needs (``query_tokens``).

    The token filter stands before the version join: it reaches the sorted files, and only matching rows move.
    """
    rows = spark.read.option("basePath", f"{root}/postings").parquet(f"{root}/postings")
    rows = rows if tokens is None else rows.filter(F.col("token").isin(list(tokens)))
    return rows.join(_versions(spark, root), ["relative_path", "batch"], "left_semi").select("token", "relative_path", "pos")


def compact_index(spark: SparkSession, root: str, target: str, removed: DataFrame | None = None) -> None:
    """The newest versions as one batch in a new folder, without the paths in ``removed`` (``relative_path``).

    Postings are written in ranges of (token, path), so that a search reads the files of its tokens only.
    """
    rows, postings = current_library(spark, root), current_postings(spark, root)
    if removed is not None:
        gone = removed.select("relative_path").distinct()
        rows, postings = (frame.join(gone, "relative_path", "left_anti") for frame in (rows, postings))
    rows.write.mode("errorifexists").parquet(_folder(f"{target}/library", 0))
    L.write_postings(postings, _folder(f"{target}/postings", 0))


# ---- notifications -------------------------------------------------------------------------


def stream_notify(events: DataFrame, enabled: Sequence[str], root: str, checkpoint: str, occurred_at: Column | None = None, once: bool = False):
    """Feed rows of the enabled events, one folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        notification_feed(batch, enabled, occurred_at).write.mode("overwrite").parquet(_folder(root, batch_id))

    return _start(events, write, checkpoint, once)
