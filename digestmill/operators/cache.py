"""Result reuse: keys, lookups, evictions, upserts, reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import urls as U
from digestmill.functions.text import strip


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    json = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substr(json, F.lit(2), F.length(json) - 2)


def _field(name: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{name}": '), _quoted(text))


def cache_context(
    provider: Column, model: Column, base_url: Column, prompt: Column, fallbacks: Column, pipeline: str = K.PIPELINE_VERSION
) -> Column:
    """Twenty hex digits that change with any setting that shapes a digest.

    ``fallbacks`` is ARRAY<STRUCT<provider, model, base_url>>. The hashed text is JSON with sorted keys.
    """

    def bare(url: Column) -> Column:
        return F.rtrim(url, F.lit("/"))

    backups = F.transform(
        fallbacks,
        lambda f: F.concat(
            F.lit("{"), _field("base_url", bare(f["base_url"])), F.lit(", "), _field("model", f["model"]), F.lit(", "),
            _field("provider", f["provider"]), F.lit("}"),
        ),
    )
    payload = F.concat(
        F.lit("{"), _field("base_url", bare(base_url)), F.lit(', "fallback_models": ['), F.array_join(backups, ", "), F.lit("], "),
        _field("model", model), F.lit(", "), _field("provider", provider), F.lit(", "), _field("summary_pipeline", F.lit(pipeline)),
        F.lit(", "), _field("summary_prompt", F.left(F.sha2(prompt, 256), F.lit(16))), F.lit("}"),
    )
    return F.left(F.sha2(payload, 256), F.lit(20))


def cache_key(url: Column, instruction: Column, quality: Column, context: Column) -> Column:
    level = F.when(quality.isin("fast", "pro"), quality).otherwise("fast")
    return F.concat(url, F.lit("\n"), strip(instruction), F.lit("\nquality="), level, F.lit("\ncontext="), context)


def content_key(title: Column, text: Column, source_type: Column, source_url: Column) -> Column:
    """``local://document/`` plus a hash of the content; connector documents also hash their source."""
    nul = F.lit("\0")
    base = F.concat(title, nul, text)
    full = F.when(source_type == "local_file", base).otherwise(F.concat(base, nul, source_type, nul, source_url))
    return F.concat(F.lit("local://document/"), F.sha2(full, 256))


def _digest(column: str) -> Column:
    """Join keys are hashes: long instructions do not travel through the shuffle."""
    return F.sha2(F.col(column), 256).alias("key_hash")


def _artifact(cache: DataFrame) -> DataFrame:
    return cache.select(
        _digest("cache_key"), F.col("title").alias("cached_title"), "result_json", "updated_at",
        F.get_json_object("result_json", "$.output_markdown_path").alias("relative_path"),
    )


def _fresh(updated_at: Column, ttl_seconds: int, now: Column) -> Column:
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(updated_at.cast("timestamp"))
    return age <= ttl_seconds * 1_000_000


def _now(now: dt.datetime | str | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(str(now)).cast("timestamp")


def cache_lookup(
    requests: DataFrame, cache: DataFrame, library: DataFrame, ttl_seconds: int = K.CACHE_TTL_SECONDS, now=None
) -> DataFrame:
    """Requests with ``hit`` and the cached result.

    A hit needs an equal key, an age of at most the TTL and an artifact that is still in the library;
    a forced request never hits. ``cache`` has one row per key.
    """
    if ttl_seconds <= 0:
        return requests.select("*", F.lit(None).cast("string").alias("result_json"), F.lit(False).alias("hit"))
    usable = _artifact(cache.filter(_fresh(F.col("updated_at"), ttl_seconds, _now(now)))).join(
        library.select("relative_path"), "relative_path", "left_semi"
    )
    # A forced request keeps a key that cannot match, rather than NULL: NULL keys would all meet in one task.
    forced = F.coalesce("force_refresh", F.lit(False))
    key = F.sha2("cache_key", 256)
    keyed = requests.withColumn("key_hash", F.when(forced, F.concat(F.lit("!"), key)).otherwise(key))
    joined = keyed.join(usable.select("key_hash", "result_json"), "key_hash", "left")
    return joined.withColumn("hit", F.col("result_json").isNotNull()).drop("key_hash")


def cache_evictions(requests: DataFrame, cache: DataFrame, library: DataFrame, ttl_seconds: int = K.CACHE_TTL_SECONDS, now=None) -> DataFrame:
    """Cache rows that were asked for in time but whose artifact is gone."""
    fresh = cache.filter(_fresh(F.col("updated_at"), ttl_seconds, _now(now)) & F.lit(ttl_seconds > 0))
    asked = requests.filter("NOT force_refresh").select(_digest("cache_key")).distinct()
    path = F.coalesce(F.get_json_object("result_json", "$.output_markdown_path"), F.lit(""))
    lost = fresh.withColumn("relative_path", path).join(library.select("relative_path"), "relative_path", "left_anti")
    return lost.withColumn("key_hash", F.sha2("cache_key", 256)).join(asked, "key_hash", "left_semi").drop("key_hash")


def cache_upsert(cache: DataFrame, results: DataFrame) -> DataFrame:
    """Cache after new results: creation time and instruction stay, title, result and time are replaced."""
    both = cache.withColumn("_turn", F.lit(0)).unionByName(results.withColumn("_turn", F.lit(1)))
    first = F.struct("_turn", "created_at")
    last = F.struct("_turn", "updated_at")
    return both.groupBy("cache_key").agg(
        F.min_by("canonical_url", first).alias("canonical_url"),
        F.min_by("instruction", first).alias("instruction"),
        F.max_by("title", last).alias("title"),
        F.max_by("result_json", last).alias("result_json"),
        F.min_by("created_at", first).alias("created_at"),
        F.max_by("updated_at", last).alias("updated_at"),
    )


def cache_report(jobs: DataFrame) -> DataFrame:
    """Hits, misses and forced runs of finished jobs by source type and quality."""
    hit = F.coalesce(F.get_json_object("result_json", "$.cache_hit").cast("boolean"), F.lit(False))
    done = jobs.filter("status = 'succeeded'").select(
        U.source_type(F.col("url")).alias("source_type"), "summary_quality", hit.alias("hit"),
        F.coalesce("force_refresh", F.lit(False)).alias("forced"),
    )
    return done.groupBy("source_type", "summary_quality").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if("forced").alias("forced")
    )


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """Groups of documents with one content key; all but the first are avoidable work."""
    key = content_key(F.col("title"), F.col("content_text"), F.col("source_type"), F.col("source_url"))
    groups = documents.select("doc_id", key.alias("content_key")).groupBy("content_key").agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")
    )
    return groups.filter("copies > 1").withColumn("avoidable", F.col("copies") - 1)
