"""Model catalogues and fallback profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import text as T

_IDS = "array<string>"


def summary_model(model_id: Column) -> Column:
    """Whether a model id may summarise text."""
    return (model_id != "") & (F.length(model_id) <= 200) & ~F.rlike(model_id, F.lit(K.NON_SUMMARY_MODEL))


def discovered_ids(payload: Column, style: Column) -> Column:
    """Usable model ids of a discovery reply, first occurrences in order."""

    def get(value: Column, path: str, kind: str = "string") -> Column:
        return F.try_variant_get(value, path, kind)

    def items(data: Column, path: str) -> Column:
        return F.coalesce(get(data, path, "array<variant>"), F.array().cast("array<variant>"))

    def gemini(item: Column) -> Column:
        first = get(item, "$.supportedGenerationMethods", _IDS)
        methods = F.coalesce(F.when(F.size(first) > 0, first), get(item, "$.supported_actions", _IDS), F.array().cast(_IDS))
        name = F.regexp_replace(T.first_present(get(item, "$.baseModelId"), get(item, "$.name")), "^models/", "")
        return F.when((F.size(methods) == 0) | F.array_contains(methods, "generateContent"), name)

    def read(data: Column) -> Column:
        kind = F.lower(F.coalesce(style, F.lit("openai")))
        openai = F.transform(items(data, "$.data"), lambda item: get(item, "$.id"))
        google = F.transform(items(data, "$.models"), gemini)
        local = F.transform(items(data, "$.models"), lambda item: T.first_present(get(item, "$.model"), get(item, "$.name")))
        names = F.when(kind == "gemini", google).when(kind == "ollama", local).otherwise(openai)
        trimmed = F.transform(names, lambda name: T.strip(F.coalesce(name, F.lit(""))))
        return F.array_distinct(F.filter(trimmed, summary_model))

    return T.let(F.try_parse_json(payload), read)


def model_catalog(providers: DataFrame, discovered: DataFrame, cached: DataFrame, now: Column, force_refresh: bool = False) -> DataFrame:
    """Status and model ids per service.

    ``providers(service_id, requires_api_key, has_key, models, style)`` where a NULL style means no
    discovery; ``discovered(service_id, payload)``, NULL when the call failed;
    ``cached(service_id, cached_at, cached_ids)`` in epoch seconds. Times are epoch seconds.
    """
    joined = providers.join(discovered, "service_id", "left").join(cached, "service_id", "left")
    empty = F.array().cast(_IDS)
    rows = (
        joined.withColumn("live", F.coalesce(discovered_ids(F.col("payload"), F.col("style")), empty))
        .withColumn("kept", F.array_distinct(F.filter(F.transform(F.coalesce("cached_ids", empty), T.strip), lambda item: item != "")))
        .withColumn("built", F.filter(F.transform(F.coalesce("models", empty), T.strip), lambda item: item != ""))
    )
    has_cache = F.size("kept") > 0
    fresh = has_cache & (now - F.coalesce("cached_at", F.lit(0.0)) < K.CATALOG_TTL_SECONDS)
    status = T.first_match(
        [
            (F.coalesce("requires_api_key", F.lit(True)) & ~F.coalesce("has_key", F.lit(False)), "key_required"),
            (fresh & F.lit(not force_refresh), "cached"), (F.col("style").isNull(), "built_in"), (F.size("live") > 0, "live"),
        ],
        F.lit("fallback"),
    )
    from_provider = F.when(F.col("status") == "live", F.col("live")).when(has_cache, F.col("kept"))
    ids = F.coalesce(from_provider, F.array_distinct("built"))
    refreshed = F.when(F.col("status") == "live", now).otherwise(F.nullif(F.col("cached_at"), F.lit(0.0)))
    return rows.withColumn("status", status).select(
        "service_id", "status", F.col("status").isin("live", "cached", "built_in").alias("ok"), refreshed.alias("refreshed_at"),
        ids.alias("model_ids"), F.coalesce(F.array_except(from_provider, F.col("built")), empty).alias("additional_model_ids"),
    )


def fallback_profiles(services: DataFrame, configs: DataFrame, configured: DataFrame) -> DataFrame:
    """The backup model profile of each configuration.

    ``services(service_id, position, provider, default_model, strong_model, base_url, requires_api_key)``,
    ``configs(config_id, active, preferred)``, ``configured(config_id, service_id, api_key, enabled, fast, pro, url)``.
    The local service and the active one are never a backup; the preferred one comes first; one is used.
    """
    ready = F.when(F.coalesce("requires_api_key", F.lit(True)), F.trim(F.coalesce("api_key", F.lit(""))) != "").otherwise(
        F.lower(F.trim(F.coalesce("enabled", F.lit("")))).isin("1", "true", "yes", "on")
    )
    usable = configured.join(services, "service_id").join(configs, "config_id").filter(
        (F.col("service_id") != "local") & (F.col("service_id") != F.col("active")) & ready
    )
    preferred = F.lower(F.trim(F.coalesce("preferred", F.lit(""))))
    order = F.struct(F.when(F.col("service_id") == preferred, 0).otherwise(1).alias("rank"), "position")
    profile = F.struct(
        "service_id", "provider", T.first_present(F.col("fast"), F.col("default_model")).alias("model"),
        T.first_present(F.col("pro"), F.col("strong_model")).alias("strong_model"), T.first_present(F.col("url"), F.col("base_url")).alias("base_url"),
    )
    return usable.groupBy("config_id").agg(F.min_by(profile, order).alias("p")).select("config_id", "p.*")
