"""Quality, regression, retention, catalogue and notification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import text as T
from digestmill.operators import catalog as M
from digestmill.operators import digest as DO
from digestmill.operators import notify as N
from digestmill.operators import quality as Q
from digestmill.operators import retention as R
from digestmill.plans.bindings import view
from digestmill.plans.digest_queries import _extractive
from digestmill.plans.registry import query


def _samples(spark, sf):
    """A sample and its result per document, with expectations that some of them miss."""
    doc = F.col("doc_id")
    docs = view(spark, sf, "documents")
    samples = docs.select(
        doc.cast("string").alias("id"), F.array(F.lit("platform_subtitle"), F.lit("local_asr")).alias("expected_transcript_origins"),
        F.when(doc % 2 == 0, F.array(F.lit("bilibili_subtitle"))).alias("expected_subtitle_statuses"),
        F.when(doc % 3 == 0, F.array(F.lit("ZH"), F.lit("中文"))).alias("expected_subtitle_languages"),
        F.when(doc % 4 == 0, F.lit("BV1")).alias("expected_bvid"), F.when(doc % 5 == 0, F.lit(1.03)).alias("maximum_duration_ratio"),
        F.lit("zh").alias("expected_summary_language"), F.lit(2).alias("minimum_core_points"), F.lit("").alias("reference_transcript"),
        F.lit(None).cast("double").alias("maximum_character_error_rate"),
    )
    markdown = F.concat(
        F.lit("# 标题\n\n## 核心要点\n\n- 要点一\n"), F.when(doc % 2 == 0, F.lit("- 要点二\n")).otherwise(""), F.lit("\n## 核心要点时间轴\n\n- [a](b) 要点一\n- 要点二\n\n## 详细\n"),
        F.when(doc % 7 == 0, F.repeat(F.lit("latin filler "), 60)).otherwise(""),
    )
    results = docs.filter(doc % 10 != 9).select(
        doc.cast("string").alias("id"), T.first_match([(doc % 6 == 5, "failed"), (doc % 6 == 4, "running")], F.lit("succeeded")).alias("status"),
        F.when(doc % 6 == 5, F.lit("boom")).alias("error_message"), F.when(doc % 8 != 7, F.lit("local_asr")).alias("transcript_origin"),
        F.when(doc % 4 < 2, F.lit("bilibili_subtitle")).alias("subtitle_status"), F.when(doc % 2 == 0, F.lit("zh-CN")).otherwise(F.lit("en")).alias("subtitle_language"),
        F.when(doc % 8 == 0, F.lit("BV1")).alias("bvid"), F.when(doc % 15 == 0, F.lit(1.01)).when(doc % 15 == 5, F.lit(1.2)).alias("duration_ratio"),
        markdown.alias("summary_markdown"), F.lit(None).cast("string").alias("reference"), F.lit(None).cast("string").alias("hypothesis"),
        F.lit(None).cast("double").alias("duration"),
    )
    return samples, results


_HAS = "doc_id % 10 <> 9"
_CHECKS = f"""checks AS (
    SELECT CAST(doc_id AS VARCHAR) AS id, 'terminal_status' AS name, {_HAS} AND doc_id % 6 <> 4 AS ok FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'succeeded', {_HAS} AND doc_id % 6 < 4 FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'transcript_origin', {_HAS} AND doc_id % 8 <> 7 FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'subtitle_status', {_HAS} AND doc_id % 4 < 2 FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'subtitle_language', {_HAS} AND doc_id % 2 = 0 FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'bvid', {_HAS} AND doc_id % 8 = 0 FROM documents WHERE doc_id % 4 = 0
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'subtitle_duration_ratio', {_HAS} AND doc_id % 15 = 0 FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'chinese_summary', {_HAS} AND doc_id % 7 <> 0 FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'core_points', {_HAS} AND doc_id % 2 = 0 FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'timeline_matches_core_points', NOT ({_HAS}) OR doc_id % 2 = 0 FROM documents)"""


@query("regression_checks", f"WITH {_CHECKS} SELECT id, name, ok FROM checks")
def regression_checks(spark, sf):
    return Q.regression_checks(*_samples(spark, sf)).select("id", "name", "ok")


@query("regression_report", f"WITH {_CHECKS} SELECT id, bool_and(ok) AS ok, count(*) AS checks FROM checks GROUP BY id")
def regression_report(spark, sf):
    return Q.regression_report(Q.regression_checks(*_samples(spark, sf)))


@query("regression_suite", f"WITH {_CHECKS} SELECT bool_and(ok) AS ok, count(DISTINCT id) AS sample_count FROM checks")
def regression_suite(spark, sf):
    return Q.regression_suite(Q.regression_report(Q.regression_checks(*_samples(spark, sf))))


@query(
    "section_items",
    """SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, 'T') OR starts_with(l, '- '))) AS BIGINT) AS items FROM documents""",
)
def section_items(spark, sf):
    """Lines that start with T become list items of a section in the middle of a text."""
    rows = F.transform(F.split("text", "\n"), lambda line: F.when(F.startswith(line, F.lit("T")), F.concat(F.lit("  * "), line)).otherwise(line))
    markdown = F.concat(F.lit("- before\n## 核心要点时间轴\n"), F.array_join(rows, "\n"), F.lit("\n## next\n- after"))
    return view(spark, sf, "documents").select("doc_id", T.section_items(markdown, K.CORE_POINTS).cast("bigint").alias("items"))


@query(
    "char_ratio",
    """SELECT doc_id, CAST(round(6000000.0 * k / (length(regexp_replace(text, '\\s', '', 'g')) + k)) AS BIGINT) AS scaled FROM (SELECT doc_id, text, doc_id % 50 AS k FROM documents)""",
)
def char_ratio(spark, sf):
    mixed = F.concat("text", F.repeat(F.lit("字"), (F.col("doc_id") % 50).cast("int")))
    return view(spark, sf, "documents").select("doc_id", F.round(T.char_ratio(mixed, parts=6000000)).cast("bigint").alias("scaled"))


@query(
    "library_quality",
    """SELECT source_type, count(*) AS digests, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS core_points, count(*) FILTER (WHERE doc_id % 2 = 0) AS matched_timelines,
         CAST(7 * count(*) AS BIGINT) AS missing_sections, count(*) FILTER (WHERE doc_id % 3 = 0) AS high, count(*) FILTER (WHERE doc_id % 3 = 1) AS low FROM v_docs GROUP BY source_type""",
)
def library_quality(spark, sf):
    doc = F.col("doc_id")
    markdown = F.concat(
        F.lit("# "), "title", F.lit("\n\n## 核心要点\n\n- a\n"), F.when(doc % 2 == 0, F.lit("2. b\n")).otherwise(""), F.lit("\n## 核心要点时间轴\n\n- a\n* b\n"),
    )
    rows = view(spark, sf, "v_docs").select(
        "doc_id", "source_type", markdown.alias("summary_markdown"), T.first_match([(doc % 3 == 0, "high"), (doc % 3 == 1, "low")], F.lit("medium")).alias("confidence")
    )
    return Q.library_quality(rows).select("source_type", "digests", "core_points", "matched_timelines", "missing_sections", "high", "low")


_LACKING = " + ".join(f"CASE WHEN contains(e.md, '{section}') THEN 0 ELSE 1 END" for section in K.REQUIRED_SECTIONS)


@query(
    "digest_quality",
    f"""WITH {_extractive()} SELECT source_type, count(*) AS digests, CAST(sum({_LACKING}) AS BIGINT) AS missing_sections FROM ext e JOIN v_docs d ON d.doc_id = e.doc_id GROUP BY source_type""",
)
def digest_quality(spark, sf):
    """Quality roll-up over the extractive digests of all documents."""
    digests = DO.extractive_digest(view(spark, sf, "v_docs"), summary_chars=300).withColumn("confidence", F.lit("none"))
    return Q.library_quality(digests).select("source_type", "digests", "missing_sections")


# ---- retention -----------------------------------------------------------------------------

_NOW = "2024-01-31 00:00:00"


def _tables(spark, sf):
    events = view(spark, sf, "events")
    temp = events.filter("event_type = 'view'").select(F.concat(F.lit("tmp/"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("updated_at"))
    outputs = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.max("ts").alias("updated_at"))
    jobs = view(spark, sf, "v_jobs").select("job_id", F.col("created_at").alias("updated_at"), "status")
    return temp, outputs, jobs


_OLD = "TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY"


@query(
    "retention_preview",
    f"""SELECT 'temp' AS category, 'tmp/' || event_id AS item, false AS removed FROM events WHERE event_type = 'view' AND ts < {_OLD}
        UNION ALL SELECT 'outputs', d, false FROM (SELECT strftime(ts, '%Y-%m-%d') AS d, max(ts) AS m FROM events GROUP BY 1) WHERE m < {_OLD}
        UNION ALL SELECT 'jobs', 'job_' || event_id, false FROM events WHERE ts < {_OLD}""",
)
def retention_preview(spark, sf):
    return R.retention_preview(*_tables(spark, sf), now=F.lit(_NOW), include_jobs=True).select("category", "item", "removed")


@query("retention_apply", f"SELECT 'job_' || event_id AS job_id FROM events WHERE ts >= {_OLD}")
def retention_apply(spark, sf):
    temp, outputs, jobs = _tables(spark, sf)
    preview = R.retention_preview(temp, outputs, jobs, now=F.lit(_NOW), include_jobs=True, dry_run=False)
    return R.retention_apply(jobs, "job_id", "jobs", preview).select("job_id")


@query("kept_recent", f"SELECT count(*) AS kept_recent_count FROM events WHERE event_type = 'view' AND ts >= {_OLD}")
def kept_recent(spark, sf):
    return R.kept_recent(_tables(spark, sf)[0], now=F.lit(_NOW))


# ---- catalogue and services ----------------------------------------------------------------


def _providers(spark, sf):
    """A provider per user with a reply in one of the three styles."""
    users = view(spark, sf, "events").select("user_id").distinct()
    user = F.col("user_id")
    name = F.concat(F.lit("m"), (user % 5).cast("string"))
    providers = users.select(
        user.alias("service_id"), (user % 6 != 0).alias("requires_api_key"), (user % 4 != 0).alias("has_key"),
        F.array(F.lit("m1"), F.lit("base")).alias("models"), T.first_match([(user % 3 == 0, "openai"), (user % 3 == 1, "gemini"), (user % 7 == 2, None)], F.lit("ollama")).alias("style"),
    )
    payload = F.when(user % 3 == 0, F.concat(F.lit('{"data":[{"id":" '), name, F.lit(' "},{"id":"speech-2.8-hd"},{"id":"'), name, F.lit('"},{"id":"tail"}]}'))).when(
        user % 3 == 1,
        F.concat(F.lit('{"models":[{"name":"models/'), name, F.lit('","supportedGenerationMethods":["generateContent"]},{"baseModelId":"gem-embed","supported_actions":["generateContent"]},{"name":"models/other","supportedGenerationMethods":["embedContent"]}]}')),
    ).otherwise(F.concat(F.lit('{"models":[{"model":"'), name, F.lit('"},{"name":"llava:7b"},{"name":""}]}')))
    discovered = users.select(user.alias("service_id"), F.when(user % 11 != 0, payload).alias("payload"))
    cached = users.filter(user % 5 == 0).select(
        user.alias("service_id"), F.when(user % 10 == 0, F.lit(999000.0)).otherwise(F.lit(1000.0)).alias("cached_at"), F.array(F.lit("old"), F.lit("m1"), F.lit("old")).alias("cached_ids")
    )
    return providers, discovered, cached


@query(
    "model_catalog",
    """WITH u AS (SELECT DISTINCT user_id AS u FROM events),
        s AS (SELECT u, CASE WHEN u % 6 <> 0 AND u % 4 = 0 THEN 'key_required' WHEN u % 10 = 0 THEN 'cached' WHEN u % 3 = 2 AND u % 7 = 2 THEN 'built_in' WHEN u % 11 <> 0 THEN 'live' ELSE 'fallback' END AS status FROM u),
        i AS (SELECT u, status, CASE WHEN status = 'live' THEN 'm' || (u % 5) || CASE u % 3 WHEN 0 THEN ',tail' WHEN 1 THEN '' ELSE ',llava:7b' END WHEN u % 5 = 0 THEN 'old,m1' ELSE 'm1,base' END AS ids FROM s)
        SELECT u AS service_id, status, status IN ('live', 'cached', 'built_in') AS ok, ids AS model_ids,
          CASE WHEN status = 'live' OR u % 5 = 0 THEN array_to_string(list_filter(string_split(ids, ','), lambda x: x NOT IN ('m1', 'base')), ',') ELSE '' END AS additional FROM i""",
)
def model_catalog(spark, sf):
    catalog = M.model_catalog(*_providers(spark, sf), now=F.lit(1000000.0))
    return catalog.select("service_id", "status", "ok", F.array_join("model_ids", ",").alias("model_ids"), F.array_join("additional_model_ids", ",").alias("additional"))


@query(
    "fallback_profiles",
    """WITH c AS (SELECT DISTINCT user_id AS config_id FROM events), s(service_id, position, key) AS (VALUES ('local', 0, false), ('alpha', 1, true), ('beta', 2, true), ('home', 3, false)),
        x AS (SELECT config_id, service_id, position, CASE WHEN (config_id % 3 = 2 AND service_id = 'beta') OR (config_id % 3 = 1 AND service_id = 'home') THEN 0 ELSE 1 END AS rank FROM c, s
          WHERE service_id <> 'local' AND NOT (config_id % 2 = 0 AND service_id = 'alpha') AND (CASE service_id WHEN 'alpha' THEN config_id % 5 <> 0 WHEN 'beta' THEN config_id % 7 <> 0 ELSE config_id % 4 = 0 END))
        SELECT config_id, arg_min(service_id, (rank, position)) AS service_id, CASE WHEN arg_min(service_id, (rank, position)) = 'beta' THEN 'tuned' ELSE arg_min(service_id, (rank, position)) || '-small' END AS model FROM x GROUP BY config_id""",
)
def fallback_profiles(spark, sf):
    users = view(spark, sf, "events").select(F.col("user_id").alias("config_id")).distinct()
    user = F.col("config_id")
    rows = [("local", 0, "local", False), ("alpha", 1, "openai_compatible", True), ("beta", 2, "openai_compatible", True), ("home", 3, "openai_compatible", False)]
    services = spark.createDataFrame(
        [(s, i, p, s + "-small", s + "-big", "https://" + s + ".example", key) for s, i, p, key in rows],
        "service_id STRING, position INT, provider STRING, default_model STRING, strong_model STRING, base_url STRING, requires_api_key BOOLEAN",
    )
    configs = users.select(
        user, F.when(user % 2 == 0, "alpha").otherwise("local").alias("active"), T.first_match([(user % 3 == 1, "home"), (user % 3 == 2, " Beta ")], F.lit("")).alias("preferred")
    )

    def entry(service, key, flag, fast):
        return users.select(user, F.lit(service).alias("service_id"), key.alias("api_key"), flag.alias("enabled"), F.lit(fast).alias("fast"), F.lit("").alias("pro"), F.lit("").alias("url"))

    none = F.lit("")
    configured = (
        entry("alpha", F.when(user % 5 != 0, F.lit("k")).otherwise(" "), none, "").unionByName(entry("beta", F.when(user % 7 != 0, F.lit("k")), none, "tuned"))
        .unionByName(entry("home", none, F.when(user % 4 == 0, F.lit("Yes")).otherwise("no"), "")).unionByName(entry("local", F.lit("k"), F.lit("1"), ""))
    )
    return M.fallback_profiles(services, configs, configured).select("config_id", "service_id", "model")


@query(
    "generation_evidence",
    """SELECT evidence, count(*) AS n FROM (SELECT event_id % 6 IN (0, 2, 4) AS evidence FROM events) GROUP BY evidence""",
)
def generation_evidence(spark, sf):
    bodies = [
        '{"choices":[{"message":{"reasoning_content":" x "}}]}', '{"choices":[{"message":{"reasoning":[]}}]}', '{"output":[{"type":"reasoning"}]}',
        '{"usage":{"output_tokens_details":{"reasoning_tokens":0}}}', '{"usage":{"completion_tokens_details":{"reasoning_tokens":12}}}', "not json",
    ]
    body = T.first_match([(F.col("event_id") % 6 == i, text) for i, text in enumerate(bodies)])
    rows = view(spark, sf, "events").select(F.coalesce(Q.generation_evidence(body), F.lit(False)).alias("evidence"))
    return rows.groupBy("evidence").agg(F.count("*").alias("n"))


@query(
    "health_rollup",
    """SELECT user_id AS host, bool_and(event_type <> 'error' OR event_id % 3 <> 0) AS ok, count(*) AS checks, count(*) FILTER (WHERE event_type = 'error' AND event_id % 3 = 0) AS failed_required FROM events GROUP BY user_id""",
)
def health_rollup(spark, sf):
    checks = view(spark, sf, "events").select(F.col("user_id").alias("host"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 3 == 0).alias("required"))
    return Q.health_rollup(checks)


# ---- notifications -------------------------------------------------------------------------


@query(
    "notification_feed",
    """SELECT event_id, 'job.' || CASE event_type WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS event,
         CASE WHEN event_type = 'error' THEN 500 END AS message_chars, event_type = 'purchase' AS has_title, false AS leaks, '2024-01-31T00:00:00+00:00' AS occurred_at FROM events WHERE event_type IN ('purchase', 'error')""",
)
def notification_feed(spark, sf):
    changes = view(spark, sf, "v_job_events").withColumn("job_id", F.col("event_id").cast("string")).withColumn(
        "error_message", F.when(F.col("op") == "fail", F.repeat(F.lit("e"), 600)).otherwise("")
    ).withColumn("api_key", F.lit("secret")).withColumn("source_text", F.lit("body"))
    feed = N.notification_feed(changes, ["job.succeeded", " job.failed "], F.lit(_NOW).cast("timestamp"), error_chars=500)
    payload = F.col("payload")
    return feed.select(
        F.col("job_id").cast("bigint").alias("event_id"), "event", F.length(F.get_json_object(payload, "$.error_message")).alias("message_chars"),
        F.get_json_object(payload, "$.title").isNotNull().alias("has_title"), (F.contains(payload, F.lit("secret")) | F.contains(payload, F.lit("source_text"))).alias("leaks"),
        F.get_json_object(payload, "$.occurred_at").alias("occurred_at"),
    )


@query(
    "client_activity",
    """SELECT user_id AS client, arg_max(event_type, ts) AS last_path, max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 600 SECOND AS connected FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY user_id""",
)
def client_activity(spark, sf):
    requests = view(spark, sf, "events").filter("ts <= TIMESTAMP_NTZ '2024-01-30 12:00:00'").select(F.col("user_id").alias("client"), F.col("event_type").alias("path"), "ts")
    return N.client_activity(requests, F.lit("2024-01-30 12:00:00")).select("client", "last_path", "connected")
