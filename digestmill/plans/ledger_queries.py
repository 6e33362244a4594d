"""Job ledger, batch and cache queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions.text import first_match
from digestmill.operators import batches as B
from digestmill.operators import cache as C
from digestmill.operators import ledger as J
from digestmill.plans.bindings import view
from digestmill.plans.registry import query
from digestmill.plans.url_queries import _SOURCE


FOLD_SQL = """WITH flagged AS (SELECT *, coalesce(max(CASE WHEN op = 'cancel' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM v_job_events),
        live AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r FROM flagged WHERE gone = 0 OR op = 'cancel'),
        err AS (SELECT job_id, error_code, error_message, row_number() OVER (PARTITION BY job_id ORDER BY r) AS q FROM live WHERE op IN ('succeed', 'fail', 'cancel'))
        SELECT l.job_id, max(CASE WHEN r = 1 THEN status END) AS status, max(CASE WHEN r = 1 THEN stage END) AS stage,
          arg_min(progress, r) FILTER (WHERE progress IS NOT NULL) AS progress, arg_min(title, r) FILTER (WHERE title IS NOT NULL) AS title,
          (SELECT error_code FROM err e WHERE e.job_id = l.job_id AND q = 1) AS error_code,
          (SELECT error_message FROM err e WHERE e.job_id = l.job_id AND q = 1) AS error_message, count(*) AS applied_events
        FROM live l GROUP BY l.job_id"""


@query("fold_jobs", FOLD_SQL)
def fold_jobs(spark, sf):
    return J.fold_jobs(view(spark, sf, "v_job_events")).drop("created_at", "updated_at")


@query(
    "list_jobs",
    "SELECT job_id, status, request_kind FROM v_jobs WHERE status = 'failed' AND request_kind <> 'media_download'",
)
def list_jobs(spark, sf):
    found = J.list_jobs(view(spark, sf, "v_jobs"), status="failed", not_kind="media_download")
    return found.select("job_id", "status", "request_kind")


@query("status_counts", "SELECT status, count(*) AS n FROM v_jobs WHERE request_kind <> 'media_download' GROUP BY status")
def status_counts(spark, sf):
    return J.status_counts(view(spark, sf, "v_jobs"), not_kind="media_download")


@query("media_status_counts", "SELECT status, count(*) AS n FROM v_jobs WHERE request_kind = 'media_download' GROUP BY status")
def media_status_counts(spark, sf):
    return J.status_counts(view(spark, sf, "v_jobs"), kind="media_download")


@query(
    "queue_active",
    """SELECT job_id, status, CASE status WHEN 'running' THEN 0 ELSE 1 END AS queue_rank FROM v_jobs
        WHERE status IN ('running', 'queued') AND request_kind <> 'media_download'""",
)
def queue_active(spark, sf):
    return J.queue_active(view(spark, sf, "v_jobs")).select("job_id", "status", "queue_rank")


@query(
    "queue_status",
    """SELECT running, queued, total, running + queued AS active_count, running + queued AS active_returned,
          false AS active_limited FROM (SELECT count(*) FILTER (WHERE status = 'running') AS running,
          count(*) FILTER (WHERE status = 'queued') AS queued, count(*) AS total FROM v_jobs WHERE request_kind <> 'media_download')""",
)
def queue_status(spark, sf):
    return J.queue_status(view(spark, sf, "v_jobs"))


@query(
    "recoverable_jobs",
    """SELECT job_id, CASE WHEN ok THEN 'requeued' ELSE 'interrupted' END AS outcome, CASE WHEN ok THEN 'queued' ELSE 'failed' END AS status,
          CASE WHEN ok THEN 'recovered' ELSE 'interrupted' END AS stage, CASE WHEN NOT ok THEN 'interrupted' END AS error_code
        FROM (SELECT job_id, CASE request_kind WHEN 'link' THEN NOT starts_with(url, 'local://')
            WHEN 'document' THEN event_id % 97 <> 0 AND event_id % 3 <> 0 ELSE true END AS ok FROM v_jobs WHERE status IN ('queued', 'running'))""",
)
def recoverable_jobs(spark, sf):
    return J.recoverable(view(spark, sf, "v_jobs")).select("job_id", "outcome", "status", "stage", "error_code")


@query(
    "retry_requests",
    """SELECT job_id AS retry_of, CASE WHEN doc OR src THEN 'document' ELSE 'link' END AS request_kind, CASE WHEN NOT (doc OR src) THEN url END AS url,
          CASE WHEN doc THEN 'Doc ' || event_id WHEN src THEN 'S' || event_id END AS title,
          CASE WHEN doc THEN 'text ' || event_id WHEN src THEN 'body ' || event_id END AS content,
          CASE WHEN event_id % 2 = 0 THEN 'again' ELSE instruction END AS instruction,
          CASE WHEN event_id % 5 = 2 THEN 'pro' WHEN status = 'succeeded' THEN CASE WHEN event_id % 3 = 0 THEN 'pro' ELSE 'fast' END
               WHEN lower(summary_quality) IN ('deep', 'pro') THEN 'pro' ELSE 'fast' END AS summary_quality,
          event_id % 7 <> 0 AS force_refresh
        FROM (SELECT *, request_kind = 'document' AND event_id % 97 <> 0 AND event_id % 3 <> 0 AS doc, url LIKE 'local://%' AND status = 'succeeded' AS src
              FROM v_jobs WHERE request_kind <> 'media_download')""",
)
def retry_requests(spark, sf):
    jobs = view(spark, sf, "v_jobs")
    event = F.col("event_id")
    overrides = jobs.select(
        "job_id", F.when(event % 2 == 0, F.lit("again")).alias("instruction"),
        F.when(event % 5 == 2, F.lit("strong")).alias("summary_quality"), F.when(event % 7 == 0, F.lit(False)).alias("force_refresh"),
    )
    return J.retry_requests(jobs, overrides)


_STEPS = "CASE error_code " + " ".join(
    f"WHEN '{code}' THEN '{steps[0]}'" for code, steps in K.NEXT_STEPS.items()
) + f" ELSE '{K.NEXT_STEPS_OTHER[0]}' END"
_STEP_COUNT = "CASE error_code " + " ".join(
    f"WHEN '{code}' THEN {len(steps)}" for code, steps in K.NEXT_STEPS.items()
) + f" ELSE {len(K.NEXT_STEPS_OTHER)} END"


@query(
    "job_view",
    f"""SELECT job_id, CASE WHEN error_next_steps_json IS NOT NULL THEN 'own step' WHEN error_code IS NOT NULL THEN {_STEPS} END AS first_step,
          CASE WHEN event_id % 97 <> 0 AND request_kind = 'document' AND event_id % 3 <> 0 THEN 'text ' || event_id END AS payload_content,
          json_extract_string(result_json, '$.output_markdown_path') AS output_markdown_path, force_refresh FROM v_jobs""",
)
def job_view(spark, sf):
    jobs = J.job_view(view(spark, sf, "v_jobs"))
    return jobs.select(
        "job_id", F.try_element_at("error_next_steps", F.lit(1)).alias("first_step"), F.col("request_payload.content").alias("payload_content"),
        F.col("result.output_markdown_path").alias("output_markdown_path"), "force_refresh",
    )


@query(
    "document_gate",
    """SELECT doc_id, substr(CASE WHEN doc_id % 4 = 0 THEN 'local-document' ELSE trim(text, ' ' || chr(10)) END, 1, 180) AS title, length(body) AS chars,
          CASE WHEN length(body) < 20 THEN 'invalid_document' END AS error_code
        FROM (SELECT doc_id, text, trim(CASE WHEN doc_id % 6 = 0 THEN '  too short ' || chr(10) ELSE text END, ' ' || chr(10)) AS body FROM documents)""",
)
def document_gate(spark, sf):
    docs = view(spark, sf, "documents")
    uploads = docs.select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("text")).alias("title"),
        F.when(F.col("doc_id") % 6 == 0, F.lit("  too short \n")).otherwise(F.col("text")).alias("content"),
    )
    gated = J.document_gate(uploads, title_chars=180)
    return gated.select("doc_id", "title", F.length("content").cast("bigint").alias("chars"), "error_code")


@query(
    "failure_report",
    f"SELECT error_code, count(*) AS n, {_STEPS} AS first_step, CAST({_STEP_COUNT} AS BIGINT) AS steps FROM v_jobs WHERE status = 'failed' GROUP BY error_code",
)
def failure_report(spark, sf):
    report = J.failure_report(view(spark, sf, "v_jobs"))
    return report.select("error_code", "n", F.col("next_steps")[0].alias("first_step"), F.size("next_steps").cast("bigint").alias("steps"))


@query(
    "stage_progress",
    "SELECT stage, count(*) AS events, min(progress) AS lowest, max(progress) AS highest FROM v_job_events GROUP BY stage",
)
def stage_progress(spark, sf):
    return J.stage_progress(view(spark, sf, "v_job_events"))


@query(
    "download_progress",
    """SELECT CAST(least(event_id % 150, 100) AS BIGINT) AS percent, count(*) AS n, CAST(round((0.08 + least(event_id % 150, 100) / 100.0 * 0.82) * 1000000) AS BIGINT) AS ppm
        FROM events GROUP BY 1, 3""",
)
def download_progress(spark, sf):
    line = F.concat(F.lit("[download] PROGRESS: "), (F.col("event_id") % 150).cast("string"), F.lit(".0% of file"))
    events = view(spark, sf, "events").select(
        F.least(F.col("event_id") % 150, F.lit(100)).cast("bigint").alias("percent"), (J.progress_of(line) * 1000000).alias("p")
    )
    return events.groupBy("percent", F.round("p").cast("bigint").alias("ppm")).agg(F.count("*").alias("n"))


_REQ = [
    ("nope", '{"a":1}'), ("submit_link", '{"url":"https://a.b","zz":1,"aa":2}'), ("submit_link", '{"instruction":"x"}'),
    ("submit_link", '{"url":5}'), ("submit_link", '{"url":"  "}'), ("submit_batch", '{"urls":[]}'), ("submit_batch", '{"urls":["a",3]}'),
    ("submit_link", '{"url":"https://a.b","summary_quality":"best"}'), ("get_job", '{"job_id":"j","wait_seconds":46}'),
    ("list_recent_jobs", '{"limit":0}'), ("cleanup", '{"days":true}'), ("health_check", "{}"), ("submit_batch", '{"urls":["a","b"],"force_refresh":true}'),
]
_VIOLATIONS = [
    "Unknown tool: nope", "Invalid arguments for submit_link: unknown field ''aa''.", "Invalid arguments for submit_link: ''url'' is required.",
    "Invalid arguments for submit_link: ''url'' must be string.", "Invalid arguments for submit_link: ''url'' must not be empty.",
    "Invalid arguments for submit_batch: ''urls'' must not be empty.", "Invalid arguments for submit_batch: every ''urls'' item must be string.",
    "Invalid arguments for submit_link: ''summary_quality'' must be one of fast, pro.", "Invalid arguments for get_job: ''wait_seconds'' is above the maximum.",
    "Invalid arguments for list_recent_jobs: ''limit'' is below the minimum.", "Invalid arguments for cleanup: ''days'' must be integer.",
]


@query(
    "validate_requests",
    f"""SELECT event_id AS request_id, CASE event_id % {len(_REQ)} {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_VIOLATIONS))} END AS violation FROM events""",
)
def validate_requests(spark, sf):
    turn = F.col("event_id") % len(_REQ)
    requests = view(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), first_match([(turn == i, tool) for i, (tool, _) in enumerate(_REQ)]).alias("tool"),
        first_match([(turn == i, args) for i, (_, args) in enumerate(_REQ)]).alias("args"),
    )
    return J.validate_requests(requests).select("request_id", "violation")


# ---- batches -------------------------------------------------------------------------------

_BATCH = """SELECT m.batch_id, count(*) AS total, count(j.job_id) AS found, count(*) FILTER (WHERE j.status = 'queued') AS queued,
    count(*) FILTER (WHERE j.status = 'running') AS running, count(*) FILTER (WHERE j.status = 'succeeded') AS succeeded,
    count(*) FILTER (WHERE j.status = 'failed') AS failed, count(*) FILTER (WHERE j.status = 'canceled') AS canceled
  FROM v_batch_members m LEFT JOIN v_jobs j ON j.job_id = m.job_id GROUP BY m.batch_id"""
_BATCH_STATUS = """CASE WHEN failed > 0 AND failed = total THEN 'failed' WHEN succeeded = total THEN 'succeeded' WHEN failed > 0 OR succeeded > 0 THEN 'partial' ELSE 'running' END"""


@query("batch_status", f"SELECT *, {_BATCH_STATUS} AS status FROM ({_BATCH})")
def batch_status(spark, sf):
    return B.batch_status(view(spark, sf, "v_batch_members"), view(spark, sf, "v_jobs"))


@query(
    "batch_summary",
    f"""SELECT m.batch_id, m.seq, m.job_id, CASE WHEN status IN ('succeeded', 'failed') THEN status ELSE 'running' END AS section,
          json_extract_string(result_json, '$.output_markdown_path') AS output_markdown_path, CASE WHEN status = 'failed' THEN error_code END AS error_code,
          CASE WHEN status = 'failed' THEN CASE WHEN error_next_steps_json IS NOT NULL THEN 'own step' ELSE {_STEPS} END END AS first_step
        FROM v_batch_members m JOIN v_jobs j ON j.job_id = m.job_id""",
)
def batch_summary(spark, sf):
    summary = B.batch_summary(view(spark, sf, "v_batch_members"), view(spark, sf, "v_jobs"))
    return summary.select(
        "batch_id", "seq", "job_id", "section", "output_markdown_path", "error_code", F.col("error_next_steps")[0].alias("first_step")
    )


@query(
    "make_batches",
    """SELECT user_id AS batch_id, event_id AS seq, 'job_' || substr(sha256(user_id || chr(10) || event_id || chr(10) || url), 1, 32) AS job_id FROM v_submissions""",
)
def make_batches(spark, sf):
    subs = view(spark, sf, "v_submissions").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("seq"), "url")
    return B.make_batches(subs).drop("url")


@query(
    "list_batches",
    f"""SELECT b.*, {_BATCH_STATUS} AS status, h.created_at FROM ({_BATCH}) b JOIN
        (SELECT user_id, min(ts) AS created_at FROM events GROUP BY user_id) h ON b.batch_id = h.user_id""",
)
def list_batches(spark, sf):
    headers = view(spark, sf, "events").groupBy(F.col("user_id").alias("batch_id")).agg(F.min("ts").alias("created_at"))
    found = B.list_batches(headers, view(spark, sf, "v_batch_members"), view(spark, sf, "v_jobs"))
    return found


# ---- cache ---------------------------------------------------------------------------------

_KEY = "url || chr(10) || trim(instruction) || chr(10) || 'quality=' || CASE WHEN summary_quality IN ('fast', 'pro') THEN summary_quality ELSE 'fast' END || chr(10) || 'context=c1'"
_CACHED = f"""SELECT cache_key, min(created_at) AS created_at, arg_max(title, created_at) AS title, max(created_at) AS updated_at, arg_max(result_json, created_at) AS result_json
    FROM (SELECT {_KEY} AS cache_key, created_at, title, result_json FROM v_jobs WHERE status = 'succeeded') GROUP BY cache_key"""
_NOW = "2024-01-31 00:00:00"
_TTL = 14 * 86400


def _key():
    return C.cache_key(F.col("url"), F.col("instruction"), F.col("summary_quality"), F.lit("c1"))


def _cache(spark, sf):
    done = view(spark, sf, "v_jobs").filter("status = 'succeeded'").select(
        _key().alias("cache_key"), "canonical_url", "instruction", "title", "result_json", "created_at", F.col("created_at").alias("updated_at")
    )
    return C.cache_upsert(done.limit(0), done)


@query(
    "cache_context",
    f"""SELECT doc_id, substr(sha256('{{"base_url": "https://api.example.org/v' || doc_id % 7 || '", "fallback_models": ' ||
          CASE WHEN doc_id % 2 = 0 THEN '[{{"base_url": "http://localhost:1234", "model": "b", "provider": "openai_compatible"}}]' ELSE '[]' END ||
          ', "model": "m' || doc_id % 3 || '", "provider": "openai_compatible", "summary_pipeline": "{K.PIPELINE_VERSION}", "summary_prompt": "' ||
          substr(sha256(text), 1, 16) || '"}}'), 1, 20) AS context FROM documents""",
)
def cache_context(spark, sf):
    doc = F.col("doc_id")
    backup = F.struct(
        F.lit("openai_compatible").alias("provider"), F.lit("b").alias("model"), F.lit("http://localhost:1234/").alias("base_url")
    )
    fallbacks = F.when(doc % 2 == 0, F.array(backup)).otherwise(F.filter(F.array(backup), lambda item: F.lit(False)))
    context = C.cache_context(
        F.lit("openai_compatible"), F.concat(F.lit("m"), (doc % 3).cast("string")),
        F.concat(F.lit("https://api.example.org/v"), (doc % 7).cast("string"), F.lit("/")), F.col("text"), fallbacks,
    )
    return view(spark, sf, "documents").select("doc_id", context.alias("context"))


@query("cache_key", f"SELECT event_id, {_KEY} AS cache_key FROM v_submissions")
def cache_key(spark, sf):
    return view(spark, sf, "v_submissions").select("event_id", _key().alias("cache_key"))


_CONTENT_KEY = """'local://document/' || sha256(title || chr(0) || content_text ||
    CASE WHEN source_type = 'feishu_document' THEN chr(0) || source_type || chr(0) || canonical_url ELSE '' END)"""
_UPLOADS = "SELECT doc_id, 'Doc' AS title, content_text, CASE WHEN source_type = 'feishu_document' THEN source_type ELSE 'local_file' END AS source_type, canonical_url FROM v_docs"


@query("content_key", f"SELECT doc_id, {_CONTENT_KEY} AS content_key FROM ({_UPLOADS})")
def content_key(spark, sf):
    return _uploads(spark, sf).select(
        "doc_id", C.content_key(F.col("title"), F.col("content_text"), F.col("source_type"), F.col("source_url")).alias("content_key")
    )


def _uploads(spark, sf):
    kind = F.when(F.col("source_type") == "feishu_document", F.col("source_type")).otherwise("local_file")
    return view(spark, sf, "v_docs").select(
        "doc_id", F.lit("Doc").alias("title"), "content_text", kind.alias("source_type"), F.col("canonical_url").alias("source_url")
    )


@query(
    "cache_lookup",
    f"""WITH cached AS ({_CACHED}), usable AS (SELECT cache_key, result_json FROM cached WHERE updated_at >= TIMESTAMP '{_NOW}' - INTERVAL 14 DAY
            AND json_extract_string(result_json, '$.output_markdown_path') IN (SELECT relative_path FROM v_library))
        SELECT r.job_id, u.result_json, u.result_json IS NOT NULL AS hit FROM (SELECT job_id, force_refresh, {_KEY} AS cache_key FROM v_submissions) r
        LEFT JOIN usable u ON u.cache_key = r.cache_key AND NOT r.force_refresh""",
)
def cache_lookup(spark, sf):
    requests = view(spark, sf, "v_submissions").select("job_id", "force_refresh", _key().alias("cache_key"))
    found = C.cache_lookup(requests, _cache(spark, sf), view(spark, sf, "v_library"), _TTL, _NOW)
    return found.select("job_id", "result_json", "hit")


@query(
    "cache_evictions",
    f"""WITH cached AS ({_CACHED}) SELECT cache_key, title FROM cached WHERE updated_at >= TIMESTAMP '{_NOW}' - INTERVAL 14 DAY
          AND json_extract_string(result_json, '$.output_markdown_path') NOT IN (SELECT relative_path FROM v_library)
          AND cache_key IN (SELECT {_KEY} FROM v_submissions WHERE NOT force_refresh)""",
)
def cache_evictions(spark, sf):
    requests = view(spark, sf, "v_submissions").select("force_refresh", _key().alias("cache_key"))
    return C.cache_evictions(requests, _cache(spark, sf), view(spark, sf, "v_library"), _TTL, _NOW).select("cache_key", "title")


@query(
    "cache_upsert",
    f"""WITH keyed AS (SELECT {_KEY} AS cache_key, instruction, title, created_at, CASE WHEN event_id % 16 < 8 THEN 0 ELSE 1 END AS turn
            FROM v_jobs WHERE status = 'succeeded')
        SELECT cache_key, arg_min(instruction, (turn, created_at)) AS instruction, arg_max(title, (turn, created_at)) AS title,
          strftime(arg_min(created_at, (turn, created_at)), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(arg_max(created_at, (turn, created_at)), '%Y-%m-%d %H:%M:%S') AS updated_at FROM keyed GROUP BY cache_key""",
)
def cache_upsert(spark, sf):
    """Half of the finished jobs are already cached, the rest are new results; page URLs occur in both."""
    done = view(spark, sf, "v_jobs").filter("status = 'succeeded'").select(
        "event_id", _key().alias("cache_key"), "canonical_url", "instruction", "title", "result_json",
        "created_at", F.col("created_at").alias("updated_at"),
    )
    merged = C.cache_upsert(done.filter("event_id % 16 < 8").drop("event_id"), done.filter("event_id % 16 >= 8").drop("event_id"))
    return merged.select("cache_key", "instruction", "title", *[F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name) for name in ("created_at", "updated_at")])


@query(
    "cache_report",
    f"""SELECT {_SOURCE} AS source_type, summary_quality, count(*) FILTER (WHERE event_id % 4 = 1) AS hits, count(*) FILTER (WHERE event_id % 4 <> 1) AS misses,
          count(*) FILTER (WHERE force_refresh) AS forced FROM v_jobs WHERE status = 'succeeded' GROUP BY 1, 2""",
)
def cache_report(spark, sf):
    return C.cache_report(view(spark, sf, "v_jobs"))


@query(
    "duplicate_documents",
    f"""SELECT content_key, min(doc_id) AS first_doc, count(*) AS copies, count(*) - 1 AS avoidable FROM (SELECT doc_id, {_CONTENT_KEY} AS content_key FROM ({_UPLOADS}))
        GROUP BY content_key HAVING count(*) > 1""",
)
def duplicate_documents(spark, sf):
    return C.duplicate_documents(_uploads(spark, sf))
