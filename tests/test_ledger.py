"""Jobs, batches, cache, retention and notifications on literal rows."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from digestmill import schemas as S
from digestmill.operators import batches as B
from digestmill.operators import cache as C
from digestmill.operators import catalog as M
from digestmill.operators import ledger as J
from digestmill.operators import notify as N
from digestmill.operators import quality as Q
from digestmill.operators import retention as R

EVENT = {"submit": ("queued", "received", 0.0), "progress": ("running", "extracting", 0.25), "succeed": ("succeeded", "done", 1.0), "fail": ("failed", "failed", None), "cancel": ("canceled", "canceled", 0.0)}


def events(spark, *ops):
    import datetime as dt

    rows = []
    for i, (job, op) in enumerate(ops):
        status, stage, progress = EVENT[op]
        code = {"fail": "invalid_url", "cancel": "canceled"}.get(op)
        rows.append((i, job, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), op, status, stage, progress, f"T{i}" if op == "succeed" else None, code, code and f"m{i}"))
    return spark.createDataFrame(rows, S.JOB_EVENTS)


def state(frame):
    return {row["job_id"]: row for row in frame.collect()}


def test_cancel_guard(spark):
    jobs = state(J.fold_jobs(events(spark, ("a", "submit"), ("a", "cancel"), ("a", "succeed"), ("b", "fail"), ("b", "succeed"), ("b", "progress"), ("c", "succeed"), ("c", "cancel"))))
    assert (jobs["a"]["status"], jobs["a"]["title"], jobs["a"]["error_code"]) == ("canceled", None, "canceled")
    assert (jobs["b"]["status"], jobs["b"]["title"], jobs["b"]["error_code"]) == ("running", "T4", None)
    assert (jobs["c"]["status"], jobs["c"]["title"], jobs["c"]["progress"]) == ("canceled", "T6", 0.0)


@pytest.mark.parametrize("cut", [1, 3, 5])
def test_folding_deltas_equals_folding_events(spark, cut):
    all_events = events(spark, ("a", "submit"), ("a", "fail"), ("b", "succeed"), ("a", "progress"), ("b", "cancel"), ("a", "cancel"), ("a", "succeed"), ("b", "succeed"), ("b", "cancel"), ("b", "fail"), ("c", "fail"), ("c", "succeed"))
    parts = J.job_deltas(all_events.filter(F.col("event_id") < cut)).unionByName(J.job_deltas(all_events.filter(F.col("event_id") >= cut)))
    key = lambda frame: sorted(map(str, frame.collect()))
    assert key(J.fold_jobs(parts)) == key(J.fold_jobs(all_events))


def test_random_micro_batches_fold_like_one(spark):
    """Late, reordered and canceled events, cut at random, against a plain fold."""
    random.seed(8)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for number in range(400):
        op = random.choice(["submit", "progress", "progress", "succeed", "fail", "cancel"] if random.random() < 0.4 else ["submit", "progress", "fail"])
        rows.append((number, f"j{random.randint(0, 20)}", start + dt.timedelta(seconds=random.randint(0, 60)), op, random.choice([None, op]), random.choice([None, "s"]), random.choice([None, 0.5]), random.choice([None, f"t{number}"]), random.choice([None, "e"]), random.choice([None, f"m{number}"])))
    schema = "event_id LONG, job_id STRING, ts TIMESTAMP, op STRING, status STRING, stage STRING, progress DOUBLE, title STRING, error_code STRING, error_message STRING"
    frame = spark.createDataFrame(rows, schema)
    log = J.job_deltas(frame.filter("event_id % 3 = 1")).unionByName(J.job_deltas(frame.filter("event_id % 3 = 0"))).unionByName(J.job_deltas(frame.filter("event_id % 3 = 2")))
    expected = {}
    for row in sorted(rows, key=lambda row: (row[2], row[0])):
        state = expected.setdefault(row[1], {"canceled": False, "n": 0, "first": row[2]})
        if state["canceled"] and row[3] != "cancel":
            continue
        state["canceled"] |= row[3] == "cancel"
        state["n"] += 1
        state["last"] = row[2]
        state |= {name: value for name, value in zip(("status", "stage", "progress", "title"), row[4:8], strict=True) if value is not None}
        if row[3] in ("succeed", "fail", "cancel"):
            state |= {"error_code": row[8], "error_message": row[9]}
    got = {row["job_id"]: row for row in J.fold_jobs(log).collect()}
    assert set(got) == set(expected)
    for job, state in expected.items():
        row = got[job]
        assert (row["applied_events"], row["created_at"], row["updated_at"]) == (state["n"], state["first"], state["last"]), job
        assert all(row[name] == state.get(name) for name in ("status", "stage", "progress", "title", "error_code", "error_message")), job


def test_one_hot_job_is_split(spark):
    frame = spark.range(5000).selectExpr(
        "id AS event_id", "CASE WHEN id % 5 = 0 THEN concat('j', id) ELSE 'hot' END AS job_id", "timestamp_seconds(id) AS ts", "CASE WHEN id = 4999 THEN 'cancel' ELSE 'progress' END AS op", "'running' AS status",
        "CAST(NULL AS STRING) AS stage", "CAST(id AS DOUBLE) AS progress", "CAST(NULL AS STRING) AS title", "CAST(NULL AS STRING) AS error_code", "CAST(NULL AS STRING) AS error_message",
    )
    folded = J.fold_jobs(frame)
    row = folded.filter("job_id = 'hot'").collect()[0]
    assert (row["applied_events"], row["progress"]) == (4000, 4999.0)
    plan = folded._jdf.queryExecution().optimizedPlan().toString()  # joined on the job and its part
    assert "salt" in plan.split("Join")[1].split("\n")[0]


def test_lists_are_whole_unless_a_limit_is_given(spark):
    jobs = events(spark, *[("j%d" % i, "submit") for i in range(130)]).select("job_id", "status", F.lit("link").alias("request_kind"), F.col("ts").alias("created_at"))
    assert J.list_jobs(jobs).count() == J.queue_active(jobs).count() == 130
    assert J.list_jobs(jobs, limit=100).count() == 100 and J.list_jobs(jobs, limit=0).count() == 1 and J.queue_active(jobs, 7).count() == 7
    row = J.queue_status(jobs).collect()[0]
    assert (row["active_count"], row["active_returned"], row["active_limited"]) == (130, 130, False)
    row = J.queue_status(jobs, limit=100).collect()[0]
    assert (row["active_count"], row["active_returned"], row["active_limited"]) == (130, 100, True)


def test_batch_status_rules(spark):
    jobs = spark.createDataFrame([("s", "succeeded"), ("f", "failed"), ("c", "canceled"), ("q", "queued")], "job_id STRING, status STRING")
    batches = {1: "sss", 2: "ff", 3: "sq", 4: "cc", 5: "s?", 6: "??", 7: "f?"}
    members = [(b, i, job) for b, ids in batches.items() for i, job in enumerate(ids)]
    found = {r["batch_id"]: r["status"] for r in B.batch_status(spark.createDataFrame(members, S.BATCH_MEMBERS), jobs).collect()}
    assert found == {1: "succeeded", 2: "failed", 3: "partial", 4: "running", 5: "partial", 6: "running", 7: "partial"}


def test_cache_context_equals_sorted_json(spark, one):
    context = C.cache_context(F.lit("openai_compatible"), F.lit("m"), F.lit("https://x/v1/"), F.lit("prompt"), F.array(F.struct(F.lit("p").alias("provider"), F.lit("b").alias("model"), F.lit("u/").alias("base_url"))), "v1")
    payload = {
        "provider": "openai_compatible", "model": "m", "base_url": "https://x/v1", "summary_prompt": hashlib.sha256(b"prompt").hexdigest()[:16],
        "summary_pipeline": "v1", "fallback_models": [{"provider": "p", "model": "b", "base_url": "u"}],
    }
    assert one(context) == hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:20]


def test_cache_hit_rules(spark):
    key = lambda context: f"u\n\nquality=fast\ncontext={context}"
    cache = spark.createDataFrame(
        [(key("a"), "u", "", "T", '{"output_markdown_path":"p.md"}', "2024-01-01 00:00:00"), (key("gone"), "u", "", "T", '{"output_markdown_path":"x.md"}', "2024-01-01 00:00:00")],
        "cache_key STRING, canonical_url STRING, instruction STRING, title STRING, result_json STRING, updated_at STRING",
    ).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    requests = spark.createDataFrame([("same", key("a"), False), ("model", key("b"), False), ("forced", key("a"), True), ("lost", key("gone"), False)], "job_id STRING, cache_key STRING, force_refresh BOOLEAN")
    library = spark.createDataFrame([("p.md",)], "relative_path STRING")

    def hits(now, ttl=604800):
        return {row["job_id"] for row in C.cache_lookup(requests, cache, library, ttl, now).filter("hit").collect()}

    assert hits("2024-01-08 00:00:00") == {"same"}
    assert hits("2024-01-08 00:00:01") == set() and hits("2024-01-01 00:00:00", 0) == set()
    assert [row["cache_key"] for row in C.cache_evictions(requests, cache, library, 604800, "2024-01-02 00:00:00").collect()] == [key("gone")]


def test_upsert_keeps_creation(spark):
    schema = "cache_key STRING, canonical_url STRING, instruction STRING, title STRING, result_json STRING, created_at INT, updated_at INT"
    row = C.cache_upsert(spark.createDataFrame([("k", "u", "old", "A", "1", 1, 9)], schema), spark.createDataFrame([("k", "u", "new", "B", "2", 5, 5)], schema)).collect()[0]
    assert (row["instruction"], row["title"], row["result_json"], row["created_at"], row["updated_at"]) == ("old", "B", "2", 1, 5)


def test_argument_order_decides_the_first_violation(spark):
    requests = spark.createDataFrame([(1, "get_job", '{"wait_seconds":"x","job_id":""}'), (2, "get_job", '{"job_id":"","wait_seconds":"x"}'), (3, None, "{}"), (4, "cleanup", '{"days":1.5}')], "request_id INT, tool STRING, args STRING")
    found = {row["request_id"]: row["violation"] for row in J.validate_requests(requests).collect()}
    assert found[1].endswith("'wait_seconds' must be integer.") and found[2].endswith("'job_id' must not be empty.")
    assert found[3] == "Unknown tool: None" and found[4].endswith("'days' must be integer.")


def test_retention(spark):
    rows = spark.createDataFrame([("old", "2024-01-01"), ("new", "2024-01-30")], "path STRING, updated_at STRING").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    dates, jobs = rows.withColumnRenamed("path", "date"), rows.withColumnRenamed("path", "job_id")
    now = F.lit("2024-01-31").cast("timestamp")
    dry = R.retention_preview(rows, dates, jobs, now=now)
    assert [(r["category"], r["item"], r["removed"]) for r in dry.collect()] == [("outputs", "old", False), ("temp", "old", False)]
    assert R.retention_apply(jobs, "job_id", "jobs", dry).count() == 2
    applied = R.retention_preview(rows, dates, jobs, now=now, dry_run=False, include_jobs=True)
    assert [r["job_id"] for r in R.retention_apply(jobs, "job_id", "jobs", applied).collect()] == ["new"]
    with pytest.raises(ValueError, match="unsafe_cleanup_window"):
        R.retention_preview(rows, dates, jobs, days=0, dry_run=False)


def test_notification_payload(spark):
    changes = spark.createDataFrame([("j", "succeeded", "T", "", "body", "key"), ("k", "running", "T", "", "body", "key")], "job_id STRING, status STRING, title STRING, error_message STRING, source_text STRING, api_key STRING")
    rows = N.notification_feed(changes, ["job.succeeded"]).collect()
    payload = json.loads(rows[0]["payload"])
    assert len(rows) == 1 and payload.pop("occurred_at").endswith("+00:00") and payload == {"job_id": "j", "status": "succeeded", "title": "T", "event": "job.succeeded"}


def catalog(spark, payload, cached=None, force=False, style="openai", key=True):
    providers = spark.createDataFrame([("s", True, key, ["MiniMax-M2.7"], style)], "service_id STRING, requires_api_key BOOLEAN, has_key BOOLEAN, models ARRAY<STRING>, style STRING")
    discovered = spark.createDataFrame([("s", payload)], "service_id STRING, payload STRING")
    stored = spark.createDataFrame([("s", *cached)] if cached else [], "service_id STRING, cached_at DOUBLE, cached_ids ARRAY<STRING>")
    return M.model_catalog(providers, discovered, stored, F.lit(100000.0), force).collect()[0]


def test_model_catalog(spark):
    reply = json.dumps({"data": [{"id": "MiniMax-M3"}, {"id": "speech-2.8-hd"}, {"id": "MiniMax-M2.7"}, {"id": "MiniMax-M3"}]})
    live = catalog(spark, reply)
    assert (live["status"], live["model_ids"], live["additional_model_ids"]) == ("live", ["MiniMax-M3", "MiniMax-M2.7"], ["MiniMax-M3"])
    fresh, stale = (99000.0, ["c"]), (1.0, ["c"])
    assert catalog(spark, reply, fresh)["status"] == "cached" and catalog(spark, reply, fresh, force=True)["status"] == "live"
    assert catalog(spark, None, stale)["status"] == "fallback" and catalog(spark, None, stale)["model_ids"] == ["c"]
    assert catalog(spark, reply, key=False)["status"] == "key_required" and catalog(spark, reply, style=None)["status"] == "built_in"


def test_model_discovery_styles(spark, one):
    gemini = {"models": [{"name": "models/g-pro", "supportedGenerationMethods": ["generateContent"]}, {"name": "models/e", "supportedGenerationMethods": ["embedContent"]}, {"baseModelId": "g-flash", "supported_actions": ["generateContent"]}]}
    assert one(M.discovered_ids(F.lit(json.dumps(gemini)), F.lit("gemini"))) == ["g-pro", "g-flash"]
    assert one(M.discovered_ids(F.lit('{"models":[{"model":"llama3"},{"name":"qwen"}]}'), F.lit("ollama"))) == ["llama3", "qwen"]


def test_regression_sample_passes_every_check(spark):
    text = "你好世界，这是一个足够长的转写文本。"
    samples = spark.createDataFrame(
        [("s", ["platform_subtitle"], ["bilibili_subtitle"], ["zh"], "BV1", 1.03, "zh", 1, "ref.txt", 0.1)],
        "id STRING, expected_transcript_origins ARRAY<STRING>, expected_subtitle_statuses ARRAY<STRING>, expected_subtitle_languages ARRAY<STRING>, expected_bvid STRING, maximum_duration_ratio DOUBLE, expected_summary_language STRING, minimum_core_points INT, reference_transcript STRING, maximum_character_error_rate DOUBLE",
    )
    results = spark.createDataFrame(
        [("s", "succeeded", None, "platform_subtitle", "bilibili_subtitle", "zh-CN", "BV1", 1.0, "## 核心要点\n- 要点\n## 核心要点时间轴\n- 要点", text, "[00:00] " + text, 4.0)],
        "id STRING, status STRING, error_message STRING, transcript_origin STRING, subtitle_status STRING, subtitle_language STRING, bvid STRING, duration_ratio DOUBLE, summary_markdown STRING, reference STRING, hypothesis STRING, duration DOUBLE",
    )
    checks = Q.regression_checks(samples, results)
    rows = {row["name"]: row["ok"] for row in checks.collect()}
    assert len(rows) == 11 and all(rows.values())
    assert Q.regression_suite(Q.regression_report(checks)).collect()[0]["ok"]
    assert not Q.regression_suite(Q.regression_report(checks.limit(0))).collect()[0]["ok"]
