"""Job ledger: state folded from events, lists, counts, recovery, retries, request checks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions.scale import newest
from digestmill.functions.text import first_match, strip
from digestmill.operators.urls import summary_quality


# Parts that the events of one job are dealt over until they are folded to one state each.
SALTS = 32
_PLAIN_FIELDS = ("status", "stage", "progress", "title")
_OUTCOME_FIELDS = ("error_code", "error_message")


def applied_events(events: DataFrame, canceled: DataFrame | None = None) -> DataFrame:
    """Events that count, with ``at`` and ``salt``: once a job is canceled, only another cancel may change it.

    The first cancel of each canceled job, of these events or of ``canceled`` (``job_id, canceled_at``), is sent to every
    part of the job, so that the events meet it on (job, part) and a job with very many events is split.
    """
    dealt = events.withColumn("at", F.struct("ts", "event_id")).withColumn("salt", F.pmod(F.xxhash64("event_id", "ts"), F.lit(SALTS)).cast("int"))
    cancels = dealt.filter("op = 'cancel'").groupBy("job_id").agg(F.min("at").alias("canceled_at"))
    if canceled is not None:
        cancels = cancels.unionByName(canceled).groupBy("job_id").agg(F.min("canceled_at").alias("canceled_at"))
    everywhere = cancels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(everywhere, ["job_id", "salt"], "left").filter(
        F.col("canceled_at").isNull() | (F.col("at") <= F.col("canceled_at")) | (F.col("op") == "cancel")
    )


def _writes() -> dict[str, Column]:
    """When an event writes a field; an outcome event writes the error fields even when they are NULL."""
    writes = {name: F.col(name).isNotNull() for name in _PLAIN_FIELDS}
    return writes | {name: F.col("op").isin("succeed", "fail", "cancel") for name in _OUTCOME_FIELDS}


def job_states(events: DataFrame, canceled: DataFrame | None = None) -> DataFrame:
    """One state per job that can be merged with others: each field's last write with its time, and the times of the job.

    ``plain_at`` is the last event that a cancel could still take back, ``canceled_at`` the first cancel. Events are
    folded to one state per job and part, and states again by job; no raw event is grouped by its job alone.
    """
    parts = [F.max(F.when(wrote, F.struct(F.col("at"), F.struct(F.col(name).alias("value")).alias("write")))).alias(f"last_{name}") for name, wrote in _writes().items()]
    is_cancel = F.col("op") == "cancel"
    states = applied_events(events, canceled).groupBy("job_id", "salt").agg(
        *parts, F.max(F.when(~is_cancel, F.col("at"))).alias("plain_at"), F.min(F.when(is_cancel, F.col("at"))).alias("canceled_at"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"),
    )
    return merge_states(states.drop("salt"))


def merge_states(states: DataFrame) -> DataFrame:
    """States of the same jobs put together."""
    return states.groupBy("job_id").agg(
        *(F.max(f"last_{name}").alias(f"last_{name}") for name in _writes()), F.max("plain_at").alias("plain_at"), F.min("canceled_at").alias("canceled_at"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_events").alias("n_events"),
    )


def job_fields(states: DataFrame) -> DataFrame:
    """The fields of each job from its state."""
    return states.select(
        "job_id", *(F.col(f"last_{name}")["write"]["value"].alias(name) for name in _writes()), F.col("first_ts").alias("created_at"),
        F.col("last_ts").alias("updated_at"), F.col("n_events").alias("applied_events"),
    )


def fold_jobs(events: DataFrame) -> DataFrame:
    """Current state of each job from its events: the last write per field wins, with the cancel guard."""
    return job_fields(job_states(events))


def job_deltas(events: DataFrame) -> DataFrame:
    """What a micro-batch adds to the log: its events, without columns that no state depends on.

    Folding the log gives what folding all events gives, whatever order they arrived in.
    """
    return events.select("event_id", "job_id", "ts", "op", *_PLAIN_FIELDS, *_OUTCOME_FIELDS)


def _kind(jobs: DataFrame, kind: str | None, not_kind: str | None) -> DataFrame:
    if kind:
        return jobs.filter(F.col("request_kind") == kind)
    return jobs.filter(F.col("request_kind") != not_kind) if not_kind else jobs


def list_jobs(
    jobs: DataFrame, limit: int | None = None, status: str | None = None, kind: str | None = None, not_kind: str | None = None
) -> DataFrame:
    """Jobs, newest first: all, or ``limit`` of them. Equal times are ordered by job id."""
    chosen = _kind(jobs, kind, not_kind)
    chosen = chosen.filter(F.col("status") == status) if status else chosen
    return newest(chosen, [F.desc("created_at"), F.desc("job_id")], limit)


def status_counts(jobs: DataFrame, kind: str | None = None, not_kind: str | None = None) -> DataFrame:
    return _kind(jobs, kind, not_kind).groupBy("status").agg(F.count("*").alias("n"))


def queue_active(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Running jobs, then queued jobs, newest first: all, or ``limit`` of them together."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1)
    waiting = _kind(jobs, None, "media_download").withColumn("queue_rank", rank).filter("queue_rank IS NOT NULL")
    return newest(waiting, ["queue_rank", F.desc("created_at"), F.desc("job_id")], limit)


def queue_status(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """One row with the queue totals next to what ``queue_active`` would return."""
    counted = _kind(jobs, None, "media_download").agg(
        F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "queued").alias("queued"),
        F.count("*").alias("total"),
    )
    active = F.col("running") + F.col("queued")
    returned = active if limit is None else F.least(active, F.lit(limit))
    limited = F.lit(False) if limit is None else active > limit
    return counted.select(
        "running", "queued", "total", active.alias("active_count"), returned.cast("bigint").alias("active_returned"), limited.alias("active_limited")
    )


def _payload(jobs: DataFrame) -> Column:
    """Request payload as a struct; a malformed one is an empty struct."""
    return F.from_json(
        "request_payload_json",
        "url STRING, title STRING, content STRING, media_type STRING, format STRING, metadata STRING",
    )


def _result(jobs: DataFrame) -> Column:
    return F.from_json(
        "result_json",
        "output_markdown_path STRING, resource_package_path STRING, summary_quality STRING, cache_hit BOOLEAN, "
        "source STRUCT<title: STRING, content_text: STRING>",
    )


def recoverable(jobs: DataFrame) -> DataFrame:
    """What a restart does with unfinished jobs: ``outcome`` is ``requeued`` or ``interrupted``."""
    open_jobs = jobs.filter(F.col("status").isin("queued", "running")).withColumn("payload", _payload(jobs))
    url = F.coalesce(F.nullif(F.col("payload.url"), F.lit("")), F.col("url"), F.lit(""))
    kind = F.coalesce(F.nullif(F.col("request_kind"), F.lit("")), F.lit("link"))
    replayable = first_match(
        [
            (kind == "link", (url != "") & ~F.startswith(url, F.lit("local://"))),
            (kind == "document", F.coalesce(F.col("payload.content") != "", F.lit(False))),
            (kind == "media_download", url != ""),
        ],
        F.lit(False),
    )
    outcome = F.when(replayable, "requeued").otherwise("interrupted")
    return (
        open_jobs.withColumn("outcome", outcome)
        .withColumn("status", F.when(replayable, "queued").otherwise("failed"))
        .withColumn("stage", F.when(replayable, "recovered").otherwise("interrupted"))
        .withColumn("progress", F.lit(0.0))
        .withColumn("error_code", F.when(~replayable, F.lit("interrupted")))
        .drop("payload")
    )


def retry_requests(jobs: DataFrame, overrides: DataFrame) -> DataFrame:
    """New requests for the jobs named in ``overrides(job_id, instruction, summary_quality, force_refresh)``.

    NULL override fields keep the original value. Media downloads are not retried here.
    """
    named = overrides.select(
        "job_id", F.col("instruction").alias("o_instruction"), F.col("summary_quality").alias("o_quality"),
        F.col("force_refresh").alias("o_force"),
    )
    joined = (
        jobs.filter("request_kind <> 'media_download'").join(named, "job_id")
        .withColumn("payload", _payload(jobs)).withColumn("result", _result(jobs))
    )
    replay_payload = (F.col("request_kind") == "document") & F.coalesce(F.col("payload.content") != "", F.lit(False))
    replay_source = F.startswith("url", F.lit("local://")) & F.coalesce(F.col("result.source.content_text") != "", F.lit(False))

    def some(*columns: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(column), F.lit("")) for column in columns])

    content = F.when(replay_payload, F.col("payload.content")).when(replay_source, F.col("result.source.content_text"))
    title = F.when(replay_payload, some("payload.title", "title", "url")).when(replay_source, some("result.source.title", "title", "url"))
    return joined.select(
        F.col("job_id").alias("retry_of"),
        F.when(content.isNotNull(), "document").otherwise("link").alias("request_kind"),
        F.when(content.isNull(), F.col("url")).alias("url"), title.alias("title"), content.alias("content"),
        F.coalesce("o_instruction", "instruction", F.lit("")).alias("instruction"),
        summary_quality(some("o_quality", "result.summary_quality", "summary_quality")).alias("summary_quality"),
        F.coalesce("o_force", F.lit(True)).alias("force_refresh"),
    )


def default_next_steps(code: Column) -> Column:
    """Steps shown for an error code."""
    known = F.from_json(F.lit(json.dumps({key: list(steps) for key, steps in K.NEXT_STEPS.items()})), "map<string,array<string>>")
    other = F.array(*[F.lit(step) for step in K.NEXT_STEPS_OTHER])
    return F.coalesce(F.try_element_at(known, code), other)


def job_view(jobs: DataFrame) -> DataFrame:
    """Jobs with typed payloads; next steps are the stored list, else the default for the code."""
    stored = F.from_json("error_next_steps_json", "array<string>")
    steps = F.when(F.coalesce(F.col("error_next_steps_json") != "", F.lit(False)), stored).when(
        F.coalesce(F.col("error_code") != "", F.lit(False)), default_next_steps(F.col("error_code"))
    ).otherwise(F.array().cast("array<string>"))
    return (
        jobs.withColumn("error_next_steps", steps)
        .withColumn("request_payload", _payload(jobs))
        .withColumn("result", _result(jobs))
        .withColumn("force_refresh", F.coalesce("force_refresh", F.lit(False)))
        .drop("error_next_steps_json", "request_payload_json", "result_json")
    )


def document_gate(documents: DataFrame, title_chars: int | None = None) -> DataFrame:
    """Upload texts with their whole title, or its first ``title_chars``; too short texts carry an error code."""
    text = strip(F.coalesce("content", F.lit("")))
    whole = strip(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("local-document")))
    title = whole if title_chars is None else F.left(whole, F.lit(title_chars))
    short = F.length(text) < 20
    return (
        documents.withColumn("title", F.coalesce(F.nullif(title, F.lit("")), F.lit("local-document")))
        .withColumn("content", text)
        .withColumn("error_code", F.when(short, F.lit("invalid_document")))
        .withColumn("error_message", F.when(short, F.lit("Local document content is too short to summarize.")))
    )


def failure_report(jobs: DataFrame) -> DataFrame:
    failed = jobs.filter("status = 'failed'").groupBy("error_code").agg(F.count("*").alias("n"))
    return failed.withColumn("next_steps", default_next_steps(F.col("error_code")))


def progress_of(line: Column) -> Column:
    """Overall progress of a download line ``PROGRESS: 42.0%``: 0-100 % becomes 0.08-0.90."""
    percent = F.regexp_extract(line, r"PROGRESS:\s*([0-9]+(?:\.[0-9]+)?)%", 1).try_cast("double")
    return F.lit(0.08) + F.least(F.greatest(percent, F.lit(0.0)), F.lit(100.0)) / 100 * 0.82


def stage_progress(events: DataFrame) -> DataFrame:
    """Highest and lowest progress reported per stage."""
    return events.groupBy("stage").agg(
        F.count("*").alias("events"), F.min("progress").alias("lowest"), F.max("progress").alias("highest")
    )


# ---- request checks ------------------------------------------------------------------------

_RULE = (
    "STRUCT<field: STRING, type: STRING, required: BOOLEAN, choices: ARRAY<STRING>, minimum: BIGINT, maximum: BIGINT, item: STRING>"
)


def contract_map() -> Column:
    """The tool contract as one constant map: tool -> rules in order."""
    rules = {
        tool: [
            dict(zip(("field", "type", "required", "choices", "minimum", "maximum", "item"), rule, strict=True)) for rule in fields
        ]
        for tool, fields in K.TOOL_CONTRACT.items()
    }
    return F.from_json(F.lit(json.dumps(rules)), f"map<string,array<{_RULE}>>")


def _type_name(value: Column) -> Column:
    """JSON type of a variant as the contract names it."""
    schema = F.schema_of_variant(value)
    return first_match(
        [
            (schema == "STRING", "string"), (schema == "BOOLEAN", "boolean"), (F.startswith(schema, F.lit("ARRAY")), "array"),
            (F.startswith(schema, F.lit("OBJECT")), "object"), (schema == "BIGINT", "integer"),
            (F.rlike(schema, F.lit(r"^DECIMAL\([0-9]+,0\)$")) & ~F.contains(F.col("args"), F.lit(".")), "integer"),
        ],
        F.lit("other"),
    )


def validate_requests(requests: DataFrame, contract: Column | None = None) -> DataFrame:
    """First violation per request, or NULL.

    ``requests`` has ``request_id, tool, args`` (a JSON object). Rules are checked in the order:
    unknown tool, unknown field, missing field, then the given fields in their order.
    """
    rules = F.try_element_at(contract if contract is not None else contract_map(), F.col("tool"))
    prefix = F.concat(F.lit("Invalid arguments for "), F.col("tool"), F.lit(": "))
    parsed = requests.withColumn("rules", rules).withColumn(
        "given", F.map_entries(F.coalesce(F.from_json("args", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>")))
    )
    names = F.transform("given", lambda entry: entry["key"])
    unknown = F.array_sort(F.array_except(names, F.transform("rules", lambda rule: rule["field"])))
    missing = F.filter("rules", lambda rule: rule["required"] & ~F.array_contains(names, rule["field"]))

    def broken(entry: Column) -> Column:
        value = entry["value"]
        rule = F.filter("rules", lambda item: item["field"] == entry["key"])[0]
        kind = _type_name(value)
        text = F.try_variant_get(value, "$", "string")
        number = F.try_variant_get(value, "$", "bigint")
        items = F.try_variant_get(value, "$", "array<variant>")
        field = F.concat(F.lit("'"), entry["key"], F.lit("'"))
        empty = ((rule["type"] == "string") & (strip(text) == "")) | ((rule["type"] == "array") & (F.size(items) == 0))
        problem = first_match(
            [
                (kind != rule["type"], F.concat(field, F.lit(" must be "), rule["type"], F.lit("."))),
                (rule["required"] & empty, F.concat(field, F.lit(" must not be empty."))),
                (
                    rule["choices"].isNotNull() & ~F.array_contains(rule["choices"], text),
                    F.concat(field, F.lit(" must be one of "), F.array_join(rule["choices"], ", "), F.lit(".")),
                ),
                ((rule["type"] == "integer") & (number < rule["minimum"]), F.concat(field, F.lit(" is below the minimum."))),
                ((rule["type"] == "integer") & (number > rule["maximum"]), F.concat(field, F.lit(" is above the maximum."))),
                (
                    (rule["type"] == "array") & rule["item"].isNotNull()
                    & F.exists(items, lambda item: _type_name(item) != rule["item"]),
                    F.concat(F.lit("every "), field, F.lit(" item must be "), rule["item"], F.lit(".")),
                ),
            ]
        )
        return F.concat(prefix, problem)

    violations = F.filter(F.transform("given", broken), lambda message: message.isNotNull())
    message = first_match(
        [
            (F.col("rules").isNull(), F.concat(F.lit("Unknown tool: "), F.coalesce("tool", F.lit("None")))),
            (F.size(unknown) > 0, F.concat(prefix, F.lit("unknown field '"), F.try_element_at(unknown, F.lit(1)), F.lit("'."))),
            (F.size(missing) > 0, F.concat(prefix, F.lit("'"), F.try_element_at(missing, F.lit(1))["field"], F.lit("' is required."))),
        ],
        F.try_element_at(violations, F.lit(1)),
    )
    return parsed.select("request_id", "tool", "args", message.alias("violation"))
