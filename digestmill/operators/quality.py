"""Regression checks, library quality, health roll-up, evidence of model generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import digest as D
from digestmill.functions import text as T
from digestmill.functions.scale import exploded
from digestmill.operators.transcripts import evaluate_asr


def regression_checks(samples: DataFrame, results: DataFrame) -> DataFrame:
    """``id, name, ok, detail``: the checks that apply to each sample.

    ``results`` has one row per sample ``id``: ``status, error_message, transcript_origin,
    subtitle_status, subtitle_language, bvid, duration_ratio, summary_markdown, reference, hypothesis, duration``.
    A sample without a result is judged as not finished.
    """
    pairs = results.filter("reference IS NOT NULL AND hypothesis IS NOT NULL").withColumn("doc_id", F.col("id"))
    scored = evaluate_asr(pairs.select("doc_id", "reference", "hypothesis", "duration")).select(
        F.col("doc_id").alias("id"), F.col("character_error_rate").alias("cer")
    )
    rows = samples.join(results, "id", "left").join(scored, "id", "left")

    def actual(value: Column) -> Column:
        return F.concat(F.lit("actual="), F.coalesce(value.cast("string"), F.lit("None")))

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    status = F.coalesce(F.col("status"), F.lit("None"))
    origin = T.first_present(F.col("transcript_origin"), F.lit("none"))
    markdown = text("summary_markdown")
    points, timeline = T.section_items(markdown, K.CORE_POINTS), T.section_items(markdown, K.CORE_TIMELINE)
    least = F.coalesce(F.col("minimum_core_points"), F.lit(0))

    def check(name: str, applies: Column, ok: Column, detail: Column) -> Column:
        return F.struct(applies.alias("applies"), F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))

    def listed(name: str) -> Column:
        return F.coalesce(F.size(F.col(name)) > 0, F.lit(False))

    always = F.lit(True)
    wanted_bvid = text("expected_bvid") != ""
    language = F.lower(text("subtitle_language"))
    checks = F.array(
        check("terminal_status", always, F.col("status").isin("succeeded", "failed", "canceled"), status),
        check("succeeded", always, F.col("status") == "succeeded", T.first_present(F.col("error_message"), status)),
        check("transcript_origin", listed("expected_transcript_origins"), F.array_contains("expected_transcript_origins", origin), actual(origin)),
        check(
            "subtitle_status", listed("expected_subtitle_statuses"), F.array_contains("expected_subtitle_statuses", text("subtitle_status")),
            actual(text("subtitle_status")),
        ),
        check(
            "subtitle_language", listed("expected_subtitle_languages"),
            F.exists("expected_subtitle_languages", lambda item: F.startswith(language, F.lower(item))), actual(text("subtitle_language")),
        ),
        check("bvid", wanted_bvid, text("bvid") == F.col("expected_bvid"), actual(F.col("bvid"))),
        check(
            "subtitle_duration_ratio", F.col("maximum_duration_ratio").isNotNull(), F.col("duration_ratio") <= F.col("maximum_duration_ratio"),
            actual(F.col("duration_ratio")),
        ),
        check(
            "chinese_summary", text("expected_summary_language") == "zh", T.char_ratio(markdown) >= 0.05,
            F.lit("summary must contain meaningful Chinese text"),
        ),
        check("core_points", least > 0, points >= least, actual(points)),
        check(
            "timeline_matches_core_points", least > 0, timeline == points,
            F.concat(F.lit("timeline="), timeline.cast("string"), F.lit(", core="), points.cast("string")),
        ),
        check(
            "asr_character_error_rate", F.col("cer").isNotNull() & (text("reference_transcript") != ""),
            F.col("cer") <= F.coalesce(F.col("maximum_character_error_rate"), F.lit(1.0)), actual(F.col("cer")),
        ),
    )
    return exploded(rows, ["id"], F.filter(checks, lambda c: c["applies"]), "c").select("id", "c.name", "c.ok", "c.detail")


def regression_report(checks: DataFrame) -> DataFrame:
    """``id, ok, checks`` per sample; a sample is ok when all of its checks are."""
    return checks.groupBy("id").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("checks"))


def regression_suite(report: DataFrame) -> DataFrame:
    """One row ``ok, sample_count``; an empty suite is not ok."""
    return report.agg(
        F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"), F.count("*").alias("sample_count")
    )


def library_quality(digests: DataFrame) -> DataFrame:
    """Roll-up per source type of digests ``(source_type, summary_markdown, confidence)``."""
    markdown = F.col("summary_markdown")
    rows = digests.select(
        "source_type", "confidence", T.section_items(markdown, K.CORE_POINTS).alias("points"),
        T.section_items(markdown, K.CORE_TIMELINE).alias("timeline"), F.size(D.missing_sections(markdown)).alias("missing"),
        F.length(F.regexp_replace(markdown, f"[^{T.CJK}]+", "")).alias("cjk"), F.length(F.regexp_replace(markdown, T.WS + "+", "")).alias("solid"),
    )
    return rows.groupBy("source_type").agg(
        F.count("*").alias("digests"), F.sum("points").alias("core_points"), F.count_if(F.col("points") == F.col("timeline")).alias("matched_timelines"),
        F.sum("missing").alias("missing_sections"), F.sum("cjk").alias("cjk_chars"), F.sum("solid").alias("solid_chars"),
        F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "medium").alias("medium"),
        F.count_if(F.col("confidence") == "low").alias("low"), F.count_if(F.col("confidence") == "none").alias("none"),
    )


def generation_evidence(body: Column) -> Column:
    """Whether a model response shows that the model generated something."""

    def get(value: Column, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(value, path, kind)

    def filled(value: Column) -> Column:
        schema = F.schema_of_variant(value)
        some_list = F.size(get(value, "$", "array<variant>")) > 0
        some_map = F.size(F.map_keys(get(value, "$", "map<string,variant>"))) > 0
        return F.coalesce(
            F.when(schema == "STRING", T.strip(get(value, "$", "string")) != "").when(F.startswith(schema, F.lit("ARRAY")), some_list).when(
                F.startswith(schema, F.lit("OBJECT")), some_map
            ),
            F.lit(False),
        )

    def reasoned(message: Column) -> Column:
        return filled(get(message, "$.reasoning_content")) | filled(get(message, "$.reasoning_details")) | filled(get(message, "$.reasoning"))

    def tokens(data: Column, name: str) -> Column:
        value = get(data, f"$.usage.{name}.reasoning_tokens")
        numeric = F.rlike(F.schema_of_variant(value), F.lit("^(?:BIGINT|DECIMAL|DOUBLE)"))
        return F.coalesce(numeric & (get(data, f"$.usage.{name}.reasoning_tokens", "double") > 0), F.lit(False))

    def judge(data: Column) -> Column:
        choices = F.coalesce(get(data, "$.choices", "array<variant>"), F.array().cast("array<variant>"))
        output = F.coalesce(get(data, "$.output", "array<variant>"), F.array().cast("array<variant>"))
        said = F.exists(choices, lambda choice: reasoned(get(choice, "$.message")))
        item = F.exists(output, lambda part: F.coalesce(get(part, "$.type", "string") == "reasoning", F.lit(False)))
        return said | item | tokens(data, "completion_tokens_details") | tokens(data, "output_tokens_details")

    return T.let(F.try_parse_json(body), judge)


def health_rollup(checks: DataFrame) -> DataFrame:
    """Per host: healthy when every required check is ok."""
    return checks.groupBy("host").agg(
        F.bool_and(F.col("ok") | ~F.col("required")).alias("ok"), F.count("*").alias("checks"),
        F.count_if(F.col("required") & ~F.col("ok")).alias("failed_required"),
    )
