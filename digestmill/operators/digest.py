"""Digests: extractive, prompted, and resolved from model attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import digest as D
from digestmill.functions import text as T
from digestmill.functions.scale import exploded


def _field(frame: DataFrame, name: str) -> Column:
    """A column, or NULL when the table does not have it."""
    return F.col(name) if name in frame.columns else F.lit(None).cast("string")


def sentences(documents: DataFrame) -> DataFrame:
    """``doc_id, seq, sentence``."""
    return exploded(documents, ["doc_id"], D.sentences(F.col("content_text")), "sentence", "seq")


def pick_sentences(documents: DataFrame, limit: int, skip: int = 0) -> DataFrame:
    picked = D.pick_sentences(D.sentences(F.col("content_text")), limit, skip)
    return exploded(documents, ["doc_id"], picked, "sentence", "seq")


def _provenance(frame: DataFrame) -> Column:
    return D.transcript_source(
        F.col("source_type"), _field(frame, "transcript_origin_label"), _field(frame, "subtitle_status"), _field(frame, "subtitle_source")
    )


def _read_sentences(documents: DataFrame) -> DataFrame:
    """Adds the picked sentences as columns, so that later expressions read them once."""
    return documents.withColumn("_s", D.sentences(F.col("content_text"))).withColumn("_top", D.pick_sentences(F.col("_s"), 3)).withColumn(
        "_key", D.key_sentences(F.col("_s"))
    )


def _extractive_fields(documents: DataFrame, summary_chars: int | None = None) -> tuple[Column, Column, Column]:
    """Markdown, tags and save recommendation over the columns of ``_read_sentences``."""
    reason = T.present(_field(documents, "fallback_reason"))
    instruction = T.strip(F.coalesce(_field(documents, "instruction"), F.lit("")))
    unsplit = F.col("content_text") if summary_chars is None else F.left("content_text", F.lit(summary_chars))
    summary = F.when(F.size("_top") > 0, F.array_join("_top", " ")).otherwise(unsplit)
    points = F.when(F.size("_key") > 0, F.array_join(F.transform("_key", lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise(
        F.lit(K.NO_KEY_POINTS)
    )
    markdown = F.concat(
        F.lit("# "), "title", F.lit("\n\nSource: "), "canonical_url", F.lit("\n\n## Summary\n\n"), summary,
        F.lit("\n\n## Key Points\n\n"), points,
        F.when(instruction != "", F.concat(F.lit("\n\n## User Instruction\n\n"), instruction)).otherwise(""),
        F.lit("\n\n## Save Recommendation\n\n" + K.SAVE_LINE + "\n\n## Model\n\n- Provider: local_extractive_fallback\n"),
        F.coalesce(F.concat(F.lit("- Fallback reason: "), reason, F.lit("\n")), F.lit("")),
        F.lit("- Extraction: "), "extraction_method", _provenance(documents),
    )
    tags = F.concat(
        F.array(F.lit("summary"), F.concat(F.lit("source/"), "source_type")),
        F.when(reason.isNotNull(), F.array(F.lit("model/local_fallback"))).otherwise(F.array().cast("array<string>")),
    )
    why = F.coalesce(
        F.concat(F.lit("Model API failed and a local extractive fallback was used: "), reason),
        F.lit("A conservative default; ask explicitly before saving."),
    )
    return markdown, tags, F.struct(F.lit(False).alias("should_save"), why.alias("reason"))


def _finish(rows: DataFrame, markdown: Column, tags: Column, save: Column) -> DataFrame:
    """Adds the digest columns; a video digest gets its timeline."""
    timed = D.with_video_timeline(F.col("_md"), F.col("source_type"), F.col("canonical_url"), _field(rows, "transcript_with_timestamps"))
    made = rows.withColumn("_md", markdown).withColumn("summary_markdown", timed)
    return made.withColumn("tags", tags).withColumn("save_recommendation", save).drop("_s", "_top", "_key", "_md")


def extractive_digest(documents: DataFrame, summary_chars: int | None = None) -> DataFrame:
    """Digest without a model: leading sentences and key points in a fixed layout.

    One projection over the documents: no shuffle, whatever their number. A non-empty
    ``fallback_reason`` column marks a digest that stands in for a failed model call. A text without a sentence is
    its own summary, whole or its first ``summary_chars`` characters.
    """
    return _finish(_read_sentences(documents), *_extractive_fields(documents, summary_chars))


def source_prompt(source_type: Column) -> Column:
    kind = F.lower(source_type)
    return T.first_match([(kind.isin("bilibili", "youtube"), K.PROMPT_VIDEO), (kind == "wechat", K.PROMPT_WECHAT)], F.lit(K.PROMPT_WEB))


def build_prompts(documents: DataFrame, summary_prompt: str, max_chars: int | None = None) -> DataFrame:
    """``doc_id, prompt`` for the model: rules, source block, request, and the text, cut in its middle to ``max_chars`` where asked."""
    unknown = F.lit(K.UNKNOWN)
    prompt = F.concat(
        F.lit(summary_prompt.strip() + "\n\n来源类型补充要求：\n"), source_prompt(F.col("source_type")),
        F.lit("\n\n用户指令："), T.first_present(T.strip(_field(documents, "instruction")), F.lit(K.DEFAULT_INSTRUCTION)),
        F.lit("\n\n标题："), "title", F.lit("\n来源："), "canonical_url", F.lit("\n来源类型："), "source_type",
        F.lit("\n作者："), T.first_present(_field(documents, "author"), unknown), F.lit("\n提取方式："), "extraction_method",
        F.lit("\n\n字幕状态："), T.first_present(_field(documents, "subtitle_status"), unknown),
        F.lit("\n\n字幕来源："), T.first_present(_field(documents, "transcript_origin_label"), unknown),
        F.lit("\n\n来源内容：\n"), F.col("content_text") if max_chars is None else T.head_tail(F.col("content_text"), max_chars, K.OMISSION_MARKER),
    )
    return documents.select("doc_id", prompt.alias("prompt"))


def read_attempts(attempts: DataFrame) -> DataFrame:
    """Adds ``text`` (a usable body with all sections) and ``reason`` (why an attempt failed) to model attempts.

    ``attempts(doc_id, attempt, provider, model, base_url, ready, http_code, body)``; ``http_code`` is
    NULL when nothing was received.
    """
    supported = F.lower("provider").isin("deepseek", "openai_compatible") & F.coalesce("ready", F.lit(False))
    clean = attempts.withColumn("_r", D.sanitize_response(D.response_text(F.col("body"))))
    parsed = F.try_parse_json("body")
    reason = T.first_match(
        [
            (~supported, K.ERR_NOT_READY), (F.col("http_code").isNull(), "model API request timed out."),
            (F.col("http_code") != 200, D.error_reason(F.col("http_code"), F.col("body"))),
            (parsed.isNull(), "model API returned an unexpected response: JSONDecodeError"),
            (F.col("_r.error").isNotNull() | (F.col("_r.text") == ""), "model API call failed: RuntimeError"),
        ]
    )
    said = T.present(F.try_variant_get(parsed, "$.model", "string"))
    return (
        clean.withColumn("reason", reason)
        .withColumn("text", F.when(F.col("reason").isNull(), D.ensure_sections(F.col("_r.text"))))
        .withColumn("said_model", F.coalesce(said, F.col("model")))
        .drop("_r")
    )


def resolve_attempts(attempts: DataFrame, most: int | None = None) -> DataFrame:
    """One row per document: the first attempt that succeeded, or the reasons of all of them.

    All attempts count, or the first ``most`` numbers.
    """
    read = read_attempts(attempts if most is None else attempts.filter(F.col("attempt") <= most))
    good = F.when(F.col("reason").isNull(), F.col("attempt"))
    winner = F.min_by(F.struct("attempt", "provider", "model", "said_model", "base_url", "text"), good)
    primary = F.min_by(F.struct("model", "reason"), F.col("attempt"))
    failures = F.array_sort(
        F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("attempt", F.concat_ws(": ", "model", "reason").alias("line"))))
    )
    folded = read.groupBy("doc_id").agg(winner.alias("w"), primary.alias("p"), failures.alias("f"))
    switched = F.col("w.attempt") > 1
    return folded.select(
        "doc_id", F.col("w.provider").alias("provider"), F.col("w.model").alias("model"), F.col("w.said_model").alias("said_model"),
        F.col("w.base_url").alias("base_url"), F.col("w.text").alias("text"), F.coalesce(switched, F.lit(False)).alias("failover_used"),
        F.when(switched, F.col("p.model")).alias("failover_from"), F.when(switched, F.col("p.reason")).alias("failover_reason"),
        F.when(F.col("w").isNull(), F.array_join(F.transform("f", lambda item: item["line"]), "; ")).alias("fallback_reason"),
    )


def _model_fields(documents: DataFrame) -> tuple[Column, Column, Column]:
    """Markdown, tags and save recommendation of a document joined with its resolved attempts."""
    failover = F.when(
        F.col("failover_used"),
        F.concat(F.lit("- Automatic fallback: "), "failover_from", F.lit(" failed; switched to "), "model", F.lit(".\n")),
    ).otherwise("")
    # The failover line follows the model line, which is only recognised when the reply names the same model.
    shown = F.when(F.col("said_model") == F.col("model"), failover).otherwise("")
    markdown = F.concat(
        F.lit("# "), "title", F.lit("\n\nSource: "), "canonical_url", F.lit("\n\n"), "text", F.lit("\n\n## Model\n\n- Provider: "),
        D.provider_label(F.col("provider"), F.col("base_url")), F.lit("\n- Model: "), "said_model", F.lit("\n"), shown,
        F.lit("- Extraction: "), "extraction_method", _provenance(documents),
    )
    tags = F.array(F.lit("summary"), F.concat(F.lit("source/"), "source_type"), F.concat(F.lit("model/"), F.lower("provider")))
    why = "The configured model generated a structured summary; review before long-term use."
    return markdown, tags, F.struct(F.lit(True).alias("should_save"), F.lit(why).alias("reason"))


def model_digest(documents: DataFrame, resolved: DataFrame) -> DataFrame:
    """Digests of the documents whose model call succeeded."""
    return _finish(documents.join(resolved.filter("text IS NOT NULL"), "doc_id"), *_model_fields(documents))


def digests(documents: DataFrame, attempts: DataFrame | None = None, summary_chars: int | None = None) -> DataFrame:
    """Digest of every document: from its model attempts where one succeeded, else extractive.

    Without attempts (provider ``local``) every digest is extractive. With them, documents and attempts
    are read once: each row takes one of the two layouts, and only rows without a model text are split
    into sentences.
    """
    columns = ["doc_id", "title", "canonical_url", "source_type", "summary_markdown", "tags", "save_recommendation"]
    if attempts is None:
        return extractive_digest(documents, summary_chars).select(*columns)
    rows = documents.join(resolve_attempts(attempts), "doc_id", "left")
    made = F.col("text").isNotNull()
    ready = _read_sentences(rows.withColumn("content_text", F.when(~made, F.col("content_text"))))
    fields = [F.when(made, own).otherwise(other) for own, other in zip(_model_fields(rows), _extractive_fields(rows, summary_chars), strict=True)]
    return _finish(ready, *fields).select(*columns)


def missing_section_counts(digested: DataFrame) -> DataFrame:
    """How many digests lack each required heading."""
    rows = exploded(digested, [], D.missing_sections(F.col("summary_markdown")), "section")
    return rows.groupBy("section").agg(F.count("*").alias("n"))


# Cues of one row when points are matched: a long transcript is judged in parts.
PART_CUES = 256


def match_points_to_cues(documents: DataFrame, point_chars: int | None = None, cue_chars: int | None = None) -> DataFrame:
    """``doc_id, seq, point, cue_index, time, seconds`` from ``doc_id, summary_markdown, transcript`` (one row per document).

    Points choose in order, and a chosen cue is taken. Each part of a transcript ranks its cues for each point, and only
    the best of them travel: a point with n points before it can lose n cues at most, so n + 1 candidates decide. What
    meets in one row is therefore bounded by the points of a digest, however long its transcript is.
    """
    def prepare(points: Column) -> Column:
        cues = D.timeline_cues(F.col("transcript"), cue_chars)

        def parts(all_cues: Column) -> Column:
            last = F.greatest(F.ceil(F.size(all_cues) / PART_CUES).cast("int") - 1, F.lit(0))
            return F.transform(F.sequence(F.lit(0), last), lambda part: F.slice(all_cues, part * PART_CUES + 1, PART_CUES + D.WINDOW_CUES - 1))

        return F.struct(points.alias("points"), F.transform(points, D.match_tokens).alias("tokens"), T.let(cues, parts).alias("parts"))

    prepared = documents.select("doc_id", T.let(D.summary_points(F.col("summary_markdown"), point_chars), prepare).alias("d"))
    prepared = prepared.select("doc_id", F.col("d.points").alias("points"), F.col("d.tokens").alias("tokens"), F.col("d.parts").alias("parts"))
    parts = exploded(prepared, ["doc_id", "points", "tokens"], F.col("parts"), "cues", "part")
    ranked = D.cue_scores(F.col("tokens"), F.col("cues"), F.col("part") * PART_CUES, PART_CUES)
    scored = exploded(parts, ["doc_id"], F.zip_with("points", ranked, lambda point, best: F.struct(point.alias("point"), best.alias("best"))), "m", "seq")
    merged = scored.groupBy("doc_id", "seq").agg(F.any_value("m.point").alias("point"), F.flatten(F.collect_list("m.best")).alias("best"))
    best = F.slice(F.array_sort("best"), F.lit(1), F.col("seq") + 1)
    whole = merged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "point", best.alias("best")))).alias("points"))
    taken = F.zip_with("points", D.take_in_order(F.col("points.best")), lambda point, hit: F.struct(point["seq"].alias("seq"), point["point"].alias("point"), hit.alias("hit")))
    rows = exploded(whole, ["doc_id"], taken, "m")
    return rows.select(
        "doc_id", F.col("m.seq").alias("seq"), F.col("m.point").alias("point"), F.col("m.hit.index").alias("cue_index"), F.col("m.hit.time").alias("time"),
        F.col("m.hit.seconds").alias("seconds"),
    )


def core_timelines(documents: DataFrame, point_chars: int | None = None, cue_chars: int | None = None) -> DataFrame:
    """``doc_id, markdown``: digests with one timeline line per point, from ``doc_id, url, summary_markdown, transcript``.

    The timeline a digest had is replaced; a digest without points keeps its body.
    """
    bodies = documents.withColumn("summary_markdown", D.without_timeline(F.col("summary_markdown")))
    hits = match_points_to_cues(bodies, point_chars, cue_chars).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "point", "cue_index", "time", "seconds"))).alias("hits"))
    lines = F.transform("hits", lambda hit: D.timeline_item(F.col("url"), hit["point"], hit["cue_index"], hit["time"], hit["seconds"]))
    return bodies.select("doc_id", "url", "summary_markdown").join(hits, "doc_id", "left").select("doc_id", D.with_timeline(F.col("summary_markdown"), lines).alias("markdown"))
