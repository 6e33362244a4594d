"""Column layouts of the tables the operators exchange (DDL strings)."""

from __future__ import annotations

PAGES = "page_id BIGINT, url STRING, html STRING"
CUES = "doc_id BIGINT, seq INT, start_s DOUBLE, end_s DOUBLE, text STRING"
TRACKS = "doc_id BIGINT, id STRING, subtitle_url STRING, lan STRING, lan_doc STRING, ai_type INT"
CAPTION_BODY = "STRUCT<body: ARRAY<STRUCT<`from`: DOUBLE, `to`: DOUBLE, content: STRING>>>"
JOBS = (
    "job_id STRING, url STRING, canonical_url STRING, instruction STRING, status STRING, stage STRING, "
    "progress DOUBLE, title STRING, result_json STRING, error_code STRING, error_message STRING, "
    "error_next_steps_json STRING, created_at TIMESTAMP, updated_at TIMESTAMP, request_kind STRING, "
    "summary_quality STRING, request_payload_json STRING, force_refresh BOOLEAN"
)
JOB_EVENTS = (
    "event_id BIGINT, job_id STRING, ts TIMESTAMP, op STRING, status STRING, stage STRING, "
    "progress DOUBLE, title STRING, error_code STRING, error_message STRING"
)
BATCH_MEMBERS = "batch_id BIGINT, seq BIGINT, job_id STRING"
RESULT_CACHE = (
    "cache_key STRING, canonical_url STRING, instruction STRING, title STRING, result_json STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
LIBRARY = (
    "relative_path STRING, title STRING, source_type STRING, content STRING, search_text STRING, "
    "mtime DOUBLE, size BIGINT, updated_at TIMESTAMP"
)
POSTINGS = "token STRING, relative_path STRING, pos INT"
UPLOAD_TEXT = "path STRING, text STRING, error_code STRING, error_message STRING"
SAMPLES = (
    "samples ARRAY<STRUCT<id: STRING, url: STRING, instruction: STRING, "
    "expected_transcript_origins: ARRAY<STRING>, expected_subtitle_statuses: ARRAY<STRING>, "
    "expected_subtitle_languages: ARRAY<STRING>, expected_bvid: STRING, maximum_duration_ratio: DOUBLE, "
    "expected_summary_language: STRING, minimum_core_points: INT, reference_transcript: STRING, "
    "maximum_character_error_rate: DOUBLE>>"
)
VIDEO_METADATA = (
    "STRUCT<id: STRING, title: STRING, uploader: STRING, channel: STRING, duration: DOUBLE, "
    "duration_string: STRING, upload_date: STRING, webpage_url: STRING, extractor: STRING, "
    "description: STRING, tags: ARRAY<STRING>, subtitles: MAP<STRING, ARRAY<STRUCT<ext: STRING, url: STRING>>>, "
    "automatic_captions: MAP<STRING, ARRAY<STRUCT<ext: STRING, url: STRING>>>, language: STRING>"
)
