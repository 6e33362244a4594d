"""Views that bind the given tables to the engine's inputs.

Each view is one SQL text; where the two dialects differ, a (spark, duckdb) pair. Spark and the
oracle read the same definitions, so a query and its oracle start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_CUE_START = "CASE WHEN doc_id % 7 = 0 THEN 6 * (n_lines - 1 - k) ELSE 6 * k END"
_CUE_TEXT = "CASE WHEN doc_id % 13 = 0 THEN 'music' WHEN doc_id % 5 = 0 AND k = n_lines - 1 THEN first_line ELSE line END"

VIEWS: dict[str, str | tuple[str, str]] = {
    "v_submissions": """
        SELECT e.event_id, concat('job_', CAST(e.event_id AS STRING)) AS job_id, e.user_id, e.event_type, e.value,
          CASE e.event_id % 8
            WHEN 0 THEN p.url
            WHEN 1 THEN concat('https://mp.weixin.qq.com/s/', CAST(e.event_id AS STRING), '?utm_source=x&spm=1')
            WHEN 2 THEN concat('https://WWW.youtube.com/watch?v=v', CAST(e.event_id AS STRING), '&gclid=1#t=3')
            WHEN 3 THEN concat('https://youtu.be/v', CAST(e.event_id AS STRING))
            WHEN 4 THEN concat('https://www.bilibili.com/video/BV', CAST(e.event_id AS STRING), '?p=', CAST(e.event_id % 3 AS STRING), '&vd_source=z')
            WHEN 5 THEN concat('https://b23.tv/x', CAST(e.event_id AS STRING))
            WHEN 6 THEN concat('http://10.0.0.', CAST(e.event_id % 250 AS STRING), '/a')
            ELSE concat('ftp://host/', CAST(e.event_id AS STRING)) END AS url,
          CASE e.event_id % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'media_download' ELSE 'link' END AS request_kind,
          CASE e.event_id % 4 WHEN 0 THEN 'deep' WHEN 1 THEN 'PRO' WHEN 2 THEN 'fast' ELSE 'x' END AS summary_quality,
          e.event_id % 11 = 0 AS force_refresh,
          CASE e.event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' 总结 ' ELSE 'Summarize' END AS instruction,
          e.ts AS created_at
        FROM (SELECT *, event_id % (SELECT count(*) FROM pages) AS pg FROM events) e
        LEFT JOIN pages p ON p.page_id = e.pg AND e.event_id % 8 = 0
    """,
    "v_jobs": """
        SELECT job_id, event_id, user_id,
          CASE WHEN request_kind = 'document' AND event_id % 2 = 0 THEN concat('local://doc ', CAST(event_id AS STRING))
               WHEN event_id % 101 = 3 THEN concat('local://gone ', CAST(event_id AS STRING)) ELSE url END AS url,
          CASE WHEN event_type = 'purchase' THEN url END AS canonical_url,
          instruction,
          CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded'
               WHEN 'error' THEN 'failed' ELSE 'canceled' END AS status,
          CASE event_type WHEN 'view' THEN 'received' WHEN 'click' THEN 'extracting' WHEN 'purchase' THEN 'done'
               WHEN 'error' THEN 'failed' ELSE 'canceled' END AS stage,
          CASE event_type WHEN 'purchase' THEN CAST(1.0 AS DOUBLE) WHEN 'click' THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS progress,
          CASE WHEN event_type = 'purchase' THEN concat('Title ', CAST(event_id AS STRING)) END AS title,
          CASE WHEN event_type = 'purchase' THEN concat('{"output_markdown_path":"', artifact, '","summary_quality":"',
               CASE WHEN event_id % 3 = 0 THEN 'pro' ELSE 'fast' END, '","cache_hit":', CASE WHEN event_id % 4 = 1 THEN 'true' ELSE 'false' END,
               ',"source":{"title":"S', CAST(event_id AS STRING), '","content_text":"body ', CAST(event_id AS STRING), '"}}') END AS result_json,
          CASE WHEN event_type = 'signup' THEN 'canceled' WHEN event_type = 'error' THEN
            CASE event_id % 8 WHEN 0 THEN 'need_cookies' WHEN 1 THEN 'dependency_missing' WHEN 2 THEN 'invalid_url'
              WHEN 3 THEN 'unsupported_document' WHEN 4 THEN 'invalid_document' WHEN 5 THEN 'interrupted'
              WHEN 6 THEN 'extraction_failed' ELSE 'unexpected_error' END END AS error_code,
          CASE WHEN event_type = 'error' THEN concat('failed ', CAST(event_id AS STRING)) END AS error_message,
          CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN '["own step"]' END AS error_next_steps_json,
          created_at, created_at + INTERVAL '1' HOUR AS updated_at,
          request_kind, summary_quality,
          CASE WHEN event_id % 97 = 0 THEN '{bad'
               WHEN request_kind = 'document' AND event_id % 3 <> 0 THEN concat('{"title":"Doc ', CAST(event_id AS STRING), '","content":"text ', CAST(event_id AS STRING), '"}')
               WHEN request_kind = 'document' THEN '{}'
               WHEN request_kind = 'media_download' THEN concat('{"url":"', url, '","media_type":"video","format":"720p"}')
               ELSE '{}' END AS request_payload_json,
          force_refresh
        FROM (SELECT s.*, concat('2024-01-', lpad(CAST(1 + s.d % 28 AS STRING), 2, '0'), '/src', CAST(s.d % 20 AS STRING), '/',
                CAST(s.d AS STRING), '.md') AS artifact
              FROM (SELECT *, event_id % (2 * (SELECT count(*) FROM documents)) AS d FROM v_submissions) s) a
    """,
    "v_job_events": """
        SELECT event_id, concat('job_', CAST(user_id AS STRING)) AS job_id, ts,
          CASE event_type WHEN 'view' THEN 'submit' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'succeed'
               WHEN 'error' THEN 'fail' ELSE 'cancel' END AS op,
          CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded'
               WHEN 'error' THEN 'failed' ELSE 'canceled' END AS status,
          CASE event_type WHEN 'view' THEN 'received' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'extracting' ELSE 'summarizing' END
               WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'canceled' END AS stage,
          CASE event_type WHEN 'view' THEN CAST(0.0 AS DOUBLE) WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END
               WHEN 'purchase' THEN CAST(1.0 AS DOUBLE) WHEN 'signup' THEN CAST(0.0 AS DOUBLE) END AS progress,
          CASE WHEN event_type = 'purchase' THEN concat('Title ', CAST(event_id AS STRING)) END AS title,
          CASE WHEN event_type = 'signup' THEN 'canceled' WHEN event_type = 'error' THEN
            CASE event_id % 3 WHEN 0 THEN 'need_cookies' WHEN 1 THEN 'invalid_url' ELSE 'extraction_failed' END END AS error_code,
          CASE WHEN event_type = 'signup' THEN 'Job was canceled by the user.'
               WHEN event_type = 'error' THEN concat('failed ', CAST(event_id AS STRING)) END AS error_message
        FROM (SELECT event_id, user_id, ts, CASE WHEN event_type = 'signup' AND event_id % 10 <> 0 THEN 'click' ELSE event_type END AS event_type FROM events) e
    """,
    "v_batch_members": """
        SELECT user_id AS batch_id, event_id AS seq, concat('job_', CAST(event_id AS STRING)) AS job_id FROM events
        UNION ALL
        SELECT DISTINCT user_id AS batch_id, CAST(-1 AS BIGINT) AS seq, concat('lost_', CAST(user_id AS STRING)) AS job_id
        FROM events WHERE user_id % 7 = 0
    """,
    "v_videos": """
        SELECT doc_id, source, lang, n_lines,
          CAST(6 * n_lines * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 10 ELSE 0 END AS DOUBLE) AS duration,
          concat('https://example.com/v/', CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN '?p=1' ELSE '' END) AS url
        FROM (SELECT doc_id, source, lang, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents) d
    """,
    "v_cues": (
        f"""
        SELECT doc_id, CAST(k AS INT) AS seq, CAST({_CUE_START} AS DOUBLE) AS start_s,
          CAST({_CUE_START} + CASE WHEN doc_id % 11 = 0 AND k = 2 THEN 0 ELSE 5 END AS DOUBLE) AS end_s, {_CUE_TEXT} AS text
        FROM (SELECT doc_id, n_lines, first_line, k, line FROM
          (SELECT doc_id, split(text, chr(10)) AS lines, size(split(text, chr(10))) AS n_lines, split(text, chr(10))[0] AS first_line FROM documents)
          LATERAL VIEW posexplode(lines) t AS k, line)
        """,
        f"""
        SELECT doc_id, CAST(k AS INTEGER) AS seq, CAST({_CUE_START} AS DOUBLE) AS start_s,
          CAST({_CUE_START} + CASE WHEN doc_id % 11 = 0 AND k = 2 THEN 0 ELSE 5 END AS DOUBLE) AS end_s, {_CUE_TEXT} AS text
        FROM (SELECT doc_id, len(lines) AS n_lines, lines[1] AS first_line, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS k
              FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
        """,
    ),
    # One transcript text per document, as the subtitle parser stores it.
    "v_transcripts": (
        """
        SELECT doc_id, array_join(transform(cues, c -> concat('[', c.a, '-', c.b, '] ', c.t)), chr(10)) AS transcript FROM (
          SELECT doc_id, transform(lines, (l, k) -> named_struct(
             'a', date_format(timestamp_seconds(s0[k]), 'HH:mm:ss'), 'b', date_format(timestamp_seconds(s0[k] + IF(doc_id % 11 = 0 AND k = 2, 0, 5)), 'HH:mm:ss'),
             't', CASE WHEN doc_id % 13 = 0 THEN 'music' WHEN doc_id % 5 = 0 AND k = n_lines - 1 THEN lines[0] ELSE l END)) AS cues
          FROM (SELECT *, transform(lines, (l, k) -> CASE WHEN doc_id % 7 = 0 THEN 6 * (n_lines - 1 - k) ELSE 6 * k END) AS s0
                FROM (SELECT doc_id, split(text, chr(10)) AS lines, size(split(text, chr(10))) AS n_lines FROM documents)))
        """,
        """
        SELECT doc_id, string_agg('[' || strftime(to_timestamp(start_s) AT TIME ZONE 'UTC', '%H:%M:%S') || '-' ||
             strftime(to_timestamp(end_s) AT TIME ZONE 'UTC', '%H:%M:%S') || '] ' || text, chr(10) ORDER BY seq) AS transcript
        FROM v_cues GROUP BY doc_id
        """,
    ),
    "v_vtt": (
        """
        SELECT doc_id, concat('WEBVTT', chr(10), 'Kind: captions', chr(10), 'Language: en', chr(10), chr(10),
          array_join(transform(split(transcript, chr(10)), (l, k) -> concat(CAST(k AS STRING), chr(10), substring(l, 2, 8), '.250 --> ',
             substring(l, 11, 8), '.750 align:start', chr(10), '<c.x>', substring(l, 21, 1000000000), '</c>', chr(10))), chr(10))) AS body
        FROM v_transcripts
        """,
        """
        SELECT doc_id, 'WEBVTT' || chr(10) || 'Kind: captions' || chr(10) || 'Language: en' || chr(10) || chr(10) ||
          string_agg(CAST(seq AS VARCHAR) || chr(10) || strftime(to_timestamp(start_s) AT TIME ZONE 'UTC', '%H:%M:%S') || '.250 --> ' ||
            strftime(to_timestamp(end_s) AT TIME ZONE 'UTC', '%H:%M:%S') || '.750 align:start' || chr(10) || '<c.x>' || text || '</c>' || chr(10),
            chr(10) ORDER BY seq) AS body
        FROM v_cues GROUP BY doc_id
        """,
    ),
    "v_srt": (
        """
        SELECT doc_id, array_join(transform(split(transcript, chr(10)), (l, k) -> concat(CAST(k AS STRING), chr(10), substring(l, 2, 8), ',250 --> ',
             substring(l, 11, 8), ',750', chr(10), '<i>', substring(l, 21, 1000000000), '</i>', chr(10))), chr(10)) AS body
        FROM v_transcripts
        """,
        """
        SELECT doc_id, string_agg(CAST(seq AS VARCHAR) || chr(10) || strftime(to_timestamp(start_s) AT TIME ZONE 'UTC', '%H:%M:%S') || ',250 --> ' ||
            strftime(to_timestamp(end_s) AT TIME ZONE 'UTC', '%H:%M:%S') || ',750' || chr(10) || '<i>' || text || '</i>' || chr(10),
            chr(10) ORDER BY seq) AS body
        FROM v_cues GROUP BY doc_id
        """,
    ),
    # A JSON caption body per document: cut points make some bodies invalid, empty or too long.
    "v_payloads": """
        SELECT doc_id, duration, concat('{"body":[{"from":0.2,"to":2.8,"content":"a',  CAST(doc_id AS STRING), '"},{"from":',
          CASE WHEN doc_id % 6 = 1 THEN '9.5' ELSE '3.0' END, ',"to":', CASE WHEN doc_id % 6 = 2 THEN '2.0' ELSE '12.5' END,
          ',"content":"second line of the caption body for the document"},{"from":', CASE WHEN doc_id % 6 = 3 THEN '1.0' ELSE '20.0' END,
          ',"to":', CASE WHEN doc_id % 6 = 4 THEN '4000.0' ELSE '31.5' END, ',"content":"', CASE WHEN doc_id % 6 = 5 THEN '  ' ELSE 'third line' END, '"}]}') AS payload
        FROM v_videos
    """,
    "v_library": """
        SELECT doc_id, concat('2024-01-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), '/', source, '/', CAST(doc_id AS STRING), '.md') AS relative_path,
          source, concat('# Doc ', CAST(doc_id AS STRING), chr(10), text) AS content, CAST(doc_id * 3600 AS DOUBLE) AS mtime, n_chars AS size
        FROM documents
    """,
    # Files as a directory listing: library files plus names that are never indexed.
    "v_files": (
        """
        SELECT path AS relative_path, content, mtime, size FROM v_library LATERAL VIEW explode(filter(array(relative_path,
            CASE WHEN doc_id % 3 = 0 THEN replace(relative_path, '.md', '/summary.md') END, CASE WHEN doc_id % 4 = 0 THEN replace(relative_path, '.md', '/timeline.md') END,
            CASE WHEN doc_id % 5 = 0 THEN concat('favorites/', relative_path) END, CASE WHEN doc_id % 6 = 0 THEN replace(relative_path, '.md', '.txt') END,
            CASE WHEN doc_id % 50 = 0 THEN concat('note ', CAST(doc_id AS STRING), '.md') END), p -> p IS NOT NULL)) t AS path
        """,
        """
        SELECT relative_path, content, mtime, size FROM v_library
        UNION ALL SELECT replace(relative_path, '.md', '/summary.md') AS relative_path, content, mtime, size FROM v_library WHERE doc_id % 3 = 0
        UNION ALL SELECT replace(relative_path, '.md', '/timeline.md') AS relative_path, content, mtime, size FROM v_library WHERE doc_id % 4 = 0
        UNION ALL SELECT concat('favorites/', relative_path) AS relative_path, content, mtime, size FROM v_library WHERE doc_id % 5 = 0
        UNION ALL SELECT replace(relative_path, '.md', '.txt') AS relative_path, content, mtime, size FROM v_library WHERE doc_id % 6 = 0
        UNION ALL SELECT concat('note ', CAST(doc_id AS STRING), '.md') AS relative_path, content, mtime, size FROM v_library WHERE doc_id % 50 = 0
    """,
    ),
    "v_docs": """
        SELECT doc_id, concat('Doc ', CAST(doc_id AS STRING), ' ', source, '!') AS title, text AS content_text, lang,
          concat('https://example.com/d/', CAST(doc_id AS STRING)) AS canonical_url,
          CASE doc_id % 5 WHEN 0 THEN 'wechat' WHEN 1 THEN 'youtube' WHEN 2 THEN 'bilibili' WHEN 3 THEN 'feishu_document' ELSE 'web' END AS source_type,
          CASE WHEN doc_id % 3 = 0 THEN 'Ann' END AS author,
          CASE doc_id % 5 WHEN 1 THEN 'yt_dlp_metadata_platform_subtitle' ELSE 'html_metadata_readability' END AS extraction_method,
          CASE WHEN doc_id % 5 = 1 THEN 'youtube_manual_subtitle' END AS subtitle_status,
          CASE WHEN doc_id % 10 = 1 THEN 'yt_dlp' END AS subtitle_source,
          CASE WHEN doc_id % 5 = 1 THEN '原始字幕' WHEN doc_id % 10 = 2 THEN '本地 ASR 转写' END AS transcript_origin_label,
          CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' 总结 ' ELSE 'Summarize' END AS instruction
        FROM documents
    """,
    # Model replies: two attempts per document; '~' stands for an escaped newline.
    "v_attempts": """
        SELECT doc_id, attempt, 'openai_compatible' AS provider, CASE attempt WHEN 1 THEN 'm-one' ELSE 'm-two' END AS model,
          CASE doc_id % 4 WHEN 0 THEN 'https://api.openai.com/v1' WHEN 1 THEN 'http://localhost:11434/v1' WHEN 2 THEN 'https://llm.example.org/v1' ELSE 'https://api.moonshot.cn/v1' END AS base_url,
          doc_id % 17 <> 4 OR attempt <> 1 AS ready,
          CASE WHEN doc_id % 6 = 5 AND attempt = 1 THEN 429 WHEN doc_id % 12 = 5 THEN 503 ELSE 200 END AS http_code,
          replace(CASE WHEN doc_id % 6 = 5 AND (attempt = 1 OR doc_id % 12 = 5) THEN 'quota exceeded'
            WHEN doc_id % 6 = 0 THEN concat('{"choices":[{"message":{"content":"', md, '"}}]}')
            WHEN doc_id % 6 = 1 THEN concat('{"choices":[{"message":{"content":[{"type":"text","text":"', md, '"},"tail",{"type":"image","text":"no"}]}}]}')
            WHEN doc_id % 6 = 2 THEN concat('{"output_text":"', md, '","output":[]}')
            WHEN doc_id % 6 = 3 THEN concat('{"output":[{"type":"reasoning","content":[{"type":"text","text":"hidden"}]},{"type":"message","content":[{"type":"output_text","text":" ', md, ' "},{"text":"end"}]}]}')
            ELSE concat('{"choices":[{"message":{"content":"<think>plan</think>intro~', md, CASE WHEN attempt = 1 AND doc_id % 12 = 4 THEN '<analysis>open' ELSE '' END, '"}}]}') END,
            '~', concat(chr(92), 'n')) AS body
        FROM (SELECT doc_id, attempt, concat('## 一句话结论~Doc ', CAST(doc_id AS STRING), ' holds.~~## 核心要点~- **Point** one ', CAST(doc_id AS STRING),
                '~', CASE WHEN doc_id % 2 = 0 THEN '2. [Point](http://a.b) two~' ELSE '' END, '~## 详细笔记~notes') AS md
              FROM (SELECT doc_id, 1 AS attempt FROM documents UNION ALL SELECT doc_id, 2 AS attempt FROM documents) a) m
    """,
    "v_asr": (
        """
        SELECT doc_id, regexp_replace(text, '[^ -~\\n]', 'x') AS reference,
          concat('[00:00] ', replace(regexp_replace(text, '[^ -~\\n]', 'x'), 'e', 'a')) AS hypothesis
        FROM documents
        """,
        """
        SELECT doc_id, regexp_replace(text, '[^ -~\\n]', 'x', 'g') AS reference,
          concat('[00:00] ', replace(regexp_replace(text, '[^ -~\\n]', 'x', 'g'), 'e', 'a')) AS hypothesis
        FROM documents
        """,
    ),
    "v_addresses": """
        SELECT concat('h', CAST(event_id - event_id % 4 AS STRING)) AS host,
          concat(CASE WHEN event_id % 16 = 3 THEN '127.0' ELSE
              CASE CAST((event_id - event_id % 4) / 4 AS BIGINT) % 10 WHEN 0 THEN '10.9' WHEN 1 THEN '198.18' WHEN 2 THEN '8.8' WHEN 3 THEN '93.184'
                WHEN 4 THEN '198.51' WHEN 5 THEN '198.19' WHEN 6 THEN '100.64' WHEN 7 THEN '1.1' WHEN 8 THEN '169.254' ELSE '172.20' END END,
            '.', CASE WHEN CAST((event_id - event_id % 4) / 4 AS BIGINT) % 10 = 4 THEN '100' ELSE CAST(event_id % 200 AS STRING) END, '.', CAST(1 + event_id % 250 AS STRING)) AS address
        FROM events
    """,
}


def _needed(sql: str, seen: list[str]) -> list[str]:
    """Views a text uses, dependencies first."""
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            definition = VIEWS[name]
            for text in (definition,) if isinstance(definition, str) else definition:
                _needed(text, seen)
            if name not in seen:
                seen.append(name)
    return seen


def _with(parts: list[tuple[str, str]], body: str) -> str:
    body = body.strip()
    head = ", ".join(f"{name} AS ({text})" for name, text in parts)
    if not head:
        return body
    if re.match(r"(?i)WITH\s", body):
        return f"WITH {head}, {body[4:].lstrip()}"
    return f"WITH {head} {body}"


def duck(body: str) -> str:
    """DuckDB text for a body that names views."""
    return _with([(name, _pick(name, 1)) for name in _needed(body, [])], body)


def _pick(name: str, dialect: int) -> str:
    definition = VIEWS[name]
    return definition if isinstance(definition, str) else definition[dialect]


# Tables whose rows are texts or addresses to parse: their work per byte is high.
TEXT_TABLES = ("documents", "pages", "conversations", "events")


# Session setting with the tasks that rows of text tables are dealt out to after a scan. The benchmark and the
# tests set it, because their tables are single row groups; unset, a table is read as its files are split.
SCAN_TASKS = "spark.digestmill.scanTasks"


def _scan(spark: SparkSession, path: str, text_table: bool) -> str:
    """SQL of a table scan."""
    tasks = spark.conf.get(SCAN_TASKS, None) if text_table else None
    hint = f"/*+ REPARTITION({int(tasks)}) */ " if tasks else ""
    return f"SELECT {hint}* FROM parquet.`{path}`"


def spark_sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """A body over the base tables and the views, as a DataFrame."""
    views = [(name, _pick(name, 0)) for name in _needed(body, [])]
    text = body + " ".join(sql for _, sql in views)
    tables = [
        (name, _scan(spark, f"{sf_dir}/{name}.parquet", name in TEXT_TABLES))
        for name in BASE_TABLES
        if re.search(rf"\b{name}\b", text)
    ]
    return spark.sql(_with(tables + views, body))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One base table or bound view."""
    if name in BASE_TABLES:
        return spark.sql(_scan(spark, f"{sf_dir}/{name}.parquet", name in TEXT_TABLES))
    return spark_sql(spark, sf_dir, f"SELECT * FROM {name}")
