"""Digest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import digest as D
from digestmill.functions.scale import exploded
from digestmill.operators import digest as O
from digestmill.plans.bindings import view
from digestmill.plans.registry import query

_SENT = """lines AS (SELECT doc_id, k, trim(regexp_replace(line, '\\s+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, unnest(string_split(trim(content_text, ' ' || chr(10)), chr(10))) AS line,
      generate_subscripts(string_split(trim(content_text, ' ' || chr(10)), chr(10)), 1) AS k FROM v_docs)),
  fit AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM lines WHERE length(line) BETWEEN 12 AND 220),
  many AS (SELECT DISTINCT doc_id FROM fit WHERE n >= 5),
  flat AS (SELECT doc_id, trim(regexp_replace(content_text, '\\s+', ' ', 'g'), ' ') AS t FROM v_docs WHERE doc_id NOT IN (SELECT doc_id FROM many)),
  cut AS (SELECT doc_id, string_split(regexp_replace(t, '([。！？.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS a, string_split(regexp_replace(t, '([。！？.!?])', '\\1' || chr(1), 'g'), chr(1)) AS b FROM flat),
  part AS (SELECT doc_id, unnest(CASE WHEN len(a) > 1 THEN a ELSE b END) AS line, generate_subscripts(CASE WHEN len(a) > 1 THEN a ELSE b END, 1) AS k FROM cut),
  every AS (SELECT doc_id, k, line FROM fit WHERE n >= 5 UNION ALL SELECT doc_id, k, trim(line, ' ') FROM part WHERE length(trim(line, ' ')) >= 20),
  sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS seq, line AS sentence FROM every)"""
_PICK = """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS seq, sentence FROM
    (SELECT *, row_number() OVER (PARTITION BY doc_id, substr(sentence, 1, 80) ORDER BY seq) AS r FROM {src}) WHERE r = 1"""


@query("sentences", f"WITH {_SENT} SELECT doc_id, seq, sentence FROM sent")
def sentences(spark, sf):
    return O.sentences(view(spark, sf, "v_docs")).withColumn("seq", F.col("seq").cast("bigint"))


@query("pick_sentences", f"WITH {_SENT} SELECT * FROM ({_PICK.format(src='(SELECT * FROM sent WHERE seq >= 3)')}) WHERE seq < 5")
def pick_sentences(spark, sf):
    return O.pick_sentences(view(spark, sf, "v_docs"), 5, skip=3).withColumn("seq", F.col("seq").cast("bigint"))


_CLEAN = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '`([^`]+)`', '\\1', 'g'),
    '[*_>#]', '', 'g'), '^\\[[^\\]]+\\]\\s*', ''), '^\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?\\s*', ''), '\\s+', ' ', 'g'), ' -。；;')"""
_PROVENANCE = """CASE WHEN source_type IN ('youtube', 'bilibili') AND coalesce(transcript_origin_label, subtitle_status, subtitle_source) IS NOT NULL THEN chr(10) || '- 字幕/转写来源: ' || coalesce(transcript_origin_label, '未知') ||
    CASE WHEN coalesce(subtitle_status, subtitle_source) IS NOT NULL THEN '（' || concat_ws('；', subtitle_status, subtitle_source) || '）' ELSE '' END ELSE '' END"""


def _extractive(reason: str = "NULL", only: str = "true") -> str:
    """DuckDB text of the extractive digest, as CTEs ending in ``ext(doc_id, md)``."""
    nl = "chr(10)"
    return f"""{_SENT}, top AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY seq) AS s FROM ({_PICK.format(src='sent')}) WHERE seq < 3 GROUP BY doc_id),
      rest AS (SELECT s.* FROM sent s JOIN (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id) c ON c.doc_id = s.doc_id WHERE seq >= 3 OR n <= 3),
      key AS (SELECT doc_id, string_agg('- ' || sentence, {nl} ORDER BY seq) AS lines, string_agg(CASE WHEN p <> '' THEN '- {K.TIME_UNKNOWN}' || p END, {nl} ORDER BY seq) AS timed
        FROM (SELECT *, {_CLEAN.format(x="regexp_extract('- ' || sentence, '^- +(.+)$', 1)")} AS p FROM ({_PICK.format(src='rest')})) WHERE seq < 5 GROUP BY doc_id),
      ext AS (SELECT d.doc_id, '# ' || title || {nl} || {nl} || 'Source: ' || canonical_url || {nl} || {nl} || '## Summary' || {nl} || {nl} || coalesce(top.s, substr(content_text, 1, 300)) || {nl} || {nl} ||
          '## Key Points' || {nl} || {nl} || coalesce(key.lines, '{K.NO_KEY_POINTS}') || CASE WHEN trim(instruction) <> '' THEN {nl} || {nl} || '## User Instruction' || {nl} || {nl} || trim(instruction) ELSE '' END ||
          {nl} || {nl} || '## Save Recommendation' || {nl} || {nl} || '{K.SAVE_LINE}' || {nl} || {nl} || '## Model' || {nl} || {nl} || '- Provider: local_extractive_fallback' || {nl} ||
          coalesce('- Fallback reason: ' || ({reason}) || {nl}, '') || '- Extraction: ' || extraction_method || {_PROVENANCE} ||
          CASE WHEN source_type IN ('youtube', 'bilibili') THEN {nl} || {nl} || '## {K.CORE_TIMELINE}' || {nl} || {nl} || coalesce(key.timed, '- {K.TIME_UNKNOWN}No separate key points could be extracted.') || {nl} || {nl} || '{K.FULL_TIMELINE_LINE}' ELSE '' END AS md
        FROM v_docs d LEFT JOIN top ON top.doc_id = d.doc_id LEFT JOIN key ON key.doc_id = d.doc_id WHERE {only})"""


@query("extractive_digest", f"WITH {_extractive()} SELECT doc_id, md AS summary_markdown FROM ext")
def extractive_digest(spark, sf):
    """Flagship: documents to digest Markdown in one projection."""
    return O.extractive_digest(view(spark, sf, "v_docs"), summary_chars=300).select("doc_id", "summary_markdown")


@query(
    "build_prompts",
    f"""SELECT doc_id, sha256('Rules.' || chr(10) || chr(10) || '来源类型补充要求：' || chr(10) || CASE WHEN source_type IN ('youtube', 'bilibili') THEN '{K.PROMPT_VIDEO}' WHEN source_type = 'wechat' THEN '{K.PROMPT_WECHAT}' ELSE '{K.PROMPT_WEB}' END
        || chr(10) || chr(10) || '用户指令：' || coalesce(nullif(trim(instruction), ''), '{K.DEFAULT_INSTRUCTION}') || chr(10) || chr(10) || '标题：' || title || chr(10) || '来源：' || canonical_url || chr(10) || '来源类型：' || source_type || chr(10) || '作者：' || coalesce(author, '未知')
        || chr(10) || '提取方式：' || extraction_method || chr(10) || chr(10) || '字幕状态：' || coalesce(subtitle_status, '未知') || chr(10) || chr(10) || '字幕来源：' || coalesce(transcript_origin_label, '未知') || chr(10) || chr(10) || '来源内容：' || chr(10)
        || CASE WHEN length(content_text) <= 180000 THEN content_text ELSE substr(content_text, 1, 90000) || '{K.OMISSION_MARKER}' || right(content_text, 90000) END) AS prompt_hash FROM v_docs""",
)
def build_prompts(spark, sf):
    prompts = O.build_prompts(view(spark, sf, "v_docs"), "Rules.\n")
    return prompts.select("doc_id", F.sha2("prompt", 256).alias("prompt_hash"))


_MD = """'## 一句话结论' || chr(10) || 'Doc ' || doc_id || ' holds.' || chr(10) || chr(10) || '## 核心要点' || chr(10) || '- **Point** one ' || doc_id || chr(10) ||
    CASE WHEN doc_id % 2 = 0 THEN '2. [Point](http://a.b) two' || chr(10) ELSE '' END || chr(10) || '## 详细笔记' || chr(10) || 'notes'"""
_BROKEN = "doc_id % 6 = 5 AND (attempt = 1 OR doc_id % 12 = 5)"
_TEXT = f"""CASE WHEN {_BROKEN} THEN '' WHEN doc_id % 6 = 1 THEN {_MD} || chr(10) || 'tail' WHEN doc_id % 6 = 3 THEN {_MD} || chr(10) || 'end' ELSE {_MD} END"""
_RAW = f"""CASE WHEN {_BROKEN} THEN '' WHEN doc_id % 6 IN (4, 5) THEN '<think>plan</think>intro' || chr(10) || {_MD} || CASE WHEN attempt = 1 AND doc_id % 12 = 4 THEN '<analysis>open' ELSE '' END ELSE {_TEXT} END"""
_HURT = "attempt = 1 AND doc_id % 12 = 4"


@query("response_text", f"SELECT doc_id, attempt, {_RAW} AS text FROM v_attempts")
def response_text(spark, sf):
    return view(spark, sf, "v_attempts").select("doc_id", "attempt", D.response_text(F.col("body")).alias("text"))


@query("sanitize_response", f"SELECT doc_id, attempt, CASE WHEN NOT ({_HURT}) THEN {_TEXT} END AS text, CASE WHEN {_HURT} THEN '{K.ERR_REASONING}' END AS error FROM v_attempts")
def sanitize_response(spark, sf):
    clean = D.sanitize_response(D.response_text(F.col("body")))
    rows = view(spark, sf, "v_attempts").select("doc_id", "attempt", clean.alias("r"))
    return rows.select("doc_id", "attempt", F.when(F.col("r.error").isNull(), F.col("r.text")).alias("text"), F.col("r.error").alias("error"))


_MISSING = [section for section in K.REQUIRED_SECTIONS if section not in ("## 一句话结论", "## 核心要点", "## 详细笔记")]
_ADDED = " || chr(10) || chr(10) || ".join(f"'{section}' || chr(10) || '{K.MISSING_SECTION_TEXT}'" for section in _MISSING)
_FULL = f"CASE WHEN {_TEXT} = '' THEN '' ELSE {_TEXT} || chr(10) || chr(10) || {_ADDED} END"


@query("ensure_sections", f"SELECT doc_id, attempt, {_FULL} AS markdown FROM v_attempts WHERE NOT ({_HURT})")
def ensure_sections(spark, sf):
    rows = view(spark, sf, "v_attempts").select("doc_id", "attempt", D.sanitize_response(D.response_text(F.col("body"))).alias("r"))
    return rows.filter("r.error IS NULL").select("doc_id", "attempt", D.ensure_sections(F.col("r.text")).alias("markdown"))


@query(
    "missing_sections",
    f"""SELECT section, count(*) AS n FROM (SELECT unnest([{', '.join(f"'{s}'" for s in K.REQUIRED_SECTIONS)}]) AS section, {_TEXT} AS md FROM v_attempts) WHERE NOT contains(md, section) GROUP BY section""",
)
def missing_sections(spark, sf):
    text = D.sanitize_response(D.response_text(F.col("body")))["text"]
    return O.missing_section_counts(view(spark, sf, "v_attempts").select(text.alias("summary_markdown")))


_REASON = f"""CASE WHEN NOT ready THEN '{K.ERR_NOT_READY}' WHEN http_code = 429 THEN 'model API rate limit or quota error (HTTP 429): quota exceeded' WHEN http_code = 503 THEN 'model API provider server error (HTTP 503): quota exceeded'
    WHEN {_HURT} THEN 'model API call failed: RuntimeError' END"""
_RESOLVED = f"""att AS (SELECT doc_id, attempt, model, base_url, {_REASON} AS reason, {_FULL} AS text FROM v_attempts),
    res AS (SELECT doc_id, arg_min(model, attempt) FILTER (WHERE reason IS NULL) AS model, arg_min(text, attempt) FILTER (WHERE reason IS NULL) AS text, min(attempt) FILTER (WHERE reason IS NULL) AS won,
      any_value(base_url) AS base_url, max(CASE WHEN attempt = 1 THEN reason END) AS first_reason, CASE WHEN count(*) FILTER (WHERE reason IS NULL) = 0 THEN string_agg(model || ': ' || reason, '; ' ORDER BY attempt) END AS fallback_reason
      FROM att GROUP BY doc_id)"""


@query(
    "resolve_attempts",
    f"""WITH {_RESOLVED} SELECT doc_id, model, text, coalesce(won = 2, false) AS failover_used, CASE WHEN won = 2 THEN 'm-one' END AS failover_from, CASE WHEN won = 2 THEN first_reason END AS failover_reason, fallback_reason FROM res""",
)
def resolve_attempts(spark, sf):
    return O.resolve_attempts(view(spark, sf, "v_attempts")).select(
        "doc_id", "model", "text", "failover_used", "failover_from", "failover_reason", "fallback_reason"
    )


@query(
    "error_reasons",
    """SELECT code, 'model API ' || CASE WHEN code IN (401, 403) THEN 'authentication or permission error' WHEN code = 429 THEN 'rate limit or quota error' WHEN code BETWEEN 500 AND 599 THEN 'provider server error' ELSE 'http error' END
         || ' (HTTP ' || code || '): ' || text AS reason, doc_id FROM (SELECT doc_id, trim(text, ' ' || chr(10)) AS text, CASE doc_id % 5 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 502 ELSE 404 END AS code FROM documents)""",
)
def error_reasons(spark, sf):
    rest = F.col("doc_id") % 5
    code = F.when(rest == 0, 401).when(rest == 1, 403).when(rest == 2, 429).when(rest == 3, 502).otherwise(404)
    return view(spark, sf, "documents").select(code.alias("code"), D.error_reason(code, F.col("text")).alias("reason"), "doc_id")


_LABEL = "CASE doc_id % 4 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Ollama' WHEN 2 THEN 'OpenAI-compatible' ELSE 'Kimi / Moonshot' END"


@query("provider_labels", f"SELECT label, count(*) AS n FROM (SELECT {_LABEL} AS label FROM v_attempts) GROUP BY label")
def provider_labels(spark, sf):
    label = D.provider_label(F.col("provider"), F.col("base_url")).alias("label")
    return view(spark, sf, "v_attempts").groupBy(label).agg(F.count("*").alias("n"))


_MODEL_MD = f"""'# ' || title || chr(10) || chr(10) || 'Source: ' || canonical_url || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Model' || chr(10) || chr(10) || '- Provider: ' || {_LABEL.replace('doc_id', 'd.doc_id')} || chr(10) ||
    '- Model: ' || model || chr(10) || CASE WHEN won = 2 THEN '- Automatic fallback: m-one failed; switched to m-two.' || chr(10) ELSE '' END || '- Extraction: ' || extraction_method || {_PROVENANCE} ||
    CASE WHEN source_type IN ('youtube', 'bilibili') THEN chr(10) || chr(10) || '## {K.CORE_TIMELINE}' || chr(10) || chr(10) || '- {K.TIME_UNKNOWN}Point one ' || d.doc_id || CASE WHEN d.doc_id % 2 = 0 THEN chr(10) || '- {K.TIME_UNKNOWN}Point two' ELSE '' END ||
      chr(10) || chr(10) || '{K.FULL_TIMELINE_LINE}' ELSE '' END"""


@query(
    "model_digest",
    f"""WITH {_RESOLVED} SELECT d.doc_id, {_MODEL_MD} AS summary_markdown FROM v_docs d JOIN res ON res.doc_id = d.doc_id WHERE text IS NOT NULL""",
)
def model_digest(spark, sf):
    resolved = O.resolve_attempts(view(spark, sf, "v_attempts"))
    return O.model_digest(view(spark, sf, "v_docs"), resolved).select("doc_id", "summary_markdown")


@query(
    "digests",
    f"""WITH {_RESOLVED}, {_extractive('SELECT fallback_reason FROM res WHERE res.doc_id = d.doc_id', 'd.doc_id IN (SELECT doc_id FROM res WHERE text IS NULL)')}
        SELECT doc_id, md AS summary_markdown FROM ext UNION ALL SELECT d.doc_id, {_MODEL_MD} FROM v_docs d JOIN res ON res.doc_id = d.doc_id WHERE text IS NOT NULL""",
)
def digests(spark, sf):
    return O.digests(view(spark, sf, "v_docs"), view(spark, sf, "v_attempts"), summary_chars=300).select("doc_id", "summary_markdown")


@query(
    "summary_points",
    f"""WITH {_RESOLVED}, good AS (SELECT doc_id, attempt FROM att WHERE reason IS NULL)
        SELECT doc_id, attempt, CAST(0 AS BIGINT) AS seq, 'Point one ' || doc_id AS point FROM good UNION ALL SELECT doc_id, attempt, 1, 'Point two' FROM good WHERE doc_id % 2 = 0""",
)
def summary_points(spark, sf):
    rows = O.read_attempts(view(spark, sf, "v_attempts"))
    points = exploded(rows, ["doc_id", "attempt"], D.summary_points(F.col("text")), "point", "seq")
    return points.withColumn("seq", F.col("seq").cast("bigint"))


def _tokens(expr: str) -> str:
    """DuckDB: distinct match tokens of a text."""
    stop = ", ".join(f"'{word}'" for word in K.TOKEN_STOP_WORDS)
    clean = f"regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"
    return f"""list_filter(list_distinct(list_concat(regexp_extract_all({clean}, '[a-z0-9]{{3,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'),
        list_transform(range(1, length({clean})), lambda i: substr({clean}, i, 2)))), lambda t: t NOT IN ({stop}))"""


_STOP = ", ".join(f"'{word}'" for word in K.TOKEN_STOP_WORDS)


@query(
    "match_tokens",
    f"""WITH c AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS t FROM documents),
        ch AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM c),
        tok AS (SELECT doc_id, ch || lead(ch) OVER (PARTITION BY doc_id ORDER BY i) AS tok FROM ch UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, '[a-z0-9]{{3,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')) FROM c)
        SELECT doc_id, count(DISTINCT tok) AS tokens, sha256(array_to_string(list_sort(list_distinct(list(tok))), '|')) AS hash FROM tok WHERE tok IS NOT NULL AND tok NOT IN ({_STOP}) GROUP BY doc_id""",
)
def match_tokens(spark, sf):
    rows = view(spark, sf, "documents").select("doc_id", D.match_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("tokens"), F.sha2(F.array_join(F.array_sort("t"), "|"), 256).alias("hash"))


# Points of a document are whole lines of it; the second is repeated so that it must move on.
_TWO = """SELECT v.doc_id, v.k AS seq, trim(regexp_replace(regexp_replace(c.text, '[*_>#`\\[\\]()]', '', 'g'), '\\s+', ' ', 'g'), ' -。；;') AS raw FROM
    (SELECT doc_id, n_lines, unnest([0, 1, 2]) AS k FROM v_videos) v JOIN v_cues c ON c.doc_id = v.doc_id AND c.seq = CASE k WHEN 0 THEN n_lines // 2 ELSE n_lines - 1 END"""
_CUE_TEXT = "trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')"
_MATCH = f"""p AS (SELECT doc_id, seq, raw AS point, {_tokens('raw')} AS toks FROM ({_TWO})),
  q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS idx, start_s, {_CUE_TEXT} AS t FROM v_cues WHERE {_CUE_TEXT} <> ''),
  w AS (SELECT doc_id, idx, start_s, t, concat_ws(' ', t, lead(t, 1) OVER s, lead(t, 2) OVER s, lead(t, 3) OVER s) AS win FROM q WINDOW s AS (PARTITION BY doc_id ORDER BY idx)),
  tw AS (SELECT doc_id, idx, start_s, {_tokens('t')} AS own, {_tokens('win')} AS win FROM w),
  cand AS (SELECT p.doc_id, p.seq, p.point, tw.idx, tw.start_s, len(list_intersect(p.toks, tw.own)) AS own, len(list_intersect(p.toks, tw.win)) AS win FROM p JOIN tw ON tw.doc_id = p.doc_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY own DESC, win DESC, idx) AS rk FROM cand WHERE win > 0),
  m0 AS (SELECT doc_id, idx, start_s FROM r WHERE seq = 0 AND rk = 1),
  m1 AS (SELECT doc_id, arg_min(idx, rk) AS idx, arg_min(start_s, rk) AS start_s FROM r WHERE seq = 1 AND NOT EXISTS (SELECT 1 FROM m0 WHERE m0.doc_id = r.doc_id AND m0.idx = r.idx) GROUP BY doc_id),
  m2 AS (SELECT doc_id, arg_min(idx, rk) AS idx, arg_min(start_s, rk) AS start_s FROM r WHERE seq = 2 AND NOT EXISTS (SELECT 1 FROM m0 WHERE m0.doc_id = r.doc_id AND m0.idx = r.idx)
     AND NOT EXISTS (SELECT 1 FROM m1 WHERE m1.doc_id = r.doc_id AND m1.idx = r.idx) GROUP BY doc_id),
  m AS (SELECT doc_id, 0 AS seq, idx, start_s FROM m0 UNION ALL SELECT doc_id, 1, idx, start_s FROM m1 UNION ALL SELECT doc_id, 2, idx, start_s FROM m2)"""


def _pointed(spark, sf):
    """Digest Markdown whose core points are lines of the document's own transcript."""
    lines = F.split("transcript", "\n")

    def point(line):
        bare = F.regexp_replace(F.substr(line, F.lit(21)), r"[*_>#`\[\]()]", "")
        return F.btrim(F.regexp_replace(bare, r"\s+", " "), F.lit(" -。；;"))

    # The original line of cue seq: the same position in the stamped text.
    size = F.size(lines)
    chosen = F.array(F.get(lines, F.floor(size / 2).cast("int")), F.get(lines, size - 1), F.get(lines, size - 1))
    bullets = F.array_join(F.transform(chosen, lambda line: F.concat(F.lit("- "), point(line))), "\n")
    return view(spark, sf, "v_transcripts").select(
        "doc_id", "transcript",
        F.concat(F.lit("# T\n\n## 核心要点\n\n"), bullets, F.lit("\n\n## 时间轴\nold\n\n## 质量检查\nok")).alias("summary_markdown"),
    )


@query(
    "match_points_to_cues",
    f"""WITH {_MATCH} SELECT p.doc_id, CAST(p.seq AS BIGINT) AS seq, m.idx AS cue_index, CAST(m.start_s AS BIGINT) AS seconds FROM p LEFT JOIN m ON m.doc_id = p.doc_id AND m.seq = p.seq WHERE p.point <> ''""",
)
def match_points_to_cues(spark, sf):
    return O.match_points_to_cues(_pointed(spark, sf)).select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"), F.col("cue_index").cast("bigint").alias("cue_index"), "seconds"
    )


@query(
    "core_timeline",
    f"""WITH {_MATCH}, items AS (SELECT p.doc_id, string_agg('- ' || point, chr(10) ORDER BY p.seq) AS bullets, string_agg('- ' || CASE WHEN m.idx IS NULL THEN '{K.TIME_UNKNOWN}' ELSE '[' || strftime(to_timestamp(m.start_s) AT TIME ZONE 'UTC', '%H:%M:%S') || '](https://v.example/x?p=1&t=' ||
            CAST(m.start_s AS BIGINT) || ') ' END || trim(point, ' -。；;'), chr(10) ORDER BY p.seq) AS timed FROM p LEFT JOIN m ON m.doc_id = p.doc_id AND m.seq = p.seq WHERE p.point <> '' GROUP BY p.doc_id)
        SELECT doc_id, '# T' || chr(10) || chr(10) || '## 核心要点' || chr(10) || chr(10) || bullets || chr(10) || chr(10) || chr(10) || '## 质量检查' || chr(10) || 'ok' || chr(10) || chr(10) || '## {K.CORE_TIMELINE}' || chr(10) || chr(10) || timed || chr(10) || chr(10) || '{K.FULL_TIMELINE_LINE}' AS markdown FROM items""",
)
def core_timeline(spark, sf):
    """The old timeline section is replaced by one item per point."""
    return O.core_timelines(_pointed(spark, sf).withColumn("url", F.lit("https://v.example/x?p=1")))
