"""End-to-end paths, packages and live jobs replayed over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from digestmill.operators import digest as D
from digestmill.operators import ledger as J
from digestmill.operators import library as L
from digestmill.plans import ingest as I
from digestmill.plans.bindings import view
from digestmill.plans.digest_queries import _extractive
from digestmill.plans.ledger_queries import FOLD_SQL, _KEY, _NOW, _TTL, _cache
from digestmill.plans.page_queries import _TEXT
from digestmill.plans.page_queries import ARTICLE_LINES, TITLE_TEXT
from digestmill.plans.registry import query
from digestmill.plans.url_queries import _CANON
from digestmill.sources import packages as P
from digestmill.sources import uploads as S


@query("read_pages", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS chars FROM pages")
def read_pages(spark, sf):
    return S.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@query(
    "decode_text",
    "SELECT doc_id, CASE WHEN doc_id % 4 <> 2 THEN sha256(text) END AS hash FROM documents",
)
def decode_text(spark, sf):
    """UTF-8 with and without a mark is decoded; bytes of other encodings are left to the file stage."""
    doc = F.col("doc_id")
    raw = F.when(doc % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(
        doc % 4 == 2, F.concat(F.unhex(F.lit("C3")), F.encode(F.lit("(latin"), "UTF-8"))
    ).otherwise(F.encode("text", "UTF-8"))
    return view(spark, sf, "documents").select("doc_id", F.sha2(S.decode_text(raw), 256).alias("hash"))


@query(
    "uploads_to_text",
    f"""WITH f AS (SELECT '/up/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.MD' END AS path, 'uploaded_text' AS input_kind, text, CAST(NULL AS VARCHAR) AS error_code FROM documents
          UNION ALL SELECT '/up/x' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.exe' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' ELSE '' END, CASE doc_id % 4 WHEN 1 THEN 'uploaded_pdf' WHEN 2 THEN 'uploaded_docx' END, NULL,
            CASE WHEN doc_id % 4 IN (1, 2) THEN 'dependency_missing' ELSE 'unsupported_document' END FROM documents
          UNION ALL SELECT '/up/p' || page_id || '.html', 'uploaded_html', concat_ws(chr(10), nullif({TITLE_TEXT}, ''), nullif({ARTICLE_LINES}, '')), NULL FROM pages)
        SELECT path, input_kind, sha256(text) AS text_hash, CAST(length(text) AS BIGINT) AS chars, error_code FROM f""",
)
def uploads_to_text(spark, sf):
    """All documents as uploaded text, as files of kinds that are refused, and the pages as HTML files."""
    doc = F.col("doc_id")
    content = F.when(doc % 5 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    documents = view(spark, sf, "documents")
    texts = documents.select(F.concat(F.lit("/up/"), doc.cast("string"), F.when(doc % 3 == 0, ".txt").otherwise(".MD")).alias("path"), content.alias("content"))
    refused = F.when(doc % 4 == 0, ".exe").when(doc % 4 == 1, ".pdf").when(doc % 4 == 2, ".docx").otherwise("")
    others = documents.select(F.concat(F.lit("/up/x"), doc.cast("string"), refused).alias("path"), content.alias("content"))
    pages = view(spark, sf, "pages").select(F.concat(F.lit("/up/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    files = texts.unionByName(others).unionByName(pages).withColumn("length", F.length("content").cast("bigint"))
    read = S.uploads_to_text(S.classify(files))
    return read.select("path", "input_kind", F.sha2("text", 256).alias("text_hash"), F.char_length("text").cast("bigint").alias("chars"), "error_code")


@query(
    "resource_package",
    f"""WITH {_extractive()}, f AS (SELECT d.doc_id, 'summary.md' AS file_name, length(rtrim(replace(md, '{{{{TIMELINE_LINK}}}}', 'timeline.md'), ' ' || chr(10))) + 1 AS chars FROM ext d
          UNION ALL SELECT doc_id, 'source_content.txt', length(rtrim(content_text, ' ' || chr(10))) + 1 FROM v_docs WHERE content_text <> ''
          UNION ALL SELECT doc_id, 'source_markdown.md', length(rtrim(content_text, ' ' || chr(10))) + 4 FROM v_docs WHERE doc_id % 2 = 0)
        SELECT doc_id, file_name, CAST(chars AS BIGINT) AS chars FROM f""",
)
def resource_package(spark, sf):
    """Text files of the packages of all digests with their lengths."""
    docs = view(spark, sf, "v_docs").withColumn(
        "content_markdown", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("md "), "content_text")).otherwise(F.col("content_text"))
    )
    files = P.resource_package(D.extractive_digest(docs, summary_chars=300))
    texts = files.filter("file_name NOT LIKE '%.json'")
    return texts.select("doc_id", "file_name", F.length("content").cast("bigint").alias("chars"))


@query(
    "resource_package_names",
    """SELECT file_name, count(*) AS n FROM (SELECT unnest(['summary.md', 'source_content.txt', 'transcript_with_timestamps.txt', 'transcript.txt', 'timeline.md', 'subtitle.vtt', 'metadata.json', 'source_info.json']) AS file_name, doc_id FROM documents)
       WHERE file_name <> 'subtitle.vtt' OR doc_id % 3 = 0 GROUP BY file_name""",
)
def resource_package_names(spark, sf):
    rows = view(spark, sf, "v_docs").join(view(spark, sf, "v_transcripts"), "doc_id").withColumnRenamed("transcript", "transcript_with_timestamps")
    rows = rows.withColumn("subtitle_vtt", F.when(F.col("doc_id") % 3 == 0, F.lit("WEBVTT\n")).otherwise("")).withColumn("summary_markdown", F.lit("# T"))
    return P.resource_package(rows).groupBy("file_name").agg(F.count("*").alias("n"))


@query("library_files", f"WITH {_extractive()} SELECT doc_id, sha256(replace(md, '{{{{TIMELINE_LINK}}}}', '120000-doc-' || doc_id || '-' || (SELECT source FROM documents x WHERE x.doc_id = e.doc_id) || '/timeline.md') || chr(10)) AS hash FROM ext e")
def library_files(spark, sf):
    digests = D.extractive_digest(view(spark, sf, "v_docs"), summary_chars=300).withColumn("written_at", F.lit("2024-03-01 12:00:00").cast("timestamp"))
    return P.library_files(digests).select("doc_id", F.sha2("content", 256).alias("hash"))


def _facts(name: str, table: str, columns: tuple[str, ...]) -> str:
    """DuckDB: the manifest row of a table."""
    texts = ", ".join(f"coalesce(CAST({column} AS VARCHAR), chr(0))" for column in columns)
    number = f"CAST('0x' || left(md5(concat_ws(chr(31), {texts})), 15) AS BIGINT)"
    return f"SELECT '{name}' AS table_name, count(*) AS rows, CAST(sum(CAST({number} AS HUGEINT)) AS VARCHAR) AS checksum FROM {table}"


_LIBRARY_COLUMNS = ("doc_id", "relative_path", "source", "content", "mtime", "size")
_EVENT_COLUMNS = ("event_id", "job_id", "ts", "op", "status", "stage", "progress", "title", "error_code", "error_message")


@query("table_facts", f"{_facts('jobs', 'v_job_events', _EVENT_COLUMNS)} UNION ALL {_facts('library', 'v_library', _LIBRARY_COLUMNS)}")
def table_facts(spark, sf):
    """Manifest rows of a snapshot of the job ledger and the library."""
    jobs = P.table_facts("jobs", view(spark, sf, "v_job_events").select(*_EVENT_COLUMNS))
    return jobs.unionByName(P.table_facts("library", view(spark, sf, "v_library").select(*_LIBRARY_COLUMNS)))


@query(
    "ingest_links",
    f"""WITH sub AS (SELECT job_id, {_CANON} AS canon, url, summary_quality, instruction, force_refresh, event_id FROM v_submissions),
        ok AS (SELECT *, canon || chr(10) || trim(instruction) || chr(10) || 'quality=' || CASE WHEN canon LIKE '%youtu%' OR canon LIKE '%bilibili%' OR canon LIKE '%b23.tv%' OR lower(summary_quality) IN ('deep', 'pro') THEN 'pro' ELSE 'fast' END || chr(10) || 'context=c1' AS key
               FROM sub WHERE url LIKE 'http%' AND url NOT LIKE 'http://10.%'),
        cached AS (SELECT cache_key, arg_max(result_json, created_at) AS result_json, max(created_at) AS m FROM (SELECT {_KEY} AS cache_key, created_at, result_json FROM v_jobs WHERE status = 'succeeded') GROUP BY cache_key),
        usable AS (SELECT cache_key FROM cached WHERE m >= TIMESTAMP '{_NOW}' - INTERVAL 14 DAY AND json_extract_string(result_json, '$.output_markdown_path') IN (SELECT relative_path FROM v_library)),
        pg AS (SELECT canon, arg_min(text, page_id) AS text FROM (SELECT page_id, {_CANON} AS canon, {_TEXT} AS text FROM pages) GROUP BY canon)
        SELECT job_id, CASE WHEN job_id NOT IN (SELECT job_id FROM ok) THEN 'invalid_url' WHEN job_id IN (SELECT job_id FROM ok WHERE NOT force_refresh AND key IN (SELECT cache_key FROM usable)) THEN 'cached'
          WHEN canon IN (SELECT canon FROM pg WHERE length(text) >= 80) THEN 'digested' ELSE 'extraction_failed' END AS outcome FROM sub""",
)
def ingest_links(spark, sf):
    """Every submission through the link path; the light extractor keeps the whole path native."""
    subs = view(spark, sf, "v_submissions")
    done = I.ingest_links(subs, view(spark, sf, "pages"), _cache(spark, sf), view(spark, sf, "v_library"), "c1", _NOW, _TTL, parser=False)
    made = done.digests.select(F.col("doc_id").alias("doc_key"), F.lit(True).alias("made"))
    worked = done.jobs.join(made, "doc_key", "left").select("job_id", F.when(F.col("made"), "digested").otherwise(F.col("error_code")).alias("outcome"))
    return worked.unionByName(done.cached.select("job_id", F.lit("cached").alias("outcome"))).unionByName(
        done.rejected.select("job_id", F.col("error_code").alias("outcome"))
    )


@query(
    "ingest_documents",
    """SELECT CAST(count(*) AS BIGINT) AS digests, CAST(count(*) FILTER (WHERE kind = 'feishu_document') AS BIGINT) AS connector FROM (SELECT DISTINCT t, kind, u FROM (
         SELECT trim(text, ' ' || chr(10)) AS t, CASE WHEN doc_id % 3 = 0 THEN 'feishu_document' ELSE 'local_file' END AS kind, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS u FROM documents WHERE doc_id % 5 <> 4 OR doc_id % 3 <> 1) WHERE length(t) >= 20)""",
)
def ingest_documents(spark, sf):
    doc = F.col("doc_id")
    source = F.when(doc % 3 == 0, F.concat(F.lit("https://x.feishu.cn/d/"), doc.cast("string"))).when((doc % 5 == 4) & (doc % 3 == 1), F.lit("http://plain.example/")).otherwise("")
    uploads = view(spark, sf, "documents").select(
        doc.alias("upload_id"), F.lit("Same title").alias("title"), F.col("text").alias("content"), source.alias("source_url"), F.lit("").alias("instruction")
    )
    digests = I.ingest_documents(uploads)
    return digests.agg(F.count("*").alias("digests"), F.count_if(F.col("source_type") == "feishu_document").alias("connector"))


@query(
    "job_deltas",
    f"""SELECT f.*, t.created_at, t.updated_at FROM ({FOLD_SQL}) f JOIN (
          SELECT job_id, min(ts) AS created_at, max(ts) AS updated_at FROM (
            SELECT *, coalesce(max(CASE WHEN op = 'cancel' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM v_job_events) WHERE gone = 0 OR op = 'cancel' GROUP BY job_id) t
        ON f.job_id IS NOT DISTINCT FROM t.job_id""",
)
def job_deltas(spark, sf):
    """Events cut into five slices that mix early and late ones, as micro-batches with late events would, and folded."""
    events = view(spark, sf, "v_job_events")
    deltas = None
    for slice_ in range(5):
        part = J.job_deltas(events.filter(F.col("event_id") % 5 == slice_))
        deltas = part if deltas is None else deltas.unionByName(part)
    return J.fold_jobs(deltas)
