"""Uploads, sinks, snapshots and streams through real folders."""

from __future__ import annotations

import datetime as dt
import json
import random
import re

from pyspark.sql import functions as F

from digestmill.functions import text as T
from digestmill.operators import cache as C
from digestmill.operators import digest as D
from digestmill.operators import ledger as J
from digestmill.operators import library as L
from digestmill.plans.bindings import view
from digestmill.sources import packages as P
from digestmill.sources import uploads as S
from digestmill.streaming import live as W

SF = "/root/testdata/sf0.001"


def test_uploads(spark, tmp_path):
    files = {
        "a.txt": "﻿utf text".encode(), "b.md": "中文内容".encode("gb18030"), "c.html": b"<html><head><title>T</title><style>x</style></head><body><p>out</p><article>Hello <b>HTML</b> body</article></body></html>",
        "f.exe": b"x", "g.docx": b"PK", "h.epub": b"PK", "i.pdf": b"%PDF", "j.txt": "caf\xe9 \xff".encode("latin-1"), "k.htm": "<title>标题</title><p>正文</p>".encode("gb18030"),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = {row["path"].rsplit("/", 1)[1]: row for row in S.uploads_to_text(S.read_uploads(spark, str(tmp_path))).collect()}
    assert rows["a.txt"]["text"] == "utf text" and rows["b.md"]["text"] == "中文内容"
    assert rows["c.html"]["text"] == "T\nHello\nHTML\nbody" and rows["c.html"]["input_kind"] == "uploaded_html"
    assert rows["k.htm"]["text"] == "标题\n标题\n正文"
    codes = {name: rows[name]["error_code"] for name in ("f.exe", "g.docx", "h.epub", "i.pdf")}
    assert codes == {"f.exe": "unsupported_document", "g.docx": "dependency_missing", "h.epub": "dependency_missing", "i.pdf": "dependency_missing"}
    assert rows["g.docx"]["error_message"] == "A DOCX text extractor is required to extract uploaded DOCX text."
    assert rows["j.txt"]["text"]


def test_size_bounds(spark):
    sizes = spark.createDataFrame([("a.txt", 0), ("b.txt", 10), ("c.txt", 11)], "path STRING, length BIGINT")
    codes = {r["path"]: r["error_code"] for r in S.classify(sizes, max_bytes=10).collect()}
    assert codes == {"a.txt": "document_too_large", "b.txt": None, "c.txt": "document_too_large"}


def test_manifest(spark, tmp_path):
    path = tmp_path / "samples.json"
    path.write_text(json.dumps({"samples": [{"id": "a", "url": "u", "minimum_core_points": 3}, {"id": "b", "expected_bvid": "BV1"}]}, indent=1))
    rows = S.read_manifest(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["minimum_core_points"], r["expected_bvid"]) for r in rows] == [("a", 3, None), ("b", None, "BV1")]


def test_package_of_a_video(spark):
    row = ("T", "https://v.example/x", "bilibili", "text", "markdown", "[00:00-00:05] first\n[00:05-00:09] second", "WEBVTT\n", '{"id":1}', "# T")
    frame = spark.createDataFrame([(1, *row)], "doc_id BIGINT, title STRING, canonical_url STRING, source_type STRING, content_text STRING, content_markdown STRING, transcript_with_timestamps STRING, subtitle_vtt STRING, raw_metadata STRING, summary_markdown STRING").withColumn("extraction_method", F.lit("m"))
    files = {r["file_name"]: r["content"] for r in P.resource_package(frame).collect()}
    names = {"summary.md", "source_content.txt", "source_markdown.md", "subtitle.vtt", "transcript_with_timestamps.txt", "transcript.txt", "timeline.md", "raw_metadata.json", "metadata.json", "source_info.json"}
    assert set(files) == names
    assert "- [00:00](https://v.example/x?t=0) first" in files["timeline.md"] and files["transcript.txt"] == "first\nsecond\n"
    assert json.loads(files["source_info.json"])["resource_files"] == sorted(names - {"source_info.json"})


def test_write_library_round_trip(spark, tmp_path):
    digests = D.extractive_digest(view(spark, SF, "v_docs")).withColumn("written_at", F.lit("2024-03-01 12:00:00").cast("timestamp"))
    P.write_library(digests, str(tmp_path / "lib"))
    stored = spark.read.parquet(str(tmp_path / "lib"))
    assert stored.count() == digests.count() and stored.select("relative_path").distinct().count() == digests.count()
    assert (tmp_path / "lib" / "date=2024-03-01" / "source_dir=feishu-document").is_dir()


def test_snapshots_keep_history(spark, tmp_path):
    root = str(tmp_path / "snap")
    first = P.snapshot({"t": spark.range(5)}, root, dt.datetime(2024, 1, 1))
    P.snapshot({"t": spark.range(7)}, root, dt.datetime(2024, 1, 2))
    assert first.collect()[0]["rows"] == 5
    newest = P.latest_snapshot(spark, root).collect()[0]
    assert newest["rows"] == 7 and spark.read.parquet(newest["folder"]).count() == 7
    assert P.table_facts("t", spark.range(5).repartition(3)).collect()[0]["checksum"] == first.collect()[0]["checksum"]


def event_stream(spark, tmp_path, files=4):
    """The bound job events, cut by time into files that become micro-batches."""
    events = view(spark, SF, "v_job_events")
    source = tmp_path / "events"
    for part in range(files):
        events.filter(F.floor((F.dayofmonth("ts") - 1) / 8) == part).coalesce(1).write.parquet(str(source / f"part={part}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    return events, stream


def test_stream_state_equals_batch(spark, tmp_path):
    events, stream = event_stream(spark, tmp_path)
    W.stream_jobs(stream, str(tmp_path / "jobs"), str(tmp_path / "ck"), once=True).awaitTermination()
    fields = ["job_id", "status", "stage", "progress", "title", "error_code", "error_message"]
    assert len(list((tmp_path / "jobs").glob("batch=*"))) == 4
    live = sorted(map(str, W.current_jobs(spark, str(tmp_path / "jobs")).select(*fields).collect()))
    assert live == sorted(map(str, J.fold_jobs(events).select(*fields).collect()))
    W.compact_jobs(spark, str(tmp_path / "jobs"), str(tmp_path / "compact"))
    assert sorted(map(str, W.current_jobs(spark, str(tmp_path / "compact")).select(*fields).collect())) == live


def test_closed_state_equals_batch_fold(spark, tmp_path):
    """Whatever is closed when, with late writes and with cancels that come long after what they take back."""
    draw = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    schema = "event_id LONG, job_id STRING, ts TIMESTAMP, op STRING, status STRING, stage STRING, progress LONG, title STRING, error_code STRING, error_message STRING"
    fields = ["job_id", "status", "stage", "progress", "title", "error_code", "error_message", "created_at", "updated_at", "applied_events"]
    root, rows = str(tmp_path / "jobs"), []
    for batch in range(6):
        own = []
        for _ in range(60):
            op = draw.choice(["update", "update", "update", "succeed", "fail", "cancel"])
            late = draw.choice([0, 0, 0, 30, 400])  # minutes; the delay is an hour
            ts = start + dt.timedelta(minutes=100 * batch + draw.randrange(100) - late)
            outcome = ("canceled", "canceled", None, None, "canceled", "by the user") if op == "cancel" else (
                draw.choice(["running", "done", None]), draw.choice(["read", None]), draw.choice([5, 50, None]), draw.choice(["t1", None]), draw.choice(["e", None]) if op == "fail" else None, None)
            own.append((len(rows) + len(own), f"job{draw.randrange(25)}", ts, op, *outcome))
        rows += own
        frame = spark.createDataFrame(own, schema)
        J.job_deltas(frame).withColumn("bucket", W._job_bucket()).write.partitionBy("bucket").parquet(f"{root}/batch={batch:012d}")
        if batch in (1, 3, 4):
            W.close_jobs(spark, root)
        want = sorted(map(str, J.fold_jobs(spark.createDataFrame(rows, schema)).select(*fields).collect()))
        assert sorted(map(str, W.current_jobs(spark, root).select(*fields).collect())) == want, batch
    some = spark.createDataFrame([("job3",), ("job7",)], "job_id STRING")
    assert sorted(map(str, W.current_jobs(spark, root, some).select(*fields).collect())) == [row for row in want if "'job3'" in row or "'job7'" in row]
    # What was folded is not read again: the open tail and the newer batches are.
    closed = W._closed(spark, root)
    _, tail = W._open_log(spark, root, closed)
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert closed["batch"] == 4 and re.search(r"PartitionFilters: \[[^\]]*\(batch#\d+L? > 4\)", plan)
    assert tail.count() < len(rows) / 2


def test_stream_closes_as_it_goes(spark, tmp_path):
    events, stream = event_stream(spark, tmp_path)
    W.stream_jobs(stream, str(tmp_path / "jobs"), str(tmp_path / "ck"), once=True, close_every=2, delay="2 days").awaitTermination()
    fields = ["job_id", "status", "stage", "progress", "title", "error_code", "error_message", "applied_events"]
    assert W._closed(spark, str(tmp_path / "jobs"))["version"] == 1
    assert sorted(map(str, W.current_jobs(spark, str(tmp_path / "jobs")).select(*fields).collect())) == sorted(map(str, J.fold_jobs(events).select(*fields).collect()))


REQUEST = "cache_key STRING, request_id STRING, ts TIMESTAMP, force_refresh BOOLEAN"
RESULT = "cache_key STRING, ts TIMESTAMP, result_json STRING"


def test_stream_answers_repeats(spark, tmp_path):
    """A repeat inside seven days of the last write, a forced request, a replaced result, an expired one."""
    day = lambda days, hours=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=days, hours=hours)
    batches = [
        ([("a", "r1", day(0), False), ("b", "r2", day(0), None)], [("a", day(0, 1), "A1")]),
        ([("a", "r3", day(2), False), ("a", "r4", day(3), True), ("b", "r5", day(3), False)], [("a", day(3, 1), "A2"), ("b", day(4), "B1")]),
        ([("a", "r6", day(10), False), ("b", "r7", day(11), False), ("b", "r8", day(11, 1), False)], []),
        ([("a", "r9", day(30), False), ("c", "r10", day(30), False)], [("c", day(30, 1), "C1")]),
        ([("c", "r11", day(31), False), ("b", "r12", day(31), False)], [("c", day(30), "older")]),
    ]
    for number, (requests, results) in enumerate(batches):
        rows = W.reuse_rows(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(results, RESULT))
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={number}"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        W.stream_reuse(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = {row["request_id"]: row["result_json"] for row in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"r1": None, "r2": None, "r3": "A1", "r4": None, "r5": None, "r6": "A2", "r7": "B1", "r8": None, "r9": None, "r10": None, "r11": "C1", "r12": None}
    state = spark.read.format("statestore").load(str(tmp_path / "ck")).select("key.cache_key").distinct()
    assert {row["cache_key"] for row in state.collect()} == {"c"}


def test_reuse_equals_the_batch_lookup(spark, tmp_path):
    """Requests after all results get what the batch lookup gives, and a request is never answered by a later result."""
    now = dt.datetime(2024, 2, 1)
    cache = [(f"k{i}", now - dt.timedelta(days=i % 12, seconds=i), f'{{"output_markdown_path":"p{i}"}}') for i in range(40)]
    asked = [(f"k{i % 45}", f"r{i}", now, i % 7 == 0) for i in range(60)]
    rows = W.reuse_rows(spark.createDataFrame(asked, REQUEST), spark.createDataFrame(cache, RESULT))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    W.stream_reuse(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    stored = spark.createDataFrame([(key, "t", result, ts) for key, ts, result in cache], "cache_key STRING, title STRING, result_json STRING, updated_at TIMESTAMP")
    library = spark.createDataFrame([(f"p{i}",) for i in range(40)], "relative_path STRING")
    want = C.cache_lookup(spark.createDataFrame(asked, REQUEST), stored, library, now="2024-02-01 00:00:00")
    key = lambda row: (row["request_id"], row["hit"], row["result_json"])
    assert sorted(map(str, map(key, spark.read.parquet(str(tmp_path / "out")).collect()))) == sorted(map(str, map(key, want.collect())))


def test_live_search_follows_the_folder(spark, tmp_path, monkeypatch):
    """Deleted files leave the search without a compaction; changed files and files that come back are read again."""
    root, folder = str(tmp_path / "index"), tmp_path / "files"
    place = folder / "2024-01-01" / "web"
    place.mkdir(parents=True)
    for name in ("a", "b", "c", "latest"):
        (place / f"{name}.md").write_text(f"# {name}\nshared words")

    def found(query="shared"):
        return sorted(row["relative_path"][-4:] for row in L.search(W.current_library(spark, root), W.current_postings(spark, root, L.query_tokens(query)), query).collect())

    assert W.sync_library(spark, str(folder), root) == {"changed": 3, "removed": 0} and found() == ["a.md", "b.md", "c.md"]
    (place / "b.md").unlink()
    (place / "c.md").write_text("# c\nother words entirely")
    monkeypatch.setattr(W, "MOST_PATHS", 0)
    assert W.sync_library(spark, str(folder), root) == {"changed": 1, "removed": 1}
    assert found() == ["a.md"] and found("entirely") == ["c.md"]
    assert W.sync_library(spark, str(folder), root) == {"changed": 0, "removed": 0}
    (place / "b.md").write_text("# b again\nshared words")
    (place / "a.md").unlink()
    assert W.sync_library(spark, str(folder), root) == {"changed": 1, "removed": 1} and found() == ["b.md"]
    W.compact_index(spark, root, str(tmp_path / "compact"))
    assert {row["relative_path"][-4:] for row in W.current_library(spark, str(tmp_path / "compact")).collect()} == {"b.md", "c.md"}


def test_stream_notify_writes_each_event_once(spark, tmp_path):
    events, stream = event_stream(spark, tmp_path)
    for _ in range(2):
        W.stream_notify(stream, ["job.failed"], str(tmp_path / "feed"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "feed")).count() == events.filter("status = 'failed'").count()


def test_stream_dedupe(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 3}", dt.datetime(2024, 1, 1, i)) for i in range(9)], "cache_key STRING, ts TIMESTAMP")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = W.stream_dedupe(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["cache_key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["k0", "k1", "k2"]


def test_stream_index_equals_batch_upsert(spark, tmp_path):
    root, folder = tmp_path / "index", tmp_path / "files"
    (folder / "2024-01-01" / "web").mkdir(parents=True)
    (folder / "2024-01-01" / "web" / "a.md").write_text("# First\nalpha beta")
    (folder / "2024-01-01" / "web" / "latest.md").write_text("# Hidden")

    def sync():
        W.stream_index(W.read_library_stream(spark, str(folder)), str(root), str(tmp_path / "ck"), once=True).awaitTermination()

    sync()
    (folder / "2024-01-01" / "web" / "b.md").write_text("# Second\nbeta gamma")
    sync()
    rows = W.current_library(spark, str(root))
    assert {(r["relative_path"], r["title"], r["source_type"]) for r in rows.collect()} == {("2024-01-01/web/a.md", "First", "web"), ("2024-01-01/web/b.md", "Second", "web")}
    for postings in (W.current_postings(spark, str(root)), W.current_postings(spark, str(root), L.query_tokens("beta"))):
        assert {r["relative_path"] for r in L.search(rows, postings, "beta").collect()} == {"2024-01-01/web/a.md", "2024-01-01/web/b.md"}
    W.compact_index(spark, str(root), str(tmp_path / "compact"), spark.createDataFrame([("2024-01-01/web/a.md",)], "relative_path STRING"))
    rows, postings = W.current_library(spark, str(tmp_path / "compact")), W.current_postings(spark, str(tmp_path / "compact"), ["beta"])
    assert [r["relative_path"] for r in L.search(rows, postings, "beta").collect()] == ["2024-01-01/web/b.md"]


def test_stored_search_prunes_by_token(spark, tmp_path):
    rows = L.library_rows(view(spark, SF, "v_files"))
    L.write_postings(L.build_postings(rows), str(tmp_path / "p"), files=6)
    plan = L.matching_paths(spark.read.parquet(str(tmp_path / "p")), L.query_clauses("the of"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token, [of,the])]" in plan.replace("IsNotNull(token), ", "")


def test_write_postings_splits_and_sorts(spark, tmp_path):
    rows = L.library_rows(view(spark, SF, "v_files"))
    L.write_postings(L.build_postings(rows), str(tmp_path / "p"), files=6)
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert stored.count() == L.build_postings(rows).count() and len(list((tmp_path / "p").glob("*.parquet"))) > 1
    assert {r[0] for r in L.search(rows, stored, "the of").select("relative_path").collect()} == {r[0] for r in L.search(rows, L.build_postings(rows), "the of").select("relative_path").collect()}


def test_checksums_write_numbers_as_other_engines_do(spark):
    import duckdb

    values = [36e6, 1e15, 1e16, 1.5e16, 1e22, 1e-4, 1e-5, 1.25e-7, 123456789.125, 1e300, -2.5e8, 0.0, -0.0, 0.1, 1234567890123456.0, float("nan"), float("inf"), -float("inf"), 1e-3, 9999999.5]
    rows = spark.createDataFrame([(i, value) for i, value in enumerate(values)], "i INT, x DOUBLE")
    written = [row["t"] for row in rows.orderBy("i").select(T.number_text(F.col("x")).alias("t")).collect()]
    assert written == [duckdb.execute("SELECT CAST(CAST(? AS DOUBLE) AS VARCHAR)", [value]).fetchone()[0] for value in values]
    number = duckdb.execute("SELECT CAST('0x' || left(md5(CAST(CAST(36e6 AS DOUBLE) AS VARCHAR)), 15) AS BIGINT)").fetchone()[0]
    assert P.table_facts("t", rows.filter("i = 0").select("x")).collect()[0]["checksum"] == str(number)
