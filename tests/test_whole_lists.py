"""Lists and texts come whole unless a caller asks for a length."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from digestmill.functions import pages as PF
from digestmill.operators import digest as O
from digestmill.operators import ledger as J
from digestmill.operators import notify as N
from digestmill.operators import tracks as P
from digestmill.sources import uploads as S

BODY = "WEBVTT\n\n00:00:00.000 --> 00:00:05.000\nThis is a long enough original caption line\n"
MAPS = "subtitles MAP<STRING,ARRAY<STRING>>, automatic_captions MAP<STRING,ARRAY<STRING>>"


def test_last_of_many_languages_is_picked(spark):
    names = [f"l{number:02d}" for number in range(20)]
    every = {name: [] for name in names}
    videos = spark.createDataFrame([(1, every, None, "xx"), (2, None, every, "xx")], f"doc_id BIGINT, {MAPS}, language STRING")
    ranked = {auto: [row.language for row in P.rank_youtube_languages(videos, auto).orderBy("place").collect()] for auto in (False, True)}
    assert sorted(ranked[False]) == sorted(ranked[True]) == names
    assert [row.language for row in P.rank_youtube_languages(videos, True, most=8).orderBy("place").collect()] == ranked[True][:8]
    rows = [(1, False, ranked[False][16], "vtt", BODY), (2, True, ranked[True][8], "vtt", BODY)]
    tracks = spark.createDataFrame(rows, "doc_id BIGINT, auto BOOLEAN, language STRING, format STRING, body STRING")
    picked = {row.doc_id: (row.status, row.language) for row in P.pick_youtube_track(videos, tracks).collect()}
    assert picked == {1: ("youtube_manual_subtitle", ranked[False][16]), 2: ("youtube_auto_subtitle", ranked[True][8])}


def test_video_text_lists_all(one):
    data = json.dumps({"title": "T", "tags": [f"t{n}" for n in range(25)], "automatic_captions": {f"c{n:02d}": [] for n in range(15)}})
    text = one(PF.video_text(F.lit(data), F.lit("https://u.example")))
    assert "t24" in text and "c14" in text
    short = one(PF.video_text(F.lit(data), F.lit("https://u.example"), most_tags=20, most_captions=10))
    assert "t19" in short and "t20" not in short and "c09" in short and "c10" not in short


def test_texts_are_whole(spark):
    changes = spark.createDataFrame([("j", "failed", "e" * 900)], "job_id STRING, status STRING, error_message STRING")
    sizes = [len(json.loads(N.notification_feed(changes, ["job.failed"], error_chars=most).collect()[0].payload)["error_message"]) for most in (None, 500)]
    assert sizes == [900, 500]
    uploads = spark.createDataFrame([("t" * 400, "long enough content of an upload")], "title STRING, content STRING")
    assert [len(J.document_gate(uploads, most).collect()[0].title) for most in (None, 180)] == [400, 180]
    files = spark.createDataFrame([("a.txt", 300 << 20)], "path STRING, length BIGINT")
    assert [S.classify(files, 400 << 20, cap).collect()[0].error_code for cap in (None, 200 << 20)] == [None, "document_too_large"]


def test_text_without_a_sentence_is_its_own_summary(spark):
    schema = "doc_id BIGINT, title STRING, canonical_url STRING, source_type STRING, extraction_method STRING, content_text STRING, instruction STRING"
    docs = spark.createDataFrame([(1, "T", "https://u.example", "web", "m", "ab. " * 150 + "the end", None)], schema)
    whole, short = (O.extractive_digest(docs, most).collect()[0].summary_markdown for most in (None, 300))
    assert "the end\n\n## Key Points" in whole and "the end" not in short
