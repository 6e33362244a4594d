"""Cues, timing verdicts, quality and track choice on literal rows."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from digestmill.operators import tracks as P
from digestmill.operators import transcripts as R


def test_vtt_state_machine(spark):
    body = (
        "WEBVTT\nKind: captions\nstray text\n\n1\n00:00:01.500 --> 00:00:03.000 align:start\n<c>Hello</c>  world\n00:00:04.000 --> 01:00:05.000\nnext\n"
        "line\n\n00:00:06.000 --> 00:00:07.000\n42\n\n00:00:08.000 --> 00:00:09.000\nHello world\nWEBVTT\nlost"
    )
    rows = R.cues_from_vtt(spark.createDataFrame([(1, body)], "doc_id BIGINT, body STRING")).orderBy("seq").collect()
    assert [(r["start"], r["end"], r["text"]) for r in rows] == [("00:01", "00:03", "Hello world"), ("00:04", "01:00:05", "next line")]


def test_srt_blocks(spark):
    body = "1\n00:00:01,000 --> 00:00:02,000\n<i>A</i>\nB\n\n2\n00:00:03,000 --> 00:00:04,000\n\n \n3\n00:00:05,000 --> 00:00:06,000\nA B"
    rows = R.cues_from_srt(spark.createDataFrame([(1, body)], "doc_id BIGINT, body STRING")).collect()
    assert [(r["start"], r["text"]) for r in rows] == [("00:01", "A B")]


def payload(*entries):
    import json

    return json.dumps({"body": [{"from": a, "to": b, "content": c} for a, b, c in entries]})


def verdict(spark, duration, *entries):
    frame = spark.createDataFrame([(1, payload(*entries), duration)], "doc_id BIGINT, payload STRING, duration DOUBLE")
    return R.validate_payload_timing(frame).collect()[0]


def test_payload_timing(spark):
    assert verdict(spark, 2.0, (0.2, 0.8, "a"), (0.9, 1.4, "b"))["reason"] == "ok"
    assert verdict(spark, 30.0, (10.9, 10.1, "a"))["reason"] == "invalid_timestamp_range"
    stopped = verdict(spark, 30.0, (0.0, 1.0, "a"), (5.0, 6.0, "b"), (4.0, 9.0, "c"), (10.0, 11.0, "d"))
    assert (stopped["reason"], stopped["timestamp_count"], stopped["last_timestamp_seconds"]) == ("timestamps_not_monotonic", 2, 6.0)
    assert verdict(spark, 30.0, (0.0, 1.0, " "))["reason"] == "timestamps_missing"


def test_payload_transcript_rounds_ends_up(spark, one):
    text = one(R.payload_transcript(F.lit(payload((0.2, 0.8, "a"), (0.9, 1.4, "b")))))
    assert text.splitlines()[0] == "[00:00-00:01] a"
    assert one(P.transcript_usable(F.lit(text + "\n[00:02-00:03] " + "x" * 40), F.lit(4.0)))


def timing(spark, transcript, duration):
    docs = spark.createDataFrame([(1, transcript, duration)], "doc_id BIGINT, transcript STRING, duration DOUBLE")
    return R.validate_timing(R.cues_from_transcript(docs), docs).collect()[0]


def test_validate_timing(spark):
    assert timing(spark, "[00:00-03:00] a\n[03:00-07:56] b", 198.0)["reason"] == "duration_exceeded"
    assert timing(spark, "[00:00-00:05] a\n[00:06-00:09] b", 2181.0)["reason"] == "insufficient_coverage"
    assert timing(spark, "plain text", 10.0)["reason"] == "timestamps_missing"
    # An invalid cue counts but does not move the previous start.
    mixed = timing(spark, "[00:05-00:06] a\n[00:01-00:01] b\n[00:05-00:08] c", 0.0)
    assert (mixed["reason"], mixed["timestamp_count"], mixed["timestamps_monotonic"]) == ("invalid_timestamp_range", 3, True)


def test_text_verdict_equals_table_verdict(spark):
    cases = ["[00:00-03:00] a\n[03:00-07:56] b", "[00:05-00:06] a\n[00:01-00:03] b", "[00:05-00:05] a", "[00:00-00:09] a", "x"]
    docs = spark.createDataFrame([(i, t, 198.0) for i, t in enumerate(cases)], "doc_id BIGINT, transcript STRING, duration DOUBLE")
    table = {r["doc_id"]: r["reason"] for r in R.validate_timing(R.cues_from_transcript(docs), docs).collect()}
    row = {r["doc_id"]: r["v"] for r in docs.select("doc_id", P.timing_reason(F.col("transcript"), F.col("duration")).alias("v")).collect()}
    assert table == row


def test_asr_golden(spark):
    pairs = spark.createDataFrame([(1, "你好世界", "[00:00] 你好\n[00:02] 世间", 4.0)], "doc_id BIGINT, reference STRING, hypothesis STRING, duration DOUBLE")
    row = R.evaluate_asr(pairs).collect()[0]
    assert (row["character_error_rate"], row["timing"]["duration_coverage"], row["timing"]["timestamps_monotonic"]) == (0.25, 0.5, True)


def test_edit_distance_bands(spark, one):
    for left, right, expected in (("a" * 3000, "b" * 3000, 3000), ("a" * 2000, "a" * 1500 + "b" * 500, 500), ("abc", "", 3), ("你好", "你坏", 1)):
        assert one(R.near_distance(F.lit(left), F.lit(right))) == expected == R.bit_distance(left, right)
    assert one(R.near_distance(F.lit("a" * 5000), F.lit("b" * 5000))) is None


def test_quality_of_overlong_transcript(spark):
    rows = spark.createDataFrame([(1, "[00:00-07:56] text", 198.0, "platform_subtitle")], "doc_id BIGINT, transcript STRING, duration DOUBLE, origin STRING")
    row = R.describe_quality(rows).collect()[0]
    assert row["duration_coverage"] > 2 and row["exceeds_duration"] and row["confidence"] == "low"


def test_low_value(spark, one):
    assert one(P.low_value(F.lit("[00:00-00:01] ♪ 音乐 ♪\n[00:01-00:02] Music\n[00:02-00:03] bgm")))
    assert one(P.low_value(F.lit("")))
    assert not one(P.low_value(F.lit("[00:00-00:05] a line that carries enough text to matter")))


def test_youtube_language_order(spark, one):
    schema = "s MAP<STRING, ARRAY<STRING>>, a MAP<STRING, ARRAY<STRING>>"
    manual, auto = {"en": [], "zh-Hant": [], "fr": []}, {"zh-Hans": [], "en": [], "en-orig": [], "fr": []}

    def order(automatic, *maps):
        return one(P.youtube_languages(F.col("s"), F.col("a"), F.lit("en"), automatic), schema, *maps)

    assert order(False, manual, auto)[:2] == ["zh-Hant", "en"]
    assert order(True, manual, auto)[:2] == ["en-orig", "en"]
    assert order(True, manual, None) == []
    assert order(False, None, None) == ["zh-Hans", "zh-Hant", "zh", "en"]


def test_auto_caption_keeps_original(spark):
    videos = spark.createDataFrame([(1, None, {"en-orig": [], "zh-Hans": []}, "en")], "doc_id BIGINT, subtitles MAP<STRING,ARRAY<STRING>>, automatic_captions MAP<STRING,ARRAY<STRING>>, language STRING")
    body = "WEBVTT\n\n00:00:00.000 --> 00:00:05.000\nThis is a long enough original caption line\n"
    tracks = spark.createDataFrame([(1, True, "en-orig", "vtt", body), (1, True, "zh-Hans", "vtt", body)], "doc_id BIGINT, auto BOOLEAN, language STRING, format STRING, body STRING")
    row = P.pick_youtube_track(videos, tracks).collect()[0]
    assert (row["status"], row["language"]) == ("youtube_auto_subtitle", "en-orig")


def bilibili(spark, url, bodies):
    videos = spark.createDataFrame([(1, url, "bv1abc", [60.0], 0.0, False)], "doc_id BIGINT, url STRING, api_bvid STRING, page_durations ARRAY<DOUBLE>, duration DOUBLE, player_failed BOOLEAN")
    tracks = spark.createDataFrame([(1, str(10 + i), f"//s/{i}?a=1", "zh-CN", "中文", i) for i in range(len(bodies))], "doc_id BIGINT, id STRING, subtitle_url STRING, lan STRING, lan_doc STRING, ai_type INT")
    payloads = spark.createDataFrame([(f"https://s/{i}?a=1", body) for i, body in enumerate(bodies)], "subtitle_url STRING, payload STRING")
    return P.pick_bilibili_track(videos, tracks, payloads).collect()[0]


def test_second_track_wins(spark):
    long = "the caption of the video that is long enough"
    row = bilibili(spark, "https://www.bilibili.com/video/BV1abc", [payload((0, 45, long), (46, 90, long)), payload((0, 7, long), (22, 24, "two"), (56, 58, "three"))])
    assert row["status"] == "bilibili_subtitle" and row["subtitle_id"] == "11"
    assert "duration_exceeded" in row["rejections"] and row["subtitle_vtt"].startswith("WEBVTT\n\n00:00:00.000 --> 00:00:07.000")


def test_page_out_of_range(spark):
    assert bilibili(spark, "https://www.bilibili.com/video/BV1abc?p=2", [payload((0, 7, "x"))])["status"] == "bilibili_page_not_found"


def test_failure_categories(spark, one):
    logs = ["Sign in to confirm you're not a bot", "PO Token required", "missing proof of origin", "HTTP Error 429", "other"]
    assert [one(P.youtube_failure(F.lit(log))) for log in logs] == [
        "youtube_auth_required", "youtube_po_token_required", "youtube_po_token_required", "youtube_rate_limited", "",
    ]


def test_distance_by_bits_is_exact(spark):
    draw = random.Random(12)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for _ in range(400):
        a, b = ("".join(draw.choices("ab\u4e2d\U0001f600x", k=draw.randrange(12))) for _ in range(2))
        assert R.bit_distance(a, b) == plain(a, b) == R.bit_distance(b, a), (a, b)
    texts = ["".join(draw.choices("abcdefgh ", k=draw.randrange(900, 1500))) for _ in range(8)]
    frame = spark.createDataFrame([(a, b) for a in texts[:4] for b in texts[4:]], "a STRING, b STRING")
    rows = frame.select("a", "b", F.levenshtein("a", "b").alias("want"), R.near_distance(F.col("a"), F.col("b")).alias("near"), R.far_distance("a", "b").alias("far")).collect()
    assert all(row["want"] == row["near"] == row["far"] for row in rows)


def test_unlike_long_texts_are_bounded(spark):
    """Two texts of 100,000 characters with nothing in common but their letters, beside equal and missing ones."""
    draw = random.Random(13)
    long = ["".join(draw.choices("abcdefghijklmnopqrst", k=100_000)) for _ in range(2)]
    started = time.monotonic()
    frame = spark.createDataFrame([(1, long[0], long[1], 10.0), (2, long[0], long[0], 10.0), (3, "", "abc", 10.0)], "doc_id INT, reference STRING, hypothesis STRING, duration DOUBLE")
    rows = {row["doc_id"]: row for row in R.evaluate_asr(frame).collect()}
    assert 60_000 < rows[1]["distance"] < 100_000 and rows[2]["distance"] == 0 and rows[3]["distance"] == 3
    assert time.monotonic() - started < 120


def test_long_pairs_need_no_table_where_bounds_meet(spark, monkeypatch):
    """Long texts whose edits are seen in one pass are not counted in a table; all others still are, with the same result."""
    import pytest

    rand = random.Random(7)
    for _ in range(300):
        a = "".join(rand.choice("abc字") for _ in range(rand.randrange(0, 14)))
        b = "".join(rand.choice(a + "ad") if rand.random() < 0.4 else char for char in a) + "b" * rand.randrange(0, 3)
        assert R.edit_distance(a, b) == R.bit_distance(a, b) == R.edit_distance(b, a), (a, b)
    text = "".join(rand.choice("abcdef") for _ in range(200_000))
    monkeypatch.setattr(R, "bit_distance", lambda *_: pytest.fail("a table for a pair that one pass settles"))
    assert R.edit_distance(text, text) == 0
    assert R.edit_distance(text, text.replace("e", "a")) == text.count("e")
    assert R.edit_distance(text, text[:900] + "zz" + text[900:]) == 2


def test_long_pairs_skip_the_native_table(spark):
    """The built-in distance would step through 120,000 characters once per character."""
    text = "abcdefghij" * 12_000
    frame = spark.createDataFrame([(1, text, "[00:00] " + text.replace("e", "a"), None)], "doc_id long, reference string, hypothesis string, duration double")
    row = R.evaluate_asr(frame).first()
    assert (row.distance, row.reference_chars, row.grade) == (12_000, 120_000, "good")
