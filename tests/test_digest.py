"""Digest texts, model responses, points and timelines on literal rows."""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import digest as D
from digestmill.operators import digest as O

CUES = "[00:02-00:10] 开场介绍今天的主题\n[00:32-00:40] 模型切换会让缓存失效需要重新计算\n[01:20-01:30] 强制刷新可以绕过缓存直接重跑"


D_PART = O.PART_CUES


@lru_cache(maxsize=None)
def tokens(text):
    """Brute-force match tokens."""
    clean = re.sub(r"[^\w一-鿿]", "", text.lower())
    found = set(re.findall(r"[a-z0-9]{3,}|[一-鿿]{2,}", clean)) | {clean[i : i + 2] for i in range(len(clean) - 1)}
    return found - set(K.TOKEN_STOP_WORDS)


def greedy(points, cues):
    used, out = set(), []
    for point in points:
        best = None
        for i, text in enumerate(cues):
            window = len(tokens(point) & tokens(" ".join(cues[i : i + 4])))
            key = (len(tokens(point) & tokens(text)), window, -i)
            if i not in used and window and (best is None or key > best):
                best = key
        out.append(None if best is None else -best[2])
        used |= set() if best is None else {-best[2]}
    return out


def test_match_tokens(spark, one):
    for text in ("", "a", "Hello, World 42!", "模型切换 cache_key，可以", "𠀀𠀁x好", "ab ab ab"):
        assert set(one(D.match_tokens(F.lit(text)))) == tokens(text), text


def test_points_match_greedily_like_brute_force(spark):
    lines = [f"[00:{i:02d}-00:{i + 1:02d}] shared words about topic {i % 4} and item {i}" for i in range(12)]
    cues = [line.split("] ", 1)[1] for line in lines]
    points = ["topic 2 item 6", "topic 2 item 6", "shared words", "zzqq", "item 11 topic 3", "topic 2 item 6"]
    frame = spark.createDataFrame([(1, "\n".join(lines), points)], "doc_id BIGINT, transcript STRING, points ARRAY<STRING>")
    hits = frame.select(D.match_points(F.col("points"), D.timeline_cues(F.col("transcript"))).alias("h")).collect()[0]["h"]
    assert [hit["index"] for hit in hits] == greedy(points, cues)


def test_points_match_in_parts_of_a_long_transcript(spark):
    """Whole texts, windows over part borders, points that lose many cues, documents without cues or points."""
    draw = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("ono", "iti", "ulu")]

    def line(at, text):
        return f"[{at // 60:02d}:{at % 60:02d}-99:00] {text}"

    documents = []
    for doc_id, size in enumerate((0, 1, 3, D_PART - 1, D_PART + 2, 3 * D_PART)):
        texts = [" ".join(draw.choices(words, k=draw.randrange(1, 4))) for _ in range(size)]
        texts = [text + " " + "x" * 200 + f" tail{at}" if at % 50 == 7 else text for at, text in enumerate(texts)]
        points = [" ".join(draw.choices(words, k=3)) for _ in range(4)] + ["the same point"] * 2 + [texts[0] if texts else "alone"] * 5 + (["tail107"] if size > 107 else []) + ["zzqqzz"]
        documents.append((doc_id, "## 核心要点\n" + "\n".join(f"- {point}" for point in points) + "\n", "\n".join(line(at, text) for at, text in enumerate(texts)), points, texts))
    frame = spark.createDataFrame([row[:3] for row in documents] + [(99, "no points", line(1, "ab"))], "doc_id BIGINT, summary_markdown STRING, transcript STRING")
    rows = O.match_points_to_cues(frame).orderBy("doc_id", "seq").collect()
    for doc_id, _, _, points, texts in documents:
        own = [row for row in rows if row["doc_id"] == doc_id]
        assert [row["point"] for row in own] == points and [row["cue_index"] for row in own] == greedy(points, texts), doc_id
        assert all(row["seconds"] == row["cue_index"] for row in own if row["cue_index"] is not None and row["cue_index"] < 6000)
    assert not [row for row in rows if row["doc_id"] == 99]
    inside = frame.select("doc_id", D.core_timeline(F.col("summary_markdown"), F.lit("u"), F.col("transcript")).alias("markdown"))
    spread = O.core_timelines(frame.withColumn("url", F.lit("u")))
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, inside.collect()))


def test_cuts_are_the_callers_to_ask_for(spark, one):
    long = "word " * 100 + "end"
    assert one(D.clean_point(F.lit(long))) == long and len(one(D.clean_point(F.lit(long), 180))) == 180
    assert one(D.error_reason(F.lit(500), F.lit(long))).endswith(" end") and one(D.error_reason(F.lit(500), F.lit(long), 20)).endswith("): word word word word ")
    assert len(one(D.timeline_cues(F.lit("[00:01] " + long)))[0]["text"]) == len(long) and len(one(D.timeline_cues(F.lit("[00:01] " + long), 160))[0]["text"]) == 160


def test_timeline_points(spark, one):
    markdown = "# T\n\n## 核心要点\n\n- 模型切换会让缓存失效\n- 强制刷新绕过缓存\n"
    text = one(D.core_timeline(F.lit(markdown), F.lit("https://v.example/x"), F.lit(CUES)))
    assert "[00:32](https://v.example/x?t=32) 模型切换会让缓存失效" in text and "[01:20](https://v.example/x?t=80) 强制刷新绕过缓存" in text


def test_timeline_has_one_item_per_point(spark, one):
    markdown = "## 核心要点\n- 模型切换\n- 强制刷新\n- qqzz\n\n## 时间轴\n- old\n\n## 质量检查\nok"
    text = one(D.core_timeline(F.lit(markdown), F.lit("u?p=1"), F.lit("\n".join(CUES.splitlines()[1:]))))
    assert "old" not in text and text.count("](u?p=1&t=") == 2 and f"- {K.TIME_UNKNOWN}qqzz" in text


def test_summary_points_precedence(spark, one):
    def points(markdown):
        return one(D.summary_points(F.lit(markdown)))

    assert points("## Key Points\n\n- a\n2) [b](http://x)\n") == ["a", "b"]
    assert points("## 核心要点时间轴\n- no\n\n## 一句话结论\n 一句 `话`。\n\n## x") == ["一句 话"]
    assert points("nothing") == []


def test_sanitize(spark, one):
    def clean(text):
        row = one(D.sanitize_response(F.lit(text)))
        return row["text"], row["error"]

    assert clean("<think>never closed ## 核心要点")[1] == K.ERR_REASONING
    assert clean("```markdown\n<THINK a=1>x</THINK>\nintro\n## 核心要点\n- a\n```") == ("## 核心要点\n- a", None)
    assert clean("## 核心要点\n# 硬性规则")[1] == K.ERR_LEAK


def test_ensure_sections(spark, one):
    text = one(D.ensure_sections(F.lit("## 核心要点\n- a\n")))
    assert all(section in text for section in K.REQUIRED_SECTIONS) and text.endswith("## 质量检查\n未生成。")
    assert one(D.ensure_sections(F.lit(""))) == ""


def test_response_shapes(spark, one):
    bodies = {
        json.dumps({"choices": [{"message": {"content": None}}], "output_text": "no"}): "",
        json.dumps({"choices": [], "output_text": "yes"}): "yes",
        json.dumps({"choices": [{"message": {"content": ["a", {"text": "b"}, {"type": "image", "text": "c"}]}}]}): "a\nb",
        json.dumps({"output": [{"type": "reasoning", "content": [{"text": "h"}]}, {"content": [{"type": "output_text", "text": " x "}]}]}): "x",
        "not json": "",
    }
    for body, expected in bodies.items():
        assert one(D.response_text(F.lit(body))) == expected, body


def test_sentences(spark, one):
    assert one(D.sentences(F.lit("Short. This one is long enough to stay here. 这一句也足够长，可以被保留下来，因为它有二十多个字。"))) == [
        "This one is long enough to stay here.", "这一句也足够长，可以被保留下来，因为它有二十多个字。",
    ]
    assert len(one(D.sentences(F.lit("\n".join(f"line number {i} here" for i in range(5)))))) == 5
    assert one(D.sentences(F.lit("  "))) == []


def test_key_points_fall_back_to_all(spark, one):
    assert one(D.key_sentences(F.array(F.lit("a"), F.lit("b"), F.lit("a")))) == ["a", "b"]
    assert one(D.key_sentences(F.array(*[F.lit(c) for c in "abcda"]))) == ["d", "a"]


ATTEMPTS = "doc_id BIGINT, attempt INT, provider STRING, model STRING, base_url STRING, ready BOOLEAN, http_code INT, body STRING"
DOCUMENT = "doc_id BIGINT, title STRING, canonical_url STRING, source_type STRING, content_text STRING, extraction_method STRING"


def test_backup_models_are_used_in_turn(spark):
    good = json.dumps({"choices": [{"message": {"content": "## 核心要点\n- a"}}]})
    rows = [
        (1, 1, "openai_compatible", "one", "https://api.openai.com/v1", True, 429, "slow down"), (1, 2, "openai_compatible", "two", "http://localhost:1234/v1", True, 200, good),
        (2, 1, "deepseek", "one", "", True, 500, ""), (2, 2, "openai_compatible", "two", "", False, None, None), (2, 3, "openai_compatible", "three", "", True, 200, good),
    ]
    documents = spark.createDataFrame([(i, "T", "https://u", "web", "A sentence that is long enough to count.", "m") for i in (1, 2)], DOCUMENT)
    attempts = spark.createDataFrame(rows, ATTEMPTS)
    every = {row["doc_id"]: row["summary_markdown"] for row in O.digests(documents, attempts).collect()}
    assert "- Automatic fallback: one failed; switched to three." in every[2]
    assert {row["doc_id"]: row["model"] for row in O.resolve_attempts(attempts, most=2).collect()} == {1: "two", 2: None}
    made = {row["doc_id"]: row for row in O.digests(documents, attempts.filter("attempt <= 2")).collect()}
    assert "- Automatic fallback: one failed; switched to two." in made[1]["summary_markdown"] and "- Provider: LM Studio" in made[1]["summary_markdown"]
    assert "- Fallback reason: one: model API provider server error (HTTP 500); two: " + K.ERR_NOT_READY in made[2]["summary_markdown"]
    assert made[2]["tags"] == ["summary", "source/web", "model/local_fallback"] and not made[2]["save_recommendation"]["should_save"]


def test_windows_are_read_from_their_cues(spark):
    """Scores equal those of whole windows: runs and pairs over borders, empty and one-letter cues, stop words, parts."""
    draw = random.Random(21)
    stop = set(K.TOKEN_STOP_WORDS)

    def tokens(text):
        clean = re.sub(r"[^\w]+", "", text.lower())
        return (set(re.findall(r"[a-z0-9]{3,}|[一-鿿]{2,}", clean)) | {clean[i : i + 2] for i in range(len(clean) - 1)}) - stop

    rows = []
    for doc in range(25):
        cues = ["".join(draw.choices(["a", "b", "C1", " ", "因", "为", "这个", "_", ".", "é"], k=draw.randrange(0, 6))) or "!" for _ in range(draw.randrange(1, 12))]
        points = ["".join(draw.choices(["a", "b", "c1", "因", "为", "这个", "é"], k=draw.randrange(1, 9))) for _ in range(3)]
        rows.append((doc, points, cues))
    frame = spark.createDataFrame(rows, "doc INT, points ARRAY<STRING>, texts ARRAY<STRING>")
    cues = F.transform("texts", lambda text, i: F.struct(F.lit("00:00").alias("time"), i.alias("seconds"), text.alias("text")))
    whole = D.cue_scores(F.transform("points", D.match_tokens), cues)
    part = D.cue_scores(F.transform("points", D.match_tokens), cues, F.lit(100), 2)
    for row in frame.select("points", "texts", whole.alias("whole"), part.alias("part")).collect():
        own = [tokens(text) for text in row["texts"]]
        wide = [tokens(" ".join(row["texts"][i : i + D.WINDOW_CUES])) for i in range(len(own))]
        for name, shift, size in (("whole", 0, len(own)), ("part", 100, 2)):
            for seq, (point, found) in enumerate(zip(row["points"], row[name], strict=True)):
                want = sorted((-len(tokens(point) & own[i]), -len(tokens(point) & wide[i]), i + shift) for i in range(min(size, len(own))) if tokens(point) & wide[i])
                assert [(hit["own"], hit["window"], hit["index"]) for hit in found] == want[: seq + 1], (point, row["texts"])
