"""Texts of any length: slugs from their heads, shares by one division."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from digestmill.functions import text as T


def test_slug_of_a_long_text_is_that_of_the_whole(spark):
    rand = random.Random(3)
    texts = ["".join(rand.choices("aB9中 -_.\nüß", k=rand.randrange(0, 260))) for _ in range(120)] + ["-" * 500 + "a", "a" * 90 + " " * 300, "a" * 90 + "--b", "a" * 89 + " - b" * 99, "", "  "]

    def plain(text: str, size: int) -> str:
        part = "".join(char if char.isascii() and char.isalnum() or "一" <= char <= "鿿" else " " for char in text)
        part = "-".join(part.split()).lower() or "untitled"
        return part[:size].rstrip("-") if len(part) > size else part

    rows = spark.createDataFrame([(text,) for text in texts], "t STRING").select("t", T.slug(F.col("t")).alias("long"), T.slug(F.col("t"), 80).alias("short")).collect()
    assert all((row["long"], row["short"]) == (plain(row["t"], 90), plain(row["t"], 80)) for row in rows)
    # Only the head of a text is rewritten.
    plan = spark.range(1).select(T.slug(F.lit("x")))._jdf.queryExecution().logical().toString()
    assert "regexp_extract" in plan


def test_share_in_parts_is_divided_once(spark):
    rows = spark.createDataFrame([("x" * 1239 + " " + "字" * 41,)], "t STRING")
    share = T.char_ratio(F.col("t"), parts=6_000_000)
    # 6,000,000 * 41 / 1,280 is 192,187.5: the share times six million fell just below the half.
    assert rows.select(F.round(share).cast("long")).first()[0] == 192_188
    assert rows.select(T.char_ratio(F.col("t"))).first()[0] == 41 / 1280


def test_white_space_is_that_of_strip(spark):
    rows = spark.range(0x3100).withColumnRenamed("id", "code").select("code", T.codepoint(F.col("code")).alias("c"))
    found = rows.select("code", F.rlike("c", F.lit(f"^{T.WS}$")).alias("is"), F.rlike("c", F.lit(f"^{T.NOT_WS}$")).alias("no"), T.collapse(F.concat("c", F.lit("a"), "c", "c", F.lit("b"), "c")).alias("t")).collect()
    for row in found:
        space = chr(row["code"]).isspace()
        assert (row["is"], row["no"]) == (space, not space), row
        assert (row["t"] == "a b") == space, row


def test_lines_are_those_of_splitlines(spark):
    rand = random.Random(5)
    breaks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "a", "b ", "\x1f", "中", "‪"]
    texts = ["".join(rand.choices(breaks, k=rand.randrange(0, 14))) + "end" for _ in range(300)]
    for row in spark.createDataFrame([(text,) for text in texts], "t STRING").select("t", T.lines(F.col("t")).alias("lines")).collect():
        assert row["lines"] == row["t"].splitlines(), row


def test_music_lines_keep_their_marks_apart(spark):
    from digestmill.operators.tracks import low_value

    lines = ["♪ mu-sic ♫", "~Mu.sic,！", "mu　sic？。", "～music，"]
    frame = spark.createDataFrame([("\n".join(lines * 5),), ("\n".join(f"{line} words that are spoken" for line in lines),), ("\n".join("…" + line for line in lines * 5),)], "t STRING")
    assert [row[0] for row in frame.select(low_value(F.col("t"))).collect()] == [True, False, False]
