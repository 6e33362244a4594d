"""Subtitle parsing, cue tables, timing checks, transcript quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from digestmill import constants as K
from digestmill.functions import text as T
from digestmill.functions import times as C
from digestmill.functions.scale import exploded, in_order
from digestmill.functions.urls import timestamp_link

# ---- parsing: one row per subtitle file in, one row per cue out ------------------------------

_EDGE, _HEAD = "\x01", "\x02"


def _cues(parsed: DataFrame) -> DataFrame:
    """Exploded cues from an array of STRUCT<start, end, text>."""
    return exploded(parsed, ["doc_id"], F.col("cues"), "cue", "seq").select(
        "doc_id", "seq", F.col("cue.start").alias("start"), F.col("cue.end").alias("end"), F.col("cue.text").alias("text")
    )


def _timed(range_line: Column, text: Column) -> Column:
    after = F.substr(range_line, F.locate("-->", range_line) + 3)
    return F.struct(
        C.compact_time(F.substring_index(range_line, "-->", 1)).alias("start"), C.compact_time(after).alias("end"), text.alias("text")
    )


def vtt_cue_array(body: Column) -> Column:
    """Cues of a VTT text as an array, before repeats are dropped.

    Lines that close a cue are replaced by a marker, so that splitting at the markers yields one block
    per cue: no window and no shuffle is needed.
    """

    def marked(raw: Column) -> Column:
        line = T.strip(raw)
        closes = line.isin("", "WEBVTT") | F.startswith(line, F.lit("Kind:")) | F.startswith(line, F.lit("Language:"))
        return F.when(closes, F.lit(_EDGE)).when(F.contains(line, F.lit("-->")), F.concat(F.lit(_EDGE + _HEAD), line)).otherwise(line)

    plain = F.translate(body, _EDGE + _HEAD, "")
    blocks = F.split(F.array_join(F.transform(T.lines(plain), marked), "\n"), _EDGE)
    timed = F.filter(blocks, lambda block: F.startswith(block, F.lit(_HEAD)))

    def cue(block: Column) -> Column:
        rows = F.filter(F.split(F.substr(block, F.lit(2)), "\n"), lambda row: row != "")
        words = F.filter(F.slice(rows, 2, F.size(rows)), lambda row: ~F.rlike(row, F.lit(r"^\p{Nd}+$")))
        return F.struct(rows[0].alias("head"), words.alias("words"))

    filled = F.filter(F.transform(timed, cue), lambda item: F.size(item["words"]) > 0)
    return F.transform(filled, lambda item: _timed(item["head"], C.clean_cue_text(F.array_join(item["words"], " "))))


def srt_cue_array(body: Column) -> Column:
    """Cues of an SRT text: blank-line blocks with a timing line and some text."""

    def cue(block: Column) -> Column:
        rows = F.filter(F.transform(T.lines(block), T.strip), lambda row: row != "")
        times = F.filter(rows, lambda row: F.contains(row, F.lit("-->")))
        words = F.filter(rows, lambda row: ~F.contains(row, F.lit("-->")) & ~F.rlike(row, F.lit(r"^\p{Nd}+$")))
        return F.struct(F.size(rows).alias("n"), F.try_element_at(times, F.lit(1)).alias("head"), C.clean_cue_text(F.array_join(words, " ")).alias("text"))

    blocks = F.transform(F.split(T.strip(body), rf"\n{T.WS}*\n"), cue)
    kept = F.filter(blocks, lambda item: (item["n"] >= 2) & item["head"].isNotNull() & (item["text"] != ""))
    return F.transform(kept, lambda item: _timed(item["head"], item["text"]))


def cues_from_vtt(files: DataFrame) -> DataFrame:
    """``doc_id, body`` to ``doc_id, seq, start, end, text``; a text that repeats is kept once."""
    return dedupe_cues(_cues(files.select("doc_id", vtt_cue_array(F.col("body")).alias("cues"))))


def cues_from_srt(files: DataFrame) -> DataFrame:
    return dedupe_cues(_cues(files.select("doc_id", srt_cue_array(F.col("body")).alias("cues"))))


def payload_cues(payload: Column) -> Column:
    """Entries of a caption body ``{"body": [{"from", "to", "content"}]}`` that have content."""
    body = F.from_json(payload, "STRUCT<body: ARRAY<STRUCT<`from`: STRING, `to`: STRING, content: STRING>>>")["body"]
    entries = F.transform(
        F.coalesce(body, F.array().cast(_BODY)),
        lambda e: F.struct(
            e["from"].try_cast("double").alias("from"), e["to"].try_cast("double").alias("to"),
            T.strip(F.coalesce(e["content"], F.lit(""))).alias("content"),
        ),
    )
    return F.filter(entries, lambda e: e["content"] != "")


_BODY = "ARRAY<STRUCT<`from`: STRING, `to`: STRING, content: STRING>>"


def payload_transcript(payload: Column) -> Column:
    """Stamped text of a caption body: starts floored, ends ceiled to seconds."""

    def line(e: Column) -> Column:
        prefix = F.concat(F.lit("["), C.clock_text(e["from"]), F.lit("-"), C.clock_text(e["to"], up=True), F.lit("] "))
        return F.concat(F.coalesce(prefix, F.lit("")), e["content"])

    return F.array_join(F.transform(payload_cues(payload), line), "\n")


def cues_from_json(payloads: DataFrame) -> DataFrame:
    rows = exploded(payloads, ["doc_id"], payload_cues(F.col("payload")), "e", "seq")
    return rows.select(
        "doc_id", "seq", C.clock_text(F.col("e.from")).alias("start"), C.clock_text(F.col("e.to"), up=True).alias("end"),
        F.col("e.content").alias("text"),
    )


def cues_from_transcript(transcripts: DataFrame) -> DataFrame:
    """Range-stamped lines ``[a-b] text`` of a transcript as numeric cues."""
    rows = transcripts.select("doc_id", F.posexplode(C.transcript_lines(F.col("transcript"))).alias("seq", "line"))
    line = T.strip(F.col("line"))
    return rows.filter(F.rlike(line, F.lit(C.RANGE))).select(
        "doc_id", "seq", C.seconds_of(F.regexp_extract(line, C.RANGE, 1)).alias("start_s"),
        C.seconds_of(F.regexp_extract(line, C.RANGE, 2)).alias("end_s"), C.bare_line(line).alias("text"),
    )


# ---- cue tables ----------------------------------------------------------------------------


def dedupe_cues(cues: DataFrame) -> DataFrame:
    """The first cue of each distinct text in a transcript; empty texts go. A partial aggregate on
    (transcript, text), so a long transcript is spread over tasks."""
    rest = [column for column in cues.columns if column not in ("doc_id", "text", "seq")]
    first = cues.filter("text <> ''").groupBy("doc_id", "text").agg(
        F.min(F.struct("seq", *rest)).alias("first")
    )
    return first.select("doc_id", "text", "first.*").select(*cues.columns)


def low_value_transcripts(cues: DataFrame) -> DataFrame:
    """Per transcript: music-only share of at least 0.75, under 30 meaningful characters, or no text."""
    bare = F.lower(F.regexp_replace("text", rf"(?:{T.WS}|[♪♫~～,，。.!！?？-])+", ""))
    music = F.count_if(bare.isin(*K.MUSIC_WORDS) & (F.col("text") != ""))
    stats = cues.groupBy("doc_id").agg(
        F.count_if(F.col("text") != "").alias("lines"), music.alias("music_lines"), F.sum(F.length("text")).alias("chars")
    )
    low = (F.col("lines") == 0) | (F.col("music_lines") * 4 >= F.col("lines") * 3) | (F.col("chars") - 2 * F.col("music_lines") < 30)
    return stats.withColumn("low_value", low)


def tolerance(duration: Column) -> Column:
    """Tolerance past the end of a video."""
    return F.when(duration > 0, F.greatest(F.lit(5.0), duration * 0.03)).otherwise(F.lit(0.0))


def validate_timing(cues: DataFrame, documents: DataFrame, require_timestamps: bool = True) -> DataFrame:
    """Timing verdict per document ``(doc_id, duration)``; documents without cues are judged too.

    An invalid cue counts, but does not move the previous start.
    """
    start, end = F.col("start_s"), F.col("end_s")
    finite = ~F.isnan(start) & ~F.isnan(end) & (F.abs(start) != float("inf")) & (F.abs(end) != float("inf"))
    good = F.coalesce(finite & (start >= 0) & (end > start), F.lit(False))
    rows = cues.select("doc_id", "seq", start, end, good.alias("good"))
    totals = rows.groupBy("doc_id").agg(
        F.count("*").alias("timestamp_count"), F.bool_and("good").alias("well_formed"), F.max(F.when(F.col("good"), end)).alias("last_end")
    )
    order = in_order(rows, "doc_id", "seq", F.when(F.col("good"), start), "monotonic")
    joined = documents.select("doc_id", F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0)).alias("duration")).join(
        totals, "doc_id", "left"
    ).join(order, "doc_id", "left")
    count = F.coalesce("timestamp_count", F.lit(0))
    last = F.coalesce("last_end", F.lit(0.0))
    duration = F.col("duration")
    monotonic = F.coalesce("monotonic", F.lit(True))
    reason = T.first_match(
        [
            ((count == 0) & F.lit(require_timestamps), "timestamps_missing"),
            (~F.coalesce("well_formed", F.lit(True)), "invalid_timestamp_range"),
            (~monotonic, "timestamps_not_monotonic"),
            ((duration > 0) & (last > duration + tolerance(duration)), "duration_exceeded"),
            ((duration >= 300) & (last > 0) & (last < F.least(F.lit(180.0), duration * 0.15)), "insufficient_coverage"),
        ],
        F.lit("ok"),
    )
    return joined.select(
        "doc_id", reason.alias("reason"), (reason == "ok").alias("valid"), count.alias("timestamp_count"), monotonic.alias("timestamps_monotonic"),
        F.when(count > 0, F.round(last, 3)).alias("last_timestamp_seconds"), F.when(duration > 0, F.round(duration, 3)).alias("duration_seconds"),
        F.when((duration > 0) & (count > 0), F.round(last / duration, 4)).alias("duration_ratio"),
        F.when(duration > 0, F.round(tolerance(duration), 3)).alias("duration_tolerance_seconds"),
    )


def payload_verdict(payload: Column, duration: Column) -> Column:
    """Timing verdict of a caption body; reading stops at its first bad entry.

    STRUCT<valid, reason, timestamp_count, last_timestamp_seconds, duration_ratio>.
    """
    start = F.struct(
        F.lit(-1.0).alias("previous"), F.lit(0.0).alias("last"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("bad")
    )

    def step(acc: Column, e: Column) -> Column:
        begin, end = e["from"], e["to"]
        unfit = begin.isNull() | end.isNull() | F.isnan(begin) | F.isnan(end) | (F.abs(begin) == float("inf")) | (F.abs(end) == float("inf"))
        bad = F.when(unfit | (begin < 0) | (end <= begin), "invalid_timestamp_range").when(begin < acc["previous"], "timestamps_not_monotonic")
        moved = F.struct(
            begin.alias("previous"), F.greatest(acc["last"], end).alias("last"), (acc["n"] + 1).alias("n"), F.lit(None).cast("string").alias("bad")
        )
        stopped = F.struct(acc["previous"].alias("previous"), acc["last"].alias("last"), acc["n"].alias("n"), bad.alias("bad"))
        return F.when(acc["bad"].isNotNull(), acc).when(bad.isNotNull(), stopped).otherwise(moved)

    def report(acc: Column) -> Column:
        length = F.greatest(F.coalesce(duration, F.lit(0.0)), F.lit(0.0))
        reason = T.first_match(
            [
                (acc["bad"].isNotNull(), acc["bad"]), (acc["n"] == 0, "timestamps_missing"),
                ((length > 0) & (acc["last"] > length + tolerance(length)), "duration_exceeded"),
                ((length >= 300) & (acc["last"] < F.least(F.lit(180.0), length * 0.15)), "insufficient_coverage"),
            ],
            F.lit("ok"),
        )
        return F.struct(
            (reason == "ok").alias("valid"), reason.alias("reason"), acc["n"].alias("timestamp_count"),
            F.when(acc["n"] > 0, F.round(acc["last"], 3)).alias("last_timestamp_seconds"),
            F.when((length > 0) & (acc["n"] > 0), F.round(acc["last"] / length, 4)).alias("duration_ratio"),
        )

    return T.let(F.aggregate(payload_cues(payload), start, step), report)


def validate_payload_timing(payloads: DataFrame) -> DataFrame:
    verdict = payload_verdict(F.col("payload"), F.col("duration"))
    return payloads.select("doc_id", verdict.alias("v")).select("doc_id", "v.*")


def timing_fields(transcript: Column, duration: Column) -> Column:
    """Stamp count, order, coverage and overrun of a transcript text; single stamps count too."""
    stamps = F.filter(F.transform(C.transcript_lines(transcript), T.strip), lambda line: F.rlike(line, F.lit(C.POINT)))

    def place(line: Column) -> Column:
        begin = C.seconds_of(F.regexp_extract(line, C.POINT, 1))
        until = F.regexp_extract(line, C.POINT, 2)
        return F.struct(begin.alias("start"), F.when(until == "", begin).otherwise(F.greatest(begin, C.seconds_of(until))).alias("reach"))

    empty = F.struct(
        F.lit(0).alias("n"), F.lit(True).alias("ordered"), F.lit(None).cast("double").alias("previous"), F.lit(None).cast("double").alias("last")
    )

    def step(acc: Column, p: Column) -> Column:
        return F.struct(
            (acc["n"] + 1).alias("n"), (acc["ordered"] & F.coalesce(p["start"] >= acc["previous"], F.lit(True))).alias("ordered"),
            p["start"].alias("previous"), F.greatest(acc["last"], p["reach"]).alias("last"),
        )

    def report(acc: Column) -> Column:
        length = F.coalesce(duration, F.lit(0.0))
        known = (length > 0) & acc["last"].isNotNull()
        return F.struct(
            acc["n"].alias("timestamp_count"), acc["ordered"].alias("timestamps_monotonic"),
            F.when(known, F.round(F.greatest(acc["last"] / length, F.lit(0.0)), 4)).alias("duration_coverage"),
            F.round(acc["last"], 3).alias("last_timestamp_seconds"),
            (known & (acc["last"] > length + tolerance(length))).alias("exceeds_duration"),
        )

    return T.let(F.aggregate(F.transform(stamps, place), empty, step), report)


def timing_quality(transcripts: DataFrame) -> DataFrame:
    """``doc_id, transcript, duration`` to timing fields."""
    return transcripts.select("doc_id", timing_fields(F.col("transcript"), F.col("duration")).alias("t")).select("doc_id", "t.*")


def describe_quality(transcripts: DataFrame) -> DataFrame:
    """Confidence of each transcript; also needs ``origin``."""
    rows = transcripts.select(
        "doc_id", "origin", F.length(C.normalized(F.col("transcript"))).alias("character_count"),
        timing_fields(F.col("transcript"), F.col("duration")).alias("t"),
    )
    confidence = T.first_match(
        [
            (F.col("character_count") == 0, "none"), (~F.col("t.timestamps_monotonic") | F.col("t.exceeds_duration"), "low"),
            (F.col("origin") == "platform_subtitle", "high"), (F.col("character_count") < 80, "low"),
            (F.coalesce(F.col("t.duration_coverage") < 0.5, F.lit(False)), "low"),
        ],
        F.lit("medium"),
    )
    return rows.select("doc_id", confidence.alias("confidence"), "character_count", "t.*")


# Widest band around the diagonal that the built-in distance is asked for; pairs further apart are counted by bits.
WIDEST_BAND = 4096
# The built-in distance steps through a text once per character of the other, however narrow its band is: longer texts are not given to it.
NEAR_CHARS = 1024


def near_distance(left: Column, right: Column) -> Column:
    """Exact edit distance up to ``WIDEST_BAND``, NULL above it.

    The band around the diagonal widens until the distance fits in it.
    """

    def measure(pair: Column) -> Column:
        def within(limit: int, wider: Column) -> Column:
            return T.let(F.levenshtein(pair["a"], pair["b"], limit), lambda found: F.when(found >= 0, found).otherwise(wider))

        found = F.lit(None).cast("int")
        for band in (WIDEST_BAND, 512, 64):
            found = within(band, found)
        return found

    return T.let(F.struct(left.alias("a"), right.alias("b")), measure)


def bit_distance(left: str, right: str) -> int:
    """Exact edit distance of any two texts: a whole column of the table is one number, and a character is a few of its sums."""
    if len(left) < len(right):
        left, right = right, left
    size = len(left)
    if not right:
        return size
    rows: dict[str, bytearray] = {}
    for at, char in enumerate(left):
        row = rows.get(char)
        if row is None:
            row = rows[char] = bytearray(size // 8 + 1)
        row[at >> 3] |= 1 << (at & 7)
    wanted = set(right)
    places = {char: int.from_bytes(row, "little") for char, row in rows.items() if char in wanted}
    every, last = (1 << size) - 1, 1 << (size - 1)
    # Where the distance rises or falls by one from the row above.
    rises, falls, distance = every, 0, size
    for char in right:
        equal = places.get(char, 0)
        diagonal = (((equal & rises) + rises) ^ rises) | equal | falls
        up = falls | (every & ~(diagonal | rises))
        down = rises & diagonal
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        up = ((up << 1) | 1) & every
        down = (down << 1) & every
        kept = equal | falls
        rises = down | (every & ~(kept | up))
        falls = up & kept
    return distance


def edit_distance(left: str, right: str) -> int:
    """Exact edit distance: what both ends share is left out, and where bounds that cost one pass meet, no table is needed.

    At least as many edits are needed as one side has characters that the other lacks, whatever their order; at most as many
    as there are differing places, counted from either end, and characters that one side has more.
    """
    a, b = (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for text in (left, right))

    def shared(first: np.ndarray, second: np.ndarray) -> int:
        size = min(len(first), len(second))
        differs = first[:size] != second[:size]
        return int(differs.argmax()) if differs.any() else size

    head = shared(a, b)
    a, b = a[head:], b[head:]
    tail = shared(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    size, more = min(len(a), len(b)), abs(len(a) - len(b))
    if size == 0:
        return more
    most = more + min(int((a[:size] != b[:size]).sum()), int((a[len(a) - size :] != b[len(b) - size :]).sum()))
    chars, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    surplus = np.bincount(place[: len(a)], minlength=len(chars)) - np.bincount(place[len(a) :], minlength=len(chars))
    least = int(max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()))
    return most if most == least else bit_distance(left[head : len(left) - tail], right[head : len(right) - tail])


@F.pandas_udf(IntegerType())
def far_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Exact edit distance of the pairs that are not NULL."""
    return pd.Series([None if a is None or b is None else edit_distance(a, b) for a, b in zip(left, right, strict=True)], dtype="Int32")


def evaluate_asr(pairs: DataFrame, sample_chars: int | None = None) -> DataFrame:
    """Character error rate of ``hypothesis`` against ``reference`` with a grade.

    Whole texts are compared, or the first ``sample_chars`` characters of each side.
    """

    def cut(text: str) -> Column:
        return F.col(text) if sample_chars is None else F.substring(text, 1, sample_chars)

    rows = pairs.withColumn("ref", C.normalized(F.col("reference"))).withColumn("hyp", C.normalized(F.col("hypothesis")))
    # Short pairs stay native; the others reach the second way, and short ones are NULL there.
    short = F.greatest(F.length(cut("ref")), F.length(cut("hyp"))) <= NEAR_CHARS
    near = rows.withColumn("near", F.when(short, near_distance(cut("ref"), cut("hyp"))))
    far = far_distance(*(F.when(F.col("near").isNull(), cut(name)) for name in ("ref", "hyp")))
    scored = near.withColumn("distance", F.coalesce("near", far)).withColumn(
        "evaluated_chars", F.length(cut("ref"))
    ).withColumn("t", timing_fields(F.col("hypothesis"), F.col("duration")))
    rate = F.col("distance") / F.greatest(F.col("evaluated_chars"), F.lit(1))
    grade = (
        F.when(~F.col("t.timestamps_monotonic"), "poor").when(rate <= 0.15, "good").when(rate <= 0.30, "review").otherwise("poor")
    )
    return scored.select(
        "doc_id", F.length("ref").alias("reference_chars"), F.length("hyp").alias("hypothesis_chars"), "evaluated_chars",
        ((F.length("ref") > F.length(cut("ref"))) | (F.length("hyp") > F.length(cut("hyp")))).alias("truncated"), "distance", F.round(rate, 4).alias("character_error_rate"),
        F.round(F.greatest(F.lit(0.0), 1 - rate), 4).alias("character_accuracy"), grade.alias("grade"), F.col("t").alias("timing"),
    )


# ---- rendering: one text per document ------------------------------------------------------


def plain_transcript(transcript: Column) -> Column:
    """Transcript without stamps and blank lines."""
    bare = F.transform(C.transcript_lines(transcript), C.bare_line)
    return F.array_join(F.filter(bare, lambda line: line != ""), "\n")


def srt_to_vtt(text: Column) -> Column:
    body = F.regexp_replace(text, rf"(?m)^{T.WS}*\d+{T.WS}*$", "")
    body = T.strip(F.regexp_replace(F.replace(body, F.lit(","), F.lit(".")), r"\n{3,}", "\n\n"))
    return F.when(body != "", F.concat(F.lit("WEBVTT\n\n"), body, F.lit("\n"))).otherwise("")


def payload_vtt(payload: Column) -> Column:
    """VTT text of a caption body; entries without both times are left out."""
    timed = F.filter(payload_cues(payload), lambda e: e["from"].isNotNull() & e["to"].isNotNull())
    blocks = F.transform(timed, lambda e: F.concat(C.vtt_clock(e["from"]), F.lit(" --> "), C.vtt_clock(e["to"]), F.lit("\n"), e["content"]))
    return F.when(F.size(timed) == 0, F.lit("")).otherwise(F.concat(F.lit("WEBVTT\n\n"), F.array_join(blocks, "\n\n"), F.lit("\n")))


def full_timeline(url: Column, transcript: Column) -> Column:
    """Markdown list with one time link per stamped line; empty when there is none."""
    stamped = F.filter(F.transform(C.transcript_lines(transcript), T.strip), lambda line: F.rlike(line, F.lit(C.STAMPED)))

    def item(line: Column) -> Column:
        begin = F.substring_index(F.regexp_extract(line, C.STAMPED, 1), "-", 1)
        text = T.collapse(F.regexp_extract(line, C.STAMPED, 2))
        shown = F.concat(F.lit("- ["), begin, F.lit("]("), timestamp_link(url, C.link_seconds(begin)), F.lit(") "), text)
        return F.when(text != "", shown)

    items = F.filter(F.transform(stamped, item), lambda line: line.isNotNull())
    return F.when(F.size(items) > 0, F.concat(F.lit("# Timeline\n\n"), F.array_join(items, "\n"))).otherwise("")
