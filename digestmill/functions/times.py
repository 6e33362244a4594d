"""Column functions over cue times and stamped transcript lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from digestmill.functions.text import LINE_BREAK, NOT_WS, WS, collapse, let, strip

STAMP = rf"^\[[^\]]+\]{WS}*"
_CLOCK = r"(?:\d{1,2}:)?\d{1,2}:\d{2}(?:\.\d+)?"
RANGE = rf"^\[({_CLOCK}){WS}*(?:-|-->){WS}*({_CLOCK})\]"
_POINT_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?"
POINT = rf"^\[({_POINT_CLOCK})(?:{WS}*(?:-->|-){WS}*({_POINT_CLOCK}))?\]"
STAMPED = rf"^\[([^\]]+)\]{WS}*(.+)$"


def compact_time(text: Column) -> Column:
    """First token of a cue time without fraction and without one leading ``00:``."""
    token = F.regexp_extract(strip(text), f"^({NOT_WS}*)", 1)
    whole = F.substring_index(F.replace(token, F.lit(","), F.lit(".")), ".", 1)
    return F.regexp_replace(whole, "^00:", "")


def seconds_of(clock: Column) -> Column:
    """Seconds of ``mm:ss`` or ``hh:mm:ss[.fff]``; 0 for any other shape."""

    def add(parts: Column) -> Column:
        numbers = F.transform(parts, lambda part: part.try_cast("double"))
        return F.when(F.size(parts) == 2, numbers[0] * 60 + F.get(numbers, F.lit(1))).when(
            F.size(parts) == 3, numbers[0] * 3600 + F.get(numbers, F.lit(1)) * 60 + F.get(numbers, F.lit(2))
        ).otherwise(F.lit(0.0))

    return let(F.split(clock, ":"), add)


def link_seconds(clock: Column) -> Column:
    """Seconds for a time link: the last three groups of digits between ``:`` and ``.``."""

    def add(parts: Column) -> Column:
        def at(back: int) -> Column:
            return F.try_element_at(parts, F.lit(-back)).cast("bigint")

        return F.when(F.size(parts) >= 3, at(3) * 3600 + at(2) * 60 + at(1)).when(
            F.size(parts) == 2, at(2) * 60 + at(1)
        ).when(F.size(parts) == 1, at(1)).otherwise(F.lit(0).cast("bigint"))

    return let(F.filter(F.split(clock, "[:.]"), lambda part: F.rlike(part, F.lit(r"^\p{Nd}+$"))), add)


def clock_text(seconds: Column, up: bool = False) -> Column:
    """``mm:ss`` or, from one hour, ``hh:mm:ss``; floored or ceiled to whole seconds. NULL stays NULL."""
    whole = F.ceil(seconds) if up else F.when(seconds >= 0, F.floor(seconds)).otherwise(F.ceil(seconds))

    def show(total: Column) -> Column:
        hours, rest = F.floor(total / 3600), F.pmod(total, F.lit(3600))
        minutes, left = F.floor(rest / 60), F.pmod(rest, F.lit(60))
        return F.when(total.isNull(), F.lit(None)).when(hours != 0, F.format_string("%02d:%02d:%02d", hours, minutes, left)).otherwise(
            F.format_string("%02d:%02d", minutes, left)
        )

    return let(whole.cast("bigint"), show)


def vtt_clock(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``."""
    hours = F.floor(seconds / 3600)
    minutes = F.floor(F.pmod(seconds, F.lit(3600.0)) / 60)
    return F.format_string("%02d:%02d:%06.3f", hours, minutes, F.pmod(seconds, F.lit(60.0)))


def clean_cue_text(text: Column) -> Column:
    return collapse(F.regexp_replace(text, "<[^>]+>", ""))


def bare_line(line: Column) -> Column:
    """A transcript line without its stamp."""
    return strip(F.regexp_replace(line, STAMP, ""))


def transcript_lines(transcript: Column) -> Column:
    return F.split(transcript, LINE_BREAK)


def normalized(text: Column) -> Column:
    """Letters and digits of a transcript, lower-cased, without stamps and timing lines."""
    bare = F.regexp_replace(text, rf"(?m)^\[[^\]]+\]{WS}*", "")
    bare = F.regexp_replace(bare, rf"(?m)^{_POINT_CLOCK}{WS}*-->.*$", "")
    return F.lower(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", ""))


__all__ = [
    "POINT", "RANGE", "STAMP", "STAMPED", "bare_line", "clean_cue_text", "clock_text", "compact_time",
    "link_seconds", "normalized", "seconds_of", "transcript_lines", "vtt_clock",
]
