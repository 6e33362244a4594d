"""Column functions over text: trimming, lines, entities, slugs, cuts."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a Unicode-aware ``strip``/``\s`` sees it; Java's ``\s`` alone misses most of it.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
# The same class, quick to refuse: the Latin-1 ones compile to a bit table, and one range keeps most others from the rest.
WS = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
NOT_WS = f"[^{_SPACE_CLASS}]"
# A class first, so that a character that is none is refused by one table and one range.
LINE_BREAK = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85 - ](?:(?<=\r)\n)?"
CJK = "一-鿿"
WORD = r"\p{L}\p{N}_"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once and use it many times inside ``body``; keeps expression trees small."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def collapse(text: Column) -> Column:
    """White-space runs become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def present(text: Column) -> Column:
    """NULL for an empty string."""
    return let(text, lambda value: F.when(value != "", value))


def first_present(*texts: Column) -> Column:
    """The first text that is neither NULL nor empty."""
    return F.coalesce(*[present(text) for text in texts])


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def first_match(cases: list[tuple[Column, Column | str | None]], default: Column | None = None) -> Column:
    """CASE WHEN over an ordered list."""
    chain = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain if default is None else chain.otherwise(default)


# ---- HTML entities -------------------------------------------------------------------------

# Most pages use a handful of names; they are tested before the full table.
_COMMON = {name: html5[name + ";"] for name in ("amp", "lt", "gt", "quot", "nbsp", "copy", "middot", "apos")}


def _replacement(code: int) -> str | None:
    """Text for a numeric reference that does not stand for itself."""
    if code == 0 or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF:
        return "�"
    if code == 0x0D:
        return "\r"
    if 0x80 <= code <= 0x9F:
        return bytes([code]).decode("cp1252", errors="ignore") or chr(code)
    if code in (0x0B, 0x7F) or 0x1 <= code <= 0x8 or 0xE <= code <= 0x1F or 0xFDD0 <= code <= 0xFDEF:
        return ""
    return "" if code & 0xFFFE == 0xFFFE else None


_SPECIAL_CODES = {code: text for code in range(0xA0) if (text := _replacement(code)) is not None}


def _literal_map(pairs: dict, key_type: str = "string") -> Column:
    """A constant map; the optimizer folds the parse into a literal."""
    return F.from_json(F.lit(json.dumps(pairs)), f"map<{key_type},string>")


def codepoint(code: Column) -> Column:
    """A character from its number (``chr`` wraps at 256)."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


_NUMBER = r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?"


def _numeric(piece: Column) -> Column:
    """A piece that starts with a numeric reference, decoded."""
    digits = F.regexp_extract(piece, r"^#([0-9]+);?", 1)
    hexits = F.ltrim(F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+);?", 1), F.lit("0"))
    beyond = F.lit(0x110000)
    code = F.when(digits != "", F.least(F.coalesce(digits.try_cast("bigint"), beyond), beyond)).otherwise(
        F.when(F.length(hexits) > 6, beyond).otherwise(F.coalesce(F.conv(hexits, 16, 10).try_cast("bigint"), F.lit(0)))
    )

    def text(number: Column) -> Column:
        special = F.try_element_at(_literal_map(_SPECIAL_CODES), number.cast("string"))
        return (
            F.when(special.isNotNull(), special)
            .when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .when(number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE), F.lit(""))
            .otherwise(codepoint(number))
        )

    return F.concat(let(code, text), F.regexp_replace(piece, _NUMBER, ""))


def _named(piece: Column) -> Column:
    """A piece that starts with a name; without its semicolon the longest known prefix counts."""
    longest = max(len(key) for key in html5 if not key.endswith(";"))

    def by_name(names: Column, name: Column) -> Column:
        exact = F.try_element_at(names, name)
        # Only names that are known without a semicolon can match a shortened key.
        hits = F.filter(
            F.transform(F.sequence(F.lit(longest), F.lit(2), F.lit(-1)), lambda size: F.struct(size.alias("size"), F.try_element_at(names, F.substr(name, F.lit(1), size)).alias("text"))),
            lambda hit: hit["text"].isNotNull() & (hit["size"] < F.length(name)),
        )
        known = F.coalesce(
            F.when(exact.isNotNull(), F.struct(F.length(name).alias("size"), exact.alias("text"))),
            F.try_element_at(hits, F.lit(1)),
        )
        return let(
            known,
            lambda hit: F.when(hit.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(hit["text"], F.substr(piece, hit["size"] + 1))),
        )

    name = F.regexp_extract(piece, r"^([^\t\n\f <&#;]{1,32};?)", 1)
    return let(_literal_map(dict(html5)), lambda names: let(name, lambda value: by_name(names, value)))


def unescape_html(text: Column) -> Column:
    """Character references to characters; every reference is decoded once."""

    def decode(piece: Column, index: Column) -> Column:
        chain = F.when(index == 0, piece)
        for name, value in _COMMON.items():
            chain = chain.when(F.startswith(piece, F.lit(name + ";")), F.concat(F.lit(value), F.substr(piece, F.lit(len(name) + 2))))
        chain = chain.when(~F.coalesce(F.rlike(piece, F.lit(r"^[#A-Za-z]")), F.lit(False)), F.concat(F.lit("&"), piece))
        return chain.when(F.rlike(piece, F.lit(_NUMBER)), _numeric(piece)).otherwise(_named(piece))

    def expand(value: Column) -> Column:
        pieces = F.transform(F.split(value, "&"), decode)
        return F.when(F.contains(value, F.lit("&")), F.array_join(pieces, "")).otherwise(value)

    return let(text, expand)


def clean_text(text: Column) -> Column:
    return collapse(unescape_html(F.coalesce(text, F.lit(""))))


def normalize_blocks(text: Column, separator: str = "\n\n") -> Column:
    """Non-empty cleaned lines joined by a blank line."""
    cleaned = F.transform(F.split(text, r"[\r\n]+"), clean_text)
    return F.array_join(F.filter(cleaned, lambda line: line != ""), separator)


# ---- names and cuts ------------------------------------------------------------------------


def safe_part(text: Column) -> Column:
    dashed = F.regexp_replace(text, f"[^A-Za-z0-9{CJK}]+", "-")
    return F.lower(F.btrim(dashed, F.lit("-")))


def slug(title: Column, size: int = 90) -> Column:
    # The characters up to the first one too many decide a slug; the rest of a long text need not be rewritten.
    kept = f"A-Za-z0-9{CJK}"
    part = safe_part(F.regexp_extract(title, f"^(?:[^{kept}]*+[{kept}]){{0,{size + 1}}}", 0))

    def cut(text: Column) -> Column:
        return F.when(text == "", F.lit("untitled")).when(F.length(text) > size, F.rtrim(F.substring(text, 1, size), F.lit("-"))).otherwise(text)

    return let(part, cut)


def note_path(title: Column, date: Column) -> Column:
    return F.concat(F.lit("Inbox/Links/"), F.date_format(date, "yyyy-MM-dd"), F.lit("-"), slug(title, 80), F.lit(".md"))


def download_name(title: Column, default: str = "digest-output") -> Column:
    stem = F.btrim(F.regexp_replace(title, f"[^{WORD}{CJK}.-]+", "-"), F.lit(".-"))
    return let(stem, lambda name: F.concat(F.when(name == "", F.lit(default)).otherwise(name), F.lit(".md")))


def truncate_text(text: Column, size: int, separator: str = " ") -> Column:
    """Cut to ``size`` characters, then back to the last separator if there is one."""
    head = F.substring(text, 1, size)
    back = F.length(head) - F.locate(separator, F.reverse(head))
    return F.when(F.length(text) <= size, text).when(
        F.contains(head, F.lit(separator)), F.substr(head, F.lit(1), back)
    ).otherwise(head)


def head_tail(text: Column, size: int, marker: str) -> Column:
    half = size // 2
    return F.when(F.length(text) <= size, text).otherwise(
        F.concat(F.substring(text, 1, half), F.lit(marker), F.right(text, F.lit(-(-size // 2))))
    )


def search_text(text: Column) -> Column:
    """Lower-cased words; a CJK run is one token per character; the rest is dropped."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(f"([{CJK}]|[A-Za-z0-9_]+)"), F.lit(1)), " ")


def char_ratio(text: Column, klass: str = CJK, parts: int = 1) -> Column:
    """Share of a character class among the non-space characters, in ``parts`` of the whole.

    A share in parts is divided once, so a rounding that follows meets the exact half.
    """
    counts = F.struct(F.length(F.regexp_replace(text, WS + "+", "")).alias("solid"), F.length(F.regexp_replace(text, f"[^{klass}]+", "")).alias("hits"))
    return let(counts, lambda n: F.when(n["solid"] == 0, F.lit(0.0)).otherwise(n["hits"].cast("bigint") * parts / n["solid"]))


def number_text(value: Column) -> Column:
    """A floating-point number as text the way other engines write it: plain from 1e-4 up to 1e16, beyond that ``1.5e+16``."""

    def write(text: Column) -> Column:
        plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
        scaled = F.regexp_replace(F.regexp_replace(text, r"(?:\.0)?E(?=\d)", "e+"), r"(?:\.0)?E-", "e-")
        scaled = F.regexp_replace(scaled, r"(?<=e[+-])(\d)$", "0$1")
        named = F.replace(F.lower(text), F.lit("infinity"), F.lit("inf"))
        size = F.abs(value)
        return F.when(~F.contains(text, F.lit("E")), named).when((size >= 1e-4) & (size < 1e16), plain).otherwise(scaled)

    return let(value.cast("string"), write)


def section_items(markdown: Column, heading: str) -> Column:
    """List items between the first occurrence of ``## heading`` and the next section."""
    marker = "## " + heading
    after = F.substr(markdown, F.locate(marker, markdown) + len(marker))
    section = F.substring_index(after, "\n## ", 1)
    item = F.filter(lines(section), lambda line: _is_item(F.ltrim(line, F.lit(SPACE_CHARS))))
    return F.when(F.contains(markdown, F.lit(marker)), F.size(item)).otherwise(F.lit(0))


def _is_item(line: Column) -> Column:
    return F.rlike(line, F.lit(r"^(?:- |\* )")) | F.rlike(F.rtrim(F.substring(line, 1, 2), F.lit(".")), F.lit(r"^[\p{Nd}]+$"))
