"""A native tag-stream machine: HTML to tokens, tokens to elements, elements to texts, all as Column expressions.

One regular expression cuts a page into tags and texts. A fold over the tags keeps the stack of open elements and
gives every wanted element its range of tokens; what an element says is then a slice of the texts. Unclosed elements
simply nest; an end tag closes the nearest open element of its name and is ignored when there is none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from digestmill.functions import text as T

VOID = tuple("area base br col embed hr img input link meta param source track wbr".split())
# Script and style are one token with all they hold; a bare ``<`` that opens nothing is a text of its own.
_TOKENS = (
    r"""(?is)<!--.*?(?:-->|\z)|<(script|style)\b(?:[^'">]++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\b[^>]*>|\z)"""
    r"""|</?[a-z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>|</?[a-z][^>]*>|<[!?/][^>]*>|[^<]+|<"""
)
_START, _END, _TEXT, _OTHER = 1, 2, 0, 3


def attributes(tag: Column, *names: str) -> Column:
    """ARRAY<STRING>: values of the first attribute of each name in a start tag, entities decoded; empty when there is none."""

    def raw(name: str) -> Column:
        value = r"""(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
        before = rf"""(?:[\s/]++(?!{name}[\s=/>])[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']*+))?+)*+"""
        pattern = rf"""(?is)^<[a-z][^\s/>]*+{before}[\s/]++{name}\s*=\s*{value}"""
        found = F.concat(*[F.regexp_extract(tag, pattern, group) for group in (1, 2, 3)])
        return F.when(F.contains(F.lower(tag), F.lit(name)), found).otherwise("")

    return F.transform(F.array(*[raw(name) for name in names]), T.unescape_html)


def has_word(value: Column, word: str) -> Column:
    """Whether a class list holds a word."""
    return F.array_contains(F.split(T.collapse(value), " "), word)


def marks(pairs: list[tuple[Column, int]]) -> Column:
    """The sum of the marks whose conditions hold."""
    total = F.lit(0)
    for condition, mark in pairs:
        total = total + F.when(condition, F.lit(mark)).otherwise(F.lit(0))
    return total


def tokens(html: Column, mark) -> Column:
    """ARRAY<STRUCT<i, kind, name, mark, text>>: ``mark(name, tag)`` gives the marks of a start tag as one number."""

    def read(piece: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][^\s/>]*)", 1))
        shown = F.when(~F.startswith(piece, F.lit("<")) | (piece == "<"), _TEXT)

        def with_name(tag: Column) -> Column:
            empty = tag.isin("script", "style", *VOID) | F.endswith(piece, F.lit("/>"))
            kind = shown.when(tag == "", _OTHER).when(F.startswith(piece, F.lit("</")), _END).when(empty, _OTHER).otherwise(_START)
            wanted = F.when((tag != "") & ~F.startswith(piece, F.lit("</")), mark(tag, piece)).otherwise(F.lit(0))
            return F.struct(i.alias("i"), kind.alias("kind"), tag.alias("name"), wanted.alias("mark"), F.when(kind == _TEXT, piece).alias("text"))

        return T.let(name, with_name)

    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TOKENS), F.lit(0)), read)


def elements(stream: Column, hide: int = 0) -> Column:
    """ARRAY<STRUCT<at, end, mark>> of the marked elements of a token stream, in document order.

    An element covers the tokens after ``at`` and before ``end``. An element whose mark has the bit ``hide`` has no
    other, and nothing below it is marked.
    """
    frames, ranges = "array<struct<name:string,mark:int,at:int,hidden:boolean>>", "array<struct<at:int,end:int,mark:int>>"
    start = F.struct(F.array().cast(frames).alias("open"), F.array().cast(ranges).alias("closed"))

    def range_of(frame: Column, end: Column) -> Column:
        return F.struct(frame["at"].alias("at"), end.cast("int").alias("end"), frame["mark"].alias("mark"))

    def marked(open_: Column, end: Column) -> Column:
        return F.transform(F.filter(open_, lambda frame: frame["mark"] != 0), lambda frame: range_of(frame, end))

    def step(state: Column, token: Column) -> Column:
        above = F.coalesce(F.try_element_at(state["open"], F.lit(-1))["hidden"], F.lit(False))

        def opened(hidden: Column) -> Column:
            hides = token["mark"].bitwiseAND(F.lit(hide))
            own = F.when(hidden, F.lit(0)).when(hides != 0, hides).otherwise(token["mark"])
            frame = F.struct(
                token["name"].alias("name"), own.alias("mark"), token["i"].alias("at"),
                (hidden | (hides != 0)).alias("hidden"),
            )
            return F.struct(F.concat(state["open"], F.array(frame)).alias("open"), state["closed"].alias("closed"))

        def closed(back: Column) -> Column:
            kept = F.size(state["open"]) - back
            return F.when(back == 0, state).otherwise(
                F.struct(
                    F.slice(state["open"], F.lit(1), kept).alias("open"),
                    F.concat(state["closed"], marked(F.slice(state["open"], kept + 1, back), token["i"])).alias("closed"),
                )
            )

        names = F.reverse(F.transform(state["open"], lambda frame: frame["name"]))
        return F.when(token["kind"] == _START, T.let(above, opened)).otherwise(T.let(F.array_position(names, token["name"]).cast("int"), closed))

    def build(every: Column) -> Column:
        tags = F.filter(every, lambda token: token["kind"].isin(_START, _END))
        end = F.size(every)
        return F.aggregate(tags, start, step, lambda state: F.array_sort(F.concat(state["closed"], marked(state["open"], end))))

    return build(stream)


def within(place: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda item: (place > item["at"]) & (place < item["end"]))


def with_mark(found: Column, mark: int) -> Column:
    return F.filter(found, lambda item: item["mark"].bitwiseAND(F.lit(mark)) != 0)


def first_with(found: Column, mark: int) -> Column:
    """The first element with a mark, NULL when there is none."""
    return F.try_element_at(with_mark(found, mark), F.lit(1))


def texts(stream: Column, without: Column) -> Column:
    """ARRAY<STRING>: the stripped text at each token, empty for tags and inside the ranges ``without``."""

    def shown(token: Column, i: Column) -> Column:
        return F.when((token["kind"] != _TEXT) | within(i, without), F.lit("")).otherwise(T.strip(T.unescape_html(token["text"])))

    return F.transform(stream, shown)


def said(words: Column, element: Column, joiner: str) -> Column:
    """The non-empty texts of an element, joined; empty without an element."""
    own = F.filter(F.slice(words, element["at"] + 2, F.greatest(element["end"] - element["at"] - 1, F.lit(0))), lambda word: word != "")
    return F.when(element.isNull(), F.lit("")).otherwise(F.array_join(own, joiner))
