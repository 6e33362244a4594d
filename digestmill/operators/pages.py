"""Page extraction jobs: light text, article text, WeChat articles, images, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill.functions import markup as M
from digestmill.functions import pages as P
from digestmill.functions import text as T
from digestmill.functions.scale import exploded

MIN_TEXT = 80
_NOISE, _BLOCK, _H1, _BODY = 1, 2, 4, 8
_NOISE_TAGS = ("script", "style", "noscript", "svg", "canvas", "form", "nav", "footer", "aside", "header")
_BLOCK_TAGS = ("h1", "h2", "h3", "p", "li", "blockquote")
_NOISE_CLASSES = ("cookie", "subscribe", "newsletter", "advert")
_NOISE_IDS = ("cookie", "comment")
# Candidates for the article, in order: article, main, role=main, three classes, body.
_CANDIDATES = (16, 32, 64, 128, 256, 512, _BODY)
_CLASSES = ("article", "post", "content")

_IMAGE, _DROPPED, _NAMED, _RICH_TITLE, _NICKNAME, _RICH_BODY, _ARTICLE = 1, 2, 4, 32, 64, 256, 512
_WECHAT_IDS = {"activity-name": _NAMED, "js_name": _NAMED * 2, "publish_time": _NAMED * 4, "js_content": 128}
_IMAGE_TEXT = "[图片]"


def article_marks(name: Column, tag: Column) -> Column:
    def judged(found: Column) -> Column:
        classes, ident = found[0], found[1]
        noisy = name.isin(*_NOISE_TAGS) | T.contains_any(classes, _NOISE_CLASSES) | T.contains_any(ident, _NOISE_IDS)
        return M.marks(
            [
                (noisy, _NOISE), (name.isin(*_BLOCK_TAGS), _BLOCK), (name == "h1", _H1), (name == "body", _BODY), (name == "article", 16),
                (name == "main", 32), (found[2] == "main", 64),
                *[(M.has_word(classes, word), 128 << place) for place, word in enumerate(_CLASSES)],
            ]
        )

    return T.let(M.attributes(tag, "class", "id", "role"), judged)


def wechat_marks(name: Column, tag: Column) -> Column:
    def judged(found: Column) -> Column:
        classes, ident = found[0], found[1]
        return M.marks(
            [
                (name == "img", _IMAGE), (name.isin("script", "style", "svg", "canvas", "form"), _DROPPED), (name == "article", _ARTICLE),
                *[(ident == value, mark) for value, mark in _WECHAT_IDS.items()],
                ((name == "h1") & M.has_word(classes, "rich_media_title"), _RICH_TITLE),
                (M.has_word(classes, "profile_nickname"), _NICKNAME), (M.has_word(classes, "rich_media_content"), _RICH_BODY),
            ]
        )

    return T.let(M.attributes(tag, "class", "id"), judged)


def article_fields(html: Column) -> Column:
    """STRUCT<h1, body_text, best>: first heading, text of the body, and the longest candidate's blocks, without noise."""

    def read(page: Column) -> Column:
        def with_words(words: Column) -> Column:
            found = page["found"]
            blocks = F.filter(
                F.transform(M.with_mark(found, _BLOCK), lambda item: F.struct(item["at"].alias("at"), T.clean_text(M.said(words, item, " ")).alias("text"))),
                lambda block: F.length(block["text"]) >= 20,
            )

            def longest(every: Column) -> Column:
                def inside(item: Column) -> Column:
                    own = F.filter(every, lambda block: (block["at"] > item["at"]) & (block["at"] < item["end"]))
                    return F.when(item.isNull(), F.lit("")).otherwise(F.array_join(F.transform(own, lambda block: block["text"]), "\n\n"))

                candidates = F.array(*[T.let(M.first_with(found, mark), inside) for mark in _CANDIDATES])
                return F.aggregate(candidates, F.lit(""), lambda best, text: F.when(F.length(text) > F.length(best), text).otherwise(best))

            return F.struct(
                M.said(words, M.first_with(found, _H1), " ").alias("h1"), M.said(words, M.first_with(found, _BODY), "\n").alias("body_text"),
                T.let(blocks, longest).alias("best"),
            )

        return T.let(M.texts(page["stream"], M.with_mark(page["found"], _NOISE)), with_words)

    return T.let(M.tokens(html, article_marks), lambda stream: T.let(F.struct(stream.alias("stream"), M.elements(stream, _NOISE).alias("found")), read))


def wechat_fields(html: Column) -> Column:
    """STRUCT<activity_name, js_name, publish_time, rich_title, nickname, bodies> of a WeChat page."""

    def read(page: Column) -> Column:
        stream, found = page["stream"], page["found"]

        def body(words: Column, mark: int) -> Column:
            def inside(item: Column) -> Column:
                dropped = F.filter(M.with_mark(found, _DROPPED), lambda part: part["at"] > item["at"])
                images = F.transform(stream, lambda token, i: F.when(token["mark"].bitwiseAND(F.lit(_IMAGE)) != 0, F.lit(_IMAGE_TEXT)).otherwise(F.get(words, i)))
                shown = F.transform(images, lambda text, i: F.when(M.within(i, dropped), F.lit("")).otherwise(text))
                return F.when(item.isNull(), F.lit(None).cast("string")).otherwise(M.said(shown, item, "\n"))

            return T.let(M.first_with(found, mark), inside)

        def with_words(words: Column) -> Column:
            named = {name: M.said(words, M.first_with(found, mark), " ") for name, mark in
                     {"activity_name": _NAMED, "js_name": _NAMED * 2, "publish_time": _NAMED * 4, "rich_title": _RICH_TITLE, "nickname": _NICKNAME}.items()}
            bodies = F.array_compact(F.array(*[body(words, mark) for mark in (128, _RICH_BODY, _ARTICLE)]))
            return F.struct(*[text.alias(name) for name, text in named.items()], bodies.alias("bodies"))

        return T.let(M.texts(stream, F.array().cast("array<struct<at:int,end:int,mark:int>>")), with_words)

    return T.let(M.tokens(html, wechat_marks), lambda stream: T.let(F.struct(stream.alias("stream"), M.elements(stream).alias("found")), read))


def extract_pages_light(pages: DataFrame) -> DataFrame:
    """``page_id, url, title, text`` without a parser: native expressions only."""
    return pages.select("page_id", "url", P.light_title(F.col("html")).alias("title"), P.light_text(F.col("html")).alias("text"))


def extract_pages_article(pages: DataFrame) -> DataFrame:
    """Article fields of each page.

    The longest candidate element wins, a longer JSON-LD body beats it, the whole body is the last resort.
    """
    parsed = pages.select("page_id", "url", "html", article_fields(F.col("html")).alias("a"))
    fields = parsed.select(
        "page_id", "url", P.page_metadata(F.col("html"), F.col("a.h1")).alias("m"), F.col("a.best").alias("best"), F.col("a.body_text").alias("body_text"),
    )
    body = F.when(F.length("m.json_ld_body") > F.length("best"), F.col("m.json_ld_body")).otherwise(F.col("best"))
    text = F.coalesce(T.present(body), T.clean_text(F.col("body_text")))
    return fields.select(
        "page_id", "url", F.coalesce("m.title", F.lit("")).alias("title"), "m.author", "m.published_at", "m.og_description", "m.json_ld_type",
        T.normalize_blocks(text).alias("text"),
    )


def page_metadata(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", P.page_metadata(F.col("html")).alias("m")).select("page_id", "m.*").drop("json_ld_body")


def extract_wechat(pages: DataFrame) -> DataFrame:
    """Fields of WeChat articles; a block page carries ``error_code`` and its message instead of text."""
    parsed = pages.select("page_id", "url", "html", wechat_fields(F.col("html")).alias("w")).select("page_id", "url", "html", "w.*")
    html = F.col("html")
    title = T.first_present(
        F.col("activity_name"), F.col("rich_title"), P.script_variable(html, "msg_title"), P.meta_content(html, "property", "og:title")
    )
    author = T.first_present(
        F.col("js_name"), F.col("nickname"), P.script_variable(html, "nickname"), P.meta_content(html, "property", "og:article:author")
    )
    full = F.filter(F.transform("bodies", P.normalize_lines), lambda body: F.length(body) >= MIN_TEXT)
    described = P.unescape_hex(
        F.coalesce(T.first_present(P.meta_content(html, "property", "og:description"), P.meta_content(html, "name", "description")), F.lit(""))
    )
    text = F.coalesce(F.try_element_at(full, F.lit(1)), P.normalize_lines(F.regexp_replace(described, "<[^>]+>", "\n")))
    blocked = P.blocked_page(html)
    return parsed.select(
        "page_id", "url", F.when(blocked.isNull(), P.unescape_hex(title)).alias("title"),
        F.when(blocked.isNull() & author.isNotNull(), P.unescape_hex(author)).alias("author"),
        F.when(blocked.isNull(), P.wechat_published_at(F.col("publish_time"), html)).alias("published_at"),
        F.when(blocked.isNull(), text).alias("text"), P.page_images(html).alias("image_urls"),
        F.when(blocked.isNotNull(), F.lit("wechat_blocked")).alias("error_code"), blocked.alias("error_message"),
    )


def page_images(pages: DataFrame) -> DataFrame:
    """``page_id, seq, image_url``."""
    return exploded(pages, ["page_id"], P.page_images(F.col("html")), "image_url", "seq")


def usable_extracts(extracts: DataFrame, fallback: DataFrame, key: str = "url") -> DataFrame:
    """Extracts with at least 80 characters, from the fallback where the page had less: one row per extract.

    ``extracts(url, title, text, error_code)``, ``fallback(url, title, text)``, met by ``key``, a column of both. Of several
    fallbacks of a key the longest counts. An invalid URL never takes the fallback.
    """
    order = F.struct(F.length("text"), "text", "title")
    other = fallback.groupBy(key).agg(F.max_by(F.struct("title", "text"), order).alias("f"))
    joined = extracts.join(other, key, "left")
    refused = F.col("error_code") == "invalid_url"
    short = F.col("error_code").isNotNull() | (F.length(F.coalesce("text", F.lit(""))) < MIN_TEXT)
    switched = F.coalesce(~refused, F.lit(True)) & short & F.col("f").isNotNull()
    text = F.when(switched, F.col("f.text")).otherwise(F.coalesce("text", F.lit("")))
    error = (
        F.when(F.coalesce(refused, F.lit(False)), F.lit("invalid_url"))
        .when(~switched & F.col("error_code").isNotNull(), F.col("error_code"))
        .when(F.length(text) < MIN_TEXT, F.lit("extraction_failed"))
    )
    return joined.select(
        "url", F.when(error.isNull(), F.when(switched, F.col("f.title")).otherwise(F.col("title"))).alias("title"),
        F.when(error.isNull(), text).alias("text"), (switched & error.isNull()).alias("from_fallback"), error.alias("error_code"),
    )
