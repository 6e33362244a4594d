"""Column functions over raw HTML: light text, metadata, JSON-LD, images, block pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import text as T

_NOISE_TAGS = "script|style|noscript|svg|canvas|form|nav|footer|aside|header"
_META = r"""(?is)(<meta\b(?:"[^"]*"|'[^']*'|[^'">])*>)"""


def _raw_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def light_title(html: Column) -> Column:
    return T.clean_text(T.unescape_html(_raw_title(html)))


def light_text(html: Column) -> Column:
    """Text without script, style and tags; non-empty lines joined by a blank line."""
    bare = F.regexp_replace(html, r"(?is)<(script|style).*?>.*?</\1>", " ")
    return T.normalize_blocks(T.unescape_html(F.regexp_replace(bare, r"(?s)<[^>]+>", " ")))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, group) for group in (1, 2, 3)])


def meta_raw(html: Column, attribute: str, value: str) -> Column:
    """Raw content of the first ``<meta>`` whose attribute has the value; NULL when absent."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(_META), F.lit(1)), lambda tag: _attribute(tag, attribute) == value)
    return T.let(F.try_element_at(tags, F.lit(1)), lambda tag: _attribute(tag, "content"))


def meta_content(html: Column, attribute: str, value: str) -> Column:
    """Cleaned content of the first ``<meta>`` whose attribute has the value; empty when absent."""
    return T.clean_text(meta_raw(html, attribute, value))


def _first_clean(*raw: Column) -> Column:
    """The first candidate that is not empty once cleaned. One cleaning expression serves all of them."""
    return F.try_element_at(F.filter(F.transform(F.array(*raw), T.clean_text), lambda text: text != ""), F.lit(1))


def first_heading(html: Column) -> Column:
    """Raw text of the first h1 outside the noise elements."""
    kept = F.regexp_replace(html, rf"(?is)<({_NOISE_TAGS})\b[^>]*>.*?</\1>", " ")
    inner = F.regexp_extract(kept, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    return F.regexp_replace(inner, r"(?s)<[^>]+>", " ")


def json_ld_article(html: Column) -> Column:
    """The first JSON-LD item that is an article, graphs before their item, as a variant; NULL when there is none."""
    scripts = F.regexp_extract_all(
        html, F.lit(r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""), F.lit(1)
    )
    empty = F.array().cast("array<variant>")

    def listed(value: Column) -> Column:
        return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), empty)

    def items(raw: Column) -> Column:
        def expand(data: Column) -> Column:
            top = F.when(F.startswith(F.schema_of_variant(data), F.lit("ARRAY")), listed(data)).otherwise(F.array(data))
            return F.flatten(F.transform(top, lambda item: F.concat(listed(F.try_variant_get(item, "$['@graph']", "variant")), F.array(item))))

        return T.let(F.try_parse_json(raw), lambda data: F.when(data.isNull(), empty).otherwise(expand(data)))

    def is_article(item: Column) -> Column:
        kinds = F.concat(
            F.array(F.try_variant_get(item, "$['@type']", "string")),
            F.coalesce(F.try_variant_get(item, "$['@type']", "array<string>"), F.array().cast("array<string>")),
        )
        return F.exists(kinds, lambda kind: F.coalesce(F.lower(kind).isin("article", "newsarticle", "blogposting", "report"), F.lit(False)))

    return F.try_element_at(F.filter(F.flatten(F.transform(scripts, items)), is_article), F.lit(1))


def json_ld_fields(html: Column) -> Column:
    """STRUCT<type, headline, author, published_at, body> of the JSON-LD article; texts are empty when absent."""

    def get(item: Column, path: str, kind: str = "string") -> Column:
        return F.try_variant_get(item, path, kind)

    def fields(item: Column) -> Column:
        author = T.first_present(
            F.when(F.startswith(F.schema_of_variant(get(item, "$.author", "variant")), F.lit("OBJECT")), get(item, "$.author.name")),
            get(item, "$.author[0].name"),
            F.when(F.startswith(F.schema_of_variant(get(item, "$.author[0]", "variant")), F.lit("STRING")), get(item, "$.author[0]")),
            F.when(F.startswith(F.schema_of_variant(get(item, "$.author", "variant")), F.lit("STRING")), get(item, "$.author")),
        )
        body = T.first_present(get(item, "$.articleBody"), get(item, "$.text"))
        return F.struct(
            F.coalesce(get(item, "$['@type']"), get(item, "$['@type'][0]"), F.lit("")).alias("type"),
            F.coalesce(get(item, "$.headline"), F.lit("")).alias("headline"), F.coalesce(author, F.lit("")).alias("author"),
            F.coalesce(get(item, "$.datePublished"), F.lit("")).alias("published_at"),
            T.normalize_blocks(F.coalesce(body, F.lit(""))).alias("body"),
        )

    return T.let(json_ld_article(html), fields)


def page_metadata(html: Column, heading: Column | None = None) -> Column:
    """STRUCT<title, author, published_at, og_description, json_ld_type, json_ld_body> by precedence."""

    def build(ld: Column) -> Column:
        title = F.coalesce(
            T.present(ld["headline"]),
            _first_clean(
                heading if heading is not None else first_heading(html), meta_raw(html, "property", "og:title"),
                meta_raw(html, "name", "twitter:title"), _raw_title(html),
            ),
        )
        author = _first_clean(ld["author"], meta_raw(html, "name", "author"), meta_raw(html, "property", "article:author"))
        published = F.coalesce(
            T.present(ld["published_at"]), _first_clean(meta_raw(html, "property", "article:published_time"), meta_raw(html, "name", "date"))
        )
        return F.struct(
            title.alias("title"), author.alias("author"), published.alias("published_at"),
            meta_content(html, "property", "og:description").alias("og_description"), ld["type"].alias("json_ld_type"),
            ld["body"].alias("json_ld_body"),
        )

    return T.let(json_ld_fields(html), build)


def page_images(html: Column) -> Column:
    """Image addresses in first-seen order over three patterns."""
    patterns = (
        r'<img[^>]+(?:data-src|src)="([^"]+)"',
        r"""cdn_url_\d+_\d+\s*=\s*["'](https?://mmbiz[^"']+)""",
        r"""msg_cdn_url\s*=\s*["'](https?://mmbiz[^"']+)""",
    )
    found = F.concat(*[F.regexp_extract_all(html, F.lit(pattern), F.lit(1)) for pattern in patterns])
    return F.array_distinct(F.filter(F.transform(found, T.unescape_html), lambda url: F.startswith(url, F.lit("http"))))


def blocked_page(html: Column) -> Column:
    """Message of the first block-page marker; NULL for a normal page."""
    return T.first_match([(F.contains(html, F.lit(marker)), message) for marker, message in K.BLOCKED_PAGE_MARKERS])


def unescape_hex(value: Column) -> Column:
    r"""``\xNN`` escapes and entities to characters."""

    def piece(part: Column, index: Column) -> Column:
        code = F.regexp_extract(part, "^([0-9a-fA-F]{2})", 1)
        decoded = F.concat(F.decode(F.unhex(code), "ISO-8859-1"), F.substr(part, F.lit(3)))
        return F.when(index == 0, part).when(code == "", F.concat(F.lit("\\x"), part)).otherwise(decoded)

    def expand(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("\\x")), F.array_join(F.transform(F.split(text, r"\\x"), piece), "")).otherwise(text)

    return T.unescape_html(T.let(F.coalesce(value, F.lit("")), expand))


def script_variable(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"""(?s)(?:var\s+|window\.){name}\s*=\s*(?:window\.title\s*=\s*)?(['"])(.*?)\1""", 2)


def wechat_published_at(visible: Column, html: Column) -> Column:
    """Visible time text, else the ``ct`` epoch as ISO UTC."""
    epoch = F.regexp_extract(html, r"""(?:var\s+|window\.)ct\s*=\s*['"]?(\d+)['"]?""", 1).try_cast("bigint")
    iso = F.concat(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return T.first_present(visible, iso)


def normalize_lines(text: Column) -> Column:
    rows = F.transform(F.split(unescape_hex(text), r"[\r\n]+"), T.collapse)
    return F.array_join(F.filter(rows, lambda row: row != ""), "\n")


def reader_text(text: Column) -> Column:
    """STRUCT<title, text> of a reader-service reply; NULL when it is under 80 characters."""

    def read(body: Column) -> Column:
        title = T.clean_text(F.regexp_extract(body, r"(?dm)^Title:\s*(.+)$", 1))
        rest = T.normalize_blocks(T.strip(F.regexp_replace(body, r"(?dm)^Title:.*?(?:\n|$)", "")))
        return F.when(F.length(body) >= 80, F.struct(title.alias("title"), rest.alias("text")))

    return T.let(T.strip(text), read)


def compact_metadata(metadata: Column) -> Column:
    """JSON with the kept metadata keys; absent keys stay absent, values are unchanged."""
    parsed = F.from_json(metadata, "map<string,variant>")
    return F.to_json(F.map_filter(parsed, lambda key, value: key.isin(*K.METADATA_KEYS)))


def video_text(metadata: Column, url: Column, most_tags: int | None = None, most_captions: int | None = None) -> Column:
    """Labelled text block of a video's metadata JSON, with all tags and automatic captions unless a number is asked for."""

    def build(data: Column) -> Column:
        def field(name: str) -> Column:
            return T.present(F.try_variant_get(data, f"$.{name}", "string"))

        def label(name: str, value: Column) -> Column:
            return F.concat(F.lit(name + ": "), value)

        def languages(name: str) -> Column:
            captions = F.try_variant_get(data, f"$.{name}", "map<string,variant>")
            return F.array_sort(F.coalesce(F.map_keys(captions), F.array().cast("array<string>")))

        def joined(values: Column, most: int | None = None) -> Column:
            shown = values if most is None else F.slice(values, 1, most)
            return F.when(F.size(values) > 0, F.array_join(shown, ", "))

        tags = F.coalesce(F.try_variant_get(data, "$.tags", "array<string>"), F.array().cast("array<string>"))
        manual, auto = languages("subtitles"), languages("automatic_captions")
        seconds = F.when(F.try_variant_get(data, "$.duration", "double") != 0, field("duration"))
        return F.concat_ws(
            "\n\n", label("Title", F.coalesce(field("title"), url)), label("Author", F.coalesce(field("uploader"), field("channel"))),
            F.coalesce(label("Duration", field("duration_string")), label("Duration seconds", seconds)),
            label("Description", field("description")), label("Tags", joined(tags, most_tags)), label("Available subtitles", joined(manual)),
            label("Available automatic captions", joined(auto, most_captions)),
            F.when((F.size(manual) == 0) & (F.size(auto) == 0), F.lit(K.NO_SUBTITLES_LINE)),
        )

    return T.let(F.try_parse_json(metadata), build)


def with_transcript(content: Column, transcript: Column) -> Column:
    bare = F.replace(content, F.lit("\n\n" + K.NO_SUBTITLES_LINE), F.lit(""))
    return F.concat(bare, F.lit("\n\nTranscript:\n\n"), transcript)
