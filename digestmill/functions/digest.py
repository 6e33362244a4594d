"""Column functions that build and read digest Markdown. Everything stays inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import text as T
from digestmill.functions import times as C
from digestmill.functions.urls import timestamp_link

_VIDEO = ("bilibili", "youtube")


def _strings() -> Column:
    return F.array().cast("array<string>")


def sentences(text: Column) -> Column:
    """Sentences of a document: its medium-long lines when there are five, else its punctuated parts."""

    def from_raw(raw: Column) -> Column:
        fit = F.filter(F.transform(T.lines(raw), T.collapse), lambda line: F.length(line).between(12, 220))
        return T.let(fit, lambda found: F.when(F.size(found) >= 5, found).otherwise(T.let(T.collapse(raw), punctuated)))

    def punctuated(flat: Column) -> Column:
        spaced = F.split(flat, r"(?<=[。！？.!?]) ")
        tight = F.split(flat, r"(?<=[。！？.!?])")
        parts = T.let(spaced, lambda found: F.when(F.size(found) > 1, found).otherwise(tight))
        return F.filter(F.transform(parts, T.strip), lambda part: F.length(part) >= 20)

    return T.let(T.strip(text), lambda raw: F.when(raw == "", _strings()).otherwise(from_raw(raw)))


def pick_sentences(found: Column, limit: int, skip: int | Column = 0) -> Column:
    """The first ``limit`` sentences with distinct 80-character beginnings."""

    def step(picked: Column, sentence: Column) -> Column:
        seen = F.exists(picked, lambda other: F.left(other, F.lit(80)) == F.left(sentence, F.lit(80)))
        return F.when((F.size(picked) >= limit) | seen, picked).otherwise(F.concat(picked, F.array(sentence)))

    start = F.lit(skip) if isinstance(skip, int) else skip
    rest = F.slice(found, start + 1, F.greatest(F.size(found), F.lit(1)))
    return F.aggregate(rest, _strings(), step)


def key_sentences(found: Column, limit: int = 5) -> Column:
    """Key points come from the fourth sentence on, or from all when there are at most three."""
    return pick_sentences(found, limit, F.when(F.size(found) > 3, 3).otherwise(0))


def transcript_source(source_type: Column, label: Column, status: Column, source: Column) -> Column:
    """Provenance line of a video digest; empty otherwise."""
    details = F.concat_ws("；", T.present(status), T.present(source))
    suffix = F.coalesce(F.concat(F.lit("（"), T.present(details), F.lit("）")), F.lit(""))
    line = F.concat(F.lit("\n- 字幕/转写来源: "), F.coalesce(T.present(label), F.lit(K.UNKNOWN)), suffix)
    known = T.first_present(label, details).isNotNull()
    return F.when(source_type.isin(*_VIDEO) & known, line).otherwise("")


# ---- model responses -----------------------------------------------------------------------


def _of_type(value: Column, name: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(name)), F.lit(False))


def _text_part(part: Column) -> Column:
    """Text of a typed content part; NULL for other kinds."""
    kind = F.try_variant_get(part, "$.type", "variant")
    kind_text = F.try_variant_get(part, "$.type", "string")
    plain = kind.isNull() | F.is_variant_null(kind) | kind_text.isin("text", "output_text")
    text = F.try_variant_get(part, "$.text", "variant")
    return F.when(_of_type(part, "OBJECT") & plain & _of_type(text, "STRING"), F.try_variant_get(part, "$.text", "string"))


def response_text(body: Column) -> Column:
    """Final text of a model response in any of the supported shapes; empty when there is none."""

    def items(value: Column) -> Column:
        return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))

    def content_text(content: Column) -> Column:
        parts = F.transform(
            items(content), lambda p: F.when(_of_type(p, "STRING"), F.try_variant_get(p, "$", "string")).otherwise(_text_part(p))
        )
        joined = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")
        return F.when(_of_type(content, "STRING"), F.try_variant_get(content, "$", "string")).when(
            _of_type(content, "ARRAY"), joined
        ).otherwise("")

    def output_parts(data: Column) -> Column:
        messages = F.filter(
            items(F.try_variant_get(data, "$.output", "variant")),
            lambda m: _of_type(m, "OBJECT") & ~F.coalesce(F.try_variant_get(m, "$.type", "string") == "reasoning", F.lit(False)),
        )
        texts = F.transform(messages, lambda m: F.transform(items(F.try_variant_get(m, "$.content", "variant")), _text_part))
        return F.filter(F.transform(F.flatten(texts), lambda t: T.strip(t)), lambda t: T.present(t).isNotNull())

    def read(data: Column) -> Column:
        message = F.try_variant_get(data, "$.choices[0].message", "variant")
        output_text = F.try_variant_get(data, "$.output_text", "variant")
        plain = F.when(_of_type(output_text, "STRING"), F.try_variant_get(data, "$.output_text", "string"))
        return F.when(_of_type(message, "OBJECT"), content_text(F.try_variant_get(data, "$.choices[0].message.content", "variant"))).when(
            T.present(T.strip(plain)).isNotNull(), plain
        ).otherwise(F.array_join(output_parts(data), "\n"))

    return T.let(F.try_parse_json(body), lambda data: F.coalesce(read(data), F.lit("")))


def sanitize_response(text: Column) -> Column:
    """STRUCT<text, error>: fence and closed reasoning blocks removed, cut to the first required section."""
    names = "|".join(K.REASONING_TAGS)
    fence = r"(?is)^```(?:markdown|md)?\s*\n(.*)\n```\z"

    def unwrap(raw: Column) -> Column:
        return F.when(F.rlike(raw, F.lit(fence)), T.strip(F.regexp_extract(raw, fence, 1))).otherwise(raw)

    def cut(clean: Column) -> Column:
        places = [F.nullif(F.locate(section, clean), F.lit(0)) for section in K.REQUIRED_SECTIONS]
        first = F.least(*places)
        return F.when(first.isNull(), clean).otherwise(T.strip(F.substr(clean, first)))

    def judge(clean: Column) -> Column:
        open_tag = F.rlike(clean, F.lit(rf"(?i)</?(?:{names})\b"))
        return T.let(
            cut(clean),
            lambda body: F.struct(
                body.alias("text"),
                F.when(open_tag, F.lit(K.ERR_REASONING)).when(T.contains_any(body, K.PROMPT_LEAK_MARKERS), F.lit(K.ERR_LEAK)).alias("error"),
            ),
        )

    blocks = T.strip(F.regexp_replace(unwrap(T.strip(text)), rf"(?is)<({names})\b[^>]*>.*?</\1>\s*", ""))
    return T.let(blocks, judge)


def missing_sections(markdown: Column) -> Column:
    wanted = F.array(*[F.lit(section) for section in K.REQUIRED_SECTIONS])
    return F.filter(wanted, lambda section: ~F.contains(markdown, section))


def ensure_sections(markdown: Column) -> Column:
    """Missing headings appended with a placeholder; an empty text stays empty."""
    added = F.transform(missing_sections(markdown), lambda section: F.concat(section, F.lit("\n" + K.MISSING_SECTION_TEXT)))
    return F.when((markdown == "") | (F.size(added) == 0), markdown).otherwise(
        F.concat(T.rstrip(markdown), F.lit("\n\n"), F.array_join(added, "\n\n"))
    )


def provider_label(provider: Column, base_url: Column) -> Column:
    """Display name of a model provider."""
    location = F.substring_index(F.regexp_extract(base_url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), "@", -1)
    bracketed = F.regexp_extract(location, r"\[([^\]]*)\]", 1)
    host = F.lower(F.when(bracketed != "", bracketed).otherwise(F.substring_index(location, ":", 1)))
    port = F.regexp_extract(location, r":([0-9]+)$", 1)
    local = F.when(port == "11434", "Ollama").when(port == "1234", "LM Studio").otherwise("本地 OpenAI-compatible")
    labels = F.map_from_arrays(
        F.array(*[F.lit(key) for key in K.PROVIDER_LABELS]), F.array(*[F.lit(value) for value in K.PROVIDER_LABELS.values()])
    )
    return T.first_match(
        [
            (F.lower(provider) == "deepseek", "DeepSeek"), (F.lower(provider) != "openai_compatible", provider),
            (host.isin(*K.LOOPBACK_HOSTS), local),
        ],
        F.coalesce(F.try_element_at(labels, host), F.lit("OpenAI-compatible")),
    )


def error_reason(http_code: Column, detail: Column, chars: int | None = None) -> Column:
    """Reason text of a failed model call by status code, with the whole detail or ``chars`` of it."""
    label = (
        F.when(http_code.isin(401, 403), "authentication or permission error").when(http_code == 429, "rate limit or quota error")
        .when(http_code.between(500, 599), "provider server error").otherwise("http error")
    )
    shown = T.present(T.strip(detail))
    suffix = F.coalesce(F.concat(F.lit(": "), shown if chars is None else F.left(shown, F.lit(chars))), F.lit(""))
    return F.concat(F.lit("model API "), label, F.lit(" (HTTP "), http_code.cast("string"), F.lit(")"), suffix)


# ---- points and timeline -------------------------------------------------------------------


def clean_point(text: Column, chars: int | None = None) -> Column:
    """A list item as a point: without marks and stamps, whole or its first ``chars`` characters."""
    for pattern, value in (
        (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"`([^`]+)`", "$1"), (r"[*_>#]", ""), (rf"^\[[^\]]+\]{T.WS}*", ""),
        (rf"^\d{{1,2}}:\d{{2}}(?::\d{{2}})?{T.WS}*", ""), (T.WS + "+", " "),
    ):
        text = F.regexp_replace(text, pattern, value)
    text = F.btrim(text, F.lit(" -。；;"))
    return text if chars is None else F.left(text, F.lit(chars))


def _section(markdown: Column, heading: str) -> Column:
    return F.regexp_extract(markdown, rf"(?dms)^## {heading}{T.WS}*\n(.*?)(?=^## |\z)", 1)


def summary_points(markdown: Column, chars: int | None = None) -> Column:
    """Points of a digest: list items of the core-points section, else its one-line conclusion; whole, or ``chars`` of each."""
    bullet = rf"^{T.WS}*(?:[-*+]|\d+[.)]){T.WS}+(.+)$"

    def listed(heading: str) -> Column:
        items = F.filter(T.lines(_section(markdown, heading)), lambda line: F.rlike(line, F.lit(bullet)))
        return F.filter(F.transform(items, lambda line: clean_point(F.regexp_extract(line, bullet, 1), chars)), lambda point: point != "")

    conclusion = clean_point(F.array_join(F.transform(T.lines(_section(markdown, K.ONE_LINE_CONCLUSION)), T.strip), " "), chars)
    only = T.let(conclusion, lambda text: F.when(text != "", F.array(text)).otherwise(_strings()))
    return T.let(
        listed(K.CORE_POINTS),
        lambda own: F.when(F.size(own) > 0, own).otherwise(
            T.let(listed(K.CORE_POINTS_EN), lambda other: F.when(F.size(other) > 0, other).otherwise(only))
        ),
    )


def match_text(text: Column) -> Column:
    """Letters, digits and underscores of a text, lower-cased, as matching reads it."""
    return F.regexp_replace(F.lower(text), f"[^{T.WORD}{T.CJK}]+", "")


def match_runs(clean: Column) -> Column:
    return F.regexp_extract_all(clean, F.lit(rf"([a-z0-9]{{3,}}|[{T.CJK}]{{2,}})"), F.lit(1))


def match_pairs(clean: Column) -> Column:
    """Overlapping pairs by look-ahead: one pass, where cutting pairs out by position is quadratic."""
    return F.regexp_extract_all(clean, F.lit(r"(?=([\x{0}-\x{D7FF}\x{E000}-\x{10FFFF}]{2}))"), F.lit(1))


def match_tokens(text: Column) -> Column:
    """Distinct tokens of a text for matching: long runs and all character pairs, without stop words."""

    def tokens(clean: Column) -> Column:
        return F.array_except(F.concat(match_runs(clean), match_pairs(clean)), F.array(*[F.lit(word) for word in K.TOKEN_STOP_WORDS]))

    return T.let(match_text(text), tokens)


def timeline_cues(transcript: Column, chars: int | None = None) -> Column:
    """ARRAY<STRUCT<time, seconds, text>> of the stamped lines of a transcript, with whole texts or ``chars`` of each."""
    stamped = F.filter(
        F.transform(C.transcript_lines(F.coalesce(transcript, F.lit(""))), T.strip), lambda line: F.rlike(line, F.lit(C.STAMPED))
    )

    def cue(line: Column) -> Column:
        time = F.substring_index(F.regexp_extract(line, C.STAMPED, 1), "-", 1)
        text = T.collapse(F.regexp_extract(line, C.STAMPED, 2))
        return F.struct(time.alias("time"), C.link_seconds(time).alias("seconds"), (text if chars is None else F.left(text, F.lit(chars))).alias("text"))

    return F.filter(F.transform(stamped, cue), lambda item: item["text"] != "")


# Cues that a cue's window takes in, itself included.
WINDOW_CUES = 4


def cue_scores(points: Column, cues: Column, offset: Column | None = None, count: int | None = None) -> Column:
    """For each point (a set of tokens) its best cues: ARRAY<ARRAY<STRUCT<own, window, index, time, seconds>>>.

    A cue counts when its window shares a token with the point; more common tokens with the cue come first, then with
    the window, then the earlier cue. Earlier points can take at most as many cues as there are, so a point keeps one
    more than that. ``offset`` is the index of the first cue and ``count`` the number that are judged where ``cues`` is a
    part of a transcript; the rest completes the windows. Scores are negative, so that an ascending sort has them in order.
    """

    # The pairs of a window are those of its cues and of their borders, so each cue is read once; runs can grow over a border.
    def prepared(cue: Column, i: Column) -> Column:
        place = i if offset is None else i + offset

        def read(clean: Column) -> Column:
            return F.struct(
                place.cast("int").alias("index"), cue["time"].alias("time"), cue["seconds"].cast("bigint").alias("seconds"),
                clean.alias("clean"), match_pairs(clean).alias("pairs"), match_runs(clean).alias("runs"),
            )

        return T.let(match_text(cue["text"]), read)

    def windowed(every: Column) -> Column:
        def window(cue: Column, i: Column) -> Column:
            texts = F.filter(F.transform(F.slice(every, i + 1, WINDOW_CUES), lambda c: c["clean"]), lambda clean: clean != "")

            def read(parts: Column) -> Column:
                ahead = F.slice(parts, F.lit(2), F.lit(WINDOW_CUES))
                borders = F.zip_with(F.slice(parts, F.lit(1), F.size(ahead)), ahead, lambda a, b: F.concat(F.right(a, F.lit(1)), F.left(b, F.lit(1))))
                return F.struct(cue.alias("cue"), match_runs(F.array_join(parts, "")).alias("runs"), borders.alias("borders"))

            return T.let(texts, read)

        return F.struct(every.alias("cues"), F.transform(every if count is None else F.slice(every, 1, count), window).alias("windows"))

    def ranked(ready: Column) -> Column:
        def of_point(tokens: Column, seq: Column) -> Column:
            # Shorter tokens are pairs, a run of two included.
            long = F.filter(tokens, lambda token: F.length(token) > 2)
            pairs = F.transform(ready["cues"], lambda cue: F.array_intersect(tokens, cue["pairs"]))

            def scores(common: Column) -> Column:
                def score(item: Column, i: Column) -> Column:
                    cue = item["cue"]
                    own = F.size(F.get(common["pairs"], i)) + F.size(F.array_intersect(common["long"], cue["runs"]))
                    border = F.filter(item["borders"], lambda pair: F.array_contains(tokens, pair))
                    seen = F.array_distinct(F.concat(F.flatten(F.slice(common["pairs"], i + 1, WINDOW_CUES)), border))
                    window = F.size(seen) + F.size(F.array_intersect(common["long"], item["runs"]))
                    return F.struct((-own).alias("own"), (-window).alias("window"), cue["index"].alias("index"), cue["time"].alias("time"), cue["seconds"].alias("seconds"))

                scored = F.filter(F.transform(ready["windows"], score), lambda item: item["window"] < 0)
                return F.slice(F.array_sort(scored), F.lit(1), seq + 1)

            return T.let(F.struct(pairs.alias("pairs"), long.alias("long")), scores)

        return F.transform(points, of_point)

    return T.let(T.let(F.transform(cues, prepared), windowed), ranked)


def take_in_order(ranked: Column) -> Column:
    """The cue each point gets when points choose in order and a chosen cue is taken: ARRAY<STRUCT<index, time, seconds>>.

    ``ranked`` holds the best cues of each point, as ``cue_scores`` gives them; NULL fields where none is left.
    """
    hit = "struct<index:int,time:string,seconds:bigint>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{hit}>").alias("found"))

    def step(state: Column, best: Column) -> Column:
        free = F.try_element_at(F.filter(best, lambda cue: ~F.array_contains(state["used"], cue["index"])), F.lit(1))

        def keep(cue: Column) -> Column:
            chosen = F.struct(cue["index"].alias("index"), cue["time"].alias("time"), cue["seconds"].alias("seconds"))
            return F.struct(
                F.when(cue.isNull(), state["used"]).otherwise(F.concat(state["used"], F.array(cue["index"]))).alias("used"),
                F.concat(state["found"], F.array(chosen)).alias("found"),
            )

        return T.let(free, keep)

    return F.aggregate(ranked, start, step, lambda state: state["found"])


def match_points(points: Column, cues: Column) -> Column:
    """The cue each point starts at: ARRAY<STRUCT<index, time, seconds>>, NULL fields when none fits."""
    return T.let(cue_scores(F.transform(points, match_tokens), cues), take_in_order)


def without_timeline(markdown: Column) -> Column:
    """Markdown without any timeline section."""
    headings = "|".join(K.TIMELINE_HEADINGS)
    return T.rstrip(F.regexp_replace(markdown, rf"(?ds)\n## (?:{headings})\n.*?(?=\n## |\z)", "\n"))


def timeline_item(url: Column, point: Column, index: Column, time: Column, seconds: Column) -> Column:
    """One line of the core timeline."""
    linked = F.concat(F.lit("- ["), time, F.lit("]("), timestamp_link(url, seconds), F.lit(") "), point)
    return F.when(index.isNull(), F.concat(F.lit("- " + K.TIME_UNKNOWN), point)).otherwise(linked)


def with_timeline(body: Column, items: Column) -> Column:
    """A digest body with its timeline lines; without lines as it is."""
    tail = F.concat(F.lit(f"\n\n## {K.CORE_TIMELINE}\n\n"), F.array_join(items, "\n"), F.lit("\n\n" + K.FULL_TIMELINE_LINE))
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, body).otherwise(F.concat(body, tail))


def core_timeline(markdown: Column, url: Column, transcript: Column, point_chars: int | None = None, cue_chars: int | None = None) -> Column:
    """Digest with one timeline item per point, replacing any timeline it had.

    One row does all of its own work; ``operators.digest.core_timelines`` spreads long transcripts over rows.
    """

    def with_points(body: Column, points: Column) -> Column:
        def item(point: Column, hit: Column) -> Column:
            return timeline_item(url, point, hit["index"], hit["time"], hit["seconds"])

        hits = match_points(points, timeline_cues(transcript, cue_chars))
        return with_timeline(body, T.let(hits, lambda found: F.zip_with(points, found, item)))

    return T.let(without_timeline(markdown), lambda body: T.let(summary_points(body, point_chars), lambda points: with_points(body, points)))


def with_video_timeline(markdown: Column, source_type: Column, url: Column, transcript: Column) -> Column:
    return F.when(source_type.isin(*_VIDEO), core_timeline(markdown, url, transcript)).otherwise(markdown)
