"""Library of digests: rows, postings, search, listings, favourites, tables of contents, output paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestmill.functions import text as T
from digestmill.functions.scale import exploded, materialize, newest, numbered_within

HIDDEN_NAMES = ("latest.md", "summary.md", "timeline.md")
POSTING_TOKEN = f"([{T.CJK}]|[A-Za-z0-9]+)"


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(_name(path), r"(?<=.)\.[^.]*$", "")


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def searchable(path: Column) -> Column:
    """Markdown digests outside the favourites, without the package files."""
    return F.endswith(path, F.lit(".md")) & (F.substring_index(path, "/", 1) != "favorites") & ~_name(path).isin(*HIDDEN_NAMES)


def _source_type(path: Column) -> Column:
    return F.when(F.size(_parts(path)) > 2, F.try_element_at(_parts(path), F.lit(2))).otherwise("output")


def markdown_title(content: Column) -> Column:
    """Text of the first line that starts with ``# ``; empty when there is none."""
    return T.strip(F.regexp_extract(content, rf"(?:^|{T.LINE_BREAK})# ([^\n\r\x0b\x0c\x1c-\x1e\x85  ]*)", 1))


def library_rows(files: DataFrame) -> DataFrame:
    """Index rows for searchable files ``(relative_path, content, mtime, size)``."""
    path = F.col("relative_path")
    return (
        files.filter(searchable(path))
        .withColumn("title", F.coalesce(T.present(markdown_title(F.col("content"))), _stem(path)))
        .select(
            path, "title", _source_type(path).alias("source_type"), "content",
            T.search_text(F.concat_ws("\n", "title", "relative_path", "content")).alias("search_text"),
            "mtime", "size", F.timestamp_micros((F.col("mtime") * 1_000_000).cast("bigint")).alias("updated_at"),
        )
    )


def build_postings(library: DataFrame) -> DataFrame:
    """``token, relative_path, pos``: one row per token, positions running over the whole search text."""
    tokens = F.regexp_extract_all(F.col("search_text"), F.lit(POSTING_TOKEN), F.lit(1))
    return exploded(library, ["relative_path"], tokens, "token", "pos").select("token", "relative_path", "pos")


def token_totals(library: DataFrame) -> DataFrame:
    """``token, occurrences, documents, positions`` over all postings; rows that share a path are one document.

    The tokens of a row are sorted within it, so that a path of its own counts without moving its postings. Only rows
    whose path occurs in others meet by (token, path).
    """
    repeated = materialize(library.groupBy("relative_path").agg(F.count("*").alias("n")).filter("n > 1").select("relative_path"))
    known = F.broadcast(repeated) if repeated.count() <= MOST_PATHS else repeated
    single = library.join(known, "relative_path", "left_anti")
    tokens = F.regexp_extract_all(F.col("search_text"), F.lit(POSTING_TOKEN), F.lit(1))
    placed = F.array_sort(F.transform(tokens, lambda token, pos: F.struct(token.alias("token"), pos.alias("pos"))))
    marked = T.let(
        placed,
        lambda items: F.transform(
            items, lambda item, at: F.struct(item["token"].alias("token"), item["pos"].alias("pos"), (F.get(items, at - 1)["token"].eqNullSafe(item["token"])).alias("again"))
        ),
    )
    rows = exploded(single, [], marked, "item").select("item.*")
    single = rows.groupBy("token").agg(F.count("*").alias("n"), F.count_if(~F.col("again")).alias("d"), F.sum("pos").alias("p"))
    shared = build_postings(library.join(known, "relative_path", "left_semi")).groupBy("token", "relative_path").agg(F.count("*").alias("n"), F.sum("pos").alias("p"))
    both = single.unionByName(shared.select("token", "n", F.lit(1).cast("bigint").alias("d"), "p"))
    return both.groupBy("token").agg(F.sum("n").alias("occurrences"), F.sum("d").alias("documents"), F.sum("p").alias("positions"))


def write_postings(postings: DataFrame, path: str, files: int | None = None) -> None:
    """Postings sorted by token. Ranges over (token, path) split a frequent token over many files,
    and the sorted files let a search skip all others by their min/max statistics."""
    keys = [F.col("token"), F.col("relative_path"), F.col("pos")]
    ranged = postings.repartitionByRange(files, *keys) if files else postings.repartitionByRange(*keys)
    ranged.sortWithinPartitions("token", "relative_path", "pos").write.mode("errorifexists").parquet(path)


def query_clauses(query: str) -> list[list[str]]:
    """Phrases of a query: each CJK run is a phrase of characters, each word a phrase of its
    underscore-separated parts."""
    runs = re.findall(rf"[{T.CJK}]+|[A-Za-z0-9_]+", query.lower())
    clauses = [re.findall(rf"[{T.CJK}]|[a-z0-9]+", run) for run in runs]
    return [clause for clause in clauses if clause]


def query_tokens(query: str) -> list[str]:
    """The tokens a search for the query needs postings of."""
    return sorted({token for clause in query_clauses(query) for token in clause})


def matching_paths(postings: DataFrame, clauses: list[list[str]]) -> DataFrame:
    """Paths that hold every phrase.

    One filtered scan of the postings. A phrase match is a base position at which all of its terms
    line up; bases are counted per (path, clause, base) and clauses per path, both with partial
    aggregation, so neither a frequent token nor a long document gathers in one task.
    """
    places: dict[str, list[tuple[int, int]]] = {}
    for number, clause in enumerate(clauses):
        for offset, token in enumerate(clause):
            places.setdefault(token, []).append((number, offset))
    wanted = postings.filter(F.col("token").isin(*places))
    if all(len(clause) == 1 for clause in clauses):
        bit = T.first_match([(F.col("token") == token, F.lit(sorted({n for n, _ in spots}))) for token, spots in places.items()])
        hits = wanted.select("relative_path", F.explode(bit).alias("clause"))
    else:
        slots = T.first_match(
            [
                (F.col("token") == token, F.array(*[F.struct(F.lit(n).alias("clause"), F.lit(o).alias("shift")) for n, o in spots]))
                for token, spots in places.items()
            ]
        )
        lengths = F.array(*[F.lit(len(clause)) for clause in clauses])
        lined_up = wanted.select("relative_path", "pos", F.explode(slots).alias("slot")).groupBy(
            "relative_path", F.col("slot.clause").alias("clause"), (F.col("pos") - F.col("slot.shift")).alias("base")
        ).agg(F.count("*").alias("terms"))
        hits = lined_up.filter(F.col("terms") == F.get(lengths, F.col("clause"))).select("relative_path", "clause")
    found = hits.groupBy("relative_path").agg(F.count_distinct("clause").alias("clauses"))
    return found.filter(F.col("clauses") == len(clauses)).select("relative_path")


def search(library: DataFrame, postings: DataFrame, query: str, source_type: str = "", limit: int | None = None) -> DataFrame:
    """Documents that hold all words of the query, newest first: all, or ``limit`` of them.

    A query without words finds nothing. Paths are chosen on slim columns; content is fetched for those only.
    """
    clauses = query_clauses(query)
    if not clauses:
        return library.filter(F.lit(False)).withColumn("snippet", F.lit(""))
    slim = library.select("relative_path", "mtime", "source_type")
    slim = slim.filter(F.col("source_type") == source_type) if source_type else slim
    found = slim.join(matching_paths(postings, clauses), "relative_path", "left_semi")
    if limit is not None:
        found = newest(found, [F.desc("mtime"), "relative_path"], limit)
    rows = library.join(found.select("relative_path"), "relative_path", "left_semi")
    return rows.withColumn("snippet", snippet(F.col("content"), query.strip())).orderBy(F.desc("mtime"), "relative_path")


def search_many(library: DataFrame, postings: DataFrame, queries: list[str], limit: int | None = None) -> DataFrame:
    """Several searches as one union of single searches, each with its own cut."""
    frames = [search(library, postings, query, limit=limit).withColumn("query", F.lit(query)) for query in queries]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


# ---- substring search over trigrams ----------------------------------------------------------

# Candidate paths are named in the scan up to this number, so that it can skip all others; more are joined.
MOST_PATHS = 10_000


def like_text() -> Column:
    """What ``search_like`` looks into."""
    return F.col("search_text")


def scan_text() -> Column:
    """What ``search_scan`` looks into."""
    return F.lower(F.concat_ws("\n", "title", "relative_path", "content"))


def build_trigrams(rows: DataFrame, text: Column) -> DataFrame:
    """``gram, relative_path``: every three characters in a row of a text, each once per path."""
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))
    return exploded(rows, ["relative_path"], grams, "gram").select("gram", "relative_path")


def write_trigrams(trigrams: DataFrame, path: str, files: int | None = None) -> None:
    """Trigrams sorted and in ranges of (gram, path): a search skips all files but those of its grams."""
    keys = [F.col("gram"), F.col("relative_path")]
    ranged = trigrams.repartitionByRange(files, *keys) if files else trigrams.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)


def needle_grams(needle: str, any_char: str = "") -> list[str]:
    """The trigrams a text with the needle must hold; characters of ``any_char`` match anything, so no gram spans them."""
    parts = re.split(f"[{re.escape(any_char)}]", needle) if any_char else [needle]
    return sorted({part[at : at + 3] for part in parts for at in range(len(part) - 2)})


def candidates(rows: DataFrame, trigrams: DataFrame | None, needle: str, any_char: str = "") -> DataFrame:
    """The rows that can hold a needle: all of its trigrams are posted for them. The caller still looks into the text.

    Without an index, or for a needle under three characters, these are all rows.
    """
    grams = needle_grams(needle, any_char)
    if trigrams is None or not grams:
        return rows
    met = trigrams.filter(F.col("gram").isin(grams)).groupBy("relative_path").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
    paths = materialize(met.select("relative_path"))
    if paths.count() <= MOST_PATHS:
        return rows.filter(F.col("relative_path").isin([row["relative_path"] for row in paths.collect()]))
    return rows.join(paths, "relative_path", "left_semi")


def search_like(library: DataFrame, query: str, source_type: str = "", limit: int | None = None, trigrams: DataFrame | None = None) -> DataFrame:
    """Fallback search: the normalised query as a LIKE pattern inside the search text (``_`` matches any character).

    With ``trigrams`` of the search texts only the texts that can match are looked into.
    """
    words = " ".join(re.findall(rf"[{T.CJK}]|[A-Za-z0-9_]+", query.lower()))
    found = candidates(library, trigrams, words, "_").filter(F.col("search_text").like(f"%{words}%"))
    found = found.filter(F.col("source_type") == source_type) if source_type else found
    return newest(found, [F.desc("mtime"), "relative_path"], limit)


def search_scan(
    listing: DataFrame, query: str, source_type: str = "", limit: int | None = None, look_at: int | None = None, trigrams: DataFrame | None = None
) -> DataFrame:
    """Plain scan: the lower-cased query inside title, path or text of the listed files, newest first.

    ``listing`` comes from ``list_library`` with ``content``. All files are looked at and all hits returned;
    a caller may look at the ``look_at`` newest files only, or ask for ``limit`` hits. Paths are cut on slim
    columns and content is fetched for the chosen ones; with ``trigrams`` of the scanned texts, of those that can match.
    """
    needle = query.strip().lower()
    order = [F.desc("mtime"), "relative_path"]
    seen = listing
    if look_at is not None:
        seen = listing.join(newest(listing.select("mtime", "relative_path"), order, look_at).select("relative_path"), "relative_path", "left_semi")
    found = candidates(seen, trigrams, needle).filter(F.contains(scan_text(), F.lit(needle)) & F.lit(needle != ""))
    found = found.filter(F.col("source_type") == source_type) if source_type else found
    if limit is not None:
        top = newest(found.select("mtime", "relative_path"), order, limit).select("relative_path")
        found = found.join(top, "relative_path", "left_semi")
    return found.orderBy(*order).withColumn("snippet", scan_snippet(F.col("content"), query))


def snippet(content: Column, query: str, radius: int = 90) -> Column:
    """Text around the first hit with ellipses, else the first ``2 * radius`` characters."""

    def cut(place: Column) -> Column:
        start = F.greatest(place - 1 - radius, F.lit(0))
        end = F.least(F.length(content), place - 1 + len(query) + radius)
        body = T.strip(F.substr(content, start + 1, end - start))
        return F.when(place == 0, T.strip(F.substring(content, 1, radius * 2))).otherwise(
            F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(content), "...").otherwise(""))
        )

    return T.let(F.locate(query.lower(), F.lower(content)), cut)


def scan_snippet(content: Column, query: str) -> Column:
    """Ninety characters before and 130 after the first hit on one line, else the first 220."""

    def one_line(text: Column) -> Column:
        return F.translate(text, "\n", " ")

    def cut(place: Column) -> Column:
        start = F.greatest(place - 91, F.lit(0))
        end = F.least(F.length(content), place - 1 + len(query) + 130)
        body = one_line(F.substr(content, start + 1, end - start))
        return F.when(place == 0, one_line(F.substring(content, 1, 220))).otherwise(
            F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(content), "...").otherwise(""))
        )

    return T.let(F.locate(query.lower(), F.lower(content)), cut)


# ---- upkeep --------------------------------------------------------------------------------


def index_delta(files: DataFrame, library: DataFrame) -> DataFrame:
    """Per path: ``changed`` (new, or another time or size), ``unchanged`` or ``removed``."""
    now = files.filter(searchable(F.col("relative_path"))).select(
        "relative_path", F.col("mtime").alias("n_mtime"), F.col("size").alias("n_size")
    )
    old = library.select("relative_path", F.col("mtime").alias("o_mtime"), F.col("size").alias("o_size"))
    same = (F.col("n_mtime") == F.col("o_mtime")) & (F.col("n_size") == F.col("o_size"))
    change = F.when(F.col("n_mtime").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return now.join(old, "relative_path", "full_outer").select("relative_path", change.alias("change"))


def library_upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Library with changed rows replaced: kept rows by anti join, then the changes."""
    kept = current.join(changes.select("relative_path"), "relative_path", "left_anti")
    return kept.unionByName(changes.dropDuplicates(["relative_path"]))


# ---- listings ------------------------------------------------------------------------------


def file_title(path: Column) -> Column:
    """Title from a file name: a six-digit time prefix goes, dashes become spaces."""
    stem = _stem(path)
    bare = F.when((F.length(stem) > 7) & F.rlike(stem, F.lit(r"^\p{Nd}{6}-")), F.substr(stem, F.lit(8))).otherwise(stem)
    return F.coalesce(T.present(F.replace(bare, F.lit("-"), F.lit(" "))), _name(path))


def list_library(files: DataFrame, favorites: DataFrame, limit: int | None = None) -> DataFrame:
    """Digests, newest first, with totals on every row: all, or ``limit`` of them.

    Equal times are ordered by path. ``favorites`` has ``relative_path``.
    """
    path = F.col("relative_path")
    markdown = files.filter(F.endswith(path, F.lit(".md")))
    totals = markdown.agg(
        F.struct(F.count_if(searchable(path)).alias("listed"), F.count_if(~searchable(path)).alias("skipped")).alias("t")
    )
    marked = favorites.select("relative_path").distinct().withColumn("is_favorite", F.lit(True))
    listed = markdown.filter(searchable(path))
    if limit is not None:
        listed = newest(listed, [F.desc("mtime"), "relative_path"], limit)
    rows = listed.join(marked, "relative_path", "left").orderBy(F.desc("mtime"), "relative_path")
    counted = rows.withColumn("totals", totals.scalar())
    return counted.select(
        file_title(path).alias("title"), F.substring_index(path, "/", 1).alias("date"), path, _source_type(path).alias("source_type"),
        "size", "mtime", F.coalesce("is_favorite", F.lit(False)).alias("is_favorite"),
        F.col("totals.listed").alias("total_candidates"), F.col("totals.skipped").alias("skipped"),
        (F.lit(False) if limit is None else F.col("totals.listed") > max(int(limit), 1)).alias("limited"),
    )


def library_counts(items: DataFrame) -> DataFrame:
    """Counts by source and by date over the listed items, in one pass."""
    grouped = items.groupingSets([[F.col("source_type")], [F.col("date")]], "source_type", "date").agg(F.count("*").alias("n"))
    return grouped.select(
        F.when(F.col("source_type").isNotNull(), "source_type").otherwise("date").alias("by"),
        F.coalesce("source_type", "date").alias("value"), "n",
    ).filter("value <> ''")


def filter_items(items: DataFrame, text: str = "", source_type: str = "") -> DataFrame:
    """Items whose title, path or source holds a text, regardless of case."""
    needle = text.strip().lower()
    hay = F.lower(F.concat_ws(" ", "title", "relative_path", "source_type"))
    found = items.filter(F.contains(hay, F.lit(needle))) if needle else items
    return found.filter(F.col("source_type") == source_type) if source_type else found


# ---- favourites ----------------------------------------------------------------------------


# Parts that the picks of one path are dealt over.
PICK_PARTS = 16


def _pick_path(picks: DataFrame) -> Column:
    """Relative path of a raw pick: decoded, without leading slashes; NULL when it leaves the root."""
    decoded = F.regexp_replace(picks["raw_path"], r"%(?![0-9A-Fa-f]{2})", "%25")
    path = F.ltrim(F.url_decode(F.replace(decoded, F.lit("+"), F.lit("%2B"))), F.lit("/"))
    unsafe = (path == "") | F.startswith(path, F.lit("../")) | F.contains(path, F.lit("/../")) | (F.lower(_suffix(path)) != "md")
    return F.when(~unsafe, path)


def _suffix(path: Column) -> Column:
    return F.regexp_extract(_name(path), r".\.([^.]*)$", 1)


def pick_results(library: DataFrame, favorites: DataFrame, picks: DataFrame) -> DataFrame:
    """Outcome per pick ``(pick_id, raw_path)``: ``added``, ``already_favorited`` or ``not_found``."""
    # A refused pick keeps a key of its own instead of NULL, so that refused picks do not meet in one task.
    own_key = F.concat(F.lit("!"), F.col("pick_id").cast("string"))
    paths = picks.withColumn("relative_path", F.coalesce(_pick_path(picks), own_key))
    # What is known of each picked path is gathered first; the picks then meet it on (path, part), so that a path
    # picked very often is split.
    state = (
        paths.select("relative_path", "pick_id", F.lit(False).alias("known"), F.lit(False).alias("marked"))
        .unionByName(library.select("relative_path", F.lit(None).cast(dict(picks.dtypes)["pick_id"]).alias("pick_id"), F.lit(True).alias("known"), F.lit(False).alias("marked")))
        .unionByName(favorites.select("relative_path", F.lit(None).cast(dict(picks.dtypes)["pick_id"]).alias("pick_id"), F.lit(False).alias("known"), F.lit(True).alias("marked")))
        .groupBy("relative_path")
        .agg(F.min("pick_id").alias("first_pick"), F.bool_or("known").alias("known"), F.bool_or("marked").alias("marked"))
        .filter("first_pick IS NOT NULL AND known")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PICK_PARTS - 1))))
    )
    judged = paths.withColumn("part", F.pmod(F.xxhash64("pick_id"), F.lit(PICK_PARTS)).cast("int")).join(state, ["relative_path", "part"], "left")
    outcome = (
        F.when(F.col("known").isNull(), "not_found")
        .when(F.col("marked") | (F.col("pick_id") > F.col("first_pick")), "already_favorited")
        .otherwise("added")
    )
    path = F.when(~F.startswith("relative_path", F.lit("!")), F.col("relative_path"))
    return judged.select("pick_id", path.alias("relative_path"), outcome.alias("outcome"))


def add_favorites(library: DataFrame, favorites: DataFrame, picks: DataFrame, at: Column) -> DataFrame:
    """Favourites after the picks; adding one twice changes nothing."""
    wanted = picks.select(_pick_path(picks).alias("relative_path")).filter("relative_path IS NOT NULL").distinct()
    fresh = wanted.join(library.select("relative_path"), "relative_path", "left_semi").join(
        favorites.select("relative_path"), "relative_path", "left_anti"
    )
    return favorites.select("relative_path", "favorited_at").unionByName(fresh.withColumn("favorited_at", at))


def remove_favorites(favorites: DataFrame, picks: DataFrame) -> DataFrame:
    gone = picks.select(_pick_path(picks).alias("relative_path")).filter("relative_path IS NOT NULL")
    return favorites.join(gone, "relative_path", "left_anti")


def favorite_target(picks: DataFrame, jobs: DataFrame, library: DataFrame) -> DataFrame:
    """Path each pick ``(pick_id, job_id, output_path, relative_path)`` stands for.

    A given path wins, then the output of the job, then a given output path that is in the library;
    a pick without any of them takes the newest entry.
    """
    output = jobs.select("job_id", F.get_json_object("result_json", "$.output_markdown_path").alias("job_output"))
    newest = library.agg(F.max_by("relative_path", F.struct("mtime", F.col("relative_path"))).alias("p"))
    own_key = F.concat(F.lit("!"), F.col("pick_id").cast("string"))
    asked = picks.withColumnRenamed("relative_path", "given").withColumn("job_id", F.coalesce("job_id", own_key)).join(output, "job_id", "left")
    asked = asked.withColumn("output", F.coalesce(T.present(F.col("job_output")), T.present(F.trim("output_path")), own_key))
    known = library.select(F.col("relative_path").alias("output"), F.lit(True).alias("known"))
    found = asked.join(known, "output", "left").withColumn("newest", newest.scalar())
    return found.select(
        "pick_id",
        F.coalesce(T.present(F.trim("given")), F.when(F.col("known"), F.col("output")), F.col("newest")).alias("relative_path"),
    )


# ---- documents -----------------------------------------------------------------------------


def toc(library: DataFrame, most: int | None = None) -> DataFrame:
    """The headings of each document, or its first ``most``, with anchors that are unique inside it.

    A heading takes its base as anchor, or the base with the lowest free number from 2. That is the base's own
    count, unless another heading already reads like a numbered one; only documents with such a heading walk
    through their headings one by one.
    """
    pattern = rf"^(#{{1,4}}){T.WS}+(.+)$"
    heads = F.filter(F.transform(T.lines(F.col("content")), T.strip), lambda line: F.rlike(line, F.lit(pattern)))
    heads = heads if most is None else F.slice(heads, 1, most)

    def base(title: Column) -> Column:
        dashed = F.btrim(F.regexp_replace(F.lower(title), f"[^{T.WORD}{T.CJK}]+", "-"), F.lit("-"))
        return F.coalesce(T.present(dashed), F.lit("section"))

    titled = F.transform(
        heads,
        lambda line: F.struct(
            F.length(F.regexp_extract(line, pattern, 1)).alias("level"), T.strip(F.regexp_extract(line, pattern, 2)).alias("title")
        ),
    )

    def free(used: Column, stem: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(2), F.size(used) + 2), lambda n: F.concat(stem, F.lit("-"), n.cast("string")))
        return F.concat(used, F.slice(F.filter(F.concat(F.array(stem), numbered), lambda anchor: ~F.array_contains(used, anchor)), 1, 1))

    number = r"-\p{Nd}+$"
    clash = F.exists("bases", lambda stem: F.rlike(stem, F.lit(number)) & F.array_contains("bases", F.regexp_replace(stem, number, "")))
    rows = library.select("relative_path", titled.alias("heads")).withColumn("bases", F.transform("heads", lambda head: base(head["title"])))
    rows = rows.withColumn("walked", F.when(clash, F.aggregate("bases", F.array().cast("array<string>"), free)))
    entries = exploded(rows, ["relative_path", "walked"], F.arrays_zip("heads", "bases"), "entry", "seq")
    nth = F.row_number().over(Window.partitionBy("relative_path", "entry.bases").orderBy("seq"))
    counted = F.when(nth == 1, F.col("entry.bases")).otherwise(F.concat("entry.bases", F.lit("-"), nth.cast("string")))
    anchor = F.coalesce(F.get("walked", F.col("seq")), counted)
    return entries.select("relative_path", "seq", F.col("entry.heads.level").alias("level"), F.col("entry.heads.title").alias("title"), anchor.alias("anchor"))


def output_paths(digests: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Partition and file name of each digest ``(doc_id, title, source_type, written_at)``.

    Digests of one second and slug get the suffixes ``-2``, ``-3`` and so on by ``doc_id``; the numbering does
    not gather a frequent title in one task. With ``stored (doc_id, date, source_dir, file_stem)`` numbers go on
    after the highest stored one, and digests stored at their date and source already are left out.
    """
    named = digests.withColumn("date", F.date_format("written_at", "yyyy-MM-dd")).withColumn(
        "source_dir", T.safe_part(F.coalesce(T.present(F.col("source_type")), F.lit("source")))
    ).withColumn("stem", F.concat(F.date_format("written_at", "HHmmss"), F.lit("-"), T.slug(F.col("title"), 90)))
    place = ["date", "source_dir", "stem"]
    if stored is None:
        numbered = numbered_within(named, place, "doc_id", "copy")
    else:
        fresh = named.join(stored.select("doc_id", "date", "source_dir"), ["doc_id", "date", "source_dir"], "left_anti")
        # A stored name is the first of its own stem, and may be a numbered one of the stem before its suffix.
        number = r"^(.*)-([0-9]{1,9})$"
        own = stored.select("date", "source_dir", F.col("file_stem").alias("stem"), F.lit(1).alias("taken"))
        suffixed = stored.filter(F.rlike("file_stem", F.lit(number))).select(
            "date", "source_dir", F.regexp_extract("file_stem", number, 1).alias("stem"), F.regexp_extract("file_stem", number, 2).cast("int").alias("taken")
        )
        taken = own.unionByName(suffixed).groupBy(*place).agg(F.max("taken").alias("taken"))
        counted = numbered_within(fresh, place, "doc_id", "copy").join(taken, place, "left")
        numbered = counted.withColumn("copy", F.col("copy") + F.coalesce("taken", F.lit(0))).drop("taken")
    suffix = F.when(F.col("copy") > 1, F.concat(F.lit("-"), F.col("copy").cast("string"))).otherwise("")
    return numbered.withColumn("file_stem", F.concat("stem", suffix)).withColumn(
        "relative_path", F.concat_ws("/", "date", "source_dir", F.concat("file_stem", F.lit(".md")))
    ).drop("copy", "stem")


def latest_per_partition(library: DataFrame) -> DataFrame:
    """The most recent digest of each date and source directory. The path is chosen by a small
    aggregate first; content is read for the chosen paths only."""
    path = F.col("relative_path")
    keyed = library.withColumn("date", F.substring_index(path, "/", 1)).withColumn("source_dir", F.get(_parts(path), F.lit(1)))
    chosen = keyed.groupBy("date", "source_dir").agg(F.max_by("relative_path", F.struct("mtime", "relative_path")).alias("relative_path"))
    return library.join(chosen, "relative_path").select("date", "source_dir", "relative_path", "content")
