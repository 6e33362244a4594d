"""Subtitle, transcript and track queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from digestmill.functions import text as T
from digestmill.functions import times as C
from digestmill.operators import tracks as P
from digestmill.operators import transcripts as R
from digestmill.plans.bindings import spark_sql, view
from digestmill.plans.registry import query

# Whole seconds as [hh:]mm:ss, one leading "00:" dropped.
_CLOCK = "regexp_replace(strftime(to_timestamp({s}) AT TIME ZONE 'UTC', '%H:%M:%S'), '^00:', '')"
_CUE_ROWS = f"""SELECT doc_id, seq, {_CLOCK.format(s='start_s')} AS start, {_CLOCK.format(s='end_s')} AS "end",
    trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM v_cues"""
_FIRST = "SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY seq) AS r FROM ({src}) WHERE text <> '') WHERE r = 1"
# The parser numbers the cues that hold text; lines without words make no cue.
_NUMBERED = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS seq, start, \"end\", text FROM ({_CUE_ROWS}) WHERE text <> '' AND NOT regexp_full_match(text, '[0-9]+')"


@query("cues_from_vtt", _FIRST.format(src=_NUMBERED))
def cues_from_vtt(spark, sf):
    return R.cues_from_vtt(view(spark, sf, "v_vtt")).withColumn("seq", F.col("seq").cast("bigint"))


@query("cues_from_srt", _FIRST.format(src=_NUMBERED))
def cues_from_srt(spark, sf):
    return R.cues_from_srt(view(spark, sf, "v_srt")).withColumn("seq", F.col("seq").cast("bigint"))


_PAY = """SELECT doc_id, duration, unnest([0, 1, 2]) AS k FROM v_payloads"""
_PAY_ROWS = f"""SELECT doc_id, duration, k, CASE k WHEN 0 THEN 0.2 WHEN 1 THEN CASE WHEN doc_id % 6 = 1 THEN 9.5 ELSE 3.0 END ELSE CASE WHEN doc_id % 6 = 3 THEN 1.0 ELSE 20.0 END END AS a,
    CASE k WHEN 0 THEN 2.8 WHEN 1 THEN CASE WHEN doc_id % 6 = 2 THEN 2.0 ELSE 12.5 END ELSE CASE WHEN doc_id % 6 = 4 THEN 4000.0 ELSE 31.5 END END AS b,
    CASE k WHEN 0 THEN 'a' || doc_id WHEN 1 THEN 'second line of the caption body for the document' ELSE 'third line' END AS text
  FROM ({_PAY}) WHERE k < 2 OR doc_id % 6 <> 5"""


@query(
    "cues_from_json",
    f"""SELECT doc_id, CAST(k AS BIGINT) AS seq, {_CLOCK.format(s='floor(a)')} AS start, {_CLOCK.format(s='ceil(b)')} AS "end", text FROM ({_PAY_ROWS})""",
)
def cues_from_json(spark, sf):
    return R.cues_from_json(view(spark, sf, "v_payloads")).withColumn("seq", F.col("seq").cast("bigint"))


@query(
    "cue_clock",
    """SELECT doc_id, CAST(seq AS BIGINT) AS seq, CASE WHEN h > 0 THEN printf('%02d:%02d:%02d', h, m, s) ELSE printf('%02d:%02d', m, s) END AS clock,
         CASE WHEN h > 0 THEN printf('%02d:%02d:%02d', h, m, s) ELSE printf('%02d:%02d', m, s) END AS compact, CAST(t AS BIGINT) AS seconds
       FROM (SELECT doc_id, seq, t, t // 3600 AS h, (t % 3600) // 60 AS m, t % 60 AS s FROM (SELECT doc_id, seq, CAST(start_s AS BIGINT) * 7 AS t FROM v_cues))""",
)
def cue_clock(spark, sf):
    """Clock text, its compact form and its seconds back again."""
    cues = view(spark, sf, "v_cues").withColumn("clock", C.clock_text(F.col("start_s") * 7))
    raw = F.concat(F.lit("  "), F.when(F.length("clock") == 5, F.concat(F.lit("00:"), "clock")).otherwise(F.col("clock")), F.lit(",250 align:start"))
    return cues.select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"), "clock", C.compact_time(raw).alias("compact"),
        C.seconds_of(F.col("clock")).cast("bigint").alias("seconds"),
    )


@query("dedupe_cues", f"""SELECT doc_id, seq, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY seq) AS r FROM v_cues WHERE text <> '') WHERE r = 1""")
def dedupe_cues(spark, sf):
    return R.dedupe_cues(view(spark, sf, "v_cues")).select("doc_id", "seq", "text")


@query(
    "dedupe_turns",
    "SELECT doc_id, text, seq FROM (SELECT conv_id AS doc_id, turn AS seq, text, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS r FROM conversations WHERE text <> '') WHERE r = 1",
)
def dedupe_turns(spark, sf):
    turns = view(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text")
    return R.dedupe_cues(turns)


@query(
    "low_value_transcripts",
    """SELECT doc_id, lines, music_lines, chars, lines = 0 OR music_lines >= 0.75 * lines OR chars - 2 * music_lines < 30 AS low_value
       FROM (SELECT doc_id, count(*) FILTER (WHERE text <> '') AS lines, count(*) FILTER (WHERE lower(regexp_replace(text, '[\\s~,.!?-]+', '', 'g')) = 'music') AS music_lines,
          CAST(sum(length(text)) AS BIGINT) AS chars FROM v_cues GROUP BY doc_id)""",
)
def low_value_transcripts(spark, sf):
    return R.low_value_transcripts(view(spark, sf, "v_cues"))


_TIMING = """WITH c AS (SELECT *, end_s > start_s AND start_s >= 0 AS good FROM v_cues),
  m AS (SELECT doc_id, bool_and(coalesce(start_s >= p, true)) AS monotonic FROM (SELECT doc_id, start_s, lag(start_s) OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM c WHERE good) GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n, bool_and(good) AS fit, coalesce(max(end_s) FILTER (WHERE good), 0) AS last FROM c GROUP BY doc_id),
  j AS (SELECT v.doc_id, v.duration, coalesce(t.n, 0) AS n, coalesce(fit, true) AS fit, coalesce(last, 0) AS last, coalesce(monotonic, true) AS mono
     FROM (SELECT doc_id, duration FROM v_videos UNION ALL SELECT -1 - doc_id, duration FROM v_videos WHERE doc_id % 50 = 0) v LEFT JOIN t ON t.doc_id = v.doc_id LEFT JOIN m ON m.doc_id = v.doc_id)"""


@query(
    "validate_timing",
    _TIMING + """ SELECT doc_id, CASE WHEN n = 0 THEN 'timestamps_missing' WHEN NOT fit THEN 'invalid_timestamp_range' WHEN NOT mono THEN 'timestamps_not_monotonic'
        WHEN duration > 0 AND last > duration + greatest(5, duration * 0.03) THEN 'duration_exceeded'
        WHEN duration >= 300 AND last > 0 AND last < least(180, duration * 0.15) THEN 'insufficient_coverage' ELSE 'ok' END AS reason,
      n AS timestamp_count, mono AS timestamps_monotonic, CASE WHEN n > 0 THEN CAST(last * 1000 AS BIGINT) END AS last_ms FROM j""",
)
def validate_timing(spark, sf):
    videos = view(spark, sf, "v_videos").select("doc_id", "duration")
    empty = videos.filter("doc_id % 50 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "duration")
    verdict = R.validate_timing(view(spark, sf, "v_cues"), videos.unionByName(empty))
    return verdict.select(
        "doc_id", "reason", "timestamp_count", "timestamps_monotonic", F.round(F.col("last_timestamp_seconds") * 1000).cast("bigint").alias("last_ms")
    )


@query(
    "vtt_timing_report",
    f"""WITH f AS ({_FIRST.format(src=_NUMBERED)}), c AS (SELECT f.doc_id, f.seq, v.start_s, v.end_s FROM f JOIN v_cues v ON v.doc_id = f.doc_id AND trim(regexp_replace(v.text, '\\s+', ' ', 'g'), ' ') = f.text
            AND {_CLOCK.format(s='v.start_s')} = f.start),
        m AS (SELECT doc_id, bool_and(coalesce(start_s >= p, true)) AS mono FROM (SELECT doc_id, start_s, lag(start_s) OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM c WHERE end_s > start_s) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n, bool_and(end_s > start_s) AS fit, coalesce(max(end_s) FILTER (WHERE end_s > start_s), 0) AS last FROM c GROUP BY doc_id),
        j AS (SELECT v.duration, coalesce(t.n, 0) AS n, coalesce(fit, true) AS fit, coalesce(last, 0) AS last, coalesce(mono, true) AS mono
              FROM v_videos v LEFT JOIN t ON t.doc_id = v.doc_id LEFT JOIN m ON m.doc_id = v.doc_id)
        SELECT CASE WHEN n = 0 THEN 'timestamps_missing' WHEN NOT fit THEN 'invalid_timestamp_range' WHEN NOT mono THEN 'timestamps_not_monotonic'
            WHEN duration > 0 AND last > duration + greatest(5, duration * 0.03) THEN 'duration_exceeded'
            WHEN duration >= 300 AND last > 0 AND last < least(180, duration * 0.15) THEN 'insufficient_coverage' ELSE 'ok' END AS reason, count(*) AS n FROM j GROUP BY 1""",
)
def vtt_timing_report(spark, sf):
    """Subtitle files parsed, deduplicated and judged, counted by reason."""
    cues = R.cues_from_vtt(view(spark, sf, "v_vtt"))
    numeric = cues.select("doc_id", "seq", C.seconds_of(F.col("start")).alias("start_s"), C.seconds_of(F.col("end")).alias("end_s"), "text")
    return R.validate_timing(numeric, view(spark, sf, "v_videos")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "validate_payload_timing",
    f"""WITH r AS (SELECT *, CASE WHEN b <= a THEN 'invalid_timestamp_range' WHEN a < coalesce(lag(a) OVER (PARTITION BY doc_id ORDER BY k), -1) THEN 'timestamps_not_monotonic' END AS bad FROM ({_PAY_ROWS})),
        f AS (SELECT doc_id, min(k) FILTER (WHERE bad IS NOT NULL) AS stop, arg_min(bad, k) FILTER (WHERE bad IS NOT NULL) AS bad FROM r GROUP BY doc_id),
        s AS (SELECT r.doc_id, any_value(r.duration) AS duration, any_value(f.bad) AS bad, count(*) FILTER (WHERE stop IS NULL OR k < stop) AS n, coalesce(max(b) FILTER (WHERE stop IS NULL OR k < stop), 0) AS last
              FROM r JOIN f ON f.doc_id = r.doc_id GROUP BY r.doc_id)
        SELECT doc_id, CASE WHEN bad IS NOT NULL THEN bad WHEN n = 0 THEN 'timestamps_missing' WHEN duration > 0 AND last > duration + greatest(5, duration * 0.03) THEN 'duration_exceeded'
          WHEN duration >= 300 AND last < least(180, duration * 0.15) THEN 'insufficient_coverage' ELSE 'ok' END AS reason, n AS timestamp_count, CASE WHEN n > 0 THEN CAST(last * 1000 AS BIGINT) END AS last_ms FROM s""",
)
def validate_payload_timing(spark, sf):
    verdict = R.validate_payload_timing(view(spark, sf, "v_payloads"))
    return verdict.select(
        "doc_id", "reason", F.col("timestamp_count").cast("bigint").alias("timestamp_count"),
        F.round(F.col("last_timestamp_seconds") * 1000).cast("bigint").alias("last_ms"),
    )


_QUALITY = """WITH q AS (SELECT doc_id, count(*) AS n, CAST(max(greatest(start_s, end_s)) AS BIGINT) AS last, bool_and(coalesce(start_s >= p, true)) AS mono FROM
    (SELECT *, lag(start_s) OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM v_cues) GROUP BY doc_id)"""


@query(
    "timing_quality",
    _QUALITY + """ SELECT q.doc_id, n AS timestamp_count, mono AS timestamps_monotonic, last AS last_seconds, duration > 0 AND last > duration + greatest(5, duration * 0.03) AS exceeds_duration
        FROM q JOIN v_videos v ON v.doc_id = q.doc_id""",
)
def timing_quality(spark, sf):
    rows = view(spark, sf, "v_transcripts").join(view(spark, sf, "v_videos").select("doc_id", "duration"), "doc_id")
    quality = R.timing_quality(rows)
    return quality.select(
        "doc_id", F.col("timestamp_count").cast("bigint").alias("timestamp_count"), "timestamps_monotonic",
        F.col("last_timestamp_seconds").cast("bigint").alias("last_seconds"), "exceeds_duration",
    )


@query(
    "describe_quality",
    _QUALITY + """, p AS (SELECT doc_id, CAST(sum(length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g'))) AS BIGINT) AS chars FROM v_cues GROUP BY doc_id)
        SELECT q.doc_id, chars AS character_count, CASE WHEN chars = 0 THEN 'none' WHEN NOT mono OR (duration > 0 AND last > duration + greatest(5, duration * 0.03)) THEN 'low'
          WHEN q.doc_id % 3 = 0 THEN 'high' WHEN chars < 80 THEN 'low' WHEN duration > 0 AND last * 2 < duration THEN 'low' ELSE 'medium' END AS confidence
        FROM q JOIN v_videos v ON v.doc_id = q.doc_id JOIN p ON p.doc_id = q.doc_id""",
)
def describe_quality(spark, sf):
    origin = F.when(F.col("doc_id") % 3 == 0, "platform_subtitle").otherwise("local_asr")
    rows = view(spark, sf, "v_transcripts").join(view(spark, sf, "v_videos").select("doc_id", "duration"), "doc_id").withColumn("origin", origin)
    return R.describe_quality(rows).select("doc_id", F.col("character_count").cast("bigint").alias("character_count"), "confidence")


_ASR_NORM = "lower(regexp_replace({t}, '[^A-Za-z0-9]+', '', 'g'))"


@query(
    "evaluate_asr",
    f"""SELECT doc_id, reference_chars, distance, CASE WHEN distance <= 0.15 * n THEN 'good' WHEN distance <= 0.30 * n THEN 'review' ELSE 'poor' END AS grade FROM (
          SELECT doc_id, length(r) AS reference_chars, levenshtein(r, h) AS distance, greatest(length(r), 1) AS n
          FROM (SELECT doc_id, {_ASR_NORM.format(t='reference')} AS r, {_ASR_NORM.format(t="substr(hypothesis, 9)")} AS h FROM v_asr))""",
)
def evaluate_asr(spark, sf):
    pairs = view(spark, sf, "v_asr").withColumn("duration", F.lit(None).cast("double"))
    scored = R.evaluate_asr(pairs)
    return scored.select(
        "doc_id", F.col("reference_chars").cast("bigint").alias("reference_chars"), F.col("distance").cast("bigint").alias("distance"), "grade"
    )


# ---- tracks --------------------------------------------------------------------------------

_LANS = [("zh-CN", "中文（简体）", 0), ("en-US", "English", 0), ("zh-Hans", "中文", 1), ("ja", "日本語", 1), ("", "中文字幕", 0)]
_TRACKS = "SELECT doc_id, k, CASE (doc_id + k) % 5 " + " ".join(f"WHEN {i} THEN '{lan}'" for i, (lan, _, _) in enumerate(_LANS)) + " END AS lan, CASE (doc_id + k) % 5 " + " ".join(
    f"WHEN {i} THEN '{doc}'" for i, (_, doc, _) in enumerate(_LANS)
) + " END AS lan_doc, CASE (doc_id + k) % 5 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS ai_type FROM (SELECT doc_id, 1 AS k FROM documents UNION ALL SELECT doc_id, 2 AS k FROM documents UNION ALL SELECT doc_id, 4 AS k FROM documents) d"


def _tracks(spark, sf):
    rows = spark_sql(spark, sf, _TRACKS)
    doc, k = F.col("doc_id").cast("string"), F.col("k").cast("string")
    return rows.select(
        "doc_id", F.concat(F.lit("t"), k).alias("id"), F.concat(F.lit("//sub.example.com/"), doc, F.lit("/"), k, F.lit(".json?auth="), k).alias("subtitle_url"),
        "lan", "lan_doc", "ai_type", "k",
    )


_TRACK_RANK = """CASE (doc_id + k) % 5 WHEN 0 THEN 0 WHEN 4 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END"""


@query(
    "rank_bilibili_tracks",
    f"""SELECT doc_id, 't' || k AS id, {_TRACK_RANK} AS rank, row_number() OVER (PARTITION BY doc_id ORDER BY {_TRACK_RANK},
          CASE (doc_id + k) % 5 WHEN 0 THEN 'zh-cn' WHEN 1 THEN 'en-us' WHEN 2 THEN 'zh-hans' WHEN 3 THEN 'ja' ELSE '中文字幕' END, k) AS place FROM ({_TRACKS})""",
)
def rank_bilibili_tracks(spark, sf):
    return P.rank_bilibili_tracks(_tracks(spark, sf)).select("doc_id", "id", "rank", F.col("place").cast("bigint").alias("place"))


# Verdict of track k of a document: its payload is the body of document (doc_id + k) % 6, or missing.
_VERDICT = """CASE WHEN doc_id % 4 = 1 AND k = 1 THEN 'api_failed' WHEN (doc_id + k) % 6 = 2 THEN 'invalid_timestamp_range' WHEN (doc_id + k) % 6 = 3 THEN 'timestamps_not_monotonic'
    WHEN (doc_id + k) % 6 = 4 THEN 'duration_exceeded' END"""


@query(
    "pick_bilibili_track",
    f"""WITH v AS (SELECT doc_id, 't' || k AS id, lan_doc, {_VERDICT} AS reason, row_number() OVER (PARTITION BY doc_id ORDER BY {_TRACK_RANK},
            CASE (doc_id + k) % 5 WHEN 0 THEN 'zh-cn' WHEN 1 THEN 'en-us' WHEN 2 THEN 'zh-hans' WHEN 3 THEN 'ja' ELSE '中文字幕' END, k) AS place FROM ({_TRACKS})),
        w AS (SELECT doc_id, min(place) FILTER (WHERE reason IS NULL) AS win FROM v GROUP BY doc_id),
        r AS (SELECT v.doc_id, string_agg('bilibili_wbi_player_v2:' || lan_doc || ':' || reason, ';' ORDER BY place) AS rejections,
            max(CASE reason WHEN 'api_failed' THEN 1 ELSE 2 END) AS worst FROM v JOIN w ON w.doc_id = v.doc_id WHERE win IS NULL OR place < win GROUP BY v.doc_id)
        SELECT w.doc_id, CASE WHEN w.doc_id % 10 = 7 THEN 'bilibili_video_identity_mismatch' WHEN w.doc_id % 10 = 8 THEN 'bilibili_page_not_found' WHEN win IS NOT NULL THEN 'bilibili_subtitle'
            WHEN worst = 2 THEN 'bilibili_subtitle_invalid' ELSE 'bilibili_subtitle_api_failed' END AS status,
          CASE WHEN w.doc_id % 10 IN (7, 8) THEN '' ELSE coalesce(rejections, '') END AS rejections, CASE WHEN w.doc_id % 10 NOT IN (7, 8) THEN v.id END AS subtitle_id
        FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN v ON v.doc_id = w.doc_id AND v.place = w.win""",
)
def pick_bilibili_track(spark, sf):
    doc = F.col("doc_id")
    videos = view(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("https://www.bilibili.com/video/BV"), doc.cast("string"), F.when(doc % 10 == 8, F.lit("?p=2")).otherwise("")).alias("url"),
        F.when(doc % 10 == 7, F.lit("BVother")).otherwise(F.concat(F.lit("bv"), doc.cast("string"))).alias("api_bvid"),
        F.array(F.lit(60.0)).alias("page_durations"), F.lit(0.0).alias("duration"), F.lit(False).alias("player_failed"),
    )
    turn = (doc + F.col("k")) % 6
    number = F.lit("a long enough caption line for the judge")
    body = F.concat(
        F.lit('{"body":[{"from":0.2,"to":2.8,"content":"'), number, F.lit('"},{"from":3.0,"to":'), F.when(turn == 2, F.lit("2.0")).otherwise("12.5"),
        F.lit(',"content":"second"},{"from":'), F.when(turn == 3, F.lit("1.0")).otherwise("20.0"), F.lit(',"to":'),
        F.when(turn == 4, F.lit("4000.0")).otherwise("31.5"), F.lit(',"content":"third"}]}'),
    )
    tracks = _tracks(spark, sf)
    payloads = tracks.filter(~((doc % 4 == 1) & (F.col("k") == 1))).select(F.concat(F.lit("https:"), "subtitle_url").alias("subtitle_url"), body.alias("payload"))
    return P.pick_bilibili_track(videos, tracks.drop("k"), payloads).select("doc_id", "status", "rejections", "subtitle_id")


_CAPTIONS = '{"en":[],"zh-Hant":[],"fr":[],"live_chat":[]}', '{"zh-Hans":[],"en":[],"en-orig":[],"fr":[],"pt-BR":[]}'


def _captions(spark, sf):
    doc = F.col("doc_id")
    schema = "map<string,array<string>>"
    return view(spark, sf, "documents").select(
        "doc_id", F.from_json(F.when(doc % 4 < 2, F.lit(_CAPTIONS[0])), schema).alias("subtitles"),
        F.from_json(F.when(doc % 4 % 2 == 0, F.lit(_CAPTIONS[1])), schema).alias("automatic_captions"),
        T.first_match([(doc % 3 == 0, "en"), (doc % 3 == 1, "pt")], F.lit("FR")).alias("language"),
    )


@query(
    "rank_youtube_languages",
    """SELECT doc_id, auto, array_to_string(langs, ',') AS languages FROM (
         SELECT doc_id, false AS auto, CASE WHEN doc_id % 4 < 2 THEN CASE doc_id % 3 WHEN 2 THEN ['zh-Hant', 'fr', 'en'] ELSE ['zh-Hant', 'en', 'fr'] END
           WHEN doc_id % 4 = 3 THEN ['zh-Hans', 'zh-Hant', 'zh', 'en'] END AS langs FROM documents
         UNION ALL SELECT doc_id, true, CASE WHEN doc_id % 2 = 0 THEN CASE doc_id % 3 WHEN 0 THEN ['en-orig', 'en', 'zh-Hans', 'fr', 'pt-BR'] WHEN 1 THEN ['en-orig', 'pt-BR', 'en', 'zh-Hans', 'fr']
           ELSE ['en-orig', 'fr', 'en', 'zh-Hans', 'pt-BR'] END WHEN doc_id % 4 = 3 THEN ['en-orig', 'en', 'zh-Hans', 'zh-Hant', 'zh'] END FROM documents) WHERE langs IS NOT NULL""",
)
def rank_youtube_languages(spark, sf):
    videos = _captions(spark, sf)
    frames = [
        videos.select("doc_id", F.lit(auto).alias("auto"), P.youtube_languages(F.col("subtitles"), F.col("automatic_captions"), F.col("language"), auto).alias("l"))
        for auto in (False, True)
    ]
    both = frames[0].unionByName(frames[1]).filter("size(l) > 0")
    return both.select("doc_id", "auto", F.array_join("l", ",").alias("languages"))


@query(
    "pick_youtube_track",
    f"""WITH t AS (SELECT doc_id, string_agg('[' || start || '-' || "end" || '] ' || text, chr(10) ORDER BY seq) AS transcript, count(*) AS n, count(*) FILTER (WHERE text = 'music') AS music,
            sum(length(text)) AS chars FROM ({_FIRST.format(src=_NUMBERED)}) GROUP BY doc_id)
        SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'youtube_manual_subtitle' ELSE 'youtube_auto_subtitle' END AS status, 'en' AS language, sha256(transcript) AS hash FROM t
        WHERE music < 0.75 * n AND chars - 2 * music >= 30 AND doc_id % 4 <> 1""",
)
def pick_youtube_track(spark, sf):
    """One VTT file per video in ``en``: manual, automatic, or (every fourth) in a language nobody asked for."""
    doc = F.col("doc_id")
    tracks = view(spark, sf, "v_vtt").select(
        "doc_id", (doc % 4 >= 2).alias("auto"), F.when(doc % 4 == 1, F.lit("xx")).otherwise("en").alias("language"), F.lit("vtt").alias("format"), "body"
    )
    picked = P.pick_youtube_track(_captions(spark, sf), tracks)
    return picked.select("doc_id", "status", "language", F.sha2("transcript", 256).alias("hash"))


_STATUSES = ("no_requested_language_subtitles", "youtube_rate_limited", "", "youtube_auth_required", "odd_status")


@query(
    "subtitle_status_fold",
    """WITH a AS (SELECT user_id AS doc_id, event_id AS attempt, CASE event_id % 5 WHEN 0 THEN 'no_requested_language_subtitles' WHEN 1 THEN 'youtube_rate_limited' WHEN 2 THEN '' WHEN 3 THEN 'youtube_auth_required' ELSE 'odd_status' END AS status
          FROM events)
        SELECT doc_id, coalesce(arg_min(status, (CASE status WHEN 'youtube_auth_required' THEN 0 WHEN 'youtube_rate_limited' THEN 2 WHEN 'no_requested_language_subtitles' THEN 4 ELSE 99 END, attempt))
          FILTER (WHERE status <> ''), 'subtitle_unavailable') AS status FROM a GROUP BY doc_id""",
)
def subtitle_status_fold(spark, sf):
    turn = F.col("event_id") % 5
    attempts = view(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("attempt"), T.first_match([(turn == i, s) for i, s in enumerate(_STATUSES)]).alias("status")
    )
    return P.subtitle_status_fold(attempts)


_LOGS = [
    "ERROR: Sign in to confirm you're not a bot", "WARNING: missing a PO Token", "HTTP Error 429: Too Many Requests", "n challenge solving failed",
    "请先登录账号", "ffmpeg not found. Please install", "something else",
]


@query(
    "failure_category",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'youtube_auth_required' WHEN 1 THEN 'youtube_po_token_required' WHEN 2 THEN 'youtube_rate_limited' ELSE '' END AS subtitle_failure,
         CASE WHEN event_id % 2 = 0 THEN CASE event_id % 7 WHEN 0 THEN 'need_cookies' WHEN 1 THEN 'youtube_po_token_required' WHEN 2 THEN 'youtube_rate_limited' WHEN 3 THEN 'youtube_challenge_solver_required'
            WHEN 5 THEN 'dependency_missing' ELSE 'media_download_failed' END
          ELSE CASE event_id % 7 WHEN 4 THEN 'need_cookies' WHEN 5 THEN 'dependency_missing' ELSE 'media_download_failed' END END AS download_failure FROM events""",
)
def failure_category(spark, sf):
    log = T.first_match([(F.col("event_id") % 7 == i, text) for i, text in enumerate(_LOGS)])
    kind = F.when(F.col("event_id") % 2 == 0, "youtube").otherwise("bilibili")
    return view(spark, sf, "events").select(
        "event_id", P.youtube_failure(log).alias("subtitle_failure"), P.download_failure(kind, log).alias("download_failure")
    )


@query(
    "choose_transcript",
    """WITH u AS (SELECT c.doc_id, bool_and(end_s > start_s) AND bool_and(mono) AS fit, any_value(v.duration) AS duration, max(CASE WHEN end_s > start_s THEN end_s END) AS last,
            count(*) FILTER (WHERE text = 'music') * 4 >= count(*) * 3 OR sum(length(text)) - 2 * count(*) FILTER (WHERE text = 'music') < 30 AS low, any_value(n_lines) AS n
          FROM (SELECT *, coalesce(start_s >= lag(start_s) OVER (PARTITION BY doc_id ORDER BY seq), true) OR end_s <= start_s AS mono FROM v_cues) c JOIN v_videos v ON v.doc_id = c.doc_id GROUP BY c.doc_id),
        j AS (SELECT doc_id, fit AND NOT (duration > 0 AND last > duration + greatest(5, duration * 0.03)) AND NOT (duration >= 300 AND last < least(180, duration * 0.15)) AND NOT low AS usable,
            duration >= 300 AND 30 < least(180, duration * 0.15) OR (duration > 0 AND 30 > duration + greatest(5, duration * 0.03)) AS asr_bad FROM u)
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND usable THEN 'platform_subtitle' WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 AND usable THEN 'platform_subtitle'
            WHEN doc_id % 5 <> 0 AND NOT asr_bad THEN 'local_asr' ELSE 'none' END AS transcript_origin FROM j""",
)
def choose_transcript(spark, sf):
    """Platform text for every third document, a site text for the next, and a short local transcription for most."""
    doc = F.col("doc_id")
    videos = view(spark, sf, "v_videos").select("doc_id", F.when(doc % 2 == 0, "bilibili").otherwise("youtube").alias("source_type"), "duration")
    texts = view(spark, sf, "v_transcripts")

    def side(rows, status):
        return rows.select("doc_id", "transcript", F.lit(status).alias("status"), F.lit("s").alias("source"), F.lit("en").alias("language"), F.lit("").alias("rejections"))

    asr = texts.filter(doc % 5 != 0).withColumn("transcript", F.lit("[00:00-00:30] spoken words"))
    chosen = P.choose_transcript(
        videos, side(texts.filter(doc % 3 == 0), "youtube_manual_subtitle"), side(texts.filter(doc % 3 == 1), "bilibili_subtitle"), side(asr, "transcribed")
    )
    return chosen.select("doc_id", "transcript_origin")


# ---- rendering -----------------------------------------------------------------------------


@query("plain_transcript", "SELECT doc_id, string_agg(text, chr(10) ORDER BY seq) AS plain FROM (SELECT doc_id, seq, trim(text, ' ') AS text FROM v_cues) WHERE text <> '' GROUP BY doc_id")
def plain_transcript(spark, sf):
    return view(spark, sf, "v_transcripts").select("doc_id", R.plain_transcript(F.col("transcript")).alias("plain"))


@query(
    "srt_to_vtt",
    """SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) || trim(regexp_replace(replace(regexp_replace(body, '(?m)^[ \\t]*[0-9]+[ \\t]*$', '', 'g'), ',', '.'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) || chr(10) AS vtt FROM v_srt""",
)
def srt_to_vtt(spark, sf):
    return view(spark, sf, "v_srt").select("doc_id", R.srt_to_vtt(F.col("body")).alias("vtt"))


@query(
    "payload_vtt",
    f"""SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(printf('%02d:%02d:%06.3f --> %02d:%02d:%06.3f', CAST(floor(a / 3600) AS BIGINT), CAST(floor((a % 3600) / 60) AS BIGINT), CAST(a % 60 AS DOUBLE),
          CAST(floor(b / 3600) AS BIGINT), CAST(floor((b % 3600) / 60) AS BIGINT), CAST(b % 60 AS DOUBLE)) || chr(10) || text, chr(10) || chr(10) ORDER BY k) || chr(10) AS vtt FROM ({_PAY_ROWS}) GROUP BY doc_id""",
)
def payload_vtt(spark, sf):
    return view(spark, sf, "v_payloads").select("doc_id", R.payload_vtt(F.col("payload")).alias("vtt"))


@query(
    "full_timeline",
    """SELECT v.doc_id, '# Timeline' || chr(10) || chr(10) || string_agg('- [' || strftime(to_timestamp(start_s) AT TIME ZONE 'UTC', '%H:%M:%S') || '](' || url || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 't=' || CAST(start_s AS BIGINT) || ') ' ||
          trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), chr(10) ORDER BY seq) AS timeline FROM v_cues c JOIN v_videos v ON v.doc_id = c.doc_id WHERE trim(text, ' ') <> '' GROUP BY v.doc_id""",
)
def full_timeline(spark, sf):
    rows = view(spark, sf, "v_transcripts").join(view(spark, sf, "v_videos").select("doc_id", "url"), "doc_id")
    return rows.select("doc_id", R.full_timeline(F.col("url"), F.col("transcript")).alias("timeline"))
