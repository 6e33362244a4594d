"""Choosing a subtitle track or transcript among candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import text as T
from digestmill.functions import times as C
from digestmill.functions.scale import exploded
from digestmill.functions.urls import bvid, page_index
from digestmill.operators import transcripts as R


def _chinese(language: Column) -> Column:
    return F.rlike(language, F.lit("^(?:zh|cmn|yue)"))


def bilibili_rank(lan: Column, lan_doc: Column, ai_type: Column) -> Column:
    """STRUCT<rank, language>: Chinese before others, manual before automatic."""
    language = F.lower(T.first_present(lan, lan_doc, F.lit("")))
    chinese = _chinese(language) | F.contains(language, F.lit("中文"))
    automatic = F.coalesce(ai_type, F.lit(0)) != 0
    rank = F.when(chinese & ~automatic, 0).when(chinese, 1).when(~automatic, 2).otherwise(3)
    return F.struct(rank.alias("rank"), F.coalesce(language, F.lit("")).alias("language"))


def rank_bilibili_tracks(tracks: DataFrame) -> DataFrame:
    """Adds ``place``: order in which the tracks of a video are tried (a video has few tracks)."""
    order = bilibili_rank(F.col("lan"), F.col("lan_doc"), F.col("ai_type"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("order", "id"))
    return tracks.withColumn("order", order).withColumn("place", place).withColumn("rank", F.col("order.rank")).drop("order")


def timing_reason(transcript: Column, duration: Column, require: bool = True) -> Column:
    """Timing reason of one transcript text, ``ok`` when there is nothing against it. All inside the row."""
    stamped = F.filter(F.transform(C.transcript_lines(transcript), T.strip), lambda line: F.rlike(line, F.lit(C.RANGE)))
    times = F.transform(
        stamped,
        lambda line: F.struct(
            C.seconds_of(F.regexp_extract(line, C.RANGE, 1)).alias("a"), C.seconds_of(F.regexp_extract(line, C.RANGE, 2)).alias("b")
        ),
    )
    start = F.struct(F.lit(True).alias("fit"), F.lit(True).alias("ordered"), F.lit(-1.0).alias("previous"), F.lit(0.0).alias("last"), F.lit(0).alias("n"))

    def step(acc: Column, t: Column) -> Column:
        good = (t["a"] >= 0) & (t["b"] > t["a"])
        return F.struct(
            (acc["fit"] & good).alias("fit"), (acc["ordered"] & (~good | (t["a"] >= acc["previous"]))).alias("ordered"),
            F.when(good, t["a"]).otherwise(acc["previous"]).alias("previous"),
            F.when(good, F.greatest(acc["last"], t["b"])).otherwise(acc["last"]).alias("last"), (acc["n"] + 1).alias("n"),
        )

    def reason(acc: Column) -> Column:
        length = F.greatest(F.coalesce(duration, F.lit(0.0)), F.lit(0.0))
        return T.first_match(
            [
                ((acc["n"] == 0) & F.lit(require), "timestamps_missing"), (~acc["fit"], "invalid_timestamp_range"),
                (~acc["ordered"], "timestamps_not_monotonic"),
                ((length > 0) & (acc["last"] > length + R.tolerance(length)), "duration_exceeded"),
                ((length >= 300) & (acc["last"] > 0) & (acc["last"] < F.least(F.lit(180.0), length * 0.15)), "insufficient_coverage"),
            ],
            F.lit("ok"),
        )

    return T.let(F.aggregate(times, start, step), reason)


def _transcript_reason(transcript: Column, duration: Column) -> Column:
    """Why a platform transcript is refused: low value first, then timing; NULL when it is usable."""
    return F.when(low_value(transcript), F.lit("low_value")).otherwise(F.nullif(timing_reason(transcript, duration), F.lit("ok")))


def low_value(transcript: Column) -> Column:
    """The low-value test on one transcript text."""

    def judge(lines: Column) -> Column:
        bare = F.transform(lines, lambda line: F.lower(F.regexp_replace(line, rf"[{T.WS}~,.!?\-[\u2000-\uff5e&&[♪♫～，。！？]]]+", "")))
        music = F.size(F.filter(bare, lambda line: line.isin(*K.MUSIC_WORDS)))
        chars = F.length(F.array_join(lines, ""))
        return (F.size(lines) == 0) | (music * 4 >= F.size(lines) * 3) | (chars - 2 * music < 30)

    return T.let(F.filter(F.transform(C.transcript_lines(transcript), C.bare_line), lambda line: line != ""), judge)


def transcript_usable(transcript: Column, duration: Column) -> Column:
    return (T.present(transcript).isNotNull()) & _transcript_reason(transcript, duration).isNull()


def pick_bilibili_track(videos: DataFrame, tracks: DataFrame, payloads: DataFrame, source: str = "bilibili_wbi_player_v2") -> DataFrame:
    """The track each video ends up with, or why there is none.

    ``videos(doc_id, url, api_bvid, page_durations, duration, player_failed)``,
    ``tracks(doc_id, id, subtitle_url, lan, lan_doc, ai_type)``, ``payloads(subtitle_url, payload)``.
    A payload is missing when it could not be fetched. Verdicts are computed for all tracks at once;
    the first clean one in rank order wins and the verdicts before it are its rejections.
    """
    asked = bvid(F.col("url"))
    page = page_index(F.col("url"))
    identity = T.first_match(
        [
            (asked.isNull(), "subtitle_unavailable"), (F.col("api_bvid").isNull(), "bilibili_view_api_failed"),
            (F.lower("api_bvid") != F.lower(asked), "bilibili_video_identity_mismatch"),
            ((page < 0) | (page >= F.size("page_durations")), "bilibili_page_not_found"),
        ]
    )
    length = F.coalesce(F.nullif(F.get("page_durations", F.greatest(page, F.lit(0))), F.lit(0.0)), "duration", F.lit(0.0))
    checked = videos.select("doc_id", identity.alias("identity"), asked.alias("bvid"), (page + 1).alias("page"), length.alias("length"), "player_failed")

    url = F.when(F.startswith("subtitle_url", F.lit("//")), F.concat(F.lit("https:"), "subtitle_url")).otherwise(F.col("subtitle_url"))
    wanted = tracks.filter("subtitle_url <> ''").withColumn("subtitle_url", url)
    wanted = wanted.withColumn("order", F.struct(bilibili_rank(F.col("lan"), F.col("lan_doc"), F.col("ai_type")).alias("r"), "id"))
    once = wanted.groupBy("doc_id", "subtitle_url").agg(F.min_by(F.struct("id", "lan", "lan_doc", "ai_type"), "order").alias("t"), F.min("order").alias("order"))
    bodies = once.join(payloads, "subtitle_url", "left").join(checked.filter("identity IS NULL").select("doc_id", "length"), "doc_id")
    judged = bodies.withColumn("language", T.first_present(F.col("t.lan_doc"), F.col("t.lan"))).withColumn(
        "verdict", R.payload_verdict(F.col("payload"), F.col("length"))
    ).withColumn("transcript", R.payload_transcript(F.col("payload")))
    reason = T.first_match(
        [
            (F.col("payload").isNull(), "api_failed"), (~F.col("verdict.valid"), F.col("verdict.reason")),
            (F.col("transcript") == "", "low_value"),
        ],
        _transcript_reason(F.col("transcript"), F.col("length")),
    )
    judged = judged.withColumn("reason", reason).withColumn(
        "rejection", F.when(F.col("reason").isNotNull(), F.concat_ws(":", F.lit(source), F.coalesce("language", F.lit("unknown")), "reason"))
    )
    winner = F.min_by(
        F.struct(
            F.col("t.id").alias("subtitle_id"), "language", "transcript", R.payload_vtt(F.col("payload")).alias("subtitle_vtt"),
            F.col("verdict.last_timestamp_seconds").alias("subtitle_end_seconds"), F.col("verdict.duration_ratio").alias("duration_ratio"),
            F.sha2("transcript", 256).alias("content_sha256"),
            F.sha2(F.regexp_replace("subtitle_url", r"[?#].*$", ""), 256).alias("subtitle_url_sha256"),
        ),
        F.when(F.col("reason").isNull(), F.col("order")),
    )
    first_good = F.min(F.when(F.col("reason").isNull(), F.col("order")))
    # Only the short rejection texts of a video's tracks are listed together.
    folded = judged.groupBy("doc_id").agg(
        winner.alias("w"), first_good.alias("won_at"),
        F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("order", "reason", "rejection")))).alias("rejected"),
    )
    before = F.filter("rejected", lambda r: F.col("won_at").isNull() | (r["order"] < F.col("won_at")))
    result = checked.join(folded, "doc_id", "left").withColumn("before", F.coalesce(before, F.filter("rejected", lambda r: F.lit(False))))

    def saw(test) -> Column:
        return F.coalesce(F.exists("before", test), F.lit(False))

    status = T.first_match(
        [
            (F.col("identity").isNotNull(), F.col("identity")), (F.col("won_at").isNotNull(), "bilibili_subtitle"),
            (saw(lambda r: ~r["reason"].isin("api_failed", "low_value")), "bilibili_subtitle_invalid"),
            (saw(lambda r: r["reason"] == "low_value"), "bilibili_subtitle_low_value"),
            (saw(lambda r: r["reason"] == "api_failed"), "bilibili_subtitle_api_failed"),
            (F.col("player_failed"), "bilibili_player_api_failed"),
        ],
        F.lit("subtitle_unavailable"),
    )
    return result.select(
        "doc_id", status.alias("status"), F.coalesce(F.array_join(F.transform("before", lambda r: r["rejection"]), ";"), F.lit("")).alias("rejections"),
        "bvid", "page", "w.*",
    )


def youtube_languages(manual: Column, automatic: Column, language: Column, auto: bool, most: int | None = None) -> Column:
    """Subtitle languages to ask for, best first, all or the first ``most``; ``manual`` and ``automatic`` are caption maps."""

    def keys(captions: Column) -> Column:
        names = F.coalesce(F.map_keys(captions), F.array().cast("array<string>"))
        return F.filter(names, lambda key: (key != "") & (key != "live_chat"))

    available = keys(automatic if auto else manual)
    advertised = F.coalesce(F.size(F.map_keys(manual)) > 0, F.lit(False)) | F.coalesce(F.size(F.map_keys(automatic)) > 0, F.lit(False))
    spoken = F.lower(T.strip(F.coalesce(language, F.lit(""))))
    default = ("en-orig", "en", "zh-Hans", "zh-Hant", "zh") if auto else ("zh-Hans", "zh-Hant", "zh", "en")

    def rank(names: Column) -> Column:
        chinese = F.filter(names, lambda key: _chinese(F.lower(key)))
        original = F.filter(names, lambda key: F.endswith(F.lower(key), F.lit("-orig")))
        same = F.filter(names, lambda key: (spoken != "") & ((F.lower(key) == spoken) | F.startswith(F.lower(key), F.concat(spoken, F.lit("-")))))
        english = F.filter(names, lambda key: F.lower(key).isin("en", "en-orig"))
        groups = (original, same, english, chinese, names) if auto else (chinese, same, english, original, names)
        ordered = F.array_distinct(F.concat(*groups))
        ranked = ordered if most is None else F.slice(ordered, 1, most)
        fallback = F.when(advertised, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(name) for name in default]))
        return F.when(F.size(names) > 0, ranked).otherwise(fallback)

    return T.let(available, rank)


def rank_youtube_languages(videos: DataFrame, auto: bool, most: int | None = None) -> DataFrame:
    """``doc_id, place, language`` from ``doc_id, subtitles, automatic_captions, language``."""
    ranked = youtube_languages(F.col("subtitles"), F.col("automatic_captions"), F.col("language"), auto, most)
    return exploded(videos, ["doc_id"], ranked, "language", "place")


def pick_youtube_track(videos: DataFrame, tracks: DataFrame) -> DataFrame:
    """First usable track per video: manual before automatic, then language order.

    ``tracks(doc_id, auto, language, format, body)`` holds the downloaded files.
    """
    wanted = rank_youtube_languages(videos, auto=False).withColumn("auto", F.lit(False)).unionByName(
        rank_youtube_languages(videos, auto=True).withColumn("auto", F.lit(True))
    )
    srt = F.col("format") == "srt"
    cues = F.when(srt, R.srt_cue_array(F.col("body"))).otherwise(R.vtt_cue_array(F.col("body")))
    line = F.transform("cues", lambda c: F.concat(F.lit("["), c["start"], F.lit("-"), c["end"], F.lit("] "), c["text"]))
    texts = F.transform("cues", lambda c: c["text"])
    # The first place of each distinct text; map_from_entries would refuse repeats.
    kept = F.filter("numbered", lambda n: n["first"])
    candidates = (
        tracks.join(wanted, ["doc_id", "auto", "language"])
        .withColumn("cues", F.filter(cues, lambda c: c["text"] != ""))
        .withColumn("numbered", _first_flags(line, texts))
        .withColumn("transcript", F.array_join(F.transform(kept, lambda n: n["line"]), "\n"))
    )
    # Ranked, not filtered: a filter would be pushed below the parse and repeat it.
    order = F.when((F.col("transcript") != "") & ~low_value(F.col("transcript")), F.struct("auto", "place", "format"))
    source = F.when(F.col("auto"), "youtube_auto_subtitle").otherwise("youtube_manual_subtitle")
    vtt = F.when(srt, R.srt_to_vtt(F.col("body"))).otherwise(T.strip(F.col("body")))
    best = candidates.groupBy("doc_id").agg(
        F.min_by(F.struct(source.alias("status"), "language", "transcript", vtt.alias("subtitle_vtt")), order).alias("b")
    )
    return best.filter("b IS NOT NULL").select("doc_id", "b.*")


def _first_flags(lines: Column, texts: Column) -> Column:
    """Lines with a flag for the first of equal texts: sorting the texts brings equals together."""
    numbered = F.transform(F.arrays_zip(lines.alias("line"), texts.alias("text")), lambda z, i: F.struct(z["text"].alias("text"), i.alias("i"), z["line"].alias("line")))

    def flag(ordered: Column) -> Column:
        flagged = F.transform(
            ordered,
            lambda z, i: F.struct(
                z["i"].alias("i"), z["line"].alias("line"),
                ((i == 0) | (F.get(ordered, F.greatest(i - 1, F.lit(0)))["text"] != z["text"])).alias("first"),
            ),
        )
        return F.array_sort(flagged)

    return T.let(F.array_sort(numbered), flag)


def subtitle_status_fold(attempts: DataFrame) -> DataFrame:
    """Most actionable status per video from ``doc_id, attempt, status``."""
    rank = T.first_match([(F.col("status") == status, F.lit(place)) for place, status in enumerate(K.YOUTUBE_STATUS_ORDER)], F.lit(99))
    best = attempts.filter("status <> ''").groupBy("doc_id").agg(F.min_by("status", F.struct(rank, "attempt")).alias("status"))
    every = attempts.select("doc_id").distinct()
    return every.join(best, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("subtitle_unavailable")))


def combined_status(first: Column, second: Column) -> Column:
    """Subtitle status joined with the transcription status."""
    first, second = F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))
    youtube = F.startswith(first, F.lit("youtube_")) & ~first.isin("youtube_manual_subtitle", "youtube_auto_subtitle")
    return T.first_match(
        [
            (first.isin("manual_subtitle", "auto_subtitle", "bilibili_subtitle"), first),
            (youtube, F.when(second != "", F.concat(first, F.lit(";"), second)).otherwise(first)), (second != "", second),
        ],
        F.coalesce(T.present(first), F.lit("subtitle_unavailable")),
    )


def youtube_failure(log: Column) -> Column:
    """Failure class of a downloader log; empty when it has none."""
    text = F.lower(log)
    return T.first_match(
        [
            (T.contains_any(text, ("po token", "proof of origin")), "youtube_po_token_required"),
            (T.contains_any(text, ("http error 429", "too many requests", "rate limit")), "youtube_rate_limited"),
            (T.contains_any(text, ("sign in to confirm", "login required", "use --cookies")), "youtube_auth_required"),
        ],
        F.lit(""),
    )


def download_failure(source_type: Column, log: Column) -> Column:
    """Error code of a failed media download."""
    text, youtube = F.lower(log), source_type == "youtube"
    status = youtube_failure(log)
    return T.first_match(
        [
            (youtube & (status == "youtube_auth_required"), "need_cookies"), (youtube & (status != ""), status),
            (youtube & T.contains_any(text, ("challenge solving failed", "only images are available")), "youtube_challenge_solver_required"),
            ((source_type == "bilibili") & T.contains_any(text, ("login", "cookie", "账号", "登录")), "need_cookies"),
            (F.contains(text, F.lit("ffmpeg")) & T.contains_any(text, ("not found", "not installed", "unable to obtain")), "dependency_missing"),
        ],
        F.lit("media_download_failed"),
    )


def choose_transcript(videos: DataFrame, platform: DataFrame, site: DataFrame, asr: DataFrame) -> DataFrame:
    """Transcript of each video ``(doc_id, source_type, duration)``.

    Candidates are ``(doc_id, transcript, status, source, language, rejections)`` tables with at most one
    row per video: the platform subtitle, the site's own subtitle (video site only), local speech recognition.
    """

    def side(frame: DataFrame, name: str) -> DataFrame:
        fields = F.struct("transcript", "status", "source", "language", "rejections").alias(name)
        return frame.select("doc_id", fields)

    joined = videos.join(side(platform, "p"), "doc_id", "left").join(side(site, "s"), "doc_id", "left").join(side(asr, "a"), "doc_id", "left")
    duration = F.col("duration")

    def has(name: str) -> Column:
        return F.coalesce(F.col(f"{name}.transcript") != "", F.lit(False))

    shape = joined.withColumn("p_reason", F.when(has("p"), _transcript_reason(F.col("p.transcript"), duration))).withColumn(
        "s_reason", F.when(has("s"), _transcript_reason(F.col("s.transcript"), duration))
    ).withColumn("a_reason", F.when(has("a"), timing_reason(F.col("a.transcript"), duration, require=False)))
    # A low-value text with fit times is refused too; its recorded timing reason then reads "ok".
    p_timing = F.when(has("p"), timing_reason(F.col("p.transcript"), duration))
    p_ok = has("p") & F.col("p_reason").isNull()
    s_on = F.col("source_type") == "bilibili"
    s_ok = s_on & has("s") & F.col("s_reason").isNull()
    a_ok = ~p_ok & ~s_ok & has("a") & (F.col("a_reason") == "ok")
    p_status = T.first_match(
        [(p_ok, F.col("p.status")), (has("p"), F.concat("p.status", F.lit("_invalid")))], F.coalesce("p.status", F.lit("unavailable"))
    )
    site_failed = s_on & ~has("s") & ~F.coalesce("s.status", F.lit("")).isin("", "subtitle_unavailable")
    before_asr = T.first_match(
        [(s_ok, F.lit("bilibili_subtitle")), (p_ok, p_status), (s_on & has("s"), F.lit("bilibili_subtitle_mismatch")), (site_failed, F.col("s.status"))],
        p_status,
    )
    asr_status = F.coalesce(T.present(F.col("a.status")), F.lit("transcription_unavailable"))
    status = T.first_match(
        [(s_ok | p_ok, before_asr), (a_ok, asr_status), (has("a"), F.lit("transcription_invalid"))], combined_status(before_asr, asr_status)
    )
    from_site = s_ok | (~p_ok & s_on & has("s")) | (~p_ok & site_failed)
    rejected = T.first_match(
        [(from_site, F.coalesce("s.rejections", F.lit(""))), (has("p") & ~p_ok, F.concat(F.lit("yt_dlp:"), p_timing))], F.lit("")
    )
    asr_refused = ~p_ok & ~s_ok & has("a") & ~a_ok
    rejections = F.concat_ws(";", T.present(rejected), F.when(asr_refused, F.concat(F.lit("local_asr:"), F.col("a_reason"))))
    origin = F.when(a_ok, "local_asr").when(s_ok | p_ok, "platform_subtitle").otherwise("none")
    label = F.when(a_ok, "本地 ASR 转写").when(s_ok | p_ok, "原始字幕").otherwise("未获取可用字幕或转写")
    method = T.first_match(
        [
            (s_ok, "yt_dlp_metadata_bilibili_subtitle"), (p_ok, "yt_dlp_metadata_platform_subtitle"),
            (a_ok, "yt_dlp_metadata_whisper_transcription"),
        ],
        F.lit("yt_dlp_metadata"),
    )
    chosen = F.when(s_ok, F.col("s")).when(p_ok, F.col("p")).when(a_ok, F.col("a"))
    return shape.select(
        "doc_id", chosen["transcript"].alias("transcript"), status.alias("subtitle_status"), chosen["source"].alias("subtitle_source"),
        chosen["language"].alias("subtitle_language"), rejections.alias("subtitle_rejections"), origin.alias("transcript_origin"),
        label.alias("transcript_origin_label"), method.alias("extraction_method"),
        F.when(chosen.isNull(), F.lit("transcript_unavailable")).alias("error_code"),
    )
