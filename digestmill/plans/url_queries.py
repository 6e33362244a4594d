"""URL and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import text as T
from digestmill.functions import urls as U
from digestmill.operators import urls as O
from digestmill.plans.bindings import view
from digestmill.plans.registry import query

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_SOURCE = f"""CASE WHEN {_HOST} LIKE '%mp.weixin.qq.com' THEN 'wechat'
    WHEN {_HOST} LIKE '%youtube.com' OR {_HOST} LIKE '%youtu.be' THEN 'youtube'
    WHEN {_HOST} LIKE '%bilibili.com' OR {_HOST} LIKE '%b23.tv' THEN 'bilibili' ELSE 'web' END"""
_CANON = f"""CASE WHEN url LIKE 'http%' THEN
    regexp_extract(url, '^([a-z]+://)', 1) || {_HOST} || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) ||
    coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
      lambda q: q <> '' AND NOT starts_with(q, 'utm_') AND string_split(q, '=')[1] NOT IN ('fbclid', 'gclid', 'igshid', 'spm', 'vd_source')), '&'), ''), '') END"""


@query("canonical_url", f"SELECT event_id, {_CANON} AS canonical_url FROM v_submissions")
def canonical_url(spark, sf):
    return view(spark, sf, "v_submissions").select("event_id", U.canonical_url(F.col("url")).alias("canonical_url"))


@query("page_canonical_url", f"SELECT page_id, {_CANON} AS canonical_url, {_SOURCE} AS source_type FROM pages")
def page_canonical_url(spark, sf):
    pages = view(spark, sf, "pages")
    return pages.select(
        "page_id", U.canonical_url(F.col("url")).alias("canonical_url"), U.source_type(F.col("url")).alias("source_type")
    )


@query(
    "url_status",
    f"""SELECT event_id, CASE WHEN url NOT LIKE 'http%' THEN '{K.MSG_SCHEME}' WHEN url LIKE 'http://10.%' THEN '{K.MSG_PRIVATE}' END AS reason
        FROM v_submissions""",
)
def url_status(spark, sf):
    return view(spark, sf, "v_submissions").select("event_id", U.url_status(F.col("url")).alias("reason"))


@query("source_type_counts", f"SELECT {_SOURCE} AS source_type, count(*) AS n FROM v_submissions GROUP BY 1")
def source_type_counts(spark, sf):
    subs = view(spark, sf, "v_submissions")
    return subs.groupBy(U.source_type(F.col("url")).alias("source_type")).agg(F.count("*").alias("n"))


# Trusted networks far beyond a hand-written list: 101 of IPv4 and 50 of IPv6.
_TRUSTED = [f"198.51.{part}.0/24" for part in range(101)] + [f"fd00:{part:x}::/32" for part in range(50)]
_V6 = """SELECT 'six-' || doc_id % 400 AS host, CASE doc_id % 3 WHEN 0 THEN 'fd00:' || lower(to_hex(doc_id % 200)) || '::1' WHEN 1 THEN '2606:4700::' || lower(to_hex(doc_id % 60000 + 1))
      ELSE 'FE80::' || lower(to_hex(doc_id % 60000 + 1)) END AS address, doc_id % 3 = 2 AS never, doc_id % 3 = 0 AND doc_id % 200 < 50 AS trusted, doc_id % 3 <> 1 AS private FROM documents"""


@query(
    "host_public_check",
    f"""WITH cidr(lo, hi, kind) AS (VALUES
          (0, 16777215, 'private'), (167772160, 184549375, 'private'), (2130706432, 2147483647, 'never'), (2851995648, 2852061183, 'never'),
          (2886729728, 2887778303, 'private'), (3323068416, 3323199487, 'private'), (3325256704, 3325256959, 'private'),
          (1681915904, 1686110207, 'private'), (3325231104, 3325256959, 'trusted')),
        num AS (SELECT host, address, list_reduce(list_transform(string_split(address, '.'), lambda o: CAST(o AS BIGINT)), lambda a, b: a * 256 + b) AS n FROM v_addresses),
        verdict AS (SELECT n.host, n.address, coalesce(bool_or(kind = 'never'), false) AS never, coalesce(bool_or(kind = 'trusted'), false) AS trusted,
            coalesce(bool_or(kind = 'private'), false) AS private
          FROM num n LEFT JOIN cidr c ON n.n BETWEEN c.lo AND c.hi GROUP BY n.host, n.address UNION ALL SELECT DISTINCT * FROM ({_V6})),
        judged AS (SELECT *, NOT never AND NOT trusted AND private AND (address LIKE '198.18.%' OR address LIKE '198.19.%') AS fake, NOT never AND (trusted OR NOT private) AS fine FROM verdict)
        SELECT host, bool_and(fine) AS ok, count(*) AS addresses, count(*) FILTER (WHERE fake) AS fake_ip,
          min(CASE WHEN fake THEN 'URL host resolved to ' || address || ', which is in the common Fake-IP range {K.FAKE_IP_CIDR}.' WHEN NOT fine THEN '{K.MSG_PRIVATE}' END) AS message
        FROM judged GROUP BY host""",
)
def host_public_check(spark, sf):
    doc = F.col("doc_id")
    six = view(spark, sf, "documents").select(
        F.concat(F.lit("six-"), (doc % 400).cast("string")).alias("host"),
        F.when(doc % 3 == 0, F.concat(F.lit("fd00:"), F.lower(F.hex(doc % 200)), F.lit("::1")))
        .when(doc % 3 == 1, F.concat(F.lit("2606:4700::"), F.lower(F.hex(doc % 60000 + 1))))
        .otherwise(F.concat(F.lit("FE80::"), F.lower(F.hex(doc % 60000 + 1)))).alias("address"),
    )
    trusted = spark.createDataFrame([(cidr,) for cidr in _TRUSTED], "cidr STRING")
    return O.host_public_check(view(spark, sf, "v_addresses").select("host", "address").unionByName(six), trusted)


_V4_NET = "((167772160 + (doc_id % 256) * 65536 + (doc_id // 256 % 256) * 256 + 7) >> (24 - doc_id % 17)) << (24 - doc_id % 17)"


@query(
    "normalize_cidrs",
    f"""WITH s AS (SELECT doc_id, {_V4_NET} AS net, 8 + doc_id % 17 AS p, lower(to_hex(doc_id % 65535 + 1)) AS h FROM documents),
        t AS (SELECT *, (net >> 24) || '.' || ((net >> 16) & 255) || '.' || ((net >> 8) & 255) || '.' || (net & 255) || '/' || p AS cidr4,
            CASE WHEN doc_id % 5 = 0 THEN 'Invalid fake-ip CIDR: nonsense-' || doc_id WHEN doc_id % 7 = 0 THEN 'Fake-ip CIDR must not be globally routable: 8.8.' || doc_id % 256 || '.0/24'
                 WHEN doc_id % 11 = 0 THEN 'Fake-ip CIDR overlaps a protected local range: fe80::/64' END AS error FROM s)
        SELECT doc_id AS setting_id, CAST(NULL AS BIGINT) AS pos, NULL AS cidr, NULL AS lo, NULL AS hi, error FROM t WHERE error IS NOT NULL
        UNION ALL SELECT doc_id, 0, cidr4, lower(lpad(to_hex(net), 8, '0')), lower(lpad(to_hex(net + (1 << (32 - p)) - 1), 8, '0')), NULL FROM t WHERE error IS NULL
        UNION ALL SELECT doc_id, 1, 'fd00:' || h || '::/48', 'fd00' || lpad(h, 4, '0') || repeat('0', 24), 'fd00' || lpad(h, 4, '0') || '0000' || repeat('f', 20), NULL FROM t WHERE error IS NULL""",
)
def normalize_cidrs(spark, sf):
    """Networks of both families with host bits, repeated ones, and settings refused for one bad network."""
    doc = F.col("doc_id")

    def text(value):
        return value.cast("string")

    v4 = F.concat(F.lit("10."), text(doc % 256), F.lit("."), text(F.floor(doc / 256) % 256), F.lit(".7/"), text(8 + doc % 17))
    v6 = F.concat(F.lit("FD00:"), F.hex(doc % 65535 + 1), F.lit("::5/48"))
    bad = (
        F.when(doc % 5 == 0, F.concat(F.lit("nonsense-"), text(doc))).when(doc % 7 == 0, F.concat(F.lit("8.8."), text(doc % 256), F.lit(".0/24")))
        .when(doc % 11 == 0, F.lit("fe80::1/64")).otherwise("")
    )
    settings = view(spark, sf, "documents").select(doc.alias("setting_id"), F.concat(v4, F.lit(", "), v6, F.lit("\n"), v4, F.lit(" "), bad).alias("value"))
    return O.normalize_cidrs(settings).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "connector_source",
    """WITH raw AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'http://internal.example/doc' WHEN 2 THEN 'https://Team.Feishu.cn/wiki/T' || event_id
          WHEN 3 THEN 'https://u:p@example.com/d' WHEN 4 THEN 'https://example.com:8443/d?x=1#f' WHEN 5 THEN 'https://example.com:99999/d' WHEN 6 THEN 'https://docs.larksuite.com'
          WHEN 7 THEN 'https://example.com/a b' ELSE 'https://Docs.Example.com/d/' || event_id END AS raw FROM events)
        SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'local://T' || event_id WHEN 2 THEN 'https://team.feishu.cn/wiki/T' || event_id WHEN 4 THEN raw
            WHEN 6 THEN 'https://docs.larksuite.com/' WHEN 8 THEN 'https://docs.example.com/d/' || event_id END AS source_url,
          CASE event_id % 9 WHEN 0 THEN 'local_file' WHEN 2 THEN 'feishu_document' WHEN 6 THEN 'feishu_document' WHEN 4 THEN 'cloud_document' WHEN 8 THEN 'cloud_document' END AS source_type,
          CASE WHEN event_id % 9 IN (1, 3, 5, 7) THEN 'invalid_document_source' END AS error_code FROM raw""",
)
def connector_source(spark, sf):
    event = F.col("event_id")
    rest = event % 9
    raw = T.first_match(
        [
            (rest == 0, ""), (rest == 1, "http://internal.example/doc"),
            (rest == 2, F.concat(F.lit("https://Team.Feishu.cn/wiki/T"), event.cast("string"))),
            (rest == 3, "https://u:p@example.com/d"), (rest == 4, "https://example.com:8443/d?x=1#f"),
            (rest == 5, "https://example.com:99999/d"), (rest == 6, "https://docs.larksuite.com"), (rest == 7, "https://example.com/a b"),
        ],
        F.concat(F.lit("https://Docs.Example.com/d/"), event.cast("string")),
    )
    source = U.connector_source(raw, F.concat(F.lit("T"), event.cast("string")))
    frame = view(spark, sf, "events").select("event_id", source.alias("s"))
    return frame.select("event_id", "s.source_url", "s.source_type", "s.error_code")


@query(
    "video_identity",
    """SELECT event_id, nullif(regexp_extract(url, '/video/(BV[A-Za-z0-9]+)', 1), '') AS bvid,
         CASE WHEN event_id % 8 = 4 THEN CAST(event_id % 3 AS BIGINT) - 1 ELSE 0 END AS page_index FROM v_submissions""",
)
def video_identity(spark, sf):
    found = view(spark, sf, "v_submissions").select("event_id", U.video_identity(F.col("url")).alias("v"))
    return found.select("event_id", "v.bvid", F.col("v.page_index").cast("bigint").alias("page_index"))


@query(
    "resolve_short_links",
    """SELECT event_id, CASE WHEN url LIKE '%/video/BV%' THEN url WHEN m % 3 = 2 THEN NULL
          WHEN m % 3 = 1 THEN 'https://www.bilibili.com/video/BVm' || m
          WHEN m % 4 = 0 THEN NULL WHEN m % 4 = 1 THEN 'https://www.bilibili.com/video/BV' || m
          ELSE 'https://www.bilibili.com/video/BV' || m || '?p=' || (m % 4) END AS resolved_url
        FROM (SELECT event_id, url, min(event_id) OVER (PARTITION BY url) AS m FROM v_submissions)""",
)
def resolve_short_links(spark, sf):
    """Every submitted address has metadata whose page is named after the first job that asked for it."""
    subs = view(spark, sf, "v_submissions").select("event_id", "url")
    first = F.col("first")
    metadata = subs.groupBy("url").agg(F.min("event_id").alias("first")).select(
        "url",
        T.first_match(
            [
                (first % 3 == 0, F.concat(F.lit("https://www.bilibili.com/video/BV"), first.cast("string"), F.lit("/?p="), (first % 4).cast("string"))),
                (first % 3 == 1, F.concat(F.lit("https://m.bilibili.com/video/BVm"), first.cast("string"))),
            ],
            F.concat(F.lit("https://evil.example/video/BV"), first.cast("string")),
        ).alias("webpage_url"),
    )
    return O.resolve_short_links(subs, metadata).select("event_id", "resolved_url")


_PART = "lower(trim(regexp_replace({t}, '[^A-Za-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '-', 'g'), '-'))"
_TITLE = "text"


@query(
    "slug_names",
    f"""SELECT doc_id, rtrim(substr({_PART.format(t=_TITLE)}, 1, 90), '-') AS slug,
          'Inbox/Links/2026-07-14-' || rtrim(substr({_PART.format(t=_TITLE)}, 1, 80), '-') || '.md' AS note_path,
          trim(regexp_replace({_TITLE}, '[^\\p{{L}}\\p{{N}}_.-]+', '-', 'g'), '.-') || '.md' AS download_name FROM documents""",
)
def slug_names(spark, sf):
    title = F.col("text")
    return view(spark, sf, "documents").select(
        "doc_id", T.slug(title).alias("slug"), T.note_path(title, F.lit("2026-07-14").cast("date")).alias("note_path"),
        T.download_name(title).alias("download_name"),
    )


@query(
    "route_submissions",
    f"""SELECT extractor, summary_quality, count(*) AS n FROM (SELECT
          CASE {_SOURCE} WHEN 'wechat' THEN 'wechat' WHEN 'youtube' THEN 'video' WHEN 'bilibili' THEN 'video' ELSE 'web' END AS extractor,
          CASE WHEN {_SOURCE} IN ('youtube', 'bilibili') OR lower(summary_quality) IN ('pro', 'deep') THEN 'pro' ELSE 'fast' END AS summary_quality
        FROM v_submissions) GROUP BY ALL""",
)
def route_submissions(spark, sf):
    routed = O.route(view(spark, sf, "v_submissions"))
    return routed.groupBy("extractor", "summary_quality").agg(F.count("*").alias("n"))


@query(
    "truncate_text",
    """SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE regexp_replace(substr(text, 1, 600), ' [^ ]*$', '') END AS by_space,
         CASE WHEN length(text) <= 600 THEN text ELSE regexp_replace(substr(text, 1, 600), '\\n[^\\n]*$', '') END AS by_line FROM documents""",
)
def truncate_text(spark, sf):
    text = F.col("text")
    return view(spark, sf, "documents").select(
        "doc_id", T.truncate_text(text, 600, " ").alias("by_space"), T.truncate_text(text, 600, "\n").alias("by_line")
    )


@query(
    "head_tail",
    f"""SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 250) || '{K.OMISSION_MARKER}' || right(text, 250) END AS cut FROM documents""",
)
def head_tail(spark, sf):
    return view(spark, sf, "documents").select("doc_id", T.head_tail(F.col("text"), 500, K.OMISSION_MARKER).alias("cut"))
