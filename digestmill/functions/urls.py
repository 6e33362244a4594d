"""Column functions over URLs and addresses. All native expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions.text import SPACE_CHARS, WS, first_match, let, strip

_SCHEME_PART = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_LOCATION = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH_PART = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY_PART = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"#(.*)$"


def _clean(url: Column) -> Column:
    """What a URL splitter sees: trimmed, without tabs and line breaks inside."""
    return F.translate(strip(F.coalesce(url, F.lit(""))), "\t\r\n", "")


def _scheme(clean: Column) -> Column:
    return F.lower(F.regexp_extract(clean, _SCHEME_PART, 1))


def _netloc(clean: Column) -> Column:
    return F.regexp_extract(clean, _LOCATION, 1)


def _path(clean: Column) -> Column:
    return F.regexp_extract(clean, _PATH_PART, 1)


def _query(clean: Column) -> Column:
    return F.regexp_extract(clean, _QUERY_PART, 1)


def _host(clean: Column) -> Column:
    def from_location(location: Column) -> Column:
        bracketed = F.regexp_extract(location, r"\[([^\]]*)\]", 1)
        return F.lower(F.when(F.contains(location, F.lit("[")), bracketed).otherwise(F.substring_index(location, ":", 1)))

    return let(F.substring_index(_netloc(clean), "@", -1), from_location)


def host(url: Column) -> Column:
    """Lower-cased host without user info, port or IPv6 brackets."""
    return _host(_clean(url))


def query(url: Column) -> Column:
    return _query(_clean(url))


def _decode(part: Column) -> Column:
    """Percent-decoding that leaves malformed escapes alone."""
    return F.url_decode(F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(text: Column) -> Column:
    """ARRAY<STRUCT<key, value>> in original order; empty parts are dropped, blank values kept."""
    parts = F.filter(F.split(text, "&"), lambda part: part != "")
    return F.transform(
        parts,
        lambda part: F.struct(
            _decode(F.substring_index(part, "=", 1)).alias("key"),
            _decode(F.when(F.contains(part, F.lit("=")), F.substr(part, F.locate("=", part) + 1)).otherwise("")).alias("value"),
        ),
    )


def canonical_url(url: Column) -> Column:
    """Trimmed URL without fragment and tracking keys, host lower-cased; NULL when not http(s)."""

    def build(clean: Column) -> Column:
        kept = F.filter(
            query_pairs(_query(clean)),
            lambda pair: ~(pair["key"].isin(*K.TRACKING_PARAMS) | F.startswith(pair["key"], F.lit(K.TRACKING_PREFIX))),
        )
        encoded = F.transform(kept, lambda pair: F.concat(_encode(pair["key"]), F.lit("="), _encode(pair["value"])))
        # Parameters of the last path segment survive; a bare trailing ';' does not.
        location = F.regexp_replace(_path(clean), r"(^|/)([^;/]*);$", "$1$2")
        return F.when(
            _scheme(clean).isin("http", "https") & (_netloc(clean) != ""),
            F.concat(
                _scheme(clean), F.lit("://"), F.lower(_netloc(clean)), location,
                F.coalesce(F.concat(F.lit("?"), F.nullif(F.array_join(encoded, "&"), F.lit(""))), F.lit("")),
            ),
        )

    return let(_clean(url), build)


# ---- addresses -----------------------------------------------------------------------------


def _v4_hex(text: Column) -> Column:
    """Eight hex digits of a dotted quad, NULL when it is not one (leading zeros are refused)."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    parts = F.transform(F.split(text, r"\."), lambda part: F.lpad(F.hex(part.cast("bigint")), 2, "0"))
    return F.when(F.rlike(text, F.lit(rf"^{octet}(?:\.{octet}){{3}}$")), F.array_join(parts, ""))


def _v6_hex(text: Column) -> Column:
    """Thirty-two hex digits of an IPv6 text, NULL when it is not one."""
    empty = F.array().cast("array<string>")

    def split_groups(side: Column) -> Column:
        return F.when(side == "", empty).otherwise(F.split(side, ":"))

    def without_quad(bare: Column) -> Column:
        tail = F.substring_index(bare, ":", -1)
        return let(
            _v4_hex(tail),
            lambda digits: F.when(digits.isNull(), bare).otherwise(
                F.concat(
                    F.substr(bare, F.lit(1), F.length(bare) - F.length(tail)),
                    F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4),
                )
            ),
        )

    def fill(text6: Column) -> Column:
        gap = F.contains(text6, F.lit("::"))
        sides = F.struct(
            split_groups(F.substring_index(text6, "::", 1)).alias("left"),
            F.when(gap, split_groups(F.substring_index(text6, "::", -1))).otherwise(empty).alias("right"),
            gap.alias("gap"),
        )

        def join(parts: Column) -> Column:
            missing = F.lit(8) - F.size(parts["left"]) - F.size(parts["right"])
            filled = F.concat(parts["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), parts["right"])
            fits = F.when(parts["gap"], missing >= 1).otherwise(missing == 0)
            well_formed = F.forall(filled, lambda group: F.rlike(group, F.lit(r"^[0-9A-Fa-f]{1,4}$")))
            return F.when(fits & well_formed, F.array_join(F.transform(filled, lambda group: F.lpad(group, 4, "0")), ""))

        return let(sides, join)

    parsed = let(let(F.substring_index(text, "%", 1), without_quad), fill)
    return F.when(F.contains(text, F.lit(":")) & ~F.rlike(text, F.lit(":::|::.*::")), parsed)


def ip_hex(text: Column) -> Column:
    """Fixed-width upper/lower-free hex of an address: 8 digits for IPv4, 32 for IPv6, else NULL."""
    return F.lower(F.coalesce(_v4_hex(text), _v6_hex(text)))


def bounds(cidr: str) -> tuple[str, str]:
    network = ipaddress.ip_network(cidr)
    width = 8 if network.version == 4 else 32
    return f"{int(network.network_address):0{width}x}", f"{int(network.broadcast_address):0{width}x}"


def ranges(cidrs: tuple[str, ...]) -> Column:
    """Constant ARRAY<STRUCT<lo, hi>> of fixed networks."""
    return F.array(*[F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")) for low, high in map(bounds, cidrs)])


def in_ranges(address: Column, cidrs: tuple[str, ...]) -> Column:
    """Whether a hex address lies in one of a fixed list of networks."""
    return F.exists(ranges(cidrs), lambda net: (F.length(net["lo"]) == F.length(address)) & address.between(net["lo"], net["hi"]))


def _unmapped(address: Column) -> Column:
    """The IPv4 part of an IPv4-mapped address, else the address."""
    mapped = F.startswith(address, F.lit("0" * 20 + "ffff")) & (F.length(address) == 32)
    return F.when(mapped, F.substring(address, 25, 8)).otherwise(address)


def is_global(address: Column) -> Column:
    """Global reachability of a hex address; an IPv4-mapped address is judged by its IPv4 part."""

    def judge(plain: Column) -> Column:
        private = in_ranges(plain, K.PRIVATE_V4 + K.PRIVATE_V6) & ~in_ranges(plain, K.PRIVATE_V4_EXCEPT + K.PRIVATE_V6_EXCEPT)
        return ~private & ~in_ranges(plain, (K.SHARED_V4,))

    return let(_unmapped(address), judge)


def never_reachable(address: Column) -> Column:
    """Loopback, link-local, multicast and unspecified addresses."""
    cidrs = ("127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "0.0.0.0/32", "::1/128", "fe80::/10", "ff00::/8", "::/128")
    return let(_unmapped(address), lambda plain: in_ranges(plain, cidrs))


def url_status(url: Column) -> Column:
    """Why a URL is refused before any name lookup; NULL when it may go on."""

    def judge(clean: Column) -> Column:
        def by_name(name: Column) -> Column:
            private = let(ip_hex(name), lambda address: F.coalesce(~is_global(address), F.lit(False)))
            return first_match(
                [
                    (~_scheme(clean).isin("http", "https"), K.MSG_SCHEME),
                    (_netloc(clean) == "", K.MSG_HOST),
                    ((name == "localhost") | F.endswith(name, F.lit(".localhost")), K.MSG_LOCALHOST),
                    (private, K.MSG_PRIVATE),
                ]
            )

        return let(_host(clean), by_name)

    return let(_clean(url), judge)


# ---- classification ------------------------------------------------------------------------


def _ends(name: Column, *suffixes: str) -> Column:
    found = F.lit(False)
    for suffix in suffixes:
        found = found | F.endswith(name, F.lit(suffix))
    return found


def source_type(url: Column) -> Column:
    return let(
        host(url),
        lambda name: first_match(
            [
                (_ends(name, "mp.weixin.qq.com"), "wechat"),
                (_ends(name, "youtube.com", "youtu.be"), "youtube"),
                (_ends(name, "bilibili.com", "b23.tv"), "bilibili"),
            ],
            F.lit("web"),
        ),
    )


def connector_source(url: Column, title: Column) -> Column:
    """Source of a connector document: STRUCT<source_url, source_type, extraction_method, error_code, error_message>."""

    def parse(raw: Column) -> Column:
        location = _netloc(raw)
        port = F.regexp_extract(F.substring_index(location, "@", -1), r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
        return let(
            F.struct(
                raw.alias("raw"), _scheme(raw).alias("scheme"), _host(raw).alias("host"), port.alias("port"),
                F.when(F.contains(location, F.lit("@")), F.regexp_replace(location, "@[^@]*$", "")).otherwise("").alias("user"),
                port.try_cast("bigint").alias("number"), _path(raw).alias("path"), _query(raw).alias("query"),
                F.regexp_extract(raw, _FRAGMENT, 1).alias("fragment"),
            ),
            build,
        )

    def build(u: Column) -> Column:
        error = first_match(
            [
                (u["raw"] == "", None),
                (
                    (F.length(u["raw"]) > 2048) | F.rlike(u["raw"], F.lit(r"[\x00-\x1f]")) | F.rlike(u["raw"], F.lit(WS)),
                    "The cloud document source URL is invalid.",
                ),
                (
                    (u["scheme"] != "https") | (u["host"] == "") | ~u["user"].isin("", ":"),
                    "Cloud document sources must use a normal HTTPS URL.",
                ),
                (
                    (u["port"] != "") & (~F.rlike(u["port"], F.lit("^[0-9]+$")) | F.coalesce(u["number"] > 65535, F.lit(True))),
                    "The cloud document source URL has an invalid port.",
                ),
            ]
        )

        def part(mark: str, text: Column) -> Column:
            return F.coalesce(F.concat(F.lit(mark), F.nullif(text, F.lit(""))), F.lit(""))

        rebuilt = F.concat(
            F.lit("https://"), u["host"],
            F.when(F.coalesce(u["number"], F.lit(0)) > 0, F.concat(F.lit(":"), u["number"].cast("string"))).otherwise(""),
            F.coalesce(F.nullif(u["path"], F.lit("")), F.lit("/")), part("?", u["query"]), part("#", u["fragment"]),
        )
        feishu = u["host"].isin("feishu.cn", "larksuite.com") | _ends(u["host"], ".feishu.cn", ".larksuite.com")
        return let(error, lambda message: fields(u, message, rebuilt, feishu))

    def fields(u: Column, message: Column, rebuilt: Column, feishu: Column) -> Column:
        local, bad = u["raw"] == "", message.isNotNull()
        kind = F.when(local, "local_file").when(bad, F.lit(None)).when(feishu, "feishu_document").otherwise("cloud_document")
        method = F.when(local, "local_text_upload").when(bad, F.lit(None)).when(feishu, "agent_feishu_connector").otherwise(
            "agent_document_connector"
        )
        return F.struct(
            F.when(local, F.concat(F.lit("local://"), title)).when(~bad, rebuilt).alias("source_url"),
            kind.alias("source_type"), method.alias("extraction_method"),
            F.when(bad, F.lit("invalid_document_source")).alias("error_code"), message.alias("error_message"),
        )

    return let(F.btrim(F.coalesce(url, F.lit("")), F.lit(SPACE_CHARS)), parse)


def bvid(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "/video/(BV[A-Za-z0-9]+)", 1), F.lit(""))


def page_index(url: Column) -> Column:
    """Zero-based page of the ``p`` query key; -1 when it is not a positive number."""
    values = F.filter(query_pairs(query(url)), lambda pair: (pair["key"] == "p") & (pair["value"] != ""))
    number = F.coalesce(F.try_element_at(values, F.lit(1))["value"], F.lit("1"))
    page = F.when(F.rlike(strip(number), F.lit(r"^[+-]?[0-9]+$")), strip(number).try_cast("int"))
    return F.when(page >= 1, page - 1).otherwise(F.lit(-1))


def video_identity(url: Column) -> Column:
    return F.struct(bvid(url).alias("bvid"), page_index(url).alias("page_index"))


def timestamp_link(url: Column, seconds: Column) -> Column:
    joiner = F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(url, joiner, F.lit("t="), F.greatest(seconds, F.lit(0)).cast("string"))
