"""URL operators that need more than one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import urls as U
from digestmill.functions.scale import exploded
from digestmill.functions.text import WS, first_match, let


def summary_quality(value: Column) -> Column:
    """``pro`` for its aliases, else ``fast``."""
    name = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(name.isin("pro", "deep", "strong", "depth"), F.lit("pro")).otherwise(F.lit("fast"))


def route(submissions: DataFrame) -> DataFrame:
    """Source type, extractor and effective quality of each submission."""
    kind = U.source_type(F.col("url"))
    video = F.col("source_type").isin("youtube", "bilibili")
    return (
        submissions.withColumn("source_type", kind)
        .withColumn("extractor", F.when(video, "video").when(F.col("source_type") == "wechat", "wechat").otherwise("web"))
        .withColumn("summary_quality", F.when(video, "pro").otherwise(summary_quality(F.col("summary_quality"))))
    )


def resolve_short_links(urls: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds ``resolved_url``: the URL itself if it names a video, else the one its metadata points at.

    ``metadata`` has one row per ``url`` with ``webpage_url``.
    """
    page = F.col("webpage_url")
    name = U.host(page)
    on_site = (name == "bilibili.com") | F.endswith(name, F.lit(".bilibili.com"))
    number = U.page_index(page)
    target = F.concat(
        F.lit("https://www.bilibili.com/video/"), U.bvid(page),
        F.when(number > 0, F.concat(F.lit("?p="), (number + 1).cast("string"))).otherwise(""),
    )
    return urls.join(metadata, "url", "left").withColumn(
        "resolved_url",
        F.when(U.bvid(F.col("url")).isNotNull(), F.col("url")).when(on_site & (number >= 0), target),
    )


# ---- trusted networks ----------------------------------------------------------------------


_TOO_MANY = "At most {} fake-ip CIDRs are supported."


def _mask_prefix(mask: Column) -> Column:
    """Prefix length of a dotted netmask or hostmask given as hex."""
    bits = F.lpad(F.conv(mask, 16, 2), 32, "0")
    ones = F.length(F.replace(bits, F.lit("0"), F.lit("")))
    return F.when(F.rlike(bits, F.lit("^1*0*$")), ones).when(F.rlike(bits, F.lit("^0+1*$")), 32 - ones)


def _edge(address: Column, prefix: Column, bit: str) -> Column:
    """A hex address with all bits beyond its prefix set to ``bit``."""
    digits = F.transform(F.filter(F.split(address, ""), lambda d: d != ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0"))
    flat = F.concat(F.substr(F.array_join(digits, ""), F.lit(1), prefix), F.repeat(F.lit(bit), F.length(address) * 4 - prefix))
    return let(
        flat,
        lambda bits: F.lower(
            F.array_join(F.transform(F.sequence(F.lit(1), F.length(bits), F.lit(4)), lambda i: F.conv(F.substr(bits, i, F.lit(4)), 2, 16)), "")
        ),
    )


def _network(cidr: Column) -> Column:
    """STRUCT<prefix, lo, hi> of a CIDR text with host bits cleared; NULL fields when malformed."""

    def with_address(address: Column) -> Column:
        size = F.when(F.contains(cidr, F.lit("/")), F.substr(cidr, F.locate("/", cidr) + 1))
        masked = F.when(F.length(address) == 8, let(ip_mask(size), _mask_prefix))
        prefix = (
            F.when(size.isNull(), F.length(address) * 4)
            .when(F.rlike(size, F.lit("^[0-9]{1,3}$")), size.try_cast("int"))
            .otherwise(masked)
        )
        return let(
            F.when(prefix.between(0, F.length(address) * 4), prefix),
            lambda bits: F.struct(bits.alias("prefix"), _edge(address, bits, "0").alias("lo"), _edge(address, bits, "1").alias("hi")),
        )

    def ip_mask(size: Column) -> Column:
        return F.when(F.length(U.ip_hex(size)) == 8, U.ip_hex(size))

    return let(U.ip_hex(F.substring_index(cidr, "/", 1)), with_address)


def address_text(address: Column) -> Column:
    """Canonical text of a hex address; the longest zero run of an IPv6 address becomes ``::``."""

    def groups(width: int, count: int, base: int, joiner: str) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)),
            lambda i: F.lower(F.conv(F.substr(address, i * width + 1, F.lit(width)), 16, base)),
        )
        return F.array_join(parts, joiner)

    def fold(full: Column) -> Column:
        chain = None
        for run in range(8, 1, -1):
            pattern = rf"^((?:.*?:)??)0(?::0){{{run - 1}}}((?::.*)?)$"
            left, right = F.regexp_extract(full, pattern, 1), F.regexp_extract(full, pattern, 2)
            folded = F.concat(F.when(left == "", F.lit(":")).otherwise(left), F.when(right == "", F.lit(":")).otherwise(right))
            found = F.rlike(full, F.lit(pattern))
            chain = F.when(found, folded) if chain is None else chain.when(found, folded)
        return chain.otherwise(full)

    return F.when(F.length(address) == 8, groups(2, 4, 10, ".")).when(F.length(address) == 32, let(groups(4, 8, 16, ":"), fold))


def _holds(lo: Column, hi: Column, cidrs: tuple[str, ...]) -> Column:
    """Whether one of the fixed networks holds both ends of a network."""
    return F.exists(U.ranges(cidrs), lambda net: (F.length(net["lo"]) == F.length(lo)) & (net["lo"] <= lo) & (hi <= net["hi"]))


def _network_global(lo: Column, hi: Column) -> Column:
    """A network is private when one private range holds both of its ends."""
    private = _holds(lo, hi, K.PRIVATE_V4 + K.PRIVATE_V6) & ~_holds(lo, hi, K.PRIVATE_V4_EXCEPT + K.PRIVATE_V6_EXCEPT)
    return ~_holds(lo, hi, (K.SHARED_V4,)) & ~private


def _overlaps(lo: Column, hi: Column, cidrs: tuple[str, ...]) -> Column:
    return F.exists(U.ranges(cidrs), lambda net: (F.length(net["lo"]) == F.length(lo)) & (lo <= net["hi"]) & (hi >= net["lo"]))


def normalize_cidrs(settings: DataFrame, most: int | None = None) -> DataFrame:
    """Trusted-network settings to canonical networks.

    In: ``setting_id, value``. Out: ``setting_id, pos, cidr, lo, hi, error``, one row per network in
    first-seen order, or a single error row for a setting that is refused as a whole: for its first bad network, or
    for more than ``most`` of them where a caller asks for a number. A setting is one text, judged inside its row.
    """

    def judge(raw: Column) -> Column:
        def with_net(net: Column) -> Column:
            text = F.concat(address_text(net["lo"]), F.lit("/"), net["prefix"].cast("string"))
            problem = first_match(
                [
                    (net["lo"].isNull(), F.concat(F.lit("Invalid fake-ip CIDR: "), raw)),
                    (_network_global(net["lo"], net["hi"]), F.concat(F.lit("Fake-ip CIDR must not be globally routable: "), text)),
                    (
                        _overlaps(net["lo"], net["hi"], K.NEVER_TRUSTED_CIDRS),
                        F.concat(F.lit("Fake-ip CIDR overlaps a protected local range: "), text),
                    ),
                ]
            )
            return F.struct(text.alias("cidr"), net["lo"].alias("lo"), net["hi"].alias("hi"), problem.alias("error"))

        return let(_network(raw), with_net)

    def refuse(nets: Column) -> Column:
        errors = F.filter(nets, lambda net: net["error"].isNotNull())
        error = F.try_element_at(errors, F.lit(1))["error"]
        if most is not None:
            error = F.coalesce(error, F.when(F.size(nets) > most, F.lit(_TOO_MANY.format(most))))
        null = F.lit(None).cast("string")
        refused = F.array(F.struct(null.alias("cidr"), null.alias("lo"), null.alias("hi"), error.alias("error")))
        return F.when(error.isNotNull(), refused).otherwise(nets)

    parts = F.filter(F.split(F.col("value"), f"(?:{WS}|,)+"), lambda raw: raw != "")
    rows = exploded(settings, ["setting_id"], let(F.array_distinct(F.transform(parts, judge)), refuse), "net", "pos")
    return rows.select("setting_id", F.when(F.col("net.error").isNull(), F.col("pos")).alias("pos"), "net.cidr", "net.lo", "net.hi", "net.error")


def in_networks(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """``hex``: the distinct hex addresses of ``addresses`` that lie in one of the networks (``cidr``).

    An address is in a network when their leading bits are equal, so each address meets the networks by an equal key of
    (prefix length, leading bits), once for each length that occurs. There are 162 lengths at most, however many
    networks, and nothing is compared with a list.
    """
    nets = networks.select(_network(F.col("cidr")).alias("net")).select("net.prefix", "net.lo").filter("lo IS NOT NULL").distinct()
    distinct = addresses.select("hex").filter("hex IS NOT NULL").distinct()
    lengths = [(row["width"], row["prefix"]) for row in nets.select(F.length("lo").alias("width"), "prefix").distinct().collect()]
    known = F.array(*[F.struct(F.lit(width).alias("width"), F.lit(prefix).alias("prefix")) for width, prefix in sorted(lengths)])
    if not lengths:
        return distinct.filter(F.lit(False))
    fitting = F.transform(F.filter(known, lambda size: size["width"] == F.length("hex")), lambda size: size["prefix"])
    keys = exploded(distinct, ["hex"], F.transform(fitting, lambda prefix: F.struct(prefix.alias("prefix"), _edge(F.col("hex"), prefix, "0").alias("lo"))), "key")
    met = keys.select("hex", F.col("key.prefix").alias("prefix"), F.col("key.lo").alias("lo"))
    return met.join(nets, ["prefix", "lo"], "left_semi").select("hex").distinct()


def host_public_check(resolved: DataFrame, trusted: DataFrame, most: int | None = None) -> DataFrame:
    """Whether every resolved address of a host may be fetched: ``host, ok, addresses, fake_ip, message``.

    ``resolved`` has ``host, address``; ``trusted`` has any number of ``cidr`` rows, or ``most`` where a caller asks for
    a number. A malformed network trusts nothing; an address that is none is refused.
    """
    if most is not None and trusted.limit(most + 1).count() > most:
        raise ValueError(_TOO_MANY.format(most))
    address = F.col("hex")
    # One verdict per distinct address, so a host that repeats an address does not repeat the work.
    distinct = resolved.select("host", "address").distinct().withColumn("hex", U.ip_hex(F.col("address")))
    listed = in_networks(distinct, trusted).select(F.col("hex").alias("_hex"))
    met = distinct.join(listed, F.col("hex") == F.col("_hex"), "left")
    judged = met.withColumn("never", U.never_reachable(address)).withColumn("trusted", F.col("_hex").isNotNull()).withColumn("private", ~U.is_global(address))
    refused_private = ~F.col("never") & ~F.col("trusted") & F.col("private")
    fake = refused_private & U.in_ranges(address, (K.FAKE_IP_CIDR,))
    ok = ~F.col("never") & ~refused_private & address.isNotNull()
    message = F.when(fake, F.concat(F.lit("URL host resolved to "), F.col("address"), F.lit(f", which is in the common Fake-IP range {K.FAKE_IP_CIDR}."))).when(
        ~ok | address.isNull(), F.lit(K.MSG_PRIVATE)
    )
    return judged.withColumn("message", message).groupBy("host").agg(
        F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"),
        F.count("*").alias("addresses"),
        F.count(F.when(fake, 1)).alias("fake_ip"),
        F.min("message").alias("message"),
    )
