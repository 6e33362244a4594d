"""URLs, addresses and trusted networks; the standard library is the judge where it has an answer."""

from __future__ import annotations

import html
import ipaddress
import random
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import text as T
from digestmill.functions import urls as U
from digestmill.operators import urls as O


def column(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, t STRING").select("i", function(F.col("t")).alias("v")).collect()
    return [row["v"] for row in sorted(rows, key=lambda row: row["i"])]


def expected_canonical(url):
    parsed = urlparse((url or "").strip())
    if parsed.scheme not in ("http", "https") or not parsed.netloc:
        return None
    kept = [(k, v) for k, v in parse_qsl(parsed.query, keep_blank_values=True) if k not in K.TRACKING_PARAMS and not k.startswith("utm_")]
    return urlunparse(parsed._replace(fragment="", query=urlencode(kept), netloc=parsed.netloc.lower()))


def test_canonical_url(spark):
    urls = [
        "https://example.com/a?utm_source=x&keep=1#frag", " HTTP://User:Pw@EX.com:80/Path;p=1?b=&a=%E4%BD%A0+x&c=~*é#z", "https://e.com?x",
        "https://e.com", "http:///nohost", "ftp://x/y", "https://e.com/a;", "https://e.com/a;b;", "https://e.com/%zz?q=%zz&r=a%20b",
        "https://e.com/?a=1&&b=2;c", "//x.com/a", "https://[::1]:80/a?utm_x=1&UTM_x=2", "https://e.com/a?", "https://e.com/a#b?c=1", None, "",
    ]
    found = column(spark, urls, U.canonical_url)
    assert found[0] == "https://example.com/a?keep=1"
    assert found == [expected_canonical(url) for url in urls]


def test_entities(spark):
    texts = [
        "a &amp; b", "&lt;p&gt;", "&notit; x", "&copy2024", "&#65;&#x41;&#128;&#0;&#1114112;&#xD800;x&#11;", "&unknown;", "& alone &", "&amp;amp;",
        "&Aacute", "&frac12x", "AT&T", "&nbsp;x&NotEqualTilde;", "&#;", "&#x;", "&#99999999999999999999;", "&eacute;&eacut", "&#64976;", "",
    ]
    assert column(spark, texts, T.unescape_html) == [html.unescape(text) for text in texts]


def test_addresses(spark):
    random.seed(7)
    texts = ["::", "::1", "fe80::1", "ff02::1", "2001:db8::1", "::ffff:8.8.8.8", "64:ff9b:1::5", "192.0.0.9", "192.0.0.8", "100.64.0.1", "224.0.0.1"]
    texts += ["01.2.3.4", "1.2.3", "1.2.3.256", "x", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", "12345::", ""]
    texts += [str(ipaddress.ip_address(random.getrandbits(32))) for _ in range(60)] + [str(ipaddress.ip_address(random.getrandbits(128))) for _ in range(20)]
    found = column(spark, texts, lambda t: T.let(U.ip_hex(t), lambda h: F.struct(h.alias("hex"), U.is_global(h).alias("ok"), O.address_text(h).alias("text"))))
    for text, row in zip(texts, found, strict=True):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            assert row["hex"] is None, text
            continue
        assert int(row["hex"], 16) == int(address) and row["ok"] == address.is_global, text
        assert ipaddress.ip_address(row["text"]) == address


def test_url_status(spark):
    urls = ["ftp://a/b", "https:///x", "http://LOCALHOST/", "http://a.localhost/", "http://198.18.0.30/", "http://[::1]/", "http://224.0.0.1/", "https://example.com/"]
    assert column(spark, urls, U.url_status) == [K.MSG_SCHEME, K.MSG_HOST, K.MSG_LOCALHOST, K.MSG_LOCALHOST, K.MSG_PRIVATE, K.MSG_PRIVATE, None, None]


def test_host_public_check(spark):
    def verdicts(addresses, trusted):
        resolved = spark.createDataFrame([(a, a) for a in addresses], "host STRING, address STRING")
        networks = spark.createDataFrame([(c,) for c in trusted], "cidr STRING")
        return {row["host"]: row for row in O.host_public_check(resolved, networks).collect()}

    plain = verdicts(["198.18.0.30", "198.51.100.20", "10.0.0.5", "127.0.0.1", "169.254.0.1", "8.8.8.8", "ff02::1", "2606:4700::1"], [])
    assert {host for host, row in plain.items() if row["ok"]} == {"8.8.8.8", "2606:4700::1"}
    assert "198.18.0.0/15" in plain["198.18.0.30"]["message"]
    trusted = verdicts(["198.18.0.30", "198.51.100.20", "10.0.0.5"], ["198.18.0.0/15", "198.51.100.0/24"])
    assert {host for host, row in trusted.items() if row["ok"]} == {"198.18.0.30", "198.51.100.20"}


def test_host_with_mixed_addresses_fails(spark):
    resolved = spark.createDataFrame([("h", "8.8.8.8"), ("h", "127.0.0.1")], "host STRING, address STRING")
    networks = spark.createDataFrame([], "cidr STRING")
    assert [row["ok"] for row in O.host_public_check(resolved, networks).collect()] == [False]


def test_normalize_cidrs(spark):
    refused = ["8.8.8.0/24", "127.0.0.0/8", "169.254.0.0/16", "240.0.0.0/4", "::ffff:0:0/96", "ff00::/8", "nonsense", "10.0.0.0/33"]
    settings = [(i, value) for i, value in enumerate(refused)] + [(100, "10.1.2.3/8, 198.18.0.0/15 10.0.0.0/8"), (101, ",".join(f"10.0.{i}.0/24" for i in range(33)))]
    frame = spark.createDataFrame(settings, "setting_id INT, value STRING")
    rows = O.normalize_cidrs(frame, most=K.MAX_TRUSTED_CIDRS).collect()
    by_setting = {}
    for row in rows:
        by_setting.setdefault(row["setting_id"], []).append(row)
    assert all(by_setting[i][0]["error"] and by_setting[i][0]["cidr"] is None for i in range(len(refused)))
    assert [row["cidr"] for row in by_setting[100]] == ["10.0.0.0/8", "198.18.0.0/15"]
    assert by_setting[101][0]["error"] == "At most 32 fake-ip CIDRs are supported."
    assert O.normalize_cidrs(frame).filter("setting_id = 101 AND error IS NULL").count() == 33


def test_any_number_of_networks(spark):
    """Against the standard library, with networks of every length in both families."""
    draw = random.Random(8)
    nets = [ipaddress.ip_network((draw.getrandbits(32), draw.randrange(0, 33)), strict=False) for _ in range(200)]
    nets = [net for net in nets if net.prefixlen > 6] + [ipaddress.ip_network((draw.getrandbits(128), draw.randrange(8, 129)), strict=False) for _ in range(200)]
    addresses = [ipaddress.ip_address(int(net.network_address) + draw.randrange(min(net.num_addresses, 1 << 20))) if net.version == 4 else net[draw.randrange(min(net.num_addresses, 1 << 20))] for net in nets]
    addresses += [ipaddress.ip_address(draw.getrandbits(32)) for _ in range(300)] + [ipaddress.ip_address((1 << 120) + draw.getrandbits(100)) for _ in range(100)]
    frame = spark.createDataFrame([(str(address),) for address in addresses], "address STRING").withColumn("hex", U.ip_hex(F.col("address")))
    networks = spark.createDataFrame([(str(net),) for net in nets] + [("nonsense",), (None,)], "cidr STRING")
    inside = {row["address"] for row in frame.join(O.in_networks(frame, networks), "hex").collect()}
    assert inside == {str(address) for address in addresses if any(address in net for net in nets if net.version == address.version)}
    assert O.in_networks(frame, networks.limit(0)).count() == 0
    with pytest.raises(ValueError, match="At most 32"):
        O.host_public_check(frame.withColumn("host", F.lit("h")), networks, most=32)


def test_connector_source(spark, one):
    def source(url):
        return one(U.connector_source(F.col("u"), F.lit("T")), "u STRING", url)

    assert source("https://example.feishu.cn/wiki/EXAMPLE_DOCUMENT_TOKEN")["source_type"] == "feishu_document"
    assert source("https://example.feishu.cn/wiki/X")["extraction_method"] == "agent_feishu_connector"
    assert source("http://internal.example/document")["error_code"] == "invalid_document_source"
    assert source("")["source_url"] == "local://T"
    assert source("https://Docs.Example.com:443?x#y")["source_url"] == "https://docs.example.com:443/?x#y"
    assert source("https://notfeishu.cn/a")["source_type"] == "cloud_document"


def test_video_identity(spark, one):
    def identity(url):
        row = one(U.video_identity(F.col("u")), "u STRING", url)
        return row["bvid"], row["page_index"]

    assert identity("https://www.bilibili.com/video/BV1xx/?p=3") == ("BV1xx", 2)
    assert identity("https://b23.tv/abc?p=0") == (None, -1)
    assert identity("https://b23.tv/abc?p=x") == (None, -1)
    assert identity("https://b23.tv/abc?p=") == (None, 0)
