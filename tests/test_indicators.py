"""Indicator extraction, detection, defanging and decoding on small texts."""

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import decoders, indicators, network


def found(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return [(x["type"], x["value"]) for x in indicators.with_iocs(df, "t").first()["iocs"]]


CASES = [
    (None, []),
    ("", []),
    ("blocked 9.9.9.9, then 172.16.5.4; skipped 300.1.2.3 and 1.2.3.256", [("ipv4", "9.9.9.9"), ("ipv4", "172.16.5.4")]),
    ("landing page hxxps://shop[.]test-site[.]org/cart?id=7", [("url", "https://shop.test-site.org/cart?id=7"), ("domain", "shop.test-site.org")]),
    ("reply to Sales@Shop.example.net!", [("email", "sales@shop.example.net"), ("domain", "shop.example.net")]),
    ("fixed cve-2019-0708 (CVE-2019-0708)", [("cve", "CVE-2019-0708")]),
    ("Shop.example.net; shop.EXAMPLE.net", [("domain", "shop.example.net")]),
    ("9.8.7.6.rev.example.net", [("ipv4", "9.8.7.6")]),
    ("0cc175b9c0f1b6a831c399e269772661", [("md5", "0cc175b9c0f1b6a831c399e269772661")]),
    ("at 2001:db8:0:0:0:0:0:7 now", [("ipv6", "2001:db8:0:0:0:0:0:7")]),
    ("(see http://a.b.example.org/x).", [("url", "http://a.b.example.org/x"), ("domain", "a.b.example.org")]),
    ("é9.9.9.9 and 9.9.9.9é but |9.9.9.9|", [("ipv4", "9.9.9.9")]),
    ("a.example.net,b.example.net http://c.example.net/,d.example.net", [("url", "http://c.example.net/,d.example.net"), ("domain", "c.example.net"), ("domain", "a.example.net"), ("domain", "b.example.net")]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_extraction(spark, text, expected):
    assert found(spark, text) == expected


def column(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_detect_type(spark):
    values = ["1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8::", "9.9.9.9", "01.2.3.4", "::1", "2001:db8::1", "shop.org", "a@b.co", "https://x.y/z", "CVE-2021-1234", "a" * 64, "b" * 40, "c" * 32, "1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "no indicator", "", None]
    expected = ["ipv6", "ipv6", None, "ipv4", None, "ipv6", "ipv6", "domain", "email", "url", "cve", "sha256", "sha1", "md5", "btc_address", None, None, None]
    assert column(spark, values, indicators.detect_type) == expected


def test_defang_and_back(spark):
    values = ["https://shop.org/path", "me@shop.org", "1.2.3.4", None]
    assert column(spark, values, indicators.defang) == ["hxxps://shop[.]org/path", "me[@]shop[.]org", "1[.]2[.]3[.]4", None]
    assert column(spark, values, lambda c: indicators.refang(indicators.defang(c))) == values


def test_decoders_give_null_for_garbage(spark):
    assert column(spark, ["aGVsbG8", "aGVsbG8=", "@@@@"], decoders.base64) == ["hello", "hello", None]
    assert column(spark, ["68:65-6c 6c6f", "abc", "zz"], decoders.hex_text) == ["hello", None, None]
    assert column(spark, ["a%20b+c", "plain", "50%zz"], decoders.url_text) == ["a b c", None, "50%zz"]
    assert column(spark, ["Uryyb", "123"], decoders.rot13) == ["Hello", None]


def test_names_and_networks(spark):
    assert column(spark, ["a.b.co.uk", "www.example.com", "localhost"], network.second_level_label) == ["b", "example", "localhost"]
    assert column(spark, ["aab", ""], lambda c: F.round(network.entropy(c), 4)) == [0.9183, 0.0]
    assert column(spark, ["10.1.2.3", "8.8.8.8", "192.0.2.9", "no"], lambda c: network.classify_ipv4(c)["tags"]) == ["private,rfc1918", "public", "bogon,test-net-1,non-routable", None]


def test_decoders_over_arrow_batches(spark):
    import base64
    import gzip
    import zlib

    packed = base64.b64encode(gzip.compress(b"hello")).decode()
    assert column(spark, ["NBSWY3DP", "nbswy3dp====", "1!"], decoders.base32) == ["hello", "hello", None]
    assert column(spark, ["&lt;a&gt;", "plain", None], decoders.html) == ["<a>", None, None]
    assert column(spark, [packed, "garbage", base64.b64encode(zlib.compress(b"x")).decode()], decoders.gzip) == ["hello", None, None]
    assert column(spark, [base64.b64encode(zlib.compress(b"hello")).decode(), packed], decoders.zlib) == ["hello", None]
    with pytest.raises(ValueError):
        decoders.decode("rot14", F.lit("x"))


def test_extraction_grows_with_the_text(spark):
    import time

    def seconds(n):
        began = time.perf_counter()
        assert len(found(spark, ",".join(f"10.{i // 250}.{i % 250}.7" for i in range(n)))) == n
        return time.perf_counter() - began

    seconds(10)
    few = min(seconds(10) for _ in range(2))
    assert seconds(4000) - few < 1.5


def test_ipv6_classes_agree_with_the_standard_library(spark):
    import ipaddress

    values = ["::1", "::", "fe80::1", "fec0::1", "fd00::1", "2001:db8::1", "2001:3::1", "2001:2::1", "2001:20::9", "2001:1::1", "2001:1::9", "2002::1", "ff02::1", "4000::", "2606:4700::1", "64:ff9b:1::1", "64:ff9b::1", "100::1", "::ffff:8.8.8.8", "2001:4:112::1", "1::"]

    def tag(a):
        order = (("is_loopback", "loopback"), ("is_link_local", "link-local"), ("is_site_local", "site-local"), ("is_private", "private,ula"), ("is_multicast", "multicast"), ("is_unspecified", "unspecified"), ("is_reserved", "reserved"))
        return next((t for p, t in order if getattr(ipaddress.IPv6Address(a), p)), "public")

    plain = [v for v in values if not v.startswith("::ffff")]
    assert column(spark, plain, lambda c: network.classify_ipv6(c)["tags"]) == [tag(v) for v in plain]
    assert column(spark, ["999.1.1.1", "1.2.3", "1.2.3.4.5", "8.8.8.8"], network.ipv4_to_long) == [None, None, None, 0x08080808]


def test_equal_rows_keep_their_own_decodings(spark):
    from quarrylens.operators import extract

    df = spark.createDataFrame([("aGVsbG8gMS4yLjMuNA==", {"k": "v"})] * 2, "t string, m map<string,string>")
    best = extract.rank_decodings(df, "t").where("rank = 1").collect()
    assert len(best) == 2 and {(r["operation"], r["ioc_count"]) for r in best} == {("base64", 1)}


def test_inflated_output_is_never_cut(spark):
    import base64
    import zlib

    packed = base64.b64encode(zlib.compress(b"a" * 100_000)).decode()
    assert column(spark, [packed], lambda c: F.length(decoders.zlib(c))) == [100_000]
    assert column(spark, [packed], decoders.inflate(1000)) == [None]


def test_a_label_is_computed_once(spark, capsys):
    from pyspark.sql import functions as F

    from quarrylens.functions import network

    df = spark.range(3).selectExpr("CAST(id AS string) AS s")
    df.select(F.md5("s").alias("label")).where(network.looks_generated(F.col("label"))).explain()
    assert capsys.readouterr().out.count("md5(") <= 2
    texts = ["", "aab", "x9f2k7q1z5", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(network.entropy(F.col("t")).alias("h"), network.looks_generated(F.col("t")).alias("g")).collect()
    assert rows[0]["h"] == 0 and abs(rows[1]["h"] - 0.9182958340544896) < 1e-12 and rows[3]["h"] is None
    assert [r["g"] for r in rows] == [False, False, True, None]
