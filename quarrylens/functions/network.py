"""Addresses and names as Column expressions: IPv4 ranges, second-level labels, entropy, generated-name heuristics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylens.functions.indicators import is_ipv6, let

# Special-purpose IPv4 networks in the order of their test, as (first, last, verdict, score, tags).
IPV4_CLASSES = (
    ("0.0.0.0", 8, "suspicious", 0.8, "bogon,this-network,non-routable"),
    ("192.0.0.0", 24, "suspicious", 0.8, "bogon,ietf-protocol,non-routable"),
    ("192.0.2.0", 24, "suspicious", 0.8, "bogon,test-net-1,non-routable"),
    ("198.51.100.0", 24, "suspicious", 0.8, "bogon,test-net-2,non-routable"),
    ("203.0.113.0", 24, "suspicious", 0.8, "bogon,test-net-3,non-routable"),
    ("198.18.0.0", 15, "suspicious", 0.8, "bogon,benchmarking,non-routable"),
    ("240.0.0.0", 4, "suspicious", 0.8, "bogon,reserved-future,non-routable"),
    ("100.64.0.0", 10, "benign", 0.3, "cgnat,rfc6598"),
    ("127.0.0.0", 8, "benign", 0.3, "loopback"),
    ("169.254.0.0", 16, "benign", 0.3, "link-local"),
    ("10.0.0.0", 8, "benign", 0.3, "private,rfc1918"),
    ("172.16.0.0", 12, "benign", 0.3, "private,rfc1918"),
    ("192.168.0.0", 16, "benign", 0.3, "private,rfc1918"),
    ("224.0.0.0", 4, "benign", 0.3, "multicast"),
)
# Special-purpose IPv6 networks in the order of their test, as (first 16-bit groups, bits, verdict, tags).
IPV6_CLASSES = (
    ((0, 0, 0, 0, 0, 0, 0, 1), 128, "benign", "loopback"),
    ((0xFE80,), 10, "benign", "link-local"),
    ((0xFEC0,), 10, "benign", "site-local"),
    ((0, 0, 0, 0, 0, 0, 0, 0), 128, "benign", "private,ula"),
    ((0, 0, 0, 0, 0, 0xFFFF), 96, "benign", "private,ula"),
    ((0x64, 0xFF9B, 1), 48, "benign", "private,ula"),
    ((0x100, 0, 0, 0), 64, "benign", "private,ula"),
    ((0x2001, 0xDB8), 32, "benign", "private,ula"),
    ((0x2002,), 16, "benign", "private,ula"),
    ((0x2001, 1, 0, 0, 0, 0, 0, 1), 128, "unknown", "public"),
    ((0x2001, 1, 0, 0, 0, 0, 0, 2), 128, "unknown", "public"),
    ((0x2001, 3), 32, "unknown", "public"),
    ((0x2001, 4, 0x112), 48, "unknown", "public"),
    ((0x2001, 0x20), 28, "unknown", "public"),
    ((0x2001, 0x30), 28, "unknown", "public"),
    ((0x2001, 0), 23, "benign", "private,ula"),
    ((0xFC00,), 7, "benign", "private,ula"),
    ((0xFF00,), 8, "benign", "multicast"),
)
#: Reserved where neither 2000::/3 nor any of the above.
IPV6_GLOBAL = (0x2000, 0x3FFF)
COMPOUND_SUFFIXES = (
    "co.uk", "co.jp", "co.kr", "co.in", "co.za", "com.au", "com.br", "com.mx", "com.cn", "com.tw", "com.hk", "com.sg", "com.tr",
    "ac.uk", "gov.uk", "org.uk", "ne.jp", "go.jp",
)


def ip_number(dotted: str) -> int:
    a, b, c, d = map(int, dotted.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def ipv4_to_long(ip: Column) -> Column:
    """The number of a dotted address; null unless it has four parts of at most 255."""
    parts = F.split(ip, r"\.")
    byte = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    fine = ip.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & F.forall(parts, lambda x: x.try_cast("int") <= 255)
    return F.when(fine, byte(0) * (1 << 24) + byte(1) * (1 << 16) + byte(2) * (1 << 8) + byte(3))


def ipv6_groups(ip: Column) -> Column:
    """The eight 16-bit numbers of an address, whose double colon is filled with zeros; null if it is none."""
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")

    def numbers(v: Column) -> Column:
        left, right = groups(F.substring_index(v, "::", 1)), groups(F.when(v.contains("::"), F.substring_index(v, "::", -1)).otherwise(""))
        sides = F.struct(left.alias("left"), right.alias("right"))
        whole = let(sides, lambda x: F.concat(x["left"], F.array_repeat(F.lit("0"), 8 - F.size(x["left"]) - F.size(x["right"])), x["right"]))
        return F.transform(whole, lambda g: F.conv(g, 16, 10).cast("int"))

    def with_hex_tail(v: Column) -> Column:
        tail = lambda n: F.concat(F.regexp_replace(v, r"[0-9.]+$", ""), F.lower(F.hex(F.floor(n / 65536))), F.lit(":"), F.lower(F.hex(n % 65536)))
        return let(ipv4_to_long(F.regexp_extract(v, r":([0-9.]+)$", 1)), lambda n: F.when(n.isNull(), v).otherwise(tail(n)))

    plain = let(F.regexp_replace(ip, "%[^%]+$", ""), with_hex_tail)
    return F.when(is_ipv6(ip), let(plain, numbers))


def classify_ipv6(ip: Column) -> Column:
    """struct<verdict, score, tags string>, as for IPv4; the order of the networks decides."""

    def result(verdict: str, tags: str) -> Column:
        score = {"suspicious": 0.8, "benign": 0.3}.get(verdict, 0.0)
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(score).alias("score"), F.lit(tags).alias("tags"))

    def of(g: Column) -> Column:
        out = F.when(g.isNull(), None)
        for first, bits, verdict, tags in IPV6_CLASSES:
            inside = F.lit(True)
            for i, want in enumerate(first):
                left = min(16, bits - 16 * i)
                if left > 0:
                    mask = (0xFFFF << (16 - left)) & 0xFFFF
                    inside = inside & (F.get(g, F.lit(i)).bitwiseAND(F.lit(mask)) == (want & mask))
            out = out.when(inside, result(verdict, tags))
        return out.when(~F.get(g, F.lit(0)).between(*IPV6_GLOBAL), result("suspicious", "reserved")).otherwise(result("unknown", "public"))

    return let(ipv6_groups(ip), of)


def classify_ipv4(ip: Column) -> Column:
    """struct<verdict, score, tags string>; the first network that holds the address decides. Null for no address."""
    n = ipv4_to_long(ip)
    out = F.when(n.isNull(), None)
    for first, bits, verdict, score, tags in IPV4_CLASSES:
        low = ip_number(first)
        out = out.when(n.between(low, low + (1 << (32 - bits)) - 1), F.struct(F.lit(verdict).alias("verdict"), F.lit(score).alias("score"), F.lit(tags).alias("tags")))
    return out.otherwise(F.struct(F.lit("unknown").alias("verdict"), F.lit(0.0).alias("score"), F.lit("public").alias("tags")))


def second_level_label(name: Column) -> Column:
    """The label left of the public suffix (two labels for compound suffixes); the whole name if there is one label."""
    labels = F.split(F.rtrim(F.lower(name), F.lit(".")), r"\.")
    n = F.size(labels)
    compound = (n >= 3) & F.concat_ws(".", F.get(labels, n - 2), F.get(labels, n - 1)).isin(*COMPOUND_SUFFIXES)
    return F.when(n < 2, F.get(labels, F.lit(0))).when(compound, F.get(labels, n - 3)).otherwise(F.get(labels, n - 2))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text. The text is computed once, and so is each character's share."""

    def of(t: Column) -> Column:
        n = F.length(t)
        chars = F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
        shares = F.transform(chars, lambda c: (n - F.length(F.replace(t, c, F.lit("")))) / n)
        return F.when(n == 0, 0.0).otherwise(-F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p)))

    return let(text, of)


def byte_entropy(content: Column) -> Column:
    """Shannon entropy of bytes in bits a byte; 0 for none. Each byte is a character of Latin-1."""
    return entropy(F.decode(content, "ISO-8859-1"))


def consonant_run(text: Column) -> Column:
    """Length of the longest run of consonants; y is none."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[bcdfghjklmnpqrstvwxz]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def looks_generated(label: Column) -> Column:
    """Whether a label looks like the output of a domain generation algorithm."""

    def odd(x: Column) -> Column:
        h, run, digits = x["h"], x["run"], x["digits"]
        return (h >= 3.8) | ((h >= 3.4) & (run >= 5)) | ((run >= 7) & (h >= 3.0)) | ((digits >= 0.3) & (h >= 3.2))

    def of(s: Column) -> Column:
        digits = F.length(F.regexp_replace(s, "[^0-9]", "")) / F.length(s)
        found = F.struct(entropy(s).alias("h"), consonant_run(s).alias("run"), digits.alias("digits"))
        return (F.length(s) >= 8) & ~s.contains("-") & s.rlike("[A-Za-z]") & let(found, odd)

    return let(label, of)
