"""Typed indicators in text as Column expressions: refang, defang, type detection and extraction with spans."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that define each indicator type, and the defanging notations in the order of their use.
WHITE = r"\s\p{Z}\x85\x1c-\x1f"
URL = rf"\b(?:https?|ftps?)://[^{WHITE}<>\"'\[\]{{}}|\\^`]+"
EMAIL = r"\b[a-zA-Z0-9._%+\-]+@(?:[a-zA-Z0-9\-]+\.)+[a-zA-Z]{2,63}\b"
SHA256 = r"\b[a-fA-F0-9]{64}\b"
SHA1 = r"\b[a-fA-F0-9]{40}\b"
MD5 = r"\b[a-fA-F0-9]{32}\b"
CVE = r"\bCVE-\p{Nd}{4}-\p{Nd}{4,7}\b"
BTC_BECH32 = r"\bbc1[a-z0-9]{39,59}\b"
BTC_LEGACY = r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
IPV6 = r"(?:[A-F0-9]{1,4}:){2,7}[A-F0-9]{1,4}|::(?:[A-F0-9]{1,4}:){0,6}[A-F0-9]{1,4}"
DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,63}\b"
STRICT_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
REFANG = (
    ("hxxps://", "https://"),
    ("hxxp://", "http://"),
    ("fxps://", "ftps://"),
    ("fxp://", "ftp://"),
    ("[://]", "://"),
    ("[//]", "//"),
    ("[at]", "@"),
    ("(at)", "@"),
    ("[dot]", "."),
    ("(dot)", "."),
    ("{dot}", "."),
    ("[.]", "."),
    ("(.)", "."),
    ("{.}", "."),
    ("[:]", ":"),
    ("(:)", ":"),
    ("[@]", "@"),
)
DEFANG_SCHEMES = (("https://", "hxxps://"), ("http://", "hxxp://"), ("ftps://", "fxps://"), ("ftp://", "fxp://"))
#: A label of a domain, of a mail's host, and what a last label starts with.
_LABEL, _MAIL_LABEL, _LAST = r"[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.", r"[a-zA-Z0-9\-]+\.", r"[a-zA-Z]{2,63}\b"
LOWER_CASED = ("domain", "email", "url", "md5", "sha1", "sha256")


def _hops(label: str) -> str:
    """Labels as far as the last one before a possible end, without recursion in Java's engine and without steps back.

    A hop passes labels that no end follows and one that an end follows; whether it can be made is decided at each place
    by what follows alone, so giving nothing back loses no match.
    """
    return f"(?:(?:{label}(?!{_LAST}))*+{label}(?={_LAST}))++{_LAST}"


#: The same matches of texts of any length. A place whose own run begins earlier, behind the last match, is no first one:
#: from there the match would have begun, or failed alike.
LONG = {
    EMAIL: rf"(?:\G|(?<!\b[a-zA-Z0-9_]{{1,64}})(?<![a-zA-Z0-9_][.%+\-]{{1,64}}))\b[a-zA-Z0-9._%+\-]++@{_hops(_MAIL_LABEL)}",
    DOMAIN: rf"(?<!\b[a-zA-Z0-9]{{1,63}}\.)\b{_hops(_LABEL)}",
}
#: Characters up to which the plain patterns may recurse, and matches of a token that are placed in one go.
SHORT, BLOCK = 512, 512
HOST = r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)"


def _replace_all(text: Column, old: str, new: str) -> Column:
    return F.regexp_replace(text, "(?i)" + re.sub(r"([\[\](){}.])", r"\\\1", old), new)


def refang(text: Column) -> Column:
    """Undo common defanging notations, whatever their case. Null stays null."""
    for old, new in REFANG:
        text = _replace_all(text, old, new)
    return text


def defang(text: Column) -> Column:
    """Make addresses unclickable: schemes, then dots and at signs."""
    for old, new in DEFANG_SCHEMES:
        text = _replace_all(text, old, new)
    return F.replace(F.replace(text, F.lit("."), F.lit("[.]")), F.lit("@"), F.lit("[@]"))


def url_host(url: Column) -> Column:
    """Lower-case host of an address, without user and port; an empty text if there is none."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def is_ipv6(value: Column) -> Column:
    """Eight groups, or at most seven around one double colon; the last two may be an IPv4 address, a zone may follow."""
    v = F.regexp_replace(F.regexp_replace(value, "%[^%]+$", ""), ":" + STRICT_IPV4.removeprefix("^"), ":0:0")
    groups = r"[A-Fa-f0-9]{1,4}"
    full = v.rlike(f"^(?:{groups}:){{7}}{groups}$")
    short = v.rlike(f"^(?:(?:{groups}:){{0,6}}{groups})?::(?:(?:{groups}:){{0,6}}{groups})?$") & (F.size(F.filter(F.split(v, ":"), lambda g: g != "")) <= 7)
    return full | short


def detect_type(value: Column) -> Column:
    """The indicator type of a whole text, or null. Hashes and CVEs are tested first, domains last."""
    s = F.regexp_replace(value, rf"^[{WHITE}]+|[{WHITE}]+$", "")

    def whole(pattern: str, flags: str = "") -> Column:
        return s.rlike(f"{flags}^(?:{pattern})$")

    inner = lambda p: p.removeprefix(r"\b").removesuffix(r"\b")
    # Of a whole text all labels that end with a dot are passed, so nothing needs to be given back.
    once = lambda p: inner(p).replace(".)+", ".)++")
    return (
        F.when(s == "", None)
        .when(whole(inner(SHA256)), "sha256")
        .when(whole(inner(SHA1)), "sha1")
        .when(whole(inner(MD5)), "md5")
        .when(whole(inner(CVE), "(?i)"), "cve")
        .when(F.lower(s).rlike("^bc1[a-z0-9]{39,59}$") | whole(inner(BTC_LEGACY)), "btc_address")
        .when(whole(rf"(?:https?|ftps?)://[^{WHITE}]+", "(?i)"), "url")
        .when(whole(once(EMAIL)), "email")
        .when(s.rlike(STRICT_IPV4), "ipv4")
        .when(is_ipv6(s), "ipv6")
        .when(whole(once(DOMAIN)), "domain")
    )


def _host_item(host: Column) -> Column:
    """The host as an indicator of its own (type, space, value) if it is a domain or an address, else null."""
    return let(detect_type(host), lambda kind: F.when(kind.isin("domain", "ipv4", "ipv6"), F.concat(kind, F.lit(" "), F.lower(host))))


#: Types in the order of their scans, with pattern, flags and a quick pattern that any text with a match has.
SCANS = (
    ("url", URL, "(?i)", "://"),
    ("email", EMAIL, "", "@[a-zA-Z0-9-]"),
    ("sha256", SHA256, "", "[a-fA-F0-9]{64}"),
    ("sha1", SHA1, "", "[a-fA-F0-9]{40}"),
    ("md5", MD5, "", "[a-fA-F0-9]{32}"),
    ("cve", CVE, "(?i)", r"(?i)cve-\p{Nd}"),
    ("btc_address", BTC_BECH32, "", "bc1[a-z0-9]{39}"),
    ("btc_address", BTC_LEGACY, "", "[13][a-km-zA-HJ-NP-Z1-9]{25}"),
    ("ipv6", IPV6, "(?i)", "[A-Fa-f0-9]:[A-Fa-f0-9]|::[A-Fa-f0-9]"),
    ("ipv4", IPV4, "", "[0-9][.][0-9]"),
    ("domain", DOMAIN, "", "[a-zA-Z0-9][.][a-zA-Z]{2}"),
)
DEFANGED = r"(?i)hxxp|fxp|\[|\(at\)|\(dot\)|\(\.\)|\(:\)|\{"


#: No indicator holds one of these characters, and each of them bounds words, so matches lie between them.
BREAKS = rf"[{WHITE}<>\"'\[\]{{}}|\\^`]+"
#: Only addresses hold these; a colon of another type has a digit of IPv6 or another colon on both sides.
MORE_BREAKS = r"[,;()!?#$&*/=~]+|:(?![A-Fa-f0-9:])|(?<![A-Fa-f0-9:]):(?!:)"
#: A quick pattern that every text with an indicator has.
LIKELY = r"[.:@\-][A-Za-z0-9:/\p{Nd}]|[A-Za-z0-9]{26}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SPAN = "struct<scan:int,begin:int,end:int,hit:string>"


def _pairs(token: Column, pattern: str) -> Column:
    """array<struct<gap, hit>>: the matches in a token, each with the length of what lies between it and the one before."""
    gaps, hits = F.split(token, pattern, -1), F.regexp_extract_all(token, F.lit(pattern), F.lit(0))
    return F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"))), lambda x: x["hit"].isNotNull())


def _spans(pairs: Column, scan: Column) -> Column:
    """array<struct<scan, begin, end, hit>>: positions add up. Very many matches are placed block by block, so that the
    work grows little faster than their number."""
    kinds = [kind for kind, *_ in SCANS]
    none = F.array().cast(f"array<{_SPAN}>")

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        kept = F.when(scan == kinds.index("url"), F.rtrim(x["hit"], F.lit(".,;:)"))).otherwise(x["hit"])
        span = F.struct(scan.alias("scan"), begin.alias("begin"), (begin + F.length(kept)).alias("end"), kept.alias("hit"))
        return F.struct((begin + F.length(x["hit"])).alias("at"), F.concat(a["found"], F.array(span)).alias("found"))

    placed = lambda xs, at: F.aggregate(xs, F.struct(at.alias("at"), none.alias("found")), step, lambda a: a["found"])

    def blocks(xs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(xs, i, BLOCK))
        long = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y["gap"] + F.length(y["hit"]))
        at = lambda sizes, k: F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda a, y: a + y)
        return let(cut, lambda c: let(F.transform(c, long), lambda sizes: F.flatten(F.transform(c, lambda x, k: placed(x, at(sizes, k))))))

    found = blocks(pairs)
    return F.when(scan == kinds.index("ipv6"), F.filter(found, lambda f: is_ipv6(f["hit"]))).otherwise(found)


def places(text: Column, pattern: str) -> Column:
    """array<struct<begin, end, hit>> of the matches in a text, which may be very many."""
    return F.transform(_spans(_pairs(text, pattern), F.lit(-1)), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["hit"].alias("hit")))


def _kept(token: Column) -> Column:
    """The matches of a token in the order of the scans; one that overlaps a match of an earlier scan is left out as a whole."""

    def scan(kind: str, pattern: str, flags: str, guard: str) -> Column:
        found = _pairs(token, flags + pattern)
        if pattern in LONG:
            found = F.when(F.length(token) > SHORT, _pairs(token, LONG[pattern])).otherwise(found)
        return F.when(token.rlike(guard), found)

    overlaps = lambda a, f: F.exists(a, lambda x: (x["begin"] < f["end"]) & (x["end"] > f["begin"]))
    none = F.array().cast(f"array<{_SPAN}>")
    all_pairs = F.transform(F.array(*[scan(*s) for s in SCANS]), lambda xs, n: F.when(xs.isNotNull(), _spans(xs, n)))
    return F.aggregate(all_pairs, none, lambda a, found: F.when(found.isNull(), a).otherwise(F.concat(a, F.filter(found, lambda f: ~overlaps(a, f)))))


def iocs_of(text: Column, do_refang: bool = True, hosts: bool = True) -> Column:
    """array<struct<type, value>>: the distinct indicators of a text in the order of extraction; a null text has none.

    The text is cut where no match can lie, so that positions and overlaps concern one token at a time and the work
    grows with the text. Matches are then ordered by scan and place.
    """
    kinds = F.array(*[F.lit(kind) for kind, *_ in SCANS])
    some = "|".join(f"(?:{guard})" if not guard.startswith("(?i)") else f"(?i:{guard[4:]})" for *_, guard in SCANS)

    def tokens(t: Column) -> Column:
        likely = F.filter(F.split(t, BREAKS), lambda x: x.rlike(LIKELY))
        parts = F.flatten(F.transform(likely, lambda x: F.when(x.contains("://") | ~x.rlike(MORE_BREAKS), F.array(x)).otherwise(F.split(x, MORE_BREAKS))))
        return F.filter(parts, lambda x: x.rlike(some))

    def matches(parts: Column) -> Column:
        each = F.transform(parts, lambda x, i: F.transform(_kept(x), lambda f: F.struct(f["scan"].alias("scan"), i.alias("i"), f["begin"].alias("begin"), f["hit"].alias("hit"))))
        return F.sort_array(F.flatten(each))

    def items(f: Column) -> Column:
        kind, hit = F.get(kinds, f["scan"]), f["hit"]
        value = F.when(kind.isin(*LOWER_CASED), F.lower(hit)).when(kind == "cve", F.upper(hit)).otherwise(hit)
        own = F.concat(kind, F.lit(" "), value)
        if not hosts:
            return F.array(own)
        host = F.when(kind == "url", url_host(hit)).when(kind == "email", F.element_at(F.split(hit, "@"), 2))
        return F.array(own, let(host, _host_item))

    def found(t: Column) -> Column:
        named = F.filter(F.flatten(F.transform(matches(tokens(t)), items)), lambda x: x.isNotNull())
        # Texts are told apart by hash, structures would be compared with each other.
        return F.transform(F.array_distinct(named), lambda x: F.struct(F.substring_index(x, " ", 1).alias("type"), F.substr(x, F.locate(" ", x) + 1).alias("value")))

    none = F.array().cast("array<struct<type:string,value:string>>")
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.when(text.rlike(DEFANGED), refang(text)).otherwise(text) if do_refang else text
    return F.coalesce(let(plain, lambda t: F.when(t.rlike(LIKELY), found(t)).otherwise(none)), none)


def with_iocs(df: DataFrame, text_col: str, out: str = "iocs", do_refang: bool = True, hosts: bool = True) -> DataFrame:
    """``df`` with ``out``, the indicators of its column ``text_col``."""
    return df.select("*", iocs_of(F.col(text_col), do_refang, hosts).alias(out))
