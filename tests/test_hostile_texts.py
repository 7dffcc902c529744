"""Extraction against plain loops on non-ASCII and hostile texts; no text may end an executor."""

import re
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import indicators as i

SPACES = "        　\u0085\x1c\x1f\t\x0b"


def in_python(pattern: str) -> str:
    return pattern.replace(i.WHITE, r"\s").replace(r"\p{Nd}", r"\d")


def host_type(host):
    if re.fullmatch(i.STRICT_IPV4[1:-1], host):
        return "ipv4"
    return "domain" if re.fullmatch(i.DOMAIN, host) else None


def plain(text):
    """One scan after the other over the whole text; a match that touches a taken place is none."""
    taken, out = bytearray(len(text)), []
    for kind, pattern, flags, _ in i.SCANS:
        if kind == "ipv6":
            continue  # the texts below hold none
        for m in re.finditer(in_python(pattern), text, re.I if flags else 0):
            if any(taken[m.start() : m.end()]):
                continue
            hit = m[0].rstrip(".,;:)") if kind == "url" else m[0]
            taken[m.start() : m.start() + len(hit)] = b"\x01" * len(hit)
            out.append((kind, hit.lower() if kind in i.LOWER_CASED else hit.upper() if kind == "cve" else hit))
            host = (urlparse(hit).hostname or "") if kind == "url" else hit.split("@")[1] if kind == "email" else ""
            if host and host_type(host):
                out.append((host_type(host), host.lower()))
    return list(dict.fromkeys(out))


def found(spark, texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    rows = df.select("n", i.iocs_of(F.col("t"), do_refang=False).alias("x")).orderBy("n").collect()
    return [[tuple(x) for x in r["x"]] for r in rows]


def test_unicode_spaces_end_addresses(spark):
    texts = [f"see http://a.com/x{s}y and{s}me@b.org{s}10.1.2.3{s}CVE-2024-1234{s}" for s in SPACES]
    want = [("url", "http://a.com/x"), ("domain", "a.com"), ("email", "me@b.org"), ("domain", "b.org"), ("cve", "CVE-2024-1234"), ("ipv4", "10.1.2.3")]
    assert all(x == want for x in found(spark, texts))
    kinds = spark.createDataFrame([(f"{s}http://a.com/{t}b{s}",) for s in SPACES for t in ("", s)], "t string").select(i.detect_type(F.col("t")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["url", None] * len(SPACES)


def test_random_texts_match_plain_loops(spark):
    import random

    r = random.Random(8)
    atoms = ["a", "com", "x1", "b-", "-", ".", ".", ".", "@", "@", ":", "://", "http", "1", "10.2.3.4", "_", "é", " ", " ", "%", "+", "/", ",", "d41d8cd98f00b204e9800998ecf8427e", "cve-2021-", "44444", "org", "b" * 64, "١"]
    texts = ["".join(r.choice(atoms) for _ in range(r.choice((3, 8, 20, 400)))) for _ in range(600)]
    texts = [re.sub("[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*", "", re.sub(":(?!/)", "", t)) for t in texts]
    for text, got in zip(texts, found(spark, texts), strict=True):
        assert got == plain(text), text


def test_both_ways_agree_on_any_length(spark, monkeypatch):
    """The patterns for long tokens give the plain ones' matches; so do blocks of matches."""
    import random

    r = random.Random(3)
    atoms = ["a.", "bc.", "com", "x1.", "-", ".", "@", "_", "é", "b-c.", "org", "+", "%", "9.", "zz" * 32]
    texts = ["".join(r.choice(atoms) for _ in range(r.choice((2, 6, 15, 60)))) for _ in range(800)]
    before = found(spark, texts)
    monkeypatch.setattr(i, "SHORT", 0)
    monkeypatch.setattr(i, "BLOCK", 2)
    assert found(spark, texts) == before == [plain(t) for t in texts]


HOSTILE = {
    "labels": "a." * 100_000 + "com",
    "labels without end": "b.com:" + "a." * 100_000 + "1",
    "long labels": ("x" * 63 + ".") * 15_000 + "com",
    "mails": "a." * 100_000 + "@" + "b." * 100_000 + "com",
    "many mails": "x@a.com:" * 20_000,
    "ats": "@" * 300_000,
    "ats and letters": "a@" * 150_000,
    "mail without host": "a." * 100_000 + "@-.b@c.com",
    "address": "http://a.com/" + "x" * 1_000_000,
    "colons": "1:" * 150_000,
    "double colons": "::" * 150_000,
    "hexadecimal digits": "a" * 1_000_000,
    "digits": "1." * 150_000,
    "addresses": "1.2.3.4:" * 40_000,
    "hyphens": "a" + "-" * 300_000 + "a.com",
    "percent": "a%" * 150_000 + "@a.com",
    "spaces": "a.com " * 50_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_no_text_ends_an_executor(spark, name):
    text = HOSTILE[name]
    began = time.perf_counter()
    got = found(spark, [text])[0]
    assert time.perf_counter() - began < 40
    df = spark.createDataFrame([(text,), ("x@" + text,)], "t string").select(i.detect_type(F.col("t")).alias("k"))
    assert all(r["k"] in (None, "domain", "email", "url") for r in df.collect())
    if name == "labels":
        assert got == [("domain", text)]
    if name == "mails":
        assert got[0] == ("email", text) and got[1] == ("domain", "b." * 100_000 + "com")
    if name in ("addresses", "spaces"):
        assert len(got) == 1
