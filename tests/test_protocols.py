"""Protocol expressions on literals."""

import hashlib

from pyspark.sql import functions as F

from quarrylens.functions import protocols as p


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_formats_and_strings(spark):
    data = [b"MZ\x90\x00", b"\x7fELF\x02", b"%PDF-1.7", b"PK\x03\x04abc", b"{\\rtf1", b"\x1f\x8b\x08\x00", b"abc", b"hello world", b"ElfFile\x00"]
    assert column(spark, data, p.file_format, "binary") == ["pe", "elf", "pdf", "zip", "rtf", "archive", "unknown", "unknown", "evtx"]
    assert column(spark, [b"\x00abcdef\xff12345\x00longer text"], p.ascii_strings, "binary") == [["abcdef", "longer text"]]
    assert column(spark, [b"\0" * 257 + b"ustar", b""], p.is_tar, "binary") == [True, False]
    assert column(spark, [10, 1536, 5 << 20, 3 << 30], p.human_size, "long") == ["10 B", "1.5 KiB", "5.0 MiB", "3.0 GiB"]


def test_agents_and_hellos(spark):
    assert column(spark, ["curl/8.0", "Mozilla/4.0", "Firefox", ""], p.bad_agent) == ["curl (uncommon in user traffic)", "Emotet (custom Mozilla string)", None, "Empty UA"]
    ints = lambda *xs: F.array(*[F.lit(x) for x in xs])
    got = one(spark, p.ja3(F.lit(771), ints(0x1A1A, 4865, 4866), ints(0, 0xFAFA, 10), ints(29), ints(0)))
    assert got == hashlib.md5(b"771,4865-4866,0-10,29,0").hexdigest()
    df = spark.createDataFrame([("72a589da586844d7f0818ce684948eea",), ("x",)], "ja3 string")
    assert [r["label"] for r in p.known_bad_ja3(df).collect()] == ["Cobalt Strike (default profile)"]
    assert [one(spark, p.tls_anomaly(F.lit(a), F.lit(b))) for a, b in ((4444, "a"), (443, ""), (443, "a"))] == ["non_standard_port", "no_sni", None]


def test_shares_tickets_and_times(spark):
    assert column(spark, [r"\\h\ADMIN$", r"\\h\c$", r"\\h\IPC$", r"\\h\data"], p.is_admin_share) == [True, True, False, False]
    assert one(spark, p.is_kerberoastable(F.lit(13), F.lit(23), F.lit("MSSQLSvc/x"))) and not one(spark, p.is_kerberoastable(F.lit(13), F.lit(23), F.lit("krbtgt/X")))
    assert one(spark, p.is_asrep_roastable(F.lit(10), F.lit(False))) and one(spark, p.is_rc4_downgrade(F.lit(12), F.array(F.lit(23)))) and not one(spark, p.is_rc4_downgrade(F.lit(12), F.array(F.lit(23), F.lit(18))))
    text = one(spark, p.netntlmv2(F.lit("u"), F.lit("D"), F.lit(b"\x01" * 8), F.lit(b"\x02" * 16 + b"\xff")))
    assert text == "u::D:" + "01" * 8 + ":" + "02" * 16 + ":ff"
    assert column(spark, [132_223_104_000_000_000, 0], p.filetime, "long") == ["2020-01-01T00:00:00Z", "1601-01-01T00:00:00Z"]
    assert column(spark, ["http://a/?>>"], p.url_id) == ["aHR0cDovL2EvPz4-"]


def test_ftp(spark):
    rows = [(1, "a", "b", 5, 21, 6, b"USER joe\r\nPASS x\r\n"), (2, "a", "b", 5, 21, 6, b"USER late\r\n"), (3, "a", "b", 5, 80, 6, b"USER no\r\n")]
    df = spark.createDataFrame(rows, "frame_no int, src_ip string, dst_ip string, src_port int, dst_port int, proto int, payload binary")
    assert sorted((r["verb"], r["value"]) for r in p.ftp_credentials(df).collect()) == [("PASS", "x"), ("USER", "joe")]


def test_base32_from_five_bytes_at_a_time(spark, capsys):
    import base64

    from quarrylens.plans import facts

    texts = ["a", "ab", "abc", "abcd", "abcde", "abcdef", "café €", "x" * 41]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", facts._base32(F.col("t")).alias("b"))
    assert {r["t"]: r["b"] for r in df.collect()} == {t: base64.b32encode(t.encode()).decode().rstrip("=") for t in texts}
    df.explain()
    assert capsys.readouterr().out.count("transform(") == 1
