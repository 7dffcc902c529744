"""Protocol facts as Column expressions: file formats, fingerprints of TLS hellos, tickets, shares, user agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.indicators import places

# Magic bytes in the order of their test, agents, fingerprints, ports and encryption types.
FORMATS = (
    ("evtx", "456C6646696C6500"),
    ("pe", "4D5A"),
    ("elf", "7F454C46"),
    ("pdf", "255044462D"),
    ("ole", "D0CF11E0A1B11AE1"),
    ("zip", "504B0304"),
    ("zip", "504B0506"),
    ("zip", "504B0708"),
    ("rtf", "7B5C7274"),
    ("pcap", "D4C3B2A1"),
    ("pcap", "A1B2C3D4"),
    ("pcap", "4D3CB2A1"),
    ("pcap", "A1B23C4D"),
    ("pcap", "0A0D0D0A"),
    ("archive", "1F8B"),
    ("archive", "425A68"),
    ("archive", "FD377A585A00"),
    ("macho", "CEFAEDFE"),
    ("macho", "CFFAEDFE"),
    ("macho", "FEEDFACE"),
    ("macho", "FEEDFACF"),
    ("macho_fat", "CAFEBABE"),
    ("macho_fat", "BEBAFECA"),
    ("macho_fat", "CAFEBABF"),
    ("macho_fat", "BFBAFECA"),
)
BAD_AGENTS = (
    ("Emotet (custom Mozilla string)", r"^Mozilla/4\.0$"),
    ("Sliver default", r"^Sliver/|grpc-go/"),
    ("PowerShell client", r"Mozilla/5\.0 \(Windows NT.*WindowsPowerShell"),
    ("BITSAdmin (LOLBin download)", r"^Microsoft BITS/"),
    ("WinHTTP raw", r"^Mozilla/4\.0 \(compatible; MSIE.*Windows NT"),
    ("curl (uncommon in user traffic)", r"^curl/"),
    ("Python urllib", r"^Python-urllib/"),
    ("Empty UA", r"^$"),
)
BAD_JA3 = {
    "72a589da586844d7f0818ce684948eea": "Cobalt Strike (default profile)",
    "a0e9f5d64349fb13191bc781f81f42e1": "Metasploit / Meterpreter reverse_https",
    "b386946a5a44d1ddcc843bc75336dfce": "Metasploit (Java Meterpreter)",
    "06d47c8d6f2b1f0b6e6a5f2b8e2c9a1e": "Trickbot (reported)",
    "e7d705a3286e19ea42f587b344ee6865": "Emotet (reported)",
}
BAD_JA3S = {
    "623de93db17d313345d7ea481e7443cf": "Cobalt Strike teamserver (default)",
    "ec74a5c51106f0419184d0dd08fb05bc": "Metasploit handler (reported)",
}
SMB2_COMMANDS = {
    0: "NEGOTIATE", 1: "SESSION_SETUP", 2: "LOGOFF", 3: "TREE_CONNECT", 4: "TREE_DISCONNECT", 5: "CREATE", 6: "CLOSE", 7: "FLUSH", 8: "READ",
    9: "WRITE", 10: "LOCK", 11: "IOCTL", 14: "QUERY_DIRECTORY", 16: "QUERY_INFO", 17: "SET_INFO",
}
PACKERS = (
    ("UPX", "UPX0", "section"),
    ("UPX", "UPX1", "section"),
    ("UPX", "UPX2", "section"),
    ("UPX", "UPX!", "content"),
    ("ASPack", ".aspack", "section"),
    ("ASPack", ".adata", "section"),
    ("MPRESS", ".MPRESS1", "section"),
    ("MPRESS", ".MPRESS2", "section"),
    ("PECompact", "PEC2", "section"),
    ("PECompact", "PECompact2", "content"),
    ("FSG", "FSG!", "content"),
    ("Themida", ".themida", "section"),
    ("Themida", "Themida", "content"),
    ("VMProtect", ".vmp0", "section"),
    ("VMProtect", ".vmp1", "section"),
    ("VMProtect", ".vmp2", "section"),
    ("Petite", ".petite", "section"),
    ("Enigma", ".enigma1", "section"),
    ("Enigma", ".enigma2", "section"),
    ("ConfuserEx", "ConfusedByAttribute", "content"),
    ("Obsidium", ".obsidium", "section"),
    ("Yoda", "yC", "section"),
)
HEAD_BYTES = 1 << 20
TLS_PORTS = (443, 465, 563, 636, 853, 989, 990, 992, 993, 994, 995, 5061, 8443)
RC4, AES = (23, 24), (17, 18)


def file_format(content: Column) -> Column:
    """The container format by the first bytes; fewer than four are unknown."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(F.octet_length(content) < 4, "unknown")
    for name, magic in FORMATS:
        out = out.when(head.startswith(magic), name)
    return out.otherwise("unknown")


def is_tar(content: Column) -> Column:
    return F.hex(F.substring(content, 258, 5)) == "7573746172"


def ascii_strings(content: Column) -> Column:
    """Runs of 6 to 1024 printable ASCII characters."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"[\x20-\x7E]{6,1024}"), F.lit(0))


def wide_strings(content: Column) -> Column:
    """array<struct<place, text>>: runs of 6 to 1024 printable ASCII characters in UTF-16LE, at even and odd places.

    A character is a printable byte before a zero, so a run of either alignment begins where the scan first meets it, and
    runs of the two cannot overlap but at a character whose zero is none of its own. Null contents have none.
    """
    found = places(F.decode(content, "ISO-8859-1"), r"(?:[\x20-\x7E]\x00){6,1024}")
    return F.transform(found, lambda x: F.struct(x["begin"].cast("long").alias("place"), F.replace(x["hit"], F.lit("\x00"), F.lit("")).alias("text")))


def all_strings(content: Column) -> Column:
    """The distinct ASCII strings and then the distinct UTF-16LE ones."""
    return F.array_distinct(F.concat(ascii_strings(content), F.transform(wide_strings(content), lambda x: x["text"])))


def human_size(n: Column) -> Column:
    """Bytes in B, KiB, MiB or GiB, with one digit behind the point."""
    scaled = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(n / unit, 1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, scaled(1 << 10, "KiB")).when(n < 1 << 30, scaled(1 << 20, "MiB")).otherwise(scaled(1 << 30, "GiB"))


def bad_agent(agent: Column) -> Column:
    """The label of the first pattern that a user agent meets, else null."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(BAD_AGENTS):
        out = F.when(agent.rlike(pattern), label).otherwise(out)
    return out


def _plain(values: Column) -> Column:
    """Numbers joined by dashes, without the reserved ones whose two bytes are equal and end in 0xA."""
    kept = F.filter(values, lambda v: ~((v % 256 == F.floor(v / 256)) & (v % 16 == 10)))
    return F.array_join(F.transform(kept, lambda v: v.cast("string")), "-")


def ja3_text(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column) -> Column:
    formats = F.array_join(F.transform(formats, lambda v: v.cast("string")), "-")
    return F.concat_ws(",", version.cast("string"), _plain(ciphers), _plain(extensions), _plain(curves), formats)


def ja3(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column) -> Column:
    return F.md5(ja3_text(version, ciphers, extensions, curves, formats))


def _label(value: Column, table: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def ja3s(version: Column, cipher: Column, extensions: Column) -> Column:
    return F.md5(F.concat_ws(",", version.cast("string"), cipher.cast("string"), _plain(extensions)))


def known_ja3(fingerprint: Column, server: bool = False) -> Column:
    """What a client's (or a server's) fingerprint is known as, else null."""
    return _label(fingerprint, BAD_JA3S if server else BAD_JA3)


def known_bad_ja3(hellos: DataFrame, ja3_col: str = "ja3") -> DataFrame:
    """Hellos with a fingerprint of the list of five, labelled."""
    return hellos.withColumn("label", known_ja3(F.col(ja3_col))).where("label is not null")


def smb2_command(number: Column) -> Column:
    """The name of an SMB2 command, or its number as text."""
    return F.coalesce(_label(number, SMB2_COMMANDS), number.cast("string"))


def packer(sections: Column, content: Column) -> Column:
    """The packer of the first signature that is in a section's name or in the first MiB of the file, else null."""
    head = F.decode(F.substring(content, 1, HEAD_BYTES), "ISO-8859-1")
    out = F.lit(None).cast("string")
    for name, pattern, where in reversed(PACKERS):
        hit = F.exists(sections, lambda n: n.contains(pattern)) if where == "section" else head.contains(pattern)  # noqa: B023
        out = F.when(hit, name).otherwise(out)
    return out


def tls_anomaly(port: Column, server_name: Column) -> Column:
    no_name = (port == 443) & (F.coalesce(server_name, F.lit("")) == "")
    return F.when(~port.isin(*TLS_PORTS), "non_standard_port").when(no_name, "no_sni")


def is_admin_share(path: Column) -> Column:
    """ADMIN$ or a drive's share as the last part of a UNC path; IPC$ is none."""
    return F.upper(F.element_at(F.split(path, r"\\"), -1)).rlike(r"^(ADMIN|.)\$$")


def is_kerberoastable(message: Column, etype: Column, service: Column) -> Column:
    return (message == 13) & etype.isin(*RC4) & (F.lower(F.element_at(F.split(service, "/"), 1)) != "krbtgt")


def is_asrep_roastable(message: Column, preauth: Column) -> Column:
    return (message == 10) & ~preauth


def is_rc4_downgrade(message: Column, etypes: Column) -> Column:
    has = lambda kinds: F.arrays_overlap(etypes, F.array(*[F.lit(k) for k in kinds]))
    return message.isin(10, 12) & has(RC4) & ~has(AES)


def netntlmv2(user: Column, domain: Column, challenge: Column, response: Column) -> Column:
    """``user::domain:challenge:proof:blob`` in hexadecimal; null for other versions and damaged messages."""
    h = F.lower(F.hex(response))
    whole = F.concat_ws(":", user, F.lit(""), domain, F.lower(F.hex(challenge)), F.substring(h, 1, 32), F.substr(h, F.lit(33)))
    return F.when((F.octet_length(challenge) == 8) & (F.octet_length(response) >= 16) & (user != ""), whole)


def filetime(n: Column) -> Column:
    """A Windows time (100 ns since 1601) as ISO text with seconds; the epoch where it is out of range."""
    seconds = F.floor(n / 10_000_000) - 11_644_473_600
    return F.when(seconds.between(-11_644_473_600, 253_402_300_799), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("1601-01-01T00:00:00Z")


def url_id(url: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.translate(F.base64(F.encode(url, "utf-8")), "+/=\r\n", "-_")


def ftp_credentials(packets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, src_ip, dst_ip, verb, value): the first USER, PASS, RETR and STOR of each pair on port 21."""
    ftp = packets.where("proto = 6 and (dst_port = 21 or src_port = 21)")
    head = F.decode(F.substring("payload", 1, 512), "ISO-8859-1")
    lines = ftp.select(*by, "src_ip", "dst_ip", "frame_no", F.posexplode(F.regexp_extract_all(head, F.lit(r"(?m)^(?:USER|PASS|RETR|STOR)\s+\S+\r?\n"), F.lit(0))).alias("pos", "line"))
    parts = F.split(F.trim(F.regexp_replace("line", r"[\r\n]+$", "")), r"\s+", 2)
    each = lines.select(*by, "src_ip", "dst_ip", F.get(parts, F.lit(0)).alias("verb"), F.get(parts, F.lit(1)).alias("value"), F.struct("frame_no", "pos").alias("at"))
    return each.groupBy(*by, "src_ip", "dst_ip", "verb").agg(F.min_by("value", "at").alias("value"))
