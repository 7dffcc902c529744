"""Queries of the expressions about files, protocols, decoders and addresses; see ``catalog`` for how tables are derived."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import decoders, indicators, network, protocols
from quarrylens.operators import markers, symbols
from quarrylens.plans.registry import pick, pick_sql, query, quoted, table

# --- files ------------------------------------------------------------------------------------------------------

_MAGIC = [m for _, m in protocols.FORMATS] + ["00112233", "4D", "6162636465"]
_FORMAT_SQL = " ".join(f"WHEN starts_with(h, '{m}') THEN '{name}'" for name, m in protocols.FORMATS)


@query(f"WITH c AS (SELECT p_partkey, {pick_sql('p_partkey', _MAGIC)} || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE hex(p_name) END AS h FROM part) SELECT p_partkey, CASE WHEN length(h) < 8 THEN 'unknown' {_FORMAT_SQL} ELSE 'unknown' END AS format FROM c")
def file_formats(spark, sf_dir):
    rest = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.hex("p_name"))
    content = F.unhex(F.concat(pick(F.col("p_partkey"), _MAGIC), rest))
    return table(spark, sf_dir, "part").select("p_partkey", protocols.file_format(content).alias("format"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS tar FROM part")
def tar_files(spark, sf_dir):
    end = F.when(F.col("p_partkey") % 3 == 0, "ustar").otherwise("USTAR")
    content = F.concat(F.rpad("p_name", 257, "."), end, F.col("p_type")).cast("binary")
    return table(spark, sf_dir, "part").select("p_partkey", protocols.is_tar(content).alias("tar"))


@query("WITH l AS (SELECT p_partkey, list_filter([p_name, p_type, 'short', p_brand], lambda x: length(x) >= 6) AS l FROM part) SELECT p_partkey, len(l) AS n, array_to_string(l, '|') AS runs FROM l")
def ascii_runs(spark, sf_dir):
    zero, high = F.lit(b"\x00"), F.lit(b"\xff")
    content = F.concat(F.col("p_name").cast("binary"), zero, F.col("p_type").cast("binary"), high, F.lit("short").cast("binary"), zero, F.col("p_brand").cast("binary"))
    runs = protocols.ascii_strings(content)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(runs).cast("long").alias("n"), F.array_join(runs, "|").alias("runs"))


_WIDE = "list_reduce(list_prepend('', string_split({c}, '')), lambda a, x: a || CASE WHEN x = '' THEN '' ELSE hex(x) || '00' END)"


@query(
    f"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'FF' END || {_WIDE.format(c="p_name")} || repeat('80', CAST(p_partkey % 3 + 1 AS INT)) || {_WIDE.format(c="'short'")} || 'FF' || {_WIDE.format(c="p_type")} AS h FROM part),
b AS (SELECT p_partkey, h, unnest(range(length(h) // 2 - 1)) AS i FROM c),
w AS (SELECT p_partkey, i, substr(h, CAST(2 * i + 1 AS INT), 2) AS x FROM b WHERE substr(h, CAST(2 * i + 3 AS INT), 2) = '00' AND substr(h, CAST(2 * i + 1 AS INT), 2) BETWEEN '20' AND '7E'),
r AS (SELECT *, i - 2 * row_number() OVER (PARTITION BY p_partkey, i % 2 ORDER BY i) AS run FROM w)
SELECT p_partkey, CAST(min(i) AS BIGINT) AS place, string_agg(chr(CAST('0x' || x AS INT)), '' ORDER BY i) AS text FROM r GROUP BY p_partkey, i % 2, run HAVING count(*) >= 6"""
)
def wide_runs(spark, sf_dir):
    """UTF-16LE strings at even and odd places, by gaps and islands over the bytes in SQL."""
    wide = lambda c: F.encode(c, "UTF-16LE")
    odd = F.when(F.col("p_partkey") % 2 == 0, F.lit("").cast("binary")).otherwise(F.lit(b"\xff"))
    junk = F.unhex(F.repeat(F.lit("80"), (F.col("p_partkey") % 3 + 1).cast("int")))
    content = F.concat(odd, wide(F.col("p_name")), junk, wide(F.lit("short")), F.lit(b"\xff"), wide(F.col("p_type")))
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(protocols.wide_strings(content)).alias("x"))
    return found.select("p_partkey", "x.place", "x.text")


@query("WITH s AS (SELECT o_orderkey, o_orderkey * CAST(power(10, o_orderkey % 7) AS BIGINT) AS n FROM orders) SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', round_even(n / 1024, 1)) WHEN n < 1073741824 THEN printf('%.1f MiB', round_even(n / 1048576, 1)) ELSE printf('%.1f GiB', round_even(n / 1073741824, 1)) END AS size FROM s")
def human_sizes(spark, sf_dir):
    n = F.col("o_orderkey") * F.pow(F.lit(10), F.col("o_orderkey") % 7).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", protocols.human_size(n).alias("size"))


@query("SELECT p_partkey, round(list_aggregate(string_split(p_name || p_type, ''), 'entropy'), 6) AS entropy FROM part")
def byte_entropies(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(network.byte_entropy(F.concat("p_name", "p_type").cast("binary")), 6).alias("entropy"))


_SECTIONS = [p for _, p, where in protocols.PACKERS if where == "section"] + [".text", ".data"]
_MARKS = [p for _, p, where in protocols.PACKERS if where == "content"] + ["", "nothing", "", "", ""]


@query(
    f"WITH f AS (SELECT p_partkey, ['.code', {pick_sql('p_partkey', _SECTIONS)} || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END] AS s, p_name || {pick_sql('p_partkey * 7', _MARKS)} AS c FROM part) SELECT p_partkey, CASE "
    + " ".join(f"WHEN {f'len(list_filter(s, lambda n: contains(n, {quoted(p)}))) > 0' if where == 'section' else f'contains(c, {quoted(p)})'} THEN '{name}'" for name, p, where in protocols.PACKERS)
    + " END AS packer FROM f"
)
def packers(spark, sf_dir):
    k = F.col("p_partkey")
    sections = F.array(F.lit(".code"), F.concat(pick(k, _SECTIONS), F.when(k % 2 == 0, "x").otherwise("")))
    content = F.concat("p_name", pick(k * 7, _MARKS)).cast("binary")
    return table(spark, sf_dir, "part").select(k, protocols.packer(sections, content).alias("packer"))


_SETS = {
    "combo.process_injection": ("pe", "VirtualAllocEx WriteProcessMemory CreateRemoteThread", 90),
    "combo.process_injection_partial": ("pe", "OpenProcess ResumeThread", 50),
    "combo.anti_debug": ("pe", "IsDebuggerPresent GetTickCount NtClose", 50),
    "combo.anti_vm": ("pe", "CPUID GetAdaptersInfo", 50),
    "combo.service_install": ("pe", "CreateServiceW OpenSCManagerW RegOpenKeyExA RegSetValueExA", 70),
    "combo.registry_persistence": ("pe", "RegOpenKeyExA RegSetValueExA", 50),
    "combo.keylogger": ("pe", "GetAsyncKeyState GetForegroundWindow", 70),
    "combo.screenshot_capture": ("pe", "BitBlt GetDC", 70),
    "combo.clipboard_stealer": ("pe", "GetClipboardData OpenClipboard", 50),
    "combo.dpapi_dump": ("pe", "CryptUnprotectData", 70),
    "combo.dynamic_resolution": ("pe", "GetProcAddress LoadLibraryW", 30),
    "combo.crypto_c2": ("pe", "WinHttpOpen BCryptEncrypt", 50),
    "combo.raw_socket_c2": ("pe", "socket gethostbyname", 30),
    "combo.infostealer_battery": ("pe", "EmptyClipboard GetKeyState EnumWindows GetWindowTextA", 70),
    "combo.posix_reverse_shell": ("elf", "socket connect dup2 execve", 70),
    "combo.posix_in_memory_loader": ("macho", "dlopen dlsym mprotect", 50),
    "pe.no_imports": ("pe", "", 70),
    "none": ("pe", "exit printf", 0),
}
_SET_ROWS = ", ".join(f"({i}, '{r}', {s}, '{','.join(sorted(x.split())) if r not in ('combo.dynamic_resolution', 'combo.posix_reverse_shell', 'combo.posix_in_memory_loader') else {'combo.dynamic_resolution': 'GetProcAddress,LoadLibrary*', 'combo.posix_reverse_shell': 'socket,connect,dup2,execve', 'combo.posix_in_memory_loader': 'dlopen,dlsym,mprotect'}[r]}')" for i, (r, (_, x, s)) in enumerate(_SETS.items()))


@query(
    f"""WITH t(i, rule, severity, evidence) AS (VALUES {_SET_ROWS}), f AS (SELECT p_partkey AS path, p_partkey % {len(_SETS)} AS i, p_partkey % 5 = 0 AS packed FROM part),
 a AS (SELECT path, rule, CASE WHEN rule = 'combo.dynamic_resolution' AND packed THEN 50 ELSE severity END AS severity, CASE rule WHEN 'combo.service_install' THEN 'CreateServiceW,OpenSCManagerW' ELSE evidence END AS evidence FROM f JOIN t ON f.i = t.i WHERE rule <> 'none'
 UNION ALL SELECT path, 'combo.packed_thin_imports', 50, '' FROM f JOIN t ON f.i = t.i WHERE packed AND rule <> 'pe.no_imports')
 SELECT path, rule, severity, evidence FROM a"""
)
def symbol_rules(spark, sf_dir):
    k = F.col("p_partkey")
    names = F.filter(F.split(pick(k, [x for _, x, _ in _SETS.values()]), " "), lambda x: x != "")
    files = table(spark, sf_dir, "part").select(k.alias("path"), pick(k, [f for f, _, _ in _SETS.values()]).alias("format"), names.alias("symbols"), F.size(names).alias("n_imports"), (k % 5 == 0).alias("packed"), F.lit(False).alias("dotnet"), F.lit(False).alias("high_entropy"))
    return symbols.findings(files).select("path", "rule", "severity", F.array_join("evidence", ",").alias("evidence"))


# --- protocols --------------------------------------------------------------------------------------------------

_SHARES = ("ADMIN$", "c$", "IPC$", "data", "D$x", "print")


@query("SELECT o_orderkey, o_orderkey % 6 IN (0, 1) AS admin FROM orders")
def admin_shares(spark, sf_dir):
    path = F.concat(F.lit("\\\\h"), F.col("o_custkey").cast("string"), F.lit("\\"), pick(F.col("o_orderkey"), _SHARES))
    return table(spark, sf_dir, "orders").select("o_orderkey", protocols.is_admin_share(path).alias("admin"))


@query(
    "WITH k AS (SELECT o_orderkey, o_orderkey % 4 + 10 AS m, ([17, 18, 23, 24])[CAST(o_custkey % 4 AS INT) + 1] AS e, CASE WHEN o_custkey % 5 = 0 THEN 'krbtgt/X' ELSE 'MSSQLSvc/h' END AS s, o_custkey % 3 = 0 AS pre, ([17, 18, 23, 24])[CAST(o_orderkey % 3 AS INT) + 1] AS e2 FROM orders) "
    "SELECT o_orderkey, m = 13 AND e IN (23, 24) AND s <> 'krbtgt/X' AS roastable, m = 10 AND NOT pre AS asrep, m IN (10, 12) AND (e IN (23, 24) OR e2 IN (23, 24)) AND NOT (e IN (17, 18) OR e2 IN (17, 18)) AS downgrade FROM k"
)
def kerberos_flags(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    message, etype, other = (o % 4 + 10).cast("int"), pick(c, (17, 18, 23, 24)), F.element_at(F.array(*[F.lit(x) for x in (17, 18, 23)]), (o % 3 + 1).cast("int"))
    service = F.when(c % 5 == 0, "krbtgt/X").otherwise("MSSQLSvc/h")
    return table(spark, sf_dir, "orders").select(
        o, protocols.is_kerberoastable(message, etype, service).alias("roastable"), protocols.is_asrep_roastable(message, c % 3 == 0).alias("asrep"), protocols.is_rc4_downgrade(message, F.array(etype, other)).alias("downgrade")
    )


@query("SELECT o_orderkey, md5('771,' || (o_orderkey % 100 + 1) || '-4865,' || '0-' || (o_custkey % 50) || ',29-23,0') AS ja3, md5('771,' || (4865 + o_orderkey % 3) || ',43-' || (o_custkey % 50)) AS ja3s FROM orders")
def tls_fingerprints(spark, sf_dir):
    o, c = F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int")
    ints = lambda *xs: F.array(*[x if not isinstance(x, int) else F.lit(x) for x in xs])
    version = F.lit(771)
    client = protocols.ja3(version, ints(0x1A1A, o % 100 + 1, 4865), ints(0, 0xFAFA, c % 50), ints(0x2A2A, 29, 23), ints(0))
    return table(spark, sf_dir, "orders").select("o_orderkey", client.alias("ja3"), protocols.ja3s(version, 4865 + o % 3, ints(43, 0x0A0A, c % 50)).alias("ja3s"))


_PRINTS = [*protocols.BAD_JA3, *protocols.BAD_JA3S, "0" * 32]
_PRINT_ROWS = ", ".join(f"('{k}', '{v}', {s})" for t, s in ((protocols.BAD_JA3, "false"), (protocols.BAD_JA3S, "true")) for k, v in t.items())


@query(f"WITH t(f, label, server) AS (VALUES {_PRINT_ROWS}), x AS (SELECT o_orderkey % 2 = 0 AS server, {pick_sql('o_custkey', _PRINTS)} AS f FROM orders) SELECT x.server AS server, t.label AS label, count(*) AS n FROM x LEFT JOIN t ON x.f = t.f AND x.server = t.server GROUP BY 1, 2")
def known_fingerprints(spark, sf_dir):
    f, server = pick(F.col("o_custkey"), _PRINTS), F.col("o_orderkey") % 2 == 0
    label = F.when(server, protocols.known_ja3(f, server=True)).otherwise(protocols.known_ja3(f))
    return table(spark, sf_dir, "orders").groupBy(server.alias("server"), label.alias("label")).agg(F.count("*").alias("n"))


_PORTS = (443, 8443, 4444, 993, 80, 443)


@query(f"WITH h AS (SELECT {pick_sql('o_orderkey', _PORTS)} AS port, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'a.org' END AS name FROM orders) SELECT CASE WHEN port NOT IN ({', '.join(map(str, protocols.TLS_PORTS))}) THEN 'non_standard_port' WHEN port = 443 AND name = '' THEN 'no_sni' END AS kind, count(*) AS n FROM h GROUP BY 1")
def tls_anomalies(spark, sf_dir):
    name = F.when(F.col("o_custkey") % 2 == 0, "").otherwise("a.org")
    return table(spark, sf_dir, "orders").groupBy(protocols.tls_anomaly(pick(F.col("o_orderkey"), _PORTS), name).alias("kind")).agg(F.count("*").alias("n"))


_VERBS = ("USER", "PASS", "RETR", "LIST", "STOR")


@query(
    f"WITH p AS (SELECT o_custkey % 20 AS src, o_orderkey % 3 AS dst, o_orderkey AS frame, {pick_sql('o_custkey', _VERBS)} AS verb FROM orders WHERE o_orderkey % 4 <> 0) "
    "SELECT 's' || src AS src_ip, 'd' || dst AS dst_ip, verb, 'v' || min(frame) AS value FROM p WHERE verb <> 'LIST' GROUP BY 1, 2, 3"
)
def ftp_logins(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    port = F.when(o % 4 == 0, 80).otherwise(21)
    payload = F.concat(pick(c, _VERBS), F.lit(" v"), o.cast("string"), F.lit("\r\n")).cast("binary")
    p = table(spark, sf_dir, "orders").select(o.alias("frame_no"), F.concat(F.lit("s"), (c % 20).cast("string")).alias("src_ip"), F.concat(F.lit("d"), (o % 3).cast("string")).alias("dst_ip"), F.lit(5000).alias("src_port"), port.alias("dst_port"), F.lit(6).alias("proto"), payload.alias("payload"))
    return protocols.ftp_credentials(p)


_AGENTS = ("curl/8.1", "Mozilla/4.0", "Firefox/120", "", "Python-urllib/3.9", "Sliver/1", "Microsoft BITS/7.8", "Mozilla/5.0 (Windows NT 10.0; WindowsPowerShell/5)", "Mozilla/4.0 (compatible; MSIE 7.0; Windows NT 6.1)")
_AGENT_SQL = " ".join(f"WHEN regexp_matches(a, {quoted(p)}) THEN {quoted(label)}" for label, p in protocols.BAD_AGENTS)


@query(f"WITH a AS (SELECT {pick_sql('o_orderkey', _AGENTS)} AS a FROM orders) SELECT CASE {_AGENT_SQL} END AS label, count(*) AS n FROM a GROUP BY 1")
def bad_agents(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(protocols.bad_agent(pick(F.col("o_orderkey"), _AGENTS)).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE o_orderkey % 20 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in protocols.SMB2_COMMANDS.items()) + " ELSE CAST(o_orderkey % 20 AS VARCHAR) END AS command FROM orders")
def smb2_commands(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", protocols.smb2_command((F.col("o_orderkey") % 20).cast("int")).alias("command"))


@query("SELECT o_orderkey, 'u' || o_custkey || '::D' || (o_orderkey % 9) || ':' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16) || ':' || md5(o_comment_) || ':' || lower(hex(o_comment_)) AS line FROM (SELECT *, o_orderpriority || o_orderkey AS o_comment_ FROM orders)")
def netntlm_lines(spark, sf_dir):
    text = F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))
    challenge = F.unhex(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 16))
    response = F.concat(F.unhex(F.md5(text)), text.cast("binary"))
    line = protocols.netntlmv2(F.concat(F.lit("u"), F.col("o_custkey").cast("string")), F.concat(F.lit("D"), (F.col("o_orderkey") % 9).cast("string")), challenge, response)
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query("SELECT o_orderkey, strftime(to_timestamp(epoch(o_orderdate) + o_orderkey % 86400) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at FROM orders")
def windows_times(spark, sf_dir):
    ticks = (F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400 + 11_644_473_600) * 10_000_000 + F.col("o_custkey") % 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", protocols.filetime(ticks).alias("at"))


@query("SELECT page_id, translate(rtrim(base64(encode(url)), '='), '+/', '-_') AS id FROM pages")
def url_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", protocols.url_id(F.col("url")).alias("id"))


# --- decoders ---------------------------------------------------------------------------------------------------

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(text):
    """Base32 of a text, eight digits from five bytes at a time; zeros fill the last five."""
    blocks = F.ceil(F.octet_length(text) / 5).cast("int")
    padded = F.rpad(F.hex(text), blocks * 10, "0")
    digits = F.array_join(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.lpad(F.conv(F.substr(padded, i * 10 + 1, F.lit(10)), 16, 32), 8, "0")), "")
    return F.translate(F.substr(digits, F.lit(1), F.ceil(F.octet_length(text) * 8 / 5).cast("int")), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


@query("SELECT p_partkey, p_name AS decoded FROM part")
def base32_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", _base32(F.col("p_name")).alias("t")).select("p_partkey", decoders.base32(F.lower("t")).alias("decoded"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE replace(p_name, ' ', '&') || '<' || chr(233) END AS decoded FROM part")
def html_texts(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("&amp;")), F.lit("&lt;&eacute;")))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("t")).select("p_partkey", decoders.html(F.col("t")).alias("decoded"))


def _little(n, size):
    """``size`` bytes of a number as hexadecimal digits, the lowest first."""
    digits = F.lpad(F.hex(n), 2 * size, "0")
    return F.concat(*[F.substr(digits, F.lit(2 * i + 1), F.lit(2)) for i in range(size - 1, -1, -1)])


def _stored(text):
    """A deflate stream of one block that is not compressed."""
    n = F.octet_length(text)
    return F.concat(F.lit("01"), _little(n, 2), _little(65535 - n, 2), F.hex(text))


def _adler(text):
    start = F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"))
    bytes_ = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    sums = F.aggregate(bytes_, start, lambda s, x: F.struct(((s["a"] + x) % 65521).alias("a"), ((s["b"] + s["a"] + x) % 65521).alias("b")))
    return F.concat(F.lpad(F.hex(sums["b"]), 4, "0"), F.lpad(F.hex(sums["a"]), 4, "0"))


@query("SELECT p_partkey, p_name AS gzip_text, p_type AS zlib_text, CAST(NULL AS VARCHAR) AS garbage FROM part")
def inflated_texts(spark, sf_dir):
    name, kind = F.col("p_name"), F.col("p_type")
    gz = F.concat(F.lit("1F8B08000000000000FF"), _stored(name), _little(F.crc32(name.cast("binary")), 4), _little(F.octet_length(name), 4))
    z = F.concat(F.lit("7801"), _stored(kind), _adler(kind))
    coded = table(spark, sf_dir, "part").select("p_partkey", gz.alias("g"), F.base64(F.unhex(z)).alias("z"), name.alias("n"))
    return coded.select("p_partkey", decoders.gzip(F.col("g")).alias("gzip_text"), decoders.zlib(F.col("z")).alias("zlib_text"), decoders.gzip(F.col("n")).alias("garbage"))


@query("""SELECT o_orderkey, '{' || chr(10) || '  "header": {' || chr(10) || '    "alg": "HS256"' || chr(10) || '  },' || chr(10) || '  "payload": {' || chr(10) || '    "sub": ' || o_custkey || ',' || chr(10) || '    "p": "' || o_orderpriority || '"' || chr(10) || '  }' || chr(10) || '}' AS decoded FROM orders""")
def token_texts(spark, sf_dir):
    part = lambda x: F.translate(F.base64(x.cast("binary")), "+/=", "-_")
    payload = F.concat(F.lit('{"sub":'), F.col("o_custkey").cast("string"), F.lit(',"p":"'), "o_orderpriority", F.lit('"}'))
    token = F.concat_ws(".", part(F.lit('{"alg":"HS256"}')), part(payload), F.lit("c2ln"))
    return table(spark, sf_dir, "orders").select("o_orderkey", token.alias("t")).select("o_orderkey", decoders.jwt(F.col("t")).alias("decoded"))


@query("SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS turned FROM part")
def rot13_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", decoders.decode("rot13", F.col("p_name")).alias("turned"))


# --- addresses --------------------------------------------------------------------------------------------------

_IPV6 = (
    ("::1", "loopback"), ("fe80::1%eth0", "link-local"), ("fec0::7", "site-local"), ("::", "private,ula"), ("::ffff:10.0.0.1", "private,ula"), ("fd00:1::2", "private,ula"),
    ("2001:db8::5", "private,ula"), ("ff02::1", "multicast"), ("4000::1", "reserved"), ("2606:4700::1111", "public"), ("1:2:3:4:5:6:7::", "reserved"), ("1:2", None), ("2a00:0:0:0:0:0:0:1", "public"),
)


@query(f"SELECT {pick_sql('o_orderkey', [t for _, t in _IPV6])} AS tags, count(*) AS n FROM orders GROUP BY 1")
def ipv6_classes(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(network.classify_ipv6(pick(F.col("o_orderkey"), [a for a, _ in _IPV6]))["tags"].alias("tags")).agg(F.count("*").alias("n"))


_KINDS = {
    "sha256": "sha256(CAST(o_orderkey AS VARCHAR))", "sha1": "sha1(CAST(o_orderkey AS VARCHAR))", "md5": "md5(CAST(o_orderkey AS VARCHAR))", "cve": "'CVE-2020-' || (1000 + o_orderkey % 9000)",
    "btc_address": "'1BoatSLRHtKNngkdXEeobR76b53LETtpyT'", "url": "'https://h' || o_orderkey || '.org/x'", "email": "'u' || o_orderkey || '@a.org'", "ipv4": "'10.1.' || (o_orderkey % 256) || '.9'",
    "ipv6": "'::ffff:10.1.' || (o_orderkey % 256) || '.9'", "domain": "'h' || o_orderkey || '.org'", "none": "'word ' || o_orderkey",
}


@query(f"SELECT {pick_sql('o_orderkey', [None if k == 'none' else k for k in _KINDS])} AS type, count(*) AS n FROM orders GROUP BY 1")
def detect_all_types(spark, sf_dir):
    forms = [F.expr(x.replace("VARCHAR", "STRING").replace("sha256(", "sha2_(")).alias("v") if "sha256" not in x else F.sha2(F.col("o_orderkey").cast("string"), 256) for x in _KINDS.values()]
    value = F.element_at(F.array(*forms), (F.pmod(F.col("o_orderkey"), F.lit(len(forms))) + 1).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(indicators.detect_type(value).alias("type")).agg(F.count("*").alias("n"))


# --- bytes ------------------------------------------------------------------------------------------------------

_STEP = 64
_PATTERN_SQL = ", ".join(f"('{name}', '{pattern.hex().upper()}')" for name, pattern in markers.scan_patterns())
_BYTES = f"""p(name, h) AS (VALUES {_PATTERN_SQL}),
c AS (SELECT path, string_agg(h, '' ORDER BY o, n, h) AS h FROM (SELECT l_orderkey % 200 AS path, l_orderkey AS o, l_linenumber AS n, CASE WHEN l_partkey % 5 = 0 THEN {pick_sql('l_partkey // 5', [p.hex().upper() for _, p in markers.scan_patterns()])} WHEN l_partkey % 5 = 1 THEN '4D5A' || repeat('00', 58) || '0' || (l_suppkey % 9) || '000000' ELSE hex(l_returnflag || l_partkey) END AS h FROM lineitem) GROUP BY path)"""


def _contents(spark, sf_dir):
    """Contents in which all patterns lie at places that follow from the lines of many orders."""
    part = F.col("l_partkey")
    image = F.concat(F.lit("4D5A" + "00" * 58 + "0"), (F.col("l_suppkey") % 9).cast("string"), F.lit("000000"))
    piece = F.when(part % 5 == 0, pick(F.floor(part / 5), [p.hex().upper() for _, p in markers.scan_patterns()])).when(part % 5 == 1, image).otherwise(F.hex(F.concat("l_returnflag", part.cast("string"))))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("path"), F.struct("l_orderkey", "l_linenumber", piece.alias("h")).alias("x"))
    joined = rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["h"]), "").alias("h"))
    return joined.select(F.col("path").cast("string").alias("path"), F.unhex("h").alias("content"))


@query(f"WITH {_BYTES} SELECT CAST(path AS VARCHAR) AS path, name, count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM (SELECT path, h, unnest(range(length(h) // 2)) AS i FROM c) s JOIN p ON substr(s.h, CAST(2 * i + 1 AS INT), length(p.h)) = p.h GROUP BY path, name")
def byte_patterns(spark, sf_dir):
    """All places of 19 patterns, in chunks of 64 bytes whose borders they cross."""
    return markers.find_all(_contents(spark, sf_dir), markers.scan_patterns(), size=_STEP).groupBy("path", "name").agg(F.count("*").alias("n"), F.sum("place").alias("places"))


_SHELLCODE_SQL = ", ".join(f"('{r}', {s})" for r, _, _, s in markers.SHELLCODE)
_AT = "'0x' || lower(to_hex(i))"


@query(
    f"""WITH {_BYTES}, k AS MATERIALIZED (SELECT CAST(path AS VARCHAR) AS path, s.h AS h, name, i FROM (SELECT path, h, unnest(range(length(h) // 2)) AS i FROM c) s JOIN p ON substr(s.h, CAST(2 * i + 1 AS INT), length(p.h)) = p.h),
m AS (SELECT path, i, i + CAST('0x' || substr(h, CAST(2 * i + 127 AS INT), 2) || substr(h, CAST(2 * i + 125 AS INT), 2) || substr(h, CAST(2 * i + 123 AS INT), 2) || substr(h, CAST(2 * i + 121 AS INT), 2) AS BIGINT) AS t FROM k WHERE name = 'MZ' AND i > 0 AND 2 * i + 128 <= length(h)),
e AS (SELECT m.path AS path, 'embedded.pe' AS rule, m.i AS i FROM m JOIN k ON m.path = k.path AND k.name = 'PE' AND k.i = m.t WHERE t - m.i BETWEEN 1 AND 1048575 UNION ALL SELECT path, name, i FROM k WHERE name LIKE 'embedded.%' AND i > 0),
a AS (SELECT path, substr(name, 9) AS label, i, CASE substr(name, 9) WHEN 'ZIP' THEN 1 WHEN '7z' THEN 2 WHEN 'RAR' THEN 3 ELSE 4 END AS o FROM k WHERE name LIKE 'archive %'),
s(rule, severity) AS (VALUES {_SHELLCODE_SQL}),
z AS (SELECT path, name, min(i) AS i, row_number() OVER (PARTITION BY path ORDER BY CASE name WHEN 'beacon' THEN 1 WHEN 'beacon 0x69' THEN 2 ELSE 3 END) AS n FROM k WHERE name LIKE 'beacon%' GROUP BY path, name)
SELECT path, rule, 70 AS severity, string_agg({_AT}, ' ' ORDER BY i) AS evidence FROM e GROUP BY path, rule
UNION ALL SELECT path, 'embedded.archive', 50, string_agg(label || '@' || {_AT}, ' ' ORDER BY o, i) FROM a GROUP BY path
UNION ALL SELECT path, rule, severity, {_AT} FROM (SELECT path, rule, severity, min(i) AS i FROM k JOIN s ON k.name = s.rule GROUP BY path, rule, severity)
UNION ALL SELECT path, CASE WHEN name = 'beacon' THEN 'c2.cobalt_strike_beacon_marker' ELSE 'c2.cobalt_strike_xor_marker' END, 90, {_AT} FROM z WHERE n = 1"""
)
def marker_findings(spark, sf_dir):
    """Embedded payloads, with all their places, shellcode and beacon markers of the same contents, searched to their ends."""
    return markers.findings(_contents(spark, sf_dir), size=_STEP, whole=True).select("path", "rule", "severity", F.array_join("evidence", " ").alias("evidence"))
