"""Queries of the findings of captures and event logs; see ``catalog`` for how tables are derived."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import protocols
from quarrylens.operators import captures, flows, winevents
from quarrylens.plans.registry import pick, pick_sql, query, quoted, table

_BOUNDS = {"beacons": {"cv": 10.0, "low": 1.0, "high": 1e12}, "port_scans": {"ports": 2}, "host_sweeps": {"hosts": 2}, "one_sided": {"least": 3000}, "icmp_tunnels": {"least": 64, "count": 5}}
_PACKETS = """p AS (SELECT 'f' || (l_linenumber % 2) AS file, l_orderkey * 10 + l_linenumber AS frame, epoch(l_shipdate) + l_linenumber AS ts, 's' || (l_suppkey % 3) AS s, 'd' || (l_partkey % 3) AS d,
 CASE WHEN l_suppkey % 7 = 0 THEN 1 WHEN l_orderkey % 2 = 0 THEN 6 ELSE 17 END AS proto, CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE l_partkey % 12 + 1 END AS port, CAST(l_quantity AS INT) * 10 AS size FROM lineitem)"""


def _packets(spark, sf_dir):
    icmp = F.col("l_suppkey") % 7 == 0
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), (F.col("l_linenumber") % 2).cast("string")).alias("file"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_no"),
        (F.unix_timestamp("l_shipdate") + F.col("l_linenumber")).cast("double").alias("ts"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("src_ip"),
        F.when(icmp, 0).otherwise(5000).alias("src_port"),
        F.concat(F.lit("d"), (F.col("l_partkey") % 3).cast("string")).alias("dst_ip"),
        F.when(icmp, 0).otherwise(F.col("l_partkey") % 12 + 1).cast("int").alias("dst_port"),
        F.when(icmp, 1).when(F.col("l_orderkey") % 2 == 0, 6).otherwise(17).alias("proto"),
        (F.col("l_quantity").cast("int") * 10).alias("size"),
        F.lit(2).alias("tcp_flags"),
    )


@query(f"""WITH {_PACKETS}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY file, s, d, port, proto ORDER BY frame) AS gap FROM p),
 b AS (SELECT file, s, d, port, count(*) AS n, count(*) FILTER (WHERE gap > 0) AS k, avg(gap) FILTER (WHERE gap > 0) AS mean, stddev_pop(gap) FILTER (WHERE gap > 0) AS sd, count(DISTINCT gap) FILTER (WHERE gap > 0) AS nd FROM g GROUP BY file, s, d, port, proto),
 u AS (SELECT file, 'pcap.beaconing' AS rule, 70 AS severity, 'c2' AS category, s || '->' || d || ':' || port AS evidence FROM b WHERE n >= 6 AND k >= 5 AND mean BETWEEN 1 AND 1e12 AND sd / mean <= 10 AND NOT (nd < 3 AND mean < 5)
 UNION ALL SELECT file, 'pcap.port_scan', 50, 'recon', s || '->' || d FROM p WHERE proto IN (6, 17) GROUP BY file, s, d, proto HAVING count(DISTINCT port) >= 2
 UNION ALL SELECT file, 'pcap.host_sweep', 50, 'recon', s || '->:' || port FROM p WHERE proto IN (6, 17) GROUP BY file, s, proto, port HAVING count(DISTINCT d) >= 2
 UNION ALL SELECT file, 'pcap.unidirectional_exfil', 70, 'exfiltration', s || '->' || d || ':' || port FROM p GROUP BY file, s, d, port, proto HAVING sum(size) >= 3000
 UNION ALL SELECT file, 'pcap.icmp_tunnel', 70, 'c2', s || '->' || d FROM p WHERE proto = 1 AND size - 8 >= 64 GROUP BY file, s, d HAVING count(*) >= 5) SELECT * FROM u""")  # fmt: skip
def packet_findings(spark, sf_dir):
    """With loose bounds, so that every rule finds something in the tables."""
    return captures.packet_findings(_packets(spark, sf_dir), **_BOUNDS).withColumn("evidence", F.array_join("evidence", " "))


_NAMES = ("x7f3k9q2m1zt.com", "www.example.org", "qzxwvkjhgfdt.net", "mail.example.org", "kq8z3v7x1b9m.biz", "")
_DNS = f"""m AS (SELECT 'f' || (user_id % 3) AS file, event_type IN ('click', 'purchase') AS r, epoch(ts) AS ts, CASE WHEN user_id % 3 = 1 THEN {pick_sql('(event_id % 2)', _NAMES)} ELSE {pick_sql('event_id', _NAMES)} END AS qname,
 CASE WHEN event_id % 3 = 0 THEN 16 ELSE 1 END AS qtype, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END AS rcode, event_id % 500 AS size FROM events)"""
_LABEL = "CASE WHEN qname = '' THEN '' ELSE split_part(qname, '.', -2) END"


def _dns(spark, sf_dir):
    one = F.col("user_id") % 3 == 1
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("file"),
        F.col("event_type").isin("click", "purchase").alias("is_response"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.when(one, pick(F.col("event_id") % 2, _NAMES)).otherwise(pick(F.col("event_id"), _NAMES)).alias("qname"),
        F.when(F.col("event_id") % 3 == 0, 16).otherwise(1).alias("qtype"),
        F.when(F.col("event_id") % 2 == 0, 3).otherwise(0).alias("rcode"),
        (F.col("event_id") % 500).alias("size"),
    )


@query(f"""WITH {_DNS}, q AS (SELECT DISTINCT file, qname, {_LABEL} AS s FROM m WHERE qname <> ''), h AS (SELECT *, list_aggregate(string_split(s, ''), 'entropy') AS h,
 coalesce(list_max(list_transform(regexp_extract_all(s, '[bcdfghjklmnpqrstvwxz]+', 0), lambda x: length(x))), 0) AS run, length(regexp_replace(s, '[^0-9]', '', 'g')) / length(s) AS d FROM q),
 w AS (SELECT file, qname FROM h WHERE length(s) >= 8 AND (h >= 3.8 OR (h >= 3.4 AND run >= 5) OR (run >= 7 AND h >= 3.0) OR (d >= 0.3 AND h >= 3.2))),
 st AS (SELECT file, max(ts) - min(ts) AS secs, count(*) FILTER (WHERE r) AS res, count(*) FILTER (WHERE r AND rcode = 3) AS nx, sum(CASE WHEN r AND qtype = 16 THEN size ELSE 0 END) AS txt FROM m GROUP BY file),
 l AS (SELECT m.file AS file, {_LABEL} AS s, count(*) AS n FROM m WHERE NOT r AND qname <> '' GROUP BY 1, 2)
 SELECT file, CASE WHEN count(*) >= 3 THEN 'pcap.dga_dns' ELSE 'pcap.dga_dns_outlier' END AS rule, CASE WHEN count(*) >= 3 THEN 70 ELSE 30 END AS severity, string_agg(qname, ' ' ORDER BY qname) AS evidence FROM w GROUP BY file
 UNION ALL SELECT file, 'pcap.dns_tunneling_txt_volume', 70, '' FROM st WHERE txt >= 4000 UNION ALL SELECT file, 'pcap.high_nxdomain_ratio', 50, '' FROM st WHERE res >= 50 AND nx >= 0.3 * res
 UNION ALL SELECT l.file, 'pcap.dns_tunneling_query_rate', 70, l.s FROM l JOIN st ON l.file = st.file WHERE l.n >= 5 AND secs > 0 AND l.n / secs >= 0.000001""")  # fmt: skip
def dns_findings(spark, sf_dir):
    dns = _dns(spark, sf_dir)
    durations = dns.groupBy("file").agg((F.max("ts") - F.min("ts")).alias("seconds"))
    found = captures.dns_findings(dns, durations, busy_labels={"queries": 5, "rate": 0.000001}, nxdomain_ratio={"ratio": 0.3})
    return found.select("file", "rule", "severity", F.array_join("evidence", " ").alias("evidence"))


@query(f"WITH {_DNS} SELECT file, qtype, count(*) AS n FROM m GROUP BY 1, 2")
def dns_types(spark, sf_dir):
    return flows.dns_types(_dns(spark, sf_dir), ("file",))


@query(f"WITH {_DNS} SELECT file, qname, count(*) FILTER (WHERE NOT r) AS queries, count(*) FILTER (WHERE r AND rcode = 3) AS nxdomain, count(*) FILTER (WHERE qtype = 16) AS txt FROM m WHERE qname <> '' GROUP BY 1, 2")
def dns_names(spark, sf_dir):
    return flows.dns_names(_dns(spark, sf_dir), ("file",))


_PORTS, _PRINTS = (443, 8443, 4444, 993, 80), [*protocols.BAD_JA3, "0" * 32, "1" * 32]
_HELLOS = f"h AS (SELECT 'f' || (o_orderkey % 2) AS file, 's' || (o_custkey % 3) AS s, 'd' || (o_orderkey % 5) AS d, {pick_sql('o_custkey', _PORTS)} AS port, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'n' || (o_custkey % 9) || '.org' END AS name, {pick_sql('o_orderkey', _PRINTS)} AS ja3 FROM orders)"


def _hellos(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    name = F.when(c % 2 == 0, "").otherwise(F.concat(text("n", c % 9), F.lit(".org")))
    return table(spark, sf_dir, "orders").select(text("f", o % 2).alias("file"), text("s", c % 3).alias("src_ip"), text("d", o % 5).alias("dst_ip"), pick(c, _PORTS).alias("dst_port"), name.alias("server_name"), pick(o, _PRINTS).alias("ja3"))


@query(
    f"WITH {_HELLOS}, t(f, label) AS (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in protocols.BAD_JA3.items())}), u AS (SELECT file, 'pcap.ja3_known_bad' AS rule, 50 AS severity, ja3 || ' ' || label AS evidence FROM h JOIN t ON h.ja3 = t.f "
    f"UNION ALL SELECT file, 'pcap.tls_non_standard_port', 50, s || '->' || d || ':' || port FROM h WHERE port NOT IN ({', '.join(map(str, protocols.TLS_PORTS))}) UNION ALL SELECT file, 'pcap.tls_no_sni', 30, s || '->' || d || ':' || port FROM h WHERE port = 443 AND name = '') "
    "SELECT file, rule, severity, evidence, count(*) AS n FROM u GROUP BY 1, 2, 3, 4"
)
def tls_findings(spark, sf_dir):
    return captures.tls_findings(_hellos(spark, sf_dir)).groupBy("file", "rule", "severity", F.array_join("evidence", " ").alias("evidence")).agg(F.count("*").alias("n"))


_AGENTS = ("curl/8.1", "Firefox/120", "", "Python-urllib/3.9")


@query(
    f"WITH h AS (SELECT 'f' || (o_orderkey % 2) AS file, {pick_sql('o_custkey', _AGENTS)} AS a, o_orderkey % 5 = 0 AS basic, 's' || (o_custkey % 3) || '->d' || (o_orderkey % 4) || ':80' AS e FROM orders), "
    "u AS (SELECT file, 'pcap.suspicious_user_agent' AS rule, 50 AS severity, CASE WHEN a = '' THEN '<empty>' ELSE a END AS evidence FROM h WHERE a <> 'Firefox/120' UNION ALL SELECT file, 'pcap.plaintext_http_basic', 70, e FROM h WHERE basic) SELECT file, rule, severity, evidence, count(*) AS n FROM u GROUP BY 1, 2, 3, 4"
)
def agent_findings(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    requests = table(spark, sf_dir, "orders").select(text("f", o % 2).alias("file"), pick(c, _AGENTS).alias("user_agent"), (o % 5 == 0).alias("basic_auth"), text("s", c % 3).alias("src_ip"), text("d", o % 4).alias("dst_ip"), F.lit(80).alias("dst_port"))
    return captures.agent_findings(requests).groupBy("file", "rule", "severity", F.array_join("evidence", " ").alias("evidence")).agg(F.count("*").alias("n"))


@query(
    f"WITH {_PACKETS}, {_HELLOS}, e AS (SELECT file, ts, unnest([s, d]) AS ip FROM p), a AS (SELECT file, count(*) // 2 AS packets, max(ts) - min(ts) AS seconds, count(DISTINCT ip) AS hosts FROM e GROUP BY file), "
    "b AS (SELECT file, count(DISTINCT CASE WHEN name <> '' THEN name END) AS names, count(DISTINCT ja3) AS fingerprints FROM h GROUP BY file) SELECT a.file AS file, packets, seconds, hosts, coalesce(names, 0) AS names, coalesce(fingerprints, 0) AS fingerprints FROM a LEFT JOIN b ON a.file = b.file"
)
def capture_summary(spark, sf_dir):
    return flows.capture_summary(_packets(spark, sf_dir), _hellos(spark, sf_dir), ("file",))


_SHARES, _ETYPES = ("ADMIN$", "c$", "IPC$", "data"), (17, 18, 23, 24)
_SERVERS = (*protocols.BAD_JA3S, "0" * 32)


@query(
    f"""WITH o AS (SELECT 'f' || (o_orderkey % 2) AS file, 's' || (o_custkey % 3) AS s, 'd' || (o_orderkey % 5) AS d, {pick_sql('o_custkey', _SHARES)} AS sh, o_orderkey % 4 = 0 AS old, o_orderkey % 4 + 10 AS m, {pick_sql('o_custkey', _ETYPES)} AS e,
 CASE WHEN o_custkey % 5 = 0 THEN 'krbtgt/X' ELSE 'svc/h' || (o_custkey % 5) END AS sv, 'c' || (o_custkey % 9) AS c, o_custkey % 3 = 0 AS pre, {pick_sql('o_custkey', _SERVERS)} AS js, md5(CAST(o_orderkey AS VARCHAR)) AS h, o_custkey % 5 AS u FROM orders),
 t(f, label) AS (VALUES {", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in protocols.BAD_JA3S.items())}),
 x AS (SELECT DISTINCT file, 'pcap.smb_admin_share' AS rule, 70 AS severity, chr(92) || chr(92) || 'h' || chr(92) || sh || ' ' || s || '->' || d AS evidence FROM o WHERE sh IN ('ADMIN$', 'c$')
 UNION ALL SELECT DISTINCT file, 'pcap.smb1_in_use', 50, s || '->' || d FROM o WHERE old
 UNION ALL SELECT file, 'pcap.kerberoasting', 70, sv || ' R' FROM o WHERE m = 13 AND e IN (23, 24) AND sv <> 'krbtgt/X' UNION ALL SELECT file, 'pcap.asrep_roasting', 70, c || ' R' FROM o WHERE m = 10 AND NOT pre
 UNION ALL SELECT file, 'pcap.kerberos_rc4_downgrade', 50, c || ' R' FROM o WHERE m IN (10, 12) AND e IN (23, 24)
 UNION ALL SELECT file, 'pcap.ja3s_known_bad', 50, js || ' ' || label FROM o JOIN t ON o.js = t.f
 UNION ALL SELECT file, 'pcap.netntlmv2_capture', 70, 'u' || u || '::D:' || substr(h, 1, 16) || ':' || h || ':' FROM o WHERE u <> 0
 UNION ALL SELECT DISTINCT file, 'pcap.plaintext_ftp_creds', 70, s || '->' || d FROM o)
 SELECT file, rule, severity, evidence, count(*) AS n FROM x GROUP BY 1, 2, 3, 4"""
)
def auth_findings(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    rows = table(spark, sf_dir, "orders").select("*", text("f", o % 2).alias("file"), text("s", c % 3).alias("src_ip"), text("d", o % 5).alias("dst_ip"))
    shares = rows.select("file", "src_ip", "dst_ip", F.when(o % 4 == 0, "SMB1").otherwise("SMB2").alias("dialect"), F.concat(F.lit("\\\\h\\"), pick(c, _SHARES)).alias("path"))
    etype, service = pick(c, _ETYPES), F.when(c % 5 == 0, "krbtgt/X").otherwise(text("svc/h", c % 5))
    tickets = rows.select("file", text("c", c % 9).alias("client"), service.alias("service"), F.lit("R").alias("realm"), (o % 4 + 10).cast("int").alias("message"), etype.alias("etype"), F.array(etype).alias("etypes"), (c % 3 == 0).alias("preauth"))
    h = F.md5(o.cast("string"))
    responses = rows.select("file", F.when(c % 5 == 0, "").otherwise(text("u", c % 5)).alias("user"), F.lit("D").alias("domain"), F.unhex(F.substring(h, 1, 16)).alias("challenge"), F.unhex(h).alias("response"))
    packets = rows.select("file", o.alias("frame_no"), "src_ip", "dst_ip", F.lit(5000).alias("src_port"), F.lit(21).alias("dst_port"), F.lit(6).alias("proto"), F.concat(text("USER u", c), F.lit("\r\n")).cast("binary").alias("payload"))
    found = captures.share_findings(shares).unionByName(captures.ticket_findings(tickets)).unionByName(captures.server_findings(rows.select("file", pick(c, _SERVERS).alias("ja3s"))))
    found = found.unionByName(captures.credential_findings(responses, protocols.ftp_credentials(packets, ("file",))))
    return found.groupBy("file", "rule", "severity", F.array_join("evidence", " ").alias("evidence")).agg(F.count("*").alias("n"))


# --- event logs -------------------------------------------------------------------------------------------------

_ENCODED = "powershell.exe -enc " + "QUJD" * 8
#: Scenarios, one an event in turn: code, channel, provider, fields, and the rules that they meet, with severity.
_SCENARIOS = (
    (1102, "Security", "x", {"SubjectUserName": "eve"}, {"security_log_cleared": 90}),
    (104, "System", "x", {}, {"system_log_cleared": 90}),
    (104, "Other", "Microsoft-Windows-Eventlog", {}, {"system_log_cleared": 90}),
    (104, "Other", "x", {}, {}),
    (4769, "Security", "x", {"TicketEncryptionType": "0x17", "ServiceName": "MSSQLSvc/h"}, {"kerberoasting": 70}),
    (4768, "Security", "x", {"TicketEncryptionType": "0x3", "TargetUserName": "u"}, {"asrep_roasting": 70}),
    (4624, "Security", "x", {"LogonType": "10", "IpAddress": "10.0.0.1", "TargetUserName": "u"}, {"rdp_logon": 50}),
    (4624, "Security", "x", {"LogonType": "3", "IpAddress": "10.0.0.1", "TargetUserName": "u"}, {"network_logon": 30}),
    (4624, "Security", "x", {"LogonType": "3", "IpAddress": "-", "TargetUserName": "u"}, {}),
    (4648, "Security", "x", {"TargetUserName": "u"}, {"explicit_credential_logon": 50}),
    (4688, "Security", "x", {"NewProcessName": "C:\\W\\Certutil.exe", "CommandLine": ""}, {"lolbin_execution": 50}),
    (4688, "Security", "x", {"NewProcessName": "C:\\W\\x.exe", "CommandLine": _ENCODED}, {"encoded_powershell": 70}),
    (4688, "Security", "x", {"NewProcessName": "C:\\W\\x.exe", "CommandLine": "x IEX (y)"}, {"suspicious_cmdline": 50}),
    (4104, "PowerShell", "x", {"ScriptBlockText": "Invoke-Expression $a"}, {"suspicious_ps_script_block": 70}),
    (4698, "Security", "x", {"TaskName": "t"}, {"scheduled_task_created": 70}),
    (7045, "System", "x", {"ServiceName": "s"}, {"new_service": 70}),
    (4720, "Security", "x", {"TargetUserName": "n"}, {"account_created": 70}),
    (4732, "Security", "x", {"TargetUserName": "Readers"}, {"group_membership_change": 30}),
    (5140, "Security", "x", {"ShareName": "\\\\*\\ADMIN$"}, {"admin_share_access": 50}),
    (4672, "Security", "x", {"SubjectUserName": "bob"}, {"privileged_logon": 50}),
    (4672, "Security", "x", {"SubjectUserName": "SYSTEM"}, {}),
    (10, "Sysmon", "x", {"TargetImage": "C:\\Windows\\lsass.exe", "SourceImage": "a"}, {"lsass_access": 90}),
    (18, "Sysmon", "x", {"PipeName": "\\LSASS", "Image": "a"}, {"pipe_lsass_connect": 90}),
    (17, "Sysmon", "x", {"PipeName": "\\p", "Image": "C:\\Users\\Public\\a.exe"}, {"pipe_create_suspicious": 70}),
    (1116, "Defender", "x", {"Severity Name": "Low", "Threat Name": "a"}, {"defender_threat_detected": 70}),
    (1117, "Defender", "x", {"Threat Name": "a"}, {"defender_threat_actioned": 70}),
    (3, "Sysmon", "x", {"DestinationPort": "4444"}, {"sysmon_rare_port": 30}),
    (3, "Sysmon", "x", {"DestinationPort": "8080"}, {}),
    (2004, "Firewall", "x", {"SettingValue": "Off"}, {"firewall_disabled": 70}),
    (4740, "Security", "x", {"TargetUserName": "u"}, {"account_lockout": 30}),
    (4724, "Security", "x", {"TargetUserName": "u"}, {"password_reset": 50}),
    (4688, "Security", "x", {"NewProcessName": "a.exe", "ParentProcessName": "C:\\wmiprvse.exe"}, {"wmi_execution": 50}),
    (13, "Sysmon", "x", {"TargetObject": "HKLM\\S\\Run\\a"}, {"registry_persistence": 70}),
    (4776, "Security", "x", {"TargetUserName": "u"}, {"ntlm_auth": 30}),
    (8, "Sysmon", "x", {"SourceImage": "C:\\evil.exe"}, {"create_remote_thread": 90}),
    (8, "Sysmon", "x", {"SourceImage": "C:\\WerFault.exe"}, {}),
)
_LEAST = {"sysmon_rare_port": 3, "account_lockout": 3, "ntlm_auth": 5}
#: Where the first log holds a change of a sensitive group and a severe threat.
_SENSITIVE, _SEVERE = (next(i for i, s in enumerate(_SCENARIOS) if r in s[4]) for r in ("group_membership_change", "defender_threat_detected"))
_SCENARIO_ROWS = ", ".join(f"({i}, 'evtx.{r}', {s}, {_LEAST.get(r, 1)})" for i, x in enumerate(_SCENARIOS) for r, s in x[4].items())


def scenario_events(spark, sf_dir):
    maps = []
    for i, (_, _, _, fields, _) in enumerate(_SCENARIOS):
        pairs = dict(fields) or {"none": ""}
        first = F.col("user_id") % 3 == 0
        value = lambda k, v, i=i, first=first: F.when(first, "Domain Admins").otherwise(v) if i == _SENSITIVE else F.when(first, "Severe").otherwise(v) if (i, k) == (_SEVERE, "Severity Name") else F.lit(v)
        maps.append(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), value(k, v))]))
    n = F.col("event_id")
    which = (n % len(_SCENARIOS) + 1).cast("int")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("file"), n.alias("record_id"), pick(n, [s[0] for s in _SCENARIOS]).alias("event_id"),
        pick(n, [s[1] for s in _SCENARIOS]).alias("channel"), pick(n, [s[2] for s in _SCENARIOS]).alias("provider"), F.element_at(F.array(*maps), which).alias("fields"),
    )


@query(f"""WITH s(i, rule, severity, least) AS (VALUES {_SCENARIO_ROWS}), e AS (SELECT 'f' || (user_id % 3) AS file, user_id % 3 = 0 AS first, event_id AS record, event_id % {len(_SCENARIOS)} AS i FROM events),
 h AS (SELECT file, CASE WHEN e.i = {_SENSITIVE} AND first THEN 'evtx.sensitive_group_change' ELSE rule END AS rule, CASE WHEN e.i = {_SENSITIVE} AND first THEN 70 WHEN e.i = {_SEVERE} AND first THEN 90 ELSE severity END AS severity, least,
 CASE WHEN rule LIKE '%log_cleared' THEN record END AS record FROM e JOIN s ON e.i = s.i)
 SELECT file, rule, max(severity) AS severity, count(*) AS n FROM h GROUP BY file, rule, record, least HAVING count(*) >= least""")  # fmt: skip
def windows_rules_all(spark, sf_dir):
    return winevents.rule_findings(scenario_events(spark, sf_dir)).select("file", "rule", "severity", "n")
