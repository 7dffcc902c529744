"""Findings of captures: one row each, as a union of what the network operators report.

``packets`` has file, frame_no, ts, src_ip, src_port, dst_ip, dst_port, proto, size, tcp_flags; ``dns`` has file, ts,
is_response, qname, qtype, rcode, size; ``hellos`` has file, src_ip, dst_ip, dst_port, server_name, ja3. All rows of a
report are kept; readers that want the first few of a rule rank them by severity and evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import protocols
from quarrylens.operators import flows

# Severities.
LOW, MEDIUM, HIGH = 30, 50, 70
FILE = ("file",)


def finding(rows: DataFrame, rule: str | Column, severity: int | Column, category: str, *evidence: Column) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    shown = F.array_compact(F.array(*evidence)) if evidence else F.array().cast("array<string>")
    return rows.select("file", as_column(rule).alias("rule"), as_column(severity).alias("severity"), F.lit(category).alias("category"), shown.alias("evidence"))


def _arrow(a: str, b: str, port: str | None = None) -> Column:
    end = F.concat(F.lit(":"), F.col(port).cast("string")) if port else F.lit("")
    return F.concat(F.col(a), F.lit("->"), F.col(b), end)


def packet_findings(packets: DataFrame, **bounds) -> DataFrame:
    """Beacons, scans, one-sided uploads and ICMP tunnels. ``bounds`` overrides thresholds by operator: {"port_scans": {...}}."""
    of = lambda name: bounds.get(name, {})
    flow = flows.flows(packets, FILE)
    # A flow's beacon is that of the side that began it.
    begun = flow.select("file", F.col("a_ip").alias("src_ip"), F.col("a_port").alias("src_port"), F.col("b_ip").alias("dst_ip"), F.col("b_port").alias("dst_port"), "proto")
    keys = ["file", "src_ip", "src_port", "dst_ip", "dst_port", "proto"]
    beacons = flows.beacons(packets.join(begun, keys, "left_semi"), keys, "ts", "frame_no", **of("beacons"))
    parts = [
        finding(beacons, "pcap.beaconing", HIGH, "c2", _arrow("src_ip", "dst_ip", "dst_port")),
        finding(flows.port_scans(packets, by=FILE, **of("port_scans")), "pcap.port_scan", MEDIUM, "recon", _arrow("src_ip", "dst_ip")),
        finding(flows.host_sweeps(packets, by=FILE, **of("host_sweeps")), "pcap.host_sweep", MEDIUM, "recon", F.concat(F.col("src_ip"), F.lit("->:"), F.col("dst_port").cast("string"))),
        finding(flows.one_sided(flow, **of("one_sided")), "pcap.unidirectional_exfil", HIGH, "exfiltration", _arrow("a_ip", "b_ip", "b_port")),
        finding(flows.icmp_tunnels(packets, by=FILE, **of("icmp_tunnels")), "pcap.icmp_tunnel", HIGH, "c2", _arrow("src_ip", "dst_ip")),
    ]
    return _union(parts)


def dns_findings(dns: DataFrame, durations: DataFrame, **bounds) -> DataFrame:
    """Generated names, channels and failing lookups; ``durations(file, seconds)`` are those of the captures."""
    of = lambda name: bounds.get(name, {})
    stats = flows.dns_stats(dns, FILE)
    names = flows.generated_names(dns, FILE, **of("generated_names"))
    many = F.col("many")
    generated = names.select("file", F.when(many, "pcap.dga_dns").otherwise("pcap.dga_dns_outlier").alias("rule"), F.when(many, HIGH).otherwise(LOW).alias("severity"), F.lit("c2").alias("category"), F.col("names").alias("evidence"))
    return _union([
        generated,
        finding(flows.txt_volume(stats, **of("txt_volume")), "pcap.dns_tunneling_txt_volume", HIGH, "c2"),
        finding(flows.busy_labels(dns, durations, FILE, **of("busy_labels")), "pcap.dns_tunneling_query_rate", HIGH, "c2", F.col("sld")),
        finding(flows.nxdomain_ratio(stats, **of("nxdomain_ratio")), "pcap.high_nxdomain_ratio", MEDIUM, "c2"),
    ])


def tls_findings(hellos: DataFrame) -> DataFrame:
    """Known client fingerprints, and hellos on odd ports or without a server's name."""
    known = hellos.withColumn("label", protocols.known_ja3(F.col("ja3"))).where("label is not null")
    odd = hellos.withColumn("kind", protocols.tls_anomaly(F.col("dst_port"), F.col("server_name"))).where("kind is not null")
    return _union([
        finding(known, "pcap.ja3_known_bad", MEDIUM, "c2", F.col("ja3"), F.col("label")),
        finding(odd, F.concat(F.lit("pcap.tls_"), "kind"), F.when(F.col("kind") == "no_sni", LOW).otherwise(MEDIUM), "c2", _arrow("src_ip", "dst_ip", "dst_port")),
    ])


def agent_findings(requests: DataFrame) -> DataFrame:
    """``requests(file, user_agent)`` of known agents, and ``basic_auth`` in plain text where that column is true."""
    odd = requests.withColumn("label", protocols.bad_agent(F.col("user_agent"))).where("label is not null")
    shown = F.when(F.col("user_agent") == "", "<empty>").otherwise(F.col("user_agent"))
    return _union([finding(odd, "pcap.suspicious_user_agent", MEDIUM, "c2", shown), finding(requests.where("basic_auth"), "pcap.plaintext_http_basic", HIGH, "credentials", _arrow("src_ip", "dst_ip", "dst_port"))])


def server_findings(servers: DataFrame) -> DataFrame:
    """Known fingerprints of ``servers(file, ja3s)``."""
    known = servers.withColumn("label", protocols.known_ja3(F.col("ja3s"), server=True)).where("label is not null")
    return finding(known, "pcap.ja3s_known_bad", MEDIUM, "c2", F.col("ja3s"), F.col("label"))


def share_findings(shares: DataFrame) -> DataFrame:
    """Administrative shares and the first dialect, of ``shares(file, src_ip, dst_ip, dialect, path)``; each is named once."""
    admin = shares.where(protocols.is_admin_share(F.col("path"))).select("file", "src_ip", "dst_ip", "path").distinct()
    old = shares.where("dialect = 'SMB1'").select("file", "src_ip", "dst_ip").distinct()
    return _union([
        finding(admin, "pcap.smb_admin_share", HIGH, "lateral_movement", F.col("path"), _arrow("src_ip", "dst_ip")),
        finding(old, "pcap.smb1_in_use", MEDIUM, "anomaly", _arrow("src_ip", "dst_ip")),
    ])


def ticket_findings(tickets: DataFrame) -> DataFrame:
    """Of ``tickets(file, client, service, realm, message, etype, etypes, preauth)``: roasting and weak offers."""
    roast = tickets.where(protocols.is_kerberoastable(F.col("message"), F.col("etype"), F.col("service")))
    open_ = tickets.where(protocols.is_asrep_roastable(F.col("message"), F.col("preauth")))
    weak = tickets.where(protocols.is_rc4_downgrade(F.col("message"), F.col("etypes")))
    return _union([
        finding(roast, "pcap.kerberoasting", HIGH, "credentials", F.col("service"), F.col("realm")),
        finding(open_, "pcap.asrep_roasting", HIGH, "credentials", F.col("client"), F.col("realm")),
        finding(weak, "pcap.kerberos_rc4_downgrade", MEDIUM, "c2", F.col("client"), F.col("realm")),
    ])


def credential_findings(responses: DataFrame, logins: DataFrame) -> DataFrame:
    """Of ``responses(file, user, domain, challenge, response)`` and ``logins(file, src_ip, dst_ip, verb, value)`` in plain text."""
    line = protocols.netntlmv2(*[F.col(c) for c in ("user", "domain", "challenge", "response")])
    taken = responses.withColumn("line", line).where("line is not null")
    return _union([finding(taken, "pcap.netntlmv2_capture", HIGH, "credentials", F.col("line")), finding(logins, "pcap.plaintext_ftp_creds", HIGH, "credentials", _arrow("src_ip", "dst_ip"))])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
