"""Scores, caches, correlations, flows, event rules and outputs on small rows."""

from pyspark.sql import functions as F

from quarrylens.operators import correlate, enrich, flows, scoring, winevents
from quarrylens.sinks import rules
from quarrylens.sources import feeds


def verdict(spark, rows):
    df = spark.createDataFrame([("x", *r) for r in rows], "k string, weight double, verdict string, score double, error string")
    return tuple(scoring.score(df, ["k"]).first())[1:]


def test_scores(spark):
    assert verdict(spark, [(1.0, "unknown", 0.0, "down")]) == ("unknown", 0.0)
    assert verdict(spark, [(0.9, "malicious", 0.95, None), (0.8, "malicious", 0.9, None), (0.75, "malicious", 0.8, None)])[0] == "malicious"
    v, c = verdict(spark, [(0.9, "malicious", 0.95, None), (0.8, "unknown", 0.0, None), (0.75, "unknown", 0.0, None)])
    assert v == "malicious" and abs(c - 0.9 * 0.95 / 2.45) < 1e-9
    assert verdict(spark, [(0.9, "suspicious", 0.5, None), (0.8, "unknown", 0.0, None)])[0] == "suspicious"
    assert verdict(spark, [(0.9, "benign", 0.0, None), (0.8, "benign", 0.0, None)]) == ("benign", 1.0)


def test_cache_upsert_keeps_the_newest_and_no_errors(spark):
    cache = spark.createDataFrame([("a", "ipv4", "1.1.1.1", "old", 10, 20)], "source string, ioc_type string, ioc_value string, payload string, cached_at long, expires_at long")
    results = spark.createDataFrame([("a", "ipv4", "1.1.1.1", "new", None), ("b", "ipv4", "1.1.1.1", "bad", "timeout")], "source string, ioc_type string, ioc_value string, payload string, error string")
    assert [tuple(r) for r in enrich.upsert(cache, results, 100, 5).collect()] == [("a", "ipv4", "1.1.1.1", "new", 100, 105)]
    assert enrich.purge(cache, 20).count() == 0


def test_correlations(spark):
    rows = [(i, "ipv4", v, t) for i, (v, t) in enumerate([("192.0.2.11", ["stealer-x"]), ("192.0.2.12", ["stealer-x"]), ("192.0.2.13", ["country:FR"]), ("198.51.100.4", ["stealer-x", "country:FR"])])]
    df = spark.createDataFrame(rows, "pos int, type string, value string, tags array<string>")
    assert correlate.shared_subnet(df).count() == 3
    assert correlate.shared_tag(df, all_pairs=True).count() == 3
    assert {(r["source"], r["target"]) for r in correlate.shared_tag(df).collect()} == {("192.0.2.11", "192.0.2.12"), ("192.0.2.11", "198.51.100.4")}
    same = spark.createDataFrame([(0, "ipv4", "192.0.2.4", []), (1, "ipv4", "192.0.2.004", []), (2, "ipv4", "192.0.2.5", [])], "pos int, type string, value string, tags array<string>")
    assert [(r["source"], r["target"]) for r in correlate.shared_subnet(same).collect()] == [("192.0.2.4", "192.0.2.5")]


def test_beacon_needs_even_intervals(spark):
    even = [("a", i, 60.0 * i + 0.05 * (i % 3)) for i in range(10)]
    few = [("b", i, 60.0 * i) for i in range(3)]
    df = spark.createDataFrame(even + few, "k string, n int, ts double")
    found = flows.beacons(df, ["k"], "ts", "n").collect()
    assert [r["k"] for r in found] == ["a"] and abs(found[0]["mean"] - 60) < 0.1


def test_flow_side_a_sent_first(spark):
    rows = [(1, 1.0, "b", 5, "a", 80, 6, 10, 2), (2, 2.0, "a", 80, "b", 5, 6, 7, 18), (3, 3.0, "b", 5, "a", 80, 6, 1, 1)]
    df = spark.createDataFrame(rows, "frame_no int, ts double, src_ip string, src_port int, dst_ip string, dst_port int, proto int, size int, tcp_flags int")
    f = flows.flows(df).collect()
    assert len(f) == 1
    r = f[0]
    assert (r["a_ip"], r["b_port"], r["packets_a2b"], r["bytes_b2a"], r["saw_synack"], r["saw_rst"]) == ("b", 80, 2, 7, True, False)


def test_event_rules(spark):
    def event(n, code, **fields):
        return ("f", n, code, "Security", "x", fields)

    rows = [event(1, 1102, SubjectUserName="eve"), event(2, 4688, NewProcessName="C:\\W\\certutil.exe", CommandLine="powershell -enc " + "A" * 24)]
    rows += [event(3, 4769, TicketEncryptionType="0x00000017", ServiceName="MSSQLSvc/x"), event(4, 4769, TicketEncryptionType="0x17", ServiceName="host$"), event(5, 4740, TargetUserName="u")]
    rows += [event(10 + i, 4625, TargetUserName=f"u{i % 7}", IpAddress="10.0.0.9") for i in range(70)] + [event(99, 4624, TargetUserName="u1", LogonType="2")]
    df = spark.createDataFrame(rows, "file string, record_id int, event_id int, channel string, provider string, fields map<string,string>")
    found = {r["rule"]: r["n"] for r in winevents.rule_findings(df).collect()}
    assert found == {"evtx.security_log_cleared": 1, "evtx.lolbin_execution": 1, "evtx.encoded_powershell": 1, "evtx.kerberoasting": 1}
    assert winevents.brute_force(df).count() == 7 and winevents.password_spray(df).first()["n_users"] == 7
    assert [r["user"] for r in winevents.success_after_failures(df).collect()] == ["u1"]


def test_outputs(spark):
    df = spark.createDataFrame([("ipv4", "1.2.3.4", "malicious", 0.85), ("url", "http://x.org/a;b", "malicious", 0.5), ("cve", "CVE-2020-1", "malicious", 1.0), ("domain", "it's.org", "suspicious", 0.125)], "type string, value string, verdict string, confidence double")
    stix = {r["pattern"]: r["confidence"] for r in rules.stix(df).collect()}
    assert stix["[domain-name:value = 'it\\'s.org']"] == 12 and len(stix) == 3
    sids = {r["sid"]: r["rule"] for r in rules.suricata(df, buckets=2).collect()}
    assert sorted(sids) == [1_000_001, 1_000_002] and r'content:"/a\;b"' in sids[1_000_002]
    assert rules.threat_level(df).first()[0] == "1" and rules.misp(df).count() == 3


def test_feeds(spark):
    payload = '{"data":{"attributes":{"last_analysis_stats":{"malicious":6,"suspicious":0,"harmless":4,"undetected":0}}}}'
    df = spark.createDataFrame([(payload,), ("no json",), (None,)], "p string")
    got = [tuple(r["r"]) for r in df.select(feeds.interpret("virustotal", df["p"]).alias("r")).collect()]
    assert got == [("malicious", 0.6), ("unknown", 0.0), ("unknown", 0.0)]


def test_event_evidence_is_bounded_and_cleared_logs_stand_alone(spark):
    rows = [("f", i, 4698, "Security", "x", {"TaskName": f"t{i:03d}"}) for i in range(60)] + [("f", 100 + i, 1102, "Security", "x", {"SubjectUserName": "eve"}) for i in range(3)]
    rows += [("f", 200, 4728, "Security", "x", {"TargetUserName": "Readers"}), ("f", 201, 4728, "Security", "x", {"TargetUserName": "Domain Admins"}), ("g", 1, 4728, "Security", "x", {"TargetUserName": "Readers"})]
    rows += [("g", 2, 1116, "Defender", "x", {"Severity Name": "Low"}), ("g", 3, 1116, "Defender", "x", {"Severity Name": "Severe"})]
    df = spark.createDataFrame(rows, "file string, record_id int, event_id int, channel string, provider string, fields map<string,string>")
    got = winevents.rule_findings(df).collect()
    assert [r["evidence"] for r in got if r["rule"] == "evtx.scheduled_task_created"] == [[f"t{i:03d}" for i in range(20)]]
    assert [(r["n"], r["evidence"]) for r in got if r["rule"] == "evtx.security_log_cleared"] == [(1, ["eve"])] * 3
    assert {(r["file"], r["rule"]) for r in got if "group" in r["rule"]} == {("f", "evtx.sensitive_group_change"), ("g", "evtx.group_membership_change")}
    assert [(r["severity"], r["n"]) for r in got if "defender" in r["rule"]] == [(90, 2)]


def test_parts_of_a_hot_flow_carry_over(spark):
    rows = [("a" if i % 3 else None, i, 10.0 * i + (i % 2) * 0.1, i if i % 7 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, n int, ts double, challenge int")
    part = (F.col("n") / 16).cast("int")
    plain, cut = (sorted(map(str, flows.last_challenge(df, ["k"], "n", p).collect())) for p in (None, part))
    assert plain == cut
    plain, cut = ([tuple(r) for r in flows.beacons(df, ["k"], "ts", "n", cv=0.5, part=p).orderBy("k").collect()] for p in (None, part))
    assert [r[:2] for r in plain] == [r[:2] for r in cut] and all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(plain, cut, strict=True)) and len(plain) == 2


def test_every_emitted_rule_has_techniques_or_none_on_purpose():
    """Names of rules are read off the modules that emit them."""
    import re
    from pathlib import Path

    from quarrylens.operators import findings

    folder = Path(findings.__file__).parent
    text = {m: (folder / f"{m}.py").read_text() for m in ("captures", "symbols", "winevents", "markers", "rollup")}
    emitted = set(re.findall(r'"((?:pcap|combo|pe|evtx|embedded|shellcode|c2|archive)\.[a-z0-9_]+)"', "".join(text.values())))
    emitted |= {f"evtx.{n}" for n in re.findall(r'\(\s*"([a-z0-9_]+)", (?:CRITICAL|HIGH|MEDIUM|LOW|INFO|F\.when)', text["winevents"])} | {"pcap.tls_no_sni", "pcap.tls_non_standard_port"}
    emitted.discard("pcap.tls_")
    assert len(emitted) > 85
    assert emitted == emitted & (set(findings.TECHNIQUES) | set(findings.WITHOUT_TECHNIQUE)), emitted - set(findings.TECHNIQUES)
    assert not set(findings.TECHNIQUES) & set(findings.WITHOUT_TECHNIQUE)


def test_scores_do_not_depend_on_the_order_of_sums(spark):
    """0.1 + 0.2 + 0.3 is 0.6 in one order and more in the other; a share of exactly a quarter is malicious in both."""
    from quarrylens.operators import scoring

    hits = [0.1, 0.2, 0.3]
    rows = [(key, w, "malicious", 1.0, None) for key, ws in (("a", hits), ("b", hits[::-1])) for w in ws] + [(key, 1.8, "unknown", 0.0, None) for key in "ab"]
    rows += [("nan", 1.0, "malicious", float("nan"), None), ("nan", 1.0, "benign", None, None)]
    df = spark.createDataFrame(rows, "ioc string, weight double, verdict string, score double, error string").coalesce(1)
    got = {r["ioc"]: (r["verdict"], r["confidence"]) for r in scoring.score(df, ["ioc"]).collect()}
    assert got == {"a": ("malicious", 0.25), "b": ("malicious", 0.25), "nan": ("benign", 0.5)}


def test_scores_add_hits_in_a_given_order(spark):
    """As doubles, 0.7 and 0.1 make a little less than 0.8, and three hits another sum backwards; weights stay exact."""
    from quarrylens.operators import scoring

    hits = [0.1, 0.2, 0.3]
    rows = [("below", 1, 0.7, "malicious"), ("below", 2, 0.1, "malicious"), ("below", 3, 2.4, "unknown")]
    rows += [(key, i, w, "malicious") for key, ws in (("up", hits), ("down", hits[::-1])) for i, w in enumerate(ws)] + [(key, 3, 0.6, "unknown") for key in ("up", "down")]
    rows += [("exact", i, w, "benign" if i == 0 else "unknown") for i, w in enumerate([0.36, 0.1, 0.2, 0.3, 0.24])]
    df = spark.createDataFrame(rows[::-1], "ioc string, ord int, weight double, verdict string").selectExpr("*", "1.0D AS score", "CAST(null AS string) AS error")
    got = {r["ioc"]: (r["verdict"], r["confidence"]) for r in scoring.score(df, ["ioc"], "ord").collect()}
    assert got["below"] == ("suspicious", (0.7 + 0.1) / 3.2) and got["below"][1] < 0.25
    assert got["up"] == ("malicious", (0.1 + 0.2 + 0.3) / 1.2) and got["down"] == ("malicious", (0.3 + 0.2 + 0.1) / 1.2) and got["up"] != got["down"]
    assert got["exact"] == ("benign", 0.36 / 1.2)


def test_findings_are_dealt_out_by_path_once(spark, capsys):
    from quarrylens.operators import findings

    df = spark.createDataFrame([(1, "pcap.beaconing"), (1, "pcap.beaconing"), (2, "pcap.beaconing"), (2, "none.such"), (None, "none.such")], "path long, rule string")
    dealt = findings.by_path(df, 2 * findings.PART_ROWS + 1)
    assert dealt.rdd.getNumPartitions() == 3 and findings.by_path(df, 0).rdd.getNumPartitions() == 1
    got = {r["rule"]: (r["n_paths"], len(r["mitre"])) for r in findings.rule_counts(dealt, findings.techniques(spark)).collect()}
    assert got == {"pcap.beaconing": (2, 3), "none.such": (1, 0)}
    tagged = findings.tag(dealt, findings.techniques(spark).hint("broadcast"))
    assert {r["path"]: r["techniques"] for r in findings.coverage(tagged).collect()} == {1: ["T1029", "T1071.001", "T1573"], 2: ["T1029", "T1071.001", "T1573"]}
    findings.coverage(tagged).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_scores_count_results_without_a_place_in_the_order(spark):
    """Hits whose place is missing or shared are added too, smaller ones first."""
    from quarrylens.operators import scoring

    rows = [("none", None, 1.0, "malicious"), ("none", None, 1.0, "unknown")]
    rows += [("some", None, 0.3, "malicious"), ("some", 1, 0.2, "malicious"), ("some", 2, 0.7, "unknown")]
    rows += [(key, 1, w, "malicious") for key, ws in (("up", [0.1, 0.2, 0.3]), ("down", [0.3, 0.2, 0.1])) for w in ws] + [(key, 1, 0.6, "unknown") for key in ("up", "down")]
    df = spark.createDataFrame(rows, "ioc string, ord int, weight double, verdict string").selectExpr("*", "1.0D AS score", "CAST(null AS string) AS error").coalesce(1)
    got = {r["ioc"]: (r["verdict"], r["confidence"]) for r in scoring.score(df, ["ioc"], "ord").collect()}
    assert got["none"] == ("malicious", 0.5) and got["some"] == ("malicious", (0.3 + 0.2) / 1.2)
    assert got["up"] == got["down"] == ("malicious", (0.1 + 0.2 + 0.3) / 1.2)
