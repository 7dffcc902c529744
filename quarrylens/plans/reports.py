"""Queries of reports, rules for other tools, exit lists and weights; see ``catalog`` for how tables are derived."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import enrich, findings, rollup, scoring
from quarrylens.plans import catalog
from quarrylens.plans.registry import pick, pick_sql, place, query, quoted, table
from quarrylens.sinks import reports, rules
from quarrylens.sources import feeds


# --- reports ----------------------------------------------------------------------------------------------------

#: As in the catalogue, but every indicator has an address of its own.
_VERDICTS_SQL = catalog._VERDICTS_SQL.replace("'10.1.' || (ioc % 200)", "'10.' || (ioc // 200 + 1) || '.' || (ioc % 200)")


def _verdicts(spark, sf_dir):
    ip = F.concat_ws(".", F.lit("10"), F.expr("string(ioc div 200 + 1)"), (F.col("ioc") % 200).cast("string"), F.lit("7"))
    v = catalog._verdicts(spark, sf_dir)
    return v.withColumn("value", F.when(F.col("type") == "ipv4", ip).otherwise(F.col("value")))


#: A little is added before rounding, since sums in another order may fall to either side of a tie.
_TAGGED_SQL = _VERDICTS_SQL + ", y AS (SELECT *, ['t' || (ioc % 3), 'kit'] AS tags, CASE WHEN ioc % 2 = 0 THEN ['https://r.org/' || ioc] ELSE CAST([] AS VARCHAR[]) END AS refs FROM x)"
_SAID_SQL = ", q AS (SELECT ioc, ord, source, verdict, score, error FROM r)"


def _tagged(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    links = F.when(F.col("ioc") % 2 == 0, F.array(F.concat(F.lit("https://r.org/"), F.col("ioc").cast("string")))).otherwise(F.array().cast("array<string>"))
    return v.withColumn("confidence", F.round(F.col("confidence") + 1e-9, 4)).withColumn("tags", F.array(F.concat(F.lit("t"), (F.col("ioc") % 3).cast("string")), F.lit("kit"))).withColumn("references", links)


def _said(spark, sf_dir):
    keys = _verdicts(spark, sf_dir).select("ioc", "type", "value")
    results = catalog.source_results(spark, sf_dir).select("ioc", "ord", "source", "verdict", "score", F.when(F.col("ord") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("tags"), "error")
    return results.join(keys, "ioc").drop("ioc")


@query(
    _TAGGED_SQL + _SAID_SQL + """, s AS (SELECT ioc, string_agg('{"source":"' || source || '","verdict":"' || verdict || '","score":' || CAST(score AS VARCHAR) || ',"tags":' || CASE WHEN ord % 2 = 0 THEN '["a","b"]' ELSE '[]' END || ',"error":' || CASE WHEN error IS NULL THEN 'null' ELSE '"' || error || '"' END || '}', ',' ORDER BY ord) AS j FROM q GROUP BY ioc)
 SELECT type, value, '{"value":"' || value || '","type":"' || type || '","verdict":"' || verdict || '","confidence":' || CAST(round(confidence + 1e-9, 4) AS VARCHAR) || ',"tags":["' || tags[1] || '","kit"],"references":[' || CASE WHEN len(refs) > 0 THEN '"' || refs[1] || '"' ELSE '' END || '],"sources":[' || s.j || ']}' AS json FROM y JOIN s ON y.ioc = s.ioc"""
)
def report_json(spark, sf_dir):
    return reports.json_rows(_tagged(spark, sf_dir), _said(spark, sf_dir))


@query(
    _TAGGED_SQL + _SAID_SQL + """, s AS (SELECT ioc, string_agg('| ' || source || ' | ' || CASE WHEN error IS NULL THEN verdict ELSE 'error' END || ' | ' || printf('%.2f', score) || ' | ' || CASE WHEN error IS NOT NULL THEN error WHEN ord % 2 = 0 THEN 'a, b' ELSE '' END || ' |', chr(10) ORDER BY ord) AS j FROM q GROUP BY ioc)
 SELECT type, value, '### `' || replace(replace(replace(value, 'http://', 'hxxp://'), '.', '[.]'), '@', '[@]') || '` — ' || type || ' — **' || upper(verdict) || '** (' || CAST(round_even(round(confidence + 1e-9, 4) * 100, 0) AS INT) || '%)' || chr(10) || chr(10) || '**Tags:** ' || tags[1] || ', kit' || chr(10) || chr(10)
 || '| Source | Verdict | Score | Notes |' || chr(10) || '| ------ | ------- | ----- | ----- |' || chr(10) || s.j || CASE WHEN len(refs) > 0 THEN chr(10) || chr(10) || '**References:**' || chr(10) || '- ' || refs[1] ELSE '' END AS section FROM y JOIN s ON y.ioc = s.ioc"""
)
def report_markdown(spark, sf_dir):
    return reports.markdown_rows(_tagged(spark, sf_dir), _said(spark, sf_dir)).select("type", "value", "section")


@query(_VERDICTS_SQL + ", n(rank, verdict) AS (VALUES (0, 'malicious'), (1, 'suspicious'), (2, 'benign'), (3, 'unknown')) SELECT n.rank AS rank, n.verdict AS verdict, count(x.ioc) AS n FROM n LEFT JOIN x ON n.verdict = x.verdict GROUP BY 1, 2")
def report_counts(spark, sf_dir):
    return reports.counts(_verdicts(spark, sf_dir))


@query(
    f"""WITH f AS (SELECT l_orderkey AS path, l_linenumber AS n, {pick_sql('l_partkey', catalog._RULE_NAMES)} AS rule, {pick_sql('l_suppkey', catalog._SEVERITIES)} AS severity, 'e' || l_linenumber AS e FROM lineitem)
 SELECT path, rule, '- **' || rule || '** (' || severity || ', c2): ' || e || ', x' AS line, '{{"path":' || path || ',"rule":"' || rule || '","severity":' || severity || ',"category":"c2","evidence":["' || e || '","x"]}}' AS json FROM f"""
)
def report_findings(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), pick(F.col("l_partkey"), catalog._RULE_NAMES).alias("rule"), pick(F.col("l_suppkey"), catalog._SEVERITIES).alias("severity"), F.lit("c2").alias("category"), F.array(F.concat(F.lit("e"), F.col("l_linenumber").cast("string")), F.lit("x")).alias("evidence"))
    return reports.finding_rows(found)


# --- rules for other tools --------------------------------------------------------------------------------------

@query(_VERDICTS_SQL + """, s AS (SELECT *, row_number() OVER (ORDER BY type, value) + 1000000 AS sid FROM x WHERE verdict IN ('suspicious', 'malicious') AND type <> 'md5')
 SELECT sid, CASE type WHEN 'ipv4' THEN 'alert ip any any -> ' || value || ' any (msg:"Indicator: ipv4 ' || value || ' (' || verdict || ')"; sid:' || sid || '; rev:1; classtype:trojan-activity;)'
 WHEN 'domain' THEN 'alert dns any any -> any any (msg:"Indicator: domain ' || value || ' (' || verdict || ')"; dns.query; content:"' || value || '"; nocase; sid:' || sid || '; rev:1; classtype:trojan-activity;)'
 ELSE 'alert http any any -> any any (msg:"Indicator: url ' || value || ' (' || verdict || ')"; http.host; content:"h' || ioc || '.example.com"; nocase; http.uri; content:"/a?b=1"; nocase; sid:' || sid || '; rev:1; classtype:trojan-activity;)' END AS rule FROM s""")
def suricata_all(spark, sf_dir):
    """All three kinds of rules, addresses included."""
    return rules.suricata(_verdicts(spark, sf_dir), "suspicious", buckets=8)


@query(_VERDICTS_SQL + " SELECT CASE max(CASE verdict WHEN 'malicious' THEN 2 WHEN 'suspicious' THEN 1 ELSE 0 END) WHEN 2 THEN '1' WHEN 1 THEN '2' ELSE '4' END AS threat_level FROM x")
def worst_threat(spark, sf_dir):
    return rules.threat_level(_verdicts(spark, sf_dir))


# --- sources ----------------------------------------------------------------------------------------------------


@query(
    "WITH e AS (SELECT DISTINCT '185.220.' || s_nationkey || '.' || (s_suppkey % 256) AS v FROM supplier WHERE s_suppkey % 10 <> 0), i AS (SELECT c_custkey, '185.220.' || c_nationkey || '.' || (c_custkey % 256) AS v FROM customer) "
    "SELECT c_custkey, i.v AS value, 'tor_exit' AS source, CASE WHEN e.v IS NULL THEN 'unknown' ELSE 'suspicious' END AS verdict, CASE WHEN e.v IS NULL THEN 0.0 ELSE 0.5 END AS score, CASE WHEN e.v IS NULL THEN '' ELSE 'tor,anonymizer' END AS tags FROM i LEFT JOIN e ON i.v = e.v"
)
def tor_exits(spark, sf_dir):
    ip = lambda net, host: F.concat_ws(".", F.lit("185"), F.lit("220"), F.col(net).cast("string"), (F.col(host) % 256).cast("string"))
    lines = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("# "), ip("s_nationkey", "s_suppkey"))).otherwise(F.concat(ip("s_nationkey", "s_suppkey"), F.lit(" \t"))).alias("value"))
    iocs = table(spark, sf_dir, "customer").select("c_custkey", F.lit("ipv4").alias("type"), ip("c_nationkey", "c_custkey").alias("value"))
    said = feeds.exit_results(iocs.select("type", "value").distinct(), feeds.exit_addresses(lines))
    return iocs.join(said, ["type", "value"]).select("c_custkey", "value", "source", "verdict", "score", F.array_join("tags", ",").alias("tags"))


_NAMED = [s[0] for s in enrich.SOURCES]
_WEIGHTS = ", ".join(f"({quoted(s)}, {w})" for s, w, *_ in enrich.SOURCES)


@query(
    f"WITH d(source, weight) AS (VALUES {_WEIGHTS}), r AS (SELECT o_custkey AS ioc, {pick_sql('o_orderkey', _NAMED)} AS source, CASE WHEN o_orderkey % 8 = 0 THEN 'malicious' WHEN o_orderkey % 8 IN (1, 2) THEN 'suspicious' WHEN o_orderkey % 8 = 3 THEN 'benign' ELSE 'unknown' END AS verdict, (o_orderkey % 100) / 100.0 AS score, CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' END AS error FROM orders), "
    + catalog._SCORE_SQL.split("), g AS", 1)[1].join(["j AS (SELECT r.ioc AS ioc, d.weight AS weight, r.verdict AS verdict, r.score AS score, r.error AS error FROM r JOIN d ON r.source = d.source), g AS", ""]).replace("FROM r GROUP BY", "FROM j GROUP BY")
    + " SELECT ioc, verdict, round(confidence, 6) AS confidence FROM v"
)
def weighted_scores(spark, sf_dir):
    """Results that name their source, joined with the table of sources for its weight."""
    k = F.col("o_orderkey") % 8
    verdict = F.when(k == 0, "malicious").when(k.isin(1, 2), "suspicious").when(k == 3, "benign").otherwise("unknown")
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ioc"), place().alias("place"), pick(F.col("o_orderkey"), _NAMED).alias("source"), verdict.alias("verdict"), ((F.col("o_orderkey") % 100) / 100.0).alias("score"), F.when(F.col("o_orderkey") % 17 == 0, "timeout").alias("error"))
    return scoring.score(said.join(enrich.sources(spark).select("source", "weight"), "source"), ["ioc"], "place").withColumn("confidence", catalog.rounded("confidence"))


@query("SELECT p_brand, md5(lower(string_agg('lib' || (p_size % 5) || '.' || CASE WHEN p_partkey % 3 = 0 THEN 'ord' || p_partkey ELSE p_name END, ',' ORDER BY p_partkey))) AS imphash FROM part GROUP BY p_brand")
def import_ordinals(spark, sf_dir):
    symbol = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("#"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    library = F.concat(F.lit("LIB"), (F.col("p_size") % 5).cast("string"), pick(F.col("p_partkey"), (".DLL", ".ocx", ".sys")))
    lists = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", library.alias("library"), symbol.alias("symbol")))).alias("l"))
    return lists.select("p_brand", findings.import_hash(F.col("l")).alias("imphash"))


# --- members of archives ------------------------------------------------------------------------------------------

_LIMITS = {"member_bytes": 900_000, "total_bytes": 30_000_000, "bomb_ratio": 200, "bomb_bytes": 100_000}
_MEMBERS = """m AS (SELECT 'a' || (event_id % 20) AS file, k AS id, CASE WHEN k = 0 THEN NULL WHEN k % 97 = 50 THEN k ELSE (k - 1) // 4 END AS parent, (k - 1) % 4 AS position, CASE WHEN k = 0 THEN 0 ELSE (k * 7919 % 1000) * 1000 END AS size,
  (k * 7919 % 1000) * 1000 // (k % 250 + 1) AS packed, k % 11 = 5 AS encrypted, CASE WHEN k % 13 = 7 THEN 'malicious' WHEN k % 17 = 3 THEN 'suspicious' ELSE 'clean' END AS verdict FROM (SELECT event_id, event_id // 20 AS k FROM events)),
b AS MATERIALIZED (SELECT *, size >= 100000 AND size >= 200 * greatest(packed, 1) AS bomb FROM m),
w AS (SELECT file, id, 0 AS depth, CAST([] AS BIGINT[]) AS path, [id] AS ids FROM b WHERE parent IS NULL
  UNION ALL SELECT x.file, x.id, w.depth + 1, list_append(w.path, x.position), list_append(w.ids, x.id) FROM w JOIN b x ON x.file = w.file AND x.parent = w.id JOIN b o ON o.file = w.file AND o.id = w.id WHERE w.depth <= 4 AND (o.parent IS NULL OR NOT (o.bomb OR o.encrypted OR o.size > 900000))),
j AS (SELECT b.file AS file, b.id AS id, size, bomb, encrypted, verdict, depth, path, ids FROM b LEFT JOIN w ON b.file = w.file AND b.id = w.id),
c AS (SELECT *, CASE WHEN depth BETWEEN 1 AND 4 AND NOT bomb AND NOT encrypted THEN least(size, 900000) ELSE 0 END AS cost FROM j),
d AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY file, depth BETWEEN 1 AND 4 ORDER BY path[:-2], path[-1], id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
e AS (SELECT *, CASE WHEN depth BETWEEN 1 AND 4 AND NOT bomb AND NOT encrypted THEN greatest(0, least(size, 900000, 30000000 - before)) ELSE 0 END AS taken FROM d),
s AS (SELECT file, id, depth, ids, verdict, CAST(taken AS BIGINT) AS taken, CASE WHEN depth IS NULL THEN 'unreached' WHEN depth = 0 THEN 'file' WHEN depth > 4 THEN 'depth' WHEN encrypted THEN 'encrypted' WHEN bomb THEN 'bomb' WHEN taken = size THEN 'read' WHEN taken > 0 THEN 'partial' ELSE 'budget' END AS status FROM e),
u AS (SELECT file, id AS own, unnest(ids) AS id, CASE verdict WHEN 'malicious' THEN 2 WHEN 'suspicious' THEN 1 ELSE 0 END AS rank, taken FROM s WHERE status IN ('file', 'read', 'partial')),
v AS (SELECT file, id, CASE max(rank) WHEN 2 THEN 'malicious' WHEN 1 THEN 'suspicious' ELSE 'clean' END AS verdict, count(*) FILTER (own <> id) AS members, CAST(coalesce(sum(taken) FILTER (own <> id), 0) AS BIGINT) AS bytes FROM u GROUP BY file, id)"""


def _expanded(spark, sf_dir):
    """Trees of members, four to an archive, with bombs, encrypted ones and members that are their own parents."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 20).alias("f"), F.floor(F.col("event_id") / 20).alias("k"))
    k = F.col("k")
    size = F.when(k == 0, 0).otherwise(k * 7919 % 1000 * 1000)
    parent = F.when(k == 0, None).when(k % 97 == 50, k).otherwise(F.floor((k - 1) / 4))
    verdict = F.when(k % 13 == 7, "malicious").when(k % 17 == 3, "suspicious").otherwise("clean")
    packed = F.floor(k * 7919 % 1000 * 1000 / (k % 250 + 1))
    rows = e.select(F.concat(F.lit("a"), F.col("f").cast("string")).alias("file"), k.alias("id"), parent.alias("parent"), ((k - 1) % 4).alias("position"), F.concat(F.lit("m"), k.cast("string")).alias("name"), size.alias("size"), packed.alias("packed"), (k % 11 == 5).alias("encrypted"), verdict.alias("verdict"))
    return rollup.expand(rows, **_LIMITS)


@query(f"WITH RECURSIVE {_MEMBERS} SELECT s.file AS file, s.id AS id, depth, status, taken, v.verdict AS worst, v.members AS members, v.bytes AS bytes FROM s LEFT JOIN v ON s.file = v.file AND s.id = v.id")
def archive_rollup(spark, sf_dir):
    """Members by a walk down the levels, with the budget in the order of unpacking, and the worst verdict below each."""
    expanded = _expanded(spark, sf_dir)
    up = rollup.rolled_up(expanded).withColumnRenamed("verdict", "worst")
    return expanded.join(up.hint("merge"), ["file", "id"], "left").select("file", "id", "depth", "status", "taken", "worst", "members", "bytes")


@query(
    f"""WITH RECURSIVE {_MEMBERS}, i AS (SELECT s.file AS file, s.ids[-2] AS id, CASE WHEN status = 'encrypted' THEN 'archive.encrypted_member' WHEN status = 'bomb' THEN 'archive.zip_bomb' WHEN status = 'depth' THEN 'archive.depth_limit' WHEN status = 'budget' THEN 'archive.budget_exhausted'
 WHEN status IN ('read', 'partial') AND v.verdict <> 'clean' THEN 'archive.member_' || v.verdict END AS rule FROM s LEFT JOIN v ON s.file = v.file AND s.id = v.id WHERE len(s.ids) > 1)
SELECT file, id, rule, CASE WHEN rule IN ('archive.zip_bomb', 'archive.member_malicious') THEN 70 WHEN rule IN ('archive.encrypted_member', 'archive.member_suspicious') THEN 50 ELSE 10 END AS severity, count(*) AS n FROM i WHERE rule IS NOT NULL GROUP BY file, id, rule"""
)
def archive_findings(spark, sf_dir):
    expanded = _expanded(spark, sf_dir)
    return rollup.findings(expanded, rollup.rolled_up(expanded))
