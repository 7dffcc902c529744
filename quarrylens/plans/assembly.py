"""Queries of captures and assembled streams. Each order's lines are segments of one request, out of order, repeated, overlapping and lost."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import captures, streams
from quarrylens.plans.registry import query, table
from quarrylens.sources.captures import read_captures, write_captures
from quarrylens.storage import fresh_path

_WIDTH = 30
#: Packets of a direction are cut at so many frames.
_PART_FRAMES = 64

_SEGMENTS = f"""q AS (SELECT DISTINCT l_orderkey AS o FROM lineitem),
t AS (SELECT o, 'GET /o' || o || '/' || repeat('x', CAST(o % 9 AS INT)) || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: h' || (o % 20) || '.example.org' || chr(13) || chr(10) || 'User-Agent: ' || CASE WHEN o % 7 = 0 THEN 'curl/8.' || (o % 5) ELSE 'agent/' || (o % 7) END
  || CASE WHEN o % 3 = 0 THEN chr(13) || chr(10) || 'Authorization: Basic dXNlcg==' ELSE '' END || chr(13) || chr(10) || chr(13) || chr(10) || repeat('body', 40) AS t FROM q),
l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, greatest((l_linenumber - 1) * {_WIDTH} - (l_linenumber % 2) * 5, 0) AS b, l_linenumber * {_WIDTH} AS e FROM lineitem WHERE l_partkey % 11 <> 0),
seg AS (SELECT l.o AS o, l.o * 100 + (n * 3) % 8 AS frame, b, substr(t, b + 1, e - b) AS t FROM l JOIN t ON l.o = t.o UNION ALL SELECT o, o * 100 + (n * 3) % 8 + 50, b, repeat('#', e - b) FROM l WHERE s % 5 = 0),
bytes AS (SELECT o, frame, b + unnest(range(length(t))) AS pos, unnest(string_split(t, '')) AS c FROM seg),
won AS (SELECT o, pos, arg_min(c, frame) AS c FROM bytes GROUP BY o, pos),
based AS (SELECT *, pos - CASE WHEN o % 4 < 2 THEN 0 ELSE min(pos) OVER (PARTITION BY o) END AS p, row_number() OVER (PARTITION BY o ORDER BY pos) - 1 AS r FROM won),
heads AS (SELECT o, string_agg(c, '' ORDER BY p) AS head FROM based WHERE p = r GROUP BY o),
frames AS (SELECT o, min(frame) AS first_frame FROM seg GROUP BY o),
k AS (SELECT o, 'f' || ((o // 4) % 2) AS file, CAST(CASE WHEN o % 4 < 2 THEN (o // 4) * 4 ELSE o END AS INTEGER) AS src_port, CASE WHEN o % 4 < 2 THEN 1 + CASE WHEN o % 4 = 1 AND EXISTS (SELECT 1 FROM q x WHERE x.o = q.o - 1) THEN 1 ELSE 0 END ELSE 0 END AS connection FROM q)"""


def _packets(spark, sf_dir):
    """Segments of requests; of two orders in four each begins with a SYN. Sequence numbers wrap near position 0."""
    o, n = F.col("o"), F.col("n")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    text = lambda c: c.cast("string")
    agent = F.when(o % 7 == 0, F.concat(F.lit("curl/8."), text(o % 5))).otherwise(F.concat(F.lit("agent/"), text(o % 7)))
    basic = F.when(o % 3 == 0, "\r\nAuthorization: Basic dXNlcg==").otherwise("")
    request = F.concat(F.lit("GET /o"), text(o), F.lit("/"), F.repeat(F.lit("x"), (o % 9).cast("int")), F.lit(" HTTP/1.1\r\nHost: h"), text(o % 20), F.lit(".example.org\r\nUser-Agent: "), agent, basic, F.lit("\r\n\r\n" + "body" * 40))
    begin = F.greatest((n - 1) * _WIDTH - (n % 2) * 5, F.lit(0))
    size = (n * _WIDTH - begin).cast("int")
    frame = o * 100 + (n * 3) % 8
    isn = F.lit(1 << 32) - o % 90
    sent = lambda frame, payload: F.struct(frame.alias("frame_no"), F.pmod(isn + begin, F.lit(1 << 32)).alias("tcp_seq"), F.lit(16).alias("tcp_flags"), payload.cast("binary").alias("payload"))
    syn = F.struct((o * 100).alias("frame_no"), F.pmod(isn - 1, F.lit(1 << 32)).alias("tcp_seq"), F.lit(2).alias("tcp_flags"), F.lit("").cast("binary").alias("payload"))
    there = F.col("p") % 11 != 0
    rows = F.array(F.when(there, sent(frame, F.substring(request, (begin + 1).cast("int"), size))), F.when(there & (F.col("s") % 5 == 0), sent(frame + 50, F.repeat(F.lit("#"), size))))
    first = line.groupBy("o").agg(F.lit(1).alias("x")).where(o % 4 < 2).select("o", syn.alias("r"))
    every = line.select("o", F.explode(F.array_compact(rows)).alias("r")).unionByName(first)
    port = F.when(o % 4 < 2, F.floor(o / 4) * 4).otherwise(o).cast("int")
    return every.select(F.concat(F.lit("f"), text(F.floor(o / 4) % 2)).alias("file"), F.lit("10.0.0.1").alias("src_ip"), port.alias("src_port"), F.lit("10.0.0.2").alias("dst_ip"), F.lit(80).alias("dst_port"), F.lit(6).alias("proto"), "r.*")


def _placed(spark, sf_dir):
    return streams.positions(_packets(spark, sf_dir), part=F.floor(F.col("frame_no") / _PART_FRAMES))


@query(f"WITH {_SEGMENTS} SELECT k.file AS file, k.src_port AS src_port, k.connection AS connection, first_frame, length(head) AS n_bytes, md5(head) AS head_md5 FROM heads JOIN k ON heads.o = k.o JOIN frames ON heads.o = frames.o")
def stream_heads(spark, sf_dir):
    """Heads of directions whose segments are shuffled, repeated with other bytes, overlapping and partly lost."""
    found = streams.heads(_placed(spark, sf_dir))
    return found.select("file", "src_port", "connection", "first_frame", F.length("head").cast("long").alias("n_bytes"), F.md5("head").alias("head_md5"))


@query(
    f"""WITH {_SEGMENTS}, runs AS (SELECT o, p - r AS gap, min(p) AS a, max(p) + 1 AS b FROM based GROUP BY o, p - r)
SELECT k.file AS file, k.src_port AS src_port, k.connection AS connection, CAST(a AS BIGINT) AS begin_at, CAST(b AS BIGINT) AS end_at FROM runs JOIN k ON runs.o = k.o"""
)
def stream_islands(spark, sf_dir):
    """Runs of bytes without gap; parts of 64 bytes hand on how far the earlier ones reach."""
    found = streams.islands(_placed(spark, sf_dir), part_bytes=64)
    return found.select("file", "src_port", "connection", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"))


_REQUESTS = r"""r AS (SELECT k.file AS file, k.src_port AS src_port, k.connection AS connection, regexp_extract(head, '^GET (\S+) ', 1) AS uri, regexp_extract(head, 'Host: ([^\r\n]*)', 1) AS host,
 regexp_extract(head, 'User-Agent: ([^\r\n]*)', 1) AS user_agent, contains(head, 'Authorization: Basic') AS basic_auth FROM heads JOIN k ON heads.o = k.o WHERE contains(head, chr(13) || chr(10) || chr(13) || chr(10)) AND starts_with(head, 'GET '))"""


@query(f"WITH {_SEGMENTS}, {_REQUESTS} SELECT file, src_port, connection, 'GET' AS method, uri, host, user_agent, basic_auth FROM r")
def http_requests(spark, sf_dir):
    found = streams.http_requests(streams.heads(_placed(spark, sf_dir)))
    return found.select("file", "src_port", "connection", "method", "uri", "host", "user_agent", "basic_auth")


@query(
    f"""WITH {_SEGMENTS}, {_REQUESTS} SELECT file, 'pcap.suspicious_user_agent' AS rule, user_agent AS evidence, count(*) AS n FROM r WHERE starts_with(user_agent, 'curl/') GROUP BY file, user_agent
UNION ALL SELECT file, 'pcap.plaintext_http_basic', '10.0.0.1->10.0.0.2:80', count(*) FROM r WHERE basic_auth GROUP BY file"""
)
def http_findings(spark, sf_dir):
    """From packets to findings: assembly, request heads, known agents and credentials in plain text."""
    found = captures.agent_findings(streams.http_requests(streams.heads(_placed(spark, sf_dir))))
    return found.groupBy("file", "rule", F.get("evidence", F.lit(0)).alias("evidence")).agg(F.count("*").alias("n"))


_CAPTURED = """c AS (SELECT '10.' || (l_suppkey % 3) || '.0.' || l_linenumber AS src_ip, CAST(l_partkey % 50 + 1 AS INTEGER) AS dst_port, CASE WHEN l_orderkey % 2 = 0 THEN 6 ELSE 17 END AS proto, l_orderkey AS o, length('order ' || l_orderkey || repeat('.', CAST(l_quantity AS INT) % 10)) AS size FROM lineitem)"""


def _frames(spark, sf_dir):
    """Ethernet frames made of columns: a line's numbers in IPv4 and TCP or UDP headers, and a short text."""
    o = F.col("l_orderkey")
    wide = lambda n, bytes_: F.lpad(F.hex(n.cast("long")), 2 * bytes_, "0")
    text = F.concat(F.lit("order "), o.cast("string"), F.repeat(F.lit("."), (F.col("l_quantity").cast("int") % 10)))
    tcp = o % 2 == 0
    ports = F.concat(F.lit("1388"), wide(F.col("l_partkey") % 50 + 1, 2))
    body = F.when(tcp, F.concat(ports, wide(o, 4), F.lit("00000000" + "5010" + "000000000000"))).otherwise(F.concat(ports, wide(F.length(text) + 8, 2), F.lit("0000")))
    size = F.length(text) + F.when(tcp, 40).otherwise(28)
    head = F.concat(F.lit("4500"), wide(size, 2), F.lit("0000000040"), F.when(tcp, "06").otherwise("11"), F.lit("0000"), F.lit("0A"), wide(F.col("l_suppkey") % 3, 1), F.lit("00"), wide(F.col("l_linenumber"), 1), F.lit("0A000001"))
    frame = F.concat(F.unhex(F.concat(F.lit("00" * 12 + "0800"), head, body)), text.cast("binary"))
    return table(spark, sf_dir, "lineitem").select((o + F.col("l_linenumber") / 8).cast("double").alias("ts"), frame.alias("frame"))


@query(f"WITH {_CAPTURED} SELECT src_ip, dst_port, proto, count(*) AS n, CAST(sum(size) AS BIGINT) AS n_bytes, max(CASE WHEN proto = 6 THEN o ELSE 0 END) AS last_seq, sum(o % 1000) AS ts_sum FROM c GROUP BY src_ip, dst_port, proto")
def capture_rows(spark, sf_dir):
    """Frames written as capture files and read in partitions of a megabyte, which begin in the middle of records."""
    path = fresh_path(spark, "captures")
    write_captures(_frames(spark, sf_dir), path)
    rows = read_captures(spark, path, partition_bytes=1 << 20)
    return rows.groupBy("src_ip", "dst_port", "proto").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("n_bytes"), F.max("tcp_seq").alias("last_seq"), F.sum(F.floor("ts") % 1000).alias("ts_sum"))
