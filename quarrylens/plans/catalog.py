"""Registered queries of the security operators and their SQL equivalents.

The driver's tables hold no feeds, packets or Windows events, so each query first derives such a table from them, by
the same arithmetic in Spark and in SQL. All queries read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions import decoders, indicators, network
from quarrylens.functions import sql as sql_functions
from quarrylens.operators import correlate, enrich, extract, findings, flows, scoring, versioned_cache, winevents
from quarrylens.plans import indicator_sql
from quarrylens.plans.registry import QUERIES, SQL, pick, place, query, table
from quarrylens.sinks import rules
from quarrylens.sources import feeds
from quarrylens.storage import fresh_path

def ascii_text(c: str = "text"):
    """Word boundaries differ between engines outside ASCII; compared queries blank such characters on both sides."""
    return F.regexp_replace(F.col(c), "[^\\x00-\\x7F]", " ")


ASCII_SQL = r"regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')"
HOST_SQL = r"lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


# --- extraction -------------------------------------------------------------------------------------------------


@query(indicator_sql.TYPE_COUNTS)
def ioc_type_counts(spark, sf_dir):
    """The whole extraction over pages (addresses and markup) and documents: how often each type occurs, and in how many texts."""
    pages = table(spark, sf_dir, "pages")
    parts = [pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("url").alias("text")), pages.select(F.concat(F.lit("h"), "page_id").alias("id"), F.col("html").alias("text"))]
    texts = parts[0].unionByName(parts[1]).unionByName(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text"))
    return extract.extract(texts, "text", ["id"]).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_texts"), F.count_distinct("value").alias("n_values"))


def _values_sql(kind: str) -> str:
    return indicator_sql.found("SELECT doc_id AS id, text AS t FROM documents") + f", v AS (SELECT id AS doc_id, value FROM a WHERE type = '{kind}')"


def _documents(spark, sf_dir, kind: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "documents"), "text", ["doc_id"]).where(F.col("type") == kind)


@query(f"{_values_sql('email')} SELECT doc_id, value AS email FROM v")
def ioc_emails(spark, sf_dir):
    return _documents(spark, sf_dir, "email").select("doc_id", F.col("value").alias("email"))


@query(f"{_values_sql('ipv4')} SELECT value AS ip, count(*) AS n_docs FROM v GROUP BY 1")
def ioc_ipv4(spark, sf_dir):
    return _documents(spark, sf_dir, "ipv4").groupBy(F.col("value").alias("ip")).agg(F.count("*").alias("n_docs"))


@query("SELECT page_id, md5(url) AS md5 FROM pages")
def ioc_md5(spark, sf_dir):
    """Digests among other hexadecimal digits, which are too many or too few."""
    text = F.concat_ws(" ", F.lit("see"), F.md5("url"), F.concat(F.md5("url"), F.lit("0")), F.concat(F.lit("_"), F.md5("html")), F.substring(F.md5("html"), 1, 31))
    found = extract.extract(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), "text", ["page_id"])
    return found.where("type = 'md5'").select("page_id", F.col("value").alias("md5"))


@query(f"{_values_sql('domain')} SELECT value AS domain, count(*) AS n FROM v GROUP BY 1")
def ioc_domains(spark, sf_dir):
    return _documents(spark, sf_dir, "domain").groupBy(F.col("value").alias("domain")).agg(F.count("*").alias("n"))


@query("SELECT page_id, lower(rtrim(url, '.,;:)')) AS url FROM pages")
def ioc_urls(spark, sf_dir):
    found = extract.extract(table(spark, sf_dir, "pages").select("page_id", ascii_text("url").alias("text")), "text", ["page_id"])
    return found.where("type = 'url'").select("page_id", F.col("value").alias("url"))


@query(indicator_sql.type_counts("SELECT 'p' || page_id AS id, url AS t FROM pages"))
def sql_surface(spark, sf_dir):
    """The same extraction by SQL alone: a table function in a lateral join."""
    sql_functions.register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("quarrylens_pages")
    return spark.sql("SELECT i.type, count(*) AS n, count(DISTINCT page_id) AS n_texts, count(DISTINCT i.value) AS n_values FROM quarrylens_pages, LATERAL extract_iocs(url) AS i GROUP BY i.type")


_WHITE = ["\u00a0", "\u2003", "\u3000", "\u0085", "\u2028", "\x1c"]


@query(indicator_sql.type_counts("SELECT 'd' || doc_id AS id, text AS t FROM documents"))
def ioc_unicode_space(spark, sf_dir):
    """Documents whose spaces are Unicode's others hold the same indicators."""
    docs = table(spark, sf_dir, "documents")
    text = F.replace("text", F.lit(" "), pick(F.col("doc_id"), _WHITE))
    found = extract.extract(docs.select("doc_id", text.alias("text")), "text", ["doc_id"])
    return found.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_texts"), F.count_distinct("value").alias("n_values"))


@query("SELECT page_id, replace(replace(regexp_replace(regexp_replace(url, 'https://', 'hxxps://', 'gi'), 'http://', 'hxxp://', 'gi'), '.', '[.]'), '@', '[@]') AS defanged FROM pages")
def defang_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", indicators.defang(F.col("url")).alias("defanged"))


@query("SELECT page_id, url AS refanged, true AS same FROM pages")
def refang_round_trip(spark, sf_dir):
    back = indicators.refang(indicators.defang(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", back.alias("refanged"), (back == F.col("url")).alias("same"))


_VALUES_SQL = """
SELECT c_custkey AS k, '185.220.' || c_nationkey || '.' || (c_custkey % 300) AS v FROM customer
UNION ALL SELECT c_custkey, md5(c_name) FROM customer
UNION ALL SELECT c_custkey, 'CVE-2024-' || (c_custkey + 1000) FROM customer
UNION ALL SELECT c_custkey, lower(replace(c_mktsegment, ' ', '')) || '.example.com' FROM customer
UNION ALL SELECT c_custkey, lower(replace(c_name, '#', '')) || '@example.org' FROM customer
UNION ALL SELECT c_custkey, c_name FROM customer
"""


def _values(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    nation, key = F.col("c_nationkey").cast("string"), F.col("c_custkey")
    forms = [
        F.concat(F.lit("185.220."), nation, F.lit("."), (key % 300).cast("string")),
        F.md5("c_name"),
        F.concat(F.lit("CVE-2024-"), (key + 1000).cast("string")),
        F.concat(F.lower(F.replace("c_mktsegment", F.lit(" "), F.lit(""))), F.lit(".example.com")),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.org")),
        F.col("c_name"),
    ]
    return c.select(key.alias("k"), F.explode(F.array(*forms)).alias("v"))


@query(
    f"""WITH v AS ({_VALUES_SQL}) SELECT CASE
 WHEN regexp_matches(v, '^[a-fA-F0-9]{{32}}$') THEN 'md5' WHEN regexp_matches(upper(v), '^CVE-[0-9]{{4}}-[0-9]{{4,7}}$') THEN 'cve'
 WHEN regexp_matches(v, '^[a-zA-Z0-9._%+-]+@([a-zA-Z0-9-]+\\.)+[a-zA-Z]{{2,63}}$') THEN 'email'
 WHEN regexp_matches(v, '{indicators.STRICT_IPV4}') THEN 'ipv4'
 WHEN regexp_matches(v, '^([a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\\.)+[a-zA-Z]{{2,63}}$') THEN 'domain' END AS type, count(*) AS n FROM v GROUP BY 1"""
)
def detect_types(spark, sf_dir):
    return _values(spark, sf_dir).groupBy(indicators.detect_type(F.col("v")).alias("type")).agg(F.count("*").alias("n"))


@query(f"SELECT {HOST_SQL} AS host, count(*) AS n FROM pages GROUP BY 1")
def url_host_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(indicators.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"WITH h AS (SELECT string_split({HOST_SQL}, '.') AS l FROM pages) SELECT CASE WHEN len(l) < 2 THEN l[1] ELSE l[len(l) - 1] END AS label, count(*) AS n FROM h GROUP BY 1")
def sld_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(network.second_level_label(indicators.url_host(F.col("url"))).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, round(list_aggregate(string_split(p_name, ''), 'entropy'), 6) AS entropy FROM part")
def name_entropy(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(network.entropy(F.col("p_name")), 6).alias("entropy"))


@query("SELECT p_partkey, coalesce(list_max(list_transform(regexp_extract_all(lower(p_name), '[bcdfghjklmnpqrstvwxz]+', 0), lambda x: length(x))), 0) AS run FROM part")
def consonant_runs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", network.consonant_run(F.col("p_name")).cast("long").alias("run"))


@query(
    """WITH l AS (SELECT c_custkey, 'x' || substr(md5(c_name), 1, 14) AS s FROM customer), f AS (SELECT c_custkey, s, list_aggregate(string_split(s, ''), 'entropy') AS h,
 coalesce(list_max(list_transform(regexp_extract_all(s, '[bcdfghjklmnpqrstvwxz]+', 0), lambda x: length(x))), 0) AS run, length(regexp_replace(s, '[^0-9]', '', 'g')) / length(s) AS d FROM l)
 SELECT c_custkey, s AS label FROM f WHERE h >= 3.8 OR (h >= 3.4 AND run >= 5) OR (run >= 7 AND h >= 3.0) OR (d >= 0.3 AND h >= 3.2)"""
)
def generated_names(spark, sf_dir):
    s = F.concat(F.lit("x"), F.substring(F.md5("c_name"), 1, 14))
    return table(spark, sf_dir, "customer").select("c_custkey", s.alias("label")).where(network.looks_generated(F.col("label")))


# --- decoders ---------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name AS base64_text, p_name AS hex_text, replace(p_name, ' ', '_') AS url_text, p_name AS rot13_text FROM part")
def decoders_round_trip(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.encode("p_name", "utf-8")
    return p.select(
        "p_partkey",
        decoders.base64(F.translate(F.base64(raw), "+/=", "-_")).alias("base64_text"),
        decoders.hex_text(F.hex(raw)).alias("hex_text"),
        decoders.url_text(F.url_encode(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("%")))).alias("url_text"),
        decoders.rot13(decoders.rot13(F.col("p_name"))).alias("rot13_text"),
    ).withColumn("url_text", F.expr("substring(url_text, 1, length(url_text) - 1)"))


@query()
def magic_rank(spark, sf_dir):
    """Which decoder reads an encoded address best."""
    hidden = table(spark, sf_dir, "pages").select("page_id", F.base64(F.encode("url", "utf-8")).alias("input"))
    return extract.rank_decodings(hidden, "input").select("page_id", "rank", "operation", F.round("score", 6).alias("score"), "ioc_count")


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def file_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("WITH p AS (SELECT p_brand, lower(string_agg(replace(lower(p_type), ' ', '') || '.' || p_name, ',' ORDER BY p_partkey)) AS s FROM part GROUP BY p_brand) SELECT p_brand, md5(s) AS imphash FROM p")
def import_hashes(spark, sf_dir):
    entry = F.struct("p_partkey", F.concat(F.replace("p_type", F.lit(" "), F.lit("")), F.lit(".dll")).alias("library"), F.col("p_name").alias("symbol"))
    lists = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(entry)).alias("l"))
    return lists.select("p_brand", findings.import_hash(F.col("l")).alias("imphash"))


# --- enrichment, scores, correlation ----------------------------------------------------------------------------


@query(
    "WITH n AS (SELECT c_custkey, ([10::BIGINT, 100, 127, 169, 172, 192, 198, 203, 224, 240, 0, 8, 185, 193, 223, 255])[CAST(c_custkey % 16 AS INT) + 1] AS a, c_nationkey * 10 AS b, c_custkey % 256 AS d FROM customer), "
    "x AS (SELECT *, a * 16777216 + b * 65536 + 2 * 256 + d AS v FROM n) SELECT CASE "
    + " ".join(f"WHEN v BETWEEN {network.ip_number(i)} AND {network.ip_number(i) + (1 << (32 - bits)) - 1} THEN '{tags}'" for i, bits, _, _, tags in network.IPV4_CLASSES)
    + " ELSE 'public' END AS tags, count(*) AS n FROM x GROUP BY 1"
)
def netmeta_classes(spark, sf_dir):
    first = F.element_at(F.array(*[F.lit(x) for x in (10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 0, 8, 185, 193, 223, 255)]), (F.col("c_custkey") % 16 + 1).cast("int"))
    ip = F.concat_ws(".", first.cast("string"), (F.col("c_nationkey") * 10).cast("string"), F.lit("2"), (F.col("c_custkey") % 256).cast("string"))
    return table(spark, sf_dir, "customer").groupBy(network.classify_ipv4(ip)["tags"].alias("tags")).agg(F.count("*").alias("n"))


_SOURCE_ROWS = ", ".join(f"('{s}', '{t}', {w})" for s, w, _, types in enrich.SOURCES for t in types.split())


@query(
    f"""WITH d(source, type, weight) AS (VALUES {_SOURCE_ROWS}), i AS (SELECT c_custkey, (['ipv4', 'ipv6', 'domain', 'url', 'email', 'md5', 'sha1', 'sha256', 'cve', 'btc_address'])[CAST(c_custkey % 10 AS INT) + 1] AS type FROM customer)
 SELECT source, i.type AS type, count(*) AS n, round(sum(weight), 4) AS weight FROM i JOIN d ON i.type = d.type GROUP BY 1, 2"""
)
def source_applicability(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("ipv4", "ipv6", "domain", "url", "email", "md5", "sha1", "sha256", "cve", "btc_address")])
    iocs = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(kinds, (F.col("c_custkey") % 10 + 1).cast("int")).alias("type"))
    return enrich.applicable(iocs, enrich.sources(spark)).groupBy("source", "type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


_CACHE_SQL = "SELECT substr(o_orderpriority, 1, 1) AS source, 'ipv4' AS ioc_type, CAST(o_custkey AS VARCHAR) AS ioc_value, CAST(o_orderkey AS VARCHAR) AS payload, CAST(epoch(o_orderdate) AS BIGINT) AS cached_at, CAST(epoch(o_orderdate) AS BIGINT) + 86400 * (o_orderkey % 400) AS expires_at FROM orders"
_AS_OF = 852_076_800  # 1997-01-01


def _cache(spark, sf_dir):
    at = F.unix_timestamp("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("source"), F.lit("ipv4").alias("ioc_type"), F.col("o_custkey").cast("string").alias("ioc_value"), F.col("o_orderkey").cast("string").alias("payload"), at.alias("cached_at"), (at + 86400 * (F.col("o_orderkey") % 400)).alias("expires_at")
    )


@query(f"WITH c AS ({_CACHE_SQL}) SELECT count(*) AS total, count(*) FILTER (WHERE expires_at > {_AS_OF}) AS fresh, count(*) FILTER (WHERE expires_at <= {_AS_OF}) AS expired FROM c")
def cache_stats(spark, sf_dir):
    return enrich.stats(_cache(spark, sf_dir), _AS_OF)


@query(f"WITH c AS ({_CACHE_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY source, ioc_type, ioc_value ORDER BY cached_at DESC, expires_at DESC, payload DESC) AS k FROM c) SELECT source, ioc_type, ioc_value, payload, cached_at, expires_at FROM r WHERE k = 1")
def cache_latest(spark, sf_dir):
    return enrich.latest(_cache(spark, sf_dir))


@query("""WITH b AS (SELECT 'v' || (o_custkey % 500) AS ioc_value, 'p' || o_orderkey AS payload, 100 + o_orderkey % 3 AS cached_at FROM orders WHERE o_orderkey % 7 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY ioc_value ORDER BY cached_at DESC, payload DESC) AS k FROM b) SELECT 'otx' AS source, 'domain' AS ioc_type, ioc_value, payload, CAST(cached_at AS BIGINT) AS cached_at, CAST(cached_at + 50 AS BIGINT) AS expires_at FROM r WHERE k = 1""")
def cache_versions(spark, sf_dir):
    """Three batches stored one after the other, and the snapshot of the last version."""
    cache = versioned_cache.VersionedCache(spark, fresh_path(spark, "cache"), buckets=16)
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("k"), F.lit("otx").alias("source"), F.lit("domain").alias("ioc_type"), F.concat(F.lit("v"), (F.col("o_custkey") % 500).cast("string")).alias("ioc_value"), F.concat(F.lit("p"), key.cast("string")).alias("payload"), F.when(key % 7 == 0, "timeout").alias("error"))
    for n in range(3):
        cache.upsert(rows.where(F.col("k") % 3 == n).drop("k"), now=100 + n, ttl=50)
    return cache.read()


@query(f"WITH c AS ({_CACHE_SQL}) SELECT s.source AS source, 'ipv4' AS ioc_type, CAST(c_custkey AS VARCHAR) AS ioc_value FROM customer, (SELECT unnest(['1', '2', '3', '4', '5']) AS source) s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source = s.source AND c.ioc_value = CAST(c_custkey AS VARCHAR) AND c.expires_at > {_AS_OF})")
def cache_misses(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.explode(F.array(*[F.lit(str(i)) for i in range(1, 6)])).alias("source"), F.lit("ipv4").alias("ioc_type"), F.col("c_custkey").cast("string").alias("ioc_value"))
    return enrich.misses(wanted, _cache(spark, sf_dir), _AS_OF)


_RESULTS_SQL = """SELECT o_custkey AS ioc, o_orderkey AS ord, substr(o_orderpriority, 1, 1) AS source,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0.9 WHEN '2' THEN 0.85 WHEN '3' THEN 0.8 WHEN '4' THEN 0.75 ELSE 0.4 END AS weight,
 CASE WHEN o_orderkey % 16 = 0 THEN 'malicious' WHEN o_orderkey % 16 IN (1, 2) THEN 'suspicious' WHEN o_orderkey % 16 IN (3, 4, 5) THEN 'benign' ELSE 'unknown' END AS verdict,
 (o_orderkey % 100) / 100.0 AS score, CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' END AS error FROM orders"""
_SCORE_SQL = f"""WITH r AS ({_RESULTS_SQL}), g AS (SELECT ioc, count(*) FILTER (WHERE error IS NULL) AS n, coalesce(sum(CASE WHEN error IS NULL THEN weight END), 0.0) AS total,
 coalesce(sum(CASE WHEN error IS NULL AND verdict = 'malicious' THEN weight * greatest(score, 0.5) END), 0.0) AS m,
 coalesce(sum(CASE WHEN error IS NULL AND verdict = 'suspicious' THEN weight * greatest(score, 0.5) END), 0.0) AS s,
 coalesce(sum(CASE WHEN error IS NULL AND verdict = 'benign' THEN weight END), 0.0) AS b FROM r GROUP BY ioc),
 f AS (SELECT ioc, n, m / CASE WHEN total = 0 THEN 1.0 ELSE total END AS m, s / CASE WHEN total = 0 THEN 1.0 ELSE total END AS s, b / CASE WHEN total = 0 THEN 1.0 ELSE total END AS b FROM g),
 v AS (SELECT ioc, CASE WHEN n = 0 THEN 'unknown' WHEN m >= 0.25 THEN 'malicious' WHEN s >= 0.25 OR m > 0 THEN 'suspicious' WHEN b >= 0.3 THEN 'benign' ELSE 'unknown' END AS verdict,
 CASE WHEN n = 0 THEN 0.0 WHEN m >= 0.25 THEN least(1.0, m + 0.5 * s) WHEN s >= 0.25 OR m > 0 THEN least(1.0, s + m) WHEN b >= 0.3 THEN b ELSE 0.0 END AS confidence FROM f)"""


def source_results(spark, sf_dir):
    first, k = F.substring("o_orderpriority", 1, 1), F.col("o_orderkey") % 16
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ioc"),
        F.col("o_orderkey").alias("ord"),
        place().alias("place"),
        first.alias("source"),
        F.when(first == "1", 0.9).when(first == "2", 0.85).when(first == "3", 0.8).when(first == "4", 0.75).otherwise(0.4).alias("weight"),
        F.when(k == 0, "malicious").when(k.isin(1, 2), "suspicious").when(k.isin(3, 4, 5), "benign").otherwise("unknown").alias("verdict"),
        ((F.col("o_orderkey") % 100) / 100.0).alias("score"),
        F.when(F.col("o_orderkey") % 17 == 0, "timeout").alias("error"),
    )


def rounded(c: str):
    """Six places as in DuckDB, which rounds the scaled double; Spark rounds its shortest digits."""
    return F.round(F.col(c) * 1e6) / 1e6


@query(_SCORE_SQL + " SELECT ioc, verdict, round(confidence, 6) AS confidence FROM v")
def score_verdicts(spark, sf_dir):
    return scoring.score(source_results(spark, sf_dir), ["ioc"], "place").withColumn("confidence", rounded("confidence"))


@query(_SCORE_SQL + " SELECT verdict, count(*) AS n FROM v WHERE verdict IN ('suspicious', 'malicious') GROUP BY 1")
def severity_floor(spark, sf_dir):
    return rules.summary(scoring.at_least(scoring.score(source_results(spark, sf_dir), ["ioc"], "place"), "Suspicious"))


@query(
    f"WITH r AS ({_RESULTS_SQL}), e AS (SELECT ioc, ord, unnest([1, 2]) AS p FROM r WHERE error IS NULL), t AS (SELECT ioc, ord, p, CASE p WHEN 1 THEN 'tag' || (ord % 7) ELSE 'kit' || (ord % 3) END AS x FROM e), "
    "f AS (SELECT ioc, x, min(ord * 10 + p) AS seen FROM t GROUP BY ioc, x) SELECT ioc, string_agg(x, ',' ORDER BY seen) AS tags FROM f GROUP BY ioc"
)
def tags_union(spark, sf_dir):
    tags = F.array(F.concat(F.lit("tag"), (F.col("ord") % 7).cast("string")), F.concat(F.lit("kit"), (F.col("ord") % 3).cast("string")))
    return scoring.ordered_union(source_results(spark, sf_dir).withColumn("tags", tags), ["ioc"], "ord", "tags", "all").select("ioc", F.array_join("all", ",").alias("tags"))


def _feed(kind: str, json, keep: str):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "orders").select(keep, feeds.interpret(kind, json()).alias("r"))
        return rows.groupBy("r.verdict").agg(F.count("*").alias("n"), F.round(F.sum("r.score"), 4).alias("score"))

    return run


_K = lambda m: (F.col("o_orderkey") % m).cast("string")


@query("SELECT CASE WHEN o_orderkey % 9 >= 5 THEN 'malicious' WHEN o_orderkey % 9 + o_orderkey % 3 > 0 THEN 'suspicious' ELSE 'benign' END AS verdict, count(*) AS n, round(sum(CASE WHEN o_orderkey % 9 >= 5 THEN (o_orderkey % 9) / (o_orderkey % 9 + o_orderkey % 3 + 60.0) ELSE (o_orderkey % 9 + o_orderkey % 3) / (o_orderkey % 9 + o_orderkey % 3 + 60.0) END), 4) AS score FROM orders GROUP BY 1")
def feed_virustotal(spark, sf_dir):
    json = lambda: F.concat(F.lit('{"data":{"attributes":{"last_analysis_stats":{"malicious":'), _K(9), F.lit(',"suspicious":'), _K(3), F.lit(',"harmless":60}}}}'))
    return _feed("virustotal", json, "o_orderkey")(spark, sf_dir)


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'benign' WHEN o_orderkey % 101 >= 75 THEN 'malicious' WHEN o_orderkey % 101 > 0 THEN 'suspicious' ELSE 'unknown' END AS verdict, count(*) AS n, round(sum(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (o_orderkey % 101) / 100.0 END), 4) AS score FROM orders GROUP BY 1")
def feed_abuseipdb(spark, sf_dir):
    json = lambda: F.concat(F.lit('{"data":{"abuseConfidenceScore":'), _K(101), F.lit(',"isWhitelisted":'), F.when(F.col("o_orderkey") % 7 == 0, "true").otherwise("false"), F.lit("}}"))
    return _feed("abuseipdb", json, "o_orderkey")(spark, sf_dir)


@query("SELECT CASE WHEN o_orderkey % 8 >= 5 THEN 'malicious' WHEN o_orderkey % 8 >= 1 THEN 'suspicious' ELSE 'unknown' END AS verdict, count(*) AS n, round(sum(CASE WHEN o_orderkey % 8 >= 5 THEN (o_orderkey % 8) / 10.0 WHEN o_orderkey % 8 >= 1 THEN least(0.6, (o_orderkey % 8) / 10.0) ELSE 0 END), 4) AS score FROM orders GROUP BY 1")
def feed_otx(spark, sf_dir):
    json = lambda: F.concat(F.lit('{"pulse_info":{"count":'), _K(8), F.lit('},"reputation":0}'))
    return _feed("otx", json, "o_orderkey")(spark, sf_dir)


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN o_orderkey % 101 >= 50 THEN 'malicious' ELSE 'suspicious' END AS verdict, count(*) AS n, round(sum(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_orderkey % 101) / 100.0 END), 4) AS score FROM orders GROUP BY 1")
def feed_threatfox(spark, sf_dir):
    json = lambda: F.concat(F.lit('{"query_status":"'), F.when(F.col("o_orderkey") % 5 == 0, "no_result").otherwise("ok"), F.lit('","data":[{"confidence_level":'), _K(101), F.lit("}]}"))
    return _feed("threatfox", json, "o_orderkey")(spark, sf_dir)


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 1 THEN 'suspicious' ELSE 'malicious' END AS verdict, count(*) AS n, round(sum(CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 0.95 WHEN o_orderkey % 3 = 1 THEN 0.7 ELSE 0.85 END), 4) AS score FROM orders GROUP BY 1")
def feed_urlhaus(spark, sf_dir):
    state = F.when(F.col("o_orderkey") % 3 == 0, "online").when(F.col("o_orderkey") % 3 == 1, "offline").otherwise("gone")
    json = lambda: F.concat(F.lit('{"query_status":"'), F.when(F.col("o_orderkey") % 4 == 0, "no_results").otherwise("ok"), F.lit('","url_status":"'), state, F.lit('"}'))
    return _feed("urlhaus", json, "o_orderkey")(spark, sf_dir)


def _ip_batch(spark, sf_dir):
    ip = F.concat_ws(".", F.lit("185"), F.lit("220"), F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 256).cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.lit("ipv4").alias("type"), ip.alias("value"), F.array(F.lower("c_mktsegment"), F.lit("country:x")).alias("tags"))


@query(
    "WITH i AS (SELECT '185.220.' || c_nationkey || '.' || (c_custkey % 256) AS v, c_nationkey AS net, min(c_custkey) AS pos FROM customer GROUP BY 1, 2) "
    "SELECT a.v AS source, b.v AS target, 'shared_subnet' AS kind, 'both in 185.220.' || a.net || '.0/24' AS evidence FROM i a JOIN i b ON a.net = b.net AND a.pos < b.pos"
)
def corr_subnet(spark, sf_dir):
    return correlate.shared_subnet(_ip_batch(spark, sf_dir))


@query(
    "WITH i AS (SELECT lower(c_mktsegment) AS tag, '185.220.' || c_nationkey || '.' || (c_custkey % 256) AS v, min(c_custkey) AS pos FROM customer GROUP BY 1, 2), f AS (SELECT tag, min(pos) AS pos FROM i GROUP BY tag) "
    "SELECT s.v AS source, i.v AS target, 'shared_tag' AS kind, 'both tagged ''' || i.tag || '''' AS evidence FROM i JOIN f ON i.tag = f.tag JOIN i s ON s.tag = f.tag AND s.pos = f.pos WHERE i.v <> s.v"
)
def corr_tag(spark, sf_dir):
    return correlate.shared_tag(_ip_batch(spark, sf_dir))


@query(f"WITH u AS (SELECT url, {HOST_SQL} AS host FROM pages) SELECT url AS source, host AS target, 'url_to_host' AS kind, 'URL is hosted on ' || host AS evidence FROM u WHERE host <> ''")
def corr_url_host(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    host = indicators.url_host(F.col("url"))
    batch = p.select(F.col("page_id").alias("pos"), F.lit("url").alias("type"), F.col("url").alias("value")).unionByName(p.select(F.col("page_id").alias("pos"), F.lit("domain").alias("type"), host.alias("value")).distinct())
    return correlate.url_to_host(batch)


@query("SELECT DISTINCT 'user' || c_custkey || '@seg' || c_nationkey || '.example.org' AS source, 'seg' || c_nationkey || '.example.org' AS target, 'email_to_domain' AS kind, 'Email at seg' || c_nationkey || '.example.org' AS evidence FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def corr_email_domain(spark, sf_dir):
    domain = lambda c: F.concat(F.lit("seg"), F.col(c).cast("string"), F.lit(".example.org"))
    mails = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.lit("email").alias("type"), F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@"), domain("c_nationkey")).alias("value"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.lit("domain").alias("type"), domain("s_nationkey").alias("value"))
    return correlate.email_to_domain(mails.unionByName(names))


# --- network ----------------------------------------------------------------------------------------------------

_PACKETS_SQL = """SELECT l_orderkey * 10 + l_linenumber AS frame_no, CAST(epoch(l_shipdate) AS BIGINT) AS ts, CASE WHEN l_returnflag = 'R' THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS src_ip,
 CASE WHEN l_returnflag = 'R' THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS dst_ip, CAST(l_quantity AS INT) AS size FROM lineitem"""


def packets(spark, sf_dir):
    """Each line is a packet between its supplier and its part; returned ones go the other way."""
    s, p, back = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey")), F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_no"),
        F.unix_timestamp("l_shipdate").alias("ts"),
        F.when(back, p).otherwise(s).alias("src_ip"),
        F.lit(443).alias("src_port"),
        F.when(back, s).otherwise(p).alias("dst_ip"),
        (F.lit(443)).alias("dst_port"),
        F.lit(6).alias("proto"),
        F.col("l_quantity").cast("int").alias("size"),
        F.lit(2).alias("tcp_flags"),
    )


_FLOWS_SQL = f"""WITH p AS ({_PACKETS_SQL}), k AS (SELECT *, least(src_ip, dst_ip) AS lo, greatest(src_ip, dst_ip) AS hi FROM p), f AS (SELECT lo, hi, arg_min(src_ip, frame_no) AS a, min(ts) AS first_ts, max(ts) AS last_ts FROM k GROUP BY 1, 2),
 w AS (SELECT f.a AS a_ip, CASE WHEN f.a = f.lo THEN f.hi ELSE f.lo END AS b_ip, first_ts, last_ts, count(*) FILTER (WHERE src_ip = f.a) AS packets_a2b, count(*) FILTER (WHERE src_ip <> f.a) AS packets_b2a,
 CAST(coalesce(sum(CASE WHEN src_ip = f.a THEN size END), 0) AS BIGINT) AS bytes_a2b, CAST(coalesce(sum(CASE WHEN src_ip <> f.a THEN size END), 0) AS BIGINT) AS bytes_b2a FROM k JOIN f ON k.lo = f.lo AND k.hi = f.hi GROUP BY f.a, f.lo, f.hi, first_ts, last_ts)"""


@query(_FLOWS_SQL + " SELECT a_ip, b_ip, first_ts, last_ts, packets_a2b, packets_b2a, bytes_a2b, bytes_b2a FROM w")
def flow_aggregate(spark, sf_dir):
    return flows.flows(packets(spark, sf_dir)).select("a_ip", "b_ip", "first_ts", "last_ts", "packets_a2b", "packets_b2a", "bytes_a2b", "bytes_b2a")


@query(_FLOWS_SQL + ", t AS (SELECT a_ip AS ip, packets_a2b + packets_b2a AS p, bytes_a2b + bytes_b2a AS b FROM w UNION ALL SELECT b_ip, packets_a2b + packets_b2a, bytes_a2b + bytes_b2a FROM w) SELECT ip, CAST(sum(p) AS BIGINT) AS packets, CAST(sum(b) AS BIGINT) AS bytes FROM t GROUP BY ip ORDER BY bytes DESC, ip LIMIT 10")
def top_talkers(spark, sf_dir):
    return flows.top_talkers(flows.flows(packets(spark, sf_dir)))


@query(_FLOWS_SQL + " SELECT a_ip, b_ip, bytes_a2b, bytes_b2a FROM w WHERE bytes_a2b >= 60 AND bytes_b2a <= 0.05 * bytes_a2b")
def exfil_one_sided(spark, sf_dir):
    return flows.one_sided(flows.flows(packets(spark, sf_dir)), least=60).select("a_ip", "b_ip", "bytes_a2b", "bytes_b2a")


@query("SELECT l_suppkey % 100 AS b_port, count(*) AS flows, CAST(sum(l_quantity) AS BIGINT) AS packets FROM lineitem WHERE l_suppkey % 100 <> 0 GROUP BY 1 ORDER BY flows DESC, b_port LIMIT 10")
def top_ports(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 100).alias("b_port"), F.col("l_quantity").cast("long").alias("packets_a2b"), F.lit(0).cast("long").alias("packets_b2a"))
    return flows.top_ports(f)


_BEACON_SQL = """WITH g AS (SELECT user_id, event_type, epoch_ms(ts) / 86400000.0 AS d, epoch_ms(ts) / 86400000.0 - lag(epoch_ms(ts) / 86400000.0) OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts), event_id) AS gap FROM events),
 b AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE gap > 0) AS k, avg(gap) FILTER (WHERE gap > 0) AS mean, stddev_pop(gap) FILTER (WHERE gap > 0) AS sd FROM g GROUP BY 1, 2)
 SELECT user_id, event_type, n, round(mean, 4) AS mean, round(sd / mean, 4) AS cv FROM b WHERE n >= 6 AND k >= 5 AND mean BETWEEN 0.001 AND 100 AND sd / mean <= 0.8"""


@query(_BEACON_SQL)
def beacons(spark, sf_dir):
    """In days, with a loose bound: the events of the tables come at random."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.unix_millis(F.col("ts").cast("timestamp")) / 86400000.0).alias("d"), F.struct(F.unix_millis(F.col("ts").cast("timestamp")), "event_id").alias("at"))
    found = flows.beacons(e, ["user_id", "event_type"], "d", "at", cv=0.8, low=0.001, high=100, part=F.floor(F.col("d") / 7))
    return found.select("user_id", "event_type", "n", F.round("mean", 4).alias("mean"), F.round("cv", 4).alias("cv"))


def _probe_packets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src_ip"), (F.col("l_orderkey") % 50).alias("dst_ip"), (F.col("l_partkey") % 1000).alias("dst_port"), F.lit(17).alias("proto"), F.lit(0).alias("tcp_flags"))


@query("SELECT l_suppkey AS src_ip, l_orderkey % 50 AS dst_ip, 17 AS proto, count(DISTINCT l_partkey % 1000) AS n_ports FROM lineitem WHERE l_partkey % 1000 <> 0 GROUP BY 1, 2 HAVING count(DISTINCT l_partkey % 1000) >= 10")
def port_scans(spark, sf_dir):
    return flows.port_scans(_probe_packets(spark, sf_dir), ports=10)


@query("SELECT l_suppkey AS src_ip, 17 AS proto, l_partkey % 1000 AS dst_port, count(DISTINCT l_orderkey % 50) AS n_hosts FROM lineitem WHERE l_partkey % 1000 <> 0 GROUP BY 1, 3 HAVING count(DISTINCT l_orderkey % 50) >= 3")
def host_sweeps(spark, sf_dir):
    return flows.host_sweeps(_probe_packets(spark, sf_dir), hosts=3)


@query("SELECT l_suppkey AS src_ip, l_partkey % 20 AS dst_ip, count(*) AS n, round(avg(CAST(l_extendedprice AS INT) - 8), 4) AS avg_size FROM lineitem WHERE CAST(l_extendedprice AS INT) - 8 >= 64 GROUP BY 1, 2 HAVING count(*) >= 20")
def icmp_tunnels(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src_ip"), (F.col("l_partkey") % 20).alias("dst_ip"), F.lit(1).alias("proto"), F.bround("l_extendedprice").cast("int").alias("size"))
    return flows.icmp_tunnels(p).withColumn("avg_size", F.round("avg_size", 4))


_DNS_SQL = "SELECT event_type = 'click' OR event_type = 'purchase' AS r, 'n' || (user_id % 40) AS sld, epoch(ts) AS ts, CASE WHEN event_id % 3 = 0 THEN 16 ELSE 1 END AS qtype, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END AS rcode, event_id % 500 AS size FROM events"


def _dns(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").isin("click", "purchase").alias("is_response"),
        F.concat(F.lit("n"), (F.col("user_id") % 40).cast("string")).alias("sld"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.when(F.col("event_id") % 3 == 0, 16).otherwise(1).alias("qtype"),
        F.when(F.col("event_id") % 2 == 0, 3).otherwise(0).alias("rcode"),
        (F.col("event_id") % 500).alias("size"),
    )


@query(f"WITH m AS ({_DNS_SQL}), s AS (SELECT count(*) FILTER (WHERE NOT r) AS queries, count(*) FILTER (WHERE r) AS responses, count(*) FILTER (WHERE r AND rcode = 3) AS nxdomain, CAST(coalesce(sum(CASE WHEN r AND qtype = 16 THEN size END), 0) AS BIGINT) AS txt_bytes FROM m) SELECT * FROM s WHERE responses >= 50 AND nxdomain >= 0.4 * responses")
def dns_nxdomain(spark, sf_dir):
    return flows.nxdomain_ratio(flows.dns_stats(_dns(spark, sf_dir)), ratio=0.4)


@query(f"WITH m AS ({_DNS_SQL}) SELECT sld, count(*) AS n, round(max(ts) - min(ts), 3) AS seconds FROM m WHERE NOT r GROUP BY sld HAVING count(*) >= 20 AND count(*) >= 0.00001 * greatest(max(ts) - min(ts), 1.0)")
def dns_query_rates(spark, sf_dir):
    return flows.dns_query_rates(_dns(spark, sf_dir), queries=20, rate=0.00001).withColumn("seconds", F.round("seconds", 3))


@query("WITH m AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN event_id END AS c, event_type FROM events), a AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS as_of FROM m) SELECT user_id, event_id, as_of FROM a WHERE event_type = 'click'")
def asof_challenge(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "view", F.col("event_id")).alias("challenge"))
    return flows.last_challenge(m, ["user_id"], "event_id", part=F.floor(F.col("event_id") / 4096)).where("event_type = 'click'").select("user_id", "event_id", "as_of")


# --- Windows events ---------------------------------------------------------------------------------------------


def windows_events(spark, sf_dir):
    kind = F.col("event_type")
    code = F.when(kind == "error", 4625).when(kind == "signup", 4624).when(kind == "click", 4688).when(kind == "view", 4769).otherwise(4672)
    n = F.col("event_id")
    tools = F.element_at(F.array(*[F.lit(x) for x in ("C:\\Windows\\certutil.exe", "C:\\Tools\\good.exe", "C:\\Windows\\mshta.exe", "D:\\a\\cmd.exe")]), (n % 4 + 1).cast("int"))
    fields = F.create_map(
        F.lit("TargetUserName"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("SubjectUserName"), F.concat(F.lit("u"), F.col("user_id").cast("string")),
        F.lit("IpAddress"), F.concat(F.lit("10.0.0."), F.get_json_object("props", "$.k")), F.lit("LogonType"), F.when(n % 3 == 0, "3").otherwise("10"),
        F.lit("TicketEncryptionType"), F.when(n % 5 == 0, "0x00000017").otherwise("0x12"), F.lit("ServiceName"), F.concat(F.lit("svc"), (n % 6).cast("string")), F.lit("NewProcessName"), tools,
    )
    return table(spark, sf_dir, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("file"), n.alias("record_id"), code.alias("event_id"), F.lit("Security").alias("channel"), F.lit("Audit").alias("provider"), fields.alias("fields"))


@query(
    """WITH e AS (SELECT 'f' || (user_id % 3) AS file, event_id AS n, event_type AS t FROM events), h AS (
 SELECT file, 'evtx.kerberoasting' AS rule, 70 AS severity FROM e WHERE t = 'view' AND n % 5 = 0
 UNION ALL SELECT file, 'evtx.rdp_logon', 50 FROM e WHERE t = 'signup' AND n % 3 <> 0
 UNION ALL SELECT file, 'evtx.network_logon', 30 FROM e WHERE t = 'signup' AND n % 3 = 0
 UNION ALL SELECT file, 'evtx.lolbin_execution', 50 FROM e WHERE t = 'click' AND n % 4 IN (0, 2)
 UNION ALL SELECT file, 'evtx.privileged_logon', 50 FROM e WHERE t = 'purchase')
 SELECT file, rule, severity, count(*) AS n FROM h GROUP BY 1, 2, 3"""
)
def windows_rules(spark, sf_dir):
    return winevents.rule_findings(windows_events(spark, sf_dir)).select("file", "rule", "severity", "n")


@query("SELECT 'f' || (user_id % 3) AS file, 'u' || user_id AS \"user\", count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 10")
def windows_brute_force(spark, sf_dir):
    return winevents.brute_force(windows_events(spark, sf_dir))


@query("SELECT 'f' || (user_id % 3) AS file, '10.0.0.' || json_extract_string(props, '$.k') AS source, count(DISTINCT user_id) AS n_users FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 5")
def windows_spray(spark, sf_dir):
    return winevents.password_spray(windows_events(spark, sf_dir))


@query("SELECT 'f' || (user_id % 3) AS file, 'u' || user_id AS \"user\", count(*) AS n_logons FROM events e WHERE event_type = 'signup' AND EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error') GROUP BY 1, 2")
def windows_success_after_failure(spark, sf_dir):
    return winevents.success_after_failures(windows_events(spark, sf_dir))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 15")
def event_top(spark, sf_dir):
    return winevents.most_common(table(spark, sf_dir, "events"), "event_type", "event_id", 15)


# --- findings and outputs ---------------------------------------------------------------------------------------

_RULE_NAMES = ("evtx.kerberoasting", "evtx.lolbin_execution", "pcap.beaconing", "pcap.host_sweep", "evtx.ntlm_auth", "none.such")
_SEVERITIES = (30, 30, 50, 70, 10)
_FINDINGS_SQL = f"SELECT l_orderkey AS path, ([{', '.join(repr(x) for x in _RULE_NAMES)}])[CAST(l_partkey % 6 AS INT) + 1] AS rule, ([{', '.join(map(str, _SEVERITIES))}])[CAST(l_suppkey % 5 AS INT) + 1] AS severity FROM lineitem"
_TECHNIQUES_SQL = "WITH t(rule, t) AS (VALUES " + ", ".join(f"('{r}', '{t}')" for r, ts in findings.TECHNIQUES.items() for t in ts) + ")"


def _findings(spark, sf_dir):
    rule = F.element_at(F.array(*[F.lit(x) for x in _RULE_NAMES]), (F.col("l_partkey") % 6 + 1).cast("int"))
    severity = F.element_at(F.array(*[F.lit(x) for x in _SEVERITIES]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), rule.alias("rule"), severity.alias("severity"))


def _findings_by_path(spark, sf_dir):
    return findings.by_path(_findings(spark, sf_dir), table(spark, sf_dir, "lineitem").count())


@query(f"{_TECHNIQUES_SQL}, f AS ({_FINDINGS_SQL}) SELECT f.rule AS rule, count(DISTINCT t.t) AS n_techniques, count(DISTINCT path) AS n_paths FROM f LEFT JOIN t ON f.rule = t.rule GROUP BY 1")
def attack_tags(spark, sf_dir):
    counts = findings.rule_counts(_findings_by_path(spark, sf_dir), findings.techniques(spark))
    return counts.select("rule", F.size("mitre").cast("long").alias("n_techniques"), "n_paths")


@query(f"{_TECHNIQUES_SQL}, f AS ({_FINDINGS_SQL}), d AS (SELECT DISTINCT path, t.t AS t FROM f JOIN t ON f.rule = t.rule) SELECT path, string_agg(t, ',' ORDER BY t) AS techniques FROM d GROUP BY path")
def attack_coverage(spark, sf_dir):
    return findings.coverage(findings.tag(_findings_by_path(spark, sf_dir), findings.techniques(spark))).withColumn("techniques", F.array_join("techniques", ","))


@query(f"WITH f AS ({_FINDINGS_SQL}) SELECT path, count(*) AS n, max(severity) AS worst, CASE WHEN max(severity) >= 70 THEN 'malicious' WHEN max(severity) >= 50 THEN 'suspicious' ELSE 'clean' END AS verdict, round(least(1.0, sum(severity) / 100.0 / 3), 6) AS confidence FROM f GROUP BY path")
def file_verdicts(spark, sf_dir):
    return findings.verdicts(_findings(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


_COMBOS = {"metals": ["TIN", "NICKEL", "STEEL", "BRASS"], "plated": ["PLATED", "BURNISHED"], "sizes": ["SMALL", "LARGE", "MEDIUM"]}


@query(
    "WITH w AS (SELECT p_partkey, unnest(string_split(upper(p_type), ' ')) AS x FROM part), c(combo, x) AS (VALUES "
    + ", ".join(f"('{k}', '{x}')" for k, v in _COMBOS.items() for x in v)
    + "), d AS (SELECT DISTINCT p_partkey, combo, w.x AS x FROM w JOIN c ON w.x = c.x) SELECT p_partkey, combo, string_agg(x, ',' ORDER BY x) AS hits FROM d GROUP BY 1, 2"
)
def symbol_combinations(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split(F.upper("p_type"), " ").alias("s"))
    return findings.combinations(parts, "s", _COMBOS, dict.fromkeys(_COMBOS, 1)).select("p_partkey", "combo", F.array_join("hits", ",").alias("hits"))


def _verdicts(spark, sf_dir):
    v = scoring.score(source_results(spark, sf_dir), ["ioc"], "place")
    k = F.col("ioc") % 4
    host = F.concat(F.lit("h"), F.col("ioc").cast("string"), F.lit(".example.com"))
    value = F.when(k == 0, F.concat(F.lit("10.1."), (F.col("ioc") % 200).cast("string"), F.lit(".7"))).when(k == 1, host).when(k == 2, F.concat(F.lit("http://"), host, F.lit("/a?b=1"))).otherwise(F.md5(F.col("ioc").cast("string")))
    return v.select(F.when(k == 0, "ipv4").when(k == 1, "domain").when(k == 2, "url").otherwise("md5").alias("type"), value.alias("value"), "verdict", "confidence", "ioc")


_VERDICTS_SQL = _SCORE_SQL + """, x AS (SELECT ioc, verdict, confidence, CASE ioc % 4 WHEN 0 THEN 'ipv4' WHEN 1 THEN 'domain' WHEN 2 THEN 'url' ELSE 'md5' END AS type,
 CASE ioc % 4 WHEN 0 THEN '10.1.' || (ioc % 200) || '.7' WHEN 1 THEN 'h' || ioc || '.example.com' WHEN 2 THEN 'http://h' || ioc || '.example.com/a?b=1' ELSE md5(CAST(ioc AS VARCHAR)) END AS value FROM v)"""


@query(_VERDICTS_SQL + """ SELECT '[' || CASE type WHEN 'ipv4' THEN 'ipv4-addr:value' WHEN 'domain' THEN 'domain-name:value' WHEN 'url' THEN 'url:value' ELSE 'file:hashes.''MD5''' END || ' = ''' || value || ''']' AS pattern,
 CASE verdict WHEN 'malicious' THEN 'malicious-activity' WHEN 'suspicious' THEN 'anomalous-activity' ELSE verdict END AS label, count(*) AS n FROM x GROUP BY 1, 2""")
def stix_rows(spark, sf_dir):
    return rules.stix(_verdicts(spark, sf_dir)).groupBy("pattern", "label").agg(F.count("*").alias("n"))


@query(_VERDICTS_SQL + " SELECT CASE type WHEN 'ipv4' THEN 'ip-dst' ELSE type END AS type, CASE type WHEN 'md5' THEN 'Payload delivery' ELSE 'Network activity' END AS category, verdict IN ('malicious', 'suspicious') AS to_ids, count(*) AS n FROM x GROUP BY 1, 2, 3")
def misp_rows(spark, sf_dir):
    return rules.misp(_verdicts(spark, sf_dir)).groupBy("type", "category", "to_ids").agg(F.count("*").alias("n"))


@query(_VERDICTS_SQL + " SELECT type, CASE type WHEN 'ipv4' THEN 'network_connection' WHEN 'domain' THEN 'dns' WHEN 'url' THEN 'proxy' ELSE 'file_event' END AS category, '''' || CASE type WHEN 'md5' THEN 'MD5=' ELSE '' END || value || '''' AS selection FROM x WHERE verdict IN ('suspicious', 'malicious')")
def sigma_rows(spark, sf_dir):
    return rules.sigma(_verdicts(spark, sf_dir), "suspicious").select("type", "category", "selection")


@query(_VERDICTS_SQL + """, s AS (SELECT *, row_number() OVER (ORDER BY type, value) + 1000000 AS sid FROM x WHERE verdict IN ('suspicious', 'malicious') AND type <> 'md5' AND type <> 'ipv4')
 SELECT sid, CASE type WHEN 'domain' THEN 'alert dns any any -> any any (msg:"Indicator: domain ' || value || ' (' || verdict || ')"; dns.query; content:"' || value || '"; nocase; sid:' || sid || '; rev:1; classtype:trojan-activity;)'
 ELSE 'alert http any any -> any any (msg:"Indicator: url ' || value || ' (' || verdict || ')"; http.host; content:"h' || ioc || '.example.com"; nocase; http.uri; content:"/a?b=1"; nocase; sid:' || sid || '; rev:1; classtype:trojan-activity;)' END AS rule FROM s""")
def suricata_rules(spark, sf_dir):
    return rules.suricata(_verdicts(spark, sf_dir).where("type <> 'ipv4'"), "suspicious", buckets=8)


@query(_SCORE_SQL + " SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def verdict_counts(spark, sf_dir):
    return rules.summary(scoring.score(source_results(spark, sf_dir), ["ioc"], "place"))


# --- windows of time --------------------------------------------------------------------------------------------


@query("SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, count(*) > 20 AS over FROM events GROUP BY 1, 2")
def daily_quota(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumn("over", F.col("n") > 20)


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 86400000000 THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    "SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS began_us, count(*) AS n FROM s GROUP BY user_id, k"
)
def session_batches(spark, sf_dir):
    """The batch form of the debounce: events of a user with less than a day of silence between them."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "1 day")).agg(F.min("ts").alias("began"), F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros(F.col("began").cast("timestamp")).alias("began_us"), "n")


from quarrylens.plans import assembly, captures, facts, feeds as feed_plans, reports, streams  # noqa: E402, I001

__all__ = ["QUERIES", "SQL", "assembly", "captures", "facts", "feed_plans", "reports", "streams"]
