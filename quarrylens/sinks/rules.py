"""Verdicts as rows of STIX, MISP, Sigma, Suricata and Markdown. Ids follow from the values, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.indicators import url_host
from quarrylens.operators.scoring import at_least
from quarrylens.storage import fresh_path

# Notations of the formats.
STIX = {"ipv4": "ipv4-addr:value", "ipv6": "ipv6-addr:value", "domain": "domain-name:value", "url": "url:value", "email": "email-addr:value", "md5": "file:hashes.'MD5'", "sha1": "file:hashes.'SHA-1'", "sha256": "file:hashes.'SHA-256'"}
STIX_LABEL = {"malicious": "malicious-activity", "suspicious": "anomalous-activity", "benign": "benign", "unknown": "unknown"}
MISP = {"ipv4": "ip-dst", "ipv6": "ip-dst", "domain": "domain", "url": "url", "email": "email", "md5": "md5", "sha1": "sha1", "sha256": "sha256"}
SIGMA = {"ipv4": ("network_connection", "DestinationIp", "high"), "ipv6": ("network_connection", "DestinationIp", "high"), "domain": ("dns", "QueryName", "high"), "url": ("proxy", "c-uri", "high"), "email": ("email", "sender", "medium"), "md5": ("file_event", "Hashes|contains", "high"), "sha1": ("file_event", "Hashes|contains", "high"), "sha256": ("file_event", "Hashes|contains", "high")}
HASH_PREFIX = {"md5": "MD5=", "sha1": "SHA1=", "sha256": "SHA256="}
FIRST_SID = 1_000_001


def _by_type(table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(F.col("type") == k, v).otherwise(out)
    return out


def _uuid(*parts: Column) -> Column:
    h = F.sha1(F.concat_ws("|", *parts))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def stix(verdicts: DataFrame) -> DataFrame:
    """(id, pattern, confidence int, label) for the types that have a pattern."""
    safe = F.replace(F.replace(F.col("value"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    label = F.lit("unknown")
    for k, v in STIX_LABEL.items():
        label = F.when(F.col("verdict") == k, v).otherwise(label)
    rows = verdicts.withColumn("_p", _by_type(STIX)).where("_p is not null")
    return rows.select(
        F.concat(F.lit("indicator--"), _uuid(F.lit("stix"), F.col("type"), F.col("value"))).alias("id"),
        F.concat(F.lit("["), "_p", F.lit(" = '"), safe, F.lit("']")).alias("pattern"),
        F.bround(F.col("confidence") * 100).cast("int").alias("confidence"),
        label.alias("label"),
    )


def misp(verdicts: DataFrame) -> DataFrame:
    """(type, category, value, to_ids, comment) attributes."""
    category = F.when(F.col("type").isin(*HASH_PREFIX), "Payload delivery").otherwise("Network activity")
    comment = F.concat(F.lit("verdict="), "verdict", F.lit(" confidence="), F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))
    rows = verdicts.withColumn("_t", _by_type(MISP)).where("_t is not null")
    return rows.select(F.col("_t").alias("type"), category.alias("category"), "value", F.col("verdict").isin("malicious", "suspicious").alias("to_ids"), comment.alias("comment"))


def threat_level(verdicts: DataFrame) -> DataFrame:
    worst = F.coalesce(F.max(F.when(F.col("verdict") == "malicious", 2).when(F.col("verdict") == "suspicious", 1).otherwise(0)), F.lit(0))
    return verdicts.agg(F.when(worst == 2, "1").when(worst == 1, "2").otherwise("4").alias("threat_level"))


def sigma(verdicts: DataFrame, least: str = "malicious") -> DataFrame:
    """(type, category, field, level, id, selection): one row an indicator, to be listed under its type's rule.

    A rule lists all its values, so writers stream the rows of a type in order instead of holding them as one text.
    """
    rows = at_least(verdicts, least).where(F.col("type").isin(*SIGMA))
    prefix = F.coalesce(_by_type(HASH_PREFIX), F.lit(""))
    quoted = F.concat(F.lit("'"), F.replace(F.replace(F.concat(prefix, F.col("value")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    return rows.select("type", *[_by_type({k: v[i] for k, v in SIGMA.items()}).alias(n) for i, n in enumerate(("category", "field", "level"))], _uuid(F.lit("sigma"), F.col("type")).alias("id"), quoted.alias("selection"))


def suricata(verdicts: DataFrame, least: str = "malicious", first_sid: int = FIRST_SID, buckets: int = 256) -> DataFrame:
    """(sid long, rule) for addresses, domains and URLs, numbered by (type, value) without gaps.

    Numbers are taken within buckets of the order and shifted by what lies before, so no task sees all rows.
    """
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit(";"), F.lit("\\;")), F.lit("|"), F.lit("\\|"))
    host = url_host(F.col("value"))
    path = F.regexp_extract("value", r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    path = F.when(path == "", "/").when(path.startswith("?"), F.concat(F.lit("/"), path)).otherwise(path)
    body = (
        F.when(F.col("type").isin("ipv4", "ipv6"), F.concat(F.lit("alert ip any any -> "), "value", F.lit(' any (msg:"')))
        .when(F.col("type") == "domain", F.lit('alert dns any any -> any any (msg:"'))
        .when((F.col("type") == "url") & (host != ""), F.lit('alert http any any -> any any (msg:"'))
    )
    content = (
        F.when(F.col("type") == "domain", F.concat(F.lit('dns.query; content:"'), escape(F.col("value")), F.lit('"; nocase; ')))
        .when(F.col("type") == "url", F.concat(F.lit('http.host; content:"'), escape(host), F.lit('"; nocase; http.uri; content:"'), escape(path), F.lit('"; nocase; ')))
        .otherwise("")
    )
    spark, stored = verdicts.sparkSession, fresh_path(verdicts.sparkSession, "rules")
    rows = at_least(verdicts, least).where(body.isNotNull()).select("type", "value", "verdict")
    # Stored, so that both uses below read one dealing of the rows. Rows held by ``persist`` would also serve a later call, even after a table is written anew.
    rows = rows.repartitionByRange(buckets, "type", "value").withColumn("_k", F.spark_partition_id())
    rows.write.parquet(stored)
    rows = spark.read.schema(rows.schema).parquet(stored)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("type", "value")))
    starts = rows.groupBy("_k").agg(F.count("*").alias("_size"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_size").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most ``buckets`` rows
    sid = F.col("_start") + F.col("_n") - 1 + first_sid
    msg = F.concat(F.lit("Indicator: "), "type", F.lit(" "), "value", F.lit(" ("), "verdict", F.lit(')"; '))
    return rows.join(F.broadcast(starts), "_k").select(sid.cast("long").alias("sid"), F.concat(body, msg, content, F.lit("sid:"), sid.cast("string"), F.lit("; rev:1; classtype:trojan-activity;)")).alias("rule"))


def summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))
