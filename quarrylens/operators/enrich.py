"""Enrichment of indicators by source tables and a cache with time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sources with their weights and the indicator types that each supports.
SOURCES = (
    ("netmeta", 0.20, False, "ipv4 ipv6"),
    ("tor_exit", 0.40, False, "ipv4 ipv6"),
    ("urlhaus", 0.85, True, "url domain ipv4 md5 sha256"),
    ("threatfox", 0.85, True, "url domain ipv4 ipv6 md5 sha1 sha256 email"),
    ("abuseipdb", 0.80, True, "ipv4 ipv6"),
    ("otx", 0.75, True, "ipv4 ipv6 domain url md5 sha1 sha256 cve"),
    ("virustotal", 0.90, True, "ipv4 ipv6 domain url md5 sha1 sha256"),
)
KEY = ["source", "ioc_type", "ioc_value"]
DEFAULT_TTL = 86_400


def sources(spark: SparkSession) -> DataFrame:
    """The dimension of sources: seven rows, in the order of their evaluation."""
    rows = [(n, name, w, key, types.split()) for n, (name, w, key, types) in enumerate(SOURCES)]
    return spark.createDataFrame(rows, "ord int, source string, weight double, requires_key boolean, supported array<string>")


def applicable(iocs: DataFrame, dim: DataFrame) -> DataFrame:
    """Each indicator (type, value) with every source that supports its type: an equality join on the type.

    ``dim`` has a few rows; it is exploded to (source, type) and Spark broadcasts it by its size.
    """
    by_type = dim.select("ord", "source", "weight", F.explode("supported").alias("type"))
    return iocs.join(by_type, "type")


def fresh(cache: DataFrame, as_of: int) -> DataFrame:
    return cache.where(F.col("expires_at") > as_of)


def latest(cache: DataFrame) -> DataFrame:
    """The newest entry of each key; of equals the one that expires last, then the larger payload."""
    newest = F.max_by(F.struct("payload", "cached_at", "expires_at"), F.struct("cached_at", "expires_at", "payload")).alias("e")
    return cache.groupBy(*KEY).agg(newest).select(*KEY, "e.*")


def upsert(cache: DataFrame, results: DataFrame, now: int, ttl: int = DEFAULT_TTL) -> DataFrame:
    """The cache after storing ``results(source, ioc_type, ioc_value, payload, error)``; failed lookups are not kept."""
    new = results.where("error is null").select(*KEY, "payload", F.lit(now).cast("long").alias("cached_at"), F.lit(now + ttl).cast("long").alias("expires_at"))
    return latest(cache.select(new.columns).unionByName(new))


def purge(cache: DataFrame, as_of: int) -> DataFrame:
    return fresh(cache, as_of)


def stats(cache: DataFrame, as_of: int) -> DataFrame:
    return cache.agg(F.count("*").alias("total"), F.count_if(F.col("expires_at") > as_of).alias("fresh"), F.count_if(F.col("expires_at") <= as_of).alias("expired"))


def misses(wanted: DataFrame, cache: DataFrame, as_of: int) -> DataFrame:
    """Keys that the cache does not answer: only these need a lookup."""
    return wanted.join(fresh(cache, as_of).select(*KEY), KEY, "left_anti")
