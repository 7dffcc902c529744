"""Relations between indicators of a batch ``verdicts(pos, type, value, tags)``, as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.indicators import url_host
from quarrylens.functions.network import ipv4_to_long

NOISE = "^(?i)(country|usage|isp):"


def _by_value(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(F.col("value").alias("target")).agg(F.max_by("type", "pos").alias("target_type"))


def url_to_host(verdicts: DataFrame) -> DataFrame:
    urls = verdicts.where("type = 'url'").select(F.col("value").alias("source"), url_host(F.col("value")).alias("target")).where("target <> ''")
    return urls.join(_by_value(verdicts), "target").select("source", "target", F.lit("url_to_host").alias("kind"), F.concat(F.lit("URL is hosted on "), "target").alias("evidence"))


def email_to_domain(verdicts: DataFrame) -> DataFrame:
    mails = verdicts.where("type = 'email' and value like '%@%'").select(F.col("value").alias("source"), F.lower(F.regexp_extract("value", "@(.*)$", 1)).alias("target"))
    return mails.join(_by_value(verdicts), "target").select("source", "target", F.lit("email_to_domain").alias("kind"), F.concat(F.lit("Email at "), "target").alias("evidence"))


def shared_subnet(verdicts: DataFrame) -> DataFrame:
    """Pairs of distinct IPv4 addresses of a /24 network, of which there are 256 at most, so that pairs stay linear.

    Notations of one address count as one, shown as it was first written.
    """
    ips = verdicts.where("type = 'ipv4'").select("value", "pos", ipv4_to_long(F.col("value")).alias("n")).where("n is not null")
    ips = ips.groupBy("n").agg(F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos")).select("value", "pos", F.floor(F.col("n") / 256).alias("net"))
    a, b = ips.alias("a"), ips.alias("b")
    pairs = a.join(b, (F.col("a.net") == F.col("b.net")) & (F.col("a.pos") < F.col("b.pos")))
    net = F.concat_ws(".", F.floor(F.col("a.net") / 65536), F.floor(F.col("a.net") / 256) % 256, F.col("a.net") % 256, F.lit("0/24"))
    return pairs.select(F.col("a.value").alias("source"), F.col("b.value").alias("target"), F.lit("shared_subnet").alias("kind"), F.concat(F.lit("both in "), net).alias("evidence"))


def shared_tag(verdicts: DataFrame, all_pairs: bool = False) -> DataFrame:
    """Indicators that share a tag. Each is linked to the first one with the tag, which keeps all groups whole.

    ``all_pairs`` gives every pair instead; that grows with the square of a tag's use and is for small batches.
    """
    tagged = verdicts.select("value", "pos", F.explode("tags").alias("tag")).where(~F.col("tag").rlike(NOISE))
    tagged = tagged.groupBy("tag", "value").agg(F.min("pos").alias("pos"))
    if all_pairs:
        a, b = tagged.alias("a"), tagged.alias("b")
        pairs = a.join(b, (F.col("a.tag") == F.col("b.tag")) & (F.col("a.pos") < F.col("b.pos"))).select(F.col("a.value").alias("source"), F.col("b.value").alias("target"), F.col("a.tag").alias("tag"))
    else:
        first = tagged.groupBy("tag").agg(F.min_by("value", "pos").alias("source"), F.count("*").alias("n")).where("n > 1").drop("n")
        pairs = tagged.join(first, "tag").where("value <> source").select("source", F.col("value").alias("target"), "tag")
    return pairs.select("source", "target", F.lit("shared_tag").alias("kind"), F.concat(F.lit("both tagged '"), "tag", F.lit("'")).alias("evidence"))


def correlate(verdicts: DataFrame) -> DataFrame:
    return url_to_host(verdicts).unionByName(email_to_domain(verdicts)).unionByName(shared_subnet(verdicts)).unionByName(shared_tag(verdicts))
