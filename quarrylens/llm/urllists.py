"""URL filters as a temporal join with dated lists, in DataFrame functions alone.

List entries (kind, pattern, day, action) say that a pattern was added to or removed from a block list on a day.
The entries of a pattern become validity intervals: from the day of an addition to the day before the pattern's next
entry. A capture is evaluated against the entries active on the day of its fetch. Kinds: ``url`` (the address
without fragment), ``host`` (the host alone) and ``domain`` (the host and all hosts below it).

The as-of join is an equality on pattern and on a period of PERIOD_DAYS days, plus the range condition. The intervals
of a pattern do not overlap, so a capture meets each pattern at most once, and a pattern with very many intervals and
captures compares only those of one period. Both sides are dealt out by the same keys and nothing above needs a
pattern's rows together, so adaptive execution can split a hot pattern.

Defined results: a null address has a null host, matches nothing and is kept; of several entries of a pattern on one
day a removal wins; repeated captures are judged each; entries with a null field are ignored; a capture without day
matches nothing; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 32
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute address, without user, port and dots at its end; null if nothing is left."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), F.lit(""))


def plain(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def validity(entries: DataFrame) -> DataFrame:
    """(kind, pattern, begin, end): days on which patterns are listed; end is exclusive, null while listed still.

    Entries are aggregated to one a pattern and day first, so a pattern's window holds as many rows as it has days.
    """
    fine = entries.where(F.col("kind").isNotNull() & F.col("pattern").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    daily = fine.groupBy("kind", "pattern", "day").agg(F.bool_and(F.col("action") == "add").alias("on"))
    over = Window.partitionBy("kind", "pattern").orderBy("day")
    return daily.select("kind", "pattern", F.col("day").alias("begin"), F.lead("day").over(over).alias("end"), "on").where("on").drop("on")


def apply_lists(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures(page_id, url, day)`` with host, n_active (patterns that match and are active), kinds and blocked.

    ``day`` is a date. Open intervals reach to the last capture's day, the only figure that the driver reads.
    """
    last = captures.agg(F.max("day")).first()[0]
    period = lambda c: F.floor(F.unix_date(c) / PERIOD_DAYS)
    spans = validity(entries).where(F.col("begin") <= F.lit(last))
    to = F.least(F.coalesce(F.date_sub("end", 1), F.lit(last)), F.lit(last))
    spans = spans.select("kind", "pattern", "begin", F.col("end"), F.explode(F.sequence(period(F.col("begin")), period(to))).alias("period"))

    row = captures.select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", "day", host_of(F.col("url")).alias("host"))
    labels = F.split("host", r"\.")
    suffixes = F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    of = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("pattern"))
    keys = F.concat(F.array(of("url", plain(F.col("url"))), of("host", F.col("host"))), F.transform(F.coalesce(suffixes, F.array().cast("array<string>")), lambda x: of("domain", x)))
    probes = row.select("uid", "page_id", "host", "day", F.explode(keys).alias("k")).select("uid", "page_id", "host", "day", "k.*", period(F.col("day")).alias("period"))
    hit = (F.col("day") >= F.col("begin")) & (F.col("end").isNull() | (F.col("day") < F.col("end")))
    joined = probes.join(spans, ["kind", "pattern", "period"], "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    return joined.groupBy("uid").agg(
        F.first("page_id").alias("page_id"),
        F.first("host").alias("host"),
        F.first("day").alias("fetched"),
        F.count_if("hit").alias("n_active"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("hit"), F.col("kind")))), ",").alias("kinds"),
        F.bool_or("hit").alias("blocked"),
    ).drop("uid")
