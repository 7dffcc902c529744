"""What feed payloads say beside their verdicts; see ``catalog`` for how tables are derived."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.plans.registry import query, table
from quarrylens.sources import feeds

_KINDS = ("virustotal", "urlhaus", "threatfox", "abuseipdb", "otx")


def _payload(k):
    """A payload of each source, of a number: with repeated, empty and missing fields."""
    n = lambda x: x.cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else n(p) for p in parts])
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    null = F.lit("null")
    t = text("t", k % 3)
    return {
        "virustotal": text('{"data":{"attributes":{"tags":["', t, '","","', t, '","peexe"],"first_submission_date":', F.when(k % 7 == 0, 0).otherwise(1_600_000_000 + k), ',"last_analysis_date":', F.when(k % 4 == 0, null).otherwise(n(k + 5)), "}}}"),
        "urlhaus": text('{"query_status":"', F.when(k % 4 == 0, "no_results").otherwise("ok"), '","tags":["elf","', t, '"],"date_added":', F.when(k % 3 == 0, null).otherwise(quoted(text("a", k))), ',"firstseen":"', text("f", k), '","lastseen":"l","urlhaus_reference":"', F.when(k % 6 == 1, "").otherwise(text("https://u/", k)), '"}'),
        "threatfox": text('{"query_status":"ok","data":[{"tags":["', t, '","b"],"malware":"m', k % 2, '","malware_printable":"', F.when(k % 3 == 0, "").otherwise(text("P", k % 2)), '","first_seen":"', text("s", k), '","reference":"r1"},{"tags":null,"malware":"m', k % 2, '","reference":null,"last_seen":"z"}]}'),
        "abuseipdb": text('{"data":{"countryCode":', F.when(k % 3 == 0, null).otherwise(F.lit('"DE"')), ',"usageType":"', F.when(k % 2 == 0, "").otherwise("hosting"), '","isp":"isp ', k % 5, '","lastReportedAt":"', text("d", k), '"}}'),
        "otx": text('{"pulse_info":{"pulses":[', F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: text('{"tags":["p', i, '","', t, '"]}')), ","), "]}}"),
    }


_DETAILS = """
SELECT 'virustotal' AS source, k, 't' || (k % 3) || '|peexe' AS tags, CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(1600000000 + k AS VARCHAR) END AS first_seen, CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k + 5 AS VARCHAR) END AS last_seen, 'https://www.virustotal.com/gui/search/v' || k AS refs FROM o WHERE k % 5 = 0
UNION ALL SELECT 'urlhaus', k, CASE WHEN k % 4 = 0 THEN '' ELSE 'elf|t' || (k % 3) END, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 3 = 0 THEN 'f' || k ELSE 'a' || k END, CASE WHEN k % 4 = 0 THEN NULL ELSE 'l' END, CASE WHEN k % 4 = 0 OR k % 6 = 1 THEN '' ELSE 'https://u/' || k END FROM o WHERE k % 5 = 1
UNION ALL SELECT 'threatfox', k, 't' || (k % 3) || '|b|' || CASE WHEN k % 3 = 0 THEN '' ELSE 'P' || (k % 2) || '|' END || 'm' || (k % 2), 's' || k, NULL, 'r1' FROM o WHERE k % 5 = 2
UNION ALL SELECT 'abuseipdb', k, CASE WHEN k % 3 = 0 THEN '' ELSE 'country:DE|' END || CASE WHEN k % 2 = 0 THEN '' ELSE 'usage:hosting|' END || 'isp:isp ' || (k % 5), NULL, 'd' || k, 'https://www.abuseipdb.com/check/v' || k FROM o WHERE k % 5 = 3
UNION ALL SELECT 'otx', k, 'p0|t' || (k % 3) || '|p1|p2|p3|p4|p5|p6|p7|p8|p9', NULL, NULL, 'https://otx.alienvault.com/indicator/domain/v' || k FROM o WHERE k % 5 = 4"""


@query(f"WITH o AS (SELECT o_orderkey AS k FROM orders) {_DETAILS}")
def feed_details(spark, sf_dir):
    """Tags, dates and references of five sources' payloads."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    value = F.concat(F.lit("v"), F.col("k").cast("string"))
    out = None
    for n, kind in enumerate(_KINDS):
        said = rows.where(F.col("k") % 5 == n).select(F.lit(kind).alias("source"), "k", feeds.details(kind, _payload(F.col("k"))[kind], F.lit("domain"), value).alias("d"))
        out = said if out is None else out.unionByName(said)
    return out.select("source", "k", F.array_join("d.tags", "|").alias("tags"), "d.first_seen", "d.last_seen", F.array_join("d.references", "|").alias("refs"))
