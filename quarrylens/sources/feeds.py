"""Feed payloads (JSON texts) to verdict, score, tags, dates and references, by fixed schemas and conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The schemas of the payloads and the bounds of their scores.
SCHEMAS = {
    "virustotal": "data struct<attributes: struct<last_analysis_stats: struct<malicious: int, suspicious: int, harmless: int, undetected: int, timeout: int>, tags: array<string>, first_submission_date: long, last_analysis_date: long>>",
    "urlhaus": "query_status string, url_status string, tags array<string>, date_added string, firstseen string, last_online string, lastseen string, urlhaus_reference string",
    "threatfox": "query_status string, data array<struct<confidence_level: int, malware: string, malware_printable: string, tags: array<string>, first_seen: string, last_seen: string, reference: string>>",
    "abuseipdb": "data struct<abuseConfidenceScore: int, isWhitelisted: boolean, countryCode: string, usageType: string, isp: string, lastReportedAt: string>",
    "otx": "pulse_info struct<count: int, pulses: array<struct<tags: array<string>>>>, reputation int",
}
PAGES = {"virustotal": "https://www.virustotal.com/gui/search/", "abuseipdb": "https://www.abuseipdb.com/check/", "otx": "https://otx.alienvault.com/indicator/"}
OTX_SECTIONS = {"cve": "cve", "ipv4": "IPv4", "ipv6": "IPv6", "domain": "domain", "url": "url", "md5": "file", "sha1": "file", "sha256": "file"}
OTX_PULSES = 10


def _result(verdict: Column, score: Column) -> Column:
    return F.struct(verdict.alias("verdict"), score.cast("double").alias("score"))


def interpret(source: str, payload: Column) -> Column:
    """struct<verdict, score> of a payload; unknown and 0 where it says nothing or is no JSON."""
    p = F.from_json(payload, SCHEMAS[source])
    zero = F.lit(0.0)
    if source == "virustotal":
        s = p["data"]["attributes"]["last_analysis_stats"]
        n = {k: F.coalesce(s[k], F.lit(0)) for k in ("malicious", "suspicious", "harmless", "undetected")}
        total = n["malicious"] + n["suspicious"] + n["harmless"] + n["undetected"]
        share = F.when(n["malicious"] >= 5, n["malicious"] / total).when(total > 0, (n["malicious"] + n["suspicious"]) / total).otherwise(zero)
        verdict = F.when(n["malicious"] >= 5, "malicious").when(n["malicious"] + n["suspicious"] > 0, "suspicious").when(total > 0, "benign").otherwise("unknown")
        return _result(verdict, share)
    if source == "urlhaus":
        hit = p["query_status"] == "ok"
        verdict = F.when(hit & (p["url_status"] == "offline"), "suspicious").when(hit, "malicious").otherwise("unknown")
        return _result(verdict, F.when(~F.coalesce(hit, F.lit(False)), zero).when(p["url_status"] == "online", 0.95).when(p["url_status"] == "offline", 0.7).otherwise(0.85))
    if source == "threatfox":
        best = F.coalesce(F.array_max(F.transform(p["data"], lambda x: x["confidence_level"])), F.lit(0)) / 100
        hit = (p["query_status"] == "ok") & (F.size(p["data"]) > 0)
        return _result(F.when(hit & (best >= 0.5), "malicious").when(hit, "suspicious").otherwise("unknown"), F.when(hit, best).otherwise(zero))
    if source == "abuseipdb":
        n = F.coalesce(p["data"]["abuseConfidenceScore"], F.lit(0))
        white = F.coalesce(p["data"]["isWhitelisted"], F.lit(False))
        return _result(F.when(white, "benign").when(n >= 75, "malicious").when(n > 0, "suspicious").otherwise("unknown"), F.when(white, zero).otherwise(n / 100))
    # Without a count, or with 0, the pulses themselves are counted.
    count = F.coalesce(p["pulse_info"]["count"], F.lit(0))
    pulses, reputation = F.when(count != 0, count).otherwise(F.coalesce(F.size(p["pulse_info"]["pulses"]), F.lit(0)).cast("int")), F.coalesce(p["reputation"], F.lit(0))
    bad = (pulses >= 5) | (reputation < -2)
    score = F.when(bad, F.least(F.lit(1.0), pulses / 10 + F.greatest(zero, -reputation / 10))).when(pulses >= 1, F.least(F.lit(0.6), pulses / 10)).otherwise(zero)
    return _result(F.when(bad, "malicious").when(pulses >= 1, "suspicious").otherwise("unknown"), score)


def details(source: str, payload: Column, ioc_type: Column, value: Column) -> Column:
    """struct<tags, first_seen, last_seen, references> of a payload: what it says beside its verdict.

    Tags and references are in the order of the payload, each tag once; empty ones are left out.
    """
    p = F.from_json(payload, SCHEMAS[source])
    none = F.array().cast("array<string>")
    some = lambda x: F.when(x != "", x)
    given = lambda tags: F.coalesce(F.array_distinct(F.filter(tags, lambda t: t.isNotNull() & (t != ""))), none)
    told = lambda tags, first, last, references: F.struct(tags.alias("tags"), first.cast("string").alias("first_seen"), last.cast("string").alias("last_seen"), references.alias("references"))
    page = F.array(F.concat(F.lit(PAGES.get(source, "")), value))
    null = F.lit(None)
    if source == "virustotal":
        a = p["data"]["attributes"]
        date = lambda d: F.when(d != 0, d)
        return told(given(a["tags"]), date(a["first_submission_date"]), date(a["last_analysis_date"]), page)
    if source == "urlhaus":
        hit = p["query_status"] == "ok"
        in_hit = lambda x: F.when(hit, x)
        return told(given(in_hit(p["tags"])), in_hit(F.coalesce(some(p["date_added"]), some(p["firstseen"]))), in_hit(F.coalesce(some(p["last_online"]), some(p["lastseen"]))), F.coalesce(F.array_compact(F.array(in_hit(some(p["urlhaus_reference"])))), none))
    if source == "threatfox":
        rows = F.when(p["query_status"] == "ok", p["data"])
        family = lambda x: F.array(F.coalesce(some(x["malware_printable"]), some(x["malware"])))
        tags = F.flatten(F.transform(rows, lambda x: F.concat(F.coalesce(x["tags"], none), family(x))))
        first = F.get(rows, F.lit(0))
        return told(given(tags), first["first_seen"], first["last_seen"], F.coalesce(F.array_compact(F.transform(rows, lambda x: some(x["reference"]))), none))
    if source == "abuseipdb":
        d = p["data"]
        named = F.array(*[F.concat(F.lit(f"{name}:"), some(d[field])) for name, field in (("country", "countryCode"), ("usage", "usageType"), ("isp", "isp"))])
        return told(given(named), null, d["lastReportedAt"], page)
    tags = F.flatten(F.transform(F.slice(p["pulse_info"]["pulses"], 1, OTX_PULSES), lambda x: F.coalesce(x["tags"], none)))
    section = F.element_at(F.create_map(*[F.lit(x) for pair in OTX_SECTIONS.items() for x in pair]), ioc_type)
    return told(given(tags), null, null, F.array(F.concat(F.lit(PAGES["otx"]), section, F.lit("/"), value)))


def exit_addresses(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(value) for each distinct address of a text table of exit relays; lines that begin with # are comments."""
    text = F.col(line_col)
    return lines.where(~text.startswith("#")).select(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")).alias("value")).where("value <> ''").distinct()


def exit_results(iocs: DataFrame, exits: DataFrame) -> DataFrame:
    """What the list says of the addresses among ``iocs(type, value)``: an equality join that Spark sizes itself."""
    listed = exits.select("value", F.lit(True).alias("listed"))
    rows = iocs.where(F.col("type").isin("ipv4", "ipv6")).join(listed, "value", "left")
    hit = F.coalesce("listed", F.lit(False))
    tags = F.when(hit, F.array(F.lit("tor"), F.lit("anonymizer"))).otherwise(F.array().cast("array<string>"))
    return rows.select("type", "value", F.lit("tor_exit").alias("source"), F.when(hit, "suspicious").otherwise("unknown").alias("verdict"), F.when(hit, 0.5).otherwise(0.0).alias("score"), tags.alias("tags"))
