"""Reports of verdicts as rows: JSON documents and Markdown sections, one an indicator, for Spark's text writers.

``verdicts`` has type, value, verdict, confidence, tags, references; ``results`` has type, value, ord, source, verdict,
score, tags, error: what each source said of an indicator. Sources are few, so an indicator's results are a short list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.indicators import defang

# How many entries a section shows.
TAGS, SOURCE_TAGS, REFERENCES = 25, 5, 10


def _with_results(verdicts: DataFrame, results: DataFrame) -> DataFrame:
    each = F.struct("ord", "source", "verdict", "score", "tags", "error")
    by = results.groupBy("type", "value").agg(F.sort_array(F.collect_list(each)).alias("sources"))
    none = F.array().cast(by.schema["sources"].dataType)
    return verdicts.join(by, ["type", "value"], "left").withColumn("sources", F.coalesce("sources", none))


def json_rows(verdicts: DataFrame, results: DataFrame) -> DataFrame:
    """(type, value, json): one JSON document an indicator, its sources in order; confidences are written without exponents."""
    sources = F.transform("sources", lambda x: F.struct(x["source"].alias("source"), x["verdict"].alias("verdict"), x["score"].alias("score"), x["tags"].alias("tags"), x["error"].alias("error")))
    rows = _with_results(verdicts, results).withColumn("sources", sources)
    json = F.to_json(F.struct("value", "type", "verdict", "confidence", "tags", "references", "sources"), {"ignoreNullFields": "false"})
    digits = F.rtrim(F.col("confidence").try_cast("decimal(38,37)").cast("string"), F.lit("0"))
    field = lambda text: F.concat(F.lit('"confidence":'), text, F.lit(","))
    small = (F.col("confidence") >= 1e-20) & (F.col("confidence") < 1e-3)
    return rows.select("type", "value", F.when(small, F.replace(json, field(F.col("confidence").cast("string")), field(digits))).otherwise(json).alias("json"))


def markdown_rows(verdicts: DataFrame, results: DataFrame) -> DataFrame:
    """(confidence, value, type, section): one section an indicator, its value defanged.

    Written in order of falling confidence and value (``orderBy`` spreads that over tasks), sections need no numbers.
    """
    percent = F.concat(F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))
    head = F.concat(F.lit("### `"), defang(F.col("value")), F.lit("` — "), F.col("type"), F.lit(" — **"), F.upper("verdict"), F.lit("** ("), percent, F.lit(")"))

    def line(x):
        notes = F.coalesce(x["error"], F.array_join(F.slice(F.coalesce(x["tags"], F.array().cast("array<string>")), 1, SOURCE_TAGS), ", "))
        said = F.when(x["error"].isNotNull(), "error").otherwise(x["verdict"])
        return F.concat(F.lit("| "), x["source"], F.lit(" | "), said, F.lit(" | "), F.format_string("%.2f", x["score"]), F.lit(" | "), notes, F.lit(" |"))

    table = F.concat(F.array(F.lit("| Source | Verdict | Score | Notes |"), F.lit("| ------ | ------- | ----- | ----- |")), F.transform("sources", line))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("**Tags:** "), F.array_join(F.slice("tags", 1, TAGS), ", ")))
    links = F.when(F.size("references") > 0, F.array_join(F.concat(F.array(F.lit("**References:**")), F.transform(F.slice("references", 1, REFERENCES), lambda x: F.concat(F.lit("- "), x))), "\n"))
    parts = F.array_compact(F.array(head, tags, F.array_join(table, "\n"), links))
    return _with_results(verdicts, results).select("confidence", "value", "type", F.array_join(parts, "\n\n").alias("section"))


def counts(verdicts: DataFrame) -> DataFrame:
    """(verdict, n) for all four verdicts, in their order of severity, as ``rank`` from 0."""
    names = ("malicious", "suspicious", "benign", "unknown")
    totals = verdicts.agg(*[F.count_if(F.col("verdict") == n).alias(n) for n in names])
    return totals.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("verdict"), F.col(n).alias("n")) for n in names])).alias("rank", "x")).select("rank", "x.verdict", "x.n")


def finding_rows(findings: DataFrame) -> DataFrame:
    """(path, rule, line, json) of ``findings(path, rule, severity, category, evidence)``, for both kinds of reports."""
    line = F.concat(F.lit("- **"), "rule", F.lit("** ("), F.col("severity").cast("string"), F.lit(", "), "category", F.lit("): "), F.array_join("evidence", ", "))
    return findings.select("path", "rule", line.alias("line"), F.to_json(F.struct("path", "rule", "severity", "category", "evidence")).alias("json"))
