"""From texts to indicators, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.decoders import DECODERS
from quarrylens.functions.indicators import iocs_of, let, with_iocs


def extract(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep..., pos, type, value): the distinct indicators of every text, in the order of their extraction."""
    found = with_iocs(df.select(*keep, text_col), text_col)
    # The outer form: for the inner one Spark infers a filter on the array, whose expression it would push to the scan.
    each = found.select(*keep, F.posexplode_outer("iocs").alias("pos", "ioc")).where("pos is not null")
    return each.select(*keep, "pos", "ioc.type", "ioc.value")


def rank_decodings(df: DataFrame, text_col: str, limit: int = 5) -> DataFrame:
    """Every decoder tried on every text: (columns of df, operation, decoded, score, ioc_count), the best ``limit``.

    A score is .85 of the share of printable characters plus .05 for each indicator (at most .15), at most 1; below
    a share of .6 it is .3 of that share.
    """
    tried = F.filter(F.array(*[F.struct(F.lit(name).alias("operation"), f(F.col(text_col)).alias("decoded")) for name, f in sorted(DECODERS.items())]), lambda d: F.length(d["decoded"]) > 0)

    def rated(d):
        share = F.length(F.regexp_replace(d["decoded"], r"[^\P{C}\n\t\r]", "")) / F.length(d["decoded"])
        count = F.size(iocs_of(d["decoded"]))
        score = lambda n: F.when(share < 0.6, share * 0.3).otherwise(F.least(F.lit(1.0), share * 0.85 + F.least(F.lit(0.15), n * 0.05)))
        return let(count, lambda n: F.struct((-score(n)).alias("s"), (-n).alias("c"), d["operation"].alias("operation"), d["decoded"].alias("decoded")))

    # Ranked within the row, so equal rows keep their own results and nothing is shuffled.
    best = F.slice(F.sort_array(F.transform("_tried", rated)), 1, limit)
    out = df.select("*", tried.alias("_tried")).select(*df.columns, F.posexplode(best).alias("rank", "b"))
    return out.select(*df.columns, (F.col("rank") + 1).alias("rank"), "b.operation", "b.decoded", (-F.col("b.s")).alias("score"), (-F.col("b.c")).alias("ioc_count"))
