"""Weighted verdicts from the results of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the shares, and the least score that a hit counts with.
PRESENCE, MALICIOUS, SUSPICIOUS, BENIGN = 0.5, 0.25, 0.25, 0.3
AMOUNT = "decimal(28,12)"
RANK = {"unknown": 0, "benign": 1, "suspicious": 2, "malicious": 3}


def rank(verdict: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in RANK.items():
        out = F.when(verdict == name, n).otherwise(out)
    return out


def at_least(df: DataFrame, verdict: str) -> DataFrame:
    """Rows whose verdict is as severe as ``verdict``, whose name may have any case."""
    if verdict.lower() not in RANK:
        raise ValueError(f"unknown verdict {verdict!r}")
    return df.where(rank(F.col("verdict")) >= RANK[verdict.lower()])


def score(results: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One verdict and confidence a key from ``results(keys..., weight, verdict, score, error)``.

    Failed results do not count; unknown ones dilute the shares. One combined aggregation, no join.
    Amounts are summed as decimals, so that the order of a sum does not decide at a threshold. Amounts that are no finite
    numbers do not count.

    With ``order``, scores of hits are added as doubles in that order instead, as an engine does that reads the rows in it;
    running sums over sorted rows take the place of the combined aggregation. Rows that share their place in it, or have
    none, all count; smaller scores come first among them.
    """
    valid = F.col("error").isNull()
    hit = F.col("weight") * F.greatest("score", F.lit(PRESENCE))
    amount_of = lambda name, amount: F.when(valid & (F.col("verdict") == name), amount)
    summed = lambda amount: F.coalesce(F.sum(amount.try_cast(AMOUNT)).cast("double"), F.lit(0.0))
    hits = {"m": amount_of("malicious", hit), "s": amount_of("suspicious", hit)}
    if order is None:
        hits = {c: summed(x) for c, x in hits.items()}
    else:
        in_order = Window.partitionBy(*keys).orderBy(order, *hits.values())
        so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
        finite = lambda x: F.when(x.try_cast(AMOUNT).isNotNull(), x)
        running = F.struct(*[F.sum(finite(x)).over(so_far).alias(c) for c, x in hits.items()])
        results = results.select("*", F.row_number().over(in_order).alias("_row"), running.alias("_hits"))
        hits = {c: F.coalesce(F.max_by("_hits", "_row")[c], F.lit(0.0)) for c in hits}
    sums = results.groupBy(*keys).agg(
        F.count_if(valid).alias("n_valid"), summed(F.when(valid, F.col("weight"))).alias("total"), *[x.alias(c) for c, x in hits.items()], summed(amount_of("benign", F.col("weight"))).alias("b")
    )
    base = F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    sums = sums.select(*keys, "n_valid", *[(F.col(c) / base).alias(c) for c in "msb"])
    m, s, b = F.col("m"), F.col("s"), F.col("b")
    one = F.lit(1.0)
    none = F.col("n_valid") == 0
    verdict = F.when(none, "unknown").when(m >= MALICIOUS, "malicious").when((s >= SUSPICIOUS) | (m > 0), "suspicious").when(b >= BENIGN, "benign").otherwise("unknown")
    sure = F.when(none, 0.0).when(m >= MALICIOUS, F.least(one, m + 0.5 * s)).when((s >= SUSPICIOUS) | (m > 0), F.least(one, s + m)).when(b >= BENIGN, b).otherwise(0.0)
    return sums.select(*keys, verdict.alias("verdict"), sure.alias("confidence"))


def ordered_union(results: DataFrame, keys: list[str], order: str, items: str, out: str) -> DataFrame:
    """Distinct entries of the arrays ``items`` of valid results, in the order of first sight.

    The first place of each entry is a combined aggregate, so a key with very many results sends each entry once.
    """
    each = results.where("error is null").select(*keys, order, F.posexplode(items).alias("_p", "_x"))
    first = each.groupBy(*keys, "_x").agg(F.min(F.struct(order, "_p")).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_x"))), lambda e: e["_x"]).alias(out))
