"""A quality classifier from positive and unlabelled documents.

A logistic model of text statistics minimises the non-negative unbiased risk of Kiryo et al. (2017):
``prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)])``. P are the trusted positives (label 1 in the
training fold), U are all documents, whose texts need no label. Labels of 0 are used nowhere. Each step is one Spark
job over the table of features that sums gradient and curvature within tasks; a damped Newton step follows on the
driver. When the part for negatives falls below zero, the step goes back up that part, as the estimator prescribes.

The class prior is estimated from positives and unlabelled documents alone (best bin estimation, Garg et al. 2021): a
classifier that tells half of the positives from the unlabelled documents orders all scores; among its top bins the
share of unlabelled documents over that of the other positives is at least the prior, and nearest to it where hardly
any negative scores as high. The least ratio, within its margin of error, is the estimate.

Features are shares and counts of ``quality.text_counts``; ids, languages, sources and labels are none of them.
Every document trains as unlabelled text and every labelled row counts: nothing is sampled.

Defined results: a null or empty text is scored by its zero counts; a null doc_id counts as an empty string in the
fold and has no label; conflicting labels of a document count as 0; repeated rows give repeated results; extra
columns are not read; no documents give no rows. Without trusted positives all scores are the prior, 0.5 if there
are no labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import materialize, row_key, rows_of
from quarrylens.llm.quality import text_counts

FOLDS, HELD_OUT, BAR = 5, 0, 0.3
STEPS, RIDGE, CLIP = 25, 1e-3, 6.0
PRIOR_STEPS, PRIOR_BINS, PRIOR_DELTA, PRIOR_GAMMA = 8, 512, 0.1, 0.01


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def features() -> list[Column]:
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    shares = [share(c, "n_chars") for c in ("n_upper", "n_digits", "n_symbols", "n_punctuation", "n_marks", "n_other")]
    shares += [share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [F.log1p("n_words"), share("word_chars", "n_words"), share("n_common", "n_words"), share("n_distinct", "n_words"), share("n_lines", "n_words"), *[F.sqrt(s) for s in shares]]


def _design(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / std, -CLIP, CLIP)
    return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)


def _sums(table: DataFrame, mean: np.ndarray, std: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over all rows and over the trusted ones, at weights w: count, loss(-g), slope, curvature."""
    d = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 + d + d * d + 3 + 2 * d)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _design(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), mean, std)
            p = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            g = np.clip(x @ w, -500, 500)
            s = 1 / (1 + np.exp(-g))
            soft = np.logaddexp(0, g)
            parts = [[len(g), soft.sum()], s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel(), [p.sum(), soft[p].sum(), g[p].sum()], s[p] @ x[p], x[p].sum(axis=0)]
            out += np.concatenate(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["i", "v"])

    rows = table.select("x", "trusted").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row a coefficient
    return np.array([v for _, v in sorted((r["i"], r["v"]) for r in rows)])


def fit(table: DataFrame, mean: np.ndarray, std: np.ndarray, prior: float) -> np.ndarray:
    """Weights for ``table(x array<double>, trusted boolean)``."""
    d = 1 + 2 * len(mean)
    w, best, damp = np.zeros(d), (np.inf, np.zeros(d)), 1.0
    w[0] = np.log(prior / (1 - prior))
    last = w
    for _ in range(STEPS):
        a = _sums(table, mean, std, w)
        n, soft, rest = a[0], a[1], a[2:]
        slope_u, curve, rest = rest[:d] / n, rest[d : d + d * d].reshape(d, d) / n, rest[d + d * d :]
        n_p, soft_p, g_p = rest[:3]
        slope_p, x_p = rest[3 : 3 + d] / n_p, rest[3 + d :] / n_p
        positive = prior * (soft_p - g_p) / n_p
        negative = soft / n - prior * soft_p / n_p
        ridge = RIDGE * np.r_[0, np.ones(d - 1)]
        risk = positive + max(0.0, negative) + 0.5 * (ridge * w * w).sum()
        if risk < best[0] - 1e-7:
            gain, best, last, damp = best[0] - risk, (risk, w), w, min(1.0, 2 * damp)
            if gain < 1e-5:
                break
        else:
            damp /= 4
            w = last + (w - last) / 4
            if damp < 1e-3:
                break
            continue
        if negative < 0:
            step = slope_u - prior * slope_p  # up the part for negatives
        else:
            step = -(slope_u - prior * x_p + ridge * w)
        w = w + damp * np.linalg.solve(curve + np.diag(ridge + 1e-6), step)
    return best[1]


def tell_apart(table: DataFrame, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Weights that tell the trusted rows of ``table`` from all rows, at equal weight of both."""
    d = 1 + 2 * len(mean)
    w, ridge = np.zeros(d), RIDGE * np.r_[0, np.ones(d - 1)]
    for _ in range(PRIOR_STEPS):
        a = _sums(table, mean, std, w)
        n, rest = a[0], a[2:]
        slope_u, curve, rest = rest[:d] / n, rest[d : d + d * d].reshape(d, d) / n, rest[d + d * d :]
        slope_p, x_p = rest[3 : 3 + d] / rest[0], rest[3 + d :] / rest[0]
        # The curvature of the positives' half is taken to be that of all rows.
        step = np.linalg.solve(curve + np.diag(ridge + 1e-6), 0.5 * (slope_u + slope_p - x_p) + ridge * w)
        w = w - step / max(1.0, np.abs(step).max() / 4)
    return w


def best_bin(unlabelled: np.ndarray, positives: np.ndarray) -> float:
    """The class prior, from counts of unlabelled and of positive rows in bins of rising score."""
    u, p = (np.cumsum(x[::-1]) / x.sum() for x in (unlabelled, positives))
    error = sum(np.sqrt(np.log(4 / PRIOR_DELTA) / (2 * x.sum())) for x in (unlabelled, positives))
    seen = p > 0
    u, p = u[seen], p[seen]
    at = np.argmin((u + (1 + PRIOR_GAMMA) * error) / p)
    return float(min(max(u[at] / p[at], 0.01), 0.99))


def _margin(w: np.ndarray, mean: np.ndarray, std: np.ndarray) -> Column:
    """The score before the logistic function, as an expression of x."""
    k, g = len(mean), F.lit(float(w[0]))
    for i in range(k):
        z = F.least(F.lit(CLIP), F.greatest(F.lit(-CLIP), (F.get("x", F.lit(i)) - float(mean[i])) / float(std[i])))
        g = g + float(w[1 + i]) * z + float(w[1 + k + i]) * z * z
    return g


def estimate_prior(table: DataFrame, mean: np.ndarray, std: np.ndarray) -> float:
    """The share of positives among all rows of ``table(_id, x, trusted)``."""
    first = fold(F.col("_id")) % 2 == 0
    halves = table.select("x", "trusted", (F.col("trusted") & first).alias("fits"), (F.col("trusted") & ~first).alias("judges"))
    n_fit, n_judge = halves.agg(F.count_if("fits"), F.count_if("judges")).first()
    fits, judges = ("fits", "judges") if n_fit and n_judge else ("trusted", "trusted")
    w = tell_apart(halves.select("x", F.col(fits).alias("trusted")), mean, std)
    place = F.floor(PRIOR_BINS / (1 + F.exp(-_margin(w, mean, std))))
    bins = halves.groupBy(F.least(F.lit(PRIOR_BINS - 1), place).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if(judges).alias("p")).collect()  # at most PRIOR_BINS rows
    counts = np.zeros((2, PRIOR_BINS))
    for r in bins:
        counts[:, r["bin"]] = r["n"], r["p"]
    return best_bin(*counts)


def _learn(counted: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column]:
    """The stored table of ``counted(_id, x, ...)``, and the score as an expression of x."""
    known = labels.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    trusted = known.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("q")).where("q = 1").withColumn("trusted", F.lit(True)).drop("q")
    table = materialize(counted.join(trusted.hint("shuffle_hash"), "_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))), "features")

    k = len(features())
    figures = table.agg(F.count_if("trusted"), *[f(F.get("x", F.lit(i))) for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    if not figures[0]:
        return table, F.lit(0.5)
    mean, std = np.array(figures[1::2], float), np.maximum(np.array(figures[2::2], float), 1e-6)
    prior = estimate_prior(table, mean, std)
    return table, 1 / (1 + F.exp(-_margin(fit(table, mean, std, prior), mean, std)))


def _counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    return text_counts(docs.select(*keep, F.col("doc_id").alias("_id"), "text"), [*keep, "_id"]).select(*keep, "_id", F.array(*features()).alias("x"))


def score(docs: DataFrame, labels: DataFrame, keep: list[str], bar: float = BAR) -> DataFrame:
    """The columns ``keep`` of ``docs`` with held_out, score and predicted; learns from ``labels(doc_id, quality)``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), "doc_id", "text")
    table, value = _learn(_counted(rows, ["_row"]), labels)
    out = table.select("_row", (fold(F.col("_id")) == HELD_OUT).alias("held_out"), value.cast("double").alias("score"))
    clash = {c.lower() for c in keep}
    names = [c for c in ("held_out", "score") if c not in clash] + ([] if "predicted" in clash else ["predicted"])
    return out.withColumn("predicted", (F.col("score") >= bar).cast("int")).select("_row.*", *names)


def accepted(docs: DataFrame, labels: DataFrame, bar: float = BAR) -> DataFrame:
    """The documents with a score of ``bar`` or more, with all their columns.

    Texts are counted once, into the narrow table of features; its scores meet the rows again by key.
    """
    keyed = docs.select(*row_key("doc_id"), "doc_id", "text")
    table, value = _learn(_counted(keyed, ["_k1", "_k2"]), labels)
    return rows_of(docs, table.where(value >= bar), "doc_id")
