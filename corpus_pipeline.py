"""The corpus pipeline: quality rules, quality classifier, near and substring deduplication, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import packing, pu, quality, repeats, similar
from quarrylens.llm.common import materialize
from quarrylens.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near their language's distributions.

    Null and empty texts fail the base rules. Repeated rows are judged alike, each by its own text and language.
    """
    return quality.accepted(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on what is left of the labelled ones, takes for good.

    Null and empty texts are scored by their zero counts; repeated rows get equal scores; without labels all stay.
    """
    return pu.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose 5-word shingles are similar (0.8 or more).

    It is the row with the smallest doc_id, of equal ones with the smallest digest of the text; rows that share an id
    but not a group all stay. Rows with equal ids and texts fall to the one with the smallest hash. Rows without id
    stay. Null and empty texts are one text; an empty table gives an empty result; names of columns never clash.
    """
    others = [f"_doc.`{c}`" for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    first = similar.similar_texts(docs).groupBy("component_id").agg(F.min(F.struct("doc_id", "digest")).alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.digest").alias("_digest"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), similar.digest(F.col("text")).alias("_digest"), F.struct("*").alias("_doc"))
    kept = rows.join(first.hint("shuffle_hash"), ["_id", "_digest"], "left_semi")
    one = kept.groupBy("_id", "_digest").agg(F.min_by("_doc", F.xxhash64(*others)).alias("_doc"))
    return one.select("_doc.*").unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with smaller ids hold; null texts become empty ones.

    All rows stay, repeated ones too: rows with equal ids take nothing from each other. Rows without id rank last.
    A column ``n_chars`` gets the new length; all others, whatever their names, stay as they are.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"_{c}") for c in others]).alias("_rest"))
    left = repeats.remove_repeats(packed)
    of = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col(f"_rest.`_{c}`") for c in others}
    if "n_chars" in others:
        of["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return left.select(*[of[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("packing", pack),
]

#: SQL can express neither the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
