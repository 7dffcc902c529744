"""Helpers shared by the training-data operators: shared storage and links to groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.storage import fresh_path

MAX_LONG = (1 << 63) - 1


def row_key(*columns: str) -> list[Column]:
    """(_k1, _k2): a digest of ``columns`` and the text, and one of the text, by which narrow tables name rows.

    Rows with equal keys have equal texts and columns, so whatever follows from these holds for all of them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return [F.xxhash64(*columns, text).alias("_k1"), F.unhex(F.md5(text)).alias("_k2")]


def rows_of(docs: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``docs`` whose ``row_key(*columns)`` is in ``keys(_k1, _k2)``, with their own columns.

    The keys are the side that is held in memory, part by part; the texts are not sorted.
    """
    packed = docs.select(F.struct("*").alias("_doc"), *row_key(*columns))
    return packed.join(keys.select("_k1", "_k2").hint("shuffle_hash"), ["_k1", "_k2"], "left_semi").select("_doc.*")


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage (a lost executor never forces the work before it to be done again) and is removed
    when the session's file system is closed.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a long, b long)``; the component is its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Every step is one aggregation that
    Spark combines before the shuffle and one join, so that a node with very many neighbours is split by adaptive
    execution. Each round is written to the shared folder, where ids are packed so well that the size of its files says little of
    what a broadcast would take: no join broadcasts. An empty table gives an empty result.
    """

    def counted(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = materialize(df, "edges")
        row = df.agg(F.count("*"), *[F.sum(F.xxhash64(*x).cast("decimal(20,0)")) for x in (("a", "b"), ("b", "a"))]).first()
        return df, tuple(row)

    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, state = counted(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        links, now = counted(small.select("e.a", "e.b").where("a <> b").distinct())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
