"""The registered queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import align, ann, centroids, chunks, exact, packing, pu, quality, repeats, reshard, simhash, sql, urllists, wfst

OLD_SHARDS, NEW_SHARDS = 32, 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mincost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards by source to 40 of near equal bytes."""
    old = F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    moved = reshard.reshard_documents(_table(spark, sf_dir, "documents"), old, OLD_SHARDS, NEW_SHARDS)
    return moved.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def op2_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_lpf_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).drop("kept")


def op5_wfst_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.drop("class_distance", "word_distance")


def op7_pu_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"])


def op8_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dedup_chunks(_table(spark, sf_dir, "documents"))


def op9_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _list_entries(pages: DataFrame) -> DataFrame:
    """A dated list that follows from the pages: each reports its address, its host or its domain, on some day."""
    host = urllists.host_of(F.col("url"))
    domain = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    turn = F.pmod(F.col("page_id"), F.lit(3))
    kind = F.when(turn == 0, "url").when(turn == 1, "host").otherwise("domain")
    pattern = F.when(turn == 0, urllists.plain(F.col("url"))).when(turn == 1, host).otherwise(F.when(F.size(F.split(host, r"\.")) >= 2, domain))
    action = F.when(F.pmod(F.col("page_id") * 13, F.lit(7)) < 4, "add").otherwise("remove")
    return pages.select(kind.alias("kind"), pattern.alias("pattern"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("day"), action.alias("action"))


def op10_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 101 + 17, F.lit(400)).cast("int"))
    return urllists.apply_lists(pages.select("page_id", "url", fetched.alias("day")), _list_entries(pages))


def op11_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_threshold_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 clusters in five rounds; they start from the vectors whose ids have the smallest digests."""
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), 40, 5, 64, order)


def op13_mph_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


_ALL = (
    op1_mincost_reshard,
    op2_pow2_packing,
    op3_golay_simhash,
    op4_lpf_suffix_dedup,
    op5_wfst_sentencepiece,
    op6_divergence_rules,
    op7_pu_classifier,
    op8_gear_chunk_dedup,
    op9_hilbert_ann,
    op10_temporal_url_lists,
    op11_streaming_exact_dedup,
    op12_threshold_centroids,
    op13_mph_token_alignment,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {"op6_divergence_rules": sql.QUALITY, "op10_temporal_url_lists": sql.URL_LISTS, "op11_streaming_exact_dedup": sql.EXACT, "op12_threshold_centroids": sql.CENTROIDS}
