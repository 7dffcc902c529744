"""Exact deduplication by a stateful stream, with DataFrame functions only.

Two streams read the table file by file. The first gives every row the digest of its normalised text and a content
locator, the file and the row's number in it. The second keeps one entry a digest in Spark's RocksDB state store, on
disk and without expiry: the stable identifier (the smallest document id with its locator) and the number of rows.
Rows are combined before they are dealt out by digest, so a digest in a third of all rows is one row a task. Both
streams resume from their checkpoints: a later call reads new files alone and a lost executor's state is fetched again.

The state store is then read as the ledger. Rows whose digest it holds more than once are hits: their texts are
fetched by locator and compared byte by byte as grouping keys beside the digest. A digest with different bytes
under it is resolved by the bytes; every other one by the ledger.

Defined results: a null text counts as an empty one; a null id ranks last, so a group of such rows has keep_id null;
of rows with equal ids and texts the one with the first locator stays, and stays alone; texts of any length are kept
whole; an empty table gives an empty result; columns other than the two are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrylens.llm.common import materialize
from quarrylens.storage import fresh_path

#: The same as one space for every run, though it only touches runs that are not one space already.
RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Each store would set 4 MB aside at once, however little it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
PLACE = ["file", "row"]


def normalised(text: Column) -> Column:
    """The text with one space for each run of white space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), RUNS, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _schema(spark: SparkSession, path: str, *names: str) -> StructType:
    fields = spark.read.parquet(path).schema
    return StructType([fields[n] for n in names])


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(spark: SparkSession, stream: DataFrame, sink: str, mode: str, state: str, path: str | None = None) -> None:
    """Run a stream over what its source holds now, with state on disk."""
    writer = stream.writeStream.format(sink).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    with _state_on_disk(spark):
        query = (writer.option("path", path) if path else writer).start()
    query.awaitTermination()


def observe(spark: SparkSession, path: str, work: str, files: int | None = None, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> None:
    """Read the files of the Parquet table ``path`` that are new to the folder ``work`` into its digests and its state.

    ``files`` bounds the files of a micro-batch. A file must not change once it was read.
    """
    limit = {"maxFilesPerTrigger": files} if files else {}
    # As a pattern the path may be one file as well as a folder.
    docs = spark.readStream.schema(_schema(spark, path, id_col, text_col)).options(**limit).parquet(f"{path[:-1]}[{path[-1]}]")
    prints = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(normalised(F.col(text_col))).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    _run(spark, prints, "parquet", "append", f"{work}/prints-state", f"{work}/prints")
    seen = spark.readStream.schema(prints.schema).options(**limit).parquet(f"{work}/prints")
    _run(spark, seen.groupBy("digest").agg(F.min(_first()).alias("first"), F.count("*").alias("n")), "noop", "update", f"{work}/ledger-state")


def _first() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), *PLACE)


def ledger(spark: SparkSession, work: str) -> DataFrame:
    """(digest, first: struct<late, id, file, row>, n): the entries of the state store."""
    state = spark.read.format("statestore").load(f"{work}/ledger-state")
    return state.select("key.digest", F.col("value.min").alias("first"), F.col("value.count").alias("n"))


def decide(spark: SparkSession, path: str, work: str, text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, file, row, keep_file, keep_row), one row for each row observed."""
    rows = spark.read.parquet(f"{work}/prints")
    with _state_on_disk(spark):
        entries = materialize(ledger(spark, work), "ledger")
    hits = rows.join(entries.where("n > 1").select("digest"), "digest").select("digest", "doc_id", *PLACE)
    read = spark.read.schema(_schema(spark, path, text_col)).parquet(path)
    texts = read.select(F.col(text_col).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    same = texts.join(hits.hint("shuffle_hash"), PLACE).select("digest", normalised(F.col("text")).alias("bytes"), "doc_id", *PLACE)
    variants = same.groupBy("digest", "bytes").agg(F.min(_first()).alias("first"), F.count("*").alias("n"))
    odd = materialize(variants.groupBy("digest").count().where("count > 1").select("digest"), "odd")

    of = [F.col("x.first.id").alias("keep_id"), F.col("x.n").alias("group_size"), (F.struct(*PLACE) == F.struct("x.first.file", "x.first.row")).alias("kept")]
    out = ["doc_id", *of, "digest", *PLACE, F.col("x.first.file").alias("keep_file"), F.col("x.first.row").alias("keep_row")]
    plain = rows.join(entries.select("digest", F.struct("first", "n").alias("x")), "digest")
    if odd.isEmpty():
        return plain.select(*out)
    apart = same.join(odd, "digest", "left_semi").join(variants.join(odd, "digest", "left_semi").select("digest", "bytes", F.struct("first", "n").alias("x")), ["digest", "bytes"])
    return plain.join(odd, "digest", "left_anti").select(*out).unionByName(apart.select(*out))


def dedup(spark: SparkSession, path: str, work: str | None = None, files: int | None = None) -> DataFrame:
    """The decisions about all rows of the table ``path``; with ``work``, a folder that is kept, only new files are digested."""
    work = work or fresh_path(spark, "exact")
    if not spark.read.parquet(path).take(1):
        place = "doc_id long, keep_id long, group_size long, kept boolean, digest binary, file string, row long, keep_file string, keep_row long"
        return spark.createDataFrame([], place)
    observe(spark, path, work, files)
    return decide(spark, path, work)


def survivors(spark: SparkSession, path: str, decisions: DataFrame) -> DataFrame:
    """The rows of the table that stay, with all their columns."""
    docs = spark.read.parquet(path)
    place = docs.metadataColumn("_metadata")
    named = docs.select(F.struct("*").alias("_doc"), place["file_path"].alias("file"), place["row_index"].alias("row"))
    return named.join(decisions.where("kept").select(*PLACE).hint("shuffle_hash"), PLACE, "left_semi").select("_doc.*")
