"""Content-defined chunking with a gear rolling hash, and deduplication of the chunks by digest.

The hash of a position sums table values of the last 32 bytes, each shifted by its age, so that it forgets what lies
further back. A chunk ends where its top MASK_BITS bits are zero, but holds MIN_BYTES to MAX_BYTES; an insertion
moves only the boundaries near it. Each chunk has a 128-bit BLAKE2b digest. The first chunk with a digest, by
document id and position, stays; all later ones are removed.

Digests are counted by one combined aggregation and only those that occur again meet their chunks in a join that
adaptive execution can split, so a chunk in a third of all documents is no hot task.

Defined results: a null or empty text has no chunks; a null doc_id ranks last; rows with equal ids and texts both
keep what is first in either; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import MAX_LONG, materialize

MIN_BYTES, MAX_BYTES, MASK_BITS = 32, 256, 5
_GEAR = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 32, 256, dtype=np.uint32)
_SLICE = 1 << 18


def _ends(data: bytes) -> np.ndarray:
    """Positions after which the hash allows a boundary."""
    out, low = [], 0
    raw = np.frombuffer(data, np.uint8)
    while low < len(raw):
        back = max(0, low - 31)
        h = _GEAR[raw[back : low + _SLICE]]
        for k in (1, 2, 4, 8, 16):
            h = np.concatenate([h[:k], h[k:] + (h[:-k] << np.uint32(k))])
        at = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + back + 1
        out.append(at[at > low])
        low += _SLICE
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cut(texts: list[bytes]) -> list[list[int]]:
    """The chunk boundaries of each text, 0 and its length included; an empty text has just 0."""
    ends = _ends(b"".join(texts)).tolist()
    found, base, i = [], 0, 0
    for text in texts:
        bounds, n = [0], len(text)
        start = 0
        while n - start > MIN_BYTES:
            i = bisect_left(ends, base + start + MIN_BYTES, i)
            end = min(ends[i] - base if i < len(ends) else n, start + MAX_BYTES, n)
            bounds.append(end)
            start = end
        if start < n:
            bounds.append(n)
        found.append(bounds)
        base += n
    return found


def chunk(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, n_bytes, idx, start, size, digest), one row a chunk; a document without chunks has one, idx -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                texts = [x or b"" for x in part.column("text").to_pylist()]
                row, idx, start, size, digest = [], [], [], [], []
                for r, (text, bounds) in enumerate(zip(texts, cut(texts), strict=True)):
                    n = len(bounds) - 1
                    row += [r] * max(n, 1)
                    idx += range(n) if n else [-1]
                    start += bounds[:-1] if n else [0]
                    size += [b - a for a, b in zip(bounds, bounds[1:], strict=False)] if n else [0]
                    digest += [blake2b(text[a:b], digest_size=16).digest() for a, b in zip(bounds, bounds[1:], strict=False)] if n else [None]
                at = pa.array(row)
                n_bytes = pa.array([len(x) for x in texts], pa.int64()).take(at)
                arrays = [part.column("uid").take(at), part.column("doc_id").take(at), n_bytes, pa.array(idx, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(digest, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "n_bytes", "idx", "start", "size", "digest"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "uid long, doc_id long, n_bytes long, idx int, start long, size int, digest binary")


def dedup_chunks(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_chunks, n_dup_chunks, n_removed (bytes), n_spans and the removed spans.

    ``spans`` lists (begin, end) of bytes, joined where chunks touch; ``first_doc_ids`` lists the documents that keep
    the removed chunks (null for rows without id).
    """
    chunks = materialize(chunk(docs), "chunks")
    place = F.struct(F.coalesce("doc_id", F.lit(MAX_LONG)).alias("d"), F.col("idx").alias("i"))
    again = chunks.where("digest is not null").groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    late = chunks.join(again, "digest").where(place != F.col("first")).select("uid", "start", "size", F.col("first.d").alias("d"))
    lost = late.groupBy("uid").agg(
        F.count("*").alias("n_dup_chunks"),
        F.sum("size").alias("n_removed"),
        F.sort_array(F.collect_list(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b")))).alias("runs"),
        F.sort_array(F.collect_set(F.when(F.col("d") < MAX_LONG, F.col("d")))).alias("first_doc_ids"),
    )
    opens = F.filter(F.transform("runs", lambda x, i: F.when((i == 0) | (F.get("runs", i - 1)["b"] != x["a"]), x["a"])), lambda x: x.isNotNull())
    closes = F.filter(F.transform("runs", lambda x, i: F.when((i == F.size("runs") - 1) | (F.get("runs", i + 1)["a"] != x["b"]), x["b"])), lambda x: x.isNotNull())
    lost = lost.withColumn("spans", F.arrays_zip(opens.alias("begin"), closes.alias("end"))).drop("runs")
    whole = chunks.groupBy("uid").agg(F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.count_if(F.col("idx") >= 0).alias("n_chunks"))
    zero = F.lit(0).cast("long")
    return whole.join(lost, "uid", "left").select(
        "doc_id",
        "n_bytes",
        "n_chunks",
        F.coalesce("n_dup_chunks", zero).alias("n_dup_chunks"),
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        "spans",
        "first_doc_ids",
    )
