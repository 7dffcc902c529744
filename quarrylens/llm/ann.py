"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are normalised and projected to a few random directions, once for each ordering; the projections, shifted
at random, are cells of a grid, and a Hilbert curve through the grid gives each vector a key. Spark range-partitions
all (ordering, key) rows into blocks, at least MIN_BLOCKS an ordering and of BLOCK_ROWS rows in large tables. A query
is compared with the blocks around its own in every ordering (at the ends of a curve with as many on the inner side);
the best of each block are merged and reranked.

The window is a share of the table (``window_share`` of all rows in each ordering), so that recall does not fall as
the table grows; isotropic vectors of many dimensions, such as the test tables', need much of the table for a recall
of 0.9. Rows are distinct vectors: copies share a row that lists their smallest ids, as many as an answer can need.
A block is only ever met by slices of at most QUERY_SLICE queries, so no group grows with the table.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows without id; all others do, however long or short their vectors are. Shorter vectors count as filled with zeros. Fewer candidates than k give fewer rows. Extra columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.common import materialize

ORDERINGS, DIRECTIONS = 8, 8
#: Levels of the grid, and how many of them a key of 8 directions holds. The finest cells are near the precision of
#: float32, so rows of a tight cluster lie on the curve by their place, in each ordering another way.
BITS, KEY_BITS = 28, 7
KEYS = [f"key{i}" for i in range(BITS // KEY_BITS)]
WINDOW_SHARE = 0.2
BLOCK_ROWS, MIN_BLOCKS, QUERY_SLICE = 2048, 32, 2048
#: Blocks that a task writes.
SPLIT = 32
#: Rows from which centre and spread of the projections are fitted; every row is indexed.
FIT_ROWS = 20_000
SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int, key_bits: int | None = None) -> np.ndarray:
    """Positions of the rows of ``cells`` (integers below 2 ** bits) along a Hilbert curve, by Skilling's transform.

    With ``key_bits``, the position in digits of so many levels each, the highest first, as columns.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n, q = len(axes), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_bit = (axes[i] & q) != 0
            swap = np.where(set_bit, 0, (axes[0] ^ axes[i]) & p)
            axes[0] = axes[0] ^ np.where(set_bit, p, swap)
            if i:
                axes[i] = axes[i] ^ swap
        q >>= 1
    for i in range(1, n):
        axes[i] = axes[i] ^ axes[i - 1]
    turn, q = np.zeros_like(axes[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where((axes[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    keys = []
    for top in range(bits, 0, -(key_bits or bits)):
        key = np.zeros_like(axes[0])
        for b in range(top - 1, max(top - (key_bits or bits), 0) - 1, -1):
            for a in axes:
                key = (key << 1) | ((a ^ turn) >> b & 1)
        keys.append(key)
    return np.stack(keys, axis=1) if key_bits else keys[0]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    if len(size) and (size == dim).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(size), dim).copy()
    out = np.zeros((len(size), dim))
    for i, (low, n) in enumerate(zip(offsets, size, strict=False)):
        out[i, :n] = flat[low : low + n]
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is near 1: cosines stay the same to the last bit,
    and no square vanishes or overflows, whatever the vector's length."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, window_share: float = WINDOW_SHARE, window_rows: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): each query row's k nearest other rows by cosine.

    ``is_query`` is a condition on vec_id. Ties go to the smaller vec_id. A window holds ``window_share`` of the rows,
    and ``window_rows`` at least, without which the windows of small tables would hold fewer rows than an answer.
    """
    rows = usable(vectors, id_col, vector_col)
    smallest = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    firsts = first.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(is_query).select("v").distinct().withColumn("asked", F.lit(True))
    distinct = materialize(firsts.join(asked, "v", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "vectors")
    count, dim, n_asked = distinct.agg(F.count("*"), F.max(F.size("v")), F.count_if("asked")).first()
    dim = dim or 1

    random = np.random.default_rng(SEED)
    directions = min(DIRECTIONS, dim)
    turns = [np.linalg.qr(random.normal(size=(dim, directions)))[0] for _ in range(ORDERINGS)]
    shifts = random.uniform(0, 0.1, size=(ORDERINGS, directions))
    sample = distinct.orderBy(F.xxhash64("rep")).limit(FIT_ROWS).select("v").toArrow()
    unit = _scaled(_matrix(sample.column("v"), dim))
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    fits = [((unit @ t).mean(axis=0), (unit @ t).std(axis=0) + 1e-12) if len(unit) else (0.0, 1.0) for t in turns]

    def order(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _scaled(_matrix(batch.column("v"), dim))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for o, (turn, shift, (mean, std)) in enumerate(zip(turns, shifts, fits, strict=True)):
                place = (x @ turn - mean) / std / 6 + 0.5
                # The grid is eight times as wide as six deviations, so that rows far out do not share its border.
                cells = np.clip((place * 0.9 + shift + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                keys = hilbert_keys(cells, BITS, KEY_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), o, np.int32)), *[pa.array(k.copy()) for k in keys.T], batch.column("rep"), batch.column("v"), batch.column("asked")], ["ordering", *KEYS, "rep", "v", "asked"])

    per_ordering = max(1, min(count, max(MIN_BLOCKS, -(-count // BLOCK_ROWS))))
    keyed = distinct.select("rep", "v", "asked").mapInArrow(order, f"ordering int, {' long, '.join(KEYS)} long, rep long, v array<double>, asked boolean")
    # A block is a range; a task writes several of them.
    ranges = ORDERINGS * per_ordering
    blocks = keyed.repartitionByRange(ranges, "ordering", *KEYS, "rep").withColumn("block", F.spark_partition_id()).drop(*KEYS)
    blocks = materialize(blocks.coalesce(max(1, ranges // SPLIT)), "blocks")

    # First and last block of each ordering, one row each. A block that holds the ends of two orderings counts in both.
    ends = {r["ordering"]: (r["low"], r["high"]) for r in blocks.groupBy("ordering").agg(F.min("block").alias("low"), F.max("block").alias("high")).collect()}
    end = lambda k: F.get(F.array(*[F.lit(ends.get(o, (0, 0))[k]) for o in range(ORDERINGS)]), F.col("ordering"))
    most = max((high - low + 1 for low, high in ends.values()), default=1)
    window = min(1.0, max(window_share, window_rows / max(count, 1)))
    reach = max(0, -(-(int(window * most + 0.999) - 1) // 2))
    slices = max(1, -(-(n_asked or 0) * (2 * reach + 1) // (most * QUERY_SLICE)))
    part = F.pmod(F.xxhash64("rep"), F.lit(slices)).cast("int")
    first = F.greatest(end(0), F.least(F.col("block") - reach, end(1) - 2 * reach))
    near = F.sequence(first, F.least(first + 2 * reach, end(1)))
    queries = blocks.where("asked").select("ordering", F.explode(near).alias("block"), part.alias("part"), "rep", "v")
    candidates = blocks.select("ordering", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part"), "rep", "v")

    def rerank(asked_rows: pa.Table, near: pa.Table) -> pa.Table:
        if not asked_rows.num_rows or not near.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, c = _scaled(_matrix(asked_rows.column("v"), dim)), _scaled(_matrix(near.column("v"), dim))
        q_id, c_id = asked_rows.column("rep").to_numpy(), near.column("rep").to_numpy()
        by_id = np.argsort(c_id, kind="stable")
        c, c_id = c[by_id], c_id[by_id]
        nq, nc = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
        rough = np.where(np.isfinite(r := (q @ c.T) / nq[:, None] / nc[None, :]), r, -2)
        n = min(len(c), k + 1)
        # The n best and all that may tie with the last, whose exact scores decide.
        bar = np.partition(rough, len(c) - n, axis=1)[:, len(c) - n] - 1e-12
        qi, ci = np.nonzero(rough >= bar[:, None])
        score = (q[qi] * c[ci]).sum(axis=1) / (nq[qi] * nc[ci])
        best = np.lexsort((c_id[ci], -score, qi))
        qi, ci, score = qi[best], ci[best], score[best]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left")
        keep = place < n
        return pa.table({"q": q_id[qi[keep]], "rep": c_id[ci[keep]], "score": score[keep]})

    found = queries.groupBy("ordering", "block", "part").cogroup(candidates.groupBy("ordering", "block", "part")).applyInArrow(rerank, "q long, rep long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    top = found.groupBy("q", "rep").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    listed = top.join(distinct.select("rep", "ids"), "rep").groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    near = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("s"), i.alias("vec_id")))))
    listed = listed.select("q", F.sort_array(near).alias("near"))  # at most (k + 1) ** 2 entries
    of = rows.where(is_query).join(distinct.select("v", F.col("rep").alias("q")), "v").select(F.col("vec_id").alias("query_id"), "q")
    answers = of.join(listed, "q").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return answers.select("query_id", F.posexplode("near").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
