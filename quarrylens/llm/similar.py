"""Groups of texts whose sets of 5-word shingles are similar (Jaccard index of 0.8 or more).

At this similarity the 64 bits of two SimHash fingerprints differ in about ten, more than any index of their bits can
look up, so fingerprints within 3 bits are only one source of candidates. The other is minimum hashes: BANDS keys, each
of ROWS minima, of which two texts share at least one with a probability of 1 - (1 - J ** ROWS) ** BANDS (0.9998 at
0.8). All pairs of a key with at most ALL_PAIRS texts are candidates; of a larger one, each text with one of them, which a
hash of text and key picks. Every candidate is verified on the whole shingle sets, and verified pairs become groups by
``connected_components``.

Where a large key still holds texts of several groups, ``across`` looks at what is left exactly: two sets of this
similarity share one of the rarest shingles of each (a fifth of the set and one more), so these alone are joined, a
position bound and the parities of both sets drop what cannot reach the similarity any more, and members of a shingle's largest group never meet each
other. The work so grows with the texts and with those pairs of groups that share rare shingles, not with the pairs of a key.

The rows are distinct texts, known by a digest; copies cost nothing more. Texts are shuffled once, for the shingle sets
of candidates, and only the sets of candidates are stored. No join broadcasts: Spark sizes rows of an array by the table that holds
the arrays, 16 keys as one, and packed ids by their files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import connected_components, materialize
from quarrylens.llm.simhash import links, majority, shingle_hashes

WORDS = 5
BANDS, ROWS = 16, 4
ALL_PAIRS = 16
#: Bits of a set by which pairs that cannot be similar are dropped where they would meet.
PARITIES = 512
_RANDOM = np.random.Generator(np.random.PCG64(5))
_FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_FOLD = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 12


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes; those of different bands are unlike."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, (hashes[k : k + _CHUNK] * _FACTORS + _TERMS).min(axis=1))
    least ^= least >> np.uint64(29)
    key = (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return key ^ (key >> np.uint64(32))


def digest(text: Column) -> Column:
    """What tells distinct texts apart; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), text.alias("text"))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, sizes, keys = [], [], []
        for text in batch.column("text").to_pylist():
            hashes = shingle_hashes(text, WORDS)
            fps.append(majority(hashes))
            hashes = np.unique(hashes)
            sizes.append(len(hashes))
            keys.append(band_keys(hashes))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(flat.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), bands], ["doc_id", "digest", "fp", "size", "bands"])


def parities(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of PARITIES classes of a set's hashes: whether their number is odd.

    Two sets differ in at least as many elements as bits, which bounds what they share from above.
    """
    odd = np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = np.unique(shingle_hashes(text, WORDS))
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([found.view(np.int64)], pa.list_(pa.int64())), pa.array([parities(found)], pa.list_(pa.int64()))], ["node", "shingles", "parities"])


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, x struct<node, size>, n, first): each key that two or more of ``nodes(node, size, bands)`` have, and its texts."""
    rows = nodes.select(F.explode("bands").alias("key"), F.struct("node", "size").alias("x"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("x", F.xxhash64("x.node", "key")).alias("first")).where("n > 1")
    return rows.join(groups.hint("merge"), "key")


def candidates(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(a, b), a < b, for pairs of ``nodes(node, fp, size)`` that may be similar; those whose sizes forbid it are left out."""
    star = linked.select(F.col("first").alias("x"), F.col("x").alias("y"))
    few = linked.where(F.col("n").between(3, ALL_PAIRS)).groupBy("key").agg(F.collect_list("x").alias("all"))
    pairs = few.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x.node < y.node")
    same = nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("x"))
    alike = nodes.join(same.hint("merge"), "fp").select("x", F.struct("node", "size").alias("y"))
    near = links(same.select("fp", F.col("x.node").alias("node")))
    of = lambda end: same.select(F.col("x.node").alias(end), F.col("x").alias(f"{end}x"))
    near = near.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").select(F.col("ax").alias("x"), F.col("bx").alias("y"))
    found = star.unionByName(pairs).unionByName(alike).unionByName(near).where("x.node <> y.node and 5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size)")
    return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def across(linked: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a < b, for all pairs of different groups that may be similar, among the texts of large keys with several groups.

    ``groups(node, component)`` has the texts in groups of two or more, ``sets(node, shingles)`` those of all large keys.
    """
    large = linked.where(F.col("n") > ALL_PAIRS).select("key", F.col("x.node").alias("node")).join(groups.hint("merge"), "node", "left")
    large = large.withColumn("component", F.coalesce("component", "node"))
    mixed = large.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = large.join(mixed.hint("merge"), "key").select("node", "component").distinct()
    # Repeated rows of the table have repeated sets.
    one = sets.join(rest.hint("shuffle_hash"), "node").dropDuplicates(["node"])
    rows = materialize(one.select("node", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")), "rest")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    sorted_ = rows.join(shared.hint("merge"), "shingle").groupBy("node", "component", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))
    # Shingles of no other text come first; of what follows, the prefix has these.
    alone = F.col("size") - F.size("all")
    length = F.expr("size - (4 * size + 4) div 5 + 1").cast("int") - alone
    words = [F.col("parities")[k].alias(f"p{k}") for k in range(PARITIES // 64)]
    sorted_ = sorted_.join(one.select("node", *words).hint("merge"), "node")
    bits = [f"p{k}" for k in range(PARITIES // 64)]
    prefix = sorted_.where(length > 0).select("node", "component", "size", *bits, alone.alias("alone"), F.posexplode(F.slice("all", 1, length)).alias("i", "x"))
    prefix = materialize(prefix.select("x.shingle", "node", "component", "size", *bits, (F.col("size") - F.col("alone") - F.col("i")).alias("left")), "prefix")
    by_group = prefix.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    main = by_group.groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("k")).where("k > 1")
    x = prefix.join(main.hint("merge"), "shingle").where("component <> main").select("shingle", "main", *[F.col(c).alias(f"x_{c}") for c in ("node", "component", "size", "left", *bits)])
    # Nothing before the first shared shingle is shared, so with it all of the overlap is in what is left of both.
    may = "x_component <> component and (component = main or x_node < node) and 5 * least(x_size, size) >= 4 * greatest(x_size, size) and 9 * least(x_left, left) >= 4 * (x_size + size)"
    apart = " + ".join(f"bit_count(x_{p} ^ {p})" for p in bits)
    return x.join(prefix.hint("merge"), "shingle").where(f"{may} and 9 * ({apart}) <= x_size + size").select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets have a Jaccard index of 0.8 or more."""
    of = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    # J >= 4 / 5 in whole numbers
    return pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where(9 * both >= 4 * (F.size("a_set") + F.size("b_set"))).select("a", "b")


def similar_texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, digest binary, component_id long) for each distinct text of the rows with a doc_id.

    doc_id is the smallest of the text's; component_id is one number for all texts that similar pairs join.
    """
    texts = _texts(docs)
    prints = materialize(texts.mapInArrow(_prints, "doc_id long, digest binary, fp long, size int, bands array<long>"), "prints")
    nodes = prints.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in ("fp", "size", "bands")])
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    linked = materialize(keyed(nodes), "bands")
    pairs = materialize(candidates(nodes, linked), "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(linked.where(F.col("n") > ALL_PAIRS).select("x.node")).distinct()
    wanted = wanted.join(nodes.select("node", "doc_id", "digest").hint("merge"), "node")
    sets = texts.join(wanted.hint("shuffle_hash"), ["doc_id", "digest"]).select("node", "text").mapInArrow(_sets, "node long, shingles array<long>, parities array<long>")
    sets = materialize(sets, "shingles")
    groups = connected_components(verified(pairs, sets))
    more = materialize(verified(across(linked, groups, sets), sets), "across")
    if not more.isEmpty():
        groups = connected_components(more.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return nodes.join(groups.hint("merge"), "node", "left").select("doc_id", "digest", F.coalesce("component", "node").alias("component_id"))
