"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits (the last one filled with five zero bits). The
binary Golay code (23, 12, 7) is perfect: every 23-bit word has one codeword within 3 bits, its nearest; the words
at exactly 3 bits have five more at 4. So if two words differ in at most one bit, the nearest codeword of one is
always among the (one or six) codewords within 4 bits of the other. A codeword index has 12 bits.

Pigeonhole over the errors of the segments, for at most 3 differing bits:

* some segment is equal: then one of the other two has at most one error. Keys: the equal segment and a codeword
  index of another one (six ordered pairs).
* else each has exactly one error. Keys: a codeword index of the first, an equal half of the second and an equal
  half of the third (four choices).

Every fingerprint is stored under its nearest codewords (10 keys) and looked up under all of them (up to 56); equal
keys are joined and the pairs verified by their differing bits. The rows are distinct fingerprints, so copies of a
text cost nothing. Links become groups by ``connected_components``, also a Spark job.

Defined results: a null or empty text has fingerprint zero and is linked like any other. A null doc_id has its
fingerprint but a null component_id, and links nothing. Repeated rows give repeated results. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import connected_components, materialize

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the Golay code (23, 12)
SEED = 42
_CHUNK = 1 << 15


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """A hash of each run of ``words`` words, as often as it occurs: A-Z lower-cased, words at ASCII white space."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    elif words == 3:
        shingles = [b"%b %b %b" % x for x in zip(parts, parts[1:], parts[2:], strict=False)]
    elif words == 5:
        shingles = [b"%b %b %b %b %b" % x for x in zip(parts, parts[1:], parts[2:], parts[3:], parts[4:], strict=False)]
    else:
        shingles = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)]
    one = xxhash.xxh64_intdigest
    return np.array([one(s, SEED) for s in shingles], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes: each bit that more than half of them have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        h = hashes[k : k + _CHUNK].astype(">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of a whole text, as a number of 64 bits."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id long, fp long) for every row; fp has the bits of the unsigned fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x or b"", words) for x in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and for each syndrome the error patterns of at most 4 bits.

    The first pattern is the lightest; where there is one alone, it stands six times.
    """

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = [syndrome(1 << b) for b in range(23)]

    def table(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int32)
        for k, s in enumerate(bits):
            out[1 << k : 2 << k] = out[: 1 << k] ^ s
        return out

    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = 0
            for b in at:
                s ^= unit[b]
            if weight < 4 or not found[s] or found[s][0].bit_count() == 3:
                found[s].append(sum(1 << b for b in at))
    patterns = np.array([x if len(x) == 6 else x[:1] * 6 for x in found], np.int64)
    return table(unit[:12]), table(unit[12:]), patterns


def codewords(word: np.ndarray) -> np.ndarray:
    """12-bit indices of the codewords within 4 bits of each 23-bit word, as 6 columns, the nearest first."""
    low, high, patterns = _golay()
    error = patterns[low[word & 0xFFF] ^ high[word >> 12]]
    return (word[:, None] ^ error) >> 11


def _keys(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(stored keys, keys to look up): one column each, for every kind of key; a nearest codeword comes first."""
    seg = [(fp >> np.uint64(41)).astype(np.int64), (fp >> np.uint64(18) & np.uint64(0x7FFFFF)).astype(np.int64), (fp & np.uint64(0x3FFFF)).astype(np.int64)]
    code = [codewords(s) for s in seg]
    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        yield (np.int64(kind) << 48) | (seg[i] << 12)[:, None] | code[j]
    for b in range(2):
        for c in range(2):
            half_b = seg[1] >> 12 if b else seg[1] & 0xFFF
            half_c = seg[2] >> 9 if c else seg[2] & 0x1FF
            yield (np.int64(6 + 2 * b + c) << 48) | ((half_b << 9 | half_c) << 12)[:, None] | code[0]


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b) for each pair of ``nodes(fp long, node long)``, with distinct fp, that differ in 1 to 3 bits."""
    if max_bits > 3:
        raise ValueError("the keys find pairs of at most 3 differing bits")

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches, lookup=False)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches, lookup=True)

    def run(batches: Iterator[pa.RecordBatch], lookup: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            node = batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64)
            for low in range(0, len(fp), 4096):
                f, n = fp[low : low + 4096], node[low : low + 4096]
                if not len(f):
                    continue
                for key in _keys(f):
                    if lookup:
                        more = key[:, 1:] != key[:, :1]
                        rows = np.concatenate([np.arange(len(f)), np.nonzero(more)[0]])
                        value = np.concatenate([key[:, 0], key[:, 1:][more]])
                    else:
                        rows, value = np.arange(len(f)), key[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(f[rows].view(np.int64)), pa.array(n[rows])], ["key", "fp", "node"])

    x = nodes.mapInArrow(stored, "key long, fp long, node long")
    y = nodes.mapInArrow(looked_up, "key long, fp long, node long").select("key", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    # Spark sizes keys by the table of nodes, though there are up to 56 a node, and would send them to the driver to broadcast them.
    return x.join(y.hint("merge"), "key").where((near <= max_bits) & (near > 0)).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint string, component_id): component_id is the smallest doc_id that links reach."""
    fps = materialize(fingerprints(docs, words), "fingerprints")
    nodes = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    # A node is the smallest doc_id of a fingerprint; repeated doc_ids may give one node to two fingerprints, which joins them.
    nodes = materialize(nodes, "nodes")
    groups = connected_components(links(nodes, max_bits))
    of = nodes.join(groups.hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = fps.join(of.hint("merge"), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
