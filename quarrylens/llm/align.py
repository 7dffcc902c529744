"""Alignment of two tokenizers over a corpus, with counts of linked id pairs behind a minimal perfect hash.

A text is encoded by a byte-level tokenizer (A) and a SentencePiece model (B), once; the ids are written to the shared
folder. Where tokens of both end, the text falls into groups; within a group every A token is linked with every B token.

1. The first pass aligns all documents and adds up, within a task, how many hold each pair of ids: ``seen``.
2. The distinct pairs are dealt into buckets by a hash. A task builds each bucket's minimal perfect hash: pairs that
   are alone at their place of a bit array are settled, the others go on to a next, smaller array; a pair's index is
   the number of bits set before its own. The pairs themselves are kept in the order of their indexes.
3. ``seen`` becomes dense vectors of counts, one a task and bucket, indexed by the hash. They are summed as a tree.
4. The second pass aligns the documents again and looks their pairs up. A pair whose stored key differs is none.

Tables go to the tasks in ranges of buckets, RANGE_PAIRS pairs or about 70 MB at a time, whatever the number of pairs
(at most the product of the vocabularies); a task looks its pairs up in one range after the other. A's highest counts
are one number an id. Documents' rows never leave their tasks.

Defined results: null and empty texts, and those of which a tokenizer's bytes are not the text's (one that holds U+2581),
have no tokens and zeros; repeated rows count each; an empty table gives an empty result; extra columns are not read.
Texts of any length are taken whole; a long one is a slice of its own, whose distinct pairs are held at once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import materialize

#: Units that a worker remembers, and the characters of the longest of them.
MEMORY_UNITS, UNIT_CHARS = 400_000, 64
#: Bytes of A's ids that are aligned at a time, and links of a group from which they are counted by distinct pair.
SLICE_BYTES, LARGE_GROUP = 1 << 18, 1024
#: Pairs a task adds up before it writes them; pairs of a bucket, and of a range that a task holds at a time.
FLUSH_PAIRS, BUCKET_PAIRS, RANGE_PAIRS = 500_000, 4096, 1 << 22
#: Bits a pair in each array of the hash, and vectors that one task sums.
GAMMA, FAN_IN = 2, 32
#: A unit with what begins it; texts that are more than such units, and where these are cut.
_UNIT, _GLUED, _GLUED_CUT = re.compile(r"[ \n]\S+"), re.compile(r"\s\s|[^\S \n]|\s\Z"), re.compile(r"(?<=\S)(?=[ \n]\S)")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others in order for U+0100 and on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: how the byte-level tokenizer splits texts.
_PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Both tokenizers, with a bounded memory of units' ids as packed little-endian unsigned numbers.

    Equal pieces of texts have equal ids wherever neither tokenizer joins them with their neighbours: at a space or
    line end between visible characters. Units are learned many at a time, as one text.
    """

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token)
        self.n_b = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.n_b) for p in [self.b.id_to_piece(i)]]
        if any("▁" in p.lstrip("▁") or "\n" in p for i in range(self.n_b) for p in [self.b.id_to_piece(i)]):
            raise ValueError("a piece joins units")
        self.size_a, self.size_b = (np.array([len(x) for x in of]) for of in (self.bytes_a, self.bytes_b))
        self.kind = "<u2" if max(len(self.bytes_a), self.n_b) < 1 << 16 else "<u4"
        with open(path_a, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        # Where ids are numbered as merges come, ranks give the same ids faster.
        by_rank = all(vocabulary.get(t) == 256 + i for i, t in enumerate(joined)) and sorted(vocabulary[c] for c in alphabet) == list(range(256))
        self.ranks = tiktoken.Encoding("ranks", pat_str=_PRE_TOKENS, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a) if x}, special_tokens={}) if by_rank else None
        self.memory_a: dict[str, bytes] = {}
        self.memory_b: dict[str, bytes] = {}

    @staticmethod
    def cut(text: str) -> list[str]:
        """The units of a text that begins with a space."""
        return _GLUED_CUT.split(text) if _GLUED.search(text) else _UNIT.findall(text)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _alone(self, unit: str) -> tuple[bytes, bytes] | None:
        """Ids of a unit behind the letter a, without those of the letter; None if a tokenizer changes the unit's bytes."""
        a, b = self.a.encode("a" + unit, add_special_tokens=False).ids, self.b.encode("a" + unit)
        raw = b"a" + unit.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != b" " + raw:
            return None
        return self._packed(a[1:]), self._packed(b[1:])

    def _together(self, units: list[str]) -> bool:
        """Learn units that end visibly, encoded as one text; False if that text's bytes are changed."""
        text = "a" + "".join(units)
        a = self.ranks.encode_ordinary(text) if self.ranks else self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != b" " + raw:
            return False
        stops = np.cumsum([1, *[len(u) if u.isascii() else len(u.encode()) for u in units]])
        for ids, sizes, more, memory in ((a, self.size_a, 0, self.memory_a), (b, self.size_b, 1, self.memory_b)):
            packed, ends = self._packed(ids), np.cumsum(sizes[ids])
            at = (np.searchsorted(ends, stops + more) + 1) * np.dtype(self.kind).itemsize
            memory.update(zip(units, [packed[low:high] for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], strict=True))
        return True

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Packed ids of each text by A and by B; nothing for texts that a tokenizer changes."""
        if len(self.memory_a) > MEMORY_UNITS:
            self.memory_a.clear()
            self.memory_b.clear()
        cut = [self.cut(" " + t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.memory_a)
        own: dict[str, tuple[bytes, bytes] | None] = {}
        plain = [u for u in new if len(u) <= UNIT_CHARS and not u[-1].isspace()]
        for low in range(0, len(plain), 4096):
            some = plain[low : low + 4096]
            if not self._together(some):
                own.update((u, self._alone(u)) for u in some)
        plain = set(plain)
        own.update((u, self._alone(u)) for u in new if u not in plain)
        out = []
        for units in cut:
            if own and not own.keys().isdisjoint(units):
                both = [own[u] if u in own else (self.memory_a[u], self.memory_b[u]) for u in units]
                out.append((b"", b"") if None in both else (b"".join([x for x, _ in both]), b"".join([y for _, y in both])))
            else:
                out.append((b"".join(map(self.memory_a.__getitem__, units)), b"".join(map(self.memory_b.__getitem__, units))))
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path_a: str, path_b: str) -> Encoder:
    key = (path_a, path_b)
    return _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(path_a, path_b))


class Aligned:
    """Documents' groups and links as arrays, from the documents' ids and the tokens' sizes."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], size_a: np.ndarray, size_b: np.ndarray, n_b: int):
        self.n_docs, self.factor = len(docs), n_b
        self.a, self.b = (np.concatenate([d[k] for d in docs]).astype(np.int64) if docs else np.zeros(0, np.int64) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(d[k]) for d in docs], np.int64) for k in (0, 1))
        end_a, end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        ends = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool)
        ends[end_a] = True
        shut_b = ends[end_b]
        ends[:] = False
        ends[end_b] = True
        shut_a = ends[end_a]
        #: The group of each token, and each group's first tokens.
        self.group_a, self.group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
        self.last_a, self.last_b = np.flatnonzero(shut_a), np.flatnonzero(shut_b)
        self.first_a = np.concatenate([[0], self.last_a + 1])[:-1] if len(self.last_a) else np.zeros(0, np.int64)
        self.first_b = np.concatenate([[0], self.last_b + 1])[:-1] if len(self.last_b) else np.zeros(0, np.int64)
        self.links = (self.last_a - self.first_a + 1) * (self.last_b - self.first_b + 1)
        self.doc_a = np.repeat(np.arange(self.n_docs), self.n_a)
        self.doc = self.doc_a[self.last_a]

    def by_doc(self, docs: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of integers a document."""
        total = np.zeros(self.n_docs, np.int64)
        np.add.at(total, docs, values)
        return total

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, times) of all links: one each, but those of large groups by distinct pair."""
        large = self.links > LARGE_GROUP
        width = np.where(large, 0, self.last_b - self.first_b + 1)[self.group_a]
        start = np.concatenate([[0], np.cumsum(width)])
        at_a = np.repeat(np.arange(len(self.a)), width)
        at_b = np.arange(start[-1]) - start[at_a] + self.first_b[self.group_a[at_a]]
        found = [(self.doc_a[at_a], self.a[at_a] * self.factor + self.b[at_b], np.ones(len(at_a), np.int64))]
        for g in np.flatnonzero(large):
            x, times_x = np.unique(self.a[self.first_a[g] : self.last_a[g] + 1], return_counts=True)
            y, times_y = np.unique(self.b[self.first_b[g] : self.last_b[g] + 1], return_counts=True)
            keys = (x[:, None] * self.factor + y).ravel()
            found.append((np.full(len(keys), self.doc[g]), keys, np.outer(times_x, times_y).ravel()))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def texts(self, shown: list[bytes], size: int) -> list[bytes]:
        """The groups of each document in decimal. ``shown`` has all ids behind a semicolon, a comma and a bar, ``size`` of each."""
        of_a, of_b = self.a + size, self.b + size
        of_a[self.first_a] -= size
        of_b[self.first_b] += size
        merged = np.empty(len(self.a) + len(self.b), np.int64)
        merged[np.arange(len(self.a)) + self.first_b[self.group_a]] = of_a
        merged[np.arange(len(self.b)) + self.last_a[self.group_b] + 1] = of_b
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        merged = merged.tolist()
        return [b"".join(map(shown.__getitem__, merged[low:high]))[1:] for low, high in zip([0, *ends], ends, strict=False)]


def _slices(batch: pa.RecordBatch, align: Encoder) -> Iterator[tuple[pa.Array, Aligned]]:
    """(ids, alignment) of so many rows of ``encoded`` at a time that they hold about SLICE_BYTES; a long text is alone."""
    sizes = [len(x) for x in batch.column("a").to_pylist()]
    low = held = 0
    for n, size in enumerate([*sizes, SLICE_BYTES]):
        if n > low and (held + size > SLICE_BYTES or n == len(sizes)):
            part = batch.slice(low, n - low)
            docs = [tuple(np.frombuffer(x, align.kind) for x in pair) for pair in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)]
            yield part.column("doc_id"), Aligned(docs, align.size_a, align.size_b, align.n_b)
            low, held = n, 0
        held += size


def encode(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a binary, b binary): both tokenizers' packed ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoder(path_a, path_b)
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                ids = both.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([a for a, _ in ids], pa.binary()), pa.array([b for _, b in ids], pa.binary())], ["doc_id", "a", "b"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, a binary, b binary")


def pair_counts(encoded: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair long, n long): in how many documents of a part of the table a pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = encoder(path_a, path_b)
        pairs, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def summed() -> None:
            keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate(counts))
            pairs[:], counts[:] = [keys], [total]

        def told() -> pa.RecordBatch:
            summed()
            return pa.RecordBatch.from_arrays([pa.array(pairs.pop()), pa.array(counts.pop())], ["pair", "n"])

        for batch in batches:
            for _, aligned in _slices(batch, align):
                doc, pair, _ = aligned.pairs()
                once = np.unique(pair * aligned.n_docs + doc) // aligned.n_docs
                keys, n = np.unique(once, return_counts=True)
                pairs.append(keys)
                counts.append(n)
                if sum(map(len, pairs)) > 2 * FLUSH_PAIRS:
                    summed()
                    if len(pairs[0]) > FLUSH_PAIRS:
                        yield told()
        if pairs:
            yield told()

    return encoded.mapInArrow(run, "pair long, n long")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 hash bits of each key, other ones for each seed."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(keys, 0) % np.uint64(buckets)).astype(np.int32)


def build_bucket(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(sizes of the bit arrays, their bits one after the other, the keys in the order of their indexes) of distinct keys."""
    sizes, bits, placed = [], [], []
    left, base = keys, 0
    while len(left):
        size = GAMMA * len(left) + 1
        at = (_mix(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        fits = alone[at]
        placed.append((base + at[fits], left[fits]))
        sizes.append(size)
        bits.append(alone)
        base += size
        left = left[~fits]
    if not placed:
        return sizes, np.zeros(0, bool), keys
    order = np.argsort(np.concatenate([p for p, _ in placed]))
    return sizes, np.concatenate(bits), np.concatenate([k for _, k in placed])[order]


class PairHash:
    """The minimal perfect hash of the buckets ``low`` to ``low + len(tables) - 1``, with verified keys."""

    def __init__(self, buckets: int, low: int, tables: list[tuple[list[int], bytes, bytes]]):
        self.buckets, self.low, self.n = buckets, low, len(tables)
        levels = max((len(s) for s, _, _ in tables), default=0)
        self.size = np.zeros((len(tables), levels), np.uint64)
        self.start = np.zeros((len(tables), levels), np.int64)
        bits, base = [], 0
        for i, (sizes, raw, _) in enumerate(tables):
            self.size[i, : len(sizes)] = sizes
            self.start[i, : len(sizes)] = base + np.cumsum([0, *sizes])[: len(sizes)]
            own = np.unpackbits(np.frombuffer(raw, np.uint8))
            bits.append(np.pad(own, (0, -len(own) % 64)))
            base += len(bits[-1])
        packed = np.packbits(np.concatenate(bits), bitorder="little") if bits else np.zeros(0, np.uint8)
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = np.concatenate([np.frombuffer(k, "<i8") for _, _, k in tables]) if tables else np.zeros(0, np.int64)
        #: The first index of each bucket.
        self.first = np.concatenate([[0], np.cumsum([len(k) // 8 for _, _, k in tables])]).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for those that are none or lie in other buckets."""
        out = np.full(len(keys), -1, np.int64)
        bucket = bucket_of(keys, self.buckets) - self.low
        live = np.flatnonzero((bucket >= 0) & (bucket < self.n))
        for level in range(self.size.shape[1]):
            size = self.size[bucket[live], level]
            live, size = live[size > 0], size[size > 0]
            if not len(live):
                break
            at = self.start[bucket[live], level] + (_mix(keys[live], level + 1) % size).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            rank = self.before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[live[hit]] = rank[hit]
            live = live[~hit]
        sure = out >= 0
        sure[sure] = self.keys[out[sure]] == keys[sure]
        return np.where(sure, out, -1)


def build_tables(seen: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, sizes, bits, keys), one row a bucket of the distinct pairs of ``seen``; and the number of buckets."""
    pairs = materialize(seen.select("pair").distinct(), "pairs")
    buckets = max(1, -(-pairs.count() // BUCKET_PAIRS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column("pair").to_numpy(), buckets)), batch.column("pair")], ["bucket", "pair"])

    def build(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "sizes": pa.array([], pa.list_(pa.int32())), "bits": pa.array([], pa.binary()), "keys": pa.array([], pa.binary())})
        sizes, bits, keys = build_bucket(np.sort(table.column("pair").to_numpy()))
        row = {"bucket": table.column("bucket")[:1], "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": [np.packbits(bits).tobytes()], "keys": [keys.astype("<i8").tobytes()]}
        return pa.table(row)

    built = pairs.mapInArrow(deal, "bucket int, pair long").groupBy("bucket").applyInArrow(build, "bucket int, sizes array<int>, bits binary, keys binary")
    return materialize(built, "tables"), buckets


def _ranges(buckets: int) -> list[tuple[int, int]]:
    step = max(1, RANGE_PAIRS // BUCKET_PAIRS)
    return [(low, min(buckets, low + step)) for low in range(0, buckets, step)]


def _hash_of(tables: DataFrame, buckets: int, low: int, high: int) -> PairHash:
    """One range's hash; a bucket that no pair fell into is an empty one."""
    rows = {r["bucket"]: (r["sizes"], bytes(r["bits"]), bytes(r["keys"])) for r in tables.where(F.col("bucket").between(low, high - 1)).collect()}
    return PairHash(buckets, low, [rows.get(b, ([], b"", b"")) for b in range(low, high)])


def _sum_tree(vectors: DataFrame, tasks: int) -> DataFrame:
    """One vector a bucket: FAN_IN at a time are added until one is left."""

    def add(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table
        total = sum(np.frombuffer(v, "<i8") for v in table.column("counts").to_pylist())
        return pa.table({"bucket": table.column("bucket")[:1], "task": table.column("task")[:1], "counts": [total.tobytes()]}, vectors_schema)

    vectors_schema = pa.schema([("bucket", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())])
    while True:
        tasks = -(-tasks // FAN_IN)
        vectors = vectors.withColumn("task", F.expr(f"cast(pmod(task, {tasks}) as int)")).groupBy("bucket", "task").applyInArrow(add, "bucket int, task int, counts binary")
        if tasks <= 1:
            return vectors.select("bucket", "counts")


def dense_counts(seen: DataFrame, tables: DataFrame, buckets: int) -> DataFrame:
    """(bucket, counts binary): the documents of each pair as 64-bit numbers, in the order of the bucket's indexes."""
    context, out = seen.sparkSession.sparkContext, None
    for low, high in _ranges(buckets):
        shared = context.broadcast(_hash_of(tables, buckets, low, high))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            of, task = shared.value, TaskContext.get().partitionId()
            total = np.zeros(len(of.keys), np.int64)
            for batch in batches:
                at = of.index(batch.column("pair").to_numpy())
                np.add.at(total, at[at >= 0], batch.column("n").to_numpy()[at >= 0])
            for b in np.flatnonzero(np.add.reduceat(np.append(total, 0), of.first[:-1]) * (np.diff(of.first) > 0)):
                part = total[of.first[b] : of.first[b + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([of.low + b], pa.int32()), pa.array([task], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["bucket", "task", "counts"])

        vectors = materialize(seen.mapInArrow(run, "bucket int, task int, counts binary"), "vectors")
        tasks = (vectors.agg(F.max("task")).first()[0] or 0) + 1
        summed = materialize(_sum_tree(vectors, tasks), "counts")
        out = summed if out is None else out.unionByName(summed)
        shared.unpersist()
    return out


def _highest(tables: DataFrame, counts: DataFrame, n_b: int) -> dict[int, int]:
    """The highest count of each A id: one number an id, so at most as many as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, "<i8") // n_b), pa.array(np.frombuffer(n, "<i8"))], ["a", "n"])

    each = tables.join(counts, "bucket").select("keys", "counts").mapInArrow(run, "a long, n long")
    return {r["a"]: r["n"] for r in each.groupBy("a").agg(F.max("n").alias("n")).collect()}


class PairCounts:
    """A range's hash with the counts behind it and which of them are their A id's highest."""

    def __init__(self, of: PairHash, counts: np.ndarray, best: np.ndarray):
        self.of, self.counts, self.best = of, counts, best

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, 1 if the highest) of each pair, zeros for those that are not here."""
        at = self.of.index(keys)
        there = at >= 0
        n, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        n[there], best[there] = self.counts[at[there]], self.best[at[there]]
        return n, best


def _range_counts(tables: DataFrame, counts: DataFrame, buckets: int, n_b: int, highest: np.ndarray) -> Iterator[PairCounts]:
    for low, high in _ranges(buckets):
        of = _hash_of(tables, buckets, low, high)
        rows = {r["bucket"]: bytes(r["counts"]) for r in counts.where(F.col("bucket").between(low, high - 1)).collect()}
        n = np.frombuffer(b"".join(rows.get(b, b"") for b in range(low, high)), "<i8")
        yield PairCounts(of, n, n == highest[of.keys // n_b])


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row a document of ``docs(doc_id, text)``: tokens, groups and links, and what the corpus has of its links.

    n_best counts the links whose pair is the most frequent of its A id, count_sum adds up the counts of all links.
    """
    context = docs.sparkSession.sparkContext
    encoded = materialize(encode(docs, path_a, path_b), "encoded", "zstd")
    seen = materialize(pair_counts(encoded, path_a, path_b), "seen")
    tables, buckets = build_tables(seen)
    counts = dense_counts(seen, tables, buckets)
    both = encoder(path_a, path_b)
    highest = np.zeros(len(both.bytes_a), np.int64)
    for a, n in _highest(tables, counts, both.n_b).items():
        highest[a] = n
    ranges = [context.broadcast(x) for x in _range_counts(tables, counts, buckets, both.n_b, highest)]

    def looked_up(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for shared in ranges:
            some, first = shared.value.look_up(keys)
            n, best = n + some, best + first
            if len(ranges) > 1:
                del shared._value  # the worker holds one range at a time and reads it again from its executor's disk
        return n, best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = encoder(path_a, path_b)
        size = max(len(align.bytes_a), align.n_b)
        shown = [b"%c%d" % (c, i) for c in b";,|" for i in range(size)]
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            for ids, x in _slices(batch, align):
                doc, pair, times = x.pairs()
                pairs, at = np.unique(pair, return_inverse=True)
                n, best = looked_up(pairs)
                sums = [x.n_a, x.n_b, np.bincount(x.doc, minlength=x.n_docs), x.by_doc(x.doc, x.links), x.by_doc(doc, times * best[at]), x.by_doc(doc, times * n[at])]
                groups = [sha256(t).hexdigest() if t else "" for t in x.texts(shown, size)]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in sums], pa.array(groups, pa.string())], names)

    return encoded.mapInArrow(run, RESULT)
