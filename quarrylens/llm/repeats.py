"""Exact substring deduplication with longest-previous-factor arrays over a distributed suffix array.

A byte goes if some string of ``length`` bytes that covers it also starts in a document with a smaller id. Building
one suffix array of a corpus is a matter of every byte; here only the suffixes that can matter are sorted:

1. Windows of ``length`` bytes are keyed by the smallest hash of the GRAM-byte strings in them. The key is a function
   of the window alone, so equal windows meet under equal keys; neighbouring windows mostly share theirs, and a run
   of windows with one key is a *fragment*. Documents are dealt into blocks by id and text. Each block sends every key once,
   packed into one row for each bucket of keys, and learns which of its keys occur in another document.
2. Each block sends its distinct fragments under those keys to the buckets. A bucket puts all suffixes of its
   fragments that hold a window in suffix order, with the common prefix of each with the one before. In that order the
   previous and the next suffix of a smaller document give the longest previous factor of each suffix: the longest
   string from there on that a smaller document holds in the bucket. Factors of ``length`` or more are answered, and
   the smallest document of each fragment.
3. Each block marks the factors in its documents (whole fragments where a smaller document holds them) and keeps the
   rest.

A fragment has at most as many windows as can share one place of the smallest hash; longer runs (of periodic text)
are cut, so that suffixes are short and their order needs few steps.

A block sends a key or a fragment once, however many of its documents hold it, so copies and boilerplate in a third
of all rows weigh no more than the number of blocks. Keys that more than HOT_BLOCKS blocks hold, or about HOT_FRAGMENTS
distinct fragments of the blocks, are sent as single windows under a hash of the window instead, which spreads text
that stands around a very frequent phrase, at any size of the corpus. Blocks and
buckets have a fixed size; their numbers grow with the corpus. Nothing is dropped or capped: false sharing of the
32-bit keys only sends more fragments, and bytes decide.

Defined results: a null text is an empty one; a null doc_id ranks after all others; rows with equal ids do not
remove from each other; an empty table gives an empty result; further columns stay as they are, but
those named like a result column are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

GRAM = 20
BLOCK_BYTES = 4 << 20
BUCKET_KEYS_BYTES = 32 << 20
BUCKET_BYTES = 4 << 20
HOT_BLOCKS = 4096
#: Their windows take some 30 MB of arrays in a bucket.
HOT_FRAGMENTS = 8192
#: What a bucket answers of a block's fragments: the smallest document, the number of factors, their offsets and lengths.
FACTORS = ("unit", "least", "n", "factors")
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
_SLICE = 1 << 18
_LAST = (1 << 63) - 1
_U = np.uint64
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(29))
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _string_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of ``size`` values, by doubling."""
    powers = {1: values}
    width = 1
    while 2 * width <= size:
        h, factor = powers[width], _U(pow(_BASE, width, 1 << 64))
        powers[2 * width] = h[:-width] * factor + h[width:]
        width *= 2
    out, have = powers[width], width
    while have < size:
        more = 1 << ((size - have).bit_length() - 1)
        n = len(values) - have - more + 1
        out = out[:n] * _U(pow(_BASE, more, 1 << 64)) + powers[more][have : have + n]
        have += more
    return out


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Block:
    """The documents of a block, sorted by id, and their fragments: runs of windows with one key."""

    def __init__(self, table: pa.Table, length: int):
        doc = table.column("rank").to_numpy()
        self.order = np.argsort(doc, kind="stable")
        self.doc = doc[self.order].astype(np.int64)
        texts = table.column("text").to_pylist()
        self.texts = [texts[i] or b"" for i in self.order]
        self.length = length
        size = np.array([len(x) for x in self.texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.data = b"".join(self.texts)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self._fragments()

    def _fragments(self) -> None:
        """begin, end (of the windows' starts), key of each fragment, in the order of the text."""
        length, keys, begins, ends = self.length, [], [], []
        total, low = len(self.bytes), 0
        last_start = np.repeat(self.start[1:] - length, np.diff(self.start))  # of the document at each byte
        while total - low >= length:
            high = min(total, low + _SLICE + length - 1)
            h = _mixed(_string_hashes(_TABLE[self.bytes[low:high]], GRAM))
            least = _sliding_least(h, length - GRAM + 1)
            valid = last_start[low : low + len(least)] >= np.arange(low, low + len(least))
            change = np.empty(len(least) + 1, bool)
            change[0] = change[-1] = True
            np.not_equal(least[1:], least[:-1], out=change[1:-1])
            change[1:-1] |= valid[1:] != valid[:-1]
            edge = np.flatnonzero(change)
            good = valid[edge[:-1]]
            begins.append(edge[:-1][good] + low)
            ends.append(edge[1:][good] + low)
            keys.append(least[edge[:-1][good]])
            low = high - length + 1
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        begin, end, key = join(begins, np.int64), join(ends, np.int64), join(keys, np.uint64)
        most = length - GRAM + 1
        pieces = -(-(end - begin) // most)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.begin, self.key = np.repeat(begin, pieces) + part * most, np.repeat(key, pieces)
        self.end = np.minimum(np.repeat(end, pieces), self.begin + most)
        inside = np.searchsorted(self.start, self.begin, side="right") - 1
        self.of = self.doc[inside] if len(inside) else np.zeros(0, np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, whether each is in two documents of this block, and its number of distinct fragments here."""
        order = np.lexsort((self.of, self.key))
        key, of = self.key[order], self.of[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(key)]]) - 1 if len(key) else first
        n = last - first + 1
        many = np.repeat(n > 1, n)
        at = order[many]
        if len(at):
            # Equal fragments of a key count once.
            size = self.end[at] - self.begin[at]
            value = self._content(self.begin[at], self.end[at] + self.length - 1)
            group = np.repeat(np.arange(len(n)), n)[many]
            by = np.lexsort((value, size, group))
            new = np.ones(len(by), bool)
            new[1:] = (group[by][1:] != group[by][:-1]) | (size[by][1:] != size[by][:-1]) | (value[by][1:] != value[by][:-1])
            n = np.where(n > 1, np.bincount(group[by][new], minlength=len(n)), n)
        return key[first], of[first] != of[last], n

    def select(self, shared: np.ndarray, hot: np.ndarray) -> None:
        """Keep the fragments with a shared key and cut those with a hot key into windows. Sets unit and bucket hash."""
        is_hot = _member(self.key, hot)
        take = _member(self.key, shared) & ~is_hot
        begin, end, route = [self.begin[take]], [self.end[take]], [self.key[take]]
        if is_hot.any():
            n = (self.end - self.begin)[is_hot]
            at = np.repeat(self.begin[is_hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin.append(at)
            end.append(at + 1)
            route.append(None)
        begin, end = np.concatenate(begin), np.concatenate(end)
        values = self._content(begin, end + self.length - 1)
        if route[-1] is None:
            route[-1] = values[len(route[0]) :]
        route = np.concatenate(route)
        of = self.doc[np.searchsorted(self.start, begin, side="right") - 1] if len(begin) else np.zeros(0, np.int64)
        order = np.lexsort((begin, values, end - begin, route))
        same = np.concatenate([[True], (values[order][1:] != values[order][:-1]) | ((end - begin)[order][1:] != (end - begin)[order][:-1]) | (route[order][1:] != route[order][:-1])]) if len(order) else np.zeros(0, bool)
        unit = np.empty(len(order), np.int64)
        unit[order] = np.cumsum(same) - 1
        self.first = order[same]  # documents are in the order of their ids, so the first holder has the smallest id
        self.frag_begin, self.frag_end, self.unit, self.frag_of, self.route = begin, end, unit, of, route

    def _content(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes from begin to end, by sums of powers; taken in slices that share a document's bytes."""
        out = np.zeros(len(begin), np.uint64)
        inverse = pow(_BASE, -1, 1 << 64)
        order = np.argsort(begin, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 8192)):
            if not len(part):
                continue
            low, high = int(begin[part].min()), int(end[part].max())
            for cut in [part] if high - low <= 8 * _SLICE else np.array_split(part, len(part)):
                low, high = int(begin[cut].min()), int(end[cut].max())
                power = _powers(high - low, _BASE)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[self.bytes[low:high]] * power[:-1])])
                out[cut] = (sums[end[cut] - low] - sums[begin[cut] - low]) * _powers(high - low, inverse)[begin[cut] - low]
        return _mixed(out)


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(16, (n + 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = _U(base)
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[: n + 1]


def _member(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(values, x)
    at[at == len(values)] = 0
    return values[at] == x


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of big-endian words are zero."""
    return sum((x >> _U(64 - 8 * j)) == 0 for j in range(1, 9)).astype(np.int64)


def suffix_order(data: bytes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes data[at : at + size], and the common prefix of each with the one before it in that order.

    Words of 8 bytes, big-endian, are compared from the left; only those suffixes that are still tied are looked at
    again. Of two suffixes of which one begins with the other, the shorter one is first.
    """
    padded = np.frombuffer(data + bytes(8), np.uint8)
    word = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        word = (word << _U(8)) | padded[k : k + len(word)]

    def words(which: np.ndarray, k: int) -> np.ndarray:
        rest = size[which] - 8 * k
        w = word[np.minimum(at[which] + 8 * k, len(word) - 1)]
        short = rest < 8
        if short.any():
            keep = 8 * np.clip(rest[short], 0, 8).astype(np.uint64)
            w[short] = np.where(keep > 0, w[short] >> (_U(64) - np.maximum(keep, _U(8))) << (_U(64) - np.maximum(keep, _U(8))), _U(0))
        return w

    n = len(at)
    order, new, common = np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64)
    new[:1] = True
    place, group = np.arange(n), np.zeros(n, np.int64)
    for k in range(-(-int(size.max(initial=0)) // 8) + 1):
        if not len(place):
            break
        suffix = order[place]
        last = 8 * k >= size[suffix].max()
        w = size[suffix].astype(np.uint64) if last else words(suffix, k)
        by = np.lexsort((w, group)) if k else np.argsort(w, kind="stable")
        suffix, w = suffix[by], w[by]
        order[place] = suffix
        apart = np.flatnonzero((group[1:] == group[:-1]) & ((w[1:] != w[:-1]) | last)) + 1
        common[place[apart]] = 8 * k if last else 8 * k + _equal_bytes(w[apart] ^ w[apart - 1])
        new[place[apart]] = True
        tied = ~new[place]
        tied[:-1] |= ~new[place[1:]] & (np.diff(place) == 1)
        place = place[tied]
        group = np.cumsum(new)[place]
    common[1:] = np.minimum(common[1:], np.minimum(size[order[1:]], size[order[:-1]]))  # no prefix is longer than the shorter one
    return order, common


def _smaller_before(doc: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order: its common prefix with the nearest one before it of a smaller document, 0 if below ``length``.

    Pointers jump: what a pointer skips is of no smaller document, so a pointer may take over that of its goal.
    """
    found, low, before = np.zeros(len(doc), np.int64), common.copy(), np.arange(len(doc)) - 1
    active = np.flatnonzero(common >= length)
    while len(active):
        to = before[active]
        smaller = doc[to] < doc[active]
        found[active[smaller]] = low[active[smaller]]
        active, to = active[~smaller], to[~smaller]
        low[active], before[active] = np.minimum(low[active], low[to]), before[to]
        active = active[low[active] >= length]
    return found


def previous_factors(data: bytes, begin: np.ndarray, count: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, offset, longest previous factor) of the suffixes that start at the windows of the fragments.

    Fragment f is data[begin[f] : begin[f] + count[f] + length - 1], of document doc[f]. A suffix's longest previous
    factor is its longest prefix with which a suffix of a smaller document begins; those below ``length`` count as 0.
    """
    frag = np.repeat(np.arange(len(begin)), count)
    offset = np.arange(len(frag)) - np.repeat(np.cumsum(count) - count, count)
    order, common = suffix_order(data, begin[frag] + offset, count[frag] + length - 1 - offset)
    holder = doc[frag][order]
    after = np.concatenate([common[:1] * 0, common[1:][::-1]])
    longest = np.zeros(len(frag), np.int64)
    longest[order] = np.maximum(_smaller_before(holder, common, length), _smaller_before(holder[::-1], after, length)[::-1])
    return frag, offset, longest


def longest_factors(frag: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Which suffixes have a factor that is not the rest of the one before."""
    new = longest > 0
    new[1:] &= (frag[1:] != frag[:-1]) | (longest[1:] >= longest[:-1])
    return np.flatnonzero(new)


def marks(twice: np.ndarray, fragments: np.ndarray) -> np.ndarray:
    """One byte a key: the upper bit says that two documents of the block hold it, the others that it has at most 2 ** n fragments."""
    return (np.ceil(np.log2(np.maximum(fragments, 1))).astype(np.uint8)) | (twice.astype(np.uint8) << 7)


def judge_keys(keys: np.ndarray, mark: np.ndarray, hot_blocks: int, hot_fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """For the keys that blocks sent, with their marks: whether two documents hold each, and whether it is hot."""
    which, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    any_twice = np.zeros(len(which), bool)
    any_twice[at[mark > 127]] = True
    fragments = np.bincount(at, weights=np.exp2(mark & 127), minlength=len(which))
    shared = (n > 1) | any_twice
    return shared[at], (shared & ((n > hot_blocks) | (fragments > hot_fragments)))[at]


def block_of(n_blocks: int) -> Column:
    """The block of a row of (rank, text). Results compare ids, so equal ids may lie in different blocks."""
    return F.pmod(F.xxhash64("rank", "text"), F.lit(n_blocks)).cast("int")


def _pack(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
    for low, high in zip(edge, [*edge[1:], len(bucket)], strict=True):
        yield int(bucket[order[low]]), order[low:high]


def remove_repeats(docs: DataFrame, length: int = 50, block_bytes: int = BLOCK_BYTES, key_bucket_bytes: int = BUCKET_KEYS_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_blocks: int = HOT_BLOCKS, hot_fragments: int = HOT_FRAGMENTS) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans long and kept_sha256, kept string to ``docs(doc_id, text, ...)``.

    ``kept`` is the remaining text without characters that lost a byte; the digest is that of all remaining bytes.
    """
    if not GRAM + 8 <= length < 1 << 15:
        raise ValueError(f"the length must be {GRAM + 8} at least and below {1 << 15}")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, n_key_buckets, n_buckets = (max(8, -(-total // x)) for x in (block_bytes, key_bucket_bytes, bucket_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks // 4)
    key_shift, shift = _U(32), _U(11)

    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text", *RESULTS)]
    blocks = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("rank"),
        F.col("text").cast("binary").alias("text"),
        F.struct("doc_id", *[F.col(f"`{c}`") for c in others]).alias("row"),
    ).withColumn("block", block_of(n_blocks))
    blocks = blocks.repartition(parts, "block")

    def bucket_of_keys(key: np.ndarray) -> np.ndarray:
        return (key >> key_shift) % _U(n_key_buckets)

    def send_keys(key: tuple, table: pa.Table) -> pa.Table:
        block, found = key[0].as_py(), Block(table, length)
        keys, twice, fragments = found.keys()
        mark = marks(twice, fragments)
        rows: list[tuple] = []
        for b, at in _by_bucket(bucket_of_keys(keys)):
            rows.append((b, block, _pack(keys[at], "<u4"), _pack(mark[at], "u1")))
        return pa.Table.from_pylist([dict(zip(("bucket", "block", "keys", "mark"), r, strict=True)) for r in rows], pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("mark", pa.binary())]))

    def match_keys(table: pa.Table) -> pa.Table:
        block, raw = table.column("block").to_pylist(), [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        mark = np.concatenate([np.frombuffer(x, "u1") for x in table.column("mark").to_pylist()])
        shared, hot = judge_keys(np.concatenate(raw), mark, hot_blocks, hot_fragments)
        out, low = [], 0
        for b, x in zip(block, raw, strict=True):
            keep, warm = shared[low : low + len(x)], hot[low : low + len(x)]
            low += len(x)
            if keep.any():
                out.append({"block": b, "keys": _pack(x[keep], "<u4"), "hot": _pack(warm[keep], "u1")})
        bucket = table.column("bucket")[0].as_py()
        return pa.Table.from_pylist([{**x, "bucket": bucket} for x in out], pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary()), ("bucket", pa.int32())]))

    def chosen(table: pa.Table, answers: pa.Table) -> Block:
        found = Block(table, length)
        # A key is known by its bucket and its low 32 bits.
        short = (bucket_of_keys(found.key) << _U(32)) | (found.key & _U(0xFFFFFFFF))
        shared, hot = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for b, keys, warm in zip(*(answers.column(c).to_pylist() for c in ("bucket", "keys", "hot")), strict=True):
            k = np.frombuffer(keys, "<u4").astype(np.uint64) | (_U(b) << _U(32))
            shared.append(k)
            hot.append(k[np.frombuffer(warm, "u1") > 0])
        full, found.key = found.key, short
        found.select(np.sort(np.concatenate(shared)), np.sort(np.concatenate(hot)))
        found.key = full
        return found

    def send_fragments(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[dict] = []
        if table.num_rows and answers.num_rows:
            found = chosen(table, answers)
            block, first = key[0].as_py(), found.first
            bucket = (_mixed(found.route[first]) >> shift) % _U(n_buckets)
            begin, end = found.frag_begin[first].tolist(), (found.frag_end[first] + length - 1).tolist()
            for b, at in _by_bucket(bucket):
                rows.append({"bucket": b, "block": block, "unit": _pack(at, "<u4"), "doc": _pack(found.frag_of[first[at]], "<i8"), "size": _pack((found.frag_end - found.frag_begin)[first[at]], "<u4"), "data": b"".join([found.data[begin[i] : end[i]] for i in at])})
        return pa.Table.from_pylist(rows, fragment_schema)

    fragment_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("unit", pa.binary()), ("doc", pa.binary()), ("size", pa.binary()), ("data", pa.binary())])

    def match_fragments(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("block", "unit", "doc", "size", "data")}
        count = np.concatenate([np.frombuffer(x, "<u4") for x in cols["size"]]).astype(np.int64)
        doc = np.concatenate([np.frombuffer(x, "<i8") for x in cols["doc"]])
        data = b"".join(cols["data"])
        cols["data"] = None
        stop = np.cumsum(count + length - 1)
        begin = stop - (count + length - 1)
        # Equal fragments of several blocks are sorted once, under their smallest document.
        number: dict[bytes, int] = {}
        unique = np.array([number.setdefault(data[b:e], len(number)) for b, e in zip(begin.tolist(), stop.tolist(), strict=True)], np.int64)
        _, first = np.unique(unique, return_index=True)
        least = np.full(len(first), _LAST, np.int64)
        np.minimum.at(least, unique, doc)
        frag, offset, longest = previous_factors(data, begin[first], count[first], least, length)
        piece = longest_factors(frag, longest)
        factor = np.stack([offset[piece], longest[piece]], axis=1)
        low = np.searchsorted(frag[piece], np.arange(len(first)), side="left")
        n = np.searchsorted(frag[piece], np.arange(len(first)), side="right") - low
        rows, at = [], 0
        for b, raw in zip(cols["block"], cols["unit"], strict=True):
            unit = np.frombuffer(raw, "<u4")
            u, own = unique[at : at + len(unit)], doc[at : at + len(unit)]
            at += len(unit)
            said = (least[u] < own) | (n[u] > 0)  # of all others the block holds the smallest document itself
            unit, u = unit[said], u[said]
            if len(u):
                k = np.repeat(low[u], n[u]) + np.arange(n[u].sum()) - np.repeat(np.cumsum(n[u]) - n[u], n[u])
                rows.append({"block": b, "unit": _pack(unit, "<u4"), "least": _pack(least[u], "<i8"), "n": _pack(n[u], "<u2"), "factors": _pack(factor[k], "<u2")})
        return pa.Table.from_pylist(rows, pa.schema([("block", pa.int32()), *[(c, pa.binary()) for c in FACTORS]]))

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        # The keys' answers and the fragments' answers come as rows of one table.
        is_key = answers.column("keys").is_valid()
        found = chosen(table, answers.filter(is_key))
        mark = np.zeros(len(found.bytes) + 1, np.int32)
        if len(found.first):
            least, low, n = found.frag_of[found.first].copy(), np.zeros(len(found.first), np.int64), np.zeros(len(found.first), np.int64)
            factors, done = [np.zeros((0, 2), np.int64)], 0
            for x in answers.filter(answers.column("unit").is_valid()).select(list(FACTORS)).to_pylist():
                unit, many = np.frombuffer(x["unit"], "<u4"), np.frombuffer(x["n"], "<u2").astype(np.int64)
                least[unit], n[unit], low[unit] = np.frombuffer(x["least"], "<i8"), many, done + np.cumsum(many) - many
                factors.append(np.frombuffer(x["factors"], "<u2").reshape(-1, 2).astype(np.int64))
                done += len(factors[-1])
            factor = np.concatenate(factors)
            whole = found.frag_of > least[found.unit]
            np.add.at(mark, found.frag_begin[whole], 1)
            np.add.at(mark, found.frag_end[whole] + length - 1, -1)
            part, u = found.frag_begin[~whole], found.unit[~whole]
            k = np.repeat(low[u], n[u]) + np.arange(n[u].sum()) - np.repeat(np.cumsum(n[u]) - n[u], n[u])
            start = np.repeat(part, n[u]) + factor[k, 0]
            np.add.at(mark, start, 1)
            np.add.at(mark, start + factor[k, 1], -1)
        removed = np.cumsum(mark[:-1]) > 0
        rows: dict[str, list] = {c: [] for c in RESULTS}
        for i, text in enumerate(found.texts):
            out = removed[found.start[i] : found.start[i + 1]]
            n_removed, kept, spans = int(out.sum()), text, 0
            if n_removed:
                spans = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~out].tobytes()
            for c, v in zip(rows, (len(text), n_removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")), strict=True):
                rows[c].append(v)
        row = table.column("row").take(pa.array(found.order))
        return pa.Table.from_arrays([row, *[pa.array(v, t) for v, t in zip(rows.values(), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], ["row", *rows])

    done_type = StructType([blocks.schema["row"], *(StructField(c, t) for c, t in zip(RESULTS, (LongType(), LongType(), LongType(), StringType(), StringType()), strict=True))])

    # The text is dealt out once; each of the three passes reads that exchange.
    keys = blocks.groupBy("block").applyInArrow(send_keys, "bucket int, block int, keys binary, mark binary")
    shared = keys.groupBy("bucket").applyInArrow(match_keys, "block int, keys binary, hot binary, bucket int").repartition(parts, "block")
    fragments = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_fragments, "bucket int, block int, unit binary, doc binary, size binary, data binary")
    sources = fragments.groupBy("bucket").applyInArrow(match_fragments, "block int, unit binary, least binary, n binary, factors binary")
    none = lambda *names: [F.lit(None).cast("binary" if n != "bucket" else "int").alias(n) for n in names]
    answers = shared.select("block", "bucket", "keys", "hot", *none(*FACTORS)).unionByName(sources.select("block", *none("bucket", "keys", "hot"), *FACTORS)).repartition(parts, "block")
    done = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, done_type)
    return done.select("row.*", *RESULTS)
