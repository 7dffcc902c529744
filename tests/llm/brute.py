"""Plain Python versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def simhash(text: str | None) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def components(prints: dict[int, int], bits: int = 3) -> dict[int, int]:
    parent = {i: i for i in prints}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def repeats(rows: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple]:
    """(rank, n_bytes, n_removed, n_spans, sha256) for each row."""
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for rank, t in texts:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(first.get(s, LAST), rank)
    out = []
    for rank, t in texts:
        gone = set()
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < rank:
                gone.update(range(k, k + length))
        spans = sum(1 for k in gone if k - 1 not in gone)
        kept = bytes(b for k, b in enumerate(t) if k not in gone)
        out.append((rank, len(t), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def gear_chunks(data: bytes, gear: list[int], low: int, high: int, bits: int) -> list[bytes]:
    """Chunks by a rolling hash of one byte after the other."""
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        n = i + 1 - start
        if (n >= low and h >> (32 - bits) == 0) or n == high:
            out.append(data[start : i + 1])
            start = i + 1
    return out + [data[start:]] * (start < len(data))


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def similar_groups(texts: dict, least: float = 0.8) -> dict:
    """The smallest key of each text's group; all pairs of texts that share a shingle are compared."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for i in sorted(sets):
        for j in {j for s in sets[i] or [None] for j in holders.get(s, ())}:
            if jaccard(sets[i], sets[j]) >= least:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i] or [None]:
            holders.setdefault(s, []).append(i)
    return {i: find(i) for i in texts}


def merges(text: str, score: dict[str, float]) -> list[str]:
    """Byte-pair merges: the best pair of neighbours first, the left one of equals."""
    parts = list(text)
    while True:
        offers = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
        if not offers:
            return parts
        i = min(offers)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def factors(suffixes: list[tuple[bytes, int]], least: int) -> list[int]:
    """The longest prefix of each suffix with which one of a smaller document begins, 0 if shorter than ``least``."""

    def common(x: bytes, y: bytes) -> int:
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    best = [max([common(s, t) for t, e in suffixes if e < d], default=0) for s, d in suffixes]
    return [n if n >= least else 0 for n in best]
