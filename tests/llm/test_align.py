"""Token alignment against whole texts, plain loops and dictionaries; and the minimal perfect hash."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylens.llm import align
from quarrylens.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox, the quick brown fox; it's <|endoftext|> and <s>.",
    "  two  spaces \n\n and\tlines \r\n end ",
    " ",
    "\n",
    "",
    None,
    "has ▁ inside",
    "été 日本語の文 \U0001f600\U0001f600  nbsp　wide",
    "a\0b\x1c c ​",
    "x" * 3000 + " " + "0123456789" * 300 + " ÿþ" * 50,
    "The quick brown fox, the quick brown fox; it's <|endoftext|> and <s>.",
    "word " * 2000,
]


def plain(text):
    """(a ids, b ids, groups) of a whole text by the libraries, without units; None if bytes differ."""
    both = align.encoder(A, B)
    if not text:
        return None
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(both.bytes_a[i] for i in a) != raw or b"".join(both.bytes_b[i] for i in b) != raw:
        return None
    ends = lambda ids, of: np.cumsum([len(of[i]) for i in ids]).tolist()
    end_a, end_b = ends(a, both.bytes_a), ends(b, both.bytes_b)
    cuts = sorted(set(end_a) & set(end_b))
    groups, i, j = [], 0, 0
    for c in cuts:
        k, m = end_a.index(c) + 1, end_b.index(c) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


def brute(texts):
    found = [plain(t) for t in texts]
    links = [Counter((x, y) for ga, gb in f[2] for x in ga for y in gb) if f else Counter() for f in found]
    counts = Counter(p for each in links for p in each)
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for f, each in zip(found, links, strict=True):
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        out.append((len(f[0]), len(f[1]), len(f[2]), each.total(), sum(n for p, n in each.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in each.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def check(spark, texts):
    df = spark.createDataFrame([(n, t, 1, 2) for n, t in enumerate(texts)], "doc_id long, text string, n_a int, pair int").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in align.align_documents(df, A, B).collect()}
    assert [got[n] for n in range(len(texts))] == brute(texts)


def test_alignment_matches_plain_loops(spark):
    check(spark, TEXTS)


def test_whole_table_matches_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    check(spark, [r["text"] for r in docs])


def test_empty_table(spark):
    found = align.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert found.count() == 0 and [f"{n} {t.replace('bigint', 'long')}" for n, t in found.dtypes] == align.RESULT.split(", ")


def test_small_ranges_and_trees_give_the_same(spark, monkeypatch):
    """Many buckets, several ranges in a task and several levels of sums."""
    for name, value in (("BUCKET_PAIRS", 8), ("RANGE_PAIRS", 64), ("FAN_IN", 2), ("FLUSH_PAIRS", 20), ("MEMORY_UNITS", 3), ("LARGE_GROUP", 3), ("SLICE_BYTES", 40)):
        monkeypatch.setattr(align, name, value)
    check(spark, TEXTS)


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \t\n'sx1.é 　中\x1c▁")), max_size=24))
def test_units_give_the_tokens_of_the_whole(text):
    both = align.encoder(A, B)
    ids = [np.frombuffer(x, both.kind).tolist() for x in both.encode([text])[0]]
    whole = plain(text)
    assert ids == (list(whole[:2]) if whole else [[], []])


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_hash_is_minimal_and_verified(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    buckets = 7
    dealt = [align.build_bucket(keys[align.bucket_of(keys, buckets) == b]) for b in range(buckets)]
    tables = [(s, np.packbits(x).tobytes(), k.astype("<i8").tobytes()) for s, x, k in dealt]
    of = align.PairHash(buckets, 0, tables)
    assert sorted(of.index(keys)) == list(range(len(keys)))
    others = np.arange(1 << 41, (1 << 41) + 500)
    assert (of.index(others) == -1).all()
    some = align.PairHash(buckets, 3, tables[3:5])
    inside = np.isin(align.bucket_of(keys, buckets), (3, 4))
    assert ((some.index(keys) >= 0) == inside).all()
    assert sum(len(x) for _, x, _ in dealt) <= 6 * len(keys) + 70
