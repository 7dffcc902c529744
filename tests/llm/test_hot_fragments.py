"""Relief for keys with very many fragments, however few blocks there are."""

import random
import numpy as np
import pyarrow as pa

import brute

from quarrylens.llm import repeats

PHRASE = "the same thirty bytes everywhere"


def texts(n=300):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(12))
    rows = [(i, f"{word()} {word()} {word()} {PHRASE} {word()} {word()} {word()}") for i in range(n)]
    return rows + [(n + i, f"{word()} {rows[i][1]}") for i in range(20)] + [(n + 20, rows[0][1]), (None, rows[3][1]), (None, rows[3][1])]


def test_distinct_fragments_make_a_key_hot():
    rows = [(i, t.encode()) for i, t in texts() if i is not None]
    block = repeats.Block(pa.table({"rank": [i for i, _ in rows], "text": [t for _, t in rows]}), 50)
    keys, twice, n = block.keys()
    assert n.max() > 64
    distinct = {}
    for k, b, e in zip(block.key.tolist(), block.begin.tolist(), block.end.tolist(), strict=True):
        distinct.setdefault(k, set()).add(block.data[b : e + 49])
    assert n.tolist() == [len(distinct[k]) for k in keys.tolist()]
    shared, hot = repeats.judge_keys(keys, repeats.marks(twice, n), 4096, 64)
    assert hot[n > 64].all() and not hot[n <= 32].any() and shared[hot].all()
    two = np.concatenate([keys, keys])
    assert repeats.judge_keys(two, np.tile(repeats.marks(twice, n), 2), 4096, 150)[1].any()


def test_rows_with_hot_fragments(spark):
    found = repeats.remove_repeats(spark.createDataFrame(texts(), "doc_id long, text string"), hot_fragments=30)
    mine = sorted((brute.LAST if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect())
    assert mine == sorted(brute.repeats(texts()))


def test_rows_without_id_are_dealt_over_the_blocks(spark):
    rows = spark.range(1000).selectExpr("9223372036854775807 rank", "cast(string(id) as binary) text")
    assert rows.select(repeats.block_of(8).alias("b")).distinct().count() == 8
