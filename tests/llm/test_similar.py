"""Near-dedup of the pipeline: 5-word shingles, similarity 0.8 or more."""

import random

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(x, y):
    return len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def changed(rng, text, n):
    out = list(text)
    for i in range(n):
        out[(i + 1) * len(out) // (n + 1)] = words(rng, 1)[0]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def test_keys_of_texts_are_not_broadcast(spark):
    """Each text has 16 keys, of which Spark counts one; a broadcast goes through the driver."""
    i = F.col("id")
    nodes = spark.range(10).select(i.alias("node"), i.alias("fp"), F.lit(3).alias("size"), F.array(i).alias("bands"))
    linked = similar.keyed(nodes)
    pairs = similar.candidates(nodes, linked)
    sets = nodes.select("node", F.col("bands").alias("shingles"))
    for df in (linked, pairs, similar.verified(pairs, sets)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_dedup_joins_similar_texts(spark):
    rng = random.Random(4)
    rows, dropped = [], set()
    for i in range(40):
        base = words(rng, 300)
        near, far = changed(rng, base, 6), changed(rng, base, 9)
        assert jaccard(" ".join(base), " ".join(near)) >= 0.8 > jaccard(" ".join(base), " ".join(far))
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(changed(rng, words(rng, 300), 1)))]
        dropped.add(3 * i + 1)
        rows.append((1000 + i, " ".join(far)))
    # A large group of near copies of one text, whose keys are hot.
    base = words(rng, 200)
    group = [(2000 + i, " ".join(changed(rng, base, 1))) for i in range(100)]
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows + group), "").collect()}
    assert kept & {i for i, _ in rows} == {i for i, _ in rows} - dropped
    assert kept & {i for i, _ in group} == {2000}


@pytest.mark.parametrize("some", [True, False])
def test_texts_of_frequent_keys_lose_no_link(spark, monkeypatch, some):
    """A passage in all texts gives them common keys; without any other candidates, the exact way alone finds all groups."""
    monkeypatch.setattr(similar, "ALL_PAIRS", 1)
    candidates = similar.candidates
    monkeypatch.setattr(similar, "candidates", lambda *x: candidates(*x).where("a % 3 = 0" if some else "false"))
    rng = random.Random(8)
    passage, rows = words(rng, 170), []
    for i in range(120):
        base = passage + words(rng, 40)
        rows.append(base)
        if i % 3 == 0:
            rows += [changed(rng, base, 3), changed(rng, rows[-1], 2)]
    rng.shuffle(rows)
    texts = {i: " ".join(t) for i, t in enumerate(rows)} | {900: texts_end(rows[0], rng), 901: ""}
    table = frame(spark, list(texts.items()) + [(0, texts[0]), (5, texts[5])])
    linked = similar.keyed(nodes(spark, texts))
    assert linked.where("n > 16").count() > 200
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_texts(table).collect()}
    groups = brute.similar_groups(texts)
    partition = lambda of: {frozenset(i for i in of if of[i] == g) for g in of.values()}
    assert partition(found) == partition(groups)


def texts_end(words_, rng):
    return " ".join(words_ + words(rng, 2))


def nodes(spark, texts):
    rows = [(i, len(h := similar.np.unique(similar.shingle_hashes(t.encode(), 5))), similar.band_keys(h).view("int64").tolist()) for i, t in texts.items()]
    return spark.createDataFrame(rows, "node long, size int, bands array<long>")
