"""The corpus pipeline: its stages keep the columns, drop what they should, and end in sequences."""

import random

import brute
import corpus_pipeline
import numpy as np
import pytest

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, labels = docs.columns, {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    at = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        at[name] = docs
        assert name == "packing" or docs.columns == columns
    rows = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, d in at.items() if n != "packing"}
    for i in rows["quality rules"]:
        n, *_, again = brute.base_counts(spark.read.parquet(f"{DIR}/documents.parquet").where(f"doc_id = {i}").first()["text"]) if i < 20 else (10, 0)
        assert n >= 10 and 100 * again <= 20 * n
    good = [i for i in rows["quality rules"] if labels.get(i) == 1]
    assert len([i for i in good if i in rows["quality classifier"]]) >= 0.95 * len(good)
    groups = brute.similar_groups(rows["quality classifier"])
    assert set(rows["SimHash near-dedup"]) == {i for i, g in groups.items() if i == g}
    near = sorted(rows["SimHash near-dedup"].items())
    left = rows["suffix-array dedup"]
    assert set(left) == {i for i, _ in near}
    expected = {r[0]: r[1] - r[2] for r in brute.repeats(near)}
    assert all(abs(len(left[i].encode()) - n) <= 8 for i, n in expected.items())
    lengths = [r["length"] for r in at["packing"].collect()]
    assert set(np.log2(lengths) % 1) == {0.0} and {r["doc_id"] for r in at["packing"].select("doc_id").collect()} == set(left)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, tied and repeated rows, repeated ids with unlike texts, and columns named like results."""
    rng = random.Random(9)
    text = [words(rng, 60) for _ in range(6)]
    rows = [(1, text[0]), (1, text[1]), (2, text[0]), (2, text[2]), (2, text[2]), (3, None), (4, ""), (5, None), (None, text[3]), (None, text[3]), (None, None)]
    rows += [(6, words(rng, 50_000)), (7, text[4]), (0, text[4] + " end"), (8, text[5]), (8, text[5])]
    schema = "doc_id long, text string, lang string, source string, n_chars int, kept string, n_bytes int, digest string, node int, _doc int, shard int, score double, _k1 string"
    extra = lambda i, t: (i, t, "en", None, len(t or ""), "k", 1, "d", 2, 3, 4, 0.5, "k1")
    return spark.createDataFrame([extra(*r) for r in rows], schema).repartition(3).cache()


def test_near_dedup_of_odd_rows(spark, odd):
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, odd, "").collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    with_id = {(i, t) for i, t in rows if i is not None}
    key = {x: (x[0], x[1] or "") for x in with_id}
    groups = brute.similar_groups({k: k[1] for k in key.values()})
    first = {k for k in groups if groups[k] == k}
    assert sorted((i, t or "") for i, t in got if i is not None) == sorted(first)
    assert sum(i is None for i, _ in got) == 3
    assert {t for i, t in rows if i in (1, 2)} == {t for i, t in got if i in (1, 2)}  # unlike texts of one id all stay


def test_other_stages_of_odd_rows(spark, odd):
    kept = corpus_pipeline.quality_rules(spark, odd, "")
    assert kept.columns == odd.columns
    texts = sorted(str(r["text"]) for r in kept.collect())
    assert texts == sorted(str(r["text"]) for r in odd.collect() if len((r["text"] or "").split()) >= 10)
    scored = corpus_pipeline.quality_classifier(spark, odd, DIR)
    assert scored.columns == odd.columns and {r["kept"] for r in scored.collect()} <= {"k"}
    left = corpus_pipeline.substring_dedup(spark, odd, "")
    assert left.columns == odd.columns and left.count() == odd.count()
    assert {(r["kept"], r["n_bytes"], r["_doc"]) for r in left.collect()} == {("k", 1, 3)}
    expected = sorted((i, n - gone) for i, n, gone, *_ in brute.repeats([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert sorted((brute.LAST if r["doc_id"] is None else r["doc_id"], len(r["text"])) for r in left.collect()) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in left.collect())
    packed = corpus_pipeline.pack(spark, odd, "")
    assert packed.where("start = 0").count() == odd.count()


def test_shared_folder_is_required_on_a_cluster(spark):
    from types import SimpleNamespace

    from quarrylens.storage import shared_dir

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k: None), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), master="spark://host:7077", applicationId="x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context))
    assert shared_dir(spark)
