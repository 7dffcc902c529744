"""Streaming exact deduplication: odd rows, resumed runs and colliding digests."""

import hashlib
import re

from pyspark.sql import functions as F

from quarrylens.llm import exact

SCHEMA = "doc_id long, text string, file string, first string, digest string"
ROWS = [
    (5, "a  b", "f", "x", "d"),
    (3, "a\tb", "f", "x", "d"),
    (3, "a \r\n b", "f", "x", "d"),
    (9, None, None, None, None),
    (8, "", None, None, None),
    (None, "a b", None, None, None),
    (None, "only", None, None, None),
    (None, "only", None, None, None),
    (7, " a b", None, None, None),
    (6, "a b", None, None, None),
    (4, "x y " * 80_000, None, None, None),
    (2, "x  y " * 80_000, None, None, None),
]


def expected(rows):
    """By plain loops: (doc_id, keep_id, group_size, digest) sorted, and how many rows of each group stay."""
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(plain(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out = [(i, keep[plain(t)], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t, *_ in rows]
    return sorted(out, key=str)


def decided(df):
    rows = df.select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")), "kept").collect()
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    return sorted([tuple(r)[:4] for r in rows], key=str), sum(r["kept"] for r in rows)


def test_odd_rows_and_survivors(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    found = exact.dedup(spark, path)
    rows, kept = decided(found)
    assert rows == expected(ROWS) and kept == 6
    left = exact.survivors(spark, path, found)
    assert left.columns == ["doc_id", "text", "file", "first", "digest"] and left.count() == 6


def test_one_file_and_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    empty = exact.dedup(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and empty.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "digest"]
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "one"))
    file = next((tmp_path / "one").glob("part-*"))
    assert decided(exact.dedup(spark, str(file)))[0] == expected(ROWS)


def test_state_goes_on_where_it_ended(spark, tmp_path):
    """New files meet the state of earlier runs; what was read is not read again."""
    path, work = str(tmp_path / "t"), str(tmp_path / "work")
    spark.createDataFrame(ROWS[:6], SCHEMA).repartition(2).write.parquet(path)
    assert decided(exact.dedup(spark, path, work, files=1))[0] == expected(ROWS[:6])
    spark.createDataFrame(ROWS[6:], SCHEMA).repartition(2).write.mode("append").parquet(path)
    assert decided(exact.dedup(spark, path, work, files=1))[0] == expected(ROWS)
    before = sum(1 for _ in (tmp_path / "work/prints").glob("part-*"))
    assert decided(exact.dedup(spark, path, work))[0] == expected(ROWS)
    assert sum(1 for _ in (tmp_path / "work/prints").glob("part-*")) == before
    assert spark.conf.get(next(iter(exact.STATE)), None) != exact.STATE[next(iter(exact.STATE))]


def test_bytes_decide_when_digests_collide(spark, tmp_path):
    """With a digest of two bits, texts that differ stay apart and equal ones stay together."""
    path, work = str(tmp_path / "t"), str(tmp_path / "work")
    rows = [(n, f"text {n % 7}") for n in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    exact.observe(spark, path, work, digest=lambda t: F.unhex(F.hex(F.pmod(F.crc32(t.cast("binary")), F.lit(4)))))
    found = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.decide(spark, path, work).collect())
    assert found == [(n, n % 7, len(range(n % 7, 40, 7)), n < 7) for n in range(40)]


def test_a_hot_text_is_one_entry(spark, tmp_path):
    path, work = str(tmp_path / "t"), str(tmp_path / "work")
    spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text")).repartition(6).write.parquet(path)
    found = exact.dedup(spark, path, work)
    assert found.where("kept").count() == 6001 and found.where("group_size = 3000 and keep_id = 0").count() == 3000
    assert exact.ledger(spark, work).count() == 6001
