"""The versioned cache: snapshots, touched buckets, crashes and competing writers."""

import pytest

from quarrylens.operators import enrich
from quarrylens.operators.versioned_cache import Conflict, VersionedCache

SCHEMA = "source string, ioc_type string, ioc_value string, payload string, error string"


def batch(spark, rows):
    return spark.createDataFrame([("otx", "domain", k, p, e) for k, p, e in rows], SCHEMA)


def held(cache, version=None):
    return {r["ioc_value"]: (r["payload"], r["cached_at"]) for r in cache.read(version).collect()}


def test_versions_and_touched_buckets(spark, tmp_path):
    cache = VersionedCache(spark, f"file://{tmp_path}/cache", buckets=16)
    assert cache.read().count() == 0 and cache.version() == 0
    assert cache.upsert(batch(spark, [(f"k{i}", "a", None) for i in range(300)] + [("bad", None, "timeout")]), now=10, ttl=5) == 1
    assert cache.upsert(batch(spark, [("k7", "b", None), ("new", "b", None), ("new", "c", None)]), now=12, ttl=50) == 2
    assert held(cache) == {f"k{i}": ("a", 10) for i in range(300) if i != 7} | {"k7": ("b", 12), "new": ("c", 12)}
    assert held(cache, 1) == {f"k{i}": ("a", 10) for i in range(300)}
    first, second = cache.manifest(1), cache.manifest(2)
    assert len(first) == 16 and 1 <= sum(first[b] != second[b] for b in first) <= 2
    assert cache.upsert(batch(spark, [("x", None, "error")]), now=13) == 2
    assert cache.purge(14) == 2 and cache.purge(15) == 3
    assert held(cache) == {"k7": ("b", 12), "new": ("c", 12)} and enrich.stats(cache.read(), 15).first()[:] == (2, 2, 0)


def test_what_is_not_committed_is_not_seen(spark, tmp_path, monkeypatch):
    cache = VersionedCache(spark, f"file://{tmp_path}/cache", buckets=4)
    cache.upsert(batch(spark, [("a", "1", None)]), now=1)
    commit = cache._commit

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(cache, "_commit", crash)
    with pytest.raises(OSError, match="lost"):
        cache.upsert(batch(spark, [("a", "2", None)]), now=2)
    assert held(cache) == {"a": ("1", 1)}
    monkeypatch.setattr(cache, "_commit", commit)
    cache.upsert(batch(spark, [("a", "3", None)]), now=3)
    assert held(cache) == {"a": ("3", 3)}
    monkeypatch.setattr(cache, "version", lambda: 1)  # a writer that began before the last commit
    with pytest.raises(Conflict):
        cache.upsert(batch(spark, [("a", "4", None)]), now=4)
    monkeypatch.undo()
    assert held(cache) == {"a": ("3", 3)}
