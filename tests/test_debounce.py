"""Batches by silence, by number and by timer, over several micro-batches."""

import datetime as dt

import pytest

from quarrylens.streaming import debounce

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, value string, ts timestamp"


@pytest.fixture
def batches(spark, tmp_path):
    """Adds rows as a file, runs the stream on from its checkpoint and gives all batches so far."""
    name, provider = debounce.PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)

    def run(rows, **options):
        spark.createDataFrame([(k, v, T0 + dt.timedelta(seconds=s)) for k, v, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
        query = debounce.debounced(found, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["key"], r["values"]) for r in spark.read.schema("key string, values array<string>, n int").parquet(str(tmp_path / "out")).collect())

    yield run
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_silence_number_and_timer(batches):
    got = batches([("a", "x", 0), ("a", "y", 0.5), ("a", "x", 1), ("a", "z", 9), ("b", "p", 0)], seconds=2, most=3)
    assert got == [("a", ["x", "y"]), ("b", ["p"])]  # b by its timer, as the watermark is at 9
    got = batches([("a", "w", 10), ("a", "v", 10.5), ("c", "late", 20)], seconds=2, most=3)
    assert got == [("a", ["x", "y"]), ("a", ["z", "w", "v"]), ("b", ["p"])]
    got = batches([("c", "later", 30)], seconds=2, most=3)
    assert got == [("a", ["x", "y"]), ("a", ["z", "w", "v"]), ("b", ["p"]), ("c", ["late"])]


class Store:
    """A state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {
                "exists": lambda: bool(self.rows), "get": lambda: self.rows.get(()), "update": lambda v: self.rows.update({(): v}), "clear": self.rows.clear, "keys": lambda: list(self.rows), "iterator": lambda: list(self.rows.items()),
                "containsKey": lambda k: k in self.rows, "updateValue": lambda k, v: self.rows.update({k: v}), "getMapState": lambda *a: self, "getValueState": lambda *a: Store(), "listTimers": list, "deleteTimer": lambda t: None,
                "registerTimer": lambda t: None, "getCurrentWatermarkInMs": lambda: 0,
            }[name](*args)

        return call


def test_rows_cost_no_calls_of_the_state():
    import pandas as pd

    held, processor = Store(), debounce.Debounce(600, 4)
    processor.init(held)
    parts = [pd.DataFrame({"ts": [pd.Timestamp(T0) + pd.Timedelta(seconds=i + p) for i in range(0, 4002, 2)], "value": [f"{i + p:05}" for i in range(0, 4002, 2)]}) for p in (0, 1)]
    got = pd.concat(processor.handleInputRows(("k",), iter(parts), Store()))
    assert got["values"].tolist() == [[f"{i + j:05}" for j in range(4)] for i in range(0, 4000, 4)]
    assert sorted(held.rows) == [("04000",), ("04001",)] and held.calls < 20
