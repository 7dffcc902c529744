"""Growing logs: restarts, rotation, rewriting and lines without end, each line once."""

import os

import pytest

from quarrylens.sources import logs


@pytest.fixture
def follow(spark, tmp_path):
    """Runs the stream over what is there and gives all lines so far; each run starts from the checkpoint."""

    def run(path=None, **options):
        stream = logs.log_lines(spark, str(path or tmp_path / "app.log"), **options)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        if not (tmp_path / "out").exists():
            return []
        return [r["line"] for r in spark.read.schema(logs.SCHEMA).parquet(str(tmp_path / "out")).collect()]

    return run


def append(path, text):
    with open(path, "ab") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def test_lines_are_read_once_through_restarts_and_rotation(tmp_path, follow):
    log = tmp_path / "app.log"
    append(log, "one\ntwo\nhal")
    assert sorted(follow()) == ["one", "two"]
    append(log, "f\n\nnext\n")
    assert sorted(follow()) == ["", "half", "next", "one", "two"]
    append(log, "before rotation\nrest")
    os.rename(log, tmp_path / "app.log.1")
    append(log, "after rotation\n")
    append(tmp_path / "other.txt", "not watched\n")
    want = ["", "after rotation", "before rotation", "half", "next", "one", "two"]
    assert sorted(follow()) == want
    assert sorted(follow()) == want
    append(tmp_path / "app.log.1", " and more\n")
    append(log, b"\xff\n")
    assert sorted(follow()) == sorted([*want, "rest and more", "�"])


def test_a_file_written_anew_is_read_from_its_start(tmp_path, follow):
    log = tmp_path / "app.log"
    append(log, "aaaa\nbbbb\n")
    follow()
    log.write_text("cc\n")
    assert sorted(follow()) == ["aaaa", "bbbb", "cc"]
    log.write_text("dddd\n" * 5)
    assert sorted(follow()) == ["aaaa", "bbbb", "cc", *["dddd"] * 5]


def test_start_behind_what_is_there(tmp_path, follow):
    log = tmp_path / "app.log"
    append(log, "old\n")
    assert follow(from_start=False) == []
    append(log, "new\n")
    assert follow(from_start=False) == ["new"]


def test_patterns_and_no_file(tmp_path, follow):
    assert follow(tmp_path / "*.log") == []
    append(tmp_path / "a.log", "a\n" * 10_000)
    append(tmp_path / "b.log", "b\n" * 3)
    assert sorted(follow(tmp_path / "*.log", batch_bytes=1 << 10))[-3:] == ["b"] * 3
    while len(follow(tmp_path / "*.log", batch_bytes=1 << 12)) < 10_003:
        pass
    assert len(follow(tmp_path / "*.log")) == 10_003


def test_lines_without_end_come_in_pieces(tmp_path, monkeypatch):
    """The pieces do not depend on where batches end."""
    monkeypatch.setattr(logs, "LINE_BYTES", 10)
    text = b"ab\n" + b"x" * 25 + b"\n" + b"y" * 20 + b"\n" + b"z" * 13
    path = str(tmp_path / "a.log")

    def lines(sizes):
        reader, out, at = logs.LogReader({"path": path}), [], {}
        for n in sizes:
            with open(path, "wb") as f:
                f.write(text[:n])
            now = reader.latestOffset()
            for part in reader.partitions(at, now):
                out += [x for b in reader.read(part) for x in b.column("line").to_pylist()]
            at = now
        return out

    whole = lines([len(text)])
    assert whole == ["ab", "x" * 10, "x" * 10, "x" * 5, "y" * 10, "y" * 10, "", "z" * 10]
    os.remove(path)
    assert lines([1, 2, 5, 14, 15, 28, 29, 30, 41, 49, 50, 55, len(text)]) == whole
