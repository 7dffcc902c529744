"""Stream assembly against a byte map, with wraps, gaps, repeats and hot directions cut into parts."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import streams

SCHEMA = "file string, frame_no long, src_ip string, src_port int, dst_ip string, dst_port int, proto int, tcp_flags int, tcp_seq long, payload binary, head string"
FLOW = ("f", "10.0.0.1", 4000, "10.0.0.2", 80)


def packet(frame, seq, payload, flags=16, flow=FLOW, proto=6):
    f, src, sport, dst, dport = flow
    return (f, frame, src, sport, dst, dport, proto, flags, None if seq is None else seq % (1 << 32), payload, "x")


def brute(packets, most):
    """{(flow, connection): (head, islands)} by one dictionary a connection."""
    out, now, seen = {}, {}, {}
    for f, frame, src, sport, dst, dport, proto, flags, seq, payload, _ in sorted(packets, key=lambda p: (p[0], p[1])):
        if proto != 6 or seq is None:
            continue
        flow = (f, src, sport, dst, dport)
        payload = payload or b""
        opens = flags & 2 and not payload
        seq = (seq + 1) if opens else seq
        last, at, number = now.get(flow, (None, 0, 0))
        if last is not None:
            at += (seq - last + (1 << 31)) % (1 << 32) - (1 << 31)
        number += bool(opens)
        now[flow] = (seq, at, number)
        if opens:
            seen[flow, number] = [at, {}]
        held = seen.setdefault((flow, number), [None, {}])[1]
        for k, b in enumerate(payload):
            held.setdefault(at + k, b)
    for key, (base, held) in seen.items():
        base = base if base is not None else min(held, default=0)
        spots = sorted(k - base for k in held if k >= base)
        head = bytearray()
        while len(head) < most and len(head) + base in held:
            head.append(held[len(head) + base])
        runs = []
        for k in spots:
            if runs and runs[-1][1] == k:
                runs[-1][1] = k + 1
            else:
                runs.append([k, k + 1])
        out[key] = (bytes(head), [tuple(r) for r in runs])
    return out


def assembled(spark, packets, part=None, most=streams.HEAD_BYTES, part_bytes=streams.PART_BYTES):
    df = spark.createDataFrame(packets, SCHEMA).repartition(3)
    placed = streams.positions(df, part).persist()
    heads = {(tuple(r[c] for c in streams.FLOW), r["connection"]): bytes(r["head"]) for r in streams.heads(placed, most).collect()}
    runs = {}
    for r in streams.islands(placed, part_bytes).collect():
        runs.setdefault((tuple(r[c] for c in streams.FLOW), r["connection"]), []).append((r["begin"], r["end"]))
    placed.unpersist()
    return heads, {k: sorted(v) for k, v in runs.items()}


def random_packets(seed):
    r = random.Random(seed)
    out = []
    for n in range(6):
        flow = ("f" if n % 2 else "g", f"10.0.0.{n // 2}", 4000 + n, "10.0.0.9", 80)
        isn, frame = r.choice((0, 5, (1 << 32) - 40, (1 << 31) - 3)), n * 1000
        for _ in range(r.randrange(1, 3)):
            if r.random() < 0.6:
                out.append(packet(frame := frame + 1, isn - 1, r.choice((b"", None)), 2, flow))
            for _ in range(r.randrange(0, 14)):
                at = r.randrange(-3, 90)
                out.append(packet(frame := frame + r.randrange(1, 4), isn + at, bytes(r.randrange(65, 91) for _ in range(r.randrange(0, 25))), 16, flow))
            isn += r.randrange(1000)
    out += [packet(5000, None, b"x"), packet(5001, 1, b"x", proto=17), packet(5002, 9, None)]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_assembly_matches_a_byte_map(spark, monkeypatch, seed):
    monkeypatch.setattr(streams, "BLOCK_BYTES", 7)
    packets = [p for s in range(8) for p in [(f"{p[0]}{s}", *p[1:]) for p in random_packets(8 * seed + s)]]
    want = brute(packets, 50)
    for part in (None, F.floor(F.col("frame_no") / 5)):
        heads, runs = assembled(spark, packets, part, 50, 16)
        assert heads == {k: h for k, (h, _) in want.items() if h}
        assert runs == {k: r for k, (_, r) in want.items() if r}


def test_positions_grow_past_several_wraps(spark):
    """10 GB of one direction in steps of a gigabyte; parts of a frame each."""
    packets = [packet(n, 7 + n * (1 << 30), b"ab") for n in range(10)]
    for part in (None, F.col("frame_no")):
        placed = streams.positions(spark.createDataFrame(packets, SCHEMA), part)
        assert sorted(r["begin"] for r in placed.collect()) == [n << 30 for n in range(10)]


def test_a_hot_range_that_is_sent_again_and_again(spark):
    packets = [packet(n, 100 + n % 40, bytes([65 + n % 40, 66 + n % 40]), 16) for n in range(20_000)]
    heads, runs = assembled(spark, packets, F.floor(F.col("frame_no") / 1000))
    assert list(runs.values()) == [[(0, 41)]] and list(heads.values()) == [bytes(range(65, 106))]


def test_messages(spark):
    first = packet(1, 1, b"GET /a b HTTP/1.1\r\nHost: one\r\nhost:  two \r\nUser-Agent:curl/8\r\nnone\r\nAuthorization: BASIC eA==\r\n\r\nbody")
    other = packet(2, 1, b"HTTP/1.1 404 Not Found\nServer: s\nContent-Length: x\nContent-Type: t/h\n\n", flow=("f", "b", 1, "c", 2))
    open_end = packet(3, 1, b"GET / HTTP/1.1\r\nHost: h\r\n", flow=("f", "d", 1, "c", 2))
    odd = packet(4, 1, b"BREW / x\r\n\r\n", flow=("f", "e", 1, "c", 2))
    heads = streams.heads(streams.positions(spark.createDataFrame([first, other, open_end, odd], SCHEMA)))
    r = streams.http_requests(heads).collect()
    assert [(x["method"], x["uri"], x["host"], x["user_agent"], x["basic_auth"]) for x in r] == [("GET", "/a", "two", "curl/8", True)]
    r = streams.http_responses(heads).collect()
    assert [(x["status"], x["reason"], x["server"], x["content_type"], x["content_length"]) for x in r] == [(404, "Not Found", "s", "t/h", 0)]


def test_empty_table(spark):
    placed = streams.positions(spark.createDataFrame([], SCHEMA), F.col("frame_no"))
    assert streams.heads(placed).count() == streams.islands(placed).count() == 0


def test_packets_are_read_twice(spark, capsys):
    """Once for what parts hand on, and once for the bytes, however many steps follow."""
    rows = [("f", 1, "a", 1, "b", 2, 6, 16, 10, b"xy"), ("f", 70, "a", 1, "b", 2, 6, 16, 12, b"z")]
    df = spark.createDataFrame(rows, "file string, frame_no long, src_ip string, src_port int, dst_ip string, dst_port int, proto int, tcp_flags int, tcp_seq long, payload binary")
    from pyspark.sql import functions as F

    found = streams.islands(streams.positions(df, part=F.floor(F.col("frame_no") / 64)), part_bytes=1)
    assert [tuple(r) for r in found.select("begin", "end", "segments").collect()] == [(0, 3, 2)]
    capsys.readouterr()
    found.explain()
    assert capsys.readouterr().out.count("Scan ExistingRDD") <= 2
