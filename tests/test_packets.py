"""Captures built here, read as packets and aggregated to flows."""

import random
import socket
import struct

import pytest

from quarrylens.operators import flows
from quarrylens.sources.captures import read_captures, write_captures
from quarrylens.sources.packets import packet


def tcp(src, dst, sport, dport, flags, payload=b""):
    body = struct.pack(">HHIIBBHHH", sport, dport, 1, 0, 5 << 4, flags, 0, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, 6, 0, socket.inet_aton(src), socket.inet_aton(dst))
    return b"\0" * 12 + b"\x08\x00" + ip + body


def test_capture_to_flow(spark, tmp_path):
    packets = [tcp("10.0.0.2", "10.0.0.1", 5000, 80, 2), tcp("10.0.0.1", "10.0.0.2", 80, 5000, 18), tcp("10.0.0.2", "10.0.0.1", 5000, 80, 16, b"GET /"), b"\0" * 30]
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, p in enumerate(packets):
        data += struct.pack("<IIII", 100 + i, 500_000, len(p), len(p)) + p
    (tmp_path / "a.pcap").write_bytes(data + b"\x01\x02")
    (tmp_path / "b.pcap").write_bytes(b"no capture")
    rows = read_captures(spark, str(tmp_path))
    assert rows.count() == 3
    f = flows.flows(rows).first()
    assert (f["a_ip"], f["b_port"], f["packets_a2b"], f["bytes_a2b"], f["saw_synack"], f["first_ts"]) == ("10.0.0.2", 80, 2, 5, True, 100.5)


def classic(packets, order="<", magic=0xA1B2C3D4, link=1):
    data = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    return data + b"".join(struct.pack(order + "IIII", 100 + i, i % 999, len(p), len(p)) + p for i, p in enumerate(packets))


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def section(order, links, packets):
    """A section with an interface for each (link, power of the unit of time); packets are dealt to them in turn."""
    data = block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    for link, power in links:
        data += block(order, 1, struct.pack(order + "HHI", link, 0, 0) + struct.pack(order + "HH", 2, 3) + b"abc\0" + struct.pack(order + "HHB3x", 9, 1, power) + struct.pack(order + "HH", 0, 0))
    for i, p in enumerate(packets):
        number = i % len(links)
        power = links[number][1]
        ticks = (100 + i) * (2 ** (power & 127) if power & 128 else 10**power)
        data += block(order, 6, struct.pack(order + "5I", number, ticks >> 32, ticks & 0xFFFFFFFF, len(p), len(p)) + p)
        if i % 7 == 0:
            data += block(order, 5, b"statistics")
    return data + block(order, 3, struct.pack(order + "I", len(packets[0])) + packets[0])


def rows(spark, path, step):
    return sorted((r["frame_no"], r["ts"], r["src_ip"], r["dst_port"], bytes(r["payload"])) for r in read_captures(spark, str(path), step).collect())


def some_packets(n, most):
    r = random.Random(n)
    return [tcp(f"10.0.{i % 9}.{i % 250}", "10.0.0.1", 5000, i % 60_000, 16, r.randbytes(r.randrange(most))) for i in range(n)]


@pytest.mark.parametrize("order, magic", [("<", 0xA1B2C3D4), (">", 0xA1B2C3D4), ("<", 0xA1B23C4D)])
def test_partitions_of_a_large_capture_give_each_record_once(spark, tmp_path, order, magic):
    packets = some_packets(12_000, 2900)
    path = tmp_path / "a.pcap"
    path.write_bytes(classic(packets, order, magic) + b"\x01")
    whole = rows(spark, path, 1 << 40)
    assert len(whole) == 12_000 and rows(spark, path, 1_500_007) == whole


def test_a_capture_within_packets_of_a_capture(spark, tmp_path):
    """Payloads that are records themselves and end where their packet ends do not mislead a partition."""
    inner = classic(some_packets(40, 60))[24:]
    packets = [tcp("10.0.0.2", "10.0.0.1", 1, i % 60_000, 16, inner) for i in range(1200)]
    path = tmp_path / "a.pcap"
    path.write_bytes(classic(packets))
    assert rows(spark, path, 300_001) == rows(spark, path, 1 << 40) and len(rows(spark, path, 300_001)) == 1200


def test_sections_interfaces_and_units_of_time(spark, tmp_path):
    packets = some_packets(3000, 900)
    bare = [p[14:] for p in packets]
    data = section("<", [(1, 6), (1, 9)], packets) + section(">", [(101, 0x80 | 10)], bare) + section("<", [(228, 3), (228, 6), (228, 0)], bare)
    path = tmp_path / "a.pcapng"
    path.write_bytes(data)
    whole = rows(spark, path, 1 << 40)
    assert len(whole) == 9003 and {round(ts, 6) for _, ts, *_ in whole} == {0.0} | {100.0 + i for i in range(3000)}
    assert rows(spark, path, 700_000) == whole


def test_links(spark):
    frame = tcp("10.0.0.2", "10.0.0.1", 5, 80, 2, b"x")
    ip = frame[14:]
    six = struct.pack(">IHBB", 6 << 28, len(ip) - 20 + 16, 0, 64) + socket.inet_pton(socket.AF_INET6, "::1") * 2 + bytes([44, 0]) + bytes(6) + bytes([6, 0]) + bytes(6) + ip[20:] + b"trailer"
    want = ("10.0.0.2", 5, "10.0.0.1", 80, 6, 1, 2, 1, b"x")
    told = {1: frame, 101: ip, 228: ip, 113: b"\0" * 14 + b"\x08\x00" + ip, 276: b"\x08\x00" + b"\0" * 18 + ip, 0: struct.pack("<I", 2) + ip, 108: struct.pack(">I", 2) + ip}
    assert all(packet(link, f) == want for link, f in told.items())
    assert packet(1, frame[:12] + b"\x88\xa8\0\1\x81\0\0\2" + frame[12:]) == want
    for link, f in ((229, six), (0, struct.pack("<I", 30) + six), (113, b"\0" * 14 + b"\x86\xdd" + six)):
        assert packet(link, f) == ("::1", 5, "::1", 80, 6, 1, 2, 1, b"x")
    assert packet(147, ip) is None and packet(113, b"") is None and packet(0, b"\2") is None


def test_written_captures_read_back(spark, tmp_path):
    packets = some_packets(500, 300)
    df = spark.createDataFrame([(1.5 + i, p) for i, p in enumerate(packets)], "ts double, frame binary").repartition(3)
    write_captures(df, str(tmp_path / "out"))
    back = read_captures(spark, "file://" + str(tmp_path / "out"))
    assert back.count() == 500 and back.agg({"ts": "sum"}).first()[0] == sum(1.5 + i for i in range(500))
    (tmp_path / "none").mkdir()
    assert read_captures(spark, str(tmp_path / "none")).count() == 0


def test_chains_that_never_meet_the_true_one(tmp_path):
    """Seconds and fractions that read as a fraction and a size four bytes earlier lead past the ends of records."""
    from quarrylens.sources import captures

    r = random.Random(8)
    out, places = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262_144, 1)], []
    at = 24
    while at < 6 << 20:
        frame = bytes(12) + b"\x08\0E\0\0" + bytes(r.randrange(20, 30))
        out.append(struct.pack("<4I", r.randrange(150_000), r.choice([125_000, 250_000]), len(frame), len(frame)) + frame)
        places.append(at)
        at += len(out[-1])
    (tmp_path / "x.pcap").write_bytes(b"".join(out))
    form = captures.Classic(captures.Window(captures.fs.LocalFileSystem(), str(tmp_path / "x.pcap")))
    for low in range(1 << 20, at - 100, 700_001):
        assert captures.first_record(form, low) == next(p for p in places if p >= low)


def test_partitions_begin_where_the_chains_from_the_start_lead(tmp_path, monkeypatch):
    """Headers that are read four bytes late follow each other to the end of a file; no partition reads what lies far before it."""
    from quarrylens.sources import captures

    path, step = tmp_path / "x.pcap", 1 << 20
    path.write_bytes(classic([bytes(12) + p[12:] for p in some_packets(60_000, 120)]))
    scan = captures.CaptureReader({"path": str(path), "partition_bytes": step, "rows": "layout"})
    leaves = [(r["place"], r["leaves"]) for part in scan.partitions() for batch in scan.read(part) for r in batch.to_pylist()]
    assert len(leaves) <= 4 * len(scan.partitions())
    starts = captures._starts(dict(leaves))
    calls, after = [], captures.Classic.after
    monkeypatch.setattr(captures.Classic, "after", lambda self, place: calls.append(place) or after(self, place))
    reader = captures.CaptureReader({"path": str(path), "partition_bytes": step, "starts": captures.json.dumps({str(path): starts})})
    rows = [sum(batch.num_rows for batch in reader.read(part)) for part in reader.partitions()]
    assert len(rows) > 5 and sum(rows) == len(calls) == 60_000 and min(calls) == 24
