"""Frames of captures as rows of ``packets``: links, IPv4 and IPv6, TCP and UDP."""

from __future__ import annotations

import socket
import struct

import pyarrow as pa

SCHEMA = "path string, frame_no long, ts double, src_ip string, src_port int, dst_ip string, dst_port int, proto int, size int, tcp_flags int, tcp_seq long, payload binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Magic numbers by byte order and unit of time.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
IPV4, IPV6 = b"\x08\x00", b"\x86\xdd"
#: Links whose frames begin with an IP header, those with a protocol at some place and a header's size, and loopbacks.
BARE = (12, 14, 101, 228, 229)
COOKED = {113: (14, 16), 276: (0, 20)}
#: Extension headers with the unit of their length and what is added to it; fragments have 8 bytes.
EXTENSIONS = {0: (8, 1), 43: (8, 1), 60: (8, 1), 51: (4, 2), 44: (0, 8)}
ETHERNET, LOOPBACK = 1, {0: "<", 108: ">"}
FAMILIES = {2: 4, 24: 6, 28: 6, 30: 6}


def packet(link: int, frame: bytes) -> tuple | None:
    """(src, sport, dst, dport, proto, size, flags, seq, payload) of an IP packet, or None."""
    if link == ETHERNET:
        kind, at = frame[12:14], 14
        for _ in range(2):
            if kind in (b"\x81\x00", b"\x88\xa8") and len(frame) >= at + 4:
                kind, at = frame[at + 2 : at + 4], at + 4
        frame = frame[at:] if kind in (IPV4, IPV6) else b""
    elif link in COOKED:
        at, size = COOKED[link]
        frame = frame[size:] if frame[at : at + 2] in (IPV4, IPV6) else b""
    elif link in LOOPBACK:
        family = FAMILIES.get(struct.unpack_from(LOOPBACK[link] + "I", frame)[0]) if len(frame) >= 4 else None
        frame = frame[4:] if family and len(frame) > 4 and frame[4] >> 4 == family else b""
    elif link not in BARE:
        return None
    if len(frame) >= 20 and frame[0] >> 4 == 4:
        head, proto, total = 4 * (frame[0] & 15), frame[9], struct.unpack_from(">H", frame, 2)[0]
        src, dst, body = socket.inet_ntoa(frame[12:16]), socket.inet_ntoa(frame[16:20]), frame[head : max(head, total or len(frame))]
    elif len(frame) >= 40 and frame[0] >> 4 == 6:
        length = struct.unpack_from(">H", frame, 4)[0]
        proto, src, dst, body = frame[6], socket.inet_ntop(socket.AF_INET6, frame[8:24]), socket.inet_ntop(socket.AF_INET6, frame[24:40]), frame[40 : 40 + (length or len(frame))]
        for _ in range(8):
            if proto not in EXTENSIONS or len(body) < 8:
                break
            unit, more = EXTENSIONS[proto]
            proto, body = body[0], body[unit * (body[1] + more) if unit else more :]
    else:
        return None
    if proto == 6 and len(body) >= 20:
        sport, dport, seq = struct.unpack_from(">HHI", body)
        return src, sport, dst, dport, proto, len(load := body[4 * (body[12] >> 4) :]), body[13], seq, load
    if proto == 17 and len(body) >= 8:
        sport, dport = struct.unpack_from(">HH", body)
        return src, sport, dst, dport, proto, len(body) - 8, 0, 0, body[8:]
    return src, 0, dst, 0, proto, len(body), 0, 0, body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)
