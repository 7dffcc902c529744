"""Byte patterns against plain searches across chunk borders."""

import random

from quarrylens.operators import markers


def places(content, pattern):
    return [i for i in range(len(content)) if content.startswith(pattern, i)]


def test_all_places_across_borders(spark):
    r = random.Random(5)
    patterns = [("a", b"\0\0"), ("b", b"\0\0\0\1"), ("same", b"\0\0"), ("c", b"\xff"), ("d", b"abcabcabd")]
    contents = [bytes(r.choice(b"\0\0\0\1\xffabcd") for _ in range(n)) + b"abcabcabcabd" for n in (0, 1, 30, 700)] + [b"", None]
    df = spark.createDataFrame([(str(i), c, 0) for i, c in enumerate(contents)], "path string, content binary, place int")
    for size in (1, 7, 1 << 20):
        got = sorted(tuple(x)[:3] for x in markers.find_all(df, patterns, size).collect())
        assert got == sorted((str(i), n, at) for i, c in enumerate(contents) for n, p in patterns for at in places(c or b"", p))
    assert markers.findings(df.limit(0)).count() == 0


def test_images_need_their_header_and_markers_their_key(spark):
    image = b"MZ" + bytes(58) + (64).to_bytes(4, "little") + b"PE\0\0"
    far = b"MZ" + bytes(58) + (2_000_000).to_bytes(4, "little") + bytes(1_999_936) + b"PE\0\0"
    marker = bytes.fromhex(markers.BEACON)
    rows = [("own", image), ("second", b"x" + image + image), ("none", b"x" + image[:-1]), ("far", b"x" + far), ("late", bytes(markers.FRONT_BYTES - 7) + markers.keyed(marker, 0x69)), ("keyed", markers.keyed(marker, 0x2E) + markers.keyed(marker, 0x69)), ("plain", markers.keyed(marker, 0x69) + marker)]
    got = {(r["path"], r["rule"], tuple(r["evidence"])) for r in markers.findings(spark.createDataFrame(rows, "path string, content binary"), 1 << 16).collect()}
    assert got == {("second", "embedded.pe", ("0x1", "0x45")), ("keyed", "c2.cobalt_strike_xor_marker", ("0x8",)), ("plain", "c2.cobalt_strike_beacon_marker", ("0x8",))}


def test_contents_are_cut_and_searched_once(spark):
    """No chunk's row holds its whole content, and no rule searches the contents again."""
    df = spark.createDataFrame([("a", bytes(500) + b"MZ")], "path string, content binary")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan(markers.findings(df, 64))
    cut = markers.chunks(df, 8, 64)
    assert "transform(sequence" in plan(cut)
    assert [(r["begin"], r["own"], len(r["content"])) for r in cut.collect()] == [(i, min(64, 502 - i), min(72, 502 - i)) for i in range(0, 502, 64)]


def test_whole_contents_are_used(spark):
    """Places at the end of a content count and are named like those at its beginning."""
    marker, late = bytes.fromhex(markers.BEACON), markers.FRONT_BYTES
    many = b"x" + b"\x7fELF" * 30 + b"PK\3\4" * 20 + b"\x1f\x8b\x08" * 20
    df = spark.createDataFrame([("late", bytes(late) + marker + bytes.fromhex("FC4883E4F0E8")), ("many", many)], "path string, content binary")
    got = {(r["path"], r["rule"]): list(r["evidence"]) for r in markers.findings(df, whole=True).collect()}
    assert got == {
        ("late", "c2.cobalt_strike_beacon_marker"): [hex(late)], ("late", "shellcode.msfvenom_x64"): [hex(late + 8)], ("many", "embedded.elf"): [hex(1 + 4 * i) for i in range(30)],
        ("many", "embedded.archive"): [f"ZIP@{hex(121 + 4 * i)}" for i in range(20)] + [f"gzip@{hex(201 + 3 * i)}" for i in range(20)],
    }
