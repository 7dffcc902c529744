"""Positions of many byte patterns in long contents, and what they say: embedded payloads, shellcode, beacon markers.

Contents are cut into overlapping chunks, so that one long content is many rows; a hit counts in the chunk in which it
begins. One Aho-Corasick automaton, compiled once a worker, finds all patterns in one pass over a chunk. Patterns under a
one-byte key are searched by their transformed bytes; contents are never decoded.

Defined results: null contents have no hits; overlapping hits are all reported; repeated paths are one content each time;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.indicators import let
from quarrylens.storage import fresh_path

CHUNK_BYTES, BATCH_ROWS = 1 << 20, 10_000
# Patterns, keys and bounds.
MZ, PE = "MZ", "PE"
EXECUTABLES = {"embedded.elf": ("7F454C46",), "embedded.macho": ("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE")}
ARCHIVES = {"ZIP": "504B0304", "7z": "377ABCAF271C", "RAR": "526172211A07", "gzip": "1F8B08"}
SHELLCODE = (
    ("shellcode.msfvenom_x64", "FC4883E4F0E8", "shellcode", 70),
    ("shellcode.msfvenom_x86_hash", "FCE882000000", "shellcode", 70),
    ("shellcode.metasploit_egghunter", "6681CAFF0F42526A", "shellcode", 70),
    ("shellcode.donut_loader", "E80000000059" + "4989C8", "shellcode", 70),
    ("shellcode.go_buildid_marker", "FF20476F206275696C642049443A2022", "compiler", 10),
    ("shellcode.upx_signature", b"$Info: This file is packed with the UPX".hex(), "packer", 30),
)
BEACON, BEACON_KEYS = "0001000100020004", (0x69, 0x2E)
FRONT_BYTES, POINTER_BYTES, POINTER_MOST = 16 << 20, 0x3C, 0x100000
SHOWN, SHOWN_ARCHIVES = 8, 4


def keyed(pattern: bytes, key: int) -> bytes:
    return bytes(b ^ key for b in pattern)


def chunks(files: DataFrame, overlap: int, size: int = CHUNK_BYTES) -> DataFrame:
    """(path, begin, own, content): chunks of ``files(path, content)`` of ``size`` own bytes and ``overlap`` further ones."""
    def cut(content: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(content) - 1, F.lit(0)), F.lit(size))
        own = lambda begin: F.least(F.length(content) - begin, F.lit(size))
        return F.transform(starts, lambda b: F.struct(b.cast("long").alias("begin"), own(b).alias("own"), F.substring(content, b + 1, F.lit(size + overlap)).alias("content")))

    # Cut before they become rows: a row of each chunk with its whole content would be quadratic. ``let`` computes a content once.
    return files.where(F.length("content") > 0).select("path", F.explode(let(F.col("content"), cut)).alias("x")).select("path", "x.*")


_AUTOMATA: dict[tuple, object] = {}


def _automaton(patterns: tuple[tuple[str, bytes], ...]):
    if patterns not in _AUTOMATA:
        import ahocorasick

        by_bytes: dict[bytes, list[str]] = {}
        for name, pattern in patterns:
            by_bytes.setdefault(pattern, []).append(name)
        automaton = ahocorasick.Automaton()
        for pattern, names in by_bytes.items():
            automaton.add_word(pattern.decode("latin-1"), (len(pattern), names))
        automaton.make_automaton()
        _AUTOMATA[patterns] = automaton
    return _AUTOMATA[patterns]


def find_all(files: DataFrame, patterns: list[tuple[str, bytes]], size: int = CHUNK_BYTES) -> DataFrame:
    """(path, name, place long, pointer long) of every occurrence.

    ``pointer`` is where the number 0x3C bytes behind an MZ points to, null for other patterns.
    """
    fixed = tuple(patterns)
    overlap = max(POINTER_BYTES + 4, *[len(p) for _, p in fixed]) - 1
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("place", pa.int64()), ("pointer", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(fixed)
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            rows: list[tuple] = []
            for path, begin, own, content in zip(*[batch.column(c).to_pylist() for c in ("path", "begin", "own", "content")], strict=True):
                for end, (length, names) in automaton.iter(content.decode("latin-1")):
                    at = end + 1 - length
                    if at >= own:
                        continue
                    for name in names:
                        raw = content[at + POINTER_BYTES : at + POINTER_BYTES + 4] if name == MZ else b""
                        rows.append((path, name, begin + at, begin + at + int.from_bytes(raw, "little") if len(raw) == 4 else None))
                    if len(rows) >= BATCH_ROWS:
                        yield told(rows)
                        rows = []
            if rows:
                yield told(rows)

    return chunks(files, overlap, size).mapInArrow(run, "path string, name string, place long, pointer long")


def _hex(place: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(place)))


def _first(rows: DataFrame, keys: list[str], most: int | None, shown: Column) -> DataFrame:
    """(keys, evidence): the first places in order, or all. Spark drops later ranks before the shuffle, so ``most`` bounds lists."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    few = rows.select(*keys, "place", shown.alias("shown"))
    few = few if most is None else few.withColumn("n", rank).where(F.col("n") <= most)
    listed = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "shown"))).alias("x"))
    return listed.select(*keys, F.transform("x", lambda x: x["shown"]).alias("evidence"))


def scan_patterns() -> list[tuple[str, bytes]]:
    """All patterns of ``findings`` by name."""
    out = [(MZ, b"MZ"), (PE, b"PE\0\0")]
    out += [(rule, bytes.fromhex(p)) for rule, ps in EXECUTABLES.items() for p in ps]
    out += [(f"archive {label}", bytes.fromhex(p)) for label, p in ARCHIVES.items()]
    out += [(rule, bytes.fromhex(p)) for rule, p, _, _ in SHELLCODE]
    marker = bytes.fromhex(BEACON)
    return [*out, ("beacon", marker), *[(f"beacon {k:#04x}", keyed(marker, k)) for k in BEACON_KEYS]]


def findings(files: DataFrame, size: int = CHUNK_BYTES, whole: bool = False) -> DataFrame:
    """(path, rule, severity, category, evidence) of ``files(path, content)``; the carrier's own header at 0 does not count.

    Hits are stored, as every rule reads them: contents are searched once. With ``whole``, markers count wherever they lie, not
    only within the first FRONT_BYTES, and evidence names every place of an embedded payload, not only the first ones.
    """
    sizes = {name: len(p) for name, p in scan_patterns()}
    spark, stored = files.sparkSession, fresh_path(files.sparkSession, "hits")
    hits = find_all(files, scan_patterns(), size)
    hits.write.parquet(stored)
    hits = spark.read.schema(hits.schema).parquet(stored)
    inner = hits.where("place > 0")
    images = inner.where(F.col("name") == MZ).select("path", "place", "pointer").where((F.col("pointer") - F.col("place")).between(1, POINTER_MOST - 1))
    heads = hits.where(F.col("name") == PE).select("path", F.col("place").alias("pointer")).distinct()
    pe = images.join(heads.hint("merge"), ["path", "pointer"]).select("path", F.lit("embedded.pe").alias("rule"), "place", "pointer")
    programs = inner.where(F.col("name").isin(*EXECUTABLES)).select("path", F.col("name").alias("rule"), "place", "pointer")
    told = lambda df, severity, category: df.select("path", "rule", F.lit(severity).alias("severity"), F.lit(category).alias("category"), "evidence")
    out = told(_first(pe.unionByName(programs), ["path", "rule"], None if whole else SHOWN, _hex(F.col("place"))), 70, "dropper")

    packed = hits.where(F.col("name").startswith("archive ")).withColumn("label", F.substring("name", 9, 8))
    few = packed if whole else packed.withColumn("n", F.row_number().over(Window.partitionBy("path", "label").orderBy("place"))).where(F.col("n") <= SHOWN_ARCHIVES)
    order = F.array_position(F.array(*[F.lit(x) for x in ARCHIVES]), F.col("label"))
    listed = few.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "place", "label"))).alias("x"))
    shown = F.transform("x" if whole else F.slice("x", 1, SHOWN), lambda x: F.concat(x["label"], F.lit("@"), _hex(x["place"])))
    out = out.unionByName(told(listed.select("path", F.lit("embedded.archive").alias("rule"), shown.alias("evidence")), 50, "dropper"))

    # Unless whole contents are asked for, only what lies whole within the first bytes counts for these.
    length = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("name"))
    front = hits.where(F.col("name").isin(*[r for r, *_ in SHELLCODE]) | F.col("name").startswith("beacon")).where(F.lit(whole) | (F.col("place") + length <= FRONT_BYTES))
    first = front.groupBy("path", "name").agg(F.min("place").alias("place"))
    kinds = F.create_map(*[x for rule, _, category, severity in SHELLCODE for x in (F.lit(rule), F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category")))])
    code = first.where(F.col("name").isin(*[r for r, *_ in SHELLCODE])).withColumn("kind", F.element_at(kinds, F.col("name")))
    out = out.unionByName(code.select("path", F.col("name").alias("rule"), "kind.severity", "kind.category", F.array(_hex(F.col("place"))).alias("evidence")))
    # The plain marker goes before the keyed ones, and these in the order of the keys.
    names = ["beacon", *[f"beacon {k:#04x}" for k in BEACON_KEYS]]
    turn = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("name"))
    beacon = first.where(F.col("name").isin(*names)).groupBy("path").agg(F.min_by(F.struct("name", "place"), turn).alias("x"))
    rule = F.when(F.col("x.name") == "beacon", "c2.cobalt_strike_beacon_marker").otherwise("c2.cobalt_strike_xor_marker")
    return out.unionByName(told(beacon.select("path", rule.alias("rule"), F.array(_hex(F.col("x.place"))).alias("evidence")), 90, "c2"))
