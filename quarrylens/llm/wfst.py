"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model is compiled once, to

* the normaliser, which turns spaces into U+2581 and adds one in front (models with a character map are refused);
* the piece machine: a trie whose arcs read characters and whose final states write a piece's id, at the weight of its
  negative score; characters without a piece have an arc to their bytes' ids (or to the unknown id), at the weight that
  the library gives to unknown characters;
* for BPE models the pair acceptor. Its states are pieces; ``a`` may be followed by ``b`` only if no merge across
  their boundary comes before the merges that make a and b, which is read off the two pieces' merge trees. What the
  merges yield is the one sequence of pieces whose neighbours are all accepted. Unigram models have no acceptor.

An input is composed with these machines while its lattice is built from left to right: a state is a position and the
last piece. Each keeps the least weight by which it is reached, and the shortest path in the tropical semiring (sums
along a path, minima over paths) is read off backwards. For BPE each prefix has just one accepted last piece.

No piece holds U+2581 behind another character, so an input falls into units at its spaces, and these into parts
between characters that no piece joins; a part is composed once in a while and remembered.

Decoding runs the piece machine backwards, bytes together, and drops the first space.

Defined results: a null or empty text has no ids and decodes to an empty text; invalid bytes become U+FFFD; of paths of
equal weight the one whose last pieces are longest is taken; repeated rows give repeated results; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
FINAL = ""
MEMORY_UNITS, MEMORY_PAIRS = 800_000, 1_000_000
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Transducer:
    """The compiled machines of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models that map characters or drop spaces are not supported")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.is_bpe = model.trainer_spec.model_type == 2
        processor = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.unknown = processor.unk_id()
        self.piece: dict[str, tuple[int, float]] = {}
        self.byte: dict[int, int] = {}
        self.written: list[bytes] = []
        for i, p in enumerate(model.pieces):
            self.written.append(b"")
            if p.type == 6:  # byte
                self.byte[int(p.piece[3:5], 16)] = i
                self.written[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 1:  # normal
                self.piece[p.piece] = (i, -p.score)
                self.written[i] = p.piece.replace(SPACE, " ").encode()
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError("a piece joins words")
            elif p.type == 2:
                self.written[i] = " ⁇ ".encode()
            elif p.type == 4:
                raise ValueError("user-defined pieces are not supported")
        self.unknown_weight = max((w for _, w in self.piece.values()), default=0.0) + 10.0
        #: Pairs of characters that some piece joins: between all others every path has a boundary.
        self.joined = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        self.split = {p: parts for p in self.piece if (parts := self._last_merge(p))} if self.is_bpe else {}
        self.root: dict = {}
        for text, (_, weight) in self.piece.items():
            if self.is_bpe and len(text) > 1 and text not in self.split:
                continue  # no merges yield it
            state = self.root
            for c in text:
                state = state.setdefault(c, {})
            state[FINAL] = (text, weight)
        self.units: dict[str, bytes] = {}
        self.follows: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0

    def _last_merge(self, text: str) -> tuple[str, str] | None:
        """The two parts whose merge makes a piece: neighbours merge by score, the best first and the left one of equals."""
        parts, last = list(text), None
        while len(parts) > 1:
            offers = [(self.piece[x + y][1], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.piece]
            if not offers:
                return None
            i = min(offers)[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = ["".join(last)]
        return last

    def accepts(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a: undo their merges, the latest first, and look for a merge across that came before."""
        pieces, split, limit = self.piece, self.split, float("inf")
        while True:
            across = pieces.get(a + b)
            if across and across[1] < limit:
                return False
            made_a = pieces[a][1] if a in split else -1.0
            made_b = pieces[b][1] if b in split else -1.0
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                limit, a = made_a, split[a][1]
            else:  # a merge across is left of those within b, so it also wins ties
                limit, b = math.nextafter(made_b, math.inf), split[b][0]

    def shortest_path(self, text: str) -> list[str]:
        """The pieces (or single characters without piece) along the shortest path of the text composed with the machines."""
        n, far, root, is_bpe = len(text), float("inf"), self.root, self.is_bpe
        weight, last = [0.0] + [far] * n, [""] * (n + 1)
        for start in range(n):
            so_far, before = weight[start], last[start]
            if so_far == far:
                continue
            follows = self.follows.get(before)
            if follows is None:
                follows = self.follows[before] = {}
            state = root
            for end in range(start, n):
                state = state.get(text[end])
                if state is None:
                    break
                arc = state.get(FINAL)
                if arc is None:
                    continue
                piece, cost = arc
                if so_far + cost < weight[end + 1]:
                    if is_bpe and before:
                        fits = follows.get(piece)
                        if fits is None:
                            fits = follows[piece] = self.accepts(before, piece)
                            self.n_pairs += 1
                        if not fits:
                            continue
                    weight[end + 1], last[end + 1] = so_far + cost, piece
            if (state is None and end == start) or FINAL not in root[text[start]]:
                cost = so_far + self.unknown_weight
                if cost < weight[start + 1]:
                    weight[start + 1], last[start + 1] = cost, text[start]
        if self.n_pairs > MEMORY_PAIRS:
            self.follows, self.n_pairs = {}, 0
        out, end = [], n
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _ids(self, unit: str) -> bytes:
        out: list[int] = []
        for text in self.shortest_path(unit):
            arc = self.piece.get(text)
            if arc:
                out.append(arc[0])
            elif self.byte:
                out += [self.byte[b] for b in text.encode()]
            else:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def _parts(self, unit: str) -> list[str]:
        joined, low, out = self.joined, 0, []
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in joined:
                out.append(unit[low:i])
                low = i
        out.append(unit[low:])
        return out

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        units, memory = _UNIT.findall(text), self.units
        if len(memory) > MEMORY_UNITS:
            memory.clear()
        for unit in set(units).difference(memory):
            parts = self._parts(unit)
            for part in parts:
                if part not in memory:
                    memory[part] = self._ids(part)
            if len(parts) > 1:
                memory[unit] = b"".join([memory[p] for p in parts])
        out = b"".join(map(memory.__getitem__, units))
        if not self.byte:  # a run of unknown characters is one unknown piece
            ids = np.frombuffer(out, "<u4")
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            out = ids[~again].tobytes()
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.written.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    return _MACHINES.get(path) or _MACHINES.setdefault(path, Transducer(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id long, ids array<int>) for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                ids = [np.frombuffer(m.encode(x or ""), "<u4").astype(np.int32) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id long, text string) for every row of ``encoded(doc_id, ids array<int>)``; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in batches:
            texts = [m.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids long, ids_crc32 long, decoded_crc32 long, same boolean) of whole texts, encoded and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                rows: list[list] = [[], [], [], []]
                for text in part.column("text").to_pylist():
                    ids = m.encode(text or "")
                    back = m.decode(ids)
                    for col, x in zip(rows, (len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode()), back == (text or "")), strict=True):
                        col.append(x)
                arrays = [part.column("doc_id"), *[pa.array(x, pa.int64()) for x in rows[:3]], pa.array(rows[3], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "same"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, same boolean")
