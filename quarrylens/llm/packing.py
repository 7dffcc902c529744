"""Packing by power-of-two decomposition.

Every document is cut into pieces whose lengths are powers of two, at most the longest sequence length; each piece
is a sequence of its own, so that no sequence crosses documents and none needs padding. Equal lengths share a
bucket. Nothing is shuffled.

A text is split at white space and each unit is encoded by the tokenizer once in a while and remembered: the
tokenizer drops white space and never joins across it, so the ids are those of the whole text. Texts with the
separators U+001C to U+001F, which Python takes for white space and the tokenizer does not, are encoded whole.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed like any other;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
MEMORY_UNITS = 1_000_000
_ODD = re.compile("[\x1c-\x1f]")
#: Letters followed by ASCII punctuation other than the apostrophe, which the tokenizer always parts.
_TAIL = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


class UnitEncoder:
    """Ids of texts as packed little-endian unsigned 32-bit numbers, with a bounded memory of units."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of units of letters, each one word to the tokenizer, encoded in one go and parted at the words' ends."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        stops = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(stops) != len(words) or (stops and stops[-1] != len(ids)):
            return self._encode(words)
        return [ids[a:b].tobytes() for a, b in zip([0, *stops], stops, strict=False)]

    def _learn(self, units: list[str]) -> None:
        memory, words, others, joined = self.memory, set(), set(), []
        for unit in units:
            if unit.isalpha():
                words.add(unit)
            elif parts := _TAIL.fullmatch(unit):
                joined.append((unit, *parts.groups()))
                words.add(parts[1])
                others.add(parts[2])
            else:
                others.add(unit)
        for some, encode in ((words, self._encode_words), (others, self._encode)):
            some = list(some.difference(memory))
            for k in range(0, len(some), 4096):
                memory.update(zip(part := some[k : k + 4096], encode(part), strict=True))
        for unit, word, tail in joined:
            memory[unit] = memory[word] + memory[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memory) > MEMORY_UNITS:
            self.memory.clear()
        memory, out = self.memory, []
        for text in texts:
            if _ODD.search(text):
                out += self._encode([text])
                continue
            units = text.split()
            if new := set(units).difference(memory):
                self._learn(list(new))
            out.append(b"".join(map(memory.__getitem__, units)))
        return out


def binary_lengths(n: int, longest: int) -> list[int]:
    """Powers of two, largest first, that sum to n; none is over ``longest``, itself a power of two."""
    lengths = [longest] * (n // longest)
    rest = n % longest
    while rest:
        lengths.append(1 << (rest.bit_length() - 1))
        rest -= lengths[-1]
    return lengths


_ENCODERS: dict[str, UnitEncoder] = {}


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, longest: int = 4096, keep_ids: bool = False) -> DataFrame:
    """One row a piece of ``docs(doc_id, text)``. ``keep_ids`` adds the ids as an array, for writing sequences."""
    if longest & (longest - 1):
        raise ValueError("the longest sequence length must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, UnitEncoder(tokenizer_path))
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                ids = part.column("doc_id").to_pylist()
                cols: list[list] = [[] for _ in range(6)]
                raw = []
                for doc, packed in zip(ids, encoder.encode([x or "" for x in part.column("text").to_pylist()]), strict=True):
                    packed += end
                    n, start = len(packed) // 4, 0
                    for length in binary_lengths(n, longest):
                        piece = packed[4 * start : 4 * (start + length)]
                        for col, x in zip(cols, (doc, start, length, zlib.crc32(piece), n, sequence), strict=True):
                            col.append(x)
                        raw.append(piece)
                        start += length
                        sequence += 1
                arrays = [pa.array(x, pa.int64()) for x in cols] + [pa.array(np.zeros(len(raw), np.int64)), pa.array(cols[2], pa.int32())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
                if keep_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in raw], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, SCHEMA + (", ids array<int>" if keep_ids else ""))


def write_buckets(docs: DataFrame, tokenizer_path: str, out: str, **options) -> None:
    """Write the sequences with their ids, one folder a length, as a variable-length training job reads them."""
    pack(docs, tokenizer_path, keep_ids=True, **options).write.partitionBy("bucket").parquet(out)
