"""Byte-level BPE on a sentencepiece model that is serialised from the vocabulary itself.

Each of the 256 bytes is mapped to a printable character; a vocabulary entry becomes a piece of
such characters, scored by its negative rank, so the merge of the best score is the
merge of the lowest rank. The normaliser is the identity: no prefix, no escaping, no charsmap. No
model is trained: the protocol buffer is written field by field.

Each pre-token is encoded on its own, by the model and a bounded cache; ids are ranks; decoding maps
ids back to the entries' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, texts

_CACHE = 250_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


_MAP = {b: c for b, c in enumerate(byte_alphabet())}


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_MAP)


def read_ranks(path: str) -> dict[bytes, int]:
    """The lines of a rank file: base64 of the bytes, and the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(no: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(no << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(no << 3 | 5) + struct.pack("<f", value)
    return _varint(no << 3) + _varint(value)


def serialised(ranks: dict[bytes, int]) -> bytes:
    """The model's protocol buffer. Piece i is the entry of rank i; the unknown piece comes last.

    Ranks have to be 0..n-1, and all 256 single bytes present.
    """
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in ordered] != list(range(len(ordered))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0..n-1 and hold every byte")
    out = [_field(1, _field(1, mapped(x).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, x in enumerate(ordered)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(ordered) + 1) + _field(40, len(ordered)) + b"".join(_field(no, (1 << 64) - 1) for no in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


#: For text of code points below 256, ``re`` with the pattern's classes spelled out finds the same pre-tokens sooner.
_LETTER, _DIGIT, _BLANK = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"


def _narrow(pattern: str) -> re.Pattern | None:
    """The pattern for Latin-1 text, where its classes are known."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_BLANK}{_LETTER}{_DIGIT}]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_DIGIT}]").replace(r"\s", f"[{_BLANK}]").replace(r"\S", f"[^{_BLANK}]")
    return None if "\\" in out.replace("\\t", "") else re.compile(out)


class Codec:
    """Encodes and decodes with the ranks of one file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(ranks))
        self.bytes = sorted(ranks, key=ranks.__getitem__)
        self.wide = regex.compile(pattern).findall
        narrow = _narrow(pattern)
        self.narrow = narrow.findall if narrow else self.wide
        #: pre-token -> (ids, their decimals joined by a space, the bytes that they decode to)
        self.cache: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)

    def learn(self, tokens: set[str]) -> None:
        """Encode pre-tokens that the cache lacks, and decode their ids."""
        new = [t for t in tokens if t not in self.cache]
        if len(self.cache) + len(new) > _CACHE:
            self.cache.clear()
            new = list(tokens)
        if new:
            for t, ids in zip(new, self.model.encode([mapped(t.encode("utf-8", "replace")) for t in new], num_threads=1)):
                self.cache[t] = (tuple(ids), " ".join(map(str, ids)), self.decode(ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def pieces(self, texts: list[str]) -> Iterator[list[tuple[tuple[int, ...], str, bytes]]]:
        """For each text the encodings of its pre-tokens."""
        split = [self.split(x) for x in texts]
        self.learn(set(chain.from_iterable(split)))
        for tokens in split:
            yield list(map(self.cache.__getitem__, tokens))

    def encode(self, text: str) -> list[int]:
        (found,) = self.pieces([text])
        return list(chain.from_iterable(p[0] for p in found))


def _slices(texts: Iterable[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters at most (one text at least)."""
    now, n = [], 0
    for x in texts:
        if now and n + len(x) > most:
            yield now
            now, n = [], 0
        now.append(x)
        n += len(x)
    if now:
        yield now


def coded(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row, and with ``with_ids`` the ids.

    Null text is as the empty one: no tokens. Whole texts; equal texts give equal rows. The file
    at ``vocabulary`` is read on the driver and broadcast (its size doesn't follow the data).
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for part in parts:
            n, one, two, lists = [], [], [], []
            for some in _slices(texts(part.column(1))):
                for found in codec.pieces(some):
                    n.append(sum(len(p[0]) for p in found))
                    one.append(hashlib.sha256(" ".join([p[1] for p in found]).encode()).hexdigest())
                    two.append(hashlib.sha256(b"".join([p[2] for p in found])).hexdigest())
                    if with_ids:
                        lists.append(list(chain.from_iterable(p[0] for p in found)))
            cols = [part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(lists, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
