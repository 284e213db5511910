"""Shared pieces of the corpus operators: tokenising and shingles.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text,
which is what ``bytes.split()`` yields; ``bytes.lower()`` maps A-Z only.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import labelled as components

__all__ = ["components", "crc_mod", "mix64", "prepare", "shingles", "texts", "word_hashes", "words"]

WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes handed to Python at once; a batch of whole texts has to fit beside the JVM (one row at least).
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep their batches small."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").split()


def texts(column: pa.Array) -> Iterator[str]:
    """The column's strings one by one, null as the empty string."""
    for x in column:
        yield x.as_py() or ""


# -- vectorised shingles

_SPACE = np.zeros(256, np.int8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_LOWER_BYTE = _BYTE[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(4096, np.uint64)
with np.errstate(over="ignore"):
    for _i in range(1, 4096):
        _POWERS[_i] = _POWERS[_i - 1] * np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (array arithmetic wraps silently)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes | np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word of one text, in order, without a Python loop."""
    b = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, memoryview, pa.Buffer)) else data
    if not len(b):
        return np.empty(0, np.uint64)
    # words begin and end where the kind of byte changes
    kind = np.empty(len(b) + 2, np.int8)
    kind[0] = kind[-1] = 1
    np.take(_SPACE, b, out=kind[1:-1])
    turns = np.flatnonzero(kind[1:] != kind[:-1])
    at, end = turns[::2], turns[1::2]
    if not len(at):
        return np.empty(0, np.uint64)
    size = end - at
    place = np.arange(len(b), dtype=np.int64)
    place -= np.repeat(at, np.diff(at, append=len(b))) if at[0] == 0 else np.concatenate([np.zeros(at[0], np.int64), np.repeat(at, np.diff(at, append=len(b)))])
    v = (_LOWER_BYTE if lower else _BYTE)[b]
    v *= _POWERS[place & 4095]
    if size.max() > 4096:
        v += (place >> 12).astype(np.uint64) * _STEP * (kind[1:-1] == 0)
    return mix64(np.add.reduceat(v, at) + size.astype(np.uint64) * _STEP)


def shingles(data: bytes, width: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``width`` words.

    A text of fewer words has one shingle, its whole sequence; without words, none.
    """
    w = word_hashes(data, lower)
    if not len(w):
        return w
    n = min(width, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h *= _STEP
        h += w[i : len(w) - n + 1 + i]
        h ^= h >> np.uint64(29)
    h = mix64(h)
    h.sort()
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]
