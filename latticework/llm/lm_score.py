"""Compression cross-entropy: how much better an in-domain dictionary fits a text than a general one.

score = (bytes under the general dictionary - bytes under the in-domain one) / bytes of the text,
both by zstandard; higher means closer to the domain. The dictionaries are raw content chosen in
the manner of FASTCOVER over the whole corpus: (1) every 8-byte window of every document is counted
in a hashed table per domain, tables are summed by bucket in a shuffle; (2) every 64-byte segment at
half-overlapping starts, a text's last 64 bytes and the whole of a shorter text
are scored by their windows' counts, the best segment of each slot is kept
(a combinable maximum); (3) the driver takes segments from those greedily,
discounting windows already covered. The counts, slots and dictionaries grow with the square root of the
corpus' bytes (``sizes``). Two tables of counts, a segment for each slot and the dictionaries
reach the driver and are broadcast. The general side
counts every document, the in-domain side every one whose id the domain has.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import prepare
from .minhash import FILTER_BITS

#: Table, slots and dictionary for a small corpus; ``sizes`` has them for others.
TABLE_BITS, SEGMENT, SLOTS, DICT_BYTES, LEVEL = 18, 64, 4096, 112_640, 3
#: Bytes of corpus from which the sizes grow, and buckets that are summed together.
GROWTH_BYTES, BLOCK = 1 << 25, 4096
_PRIME = np.uint64(0xCF1BBCDCB7A56463)


def sizes(n_bytes: int) -> tuple[int, int, int]:
    """(buckets of a table, slots, bytes of a dictionary) for a corpus of so many bytes."""
    by = math.sqrt(1 + n_bytes / GROWTH_BYTES)
    return round(by * (1 << TABLE_BITS)), round(by * SLOTS), round(by * DICT_BYTES)


def windows(data: bytes | memoryview, buckets: int = 1 << TABLE_BITS) -> np.ndarray:
    """Table buckets of all 8-byte windows of a text."""
    n = len(data) - 7
    if n <= 0:
        return np.empty(0, np.int64)
    x = np.ndarray((n,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        return (((x * _PRIME) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _flagged(docs: DataFrame, domain: DataFrame) -> DataFrame:
    """(text, good) of all documents: good where the id is among the domain's.

    A bit map of the domain's ids (FILTER_BITS, broadcast) tells most other documents apart without a shuffle.
    The texts that pass are shuffled once, against a hash table of ids, and written, as they are read twice.
    """
    ids = domain.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = ids.select(place.alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("__bits"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("__p", place)
    probed = named.join(F.broadcast(bits), F.expr("cast(__p div 64 as int)") == F.col("__word"), "left")
    passes = F.expr("doc_id is not null and coalesce(shiftrightunsigned(__bits, cast(__p % 64 as int)) & 1L, 0L) = 1")
    ids = ids.withColumn("good", F.lit(True)).hint("shuffle_hash")
    joined = probed.where(passes).select("doc_id", "text").join(ids, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    return written(joined, "domain").unionByName(probed.where(~passes).select("text", F.lit(False).alias("good")))


def counts(flagged: DataFrame, buckets: int = 1 << TABLE_BITS) -> DataFrame:
    """(bucket, n_all, n_in) over every window of every text; blocks of buckets are shuffled, compressed."""
    blocks = -(-buckets // BLOCK)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, blocks * BLOCK), np.int64)
        for part in parts:
            good = part.column(1).to_numpy(zero_copy_only=False)
            for x, g in zip(part.column(0), good):
                w = windows(x.as_buffer(), buckets)
                for k in range(1 + bool(g)):
                    np.add.at(tables[k], w, 1)
        for b in range(blocks):
            own = tables[:, b * BLOCK : (b + 1) * BLOCK]
            if own.any():
                kind = np.min_scalar_type(own.max()).newbyteorder("<")
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(own.astype(kind).tobytes(), 1)], pa.binary())], names=["block", "packed"])

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for b, x in zip(part.column(0).to_pylist(), part.column(1)):
                raw = zlib.decompress(x.as_py())
                own = np.frombuffer(raw, f"<u{len(raw) // (2 * BLOCK)}").reshape(2, BLOCK).astype(np.int64)
                sums[b] = sums[b] + own if b in sums else own
        for b, (n_all, n_in) in sums.items():
            j = np.flatnonzero(n_all)
            yield pa.RecordBatch.from_arrays([pa.array((b * BLOCK + j).astype(np.int32)), pa.array(n_all[j]), pa.array(n_in[j])], names=["bucket", "n_all", "n_in"])

    return flagged.mapInArrow(run, "block int, packed binary").repartition("block").mapInArrow(total, "bucket int, n_all long, n_in long")


def best_segments(data: bytes, table: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, score, slot) of a text's segments: at half-overlapping starts, and its last one.

    A text shorter than a segment is one; a text without a window (under 8 bytes) has none.
    """
    w = windows(data, len(table))
    if not len(w):
        return (np.empty(0, np.int64),) * 3
    sums = np.concatenate([[0], np.cumsum(table[w], dtype=np.int64)])
    last = max(0, len(data) - SEGMENT)
    start = np.unique(np.append(np.arange(0, last + 1, SEGMENT // 2), last))
    # short texts often begin alike, so their slot follows their end too
    slot = w[start] if len(data) >= SEGMENT else w[:1] + w[-1:]
    return start, sums[np.minimum(start + SEGMENT - 7, len(w))] - sums[start], slot % slots


def candidates(flagged: DataFrame, tables: np.ndarray, slots: int = SLOTS) -> DataFrame:
    """The best segment of each slot and kind (0 general, 1 in-domain): kind, slot, score, segment."""
    shared = flagged.sparkSession.sparkContext.broadcast(tables.astype(np.min_scalar_type(tables.max())))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, tuple[int, bytes]]] = [{}, {}]
        peak = np.full((2, slots), -1, np.int64)  # the scores in best
        for part in parts:
            good = part.column(1).to_numpy(zero_copy_only=False)
            for x, g in zip(part.column(0), good):
                data = x.as_buffer()
                for k in range(1 + bool(g)):
                    start, score, slot = best_segments(data, shared.value[k], slots)
                    np.maximum.at(peak[k], slot, score)
                    top = best[k]
                    for i in np.flatnonzero(score == peak[k][slot]):
                        s = int(slot[i])
                        top[s] = max(top.get(s, (-1, b"")), (int(score[i]), bytes(data[int(start[i]) : int(start[i]) + SEGMENT])))
        for k in range(2):
            filled = sorted(best[k])
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(filled), pa.int32()), pa.array(filled, pa.int32()), pa.array([best[k][s][0] for s in filled], pa.int64()), pa.array([best[k][s][1] for s in filled], pa.binary())], names=["kind", "slot", "score", "segment"])

    found = flagged.mapInArrow(run, "kind int, slot int, score long, segment binary")
    return found.groupBy("kind", "slot").agg(F.max(F.struct("score", "segment")).alias("best")).select("kind", "slot", "best.score", "best.segment")


def assembled(segments: list[tuple[int, bytes]], table: np.ndarray, size: int = DICT_BYTES) -> bytes:
    """Greedy cover: segments by the counts of windows not yet covered, the best at the end."""
    heap = [(-score, s) for score, s in segments]
    heapq.heapify(heap)
    seen = np.zeros(len(table), bool)
    out: list[bytes] = []
    filled = 0
    while heap and filled < size:
        score, s = heapq.heappop(heap)
        w = np.unique(windows(s, len(table)))
        now = -int(table[w[~seen[w]]].sum())
        if heap and now > heap[0][0]:
            if now < 0:
                heapq.heappush(heap, (now, s))
            continue
        seen[w] = True
        out.append(s)
        filled += len(s)
    return b"".join(reversed(out))


def dictionaries(docs: DataFrame, domain: DataFrame) -> tuple[bytes, bytes]:
    """(general, in-domain) raw-content dictionaries; empty where there is nothing to learn from."""
    n_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets, slots, size = sizes(n_bytes)
    flagged = _flagged(docs, domain)
    tables = np.zeros((2, buckets), np.int64)
    got = counts(flagged, buckets).toArrow()  # at most a row a bucket
    at = got.column("bucket").to_numpy()
    tables[0][at], tables[1][at] = got.column("n_all").to_numpy(), got.column("n_in").to_numpy()
    rows = candidates(flagged, tables, slots).toArrow().to_pylist()  # at most two a slot
    return tuple(assembled([(r["score"], r["segment"]) for r in rows if r["kind"] == k], tables[k], size) for k in range(2))


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, **plain)
    bits = max(17, (len(dictionary) - 1).bit_length())  # the level's own tables are full at some 300 KB
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionary), hash_log=bits, chain_log=bits, **plain)
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def score(docs: DataFrame, general: bytes, domain: bytes) -> DataFrame:
    """doc_id, n_bytes, bytes_general, bytes_domain, score; a row for each input row.

    Null or empty text: zeros. Equal texts, equal values.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((general, domain))  # two dictionaries

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (compressor(x) for x in shared.value)
        for part in parts:
            n, one, two = [], [], []
            for x in part.column(1):
                data = x.as_buffer() if x.is_valid else b""
                n.append(len(data))
                one.append(len(a.compress(data)) if len(data) else 0)
                two.append(len(b.compress(data)) if len(data) else 0)
            value = [(p - q) / k if k else 0.0 for k, p, q in zip(n, one, two)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in (n, one, two)), pa.array(value, pa.float64())], names=["doc_id", "n_bytes", "bytes_general", "bytes_domain", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_bytes long, bytes_general long, bytes_domain long, score double")


def cross_entropy(docs: DataFrame, domain: DataFrame) -> DataFrame:
    """Scores of all documents, the dictionaries learned from all of them and those whose ids ``domain`` has.

    One row per input row; texts are counted and compressed whole, however long. Null and empty texts score 0. A null id
    is in no domain; rows that repeat a domain's id all count for it. Ties between segments go to the larger bytes, so
    reruns agree. Other columns are ignored. An empty domain compresses without a dictionary. No rows give none.
    """
    prepare(docs.sparkSession)
    return score(docs, *dictionaries(docs, domain))
