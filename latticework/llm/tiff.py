"""TIFF media columns: a reader of image directories, strips and tiles, and a lossless writer.

The reader (``pages``) takes either byte order, walks the chain of directories, decodes
uncompressed, PackBits, LZW and deflate strips or tiles, undoes the horizontal (2)
predictor, and gives one page for each directory. Samples of 1, 4, 8 and 16 bits are read, interleaved or in planes.
``page_rows`` emits a row a page of a binary column; a page that can't be read gives a row with its error, and the
walk goes on. A page of more than ``MOST_BYTES`` isn't decoded, nor a block beyond its size. The writer stores
bytes as 8-bit grey samples, for round trips.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
UNIT, WIDTH = 576, 24
#: Bytes of a page's samples that are decoded at most, and directories of a file.
MOST_BYTES, MOST_PAGES = 1 << 28, 100_000
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 16: "Q"}


class TiffError(ValueError):
    """A file that isn't a well-formed TIFF of the kinds above."""


# -- codecs


def packbits_decode(data: bytes, limit: int = MOST_BYTES) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < limit:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            if i + 1 >= len(data):
                break
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{1,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    """Runs of 2 to 128 equal bytes, and what lies between them in pieces of at most 128."""
    out, at = bytearray(), 0
    for run in _RUN.finditer(data):
        start, end = run.span()
        for i in range(at, start, 128):
            piece = data[i : min(i + 128, start)]
            out.append(len(piece) - 1)
            out += piece
        out.append(257 - (end - start))
        out.append(data[start])
        at = end
    for i in range(at, len(data), 128):
        piece = data[i : i + 128]
        out.append(len(piece) - 1)
        out += piece
    return bytes(out)


#: Bits of the k-th LZW code after a clear, and of all codes when the table is full; codes that are cut out together.
_GROWING = np.array([min(12, (k + 258).bit_length()) for k in range(4096)])
_FULL = np.full(4096, 12)
_ENDS = {True: np.cumsum(_FULL), False: np.cumsum(_GROWING)}
#: Codes between two clears of the encoder, the second clear with them.
_SEGMENT = 3837


def _codes(padded: np.ndarray, bit: int, full: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole codes from ``bit`` on, after a clear or of a full table, a table's or ``most`` at most, and where each ends; three bytes of padding follow the data."""
    ends = bit + _ENDS[full][:most]
    ends = ends[: ends.searchsorted(8 * (len(padded) - 3), side="right")]
    widths = (_FULL if full else _GROWING)[: len(ends)]
    begins = ends - widths
    byte = begins >> 3
    held = padded[byte] << 16 | padded[byte + 1] << 8 | padded[byte + 2]
    return held >> (24 - (begins & 7) - widths) & ((1 << widths) - 1), ends


_LITERALS = [bytes([i]) for i in range(256)]


def _expanded(codes: list[int], skip: int, room: int) -> tuple[bytes, bool]:
    """What the codes after a clear give from the skip-th on, up to the first that fills room; whether a bad code comes before that.

    The entry of the k-th code and the byte after it has number 258 + k, so each code is a literal, or another's string and a byte.
    """
    out: list[bytes] = []
    put, bad = out.append, False
    for code in codes:
        if code < 256:
            put(_LITERALS[code])
            continue
        try:
            put(out[code - 258] + out[code - 257][:1])
        except IndexError:
            # the entry that this very code completes, or none
            if not out or code != 257 + len(out):
                bad = True
                break
            put(out[-1] + out[-1][:1])
    given = b"".join(out[skip:] if skip else out)
    if given and len(given) >= room:
        ends = list(accumulate(map(len, out[skip:])))
        return given[: ends[bisect_left(ends, room)]], False
    return given, bad


def lzw_decode(data: bytes, limit: int = MOST_BYTES) -> bytes:
    """MSB-first codes of 9 to 12 bits, early change, 256 clears and 257 ends; codes up to the next clear are expanded together."""
    padded = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64)
    out, bit, size = [], 0, 0
    seen: list[int] = []  # since the last clear; more than a full table's aren't kept
    while True:
        codes, ends = _codes(padded, bit, bool(seen), max(limit - size, 0) + 1)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stops[0]) if len(stops) else len(codes)
        own = seen + codes[:n].tolist()
        given, bad = _expanded(own, len(seen), limit - size)
        if bad:
            raise TiffError("bad LZW code")
        out.append(given)
        size += len(given)
        if n and size >= limit or not len(codes) or len(stops) and codes[n] == 257:
            return b"".join(out)
        seen = [] if len(stops) else own[: len(_GROWING)]
        bit = int(ends[min(n, len(ends) - 1)])


def lzw_encode(data: bytes) -> bytes:
    codes = [256]
    put, n = codes.append, 258
    # a string is a node: its code at -1 and the longer strings by their last byte
    if data:
        top = {data[0]: (node := {-1: data[0]})}
        for b in memoryview(data)[1:]:
            longer = node.get(b)
            if longer is not None:
                node = longer
                continue
            put(node[-1])
            node[b] = {-1: n}
            n += 1
            if n == 4094:
                put(256)
                top, n = {}, 258
            node = top.get(b)
            if node is None:
                node = top[b] = {-1: b}
        put(node[-1])
    put(257)
    # every code but the first has the bits of its place after a clear
    n = len(codes) - 1
    widths = np.empty(n + 1, np.int64)
    widths[0], widths[1:] = 9, _GROWING[:n] if n <= _SEGMENT else _GROWING[np.arange(n) % _SEGMENT]
    ends = np.cumsum(widths)
    begins = ends - widths
    held, byte = np.array(codes) << (24 - (begins & 7) - widths), begins >> 3
    size = int(ends[-1] + 7) // 8
    out = np.zeros(size + 2, np.uint8)
    # no two codes begin in one byte
    for k, shift in enumerate((16, 8, 0)):
        out[byte + k] |= (held >> shift & 255).astype(np.uint8)
    return out[:size].tobytes()


def _decoded(data: bytes, codec: int, limit: int) -> bytes:
    if codec == NONE:
        return data
    if codec == PACKBITS:
        return packbits_decode(data, limit)
    if codec == LZW:
        return lzw_decode(data, limit)
    if codec in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, limit)
        except zlib.error as e:
            raise TiffError(str(e)) from None
    raise TiffError(f"compression {codec} isn't read")


# -- reading


@dataclass(frozen=True)
class Page:
    """One directory: samples as (height, width, samples per pixel), of 8 bits unless the file's are of 16."""

    index: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def directories(data: bytes) -> Iterator[dict[int, tuple | None]]:
    """Tags of every directory in the chain, None for a value beyond the file; a loop or a broken offset is an error."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    e = "<" if data[:2] == b"II" else ">"
    try:
        (at,) = struct.unpack_from(e + "I", data, 4)
        seen = set()
        while at:
            if at in seen or len(seen) >= MOST_PAGES:
                raise TiffError("directories form a loop" if at in seen else "too many directories")
            seen.add(at)
            (n,) = struct.unpack_from(e + "H", data, at)
            tags: dict[int, tuple | None] = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
                if kind not in _TYPES:
                    continue
                one = struct.calcsize("=" + _TYPES[kind])
                where = at + 10 + 12 * i
                if one * count > 4:
                    (where,) = struct.unpack_from(e + "I", data, where)
                whole = where + one * count <= len(data)
                tags[tag] = struct.unpack_from(f"{e}{count * len(_TYPES[kind])}{_TYPES[kind][0]}" if kind != 2 else f"{count}s", data, where) if whole else None
            yield tags
            (at,) = struct.unpack_from(e + "I", data, at + 2 + 12 * n)
    except struct.error:
        raise TiffError("a directory lies beyond the file") from None


def _numbers(tags: dict[int, tuple | None], tag: int, *default: int, least: int = 0) -> tuple[int, ...]:
    found = tags.get(tag, default or None)
    if not found:
        raise TiffError(f"tag {tag} is missing" if tag not in tags else f"tag {tag} has no readable value")
    if any(not isinstance(x, int) or x < least for x in found):
        raise TiffError(f"tag {tag} holds values that don't fit")
    return found


def _page(data: bytes, index: int, t: dict[int, tuple | None], e: str) -> Page:
    (w, *_), (h, *_) = _numbers(t, 256, least=1), _numbers(t, 257, least=1)
    k, codec, predictor = (_numbers(t, tag, 1, least=1)[0] for tag in (277, 259, 317))
    kinds = _numbers(t, 258, 1, least=1)
    bits, planar = kinds[0], _numbers(t, 284, 1)[0] == 2 and k > 1
    if any(b != bits for b in kinds) or bits not in (1, 4, 8, 16):
        raise TiffError(f"samples of {kinds} bits aren't read")
    if predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise TiffError(f"predictor {predictor} isn't read for samples of {bits} bits")
    size = 2 if bits == 16 else 1
    if w * h * k * size > MOST_BYTES:
        raise TiffError(f"{w} x {h} x {k} samples are beyond {MOST_BYTES} bytes")
    tiled = 322 in t
    (bw, *_), (bh, *_) = (_numbers(t, 322, least=1), _numbers(t, 323, least=1)) if tiled else ((w,), (min(h, _numbers(t, 278, h, least=1)[0]),))
    offsets, counts = (_numbers(t, 324), _numbers(t, 325)) if tiled else (_numbers(t, 273), _numbers(t, 279))
    across, down = -(-w // bw), -(-h // bh)
    planes, inner = (k, 1) if planar else (1, k)
    if bw * inner * bh * size > MOST_BYTES:
        raise TiffError(f"a block of {bw} x {bh} is beyond {MOST_BYTES} bytes")
    if min(len(offsets), len(counts)) < across * down * planes:
        raise TiffError("blocks are missing")
    out = np.zeros((h, w, k), np.uint16 if bits == 16 else np.uint8)
    for i in range(across * down * planes):
        plane, j = divmod(i, across * down)
        y, x = j // across * bh, j % across * bw
        rows, stride = bh if tiled else min(bh, h - y), -(-bw * inner * bits // 8)
        if offsets[i] + counts[i] > len(data):
            raise TiffError("a block lies beyond the file")
        raw = _decoded(data[offsets[i] : offsets[i] + counts[i]], codec, rows * stride)
        if len(raw) < rows * stride:
            raise TiffError("a block is too short")
        flat = np.frombuffer(raw, np.uint8, rows * stride).reshape(rows, stride)
        if bits == 1:
            flat = np.unpackbits(flat, axis=1)
        elif bits == 4:
            flat = np.stack([flat >> 4, flat & 15], axis=2).reshape(rows, -1)
        elif bits == 16:
            flat = flat.view(e + "u2")
        block = flat[:, : bw * inner].reshape(rows, bw, inner)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[y : y + rows, x : x + bw, plane if planar else slice(None)] = block[: h - y, : w - x, 0] if planar else block[: h - y, : w - x]
    return Page(index, w, h, k, codec, predictor, tiled, out)


def pages_or_errors(data: bytes) -> Iterator[Page | tuple[int, str]]:
    """Each directory's page, or its index and error; an error in the chain itself ends it."""
    data, index = bytes(data), 0
    try:
        for t in directories(data):
            try:
                yield _page(data, index, t, "<" if data[:2] == b"II" else ">")
            except TiffError as error:
                yield index, str(error)
            index += 1
    except TiffError as error:
        yield index, str(error)


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF file; the first error is raised."""
    for found in pages_or_errors(data):
        if not isinstance(found, Page):
            raise TiffError(found[1])
        yield found


# -- writing


def stored(payloads: list[bytes], width: int = WIDTH, codec: int = DEFLATE, predictor: int = 1, rows: int = 1024, tile: int | None = None, order: str = "<") -> bytes:
    """A TIFF with a grey page of ``width`` samples a row for each payload (whole rows each)."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    pack = {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode}.get(codec, lambda b: zlib.compress(b, 1))
    for payload in payloads:
        image = np.frombuffer(payload, np.uint8).reshape(-1, width)
        h = len(image)
        if tile:
            full = np.zeros((-(-h // tile) * tile, -(-width // tile) * tile), np.uint8)
            full[:h, :width] = image
            blocks = [full[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, width, tile)]
        else:
            blocks = [image[y : y + rows] for y in range(0, h, rows)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1)
            raw = pack(np.ascontiguousarray(b).tobytes())
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw + b"\0" * (len(raw) & 1)
        tags = [(256, 4, [width]), (257, 4, [h]), (258, 3, [8]), (259, 3, [codec]), (262, 3, [1]), (277, 3, [1])]
        tags += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [rows]), (279, 4, counts)]
        tags += [(317, 3, [predictor])] if predictor != 1 else []
        entries = b""
        for tag, kind, values in sorted(tags):
            body = struct.pack(order + ("H" if kind == 3 else "I") * len(values), *values)
            if len(body) > 4:
                at, out = len(out), out + body + b"\0" * (len(body) & 1)
                body = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def joined(first: bytes, second: bytes) -> bytes:
    """Two little-endian files of ``stored``, one page each, as one of two pages."""
    shift = len(first)
    out = bytearray(first + second[8:])
    base = shift - 8
    (at,) = struct.unpack_from("<I", second, 4)
    (n,) = struct.unpack_from("<H", second, at)
    for i in range(n):
        entry = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from("<HHI", second, entry)
        size = (2 if kind == 3 else 4) * count
        (where,) = struct.unpack_from("<I", second, entry + 8)
        if size > 4:
            struct.pack_into("<I", out, base + entry + 8, base + where)
        if tag in (273, 324):  # offsets of blocks
            place = where if size > 4 else entry + 8
            for j in range(count):
                (v,) = struct.unpack_from("<I", second, place + 4 * j)
                struct.pack_into("<I", out, base + place + 4 * j, base + v)
    (own,) = struct.unpack_from("<I", first, 4)
    (n,) = struct.unpack_from("<H", first, own)
    struct.pack_into("<I", out, own + 2 + 12 * n, base + at)
    return bytes(out)


# -- columns


def page_rows(files: DataFrame, key: str = "file_id", column: str = "data") -> DataFrame:
    """A row for each page of a binary column: key, page, width, height, samples, compression, predictor, tiled, pixels, error.

    Null or empty data gives no page; a page that can't be read gives a row with its error, and a broken chain of
    directories one after the pages before. Pixels are bytes, 16-bit samples little-endian. Keys may be null or
    repeat. Equal files give equal rows; other columns are ignored; no rows give none.
    """
    prepare(files.sparkSession)
    names = ["key", "page", "width", "height", "samples", "compression", "predictor", "tiled", "pixels", "error"]
    kinds = [pa.string(), *[pa.int32()] * 6, pa.bool_(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip(names, kinds)))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part in parts:
            for k, x in zip(part.column(0).to_pylist(), part.column(1)):
                if not x.is_valid or not len(x.as_buffer()):
                    continue
                for p in pages_or_errors(x.as_py()):
                    if isinstance(p, Page):
                        pixels = p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes()
                        rows.append((k, p.index, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, pixels, None))
                        held += len(pixels)
                    else:
                        rows.append((k, p[0], *[None] * 7, p[1]))
                    if held > 1 << 23 or len(rows) >= 1024:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    out = files.select(F.col(key).cast("string").alias("key"), F.col(column).alias("data")).mapInArrow(run, "key string, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string")
    return out.withColumnRenamed("key", key)


def text_files(docs: DataFrame) -> DataFrame:
    """(doc_id, data): a TIFF of two pages for each text, its payload in strips and its first 576 bytes in tiles; the codec follows the id."""
    prepare(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data = []
            for k, x in zip(part.column(0).to_pylist(), part.column(1)):
                codec, own = (NONE, DEFLATE, PACKBITS, LZW)[(k or 0) % 4], payload(x.as_buffer().to_pybytes() if x.is_valid else b"")
                first, second = stored([own], codec=codec), stored([own[:UNIT]], codec=codec, predictor=2, tile=16)
                data.append(joined(first, second))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, data binary")


def payload(data: bytes) -> bytes:
    """The bytes with 255s appended up to a positive multiple of UNIT."""
    return data + b"\xff" * ((-len(data)) % UNIT or (UNIT if not data else 0))


def round_trip(data: bytes) -> tuple:
    """(n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of one text's bytes."""
    media = stored([payload(data)], codec=DEFLATE, predictor=2)
    (page,) = pages(media)
    back = page.pixels.tobytes()
    p = page.pixels
    dark, bright, ink = int((p < 64).sum()), int((p >= 192).sum()), int(p.astype(np.int64).sum())
    edges = int((p[:, 1:, 0] != p[:, :-1, 0]).sum())
    feature = f"tiff:{page.width}x{page.height}x{page.samples};codec={page.compression};predictor={page.predictor};sum={ink};low={dark};high={bright};edges={edges}"
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored as a one-page TIFF (deflate, predictor 2), read back, and described; null is empty."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cols = list(zip(*(round_trip(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in part.column(1)))) or [[]] * 7
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
