"""Reading and writing arrays as files."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import ArrayFrame, chunk_of
from ..functions.expr import converted
from ..plans.numbering import numbered
from ..schema import FLOATS, TYPES, ArrayError, ArraySchema, Attr, Dim, need, parse_schema
from .literal import cells

_TEMPLATE = {"int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "int64": "q", "uint64": "Q", "float": "f", "double": "d", "bool": "?", "char": "c"}


def _parsed(text: str, kind: str) -> str:
    """SQL that reads a field of text; null where it can't be read."""
    if kind in ("string", "char"):
        return text
    if kind == "datetime":
        return converted(text, "string", "datetime")
    return f"try_cast(trim({text}) AS {TYPES[kind]})"


def read_delimited(spark: SparkSession, path: str, schema: str | ArraySchema, sep: str = ",", header: bool = False, max_errors: int = 0, null: str = "") -> tuple[ArrayFrame, DataFrame]:
    """A delimited file as a one-dimensional array in line order, and the lines that can't be read.

    Fields are checked in Spark; more than ``max_errors`` bad lines are an error.
    """
    s = parse_schema(schema) if isinstance(schema, str) else schema
    need(len(s.dims) == 1, "a delimited file fills one dimension; redimension it afterwards")
    fields = ", ".join(f"`__{i}` string" for i in range(len(s.attrs)))
    raw = spark.read.schema(f"{fields}, `__bad` string").option("sep", sep).option("header", header).option("nullValue", null).option("columnNameOfCorruptRecord", "__bad").option("mode", "PERMISSIVE").csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    cols, wrong = [], F.col("__bad").isNotNull()
    for i, a in enumerate(s.attrs):
        v = F.expr(_parsed(f"`__{i}`", a.type))
        cols.append(v.alias(a.name))
        wrong = wrong | (F.col(f"`__{i}`").isNotNull() & v.isNull()) | (F.col(f"`__{i}`").isNull() if not a.nullable else F.lit(False))
    from ..plans.lineage import written

    both = written(raw.select(*cols, wrong.alias("__wrong"), "__bad", "__file", "__at", *[f"__{i}" for i in range(len(s.attrs))]), "input")
    bad = both.where("__wrong").select(F.col("__file").alias("file"), F.col("__at").alias("place"), F.coalesce("__bad", F.concat_ws(sep, *[F.col(f"__{i}") for i in range(len(s.attrs))])).alias("line"))
    n = bad.limit(max_errors + 1).count()
    if n > max_errors:
        raise ArrayError(f"more than {max_errors} bad lines in {path}")
    d = s.dims[0]
    good = numbered(both.where("not __wrong").select(*[f"`{a}`" for a in s.attr_names], "__at"), [F.col("__at")], d.name, d.lo)
    return ArrayFrame.of(good, s), bad


def read_text(spark: SparkSession, path: str, schema: str | ArraySchema) -> ArrayFrame:
    """Files in the dense or sparse text format; each file is one chunk or more, read as a whole by one task."""
    s = parse_schema(schema) if isinstance(schema, str) else schema
    kinds = [TYPES[a.type] if a.type not in ("datetime", "datetimetz") else "string" for a in s.attrs]
    ddl = ", ".join([*[f"`{d}` bigint" for d in s.dim_names], *[f"`{a.name}` {k}" for a, k in zip(s.attrs, kinds)]])
    names = s.names

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text in part.column(0):
                rows = [(*at, *v) for at, v in cells(text.as_py(), s)]
                if rows:
                    yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*rows))})

    df = spark.read.text(path, wholetext=True).mapInArrow(_typed(run, ddl, spark), ddl)
    for a in s.attrs:
        if a.type in ("datetime", "datetimetz"):
            df = df.withColumn(a.name, F.expr(converted(f"`{a.name}`", "string", a.type)))
    return ArrayFrame.of(df, s)


def _typed(run, ddl: str, spark: SparkSession):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def wrapped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(parts):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema)], schema=schema)

    return wrapped


def _template(template: str) -> tuple[str, list[tuple[str, bool]]]:
    kinds = []
    for x in template.strip("() ").split(","):
        words = x.split()
        kinds.append((words[0], "null" in [w.lower() for w in words[1:]]))
    return template, kinds


def read_binary(spark: SparkSession, path: str, schema: str | ArraySchema, template: str) -> ArrayFrame:
    """Fixed records, e.g. ``(int64, double null, string)``: a nullable field has a byte before it (-1 for a value, else a reason), a string a 4-byte length."""
    s = parse_schema(schema) if isinstance(schema, str) else schema
    kinds = _template(template)[1]
    need(len(kinds) == len(s.attrs) and len(s.dims) == 1, "the template doesn't fit the schema")
    d = s.dims[0]
    ddl = ", ".join(["__file string", "__at bigint", *[f"`{a.name}` {TYPES[a.type]}" for a in s.attrs]])

    def records(data: bytes) -> Iterator[tuple]:
        i = 0
        while i < len(data):
            row: list[object] = []
            for kind, null in kinds:
                v: object = None
                present = True
                if null:
                    present = struct.unpack_from("<b", data, i)[0] == -1
                    i += 1
                if kind == "string":
                    (n,) = struct.unpack_from("<I", data, i)
                    v = data[i + 4 : i + 4 + n].rstrip(b"\0").decode()
                    i += 4 + n
                else:
                    (v,) = struct.unpack_from("<" + _TEMPLATE[kind], data, i)
                    v = v.decode("latin-1") if kind == "char" else v
                    i += struct.calcsize("<" + _TEMPLATE[kind])
                row.append(v if present else None)
            yield tuple(row)

    names = s.attr_names

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file, data in zip(part.column(0).to_pylist(), part.column(1)):
                rows = list(records(data.as_py()))
                if rows:
                    yield pa.RecordBatch.from_pydict({"__file": [file] * len(rows), "__at": list(range(len(rows))), **{n: list(c) for n, c in zip(names, zip(*rows))}})

    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_typed(run, ddl, spark), ddl)
    df = numbered(df, [F.col("__file"), F.col("__at")], d.name, d.lo)
    return ArrayFrame.of(df, s)


def write_binary(src: ArrayFrame, path: str, template: str) -> None:
    """Records of a template, in the order of the dimensions; a part file for each partition."""
    kinds = _template(template)[1]
    need(len(kinds) == len(src.schema.attrs), "the template doesn't fit the schema")
    names = src.schema.attr_names

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for row in zip(*(part.column(i).to_pylist() for i in range(len(names)))):
                b = b""
                for (kind, null), v in zip(kinds, row):
                    if null:
                        b += struct.pack("<b", 0 if v is None else -1)
                    if kind == "string":
                        raw = ("" if v is None else v).encode() + b"\0"
                        b += struct.pack("<I", len(raw)) + raw
                    else:
                        b += struct.pack("<" + _TEMPLATE[kind], v.encode("latin-1") if kind == "char" and v else (b"\0" if kind == "char" else (v or 0)))
                out.append(b.hex())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    df = src.df.sort(*src.cols(*src.schema.dim_names)).select(*src.cols(*names))
    df.mapInArrow(run, "value string").write.text(path)


def _shown(c: Column, t: str, null: str) -> Column:
    """A value as the text formats show it."""
    text = c.cast("string")
    if t in FLOATS:
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        text = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(whole, c.cast("bigint").cast("string")).otherwise(text)
    elif t in ("string", "char"):
        text = F.concat(F.lit("'"), F.regexp_replace(c, "(['\\\\])", "\\\\$1"), F.lit("'"))
    elif t == "datetime":
        text = F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("'"))
    return F.coalesce(text, F.lit(null))


def rendered(src: ArrayFrame, fmt: str) -> DataFrame:
    """Lines of text: ``value`` in the order of ``__order``; csv, csv+, lcsv+, dcsv, tsv, tsv+, sparse, lsparse, dense, text."""
    s = src.schema
    base, _, option = fmt.partition(":")
    null = {"E": "", "N": "\\N", "?": "?0", "": "null"}.get(option, "null")
    if base.startswith("tsv") and not option:
        null = "\\N"
    values = [_shown(F.col(f"`{a.name}`"), a.type, null) if not base.startswith("tsv") else F.coalesce(F.col(f"`{a.name}`").cast("string"), F.lit(null)) for a in s.attrs]
    at = [F.col(f"`{d}`").cast("string") for d in s.dim_names]
    order = src.cols(*s.dim_names)
    if base in ("csv", "csv+", "lcsv+"):
        line = F.concat_ws(",", *([*at] if base != "csv" else []), *values)
    elif base == "dcsv":
        line = F.concat(F.lit("{"), F.concat_ws(",", *at), F.lit("} "), F.concat_ws(",", *values))
    elif base in ("tsv", "tsv+"):
        line = F.concat_ws("\t", *([*at] if base == "tsv+" else []), *values)
    elif base in ("sparse", "lsparse", "store", "text", "dense"):
        cell = F.concat(F.lit("("), F.concat_ws(",", *values), F.lit(")"))
        if base in ("dense", "text"):
            return _dense(src, cell)
        line = F.concat(F.lit("{"), F.concat_ws(",", *at), F.lit("}"), cell)
    else:
        raise ArrayError(f"no format {fmt}")
    return src.df.select(F.struct(*order).alias("__order"), line.alias("value"))


#: Cells of a chunk in the dense format, which writes out its empty ones.
DENSE_CELLS = 1_000_000


def _dense(src: ArrayFrame, cell: Column) -> DataFrame:
    """A line for each chunk: nested brackets with () for empty cells. A chunk is of bounded size."""
    src = src.bounded()
    s = src.schema
    size = 1
    for d in s.dims:
        size *= min(d.chunk, max(d.length, 1))
    need(size <= DENSE_CELLS, f"dense: a chunk is beyond {DENSE_CELLS} cells")
    dims = s.dims
    place = F.lit(0).cast("bigint")
    for d in dims:
        place = place * F.lit(d.chunk) + F.pmod(F.col(f"`{d.name}`") - F.lit(d.lo), F.lit(d.chunk))
    rows = src.df.select(F.struct(*[chunk_of(d).alias(d.name) for d in dims]).alias("__order"), place.alias("p"), cell.alias("c"))
    whole = rows.groupBy("__order").agg(F.map_from_entries(F.collect_list(F.struct("p", "c"))).alias("m"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            orders, out = part.column(0), []
            for o, m in zip(orders.to_pylist(), part.column(1).to_pylist()):
                have = dict(m)
                lens = [min(d.chunk, d.length - o[d.name] * d.chunk) for d in dims]

                def level(k: int, at: int) -> str:
                    if k == len(dims):
                        return have.get(at, "()")
                    return "[" + ",".join(level(k + 1, at * dims[k].chunk + i) for i in range(lens[k])) + "]"

                text = level(0, 0)
                if any(o[d.name] for d in dims):
                    text = "{" + ",".join(str(d.lo + o[d.name] * d.chunk) for d in dims) + "}" + text
                out.append(text)
            yield pa.RecordBatch.from_arrays([orders, pa.array(out, pa.string())], names=["__order", "value"])

    inner = ", ".join(f"`{d.name}`: bigint" for d in dims)
    return whole.mapInArrow(run, f"__order struct<{inner}>, value string")


def save(src: ArrayFrame, path: str, fmt: str = "store") -> ArrayFrame:
    """Write an array: parquet (also ``opaque``), a binary template ``(...)``, or lines of a text format in order."""
    if fmt in ("opaque", "parquet"):
        src.df.write.parquet(path)
    elif fmt.startswith("("):
        write_binary(src, path, fmt)
    else:
        rendered(src, fmt).sort("__order").select("value").write.text(path)
    return src


def load_file(spark: SparkSession, schema: str | ArraySchema, path: str, fmt: str = "text", max_errors: int = 0) -> tuple[ArrayFrame, DataFrame | None]:
    """(array, bad lines or None) of a file in any of the formats that can be read."""
    s = parse_schema(schema) if isinstance(schema, str) else schema
    base = fmt.split(":")[0].lower()
    if base in ("", "text", "dense", "sparse", "store", "lsparse"):
        return read_text(spark, path, s), None
    if base in ("opaque", "parquet"):
        return ArrayFrame.of(spark.read.parquet(path), s), None
    if base.startswith("("):
        return read_binary(spark, path, s, fmt), None
    if base in ("csv", "tsv"):
        return read_delimited(spark, path, s, "," if base == "csv" else "\t", max_errors=max_errors, null="" if base == "csv" else "\\N")
    raise ArrayError(f"no format {fmt}")


def fits_headers(data: bytes) -> list[dict]:
    """Header cards of every unit of a FITS file, with where its data begins and ends."""
    out, i = [], 0
    while i < len(data):
        cards: dict[str, object] = {}
        done = False
        while not done and i < len(data):
            for k in range(0, 2880, 80):
                card = data[i + k : i + k + 80].decode("ascii", "replace")
                key = card[:8].strip()
                if key == "END":
                    done = True
                    break
                if card[8:10] == "= ":
                    raw = card[10:].split("/")[0].strip() if not card[10:].lstrip().startswith("'") else card[10:].strip()
                    m = re.match(r"'((?:[^']|'')*)'", raw)
                    cards[key] = m[1].rstrip() if m else {"T": True, "F": False}.get(raw, raw)
            i += 2880
        bits, axes = abs(int(cards.get("BITPIX", 8))), int(cards.get("NAXIS", 0))
        shape = [int(cards[f"NAXIS{k + 1}"]) for k in range(axes)]
        n = bits // 8 if shape else 0
        for x in shape:
            n *= x
        out.append({"cards": cards, "start": i, "bytes": n, "shape": shape})
        i += -(-n // 2880) * 2880
    return out


def fits_show(spark: SparkSession, path: str) -> ArrayFrame:
    """A row for each unit of a FITS file: kind, bits and shape."""
    from ..operators.internal import cells as rows

    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    found = [(str(h["cards"].get("XTENSION", "PRIMARY")), int(h["cards"].get("BITPIX", 0)), "x".join(map(str, h["shape"]))) for h in fits_headers(data)]
    return rows(spark, found, [("kind", "string"), ("bitpix", "int64"), ("shape", "string")], "hdu")


def fits_input(spark: SparkSession, path: str, hdu: int = 0, name: str = "pixel") -> ArrayFrame:
    """An image unit as an array of doubles; the last axis varies slowest."""
    import numpy as np

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for x in part.column(0):
                data = x.as_py()
                h = fits_headers(data)[hdu]
                kind = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[int(h["cards"]["BITPIX"])]
                v = np.frombuffer(data, kind, h["bytes"] // np.dtype(kind).itemsize, h["start"]).astype(np.float64)
                v = v * float(h["cards"].get("BSCALE", 1)) + float(h["cards"].get("BZERO", 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], names=["__at", name])

    files = spark.read.format("binaryFile").load(path).select("content")
    shape = fits_headers(bytes(files.first()[0]))[hdu]["shape"]
    dims = tuple(Dim(f"d{i}", 0, n - 1, n) for i, n in enumerate(reversed(shape)))
    df, stride, cols = files.mapInArrow(run, f"__at bigint, `{name}` double"), 1, []
    for d in reversed(dims):
        cols.insert(0, F.expr(f"(__at div {stride}L) % {d.length}L").alias(d.name))
        stride *= d.length
    return ArrayFrame(df.select(*cols, f"`{name}`"), ArraySchema((Attr(name, "double"),), dims))
