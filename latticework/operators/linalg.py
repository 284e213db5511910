"""Matrix products over semirings, and singular values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..schema import FLOATS, INTEGERS, ArrayError, ArraySchema, Attr, Dim, fresh, need
from .registry import register_op


def _matrix(a: ArrayFrame, op: str) -> tuple[Dim, Dim, str]:
    s = a.schema
    need(len(s.dims) == 2 and len(s.attrs) == 1 and s.attrs[0].type in FLOATS + INTEGERS, f"{op} takes matrices of one numeric attribute")
    return s.dims[0], s.dims[1], s.attrs[0].name


def _product(a: ArrayFrame, b: ArrayFrame, op: str, semiring: str):
    """(__i, __j, __v): joined on the inner dimension, combined before the shuffle of the sums."""
    i, k, x = _matrix(a, op)
    k2, j, y = _matrix(b, op)
    need(k.lo == k2.lo and k.length == k2.length, f"{op}: {k} and {k2} don't match")
    p = a.df.select(F.col(f"`{i.name}`").alias("__i"), F.col(f"`{k.name}`").alias("__k"), F.col(f"`{x}`").alias("__x"))
    q = b.df.select(F.col(f"`{k2.name}`").alias("__k"), F.col(f"`{j.name}`").alias("__j"), F.col(f"`{y}`").alias("__y"))
    both = p.join(q, "__k")
    value = {"+.*": F.sum(F.col("__x") * F.col("__y")), "min.+": F.min(F.col("__x") + F.col("__y")), "max.+": F.max(F.col("__x") + F.col("__y"))}.get(semiring)
    need(value is not None, f"{op}: no semiring {semiring}")
    return i, j, both.groupBy("__i", "__j").agg(value.alias("__v"))


@register_op("spgemm", "spgemm(left, right [, 'min.+'|'max.+'])", "linear algebra")
def spgemm(left: ArrayFrame, right: ArrayFrame, semiring: str = "+.*") -> ArrayFrame:
    """Sparse matrix product over (+,*), (min,+) or (max,+); only cells with a product are present."""
    i, j, df = _product(left, right, "spgemm", semiring.strip("'\""))
    t = left.schema.attrs[0].type
    j = Dim(fresh(j.name, [i.name]), j.lo, j.hi, j.chunk, j.overlap)
    s = ArraySchema((Attr("multiply", t, True),), (i, j), left.schema.name)
    return ArrayFrame.of(df.select(F.col("__i").alias(i.name), F.col("__j").alias(j.name), F.col("__v").alias("multiply")), s)


@register_op("gemm", "gemm(a, b, c [, 'TRANSA=..;TRANSB=..;ALPHA=..;BETA=..'])", "linear algebra")
def gemm(a: ArrayFrame, b: ArrayFrame, c: ArrayFrame, options: str = "") -> ArrayFrame:
    """alpha * A * B + beta * C as doubles; absent cells count as 0."""
    opt = dict(x.split("=") for x in options.upper().replace(" ", "").strip("'\"").split(";") if x)
    alpha, beta = float(opt.pop("ALPHA", 1)), float(opt.pop("BETA", 1))
    if opt.pop("TRANSA", "0") in ("1", "T", "TRUE"):
        a = _turned(a)
    if opt.pop("TRANSB", "0") in ("1", "T", "TRUE"):
        b = _turned(b)
    if opt:
        raise ArrayError(f"gemm: unknown options {sorted(opt)}")
    a, b = _double(a), _double(b)
    i, j, df = _product(a, b, "gemm", "+.*")
    ci, cj, x = _matrix(c, "gemm")
    need(ci.length == i.length and cj.length == j.length, "gemm: the third matrix has another shape")
    parts = df.select("__i", "__j", (F.col("__v") * alpha).alias("__v"))
    rest = c.df.select((F.col(f"`{ci.name}`") - F.lit(ci.lo) + F.lit(i.lo)).alias("__i"), (F.col(f"`{cj.name}`") - F.lit(cj.lo) + F.lit(j.lo)).alias("__j"), (F.col(f"`{x}`").cast("double") * beta).alias("__v"))
    df = parts.unionByName(rest).groupBy("__i", "__j").agg(F.sum("__v").alias("__v"))
    j = Dim(fresh(j.name, [i.name]), j.lo, j.hi, j.chunk, j.overlap)
    return ArrayFrame(df.select(F.col("__i").alias(i.name), F.col("__j").alias(j.name), F.col("__v").alias("gemm")), ArraySchema((Attr("gemm", "double"),), (i, j), a.schema.name))


def _double(a: ArrayFrame) -> ArrayFrame:
    x = a.schema.attrs[0]
    return a.same(a.df.withColumn(x.name, F.col(f"`{x.name}`").cast("double")), attrs=[Attr(x.name, "double", x.nullable)])


def _turned(a: ArrayFrame) -> ArrayFrame:
    return a.same(a.df, dims=list(reversed(a.schema.dims)))


#: The shorter side of a matrix for gesvd; its Gram matrix is what reaches the driver.
SVD_SIDE = 2000
#: Cells of the dense rows that a task multiplies at once.
STRIP = 1 << 20


def _packed(cells: DataFrame) -> DataFrame:
    """Cells (r, c, v) as rows (r, c, v) of packed ints and doubles, those of one r beside each other; a row, not its cells, is shuffled and sorted."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            r = part.column(0).to_numpy()
            if not len(r):
                continue
            order = np.argsort(r, kind="stable")
            r, c, v = r[order], part.column(1).to_numpy()[order].astype("<i4").tobytes(), part.column(2).to_numpy()[order].astype("<f8").tobytes()
            at = np.append(np.flatnonzero(np.append(True, r[1:] != r[:-1])), len(r)).tolist()
            spans = list(zip(at, at[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(r[at[:-1]]), pa.array([c[4 * x : 4 * y] for x, y in spans], pa.binary()), pa.array([v[8 * x : 8 * y] for x, y in spans], pa.binary())], names=["r", "c", "v"])

    known = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v")).where("v is not null")
    return known.mapInArrow(run, "r long, c binary, v binary").repartition("r").sortWithinPartitions("r")


def _strips(n: int):
    """A function from batches of ``_packed`` to (ids, dense rows of n columns), each row once."""
    most = max(1, STRIP // max(n, 1))

    def strips(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids: list[int] = []
        x = np.zeros((most, n))
        for part in parts:
            for r, c, v in zip(*(part.column(k).to_pylist() for k in range(3))):
                if not ids or ids[-1] != r:
                    if len(ids) == most:
                        yield np.array(ids), x
                        ids, x = [], np.zeros((most, n))
                    ids.append(r)
                np.add.at(x[len(ids) - 1], np.frombuffer(c, "<i4"), np.frombuffer(v, "<f8"))
        if ids:
            yield np.array(ids), x[: len(ids)]

    return strips


def _gram(rows: DataFrame, n: int) -> np.ndarray:
    """Sums of the products of each two columns: a matrix a task, at most SVD_SIDE ** 2 sums."""
    strips = _strips(n)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((n, n))
        for _, x in strips(parts):
            g += x.T @ x
        for c in range(n):
            d = np.flatnonzero(g[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), c, np.int32)), pa.array(d.astype(np.int32)), pa.array(g[c, d])], names=["c", "d", "g"])

    got = rows.mapInArrow(run, "c int, d int, g double").groupBy("c", "d").agg(F.sum("g").alias("g")).toArrow()
    g = np.zeros((n, n))
    g[got.column("c").to_numpy(), got.column("d").to_numpy()] = got.column("g").to_numpy()
    return (g + g.T) / 2


def row_product(cells: DataFrame, basis: np.ndarray, names: list[int] | None = None) -> DataFrame:
    """(r, q, x): the rows of the cells (r, c, v), c from 0, times a matrix of at most SVD_SIDE ** 2 numbers that all workers get; q names its columns.

    Absent cells count as 0; every row with a cell gives all columns. Only packed rows are shuffled, not products.
    """
    n, k = basis.shape
    strips = _strips(n)
    shared = cells.sparkSession.sparkContext.broadcast((basis, np.arange(k) if names is None else np.array(names, np.int64)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, q = shared.value
        for ids, x in strips(parts):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(np.tile(q, len(ids))), pa.array((x @ b).ravel())], names=["r", "q", "x"])

    return _packed(cells).mapInArrow(run, "r long, q long, x double")


def svd(a: ArrayFrame) -> tuple[ArrayFrame, ArrayFrame, ArrayFrame]:
    """U, S and VT of the singular value decomposition, as ``gesvd`` gives them one by one, from one Gram matrix."""
    i, j, x = _matrix(a, "gesvd")
    need(i.hi is not None and j.hi is not None, "gesvd: a dimension is unbounded")
    wide = j.length > i.length  # then work on the transpose
    rows, cols = (j, i) if wide else (i, j)
    n = cols.length
    need(n <= SVD_SIDE, f"gesvd: the shorter side is beyond {SVD_SIDE}")
    cells = a.df.select((F.col(f"`{rows.name}`") - F.lit(rows.lo)).alias("r"), (F.col(f"`{cols.name}`") - F.lit(cols.lo)).cast("int").alias("c"), F.col(f"`{x}`").cast("double").alias("v"))
    values, vectors = np.linalg.eigh(_gram(_packed(cells), n)) if n else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values)
    sigma, v = np.sqrt(np.maximum(values[order], 0)), vectors[:, order]
    if n:
        v = v * np.where(v[np.argmax(np.abs(v), axis=0), np.arange(n)] < 0, -1.0, 1.0)
    k = Dim("i", 0, n - 1, max(1, min(n, i.chunk)))
    spark = a.spark
    s = ArrayFrame(spark.createDataFrame([(p, float(y)) for p, y in enumerate(sigma)], "i bigint, sigma double"), ArraySchema((Attr("sigma", "double"),), (k,), a.schema.name))
    short = spark.createDataFrame([(p + cols.lo, q, float(v[p, q])) for p in range(n) for q in range(n)], "p bigint, q bigint, x double")
    keep = [q for q in range(n) if sigma[q] > 1e-12 * max(sigma[0], 1e-300)]
    long = row_product(cells, v[:, keep] / sigma[keep], keep).select((F.col("r") + F.lit(rows.lo)).alias("p"), "q", "x")

    def factor(df: DataFrame, side: Dim, name: str) -> ArrayFrame:
        d = Dim(fresh("i", [side.name]), 0, n - 1, k.chunk)
        dims = (side, d) if name == "u" else (d, side)
        columns = {side.name: "p", d.name: "q"}
        return ArrayFrame(df.select(*(F.col(columns[z.name]).alias(z.name) for z in dims), F.col("x").alias(name)), ArraySchema((Attr(name, "double"),), dims, a.schema.name))

    left, right = (short, long) if wide else (long, short)
    return factor(left, i, "u"), s, factor(right, j, "v")


@register_op("gesvd", "gesvd(matrix, 'U'|'S'|'VT')", "linear algebra")
def gesvd(a: ArrayFrame, factor: str) -> ArrayFrame:
    """One factor of the singular value decomposition; absent cells count as 0.

    The Gram matrix of the shorter side (at most SVD_SIDE) is summed in Spark and solved on the
    driver; the other side's vectors are a distributed product with it. Each pair of vectors has the
    sign that makes the largest component of the shorter side's positive.
    """
    which = factor.strip("'\"").upper()
    need(which in ("U", "S", "VT", "LEFT", "VALUES", "RIGHT"), "gesvd: the factor is U, S or VT")
    return svd(a)[{"U": 0, "LEFT": 0, "S": 1, "VALUES": 1}.get(which, 2)]
