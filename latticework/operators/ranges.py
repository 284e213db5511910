"""Selection by coordinates. Bounds become filters that reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..schema import ArraySchema, Dim, need
from .registry import register_op


def _bounds(s: ArraySchema, values: tuple) -> tuple[list[int | None], list[int | None]]:
    n = len(s.dims)
    need(len(values) == 2 * n, f"{2 * n} bounds are needed, a low and a high for each dimension")
    v = [None if x is None or str(x).strip().lower() in ("null", "?") else int(x) for x in values]
    return v[:n], v[n:]


def _inside(s: ArraySchema, lo: list[int | None], hi: list[int | None]) -> Column:
    keep = F.lit(True)
    for d, a, b in zip(s.dims, lo, hi):
        c = F.col(f"`{d.name}`")
        keep = keep & (c >= a if a is not None else F.lit(True)) & (c <= b if b is not None else F.lit(True))
    return keep


@register_op("between", "between(src {, low}+ {, high}+)", "range")
def between(src: ArrayFrame, *bounds) -> ArrayFrame:
    """Keep the cells in an inclusive box; null leaves a side open; the shape stays."""
    return ArrayFrame(src.df.where(_inside(src.schema, *_bounds(src.schema, bounds))), src.schema)


@register_op("subarray", "subarray(src {, low}+ {, high}+)", "range")
def subarray(src: ArrayFrame, *bounds) -> ArrayFrame:
    """The cells in a box, re-based to start at 0."""
    s = src.schema
    lo, hi = _bounds(s, bounds)
    lo = [max(d.lo, a) if a is not None else d.lo for d, a in zip(s.dims, lo)]
    hi = [d.hi if b is None else b if d.hi is None else min(d.hi, b) for d, b in zip(s.dims, hi)]
    df = src.df.where(_inside(s, lo, hi)).select(*[(F.col(f"`{d}`") - F.lit(a)).alias(d) for d, a in zip(s.dim_names, lo)], *src.cols(*s.attr_names))
    dims = [Dim(d.name, 0, None if b is None else max(b - a, -1), d.chunk, d.overlap) for d, a, b in zip(s.dims, lo, hi)]
    return ArrayFrame(df, s.with_(dims=dims))


@register_op("cross_between", "cross_between(src, ranges)", "range")
def cross_between(src: ArrayFrame, ranges: ArrayFrame) -> ArrayFrame:
    """Keep the cells that lie in any of the ranges (low of each dimension, then high).

    A range on the first dimension is put on a grid of its own power of two, where it
    meets at most two places; a cell asks each grid in use. So this is an equi-join on
    (grid, place), never a nested loop, whatever the number of ranges.
    """
    s, n = src.schema, len(src.schema.dims)
    a = ranges.schema.attrs
    need(len(a) == 2 * n, f"cross_between: {2 * n} attributes are needed in the ranges")
    need(all(x.type == "int64" for x in a), "cross_between: ranges are of int64")
    r = ranges.df.select(*[F.col(f"`{x.name}`").alias(f"__{'lo' if i < n else 'hi'}{i % n}") for i, x in enumerate(a)])
    for i in range(n):
        r = r.where(f"__lo{i} <= __hi{i}")
    grid = F.ceil(F.log2((F.col("__hi0") - F.col("__lo0") + 1).cast("double"))).cast("int")
    r = r.withColumn("__grid", grid)
    place = F.explode(F.expr("sequence(shiftright(__lo0, __grid), shiftright(__hi0, __grid))"))
    r = r.withColumn("__place", place)
    grids = sorted(x[0] for x in r.select("__grid").distinct().collect())  # at most 64
    cells = src.df.withColumn("__grid", F.explode(F.array(*[F.lit(g) for g in grids]) if grids else F.expr("cast(array() as array<int>)")))
    cells = cells.withColumn("__place", F.expr(f"shiftright(`{s.dims[0].name}`, __grid)"))
    inside = (cells["__grid"] == r["__grid"]) & (cells["__place"] == r["__place"])
    for i, d in enumerate(s.dim_names):
        inside = inside & (cells[f"`{d}`"] >= r[f"__lo{i}"]) & (cells[f"`{d}`"] <= r[f"__hi{i}"])
    found = cells.join(r, inside, "left_semi").drop("__grid", "__place")
    # a cell may lie in ranges of several grids
    return ArrayFrame(found.dropDuplicates(s.dim_names) if len(grids) > 1 else found, s)


@register_op("slice", "slice(src {, dim, value}*)", "range")
def slice_(src: ArrayFrame, *pairs) -> ArrayFrame:
    """Fix dimensions to values and drop them."""
    need(len(pairs) % 2 == 0, "slice takes pairs of a dimension and a value")
    fixed = [(src.schema.dim(d).name, int(v)) for d, v in zip(pairs[::2], pairs[1::2])]
    need(len({d for d, _ in fixed}) == len(fixed), "slice: a dimension is given twice")
    need(len(fixed) < len(src.schema.dims), "slice: a dimension has to stay")
    keep = F.lit(True)
    for d, v in fixed:
        keep = keep & (F.col(f"`{d}`") == v)
    return src.same(src.df.where(keep), dims=[d for d in src.schema.dims if d.name not in dict(fixed)])


@register_op("thin", "thin(src {, start, step}+)", "range")
def thin(src: ArrayFrame, *pairs) -> ArrayFrame:
    """Every step-th coordinate from start, re-numbered from 0."""
    s = src.schema
    need(len(pairs) == 2 * len(s.dims), "thin takes a start and a step for each dimension")
    keep, cols, dims = F.lit(True), [], []
    for d, start, step in zip(s.dims, map(int, pairs[::2]), map(int, pairs[1::2])):
        need(step > 0, f"thin: the step of {d.name} isn't positive")
        need(start >= d.lo, f"thin: the start of {d.name} lies before it")
        need(start - d.lo < step, f"thin: the start of {d.name} lies beyond its first step")
        need(d.chunk >= step, f"thin: the step of {d.name} is beyond its chunk")
        need(d.chunk % step == 0, f"thin: the step of {d.name} doesn't divide its chunk")
        c = F.col(f"`{d.name}`")
        keep = keep & (c >= start) & ((c - F.lit(start)) % step == 0)
        cols.append(F.expr(f"(`{d.name}` - {start}) div {step}").alias(d.name))
        dims.append(Dim(d.name, 0, None if d.hi is None else (d.hi - start) // step, max(1, d.chunk // step), 0))
    return ArrayFrame(src.df.where(keep).select(*cols, *src.cols(*s.attr_names)), s.with_(dims=dims))


@register_op("lookup", "lookup(pattern, src)", "range")
def lookup(pattern: ArrayFrame, src: ArrayFrame) -> ArrayFrame:
    """For each cell of the pattern, the source's cell at the coordinates that its attributes name."""
    p, s = pattern.schema, src.schema
    need(len(p.attrs) == len(s.dims), "lookup: an attribute is needed for each dimension of the source")
    q = pattern.df.select(*[F.col(f"`{d}`").alias(f"__p{i}") for i, d in enumerate(p.dim_names)], *[F.col(f"`{a.name}`").cast("bigint").alias(f"__k{i}") for i, a in enumerate(p.attrs)])
    t = src.df.select(*[F.col(f"`{d}`").alias(f"__k{i}") for i, d in enumerate(s.dim_names)], *src.cols(*s.attr_names))
    df = q.join(t, [f"__k{i}" for i in range(len(s.dims))])
    return ArrayFrame(df.select(*[F.col(f"__p{i}").alias(d) for i, d in enumerate(p.dim_names)], *src.cols(*s.attr_names)), ArraySchema(s.attrs, p.dims, s.name))
