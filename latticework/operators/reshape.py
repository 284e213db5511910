"""Changes of shape: arithmetic on coordinates, mostly without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import ArrayFrame, chunk_of
from ..plans.numbering import numbered
from ..schema import ArraySchema, Attr, Dim, fresh, need, parse_schema
from .registry import register_op


def _closed(s: ArraySchema, op: str) -> None:
    need(all(d.hi is not None for d in s.dims), f"{op}: a dimension is unbounded")


@register_op("unpack", "unpack(src, dim [, chunk])", "reshape")
def unpack(src: ArrayFrame, name: str, chunk: int = 1_000_000) -> ArrayFrame:
    """Coordinates become attributes, cells are numbered chunk by chunk, row-major within a chunk."""
    s = src.schema
    need(name not in s.names, f"unpack: {name} is taken")
    df = numbered(src.df, [*[chunk_of(d) for d in s.dims], *src.cols(*s.dim_names)], name)
    attrs = (*[Attr(d, "int64") for d in s.dim_names], *s.attrs)
    hi = None if any(d.hi is None for d in s.dims) else _cells(s) - 1
    out = ArraySchema(attrs, (Dim(name, 0, hi, int(chunk)),), s.name)
    return ArrayFrame(df.select(*[F.col(f"`{c}`") for c in out.names]), out)


def _cells(s: ArraySchema) -> int:
    n = 1
    for d in s.dims:
        n *= d.length
    return n


def _linear(s: ArraySchema) -> Column:
    at = F.lit(0).cast("bigint")
    for d in s.dims:
        at = at * F.lit(d.length) + (F.col(f"`{d.name}`") - F.lit(d.lo))
    return at


@register_op("old_unpack", "old_unpack(src, dim)", "reshape")
def old_unpack(src: ArrayFrame, name: str) -> ArrayFrame:
    """Coordinates become attributes; the new coordinate is the cell's row-major place, gaps kept."""
    s = src.schema
    _closed(s, "old_unpack")
    need(name not in s.names, f"old_unpack: {name} is taken")
    out = ArraySchema((*[Attr(d, "int64") for d in s.dim_names], *s.attrs), (Dim(name, 0, _cells(s) - 1),), s.name)
    return ArrayFrame(src.df.select(_linear(s).alias(name), *src.cols(*s.names)), out)


@register_op("unfold", "unfold(src)", "reshape")
def unfold(src: ArrayFrame) -> ArrayFrame:
    """Attributes of one type become a dimension."""
    s = src.schema
    need(len({a.type for a in s.attrs}) == 1, "unfold: attributes have different types")
    d, v = fresh(f"unfold_{len(s.dims)}", s.names), s.attrs[0].name
    df = src.df.select(*src.cols(*s.dim_names), F.posexplode(F.array(*src.cols(*s.attr_names))).alias("__p", "__value"))
    out = ArraySchema((Attr(v, s.attrs[0].type, True),), (*s.dims, Dim(d, 0, len(s.attrs) - 1, len(s.attrs))), s.name)
    return ArrayFrame(df.select(*src.cols(*s.dim_names), F.col("__p").cast("bigint").alias(d), F.col("__value").alias(out.attrs[0].name)), out)


@register_op("reshape", "reshape(src, schema)", "reshape")
def reshape(src: ArrayFrame, schema: str | ArraySchema) -> ArrayFrame:
    """The same cells, row by row, in other dimensions of the same total size."""
    to, s = parse_schema(schema) if isinstance(schema, str) else schema, src.schema
    _closed(s, "reshape")
    _closed(to, "reshape")
    need(_cells(s) == _cells(to), "reshape: another number of cells")
    need(len(to.attrs) == len(s.attrs), "reshape: another number of attributes")
    df = src.df.withColumn("__at", _linear(s))
    stride, cols = 1, []
    for d in reversed(to.dims):
        cols.insert(0, F.expr(f"(__at div {stride}L) % {d.length}L + {d.lo}L").alias(d.name))
        stride *= d.length
    return ArrayFrame(df.select(*cols, *[F.col(f"`{a.name}`").alias(b.name) for a, b in zip(s.attrs, to.attrs)]), to.with_(name=s.name, attrs=[Attr(b.name, a.type, a.nullable) for a, b in zip(s.attrs, to.attrs)]))


@register_op("repart", "repart(src, schema)", "reshape")
def repart(src: ArrayFrame, schema: str | ArraySchema) -> ArrayFrame:
    """Other chunk sizes and overlaps; rows of one chunk come into one partition."""
    to, s = parse_schema(schema) if isinstance(schema, str) else schema, src.schema
    need(len(to.dims) == len(s.dims), "repart: another number of dimensions")
    for d, e in zip(s.dims, to.dims):
        need(d.lo == e.lo, f"repart: {d.name} starts differently")
    dims = [Dim(d.name, d.lo, d.hi, e.chunk, e.overlap) for d, e in zip(s.dims, to.dims)]
    return ArrayFrame(src.df.repartition(*[chunk_of(d) for d in dims]), s.with_(dims=dims))


@register_op("transpose", "transpose(src)", "reshape")
def transpose(src: ArrayFrame) -> ArrayFrame:
    """Dimensions in reverse order."""
    return src.same(src.df, dims=list(reversed(src.schema.dims)))


@register_op("reverse", "reverse(src)", "reshape")
def reverse(src: ArrayFrame) -> ArrayFrame:
    """Each coordinate mirrored in its bounds."""
    src = src.bounded()
    s = src.schema
    return ArrayFrame(src.df.select(*[(F.lit(d.lo + d.hi) - F.col(f"`{d.name}`")).alias(d.name) for d in s.dims], *src.cols(*s.attr_names)), s)


@register_op("adddim", "adddim(src, name)", "reshape")
def adddim(src: ArrayFrame, name: str) -> ArrayFrame:
    """A new first dimension with the one coordinate 0."""
    need(name not in src.schema.names, f"adddim: {name} is taken")
    return src.same(src.df.withColumn(name, F.lit(0).cast("bigint")), dims=[Dim(name, 0, 0, 1), *src.schema.dims])


@register_op("deldim", "deldim(src)", "reshape")
def deldim(src: ArrayFrame) -> ArrayFrame:
    """Drop the first dimension, which has length 1."""
    d = src.schema.dims
    need(len(d) > 1, "deldim: it is the only dimension")
    need(d[0].length == 1, f"deldim: {d[0].name} doesn't have length 1")
    return src.same(src.df, dims=d[1:])


@register_op("concat", "concat(left, right)", "reshape")
def concat(left: ArrayFrame, right: ArrayFrame) -> ArrayFrame:
    """The right array's cells after the left's, along the first dimension."""
    a, b = left.schema, right.schema
    need(a.dims[0].hi is not None, "concat: the first dimension is unbounded")
    need(len(a.dims) == len(b.dims) and len(a.attrs) == len(b.attrs), "concat: dimensions or attributes differ in number")
    for d, e in zip(a.dims[1:], b.dims[1:]):
        need(d.lo == e.lo and d.hi == e.hi, f"concat: {d.name} and {e.name} differ")
    for x, y in zip(a.attrs, b.attrs):
        need(x.type == y.type, f"concat: {x.name} is {x.type}, {y.name} is {y.type}")
    d, e = a.dims[0], b.dims[0]
    move = d.hi + 1 - e.lo
    r = right.df.select((F.col(f"`{e.name}`") + F.lit(move)).alias(d.name), *[F.col(f"`{y}`").alias(x) for x, y in zip(a.names[1:], b.names[1:])])
    hi = None if e.hi is None else e.hi + move
    attrs = [Attr(x.name, x.type, x.nullable or y.nullable) for x, y in zip(a.attrs, b.attrs)]
    return ArrayFrame(left.df.unionByName(r), a.with_(attrs=attrs, dims=[Dim(d.name, d.lo, hi, d.chunk, d.overlap), *a.dims[1:]]))


@register_op("xgrid", "xgrid(src {, scale}+)", "reshape")
def xgrid(src: ArrayFrame, *scales) -> ArrayFrame:
    """Each cell repeated scale times along each dimension."""
    s = src.schema
    _closed(s, "xgrid")
    need(len(scales) == len(s.dims), "xgrid takes a scale for each dimension")
    df, dims = src.df, []
    for d, k in zip(s.dims, map(int, scales)):
        need(k > 0, f"xgrid: the scale of {d.name} isn't positive")
        if k > 1:
            at = F.expr(f"{d.lo} + (`{d.name}` - {d.lo}) * {k}L")
            df = df.withColumn("__o", F.explode(F.expr(f"sequence(0L, {k - 1}L)"))).withColumn(d.name, at + F.col("__o")).drop("__o")
        dims.append(Dim(d.name, d.lo, d.lo + d.length * k - 1, d.chunk * k, 0))
    return src.same(df, dims=dims)
