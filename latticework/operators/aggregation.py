"""Aggregation by dimensions, by blocks and by new dimensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..functions.aggregates import is_aggregate, parse_aggregates
from ..plans.numbering import numbered
from ..schema import FLOATS, ArrayError, ArraySchema, Attr, Dim, bare, need, parse_schema
from .registry import register_op
from .select import missing_default


@register_op("aggregate", "aggregate(src {, agg(attr) [as name]}+ {, dim}*)", "aggregation")
def aggregate(src: ArrayFrame, *args: str) -> ArrayFrame:
    """Aggregate all cells (one cell, always) or by dimensions (groups that have cells)."""
    calls = [a for a in args if is_aggregate(a)]
    need(len(calls) > 0, "aggregate takes an aggregate call")
    by = list(dict.fromkeys(src.schema.dim(a).name for a in args if not is_aggregate(a)))
    aggs = parse_aggregates(calls, src.schema)
    cols = [a.column() for a in aggs]
    attrs = tuple(a.out for a in aggs)
    if not by:
        df = src.df.agg(*cols).select(F.lit(0).cast("bigint").alias("i"), *[f"`{a.name}`" for a in aggs])
        return ArrayFrame(df, ArraySchema(attrs, (Dim("i", 0, 0, 1),), src.schema.name))
    return ArrayFrame(src.df.groupBy(*[f"`{d}`" for d in by]).agg(*cols), ArraySchema(attrs, tuple(src.schema.dim(d) for d in by), src.schema.name))


@register_op("regrid", "regrid(src {, block}+ {, agg(attr) [as name]}+)", "aggregation")
def regrid(src: ArrayFrame, *args) -> ArrayFrame:
    """Aggregate blocks of coordinates; blocks are numbered from each dimension's start."""
    s = src.schema
    blocks = [int(a) for a in args if not is_aggregate(a)]
    need(len(blocks) == len(s.dims), "regrid takes a block size for each dimension")
    need(all(b > 0 for b in blocks), "regrid: a block size isn't positive")
    aggs = parse_aggregates([a for a in args if is_aggregate(a)], s)
    need(len(aggs) > 0, "regrid takes an aggregate call")
    keys = [(F.floor((F.col(f"`{d.name}`") - F.lit(d.lo)) / F.lit(b)).cast("bigint") + F.lit(d.lo)).alias(d.name) for d, b in zip(s.dims, blocks)]
    dims = [Dim(d.name, d.lo, None if d.hi is None else d.lo + (d.hi - d.lo) // b, d.chunk, 0) for d, b in zip(s.dims, blocks)]
    inner = {a.attr for a in aggs if a.attr}
    # values under other names, as a block's key has the name of its dimension
    df = src.df.select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in sorted(inner)])
    df = df.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(*[a.column() for a in aggs])
    return ArrayFrame(df.select(*[F.col(f"__k{i}").alias(d.name) for i, d in enumerate(dims)], *[F.col(f"`{a.name}`") for a in aggs]), ArraySchema(tuple(a.out for a in aggs), tuple(dims), s.name))


@register_op("redimension", "redimension(src, schema {, agg(attr) as name}*)", "aggregation")
def redimension(src: ArrayFrame, schema: str | ArraySchema, *calls: str, checked: bool = True) -> ArrayFrame:
    """Turn attributes into dimensions and back.

    Cells that meet at one coordinate are aggregated, or enumerated along a dimension that the
    source doesn't know (ordered by their attributes and old coordinates), or else the smallest is kept.
    Cells with a null coordinate are left out; a coordinate outside the target's bounds is an error
    at run time (``checked``), and always more cells at one coordinate than the new dimension has places.
    """
    s = src.schema
    to = parse_schema(schema) if isinstance(schema, str) else schema
    aggs = parse_aggregates(list(calls), s)
    by_name = {a.name: a for a in aggs}
    synthetic = [d for d in to.dims if d.name not in s.names]
    need(len(synthetic) <= 1, "redimension: more than one dimension isn't in the source")
    need(not (synthetic and aggs), "redimension: a synthetic dimension doesn't go with aggregates")
    for a in to.attrs:
        need(a.name in by_name or a.name in s.names, f"redimension: {a.name} isn't in the source")
        if a.name in s.attr_names and a.name not in by_name:
            need(a.nullable or not s.attr(a.name).nullable, f"redimension: {a.name} may be null in the source")
    for a in by_name:
        need(a in to.attr_names, f"redimension: {a} isn't in the target")
    for d in to.dims:
        need(d.overlap <= d.chunk, f"redimension: the overlap of {d.name} is beyond its chunk")
        if d.name in s.attr_names:
            need(s.type_of(d.name).lstrip("u").startswith("int"), f"redimension: {d.name} isn't an integer")
    real = [d for d in to.dims if d not in synthetic]
    df = src.df
    for d in real:
        c = F.col(f"`{d.name}`")
        if d.name in s.attr_names:
            df = df.where(c.isNotNull())
        outside = (c < d.lo) if d.hi is None else (c < d.lo) | (c > d.hi)
        known = d.name in s.dim_names and s.dim(d.name).lo >= d.lo and (d.hi is None or (s.dim(d.name).hi is not None and s.dim(d.name).hi <= d.hi))
        if checked and not known:
            message = F.concat(F.lit(f"redimension: {d.name} = "), c.cast("string"), F.lit(f" lies outside {d}"))
            df = df.withColumn(d.name, F.when(outside, F.raise_error(message).cast("bigint")).otherwise(c.cast("bigint")))
    keys = [F.col(f"`{d.name}`").cast("bigint") for d in real]
    plain = [a for a in to.attrs if a.name not in by_name]
    if synthetic:
        z = synthetic[0]
        w = Window.partitionBy(*keys).orderBy(*[F.col(f"`{n}`") for n in (*to.attr_names, *s.names) if n not in [d.name for d in real]])
        df = df.withColumn(z.name, F.row_number().over(w).cast("bigint") - 1 + z.lo)
        if z.hi is not None:
            c = F.col(f"`{z.name}`")
            message = F.concat(F.lit(f"redimension: {z.name} = "), c.cast("string"), F.lit(f" lies outside {z}"))
            df = df.withColumn(z.name, F.when(c > z.hi, F.raise_error(message).cast("bigint")).otherwise(c))
        return ArrayFrame.of(df, to.with_(name=to.name or s.name))
    cell = F.min(F.struct(*[F.col(f"`{a.name}`").alias(a.name) for a in plain])).alias("__cell")
    got = df.select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"`{n}`") for n in dict.fromkeys([*[a.name for a in plain], *[x.attr for x in aggs if x.attr]])])
    got = got.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(*([cell] if plain else []), *[a.column() for a in aggs], *([F.count(F.lit(1)).alias("__n")] if not plain and not aggs else []))
    cols = [F.col(f"__k{i}").alias(d.name) for i, d in enumerate(real)]
    cols += [F.col(f"`{a.name}`") if a.name in by_name else F.col(f"__cell.`{a.name}`").alias(a.name) for a in to.attrs]
    return ArrayFrame.of(got.select(*cols), to.with_(name=to.name or s.name))


@register_op("analyze", "analyze(src {, attr}*)", "aggregation")
def analyze(src: ArrayFrame, *attrs: str) -> ArrayFrame:
    """Name, least and greatest value (as text), approximate distinct count and non-null count of attributes."""
    chosen = [src.schema.attr(a).name for a in attrs] or src.schema.attr_names
    aggs = []
    for i, a in enumerate(chosen):
        c = F.col(f"`{a}`")
        aggs += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"), F.approx_count_distinct(c, 0.01).alias(f"dc{i}"), F.count(c).alias(f"n{i}")]
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("attribute_number"), F.lit(a).alias("attribute_name"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"dc{i}").cast("bigint").alias("distinct_count"), F.col(f"n{i}").cast("bigint").alias("non_null_count")) for i, a in enumerate(chosen)])
    df = src.df.agg(*aggs).select(F.inline(rows))
    out = (Attr("attribute_name", "string"), Attr("min", "string", True), Attr("max", "string", True), Attr("distinct_count", "uint64"), Attr("non_null_count", "uint64"))
    return ArrayFrame(df, ArraySchema(out, (Dim("attribute_number", 0, len(chosen) - 1, 1000),), src.schema.name))


@register_op("uniq", "uniq(sorted [, 'chunk_size=n'])", "aggregation")
def uniq(src: ArrayFrame, *options: str) -> ArrayFrame:
    """The distinct non-null values of a sorted one-dimensional array, numbered from 0."""
    s = src.schema
    need(len(s.attrs) == 1 and len(s.dims) == 1, "uniq takes one attribute and one dimension")
    need(s.dims[0].lo == 0, "uniq: the dimension starts at 0")
    a = s.attrs[0].name
    chunk = next((int(o.split("=")[1]) for o in options if o.startswith("chunk_size")), s.dims[0].chunk)
    c = F.col(f"`{a}`")
    order = [F.isnan(c).desc(), c] if s.attrs[0].type in FLOATS else [c]
    df = numbered(src.df.select(c).where(c.isNotNull()).distinct(), order, "i")
    return ArrayFrame(df.select("i", c), ArraySchema((Attr(a, s.attrs[0].type),), (Dim("i", 0, None, chunk),), s.name))


@register_op("normalize", "normalize(vector)", "aggregation")
def normalize(src: ArrayFrame) -> ArrayFrame:
    """A vector divided by its length."""
    s = src.schema
    need(len(s.attrs) == 1 and len(s.dims) == 1 and s.attrs[0].type == "double", "normalize takes a 1-d array of one double")
    v = F.col(f"`{s.attrs[0].name}`")
    total = src.df.agg(F.sqrt(F.sum(v * v)).alias("__length"))  # one row
    return src.same(src.df.crossJoin(F.broadcast(total)).withColumn(s.attrs[0].name, v / F.col("__length")))


__all__ = ["ArrayError", "bare", "missing_default"]
