"""Joins of arrays: on all dimensions, on pairs of dimensions, and by value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..schema import ArraySchema, Attr, Dim, fresh, need
from .registry import register_op


def _meet(a: Dim, b: Dim) -> Dim:
    hi = b.hi if a.hi is None else a.hi if b.hi is None else min(a.hi, b.hi)
    return Dim(a.name, max(a.lo, b.lo), hi, a.chunk, a.overlap)


@register_op("join", "join(left, right)", "join")
def join(left: ArrayFrame, right: ArrayFrame) -> ArrayFrame:
    """Cells of both arrays at equal coordinates; clashing names on the right get a suffix _2."""
    a, b = left.schema, right.schema
    need(len(a.dims) == len(b.dims), "join: the arrays have different numbers of dimensions")
    for d, e in zip(a.dims, b.dims):
        need(d.lo == e.lo, f"join: {d.name} and {e.name} start differently")
    names, taken = [], list(a.names)
    for x in b.attr_names:
        names.append(fresh(x, taken))
        taken.append(names[-1])
    r = right.df.select(*[F.col(f"`{e}`").alias(d) for d, e in zip(a.dim_names, b.dim_names)], *[F.col(f"`{x}`").alias(n) for x, n in zip(b.attr_names, names)])
    attrs = (*a.attrs, *(Attr(n, x.type, x.nullable) for n, x in zip(names, b.attrs)))
    s = ArraySchema(attrs, tuple(map(_meet, a.dims, b.dims)), a.name)
    return ArrayFrame(left.df.join(r, a.dim_names).select(*left.cols(*s.names)), s)


@register_op("cross_join", "cross_join(left, right {, left_dim, right_dim}*)", "join")
def cross_join(left: ArrayFrame, right: ArrayFrame, *pairs: str) -> ArrayFrame:
    """Join on the paired dimensions; the right array's other dimensions are appended.

    Without a pair it is the product, whose size is the product of the sizes.
    """
    a, b = left.schema, right.schema
    need(len(pairs) % 2 == 0, "cross_join: dimensions come in pairs")
    on = [(a.dim(x), b.dim(y)) for x, y in zip(pairs[::2], pairs[1::2])]
    need(len({y.name for _, y in on}) == len(on) and len({x.name for x, _ in on}) == len(on), "cross_join: a dimension is joined twice")
    for x, y in on:
        need(x.lo == y.lo, f"cross_join: {x.name} and {y.name} start differently")
    used = {y.name for _, y in on}
    taken, new, dims, attrs = list(a.names), {}, list(a.dims), list(a.attrs)
    for d in b.dims:
        if d.name not in used:
            new[d.name] = fresh(d.name, taken)
            taken.append(new[d.name])
            dims.append(Dim(new[d.name], d.lo, d.hi, d.chunk, d.overlap))
    for x in b.attrs:
        new[x.name] = fresh(x.name, taken)
        taken.append(new[x.name])
        attrs.append(Attr(new[x.name], x.type, x.nullable))
    r = right.df.select(*[F.col(f"`{y.name}`").alias(f"__j{i}") for i, (_, y) in enumerate(on)], *[F.col(f"`{k}`").alias(v) for k, v in new.items()])
    cond = [left.df[f"`{x.name}`"] == r[f"__j{i}"] for i, (x, _) in enumerate(on)]
    df = left.df.join(r, cond, "inner") if cond else left.df.crossJoin(r)
    narrowed = {x.name: _meet(x, y) for x, y in on}
    s = ArraySchema(tuple(attrs), tuple(narrowed.get(d.name, d) for d in dims), a.name)
    return ArrayFrame(df.select(*left.cols(*s.names)), s)


def _hull(a: Dim, b: Dim) -> Dim:
    return Dim(a.name, min(a.lo, b.lo), None if a.hi is None or b.hi is None else max(a.hi, b.hi), a.chunk, a.overlap)


@register_op("merge", "merge(left, right {, more}*)", "join")
def merge(first: ArrayFrame, *rest: ArrayFrame) -> ArrayFrame:
    """All cells of all arrays; where several have one, the first array's whole cell.

    One aggregation over the union: the smallest (array number, cell) at each coordinate, combined before the shuffle.
    """
    need(len(rest) > 0, "merge takes two arrays or more")
    a, parts, dims = first.schema, [], list(first.schema.dims)
    null = [x.nullable for x in a.attrs]
    for i, x in enumerate((first, *rest)):
        s = x.schema
        need(len(s.dims) == len(a.dims) and len(s.attrs) == len(a.attrs), "merge: dimensions or attributes differ in number")
        for d, e in zip(a.dims, s.dims):
            need(d.lo == e.lo, f"merge: {d.name} and {e.name} start differently")
        for p, q in zip(a.attrs, s.attrs):
            need(p.type == q.type, f"merge: {p.name} is {p.type}, {q.name} is {q.type}")
        dims, null = list(map(_hull, dims, s.dims)), [m or q.nullable for m, q in zip(null, s.attrs)]
        cell = F.struct(F.lit(i).alias("__no"), *[F.col(f"`{q}`").alias(p) for p, q in zip(a.attr_names, s.attr_names)])
        parts.append(x.df.select(*[F.col(f"`{e}`").alias(d) for d, e in zip(a.dim_names, s.dim_names)], cell.alias("__cell")))
    df = reduce(lambda p, q: p.unionByName(q), parts).groupBy(*a.dim_names).agg(F.min_by("__cell", F.col("__cell.__no")).alias("__cell"))
    attrs = [Attr(x.name, x.type, n) for x, n in zip(a.attrs, null)]
    return ArrayFrame(df.select(*first.cols(*a.dim_names), *[F.col(f"__cell.`{n}`").alias(n) for n in a.attr_names]), a.with_(dims=dims, attrs=attrs))


@register_op("index_lookup", "index_lookup(src, index, attr [, name] [, 'memory_limit=MB'])", "join")
def index_lookup(src: ArrayFrame, index: ArrayFrame, attr: str, *options: str) -> ArrayFrame:
    """Append the coordinate at which the index holds the attribute's value; null without a match."""
    a, i = src.schema.attr(attr), index.schema
    need(len(i.dims) == 1 and len(i.attrs) == 1, "index_lookup: the index has one dimension and one attribute")
    need(i.attrs[0].type == a.type, f"index_lookup: {a.name} is {a.type}, the index {i.attrs[0].type}")
    need(not i.attrs[0].nullable, "index_lookup: the index may not be nullable")
    name = next((o for o in options if "=" not in o), f"{a.name}_index")
    need(name not in src.schema.names, f"duplicate attribute {name}")
    # equal values of an index that isn't unique give the smallest coordinate
    d = index.df.groupBy(F.col(f"`{i.attrs[0].name}`").alias("__value")).agg(F.min(f"`{i.dims[0].name}`").alias(name))
    df = src.df.join(d, F.col(f"`{a.name}`") == F.col("__value"), "left")
    s = src.schema.with_(attrs=(*src.schema.attrs, Attr(name, "int64", True)))
    return ArrayFrame(df.select(*src.cols(*s.names)), s)
