"""Projection, filters and attribute changes: narrow, shuffle-free plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..functions.expr import converted, nullable, parse, sql_of
from ..schema import FLOATS, INTEGERS, TYPES, ArraySchema, Attr, Dim, bare, need, parse_schema
from .registry import register_op


@register_op("apply", "apply(src {, new_attr, expression}+)", "select")
def apply(src: ArrayFrame, *pairs: str) -> ArrayFrame:
    """Append computed attributes; each expression sees the source's attributes and dimensions."""
    need(len(pairs) >= 2 and len(pairs) % 2 == 0, "apply takes pairs of a name and an expression")
    s, cols, attrs = src.schema, [], []
    for name, text in zip(pairs[::2], pairs[1::2]):
        need(name not in s.names and name not in [a.name for a in attrs], f"duplicate attribute {name}")
        sql, t = sql_of(text, s)
        cols.append(F.expr(sql if t not in TYPES or t == "void" else f"CAST({sql} AS {TYPES[t]})").alias(name))
        attrs.append(Attr(name, t, nullable(parse(text), s)))
    return ArrayFrame(src.df.select("*", *cols), s.with_(attrs=(*s.attrs, *attrs)))


register_op("tile_apply", "tile_apply(src {, new_attr, expression}+)", "select")(apply)


@register_op("project", "project(src {, attr}+)", "select")
def project(src: ArrayFrame, *attrs: str) -> ArrayFrame:
    """Keep the listed attributes, in the given order."""
    need(len(attrs) > 0, "project takes attributes")
    return src.same(src.df, attrs=[src.schema.attr(a) for a in attrs])


@register_op("filter", "filter(src, expression)", "select")
def filter_(src: ArrayFrame, condition: str) -> ArrayFrame:
    """Keep the cells for which the condition is true."""
    sql, t = sql_of(condition, src.schema)
    need(t in ("bool", "void"), "the condition isn't a bool")
    return ArrayFrame(src.df.where(sql), src.schema)


@register_op("attribute_rename", "attribute_rename(src {, old, new}+)", "select")
def attribute_rename(src: ArrayFrame, *pairs: str) -> ArrayFrame:
    """Rename attributes."""
    need(len(pairs) >= 2 and len(pairs) % 2 == 0, "attribute_rename takes pairs of names")
    new = {src.schema.attr(o).name: n for o, n in zip(pairs[::2], pairs[1::2])}
    attrs = [Attr(new.get(a.name, a.name), a.type, a.nullable, a.default) for a in src.schema.attrs]
    return ArrayFrame(src.df.withColumnsRenamed(new), src.schema.with_(attrs=attrs))


@register_op("cast", "cast(src, schema)", "select")
def cast(src: ArrayFrame, schema: str | ArraySchema) -> ArrayFrame:
    """Rename attributes and dimensions by position, convert types, relax nullability, change open bounds."""
    to, s = parse_schema(schema) if isinstance(schema, str) else schema, src.schema
    need(len(to.attrs) == len(s.attrs), "cast: another number of attributes")
    need(len(to.dims) == len(s.dims), "cast: another number of dimensions")
    for a, b in zip(s.attrs, to.attrs):
        need(b.nullable or not a.nullable, f"cast: {a.name} may be null, {b.name} may not")
    for d, e in zip(s.dims, to.dims):
        need(d.lo == e.lo and (d.hi == e.hi or e.hi is None or d.hi is None), f"cast: bounds of {d.name} and {e.name} differ")
    cols = [F.col(f"`{d.name}`").alias(e.name) for d, e in zip(s.dims, to.dims)]
    cols += [F.expr(converted(f"`{a.name}`", a.type, b.type)).alias(b.name) for a, b in zip(s.attrs, to.attrs)]
    return ArrayFrame(src.df.select(*cols), to.with_(name=s.name))


@register_op("substitute", "substitute(src, subst {, attr}*)", "select")
def substitute(src: ArrayFrame, subst: ArrayFrame, *attrs: str) -> ArrayFrame:
    """Replace nulls by the value that ``subst`` holds for their missing reason (0 for a plain null)."""
    q, s = subst.schema, src.schema
    need(len(q.dims) == 1 and q.dims[0].lo == 0 and len(q.attrs) == 1 and not q.attrs[0].nullable, "substitute: a 1-d array from 0 with one attribute that isn't nullable is needed")
    kind = q.attrs[0].type
    chosen = [s.attr(a) for a in attrs] or [a for a in s.attrs if a.nullable]
    for a in chosen:
        need(a.type == kind, f"substitute: {a.name} is {a.type}, not {kind}")
    value = subst.df.where(F.col(f"`{q.dims[0].name}`") == 0).agg(F.first(f"`{q.attrs[0].name}`").alias("__subst"))  # one row
    df = src.df.crossJoin(F.broadcast(value))
    names = {a.name for a in chosen}
    df = df.select(*src.cols(*s.dim_names), *[(F.coalesce(f"`{a}`", "__subst") if a in names else F.col(f"`{a}`")).alias(a) for a in s.attr_names])
    return ArrayFrame(df, s.with_(attrs=[Attr(a.name, a.type, False, a.default) if a.name in names else a for a in s.attrs]))


def missing_default(a: Attr) -> str:
    """SQL of an attribute's value where none is given: its default, null, or the type's zero."""
    if a.default is not None:
        return sql_of(a.default, ArraySchema((), (Dim("__"),)))[0]
    if a.nullable:
        return "NULL"
    return "0" if a.type in INTEGERS + FLOATS else "false" if a.type == "bool" else "''"


@register_op("bernoulli", "bernoulli(src, probability [, seed])", "select")
def bernoulli(src: ArrayFrame, p: float, seed: int = 0) -> ArrayFrame:
    """Keep each cell with the given chance; the seed and the coordinates decide, however the rows are partitioned."""
    p = float(p)
    need(0 <= p <= 1, "bernoulli: the probability lies in [0, 1]")
    coin = F.pmod(F.xxhash64(*src.cols(*src.schema.dim_names), F.lit(int(seed))), F.lit(1 << 53))
    return ArrayFrame(src.df.where(coin < F.lit(int(p * (1 << 53)))), src.schema)


@register_op("sample", "sample(src, probability [, seed])", "select")
def sample(src: ArrayFrame, p: float, seed: int = 0) -> ArrayFrame:
    """Keep whole chunks with the given chance."""
    from ..frame import chunk_of

    coin = F.pmod(F.xxhash64(*[chunk_of(d) for d in src.schema.dims], F.lit(int(seed))), F.lit(1 << 53))
    return ArrayFrame(src.df.where(coin < F.lit(int(float(p) * (1 << 53)))), src.schema)


def plain(name: str) -> str:
    return bare(name)
