"""Array literals and the text formats: dense ``[[(1),()],[..]]``, sparse ``{0,1}(2)``, and delimited ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..schema import FLOATS, INTEGERS, TYPES, ArrayError, ArraySchema, need, parse_schema

_TOKEN = re.compile(r"\s*(?:(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|([\[\]{}(),;])|([^\s\[\]{}(),;\"']+))")


def _scan(text: str) -> list[str]:
    out, i, text = [], 0, text.strip()
    while i < len(text):
        m = _TOKEN.match(text, i)
        if not m:
            raise ArrayError(f"bad array literal at {text[i : i + 20]!r}")
        out.append(m.group().strip())
        i = m.end()
    return out


def value(token: str | None, kind: str) -> object:
    """A literal's value; null, ?code and nothing are None."""
    if token is None or token.lower() == "null" or re.fullmatch(r"\?\d*", token):
        return None
    if token[0] in "\"'":
        return re.sub(r"\\(.)", r"\1", token[1:-1])
    if kind == "bool":
        need(token.lower() in ("true", "false"), f"{token!r} isn't a bool")
        return token.lower() == "true"
    if kind in INTEGERS:
        return int(token)
    if kind in FLOATS:
        return float(token)
    return token


def cells(text: str, s: ArraySchema) -> Iterator[tuple[tuple[int, ...], tuple]]:
    """(coordinates, values) of a dense or sparse literal."""
    t, i, n = _scan(text), 0, len(s.dims)
    kinds = [a.type for a in s.attrs]

    def cell() -> tuple | None:
        nonlocal i
        if t[i] != "(":
            i += 1
            return (value(t[i - 1], kinds[0]),)
        i += 1
        vs: list[str | None] = []
        while t[i] != ")":
            if t[i] == ",":
                need(t[i + 1] != ")" or len(vs) < len(kinds), "bad cell")
                i += 1
                continue
            vs.append(t[i])
            i += 1
        i += 1
        if not vs:
            return None
        need(len(vs) == len(kinds), f"a cell has {len(vs)} values, not {len(kinds)}")
        return tuple(value(v, k) for v, k in zip(vs, kinds))

    at = [d.lo for d in s.dims]
    base = list(at)
    depth = 0
    while i < len(t):
        x = t[i]
        if x == "[":
            depth += 1
            if depth <= n:
                at[depth - 1] = base[depth - 1]
            i += 1
        elif x == "]":
            depth -= 1
            i += 1
        elif x == ",":
            if 0 < depth <= n:
                at[depth - 1] += 1
            i += 1
        elif x == ";":
            # the next chunk begins where its {coordinates} say
            depth, i = 0, i + 1
        elif x == "{":
            i += 1
            got = []
            while t[i] != "}":
                if t[i] != ",":
                    got.append(int(t[i]))
                i += 1
            i += 1
            need(len(got) == n, "coordinates don't fit the dimensions")
            at = list(got)
            if depth == 0:
                base = list(got)
        else:
            v = cell()
            if v is not None:
                yield tuple(at), v


def literal(spark: SparkSession, schema: str | ArraySchema, text: str) -> ArrayFrame:
    """An array from a literal; it lies in the query's text, so it is small."""
    s = parse_schema(schema) if isinstance(schema, str) else schema
    rows = []
    for at, v in cells(text, s):
        for d, x in zip(s.dims, at):
            need(x >= d.lo and (d.hi is None or x <= d.hi), f"{d.name} = {x} lies outside {d}")
        for a, x in zip(s.attrs, v):
            need(x is not None or a.nullable, f"{a.name} may not be null")
        rows.append((*at, *v))
    return ArrayFrame.of(_frame(spark, rows, s), s)


def _frame(spark: SparkSession, rows: list[tuple], s: ArraySchema) -> DataFrame:
    text = {"datetime", "datetimetz"}
    fields = [f"`{d}` bigint" for d in s.dim_names] + [f"`{a.name}` {'string' if a.type in text else TYPES[a.type]}" for a in s.attrs]
    df = spark.createDataFrame(rows, ", ".join(fields))
    from ..functions.expr import converted

    for a in s.attrs:
        if a.type in text:
            df = df.withColumn(a.name, F.expr(converted(f"`{a.name}`", "string", a.type)))
    return df


def build(spark: SparkSession, schema: str | ArraySchema, text: str, is_literal: bool = False) -> ArrayFrame:
    """One attribute, the expression's value at every coordinate of a bounded box; or a literal."""
    from ..functions.expr import converted, sql_of

    s = parse_schema(schema) if isinstance(schema, str) else schema
    if str(is_literal).lower() == "true":
        return literal(spark, s, text)
    need(len(s.attrs) == 1, "build takes one attribute, or a literal")
    need(all(d.hi is not None for d in s.dims), "build: a dimension is unbounded")
    n, stride, cols = 1, 1, []
    for d in s.dims:
        n *= d.length
    for d in reversed(s.dims):
        cols.insert(0, F.expr(f"(id div {stride}L) % {d.length}L + {d.lo}L").alias(d.name))
        stride *= d.length
    grid = spark.range(n).select(*cols)
    only = ArraySchema((), s.dims)
    sql, kind = sql_of(text, only)
    a = s.attrs[0]
    return ArrayFrame.of(grid.withColumn(a.name, F.expr(converted(sql, kind, a.type))), s)
