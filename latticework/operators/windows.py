"""Moving windows, running aggregates, ranks and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..functions.aggregates import is_aggregate, parse_aggregates
from ..plans.numbering import numbered
from ..plans.prefix import blocked, totals_before
from ..schema import FLOATS, ArraySchema, Attr, Dim, need
from .registry import register_op


@register_op("window", "window(src {, before, after}+ {, agg(attr) [as name]}+ [, 'materialize'|'probe'])", "window")
def window(src: ArrayFrame, *args) -> ArrayFrame:
    """Aggregate the box of coordinates around each cell.

    All dimensions but the last are handled by sending each cell to the lines that see it
    (a copy per offset), the last by a range frame within a line, cut into overlapping blocks.
    """
    s = src.schema
    calls = [a for a in args if is_aggregate(a)]
    methods = [a for a in args if isinstance(a, str) and a.strip("'\" ") in ("materialize", "probe")]
    sizes = [int(a) for a in args if a not in calls and a not in methods]
    need(len(sizes) == 2 * len(s.dims), "window takes a preceding and a following count for each dimension")
    need(all(x >= 0 for x in sizes), "window: a count is negative")
    need(any(x > 0 for x in sizes), "window: the window has one cell only")
    need(len(calls) > 0, "window takes an aggregate call")
    aggs = parse_aggregates(calls, s)
    pairs = list(zip(sizes[::2], sizes[1::2]))
    df = src.df.select(*src.cols(*s.dim_names), *[F.col(f"`{a}`").alias(f"__v_{a}") for a in s.attr_names if a in {x.attr for x in aggs}]).withColumn("__here", F.lit(True))
    for d, (before, after) in zip(s.dims[:-1], pairs[:-1]):
        # a cell at x counts for the lines x - after .. x + before
        if before or after:
            df = df.withColumn("__o", F.explode(F.array(*[F.lit(o) for o in range(-after, before + 1)])))
            df = df.withColumn("__here", F.col("__here") & (F.col("__o") == 0)).withColumn(d.name, F.col(f"`{d.name}`") + F.col("__o")).drop("__o")
    last, (before, after) = s.dims[-1].name, pairs[-1]
    df = blocked(df, last, before, after)
    w = Window.partitionBy("__block", *[f"`{d.name}`" for d in s.dims[:-1]]).orderBy(f"`{last}`").rangeBetween(-before, after)
    cols = [a.column(lambda c: c.over(w), F.col(f"`__v_{a.attr}`") if a.attr else None) for a in aggs]
    df = df.select(*src.cols(*s.dim_names), "__here", "__own", *cols).where("__here and __own")
    return ArrayFrame(df.select(*src.cols(*s.dim_names), *[f"`{a.name}`" for a in aggs]), ArraySchema(tuple(a.out for a in aggs), s.dims, s.name))


@register_op("variable_window", "variable_window(src, dim, before, after {, agg(attr) [as name]}+)", "window")
def variable_window(src: ArrayFrame, dim: str, before, after, *calls: str) -> ArrayFrame:
    """Aggregate a number of non-empty cells before and after each cell along a dimension.

    A count of None (unbound) leaves the frame open. Without other dimensions the cells are
    numbered first, and the window is cut into overlapping blocks of numbers.
    """
    s, d = src.schema, src.schema.dim(dim).name
    aggs = parse_aggregates(list(calls), s)
    need(len(aggs) > 0, "variable_window takes an aggregate call")
    before, after = (None if x is None or str(x).lower() in ("unbound", "null") else int(x) for x in (before, after))
    need(all(x is None or x >= 0 for x in (before, after)), "variable_window: a count is negative")
    others = [x for x in s.dim_names if x != d]
    if others or before is None or after is None:
        w = Window.partitionBy(*[f"`{x}`" for x in others]).orderBy(f"`{d}`").rowsBetween(Window.unboundedPreceding if before is None else -before, Window.unboundedFollowing if after is None else after)
        df = src.df.select(*src.cols(*s.dim_names), *[a.column(lambda c: c.over(w)) for a in aggs])
    else:
        df = blocked(numbered(src.df, [F.col(f"`{d}`")], "__n"), "__n", before, after)
        w = Window.partitionBy("__block").orderBy("__n").rowsBetween(-before, after)
        df = df.select(*src.cols(*s.dim_names), "__own", *[a.column(lambda c: c.over(w)) for a in aggs]).where("__own").drop("__own")
    return ArrayFrame(df, ArraySchema(tuple(a.out for a in aggs), s.dims, s.name))


@register_op("cumulate", "cumulate(src {, agg(attr) [as name]}+ [, dim])", "window")
def cumulate(src: ArrayFrame, *args: str) -> ArrayFrame:
    """Running aggregates along a dimension (the first by default), over non-empty cells.

    Along the only dimension, sum, count and avg are prefix totals over range partitions;
    other functions there use a single ordered window.
    """
    s = src.schema
    calls, rest = [a for a in args if is_aggregate(a)], [a for a in args if not is_aggregate(a)]
    need(len(rest) <= 1 and len(calls) > 0, "cumulate takes aggregate calls and at most one dimension")
    d = s.dim(rest[0]).name if rest else s.dim_names[0]
    aggs = parse_aggregates(calls, s)
    others = [x for x in s.dim_names if x != d]
    out = ArraySchema(tuple(a.out for a in aggs), s.dims, s.name)
    if not others and all(a.fn in ("sum", "count", "avg") and a.type not in ("string", "char") for a in aggs):
        df = src.df
        for i, a in enumerate(aggs):
            v = F.col(f"`{a.attr}`") if a.attr else F.lit(1)
            wide = "bigint" if a.out.type in ("int64", "uint64") and a.fn == "sum" else "double"
            df = df.withColumn(f"__s{i}", F.coalesce(v.cast(wide), F.lit(0).cast(wide)) if a.fn != "count" else F.lit(0)).withColumn(f"__c{i}", F.when(v.isNotNull(), 1).otherwise(0).cast("bigint"))
            for k in "sc":
                df = totals_before(df, [F.col(f"`{d}`")], f"__{k}{i}", f"__b{k}{i}").withColumn(f"__{k}{i}", F.col(f"__{k}{i}") + F.col(f"__b{k}{i}")).drop(f"__b{k}{i}") if not (k == "s" and a.fn == "count") else df
        values = [{"sum": F.col(f"__s{i}"), "count": F.col(f"__c{i}"), "avg": F.when(F.col(f"__c{i}") > 0, F.col(f"__s{i}") / F.col(f"__c{i}"))}[a.fn].alias(a.name) for i, a in enumerate(aggs)]
        return ArrayFrame(df.select(*src.cols(*s.dim_names), *values), out)
    w = Window.partitionBy(*[f"`{x}`" for x in others]).orderBy(f"`{d}`").rowsBetween(Window.unboundedPreceding, 0)
    return ArrayFrame(src.df.select(*src.cols(*s.dim_names), *[a.column(lambda c: c.over(w)) for a in aggs]), out)


def _group(src: ArrayFrame, attr: str | None, dims: tuple[str, ...]) -> tuple[Attr, list[str]]:
    a = src.schema.attr(attr) if attr else src.schema.attrs[0]
    return a, list(dict.fromkeys(src.schema.dim(d).name for d in dims))


def _ranked(a: Attr) -> Column:
    c = F.col(f"`{a.name}`")
    return c.isNotNull() & ~F.isnan(c) if a.type in FLOATS else c.isNotNull()


def _places(src: ArrayFrame, a: Attr, by: list[str]):
    """(group, __v, __n, __below): how often each value occurs in its group and how many are smaller.

    Values are counted first (combined before the shuffle); running totals over the distinct
    values then span range partitions, so a large group isn't sorted in one task.
    """
    c = F.col(f"`{a.name}`")
    counts = src.df.where(_ranked(a)).groupBy(*[F.col(f"`{d}`").alias(f"__g{i}") for i, d in enumerate(by)], c.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    groups = [f"__g{i}" for i in range(len(by))]
    if not by:
        return totals_before(counts, [F.col("__v")], "__n", "__below"), groups
    run = totals_before(counts, [*map(F.col, groups), F.col("__v")], "__n", "__all")
    starts = run.groupBy(*groups).agg(F.min("__all").alias("__start"))
    return run.join(starts, groups).withColumn("__below", F.col("__all") - F.col("__start")).drop("__all", "__start"), groups


def _rank(src: ArrayFrame, attr: str | None, dims: tuple[str, ...], mean: bool) -> ArrayFrame:
    a, by = _group(src, attr, dims)
    places, groups = _places(src, a, by)
    rank = F.col("__below") + 1.0 + ((F.col("__n") - 1) / 2.0 if mean else 0.0)
    name = f"{a.name}_rank"
    places = places.select(*groups, "__v", rank.cast("double").alias(name))
    cond = F.col(f"`{a.name}`") == F.col("__v")
    for g, d in zip(groups, by):
        cond = cond & (F.col(f"`{d}`") == F.col(g))
    df = src.df.select(*src.cols(*src.schema.dim_names, a.name)).join(places, cond, "left")
    c = F.col(f"`{a.name}`")
    value = F.when(F.isnan(c), F.lit(float("nan"))).otherwise(F.col(name)) if a.type in FLOATS else F.col(name)
    return ArrayFrame(df.select(*src.cols(*src.schema.dim_names, a.name), value.alias(name)), src.schema.with_(attrs=[a, Attr(name, "double", True)]))


@register_op("rank", "rank(src [, attr {, dim}*])", "window")
def rank(src: ArrayFrame, attr: str | None = None, *dims: str) -> ArrayFrame:
    """The attribute with its rank, 1 + the number of smaller values, by groups of dimensions; nulls and NaN aren't ranked."""
    return _rank(src, attr, dims, False)


@register_op("avg_rank", "avg_rank(src [, attr {, dim}*])", "window")
def avg_rank(src: ArrayFrame, attr: str | None = None, *dims: str) -> ArrayFrame:
    """As rank, but equal values share the mean of their places."""
    return _rank(src, attr, dims, True)


@register_op("quantile", "quantile(src, k [, attr {, dim}*])", "window")
def quantile(src: ArrayFrame, k, attr: str | None = None, *dims: str) -> ArrayFrame:
    """The k-quantiles 0..k: the value at sorted place max(ceil(p * n) - 1, 0), by groups of dimensions."""
    k = int(k)
    need(k >= 1, "quantile: at least one part is needed")
    a, by = _group(src, attr, dims)
    places, groups = _places(src, a, by)
    sizes = places.groupBy(*groups).agg(F.sum("__n").alias("__size")) if groups else places.agg(F.sum("__n").alias("__size"))
    both = places.join(sizes, groups) if groups else places.crossJoin(F.broadcast(sizes))
    at = "greatest(CAST(ceil(q * __size / {k}D) AS BIGINT) - 1, 0L)".format(k=k)
    q = F.explode(F.expr(f"filter(transform(sequence(0, {k}), q -> CAST(q AS BIGINT)), q -> {at} >= __below AND {at} < __below + __n)"))
    df = both.withColumn("quantile", q)
    name = f"{a.name}_quantile"
    df = df.select(*[F.col(g).alias(d) for g, d in zip(groups, by)], "quantile", (F.col("quantile") / F.lit(float(k))).alias("percentage"), F.col("__v").alias(name))
    s = ArraySchema((Attr("percentage", "double"), Attr(name, a.type, True)), (*[src.schema.dim(d) for d in by], Dim("quantile", 0, k, k + 1)), src.schema.name)
    return ArrayFrame(df, s)
