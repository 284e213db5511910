"""Proximity joins and detections in images."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..plans.graph import labelled
from ..plans.numbering import numbered
from ..schema import ArraySchema, Attr, Dim, fresh, need
from .registry import register_op


def _near(pattern: ArrayFrame, catalog: ArrayFrame, err: int) -> tuple[DataFrame, ArraySchema, dict[str, str]]:
    """Pairs within err in every dimension, by an equi-join on cells of a grid of width err + 1 and its neighbours."""
    p, c = pattern.schema, catalog.schema
    need(len(p.dims) == len(c.dims), "the arrays have different numbers of dimensions")
    need(err >= 0, "the distance is negative")
    size, n = err + 1, len(p.dims)
    new = {}
    taken = list(p.names)
    for a in c.attr_names:
        new[a] = fresh(a, taken)
        taken.append(new[a])
    left = pattern.df
    for i, d in enumerate(p.dim_names):
        at = F.floor(F.col(f"`{d}`") / F.lit(size)).cast("bigint")
        left = left.withColumn(f"__g{i}", F.explode(F.array(at - 1, at, at + 1)))
    right = catalog.df.select(*[F.col(f"`{d}`").alias(f"__c{i}") for i, d in enumerate(c.dim_names)], *[F.col(f"`{a}`").alias(b) for a, b in new.items()])
    for i in range(n):
        right = right.withColumn(f"__g{i}", F.floor(F.col(f"__c{i}") / F.lit(size)).cast("bigint"))
    both = left.join(right, [f"__g{i}" for i in range(n)])
    for i, d in enumerate(p.dim_names):
        both = both.where(F.abs(F.col(f"`{d}`") - F.col(f"__c{i}")) <= err)
    distance = F.lit(0).cast("bigint")
    for i, d in enumerate(p.dim_names):
        distance = distance + (F.col(f"`{d}`") - F.col(f"__c{i}")) * (F.col(f"`{d}`") - F.col(f"__c{i}"))
    return both.withColumn("__distance", distance), p, new


@register_op("bestmatch", "bestmatch(pattern, catalog, error)", "proximity")
def bestmatch(pattern: ArrayFrame, catalog: ArrayFrame, err) -> ArrayFrame:
    """For each cell of the pattern the nearest cell of the catalog within ±error in each dimension, if any."""
    both, p, new = _near(pattern, catalog, int(err))
    n = len(p.dims)
    best = F.min(F.struct("__distance", *[f"__c{i}" for i in range(n)], *[F.col(f"`{b}`") for b in new.values()])).alias("__best")
    df = both.groupBy(*[f"`{d}`" for d in p.dim_names]).agg(*[F.first(f"`{a}`").alias(a) for a in p.attr_names], best)
    attrs = (*p.attrs, *[Attr(new[a.name], a.type, a.nullable) for a in catalog.schema.attrs])
    return ArrayFrame(df.select(*pattern.cols(*p.names), *[F.col(f"__best.`{b}`").alias(b) for b in new.values()]), ArraySchema(attrs, p.dims, p.name))


@register_op("match", "match(pattern, catalog, error, dim)", "proximity")
def match(pattern: ArrayFrame, catalog: ArrayFrame, err, dim: str = "match") -> ArrayFrame:
    """All cells of the catalog within ±error of each cell of the pattern, along a new dimension by distance."""
    both, p, new = _near(pattern, catalog, int(err))
    n = len(p.dims)
    w = Window.partitionBy(*[f"`{d}`" for d in p.dim_names]).orderBy("__distance", *[f"__c{i}" for i in range(n)])
    places = [fresh(f"match_{d}", [*p.names, *new.values()]) for d in catalog.schema.dim_names]
    df = both.withColumn(dim, F.row_number().over(w).cast("bigint") - 1)
    attrs = (*p.attrs, *[Attr(new[a.name], a.type, a.nullable) for a in catalog.schema.attrs], *[Attr(x, "int64") for x in places])
    s = ArraySchema(attrs, (*p.dims, Dim(dim, 0, None)), p.name)
    return ArrayFrame(df.select(*pattern.cols(*p.dim_names), dim, *pattern.cols(*p.attr_names), *[F.col(f"`{b}`") for b in new.values()], *[F.col(f"__c{i}").alias(x) for i, x in enumerate(places)]), s)


@register_op("findstars", "findstars(image, attr, threshold)", "proximity")
def findstars(image: ArrayFrame, attr: str, threshold) -> ArrayFrame:
    """Connected areas (8 neighbours) of pixels at or above a threshold, per image of the leading dimensions.

    Returns the pixels of an area with oid (the area's number in its image order), its
    sum and its weighted centre. Edges join each pixel to neighbours, so an area may span tasks.
    """
    s = image.schema
    need(len(s.dims) >= 2, "findstars takes images of two dimensions or more")
    a = s.attr(attr).name
    y, x = s.dim_names[-2], s.dim_names[-1]
    lead = s.dim_names[:-2]
    order = image.cols(*s.dim_names)
    px = numbered(image.df.where(F.col(f"`{a}`") >= float(threshold)).select(*order, F.col(f"`{a}`").alias("__v")), order, "__id")
    moved = px.select("__id", *[F.col(f"`{d}`") for d in lead], F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("o"), F.col(f"`{y}`").alias("__y"), F.col(f"`{x}`").alias("__x"))
    moved = moved.select(F.col("__id").alias("__from"), *[F.col(f"`{d}`") for d in lead], (F.col("__y") + F.col("o.dy")).alias(y), (F.col("__x") + F.col("o.dx")).alias(x))
    edges = moved.join(px, s.dim_names).select(F.col("__from").alias("a"), F.col("__id").alias("b"))
    roots = labelled(edges)
    px = px.join(roots, px["__id"] == roots["node"], "left").withColumn("oid", F.coalesce("root", "__id")).drop("node", "root")
    v = F.col("__v").cast("double")
    areas = px.groupBy("oid").agg(F.sum(v).alias("sumpixel"), (F.sum(v * F.col(f"`{y}`")) / F.sum(v)).alias("center_y"), (F.sum(v * F.col(f"`{x}`")) / F.sum(v)).alias("center_x"))
    df = px.join(areas, "oid").select(*image.cols(*s.dim_names), "oid", "sumpixel", "center_y", "center_x")
    attrs = (Attr("oid", "int64"), Attr("sumpixel", "double"), Attr("center_y", "double"), Attr("center_x", "double"))
    return ArrayFrame(df, ArraySchema(attrs, s.dims, s.name))


@register_op("groupstars", "groupstars(observations, distance)", "proximity")
def groupstars(obs: ArrayFrame, distance) -> ArrayFrame:
    """Group observations <oid, center_y, center_x> of several images by distance of centres, transitively.

    Candidates come from an equi-join on grid cells of the distance's width and their neighbours.
    """
    s, r = obs.schema, float(distance)
    need(r > 0, "groupstars: the distance isn't positive")
    for c in ("center_y", "center_x"):
        s.attr(c)
    one = numbered(obs.df.select(*obs.cols(*s.dim_names), "center_y", "center_x"), obs.cols(*s.dim_names), "__id")
    cell = lambda c: F.floor(F.col(c) / F.lit(r)).cast("bigint")
    base = one.select("__id", "center_y", "center_x", cell("center_y").alias("gy"), cell("center_x").alias("gx"))
    near = base.select(F.col("__id").alias("b"), F.col("center_y").alias("by"), F.col("center_x").alias("bx"), F.explode(F.expr("transform(sequence(0, 8), i -> struct(gy + i div 3 - 1 as gy, gx + i % 3 - 1 as gx))")).alias("g")).select("b", "by", "bx", "g.gy", "g.gx")
    hit = (F.col("center_y") - F.col("by")) * (F.col("center_y") - F.col("by")) + (F.col("center_x") - F.col("bx")) * (F.col("center_x") - F.col("bx")) <= r * r
    edges = base.join(near, ["gy", "gx"]).where((F.col("__id") < F.col("b")) & hit).select(F.col("__id").alias("a"), "b")
    roots = labelled(edges)
    df = one.join(roots, one["__id"] == roots["node"], "left").select(*obs.cols(*s.dim_names), "center_y", "center_x", F.coalesce("root", "__id").alias("group"))
    return ArrayFrame(df, ArraySchema((Attr("center_y", "double"), Attr("center_x", "double"), Attr("group", "int64")), s.dims, s.name))


#: Pixels that savebmp takes to the driver at most.
BMP_PIXELS = 50_000_000


@register_op("savebmp", "savebmp(image, file)", "proximity")
def savebmp(image: ArrayFrame, path: str) -> ArrayFrame:
    """Write a bounded image of three attributes (red, green, blue) as a BMP file; returns the image."""
    import numpy as np

    s = image.schema
    need(len(s.dims) == 2 and len(s.attrs) == 3, "savebmp takes two dimensions and three attributes")
    h, w = (d.length for d in s.dims)
    need(h is not None and w is not None and h * w <= BMP_PIXELS, f"savebmp takes bounded images of at most {BMP_PIXELS} pixels")
    t = image.df.toArrow()
    out = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    y, x = (t.column(d.name).to_numpy() - d.lo for d in s.dims)
    for k, a in enumerate(reversed(s.attr_names)):
        out[y, x * 3 + k] = t.column(a).to_numpy().astype(np.uint8)
    body = out[::-1].tobytes()
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    with open(path, "wb") as f:
        f.write(head + body)
    return image
