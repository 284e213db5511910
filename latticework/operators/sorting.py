"""Sorting into a one-dimensional array."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..plans.numbering import numbered
from ..schema import FLOATS, ArraySchema, Dim, need
from .registry import register_op


@register_op("sort", "sort(src {, attr [asc|desc]}* [, chunk])", "sort")
def sort(src: ArrayFrame, *args) -> ArrayFrame:
    """Cells in order of attributes, numbered from 0 along n; null before NaN before numbers, ascending.

    Ties fall to the other attributes and old coordinates, so the result is one and the same each time.
    """
    s, keys, chunk = src.schema, [], 1_000_000
    for a in args:
        if re.fullmatch(r"\s*\d+\s*", str(a)):
            chunk = int(a)
            continue
        m = re.fullmatch(r"\s*([\w.]+)(?:\s+(asc|desc))?\s*", a, re.I)
        need(bool(m), f"sort: {a!r} isn't a key")
        keys.append((s.attr(m[1]), (m[2] or "asc").lower() == "desc"))
    keys = keys or [(s.attrs[0], False)]
    order = []
    for a, down in keys:
        c = F.col(f"`{a.name}`")
        parts = [c.isNull(), *([F.isnan(c)] if a.type in FLOATS else [])]
        # ascending: nulls, then NaN, then values
        order += [p.asc() if down else p.desc() for p in parts] + [c.desc() if down else c.asc()]
    order += [F.col(f"`{n}`") for n in (*s.attr_names, *s.dim_names) if n not in {a.name for a, _ in keys}]
    name = "n"
    while name in s.attr_names:
        name += "_"
    df = numbered(src.df, order, name)
    return ArrayFrame(df.select(name, *src.cols(*s.attr_names)), ArraySchema(s.attrs, (Dim(name, 0, None, chunk),), s.name))


register_op("sort2", "sort2(src)", "sort")(sort)
