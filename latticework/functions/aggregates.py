"""Aggregate functions with the array rules: sum of nothing 0, prod of nothing 1, sticky NaN."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FLOATS, INTEGERS, ArraySchema, Attr, bare, need

Over = Callable[[Column], Column]


def _sum(c: Column, t: str, o: Over) -> Column:
    if t in INTEGERS:
        return F.coalesce(o(F.sum(c.cast("bigint"))), F.lit(0).cast("bigint"))
    return F.coalesce(o(F.sum(c.cast("double"))), F.lit(0.0))


def _prod(c: Column, t: str, o: Over) -> Column:
    """Exact for integers up to 2**53; the product is built as a double."""
    p = F.coalesce(o(F.product(c.cast("double"))), F.lit(1.0))
    return p.cast("bigint") if t in INTEGERS else p


def _min(c: Column, t: str, o: Over) -> Column:
    return F.when(o(F.max(F.isnan(c))), F.lit(float("nan")).cast(t)).otherwise(o(F.min(c))) if t in FLOATS else o(F.min(c))


def _string_sum(c: Column, t: str, o: Over) -> Column:
    return o(F.concat_ws("", F.collect_list(c)))


def _wide(t: str) -> str:
    return "uint64" if t.startswith("uint") else "int64" if t in INTEGERS else "double"


#: name -> (column of value, type and how to window it; result type of the type; nullable)
AGGREGATES: dict[str, tuple[Callable[[Column, str, Over], Column], Callable[[str], str], bool]] = {
    "sum": (_sum, _wide, False),
    "prod": (_prod, _wide, False),
    "count": (lambda c, t, o: o(F.count(c)), lambda t: "uint64", False),
    "avg": (lambda c, t, o: o(F.avg(c.cast("double"))), lambda t: "double", True),
    "min": (_min, lambda t: t, True),
    "max": (lambda c, t, o: o(F.max(c)), lambda t: t, True),
    "var": (lambda c, t, o: o(F.var_samp(c.cast("double"))), lambda t: "double", True),
    "stdev": (lambda c, t, o: o(F.stddev_samp(c.cast("double"))), lambda t: "double", True),
    "approxdc": (lambda c, t, o: o(F.approx_count_distinct(c, 0.01)), lambda t: "uint64", False),
    "first_value": (lambda c, t, o: o(F.first(c, True)), lambda t: t, True),
    "last_value": (lambda c, t, o: o(F.last(c, True)), lambda t: t, True),
    "median": (lambda c, t, o: o(F.median(c)), lambda t: "double", True),
}


@dataclass(frozen=True)
class Agg:
    """One aggregate call: its function, attribute (None for ``*``), value type and result name."""

    fn: str
    attr: str | None
    type: str
    name: str

    def column(self, over: Over = lambda c: c, value: Column | None = None) -> Column:
        if self.attr is None:
            return over(F.count(F.lit(1))).alias(self.name)
        c = F.col(f"`{self.attr}`") if value is None else value
        if self.fn == "sum" and self.type in ("string", "char"):
            return _string_sum(c, self.type, over).alias(self.name)
        return AGGREGATES[self.fn][0](c, self.type, over).alias(self.name)

    @property
    def out(self) -> Attr:
        if self.attr is None:
            return Attr(self.name, "uint64")
        if self.fn == "sum" and self.type == "string":
            return Attr(self.name, "string", True)
        _, result, null = AGGREGATES[self.fn]
        return Attr(self.name, result(self.type), null)


_CALL = re.compile(r"^\s*(\w+)\s*\(\s*(\*|[\w.]*)\s*\)\s*(?:as\s+(\w+))?\s*$", re.I)


def is_aggregate(text: str) -> bool:
    m = _CALL.match(text) if isinstance(text, str) else None
    return bool(m) and m[1].lower() in AGGREGATES


def parse_aggregates(calls: list[str], schema: ArraySchema, taken: list[str] | None = None) -> list[Agg]:
    """``sum(a) as s`` and the like; default names a_sum, and count for ``count(*)``."""
    out: list[Agg] = []
    for text in calls:
        m = _CALL.match(text)
        need(bool(m) and m[1].lower() in AGGREGATES, f"{text!r} isn't an aggregate call")
        fn, arg = m[1].lower(), bare(m[2])
        if not arg:
            need(len(schema.attrs) > 0, "no attribute to aggregate")
            arg = schema.attrs[0].name
        if arg == "*":
            need(fn == "count", f"{fn}(*) isn't defined")
            out.append(Agg(fn, None, "uint64", m[3] or "count"))
        else:
            t = schema.type_of(arg)
            need(fn in ("count", "min", "max", "approxdc", "first_value", "last_value") or t in INTEGERS + FLOATS or (fn == "sum" and t == "string"), f"{fn} isn't for {t}")
            out.append(Agg(fn, arg, t, m[3] or f"{arg}_{'ApproxDC' if fn == 'approxdc' else fn}"))
    names = [a.name for a in out]
    need(len(set(names)) == len(names), f"aggregate names repeat: {names}")
    return out
