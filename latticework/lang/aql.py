"""The SQL-like language, desugared to operators.

SELECT list [INTO B] FROM sources [WHERE p] [GROUP BY dims] [REGRID AS (...)] [[FIXED|VARIABLE] WINDOW [W] AS (...)]
[REDIMENSION BY [dims]] [ORDER BY keys]; UPDATE, INSERT INTO, CREATE, DROP, RENAME, LOAD, SAVE, THIN.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..functions.aggregates import is_aggregate
from ..functions.expr import converted, nullable, parse, sql_of
from ..operators import OPERATORS
from ..schema import TYPES, ArrayError, ArraySchema, Attr, Dim, bare, need
from ..sources.store import Store
from .afl import Session, expanded, split_arguments, unquoted

_CLAUSE = ["select", "into", "from", "where", "group by", "regrid as", "fixed window", "variable window", "window", "redimension by", "order by"]


def clauses(text: str) -> list[tuple[str, str]]:
    """Clauses in order, found outside brackets and quotes."""
    marks, depth, i, low = [], 0, 0, text.lower()
    while i < len(text):
        c = text[i]
        if c in "'\"":
            i = text.index(c, i + 1) + 1
            continue
        depth += (c in "([") - (c in ")]")
        if depth == 0 and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_")):
            for k in _CLAUSE:
                m = re.compile(k.replace(" ", r"\s+") + r"\b").match(low, i)
                if m:
                    marks.append((k, i, m.end()))
                    i = m.end() - 1
                    break
        i += 1
    return [(k, text[e : marks[j + 1][1] if j + 1 < len(marks) else len(text)].strip()) for j, (k, _, e) in enumerate(marks)]


class Query:
    def __init__(self, session: Session):
        self.session = session

    # -- sources

    def source(self, text: str) -> tuple[ArrayFrame, str]:
        """An array and its alias."""
        text = text.strip()
        if text.startswith("("):
            m = re.match(r"(?is)\((.*)\)\s*(?:as\s+)?(\w*)\s*$", text)
            need(bool(m), f"bad source {text}")
            return self.run(m[1]), m[2]
        m = re.match(r"(?is)(.*?\)|[\w@*]+)(?:\s+(?:as\s+)?(\w+))?\s*$", text)
        need(bool(m), f"bad source {text}")
        return self.session.array(m[1]), m[2] or m[1]

    def sources(self, text: str) -> ArrayFrame:
        parts = re.split(r"(?i)\s+(cross\s+join|join)\s+", text)
        if len(parts) == 1:
            listed = [self.source(x) for x in split_arguments(text)]
            got, alias = listed[0]
            for other, _ in listed[1:]:
                got = OPERATORS["join"].run(got, other)
            return got
        got, alias = self.source(parts[0])
        for kind, right in zip(parts[1::2], parts[2::2]):
            pieces = re.split(r"(?i)\s+on\s+", right, maxsplit=1)
            other, name = self.source(pieces[0])
            if kind.lower().startswith("cross"):
                got = OPERATORS["cross_join"].run(got, other)
            elif len(pieces) == 1:
                got = OPERATORS["join"].run(got, other)
            else:
                got = self.join_on(got, alias, other, name, pieces[1])
        return got

    def join_on(self, a: ArrayFrame, alias: str, b: ArrayFrame, name: str, on: str) -> ArrayFrame:
        """Equalities of expressions: an equi-join on them, dimensions of both sides kept."""
        left, right = [], []
        for cond in re.split(r"(?i)\s+and\s+", on):
            sides = re.split(r"(?<![<>!])=", cond)
            need(len(sides) == 2, f"ON takes equalities, not {cond}")
            x, y = (s.strip() for s in sides)
            if re.search(rf"\b{name}\.", x) or (not re.search(rf"\b{alias}\.", x) and bare(x) not in a.schema.names):
                x, y = y, x
            left.append(sql_of(x, a.schema)[0])
            right.append(sql_of(y, b.schema)[0])
        taken, new = list(a.schema.names), {}
        from ..schema import fresh

        for n in b.schema.names:
            new[n] = fresh(n, taken)
            taken.append(new[n])
        p = a.df.select("*", *[F.expr(e).alias(f"__j{i}") for i, e in enumerate(left)])
        q = b.df.select(*[F.expr(e).alias(f"__j{i}") for i, e in enumerate(right)], *[F.col(f"`{k}`").alias(v) for k, v in new.items()])
        dims = (*a.schema.dims, *[Dim(new[d.name], d.lo, d.hi, d.chunk) for d in b.schema.dims])
        attrs = (*a.schema.attrs, *[Attr(new[x.name], x.type, x.nullable) for x in b.schema.attrs])
        s = ArraySchema(attrs, dims, a.schema.name)
        return ArrayFrame(p.join(q, [f"__j{i}" for i in range(len(left))]).select(*[F.col(f"`{c}`") for c in s.names]), s)

    # -- select

    def run(self, text: str) -> ArrayFrame | None:
        text = expanded(text.strip().rstrip(";").strip())
        low = text.lower()
        if not low.startswith("select"):
            return self.statement(text)
        found = clauses(text)
        part: dict[str, str] = {}
        windows: dict[str, tuple[str, str]] = {}
        for k, v in found:
            if k.endswith("window"):
                m = re.match(r"(?is)(\w*)\s*as\s*\((.*)\)\s*$", v)
                need(bool(m), f"bad window {v}")
                windows[m[1].lower()] = ("variable" if k.startswith("variable") else "fixed", m[2])
            else:
                need(k not in part, f"{k} is given twice")
                part[k] = v
        src = self.sources(part["from"]) if "from" in part else None
        if src is None:
            from ..sources.literal import build

            src = build(self.session.spark, "<__one:int64>[i=0:0,1,0]", "0")
        if "where" in part:
            src = OPERATORS["filter"].run(src, part["where"])
        items = [re.match(r"(?is)(.*?)(?:\s+as\s+(\w+))?\s*$", x).groups() for x in split_arguments(part["select"])]
        if "redimension by" in part:
            got = self.redimensioned(src, items, part["redimension by"])
        elif windows:
            got = self.windowed(src, items, windows)
        elif "regrid as" in part:
            got = self.regridded(src, items, part["regrid as"])
        elif any(self.aggregates(e) for e, _ in items):
            by = [bare(x.split(" as ")[0]) for x in split_arguments(part.get("group by", ""))]
            for d in by:
                need(d in src.schema.dim_names, f"GROUP BY takes dimensions, {d} isn't one")
            got = self.finished(items, src, lambda calls: OPERATORS["aggregate"].run(src, *calls, *by))
        else:
            got = self.projected(src, items)
        if "order by" in part:
            got = OPERATORS["sort"].run(got, *split_arguments(part["order by"]))
        if "into" in part:
            need(self.session.store is not None, "INTO needs a store")
            return self.session.store.store(got.bounded(), part["into"])
        return got

    @staticmethod
    def aggregates(e: str) -> list[str]:
        return [m.group() for m in re.finditer(r"\b\w+\s*\(\s*(?:\*|[\w.]*)\s*\)", e) if is_aggregate(m.group())]

    def finished(self, items: list, src: ArrayFrame, run) -> ArrayFrame:
        """Run each distinct aggregate call once, then the expressions over their results."""
        calls: dict[str, str] = {}
        exprs, names = [], []
        for k, (e, name) in enumerate(items):
            own = self.aggregates(e)
            for c in own:
                calls.setdefault(re.sub(r"\s+", "", c), f"__a{len(calls)}")
            whole = len(own) == 1 and own[0] == e.strip()
            from ..functions.aggregates import parse_aggregates

            names.append(name or (parse_aggregates([e], src.schema)[0].name if whole else f"expr_{k}"))
            for c in own:
                e = e.replace(c, calls[re.sub(r"\s+", "", c)])
            exprs.append(e)
        got = run([f"{c} as {n}" for c, n in calls.items()])
        return self.projected(got, list(zip(exprs, names)))

    def projected(self, src: ArrayFrame, items: list) -> ArrayFrame:
        s, cols, attrs = src.schema, [], []
        for k, (e, name) in enumerate(items):
            if e.strip() == "*":
                cols += src.cols(*s.attr_names)
                attrs += s.attrs
                continue
            sql, t = sql_of(e, s)
            plain = bare(e)
            n = name or (plain if plain in s.names else f"expr_{k}")
            if n in s.dim_names:
                n = f"{n}_value" if name is None else n
            cols.append(F.expr(sql if t not in TYPES or t == "void" else f"CAST({sql} AS {TYPES[t]})").alias(n))
            attrs.append(Attr(n, t, nullable(parse(e), s)))
        return ArrayFrame(src.df.select(*src.cols(*s.dim_names), *cols), s.with_(attrs=attrs))

    def regridded(self, src: ArrayFrame, items: list, text: str) -> ArrayFrame:
        sizes = {m[1]: int(m[2]) for m in re.finditer(r"(\w+)\s+(\d+)", re.sub(r"(?i)partition\s+by", "", text))}
        blocks = [sizes.get(d, 1) for d in src.schema.dim_names]
        return self.finished(items, src, lambda calls: OPERATORS["regrid"].run(src, *blocks, *calls))

    def windowed(self, src: ArrayFrame, items: list, windows: dict) -> ArrayFrame:
        """One operator per named window, joined to the source on its dimensions."""
        used: dict[str, dict[str, str]] = {w: {} for w in windows}
        only = next(iter(windows))
        exprs, names = [], []
        for k, (e, name) in enumerate(items):
            out = e
            for m in re.finditer(r"(\b\w+\s*\(\s*(?:\*|[\w.]*)\s*\))(?:\s+over\s+(\w+))?", e, re.I):
                if is_aggregate(m[1]):
                    w = (m[2] or only).lower()
                    need(w in windows, f"no window {w}")
                    alias = used[w].setdefault(re.sub(r"\s+", "", m[1]), f"__w{sum(map(len, used.values()))}")
                    out = out.replace(m.group(), alias)
                    default = m[1]
            exprs.append(out)
            from ..functions.aggregates import parse_aggregates

            names.append(name or (parse_aggregates([default], src.schema)[0].name if self.aggregates(e) else None))
        got = src
        for w, calls in used.items():
            if calls:
                r = self.one_window(src, *windows[w], [f"{c} as {n}" for c, n in calls.items()])
                got = OPERATORS["join"].run(got, r)
        return self.projected(got, list(zip(exprs, names)))

    def one_window(self, src: ArrayFrame, kind: str, text: str, calls: list[str]) -> ArrayFrame:
        sizes = {m[1]: (m[2], m[3]) for m in re.finditer(r"(\w+)\s+(\d+|unbound)\s+preceding\s+and\s+(\d+|unbound)\s+following", re.sub(r"(?i)partition\s+by", "", text), re.I)}
        need(bool(sizes), f"bad window {text}")
        for d in sizes:
            src.schema.dim(d)
        if kind == "variable":
            need(len(sizes) == 1, "a variable window has one dimension")
            ((d, (a, b)),) = sizes.items()
            return OPERATORS["variable_window"].run(src, d, a, b, *calls)
        flat = [x for d in src.schema.dim_names for x in sizes.get(d, ("0", "0"))]
        return OPERATORS["window"].run(src, *flat, *calls)

    def redimensioned(self, src: ArrayFrame, items: list, text: str) -> ArrayFrame:
        from ..functions.aggregates import parse_aggregates
        from ..schema import parse_schema

        dims = parse_schema(f"<x:int64>{text if text.startswith('[') else f'[{text}]'}").dims
        aggs, plain = [], []
        for e, name in items:
            (aggs if self.aggregates(e) else plain).append((e, name))
        calls = parse_aggregates([f"{e} as {n}" if n else e for e, n in aggs], src.schema)
        attrs = [Attr(bare(e), src.schema.type_of(e), True) for e, _ in plain if bare(e) not in {d.name for d in dims}]
        s = ArraySchema((*attrs, *[c.out for c in calls]), dims)
        return OPERATORS["redimension"].run(src, s, *[f"{c.fn}({c.attr or '*'}) as {c.name}" for c in calls])

    # -- statements

    def statement(self, text: str) -> ArrayFrame | None:
        store = self.session.store
        rules = [
            (r"create\s+(temp\s+)?array\s+(\w+)\s*(<.*)$", lambda m: store.create(m[2], m[3], bool(m[1]))),
            (r"drop\s+array\s+(\w+)$", lambda m: store.remove(m[1])),
            (r"rename\s+array\s+(\w+)\s+to\s+(\w+)$", lambda m: store.rename(m[1], m[2])),
            (r"cancel\s+query\s+(\w+)$", lambda m: OPERATORS["cancel"].run(self.session.spark, m[1])),
            (r"load\s+library\s+(\S+)$", lambda m: OPERATORS["load_library"].run(self.session.spark, unquoted(m[1]))),
            (r"unload\s+library\s+(\S+)$", lambda m: OPERATORS["unload_library"].run(self.session.spark, unquoted(m[1]))),
            (r"load\s+(\w+)\s+from\s+(?:current\s+instance\s+)?'([^']*)'(?:\s+as\s+'([^']*)')?(?:\s+errors\s+(\d+))?(?:\s+shadow\s+array\s+(\w+))?$", lambda m: OPERATORS["load"].run(store, m[1], m[2], -2, m[3] or "text", int(m[4] or 0), m[5])),
            (r"save\s+(\w+)\s+into\s+(?:current\s+instance\s+)?'([^']*)'(?:\s+as\s+'([^']*)')?$", lambda m: OPERATORS["save"].run(self.session.array(m[1]), m[2], -2, m[3] or "store")),
            (r"insert\s+into\s+(\w+)\s+'(.*)'$", lambda m: self.insert_literal(m[1], m[2])),
            (r"insert\s+into\s+(\w+)\s+(.*)$", lambda m: store.insert(self.run(m[2]), m[1])),
            (r"update\s+(\w+)\s+set\s+(.*?)(?:\s+where\s+(.*))?$", lambda m: self.update(m[1], m[2], m[3])),
            (r"thin\s+(\w+)\s+by\s+(.*)$", lambda m: self.thin(m[1], m[2])),
        ]
        for pattern, act in rules:
            if m := re.match("(?is)" + pattern, text):
                return act(m)
        if re.match(r"\w+(@\S+)?$", text):
            return self.session.array(text)
        raise ArrayError(f"can't read {text[:60]!r}")

    def insert_literal(self, name: str, text: str) -> ArrayFrame:
        from ..sources.literal import literal

        return self.session.store.insert(literal(self.session.spark, self.session.store.schema(name), text), name)

    def update(self, name: str, sets: str, where: str | None) -> ArrayFrame:
        """A new version in which the cells that satisfy WHERE have new values."""
        a = self.session.array(name)
        new = {}
        for x in split_arguments(sets):
            k, e = x.split("=", 1)
            t = a.schema.attr(k.strip()).type
            sql, have = sql_of(e, a.schema)
            new[k.strip()] = converted(sql, have, t) if have != "void" else f"CAST(NULL AS {TYPES[t]})"
        cond = sql_of(where, a.schema)[0] if where else "true"
        cols = [F.expr(f"CASE WHEN {cond} THEN {new[c]} ELSE `{c}` END").alias(c) if c in new else F.col(f"`{c}`") for c in a.schema.names]
        return self.session.store.store(ArrayFrame(a.df.select(*cols), a.schema), name)

    def thin(self, name: str, text: str) -> ArrayFrame:
        """``THIN A BY x START 0 STEP 2, y START 1 STEP 3``."""
        a = self.session.array(name)
        steps = {m[1]: (int(m[2]), int(m[3])) for m in re.finditer(r"(\w+)\s+start\s+(-?\d+)\s+step\s+(\d+)", text, re.I)}
        return OPERATORS["thin"].run(a, *[x for d in a.schema.dims for x in steps.get(d.name, (d.lo, 1))])


def run(text: str, arrays: dict[str, ArrayFrame] | None = None, store: Store | None = None, spark: SparkSession | None = None) -> ArrayFrame | None:
    """Evaluate one statement."""
    return Query(Session(arrays or {}, store, spark)).run(text)
