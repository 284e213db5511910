"""Array schemas: attributes over integer dimensions, and their text form ``<a:int64 null>[x=0:9,10,0]``."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

#: Attribute type -> Spark SQL type. Unsigned kinds take the next wider signed one, uint64 a long.
TYPES: dict[str, str] = {
    "bool": "boolean", "char": "string", "string": "string",
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "bigint",
    "float": "float", "double": "double", "datetime": "timestamp_ntz",
    "datetimetz": "struct<ts:timestamp_ntz,off:int>", "binary": "binary", "void": "void",
}
SPARK_TO_TYPE = {
    "boolean": "bool", "string": "string", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64",
    "float": "float", "double": "double", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime", "binary": "binary",
}
INTEGERS = ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64")
FLOATS = ("float", "double")
MAX = 4611686018427387903


class ArrayError(ValueError):
    """An operator was given arguments or arrays that don't fit it."""


def need(condition: bool, message: str) -> None:
    if not condition:
        raise ArrayError(message)


@dataclass(frozen=True)
class Attr:
    name: str
    type: str
    nullable: bool = False
    default: str | None = None

    def __str__(self) -> str:
        return f"{self.name}:{self.type}" + " NULL" * self.nullable + (f" DEFAULT {self.default}" if self.default is not None else "")


@dataclass(frozen=True)
class Dim:
    name: str
    lo: int = 0
    hi: int | None = None
    chunk: int = 1_000_000
    overlap: int = 0

    @property
    def length(self) -> int | None:
        return None if self.hi is None else self.hi - self.lo + 1

    def __str__(self) -> str:
        return f"{self.name}={self.lo}:{'*' if self.hi is None else self.hi},{self.chunk},{self.overlap}"


@dataclass(frozen=True)
class ArraySchema:
    attrs: tuple[Attr, ...]
    dims: tuple[Dim, ...]
    name: str = ""

    def __post_init__(self) -> None:
        names = [x.name for x in (*self.dims, *self.attrs)]
        need(len(set(names)) == len(names), f"duplicate names in {names}")
        need(bool(self.dims), "an array has at least one dimension")

    def __str__(self) -> str:
        return f"{self.name}<{','.join(map(str, self.attrs))}> [{','.join(map(str, self.dims))}]"

    @property
    def attr_names(self) -> list[str]:
        return [a.name for a in self.attrs]

    @property
    def dim_names(self) -> list[str]:
        return [d.name for d in self.dims]

    @property
    def names(self) -> list[str]:
        return self.dim_names + self.attr_names

    def attr(self, name: str) -> Attr:
        found = [a for a in self.attrs if a.name == bare(name)]
        need(bool(found), f"no attribute {name}")
        return found[0]

    def dim(self, name: str) -> Dim:
        found = [d for d in self.dims if d.name == bare(name)]
        need(bool(found), f"no dimension {name}")
        return found[0]

    def with_(self, **kw) -> ArraySchema:
        return replace(self, **{k: tuple(v) if k in ("attrs", "dims") else v for k, v in kw.items()})

    def type_of(self, name: str) -> str:
        name = bare(name)
        return "int64" if name in self.dim_names else self.attr(name).type


def bare(name: str) -> str:
    """A name without its array alias."""
    return name.rsplit(".", 1)[-1].strip()


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or the first of name_2, name_3, ... that isn't taken."""
    if name not in taken:
        return name
    i = 2
    while f"{name}_{i}" in taken:
        i += 1
    return f"{name}_{i}"


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"[^\"]*\")|([A-Za-z_][\w.]*)|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(.))", re.S)


def _tokens(text: str) -> list[str]:
    return [next(x for x in m.groups() if x is not None) for m in _TOKEN.finditer(text) if m.group().strip()]


def parse_schema(text: str) -> ArraySchema:
    """Read ``[name] < attr:type [null] [default x] , ... > [ dim=lo:hi,chunk,overlap , ... ]``."""
    t, i = _tokens(text), 0

    def take(want: str | None = None) -> str:
        nonlocal i
        need(i < len(t) and (want is None or t[i] == want), f"bad schema near {' '.join(t[max(0, i - 3) : i + 3])!r}")
        i += 1
        return t[i - 1]

    def peek(n: int = 0) -> str:
        return t[i + n] if i + n < len(t) else ""

    name = take() if t and t[0] != "<" else ""
    if name.lower() == "not":
        name = ""
    take("<")
    attrs: list[Attr] = []
    while True:
        a = take()
        take(":")
        kind = take().lower()
        need(kind in TYPES, f"unknown type {kind}")
        nullable, default = False, None
        while peek() not in (",", ">"):
            word = take().lower()
            if word == "null":
                nullable = True
            elif word == "not":
                need(take().lower() == "null", "NOT NULL expected")
            elif word == "default":
                default = take()
                if default == "-":
                    default += take()
            elif word in ("compression", "reserve"):
                take()
            else:
                raise ArrayError(f"bad attribute option {word}")
        attrs.append(Attr(a, kind, nullable, default))
        if take() == ">":
            break
    take("[")
    dims: list[Dim] = []
    while peek() != "]":
        d = take()
        lo, hi, chunk, overlap = 0, None, None, 0
        if peek() == "=":
            take()
            first = take()
            if peek() == ":":
                take()
                lo, last = int(first), take()
                hi = None if last == "*" else int(last)
            else:
                hi = None if first == "*" else int(first) - 1
            if peek() == "," and peek(1).isdigit():
                take()
                chunk = int(take())
                if peek() == "," and peek(1).isdigit():
                    take()
                    overlap = int(take())
        dims.append(Dim(d, lo, hi, chunk or (hi - lo + 1 if hi is not None else 1_000_000), overlap))
        if peek() == ",":
            take()
    take("]")
    return ArraySchema(tuple(attrs), tuple(dims), name)
