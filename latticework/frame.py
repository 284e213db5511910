"""ArrayFrame: a DataFrame whose integer coordinate columns are a key, with an array schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SPARK_TO_TYPE, TYPES, ArrayError, ArraySchema, Attr, Dim, need, parse_schema


@dataclass(frozen=True)
class ArrayFrame:
    """An array: ``df`` has a long column for each dimension, then one for each attribute.

    An empty cell is an absent row, a null attribute a null. Operators are methods.
    """

    df: DataFrame
    schema: ArraySchema

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @staticmethod
    def of(df: DataFrame, schema: ArraySchema | str) -> ArrayFrame:
        """Names and types as the schema says; columns are found by name."""
        s = parse_schema(schema) if isinstance(schema, str) else schema
        cols = [F.col(f"`{d}`").cast("bigint").alias(d) for d in s.dim_names]
        cols += [F.col(f"`{a.name}`").cast(TYPES[a.type]).alias(a.name) if a.type in TYPES else F.col(f"`{a.name}`") for a in s.attrs]
        return ArrayFrame(df.select(*cols), s)

    @staticmethod
    def from_table(df: DataFrame, dims: list[str | Dim], attrs: list[str] | None = None, name: str = "") -> ArrayFrame:
        """A table seen as an array: integer columns ``dims`` are its key (unbounded unless given as Dim)."""
        ds = [d if isinstance(d, Dim) else Dim(d) for d in dims]
        kinds = dict(df.dtypes)
        names = attrs if attrs is not None else [c for c in df.columns if c not in {d.name for d in ds}]
        return ArrayFrame.of(df, ArraySchema(tuple(Attr(c, SPARK_TO_TYPE[kinds[c]], True) for c in names), tuple(ds), name))

    def __getattr__(self, name: str) -> Callable[..., ArrayFrame]:
        from .operators import OPERATORS

        if name.startswith("_") or name.rstrip("_") not in OPERATORS:
            raise AttributeError(name)
        op = OPERATORS[name.rstrip("_")].run
        return lambda *args, **kw: op(self, *args, **kw)

    def same(self, df: DataFrame, **changes) -> ArrayFrame:
        """``df`` under this schema with changes, columns in schema order."""
        s = self.schema.with_(**changes) if changes else self.schema
        return ArrayFrame(df.select(*[F.col(f"`{c}`") for c in s.names]), s)

    def cols(self, *names: str) -> list[Column]:
        return [F.col(f"`{n}`") for n in names]

    def box(self) -> list[tuple[int, int]] | None:
        """The least box that holds all cells; None when empty. One aggregation, a row to the driver."""
        d = self.schema.dim_names
        r = self.df.agg(*[f(f"`{x}`") for x in d for f in (F.min, F.max)]).first()
        return None if r[0] is None else [(r[2 * i], r[2 * i + 1]) for i in range(len(d))]

    def bounded(self) -> ArrayFrame:
        """Unbounded dimensions take the largest coordinate present as their end."""
        if all(d.hi is not None for d in self.schema.dims):
            return self
        box = self.box() or [(d.lo, d.lo - 1) for d in self.schema.dims]
        return ArrayFrame(self.df, self.schema.with_(dims=[d if d.hi is not None else Dim(d.name, d.lo, b[1], d.chunk, d.overlap) for d, b in zip(self.schema.dims, box)]))


def chunk_of(d: Dim) -> Column:
    return F.floor((F.col(f"`{d.name}`") - F.lit(d.lo)) / F.lit(d.chunk)).cast("bigint")


__all__ = ["ArrayError", "ArrayFrame", "chunk_of", "need"]
