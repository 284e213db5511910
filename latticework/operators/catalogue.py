"""Sources, sinks and definitions as operators. Those on stored arrays take the Store first."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import SparkSession

from ..frame import ArrayFrame
from ..functions.aggregates import AGGREGATES
from ..functions.expr import FUNCTIONS
from ..schema import TYPES, ArraySchema, need, parse_schema
from ..sources import files, literal
from ..sources.store import Store
from .internal import LIBRARIES, MACROS, cells
from .registry import OPERATORS, register_op


@register_op("scan", "scan(array [, version])", "source")
def scan(store: Store, name: str, version: int | None = None) -> ArrayFrame:
    """A stored array, its latest version or a given one."""
    return store.scan(name, version)


@register_op("build", "build(schema, expression | literal [, true])", "source")
def build(spark: SparkSession, schema: str | ArraySchema, text: str, is_literal=False) -> ArrayFrame:
    """An array from an expression over coordinates, or from a literal."""
    return literal.build(spark, schema, text, is_literal)


@register_op("input", "input(schema, file [, instance [, format [, max_errors [, shadow]]]])", "source")
def input_(store: Store, schema: str | ArraySchema, path: str, instance=-2, fmt: str = "text", max_errors=0, shadow: str | None = None) -> ArrayFrame:
    """Parse a file; lines that can't be read go to a shadow array."""
    s = store.schema(schema) if isinstance(schema, str) and "<" not in schema else schema
    got, bad = files.load_file(store.spark, s, path, fmt, int(max_errors))
    if shadow and bad is not None:
        from pyspark.sql import functions as F

        from ..plans.numbering import numbered

        store.store(ArrayFrame.of(numbered(bad, [F.col("file"), F.col("place")], "i"), "<file:string null, place:int64 null, line:string null>[i=0:*,100000,0]"), shadow)
    return got


@register_op("load", "load(array, file [, instance [, format [, max_errors [, shadow]]]])", "source")
def load(store: Store, name: str, path: str, instance=-2, fmt: str = "text", max_errors=0, shadow: str | None = None) -> ArrayFrame:
    """input, then store."""
    return store.store(input_(store, name, path, instance, fmt, max_errors, shadow), name)


@register_op("save", "save(src, file [, instance [, format]])", "sink")
def save(src: ArrayFrame, path: str, instance=-2, fmt: str = "store") -> ArrayFrame:
    """Write an array to files; returns the array."""
    return files.save(src, path, fmt)


@register_op("store", "store(src, array)", "sink")
def store_(src: ArrayFrame, store: Store, name: str) -> ArrayFrame:
    """A new version of an array."""
    return store.store(src, name)


@register_op("insert", "insert(src, array)", "sink")
def insert(src: ArrayFrame, store: Store, name: str) -> ArrayFrame:
    """A new version: these cells over the former ones."""
    return store.insert(src, name)


@register_op("create_array", "create_array(name, schema [, temp])", "definition")
def create_array(store: Store, name: str, schema: str, temp=False) -> None:
    """Define an array; a temporary one lives with the store object."""
    store.create(name, schema, str(temp).lower() == "true")


@register_op("remove", "remove(array)", "definition")
def remove(store: Store, name: str) -> None:
    """Delete an array with its versions."""
    store.remove(name)


@register_op("remove_versions", "remove_versions(array, oldest)", "definition")
def remove_versions(store: Store, name: str, oldest) -> None:
    """Delete the versions before the oldest to keep."""
    store.remove_versions(name, int(oldest))


@register_op("rename", "rename(old, new)", "definition")
def rename(store: Store, old: str, new: str) -> None:
    """Rename an array."""
    store.rename(old, new)


@register_op("versions", "versions(array)", "introspection")
def versions(store: Store, name: str) -> ArrayFrame:
    """Number and time of each version."""
    rows = [(v["id"], datetime.fromtimestamp(int(v["timestamp"]), timezone.utc).replace(tzinfo=None)) for v in store.versions(name)]
    got = cells(store.spark, rows, [("version_id", "int64"), ("timestamp", "datetime")], "VersionNo")
    from pyspark.sql import functions as F

    return ArrayFrame(got.df.withColumn("VersionNo", F.col("VersionNo") + 1), parse_schema(f"<version_id:int64,timestamp:datetime>[VersionNo=1:{max(1, len(rows))},{max(1, len(rows))},0]"))


@register_op("allversions", "allversions(array)", "source")
def allversions(store: Store, name: str) -> ArrayFrame:
    """All versions, under a first dimension VersionNo."""
    return store.allversions(name)


@register_op("show", "show(array)", "introspection")
def show(src: ArrayFrame | Store, name: str | None = None) -> ArrayFrame:
    """The schema as one cell of text."""
    s, spark = (src.schema(name), src.spark) if isinstance(src, Store) else (src.schema, src.spark)
    return cells(spark, [(str(s),)], [("schema", "string")], "i")


@register_op("attributes", "attributes(array)", "introspection")
def attributes(src: ArrayFrame) -> ArrayFrame:
    """Name, type and nullability of each attribute."""
    return cells(src.spark, [(a.name, a.type, a.nullable) for a in src.schema.attrs], [("name", "string"), ("type_id", "string"), ("nullable", "bool")])


@register_op("dimensions", "dimensions(array)", "introspection")
def dimensions(src: ArrayFrame) -> ArrayFrame:
    """Name, bounds, chunks and least and greatest coordinate in use of each dimension."""
    box = src.box()
    top = 4611686018427387903
    rows = [(d.name, d.lo, top if d.hi is None else d.length, d.chunk, d.overlap, *(box[i] if box else (top, -top)), "int64") for i, d in enumerate(src.schema.dims)]
    return cells(src.spark, rows, [("name", "string"), ("start", "int64"), ("length", "uint64"), ("chunk_interval", "int64"), ("chunk_overlap", "int64"), ("low", "int64"), ("high", "int64"), ("type", "string")])


@register_op("list", "list([what])", "introspection")
def list_(store: Store, what: str = "arrays") -> ArrayFrame:
    """What there is: aggregates, arrays, functions, instances, libraries, macros, operators, types."""
    spark = store.spark
    names = {
        "aggregates": sorted(AGGREGATES), "operators": sorted(OPERATORS), "types": sorted(TYPES), "functions": sorted(FUNCTIONS),
        "libraries": sorted(LIBRARIES), "macros": sorted(MACROS), "instances": [spark.sparkContext.master],
        "queries": [str(x) for x in spark.sparkContext.statusTracker().getActiveJobsIds()],
    }
    if what == "arrays":
        return cells(spark, [(n, str(store.schema(n)), len(store.versions(n))) for n in store.names()], [("name", "string"), ("schema", "string"), ("versions", "int64")])
    need(what in names, f"list doesn't know {what}")
    return cells(spark, [(n,) for n in names[what]], [("name", "string")])


@register_op("fits_show", "fits_show(file)", "source")
def fits_show(spark: SparkSession, path: str) -> ArrayFrame:
    """The units of a FITS file."""
    return files.fits_show(spark, path)


@register_op("fits_input", "fits_input(file [, hdu])", "source")
def fits_input(spark: SparkSession, path: str, hdu=0) -> ArrayFrame:
    """A FITS image as an array."""
    return files.fits_input(spark, path, int(hdu))
