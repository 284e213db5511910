"""Distribution, evaluation, explanation and settings."""

from __future__ import annotations

import importlib
import os
import shutil

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import ArrayFrame, chunk_of
from ..schema import ArraySchema, Attr, Dim, need
from .registry import OPERATORS, register_op


def cells(spark: SparkSession, rows: list[tuple], attrs: list[tuple[str, str]], dim: str = "No") -> ArrayFrame:
    """A small one-dimensional array of rows that the driver knows."""
    s = ArraySchema(tuple(Attr(n, t, True) for n, t in attrs), (Dim(dim, 0, max(len(rows) - 1, 0), max(len(rows), 1)),))
    from ..schema import TYPES

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join([f"`{dim}` bigint", *[f"`{n}` {TYPES[t]}" for n, t in attrs]]))
    return ArrayFrame(df, s)


@register_op("sg", "sg(src, scheme [, instance])", "distribution")
def sg(src: ArrayFrame, scheme=1, *_rest) -> ArrayFrame:
    """Redistribute: 0 replicate and 2 local (left to the planner), 1 by hash of the chunk, 3 by row, 4 by column, 5 as it is."""
    k, dims = int(scheme), src.schema.dims
    need(0 <= k <= 5, "sg: the scheme lies in 0..5")
    if k == 1:
        return ArrayFrame(src.df.repartition(*[chunk_of(d) for d in dims]), src.schema)
    if k in (3, 4):
        return ArrayFrame(src.df.repartitionByRange(f"`{dims[0 if k == 3 else min(1, len(dims) - 1)].name}`"), src.schema)
    return src


@register_op("reduce_distro", "reduce_distro(src, scheme)", "distribution")
def reduce_distro(src: ArrayFrame, scheme=1) -> ArrayFrame:
    """Rows have no replicas here: the array itself."""
    return src


@register_op("materialize", "materialize(src, format)", "distribution")
def materialize(src: ArrayFrame, format_=0) -> ArrayFrame:
    """Evaluate once into the shared folder and read from there."""
    from ..plans.lineage import written

    return ArrayFrame(written(src.df, "materialize"), src.schema)


@register_op("consume", "consume(src [, stride])", "distribution")
def consume(src: ArrayFrame, stride=1) -> None:
    """Evaluate every cell and return nothing."""
    src.df.write.format("noop").mode("overwrite").save()


@register_op("explain_logical", "explain_logical(src)", "introspection")
def explain_logical(src: ArrayFrame, *_lang: str) -> ArrayFrame:
    """The logical plan as one cell of text."""
    return cells(src.spark, [(src.df._jdf.queryExecution().optimizedPlan().toString(),)], [("logical_plan", "string")])


@register_op("explain_physical", "explain_physical(src)", "introspection")
def explain_physical(src: ArrayFrame, *_lang: str) -> ArrayFrame:
    """The physical plan as one cell of text."""
    return cells(src.spark, [(src.df._jdf.queryExecution().executedPlan().toString(),)], [("physical_plan", "string")])


@register_op("echo", "echo(text)", "source")
def echo(spark: SparkSession, text: str) -> ArrayFrame:
    """One cell with the text."""
    return cells(spark, [(text,)], [("text", "string")], "i")


@register_op("help", "help([operator])", "introspection")
def help_(spark: SparkSession, name: str | None = None) -> ArrayFrame:
    """An operator's signature as one cell, or all of them."""
    need(name is None or name in OPERATORS, f"no operator {name}")
    chosen = [OPERATORS[name]] if name else [OPERATORS[k] for k in sorted(OPERATORS)]
    return cells(spark, [(f"{o.signature}: {o.doc}",) for o in chosen], [("help", "string")], "i")


@register_op("setopt", "setopt(option [, value])", "settings")
def setopt(spark: SparkSession, option: str, value: str | None = None) -> ArrayFrame:
    """A Spark setting's value, and the new one if it is given."""
    old = spark.conf.get(option, "")
    if value is None:
        return cells(spark, [(old,)], [("old", "string")])
    spark.conf.set(option, value)
    return cells(spark, [(old, value)], [("old", "string"), ("new", "string")])


@register_op("cancel", "cancel(tag)", "settings")
def cancel(spark: SparkSession, tag) -> None:
    """Stop the jobs of a query; queries carry their id as a job tag."""
    spark.sparkContext.cancelJobsWithTag(str(tag))


@register_op("mstat", "mstat()", "introspection")
def mstat(spark: SparkSession) -> ArrayFrame:
    """Memory of each block manager: most and remaining bytes."""
    found = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    it, rows = found.iterator(), []
    while it.hasNext():
        x = it.next()
        rows.append((x._1(), int(x._2()._1()), int(x._2()._2())))
    return cells(spark, rows, [("executor", "string"), ("memory", "int64"), ("free", "int64")], "Instance")


@register_op("diskinfo", "diskinfo()", "introspection")
def diskinfo(spark: SparkSession) -> ArrayFrame:
    """Bytes used, free and in all where the warehouse lies."""
    where = spark.conf.get("spark.sql.warehouse.dir", "/").removeprefix("file:") or "/"
    while not os.path.exists(where) and where != "/":
        where = os.path.dirname(where)
    u = shutil.disk_usage(where)
    return cells(spark, [(u.used, u.free, u.total)], [("used", "int64"), ("available", "int64"), ("total", "int64")], "Instance")


@register_op("mpi_init", "mpi_init()", "settings")
def mpi_init(spark: SparkSession) -> ArrayFrame:
    """Nothing has to be reset here: one empty cell."""
    return cells(spark, [(True,)], [("ready", "bool")], "i")


register_op("mpicopy", "mpicopy(src)", "settings")(reduce_distro)


@register_op("hello_instances", "hello_instances()", "introspection")
def hello_instances(spark: SparkSession) -> ArrayFrame:
    """A cell from each parallel slot."""
    n = spark.sparkContext.defaultParallelism
    df = spark.range(n, numPartitions=n).select(F.col("id").alias("instance"), F.concat(F.lit("partition "), F.spark_partition_id()).alias("status"))
    return ArrayFrame(df, ArraySchema((Attr("status", "string"),), (Dim("instance", 0, n - 1, 1),)))


@register_op("instance_stats", "instance_stats(src)", "introspection")
def instance_stats(src: ArrayFrame, *_options: str) -> ArrayFrame:
    """Cells of each partition: number, and over partitions least, most and mean."""
    per = src.df.groupBy(F.spark_partition_id().cast("bigint").alias("instance")).agg(F.count(F.lit(1)).alias("n"))
    df = per.agg(F.count(F.lit(1)).alias("partitions"), F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean")).select(F.lit(0).cast("bigint").alias("i"), "*")
    return ArrayFrame(df, ArraySchema((Attr("partitions", "int64"), Attr("cells", "int64"), Attr("least", "int64", True), Attr("most", "int64", True), Attr("mean", "double", True)), (Dim("i", 0, 0, 1),)))


LIBRARIES: dict[str, object] = {}
MACROS: dict[str, tuple[list[str], str]] = {}


@register_op("load_library", "load_library(module)", "settings")
def load_library(spark: SparkSession, name: str) -> None:
    """Import a Python module; its ``register(spark)`` may add functions and operators."""
    module = importlib.import_module(name)
    if hasattr(module, "register"):
        module.register(spark)
    LIBRARIES[name] = module


@register_op("unload_library", "unload_library(module)", "settings")
def unload_library(spark: SparkSession, name: str) -> None:
    """Forget a loaded module."""
    need(name in LIBRARIES, f"no library {name}")
    del LIBRARIES[name]


@register_op("load_module", "load_module(file)", "settings")
def load_module(spark: SparkSession, path: str) -> None:
    """Read macro definitions ``fn name(args) = body;`` into the macro table."""
    from ..lang.afl import read_macros

    with open(path) as f:
        MACROS.update(read_macros(f.read()))
