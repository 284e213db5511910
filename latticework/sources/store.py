"""Versioned storage: a folder of Parquet per write under a root, and numbered manifests as JSON.

A version's files are written first, then the next manifest (``manifest-<n>.json``), which is never written over: of two
writers one gets the number and the other an error, and a writer that dies leaves the array as it was. A version names the
folders that make it up, the newest first; an insert writes its own cells only, a scan merges them (the newest
cell at a coordinate wins), and after ``DEPTH`` inserts one writes the whole again. Files are reached through Hadoop's file
system, so the root may be anywhere that executors share. Rows are clustered by chunk so that coordinate
filters skip files and row groups.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import ArrayFrame, chunk_of
from ..schema import ArrayError, ArraySchema, Attr, Dim, need, parse_schema


#: Folders that a scan merges at most; seconds for which an unreadable newest manifest counts as one in the making.
DEPTH, MAKING = 8, 60.0


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.temp: dict[str, ArrayFrame] = {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    # -- manifests

    def _numbers(self, name: str) -> list[int]:
        """Numbers of an array's manifests, the newest first."""
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return []
        found = (re.fullmatch(r"manifest-(\d+)\.json", s.getPath().getName()) for s in self._fs.listStatus(folder))
        return sorted((int(m[1]) for m in found if m), reverse=True)

    def _manifest(self, name: str, number: int) -> str:
        return f"{self.root}/{name}/manifest-{number:08d}.json"

    def exists(self, name: str) -> bool:
        return name in self.temp or bool(self._numbers(name))

    def manifest(self, name: str) -> dict:
        """The newest manifest that can be read; ``number`` is its own."""
        for number in self._numbers(name):
            path = self._path(self._manifest(name, number))
            status = self._fs.getFileStatus(path)
            stream = self._fs.open(path)
            try:
                text = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, status.getLen())).decode()
            finally:
                stream.close()
            try:
                return json.loads(text) | {"number": number}
            except ValueError:  # its writer died, or is still writing
                need(time.time() - status.getModificationTime() / 1000 > MAKING, f"a manifest of {name} is being written")
        raise ArrayError(f"no array {name}")

    def _commit(self, name: str, value: dict) -> None:
        """Write the manifest after the one that ``value`` came from; an error if another writer has."""
        number = max([value.get("number", 0), *self._numbers(name)[:1]]) + 1
        before = value.get("number", 0)
        newer = [n for n in self._numbers(name) if n > before]
        for n in newer:  # unreadable ones of dead writers don't count
            need(not self._readable(name, n), f"{name} was changed by another writer")
        body = bytearray(json.dumps({k: v for k, v in value.items() if k != "number"}).encode())
        try:
            out = self._fs.create(self._path(self._manifest(name, number)), False)
        except Exception as error:  # Py4J's wrapper of FileAlreadyExistsException
            raise ArrayError(f"{name} was changed by another writer") from error
        try:
            out.write(body)
        finally:
            out.close()
        for n in self._numbers(name)[16:]:
            self._fs.delete(self._path(self._manifest(name, n)), False)

    def _readable(self, name: str, number: int) -> bool:
        stream = self._fs.open(self._path(self._manifest(name, number)))
        try:
            json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            return True
        except ValueError:
            return False
        finally:
            stream.close()

    def names(self) -> list[str]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory()]
        return sorted(x for x in found if self._numbers(x))

    # -- arrays

    def create(self, name: str, schema: str | ArraySchema, temp: bool = False) -> None:
        s = parse_schema(schema) if isinstance(schema, str) else schema
        need(not self.exists(name), f"array {name} exists")
        if temp:
            self.temp[name] = empty(self.spark, s.with_(name=name))
            return
        self._fs.mkdirs(self._path(f"{self.root}/{name}"))
        self._commit(name, {"schema": str(s.with_(name=name)), "versions": []})

    def schema(self, name: str) -> ArraySchema:
        return self.temp[name].schema if name in self.temp else parse_schema(self.manifest(name)["schema"])

    def versions(self, name: str) -> list[dict]:
        return [] if name in self.temp else self.manifest(name)["versions"]

    def scan(self, name: str, version: int | None = None) -> ArrayFrame:
        """The latest version, or the given one (0 is the empty array)."""
        if name in self.temp:
            need(version is None, f"{name} is temporary, it has no versions")
            return self.temp[name]
        m = self.manifest(name)
        s = parse_schema(m["schema"])
        if version is None:
            version = m["versions"][-1]["id"] if m["versions"] else 0
        if version == 0:
            return empty(self.spark, s)
        found = [v for v in m["versions"] if v["id"] == version]
        need(bool(found), f"{name} has no version {version}")
        from ..operators.joins import merge

        parts = [ArrayFrame.of(self.spark.read.parquet(f"{self.root}/{name}/{d}"), s) for d in found[0]["dirs"]]
        return parts[0] if len(parts) == 1 else ArrayFrame(merge(*parts).df, s)

    def at(self, name: str, moment: str) -> ArrayFrame:
        """The version that was current at a moment (UTC, ISO)."""
        stamp = datetime.fromisoformat(moment).replace(tzinfo=timezone.utc).timestamp()
        old = [v for v in self.versions(name) if v["timestamp"] <= stamp]
        return self.scan(name, old[-1]["id"] if old else 0)

    def store(self, src: ArrayFrame, name: str) -> ArrayFrame:
        """A new version that holds just the cells of ``src``; the array is made if it isn't there."""
        if not self.exists(name):
            self.create(name, src.schema)
        to = self.schema(name)
        _fits(src.schema, to)
        df = src.df.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(src.schema.names, to.names)])
        if name in self.temp:
            from ..plans.lineage import written

            self.temp[name] = ArrayFrame.of(written(df, "temp"), to)
            return self.temp[name]
        return self._added(df, name, [], None)

    def _added(self, df: DataFrame, name: str, under: list[str], batch: str | None) -> ArrayFrame:
        """A new version: these rows over the folders ``under``."""
        m, to = self.manifest(name), self.schema(name)
        version = max([0, *[v["id"] for v in m["versions"]]]) + 1
        where = f"v{version}-{uuid.uuid4().hex[:8]}"
        # files cover ranges of chunks, so that coordinate filters skip files and row groups
        chunks = [chunk_of(d) for d in to.dims]
        out = df.repartitionByRange(*chunks).sortWithinPartitions(*chunks, *[F.col(f"`{d}`") for d in to.dim_names])
        out.write.parquet(f"{self.root}/{name}/{where}")
        found = {"id": version, "dirs": [where, *under], "timestamp": time.time()} | ({"batch": batch} if batch else {})
        self._commit(name, m | {"versions": [*m["versions"], found]})
        return self.scan(name, version)

    def insert(self, src: ArrayFrame, name: str, batch: str | None = None) -> ArrayFrame:
        """A new version: the cells of ``src`` over those that were there. Only they are written, but for every DEPTH-th time.

        A ``batch`` that a version has already isn't inserted again.
        """
        from ..operators.joins import merge

        to = self.schema(name)
        _fits(src.schema, to)
        new = ArrayFrame.of(src.df.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(src.schema.names, to.names)]), to)
        if name in self.temp:
            return self.store(merge(new, self.scan(name)), name)
        last = self.versions(name)
        if batch and any(v.get("batch") == batch for v in last):
            return self.scan(name)
        under = last[-1]["dirs"] if last else []
        if len(under) >= DEPTH:
            return self._added(merge(new, self.scan(name)).df, name, [], batch)
        return self._added(new.df, name, under, batch)

    def remove(self, name: str) -> None:
        if name in self.temp:
            del self.temp[name]
            return
        need(self.exists(name), f"no array {name}")
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def remove_versions(self, name: str, oldest: int) -> None:
        """Forget the versions before ``oldest``, then delete their files."""
        m = self.manifest(name)
        need(any(v["id"] == oldest for v in m["versions"]), f"{name} has no version {oldest}")
        kept = [v for v in m["versions"] if v["id"] >= oldest]
        used = {d for v in kept for d in v["dirs"]}
        gone = {d for v in m["versions"] for d in v["dirs"]} - used
        self._commit(name, m | {"versions": kept})
        for d in sorted(gone):
            self._fs.delete(self._path(f"{self.root}/{name}/{d}"), True)

    def rename(self, old: str, new: str) -> None:
        need(self.exists(old), f"no array {old}")
        need(not self.exists(new), f"array {new} exists")
        if old in self.temp:
            self.temp[new] = self.temp.pop(old)
            return
        m = self.manifest(old)
        self._commit(old, m | {"schema": str(parse_schema(m["schema"]).with_(name=new))})
        need(self._fs.rename(self._path(f"{self.root}/{old}"), self._path(f"{self.root}/{new}")), f"{old} can't be renamed")

    def allversions(self, name: str) -> ArrayFrame:
        """Every version's cells under a first dimension VersionNo."""
        from functools import reduce

        s, vs = self.schema(name), self.versions(name)
        out = s.with_(dims=[Dim("VersionNo", 1, max([1, *[v["id"] for v in vs]]), 1), *s.dims])
        if not vs:
            return empty(self.spark, out)
        parts = [self.scan(name, v["id"]).df.withColumn("VersionNo", F.lit(v["id"]).cast("bigint")) for v in vs]
        return ArrayFrame.of(reduce(lambda a, b: a.unionByName(b), parts), out)


def _fits(a: ArraySchema, b: ArraySchema) -> None:
    need(len(a.attrs) == len(b.attrs) and len(a.dims) == len(b.dims), f"{a} doesn't fit {b}")
    for x, y in zip(a.attrs, b.attrs):
        need(x.type == y.type, f"{x.name} is {x.type}, {y.name} is {y.type}")
        need(y.nullable or not x.nullable, f"{x.name} may be null, {y.name} may not")
    for d, e in zip(a.dims, b.dims):
        need(d.lo >= e.lo and (e.hi is None or (d.hi is not None and d.hi <= e.hi)), f"{d} lies outside {e}")


def empty(spark: SparkSession, s: ArraySchema) -> ArrayFrame:
    from ..schema import TYPES

    fields = [f"`{d}` bigint" for d in s.dim_names] + [f"`{a.name}` {TYPES[a.type]}" for a in s.attrs]
    return ArrayFrame.of(spark.createDataFrame([], ", ".join(fields)), s)


__all__ = ["Attr", "Store", "empty"]
