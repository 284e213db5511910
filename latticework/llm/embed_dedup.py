"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

Each of ``tables`` tables hashes a vector by ``depth`` pseudo-random rotations (three rounds
of random signs and a fast Hadamard transform, after Andoni et al. 2015): the closest of
the 2d signed axes. A vector enters the home bucket and the ``probes - 1`` next most
likely ones of every table (multiprobe on both sides). Pairs in a bucket pass a 128-bit
sign sketch, then the cosine in double precision decides; none below it is reported.

Vectors are hashed relative to their mean, as embeddings often share a direction; links are verified on the
vectors themselves. A sample (at most ``SAMPLE`` vectors of the table) gives the mean and the sizes: depth follows
the logarithm of the number of vectors, so that a bucket holds a few unrelated ones, and three times as many tables are taken as
find 97 % of pairs made from the sample at just the least cosine (``fitted``), whatever the number of components; a depth
that would need more than ``MOST_TABLES`` isn't used, so a vector has a bounded number of buckets.

Hot groups: equal vectors are one class. Each bucket compares its vectors with its
smallest id; those within half the angle form a cell around it, whose members are all
linked with each other by the triangle inequality of angles, without testing pairs. From
then on cells meet cells, and a bucket of more than ``CROWD`` cells is split by a further rotation around the
bucket's own mean, with probes of its own, until none is left or splitting doesn't help. A pair of cells is decided as a
whole where the inequality allows; members of borderline pairs are counted by matrix products of blocks of at most
some ``BLOCK`` vectors, which emit a count a vector and one link, not the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import dropped, written
from .common import components, mix64, prepare

PROBES, SKETCH = 4, 128
SAMPLE, MOST_TABLES, CROWD, BLOCK, SPLITS = 4096, 96, 256, 256, 6
EPS = 1e-6


def _size(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.default_rng(seed).integers(0, 2, (3, x.shape[1])) * 2.0 - 1
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets(unit: np.ndarray, tables: int, depth: int, probes: int = PROBES, first: int = 0) -> np.ndarray:
    """Bucket keys (n, tables * probes) of vectors of any length, the home bucket first in each table from ``first`` on."""
    n, d0 = unit.shape
    d = _size(d0)
    x = np.zeros((n, d))
    x[:, :d0] = unit
    out = np.empty((n, tables, probes), np.uint64)
    top = min(probes, d)
    for t in range(first, first + tables):
        costs, codes = np.zeros((n, 1)), np.full((n, 1), d0 * 4096 + t, np.uint64)
        for k in range(depth):
            r = rotated(x, 1000 * t + k + 1)
            a = np.abs(r)
            best = np.argpartition(a, d - top, axis=1)[:, d - top :]
            size = np.take_along_axis(a, best, 1)
            order = np.argsort(-size, axis=1, kind="stable")
            best, size = np.take_along_axis(best, order, 1), np.take_along_axis(size, order, 1)
            sign = np.take_along_axis(r, best, 1) < 0
            cost = (size[:, :1] - size) ** 2
            costs = (costs[:, :, None] + cost[:, None, :]).reshape(n, -1)
            codes = mix64((codes[:, :, None] + (2 * best + sign + 1).astype(np.uint64)[:, None, :]).reshape(n, -1))
            keep = np.argsort(costs, axis=1, kind="stable")[:, :probes]
            costs, codes = np.take_along_axis(costs, keep, 1), np.take_along_axis(codes, keep, 1)
        if codes.shape[1] < probes:
            codes = np.pad(codes, ((0, 0), (0, probes - codes.shape[1])), mode="edge")
        out[:, t - first] = codes
    return out.reshape(n, -1).view(np.int64)


def sketches(unit: np.ndarray) -> np.ndarray:
    """Two words of sign bits of 128 random projections."""
    p = np.random.default_rng(unit.shape[1]).standard_normal((unit.shape[1], SKETCH))
    bits = np.packbits(unit @ p > 0, axis=1)
    return np.ascontiguousarray(bits).view("<i8")


def _apart(sample: np.ndarray, least: float) -> np.ndarray:
    """The sample without what is linked to a vector before, so that a group of copies doesn't draw the mean."""
    free = np.ones(len(sample), bool)
    for i in range(len(sample)):
        if free[i]:
            free[i + 1 :] &= sample[i + 1 :] @ sample[i] < least
    return sample[free]


def fitted(sample: np.ndarray, n: int, least: float, probes: int = PROBES) -> tuple[np.ndarray, int, int]:
    """(centre, depth, tables) for n vectors like the sample's unit vectors.

    Pairs at the least cosine are made around the centre: both as far from it as the sample's vector is. The
    depth is the largest, up to one that leaves few unrelated vectors in a bucket, at which a third of MOST_TABLES find 97 % of
    them; three times the tables that do are taken, which finds some 99.99 %.
    """
    d = sample.shape[1]
    centre = _apart(sample, least).mean(0)
    u = sample[:512] - centre
    r = np.random.default_rng(d)
    z = r.standard_normal(u.shape)
    square = np.maximum((u * u).sum(1), 1e-12)
    z -= ((z * u).sum(1) / square)[:, None] * u
    cos = np.clip(1 - (1 - least) / square, -0.5, 1)
    z *= (np.sqrt(square) * np.sqrt(1 - cos**2) / np.maximum(np.linalg.norm(z, axis=1), 1e-12))[:, None]
    v = cos[:, None] * u + z
    for depth in range(max(1, math.ceil(math.log(max(n, 2) * probes / 4) / math.log(2 * _size(d)))), 0, -1):
        hit = np.zeros(len(u), bool)
        for t in range(MOST_TABLES // 3):
            x, y = (buckets(q, 1, depth, probes, t) for q in (u, v))
            hit |= (x[:, :, None] == y[:, None, :]).any((1, 2))
            if hit.mean() >= 0.97:
                return centre, depth, 3 * (t + 1)
            if t == 5 and (1 - hit.mean()) ** (MOST_TABLES / 18) > 0.03:
                break  # out of reach at this depth
    return centre, 1, MOST_TABLES


def _vectors(table: DataFrame) -> DataFrame:
    """(vec_id, cid, d, unit, s1, s2); the last four null where the vector can't be compared."""
    names = ["vec_id", "cid", "d", "unit", "s1", "s2"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            cid, dim, unit, sk = [None] * n, [None] * n, [None] * n, np.zeros((n, 2), np.int64)
            groups: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, x in enumerate(part.column(1)):
                if x.is_valid and len(x) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    most = np.abs(v).max() if np.isfinite(v).all() else 0.0
                    if most > 0:
                        v = v / most
                        groups.setdefault(len(v), []).append((i, v / math.sqrt(float(v @ v))))
            for d, own in groups.items():
                at = [i for i, _ in own]
                u = np.stack([v for _, v in own]) + 0.0
                sk[at] = sketches(u)
                for i, v in zip(at, u):
                    unit[i], dim[i] = v.tobytes(), d
                    cid[i] = int.from_bytes(xxhash.xxh3_64_digest(unit[i]), "little", signed=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cid, pa.int64()), pa.array(dim, pa.int32()), pa.array(unit, pa.binary()), pa.array(sk[:, 0]), pa.array(sk[:, 1])], names=names)

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, cid long, d int, unit binary, s1 long, s2 long")


#: Depth and tables of lengths that the sample lacks.
RARE = (1, 8)


def _bucketed(classes: DataFrame, fits: dict[int, tuple[np.ndarray, int, int]]) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(fits)  # a centre for each length of vector in the sample

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cid, d, s1, s2 = (part.column(i).to_numpy() for i in (0, 1, 3, 4))
            raw = part.column(2).to_pylist()
            for size in np.unique(d):
                at = np.flatnonzero(d == size)
                centre, depth, tables = shared.value.get(int(size), (0.0, *RARE))
                keys = buckets(np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), size) - centre, tables, depth)
                w = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *(pa.array(np.repeat(c[at], w)) for c in (cid, s1, s2))], names=["key", "cid", "s1", "s2"])

    return classes.select("cid", "d", "unit", "s1", "s2").mapInArrow(run, "key long, cid long, s1 long, s2 long").distinct()


def _split(rows: DataFrame, crowded: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """(key, cid, cell) of the crowded buckets under new keys: a further rotation around each bucket's mean.

    The mean is that of at most 64 of the bucket's vectors, the smallest hashes.
    """
    near = written(rows.join(crowded.select("key"), "key").join(classes.select("cid", "d", "unit"), "cid"), "crowded")
    few = near.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy("cid"))).where("__r <= 64")
    means = few.groupBy("key").agg(F.collect_list("unit").alias("near"))  # 64 at most
    names = ["key", "cid", "cell"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            key, cid, cell = (part.column(i).to_numpy() for i in range(3))
            for k in np.unique(key):
                at = np.flatnonzero(key == k)
                raw = [np.frombuffer(x) for x in part.column(3).take(pa.array(at)).to_pylist()]
                centre = part.column(4)[int(at[0])].as_py()
                size = len(raw[0])
                own = [i for i, x in enumerate(raw) if len(x) == size]
                centre = np.mean([c for c in (np.frombuffer(x) for x in centre) if len(c) == size] or [np.zeros(size)], axis=0)
                probes = min(PROBES, max(1, _size(size) // 8))
                new = buckets(np.stack([raw[i] for i in own]) - centre, 1, 1, probes, 10_000 + turn)
                mixed = mix64(new.view(np.uint64) ^ np.uint64(int(k) & (1 << 64) - 1)).view(np.int64)
                at = at[own]
                yield pa.RecordBatch.from_arrays([pa.array(mixed.reshape(-1)), pa.array(np.repeat(cid[at], probes)), pa.array(np.repeat(cell[at], probes))], names=names)

    return near.join(means, "key").select("key", "cid", "cell", "unit", "near").mapInArrow(run, "key long, cid long, cell long").distinct()


def _uncrowded(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, cell), distinct, of rows (key, cid, cell), the buckets of more than CROWD cells split."""
    done = None
    for turn in range(SPLITS):
        sizes = rows.groupBy("key").agg(F.count_distinct("cell").alias("n")).where(f"n > {CROWD}")
        crowded = written(sizes, "sizes")
        if crowded.isEmpty():
            break
        part = rows.join(crowded.select("key"), "key", "left_anti").select("key", "cell")
        done = part if done is None else done.unionByName(part)
        rows = written(_split(rows, crowded, classes, turn), "split")
    rest = rows.select("key", "cell")
    return (rest if done is None else done.unionByName(rest)).distinct()


def _blocks(cells: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """(cell, block, own): the members of wanted cells in blocks of some BLOCK (cid, m, unit)."""
    size = cells.join(wanted, "cell").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("__blocks"))
    rows = cells.select("cell", "cid", "m").join(size, "cell").join(classes.select("cid", "unit"), "cid")
    return rows.groupBy("cell", F.pmod(F.xxhash64("cid"), F.col("__blocks")).alias("block")).agg(F.collect_list(F.struct("cid", "m", "unit")).alias("own")).select("cell", "own")


def _counted(some: DataFrame, blocks: DataFrame, least: float) -> DataFrame:
    """(x, y, k) for pairs of cells (a, b): with null y, vectors that member x links in the other cell; else one link of a pair of blocks."""
    both = some.join(blocks.toDF("a", "p"), "a").join(blocks.toDF("b", "q"), "b").select("p", "q")
    names = ["x", "y", "k"]

    def sides(block: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = block.values
        raw = own.field("unit").to_pylist()
        return own.field("cid").to_numpy(), own.field("m").to_numpy(), np.frombuffer(b"".join(raw)).reshape(len(raw), -1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for p, q in zip(part.column(0), part.column(1)):
                (c1, m1, u1), (c2, m2, u2) = sides(p), sides(q)
                if u1.shape[1] != u2.shape[1]:
                    continue
                hit = u1 @ u2.T >= least
                if hit.any():
                    k1, k2 = hit @ m2, m1 @ hit
                    i, j = np.unravel_index(int(np.argmax(hit)), hit.shape)
                    at1, at2 = np.flatnonzero(k1), np.flatnonzero(k2)
                    x = np.concatenate([c1[at1], c2[at2], [c1[i]]])
                    y = pa.array([None] * (len(x) - 1) + [int(c2[j])], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x), y, pa.array(np.concatenate([k1[at1], k2[at2], [0]]).astype(np.int64))], names=names)

    return both.mapInArrow(run, "x long, y long, k long")


def _angles(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, cos) of the pairs that have one length."""
    own = classes.select("cid", "d", "unit")
    both = pairs.join(own.toDF("a", "da", "ua"), "a").join(own.toDF("b", "db", "ub"), "b").where("da = db").select("a", "b", "ua", "ub")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cos = [float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cos, pa.float64())], names=["a", "b", "cos"])

    return both.mapInArrow(run, "a long, b long, cos double")


def near_vectors(table: DataFrame, least: float = 0.9, tables: int | None = None, depth: int | None = None) -> DataFrame:
    """Links of cosine >= ``least``: vec_id, n_links, component_id, kept; one row per input row.

    Null, empty, zero vectors and those with null or non-finite components have no links
    and are their own component; so have vectors of another length than all others. Equal
    vectors of different ids are linked. Repeated rows are one vector. A null vec_id takes no part:
    no links, component null, kept. No rows give none.
    """
    spark = prepare(table.sparkSession)
    theta = math.acos(least)
    rows = written(_vectors(table), "vectors")
    valid = rows.where("cid is not null and vec_id is not null")
    classes = written(valid.groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("m"), *(F.first(c).alias(c) for c in ("d", "unit", "s1", "s2"))), "classes")
    n = {r["d"]: r["n"] for r in classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(SAMPLE).collect()}
    near: dict[int, list[np.ndarray]] = {}
    for r in classes.orderBy("cid").limit(SAMPLE).select("d", "unit").collect():  # cid is a hash
        near.setdefault(r["d"], []).append(np.frombuffer(r["unit"]))
    fits = {d: fitted(np.stack(x), n.get(d, len(x)), least) for d, x in near.items()}
    if tables or depth:
        fits = {d: (c, depth or k, tables or t) for d, (c, k, t) in fits.items()}
    b = written(_bucketed(classes, fits), "buckets")

    # cells: around the smallest class of a bucket
    bits = "bit_count(s1 ^ {0}1) + bit_count(s2 ^ {0}2)"
    heads = b.groupBy("key").agg(F.min(F.struct("cid", "s1", "s2")).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("h.cid").alias("head"), F.col("h.s1").alias("h1"), F.col("h.s2").alias("h2"))
    allowed = lambda angle: f"{SKETCH} * ({angle}) / pi() + 27"  # noqa: E731 - five deviations of the sketch
    stars = b.join(heads.hint("shuffle_hash"), "key").where(f"cid <> head and {bits.format('h')} <= {allowed(theta / 2)}").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
    close = written(_angles(stars, classes).where(F.col("cos") >= math.cos(theta / 2 - EPS)), "close")
    cell = close.join(close.select(F.col("b").alias("a")).distinct(), "a", "left_anti").groupBy("b").agg(F.min(F.struct("a", "cos")).alias("h")).select(F.col("b").alias("cid"), F.col("h.a").alias("cell"), F.acos(F.least(F.col("h.cos"), F.lit(1.0))).alias("r"))
    cells = written(classes.select("cid", "m", "rep").join(cell, "cid", "left").select("cid", "m", "rep", F.coalesce("cell", "cid").alias("cell"), F.coalesce("r", F.lit(0.0)).alias("r")), "cells")
    wide = written(cells.groupBy("cell").agg(F.sum("m").alias("size"), F.max("r").alias("radius")).join(classes.select(F.col("cid").alias("cell"), "s1", "s2"), "cell"), "wide")

    # cells that share a bucket
    at = written(_uncrowded(b.select("key", "cid").join(cells.select("cid", "cell"), "cid"), classes), "met").join(wide.select("cell", "radius", "s1", "s2"), "cell")
    other = at.toDF("other", "key", "o_radius", "o1", "o2")
    met = at.join(other, "key").where(f"cell < other and {bits.format('o')} <= {allowed(f'{theta} + radius + o_radius')}").select(F.col("cell").alias("a"), F.col("other").alias("b")).distinct()
    size = wide.select("cell", "size", "radius")
    pairs = _angles(met, classes).join(size.toDF("a", "na", "ra"), "a").join(size.toDF("b", "nb", "rb"), "b")
    # a pair of lone vectors is decided by its cosine alone, exactly
    lone = (F.col("ra") == 0) & (F.col("rb") == 0)
    angle = F.acos(F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0)))
    kind = F.when(lone, F.when(F.col("cos") >= least, "all").otherwise("none")).when(angle + F.col("ra") + F.col("rb") <= theta - EPS, "all").when(angle - F.col("ra") - F.col("rb") > theta + EPS, "none").otherwise("some")
    pairs = written(pairs.withColumn("kind", kind).where("kind <> 'none'").select("a", "b", "na", "nb", "kind"), "pairs")
    some = pairs.where("kind = 'some'").select("a", "b")
    wanted = some.select(F.col("a").alias("cell")).unionByName(some.select(F.col("b").alias("cell"))).distinct()
    exact = written(_counted(some, _blocks(cells, wanted, classes), least), "exact")

    every = pairs.where("kind = 'all'")
    by_cell = every.select(F.col("a").alias("cell"), F.col("nb").alias("k")).unionByName(every.select(F.col("b").alias("cell"), F.col("na").alias("k"))).groupBy("cell").agg(F.sum("k").alias("k"))
    by_one = exact.where("y is null").groupBy(F.col("x").alias("cid")).agg(F.sum("k").alias("k1"))
    edges = cells.where("cid <> cell").select(F.col("cid").alias("a"), F.col("cell").alias("b")).unionByName(every.select("a", "b")).unionByName(exact.where("y is not null").select(F.col("x").alias("a"), F.col("y").alias("b")))
    rep = cells.select("cid", "rep")
    edges = edges.join(rep.toDF("a", "ra"), "a").join(rep.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    several = valid.join(rep, "cid").where("vec_id <> rep").groupBy("vec_id", "rep").count().groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    own = rep.join(valid.select("vec_id", "cid").distinct(), "cid").where("rep <> vec_id").join(classes.select(F.col("rep").alias("vec_id")).distinct(), "vec_id", "left_semi").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    roots = components(edges.unionByName(several).unionByName(own))
    for x in (b, close):
        dropped(x)

    links = cells.join(wide.select("cell", "size"), "cell").join(by_cell, "cell", "left").join(by_one, "cid", "left").select("cid", "rep", (F.col("size") - 1 + F.coalesce("k", F.lit(0)) + F.coalesce("k1", F.lit(0))).alias("n_links"))
    links = links.join(roots.toDF("rep", "root"), "rep", "left").select("cid", "n_links", F.coalesce("root", "rep").alias("root"))
    found = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("cid")).alias("cid")).join(links, "cid", "left")
    component = F.coalesce("root", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
