"""Merkle fixity audit of two replicas of WARC archives.

A replica is a table of records (archive, position, record_id, record). Within its archive a record has an
offset range, its place being the number of records before it. A leaf hashes the range and the record's SHA-256; a
node hashes the range and the hashes of its up to ``FAN`` children, in order; the top node of an archive is its
root, and roots are combined likewise up to one root. Two replicas are compared from their roots down: archives
are looked into only below nodes that differ, and within an archive only the branches that differ are followed. The
records of both replicas at leaves that differ are then matched by id, which tells a damaged record from a lost, added
or moved one.

All of it is DataFrame functions. An archive's tree is built from one row of its leaves (some 150 bytes a record, an
archive being a file of bounded size); the levels above are groups of at most FAN children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written

FAN = 10


def record(record_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.0 resource record of one page, as text; nulls are empty."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    head = [
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """(archive, no, record_id, lo, hi, sha, leaf) of a replica (archive, position, record_id, record).

    Records of one position are ordered by their hash. A null record is an empty one.
    """
    body = F.coalesce(F.col("record"), F.lit(""))
    own = records.select(F.col("archive").cast("long").alias("archive"), "position", F.col("record_id").cast("string").alias("record_id"), F.octet_length(body).cast("long").alias("__n"), F.sha2(body.cast("binary"), 256).alias("sha"))
    by = Window.partitionBy("archive").orderBy(F.col("position").asc_nulls_last(), "sha")
    own = own.select("archive", (F.row_number().over(by).cast("long") - 1).alias("no"), "record_id", F.sum("__n").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("hi"), "__n", "sha")
    own = own.withColumn("lo", F.col("hi") - F.col("__n"))
    return own.select("archive", "no", "record_id", "lo", "hi", "sha", F.sha2(F.concat(F.col("lo"), F.lit("-"), F.col("hi"), F.lit(":"), F.col("sha")), 256).alias("leaf"))


def _above(level: str) -> str:
    """SQL of the level over an array of (lo, hi, hash)."""
    node = "named_struct('lo', s[0].lo, 'hi', element_at(s, -1).hi, 'hash', sha2(concat(s[0].lo, '-', element_at(s, -1).hi, ':', array_join(transform(s, x -> x.hash), '')), 256))"
    groups = f"transform(sequence(0, (size({level}) - 1) div {FAN}), i -> slice({level}, i * {FAN} + 1, {FAN}))"
    return f"transform({groups}, s -> {node})"


def trees(leaf: DataFrame, levels: int) -> DataFrame:
    """(archive, l0, ..., root): every level of each archive's tree as arrays, ``levels`` above the leaves, and the top node's hash."""
    nodes = F.sort_array(F.collect_list(F.struct("no", "lo", "hi", F.col("leaf").alias("hash"))))
    out = leaf.groupBy("archive").agg(nodes.alias("l0"))
    for k in range(levels):
        out = out.withColumn(f"l{k + 1}", F.expr(_above(f"l{k}")))
    return out.select("archive", *[F.expr(f"transform(l{k}, x -> x.hash)").alias(f"l{k}") for k in range(levels + 1)], F.expr(f"l{levels}[0].hash").alias("root"))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level over (no, hash): ranges are of the numbers of FAN children each."""
    child = F.sort_array(F.collect_list(F.struct("no", "hash")))
    up = nodes.groupBy(F.expr(f"no div {FAN}").alias("no")).agg(F.min("no").alias("lo"), F.max("no").alias("hi"), child.alias("c"))
    return up.select("no", F.sha2(F.concat(F.col("lo"), F.lit("-"), F.col("hi"), F.lit(":"), F.array_join(F.transform("c", lambda x: x["hash"]), "")), 256).alias("hash"))


def differing_archives(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(archive) of the archives whose roots differ or that one replica lacks, found from the top root down.

    Levels above the archives are a tenth of the one below each; a level is looked at only below nodes that differ.
    """
    sides = [x.select(F.col("archive").alias("no"), F.col("root").alias("hash")) for x in (ours, theirs)]
    most = max([0, *[x.agg(F.max("no")).first()[0] or 0 for x in sides]])
    levels = [sides]
    while most:
        levels.append([written(parents(x), "level") for x in levels[-1]])
        most //= FAN
    bad = None
    for a, b in reversed(levels):
        both = a.select("no", F.lit(0).alias("side"), "hash").unionByName(b.select("no", F.lit(1).alias("side"), "hash"))
        if bad is not None:
            both = both.join(bad.select(F.col("no").alias("__up")), F.expr(f"no div {FAN}") == F.col("__up"), "left_semi")
        by = both.groupBy("no").agg(*[F.max(F.when(F.col("side") == i, F.col("hash"))).alias(n) for i, n in enumerate(("x", "y"))])
        bad = by.where(~F.col("x").eqNullSafe(F.col("y"))).select("no")
    return bad.select(F.col("no").alias("archive"))


def differing_leaves(ours: DataFrame, theirs: DataFrame, levels: int) -> DataFrame:
    """(archive, no) of the leaves that differ between two tables of trees, following only branches that differ."""
    bad = differing_archives(ours, theirs)
    both = bad.join(ours.select("archive", *[F.col(f"l{k}").alias(f"x{k}") for k in range(levels + 1)]), "archive", "left").join(theirs.select("archive", *[F.col(f"l{k}").alias(f"y{k}") for k in range(levels + 1)]), "archive", "left")
    at = f"array(0L)"
    for k in range(levels, -1, -1):
        if k < levels:
            at = f"flatten(transform({at}, i -> sequence(i * {FAN}, i * {FAN} + {FAN - 1})))"
        at = f"filter({at}, i -> NOT get(coalesce(x{k}, array()), cast(i as int)) <=> get(coalesce(y{k}, array()), cast(i as int)))"
    return both.select("archive", F.explode(F.expr(at)).alias("no"))


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row for each record of ours, and one for each record that only theirs has.

    archive, no, record_id, lo, hi, record_sha256, leaf_sha256, archive_root, status: ``ok``; ``corrupt``, theirs has other bytes;
    ``missing`` in their archive; ``shifted``, the same bytes at another place; ``added``, only theirs (no, lo, hi and
    hashes are theirs then, the root ours). Records of one id in an archive are paired in order among those that differ;
    null ids are alike. A null record is empty, equal rows are records of their own, other columns are ignored; without
    records there is no row.
    """
    mine, other = written(leaves(ours), "leaves"), written(leaves(theirs), "leaves")
    most = max([0, *[x.agg(F.max("no")).first()[0] or 0 for x in (mine, other)]])
    levels = 3
    while FAN**levels <= most:
        levels += 1
    t1, t2 = written(trees(mine, levels), "trees"), written(trees(other, levels), "trees")
    bad = written(differing_leaves(t1, t2, levels), "differing")
    # the records of both sides at those leaves, by id
    nth = Window.partitionBy("archive", "record_id").orderBy("no")
    a, b = (x.join(bad, ["archive", "no"], "left_semi").withColumn("nth", F.row_number().over(nth)) for x in (mine, other))
    b = b.select("archive", F.col("record_id").alias("__id"), "nth", *[F.col(c).alias("their_" + c) for c in ("no", "lo", "hi", "sha", "leaf")])
    same = (a["archive"] == b["archive"]) & a["record_id"].eqNullSafe(b["__id"]) & (a["nth"] == b["nth"])
    both = a.join(b, same, "full").select(*[F.coalesce(a[c], b[d]).alias(c) for c, d in (("archive", "archive"), ("record_id", "__id"))], a["no"], "lo", "hi", "sha", "leaf", *[c for c in b.columns if c.startswith("their_")])
    status = F.when(F.col("no").isNull(), "added").when(F.col("their_no").isNull(), "missing").when(F.col("sha") != F.col("their_sha"), "corrupt").otherwise("shifted")
    found = both.withColumn("status", status)
    hit = found.where("status <> 'added'").select("archive", "no", F.col("status").alias("__status"))
    rows = mine.join(hit, ["archive", "no"], "left").withColumn("status", F.coalesce("__status", F.lit("ok"))).drop("__status")
    more = found.where("status = 'added'").select("archive", F.col("their_no").alias("no"), "record_id", *[F.col("their_" + c).alias(c) for c in ("lo", "hi", "sha", "leaf")], "status")
    out = rows.unionByName(more).join(t1.select("archive", "root"), "archive", "left")
    return out.select("archive", "no", "record_id", "lo", "hi", F.col("sha").alias("record_sha256"), F.col("leaf").alias("leaf_sha256"), F.col("root").alias("archive_root"), "status")
