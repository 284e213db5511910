"""MinHash near-duplicates by a multi-index Hamming join (after Norouzi et al. 2012).

A document is its set of distinct word shingles. Its signature has ``K`` symbols, the
low ``b`` bits of the set's minimum under ``K`` hash functions. The signature distance is
the number of differing symbols (a metric). The symbols are cut into ``m`` chunks; by the
pigeonhole principle two signatures at distance ``D <= 2m - 1`` agree up to one symbol in
some chunk. So for every chunk each choice of its one allowed error is enumerated by
leaving that symbol out: the remaining symbols form a key, ``K`` keys in all, and every
pair within ``D`` has an equal key. Pairs found are confirmed on the full sets.

At similarity s a symbol differs with chance 1 - s, so with K = 65, m = 13, D = 25 a pair
of similarity 0.8 lies beyond D with chance below 2e-4, one of 0.85 below 1e-6.

Hot groups: documents with equal sets are one class (combined before the shuffle), only
classes enter the join. Within a key's bucket every class is compared with the bucket's
smallest id first, which connects copies at the cost of as many pairs as a bucket has rows. What is left are
pairs of a bucket that lie in different components so far. A bucket of at most ``CROWD`` classes gives them
directly, so a class has a bounded number of them. Classes of larger buckets (templates, shared passages: near
in signature, yet mostly not similar) meet by an exact prefix join instead: a set's shingles
are ordered by how rare they are, and two sets of similarity t share one of the first few of them, early enough to
leave room for the wanted overlap (Xiao et al. 2008, "PPJoin"). Rareness is a table of hashed counts of a fixed size; any one order
keeps the join exact. So no link between components is missed, and documents that share a template but no link cost no pairs.
A token that would join more than ``HOT_PAIRS`` pairs (many near copies of one text, some of them outside the main component) isn't
joined: the sets that share such tokens form groups, and what lies outside a group's main component is held in blocks by which the group's texts pass.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import dropped, written
from .common import components, prepare, shingles

SYMBOLS, CHUNKS, BITS = 65, 13, 16
MAX_DISTANCE = 2 * CHUNKS - 1
_WIDTH = SYMBOLS // CHUNKS
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint32)[:, None]
_MUL = (_RNG.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def signature(hashes: np.ndarray) -> bytes:
    """``SYMBOLS`` little-endian 16-bit symbols of a non-empty set of 64-bit hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    best = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, x.shape[1], 2048):
        y = (x[:, i : i + 2048] ^ _XOR) * _MUL
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(best, y.min(axis=1), out=best)
    return (best & np.uint32((1 << BITS) - 1)).astype("<u2").tobytes()


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("sig", pa.binary())])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document: set size, 128-bit fingerprint of the set, signature (null for an empty set)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, one, two, sig = [], [], [], []
            for x in part.column(1):
                h = shingles(x.as_buffer(), width) if x.is_valid else ()
                n.append(len(h))
                d = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else bytes(16)
                one.append(int.from_bytes(d[:8], "little", signed=True))
                two.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(signature(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())], schema=_SIGNED)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary")


def _keys(classes: DataFrame) -> DataFrame:
    """``SYMBOLS`` rows ``(key, rep)`` a class: each chunk with each of its symbols left out."""
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import mix64

        for part in parts:
            reps = part.column(0).to_numpy()
            s = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, CHUNKS, _WIDTH).astype(np.uint64)
            keys = np.empty((len(reps), CHUNKS, _WIDTH), np.uint64)
            for gap in range(_WIDTH):
                k = np.full(s.shape[:2], gap, np.uint64) + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(_WIDTH) + np.uint64(1)
                for j in range(_WIDTH):
                    if j != gap:
                        k = mix64(k ^ s[:, :, j]) + np.uint64(j)
                keys[:, :, gap] = k
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(reps, SYMBOLS))], schema=schema)

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _distances(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds h, the signature distance, and near: whether h and the set sizes allow the similarity."""
    own = classes.select("rep", "n_shingles", "sig")
    both = pairs.join(own.toDF("a", "na", "sa"), "a").join(own.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sa, sb = (np.frombuffer(b"".join(part.column(i).to_pylist()), "<u2").reshape(-1, SYMBOLS) for i in (4, 5))
            h = (sa != sb).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(h)], names=["a", "b", "na", "nb", "h"])

    return both.mapInArrow(run, "a long, b long, na long, nb long, h int")


#: Bits of the filter that keeps texts without a pair out of the shuffle; its table is at most FILTER_BITS / 64 rows.
FILTER_BITS = 1 << 23


def sifted(named: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``named`` whose hashed doc_id is set in a bit map of the ids, before any shuffle.

    The map is a broadcast table of at most FILTER_BITS / 64 words, whatever the data. It may let others
    pass (all, when there are many ids), never loses one; an exact join follows.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = ids.select(place.alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("__bits"))
    probed = named.withColumn("__p", place).withColumn("__w", F.expr("cast(__p div 64 as int)"))
    return probed.join(F.broadcast(bits), F.col("__w") == F.col("__word")).where("(shiftrightunsigned(__bits, cast(__p % 64 as int)) & 1L) = 1").select(*named.columns)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """The pairs ``(a, b)`` with 100 * intersection >= per_cent * union on the full shingle sets.

    Texts are sifted to those of documents in a pair, shuffled once by id (both joins use that exchange), and
    rows of one ``a`` come together, so that its set is made once. A hot ``a`` is split by adaptive execution.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    kept = sifted(named, ids)
    both = pairs.select("a", "b").join(kept.toDF("b", "tb"), "b").join(kept.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: OrderedDict[bytes, np.ndarray] = OrderedDict()
        for part in parts:
            yes = []
            for ta, tb in zip(part.column(2), part.column(3)):
                at = xxhash.xxh3_128_digest(ta.as_buffer())
                if at not in last:
                    last[at] = shingles(ta.as_buffer(), width)
                    if len(last) > 4:
                        last.popitem(last=False)
                x, y = last[at], shingles(tb.as_buffer(), width)
                common = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(bool(common) and 100 * common >= per_cent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


#: Classes of a bucket that are compared with each other; larger buckets go to the prefix join.
CROWD = 32
#: Counters that order shingles by rareness (4 bytes each to broadcast).
COUNTERS = 1 << 20


def rareness(texts: DataFrame, width: int) -> np.ndarray:
    """Counts of the shingles of all ``texts`` by the upper bits of their hash; COUNTERS numbers whatever the data."""
    shift = np.uint64(64 - (COUNTERS - 1).bit_length())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for part in parts:
            for x in part.column(0):
                np.add.at(n, (shingles(x.as_buffer(), width) >> shift).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["slot", "n"])

    got = texts.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.uint32)
    out[got.column("slot").to_numpy()] = np.minimum(got.column("n").to_numpy(), 0xFFFFFFFF)
    return out


def prefixes(texts: DataFrame, counts: np.ndarray, width: int, per_cent: int) -> DataFrame:
    """(token, rep, label, size, place, short) of the rare shingles by which sets of (rep, label, text) can meet; ``short``: as the smaller set."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    shift = np.uint64(64 - (COUNTERS - 1).bit_length())
    names = ["token", "rep", "label", "size", "place", "short"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rep, label, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                h = shingles(x.as_buffer(), width)
                n = len(h)
                if not n:
                    continue
                probe = n + (-per_cent * n) // 100 + 1
                own = n + (-2 * per_cent * n) // (100 + per_cent) + 1
                first = h[np.lexsort((h, shared.value[(h >> shift).astype(np.int64)]))[:probe]]
                k = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(np.full(k, rep)), pa.array(np.full(k, label)), pa.array(np.full(k, n)), pa.array(np.arange(k)), pa.array(np.arange(k) < own)], names=names)

    return texts.select("rep", "label", "text").mapInArrow(run, "token long, rep long, label long, size long, place long, short boolean")


#: Pairs of rows of different labels that a token may give to the join; costlier tokens' sets meet in blocks.
HOT_PAIRS = 1 << 16
#: Members of a group's main component that all others meet first, and how often, before they meet every member.
HEADS, ROUNDS = 64, 3
#: Shingles of the sets that a task holds, and bytes of the texts that pass them.
HELD, PASSING = 1 << 21, 8 << 20


def token_costs(rows: DataFrame) -> DataFrame:
    """(token, pairs) of the tokens with several labels: pairs of a row outside the token's main label with any row."""
    n = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.max("n").alias("top")).where("top < n")
    return n.select("token", F.expr("(n - top) * n").alias("pairs"))


def prefix_join(texts: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Pairs (a, b) of different labels among (rep, label, text) that may have the similarity: every such pair that has it, and few others."""
    return _prefix_pairs(written(prefixes(texts, rareness(texts, width), width, per_cent), "prefixes"), per_cent)


def _prefix_pairs(rows: DataFrame, per_cent: int) -> DataFrame:
    x = rows.where("short").select("token", *(F.col(c).alias("x_" + c) for c in ("rep", "label", "size", "place")))
    y = rows.select("token", *(F.col(c).alias("y_" + c) for c in ("rep", "label", "size", "place")))
    # the sets' order by size, the least size, and room for the overlap after the place where they meet
    fits = f"""x_label <> y_label and (x_size < y_size or (x_size = y_size and x_rep < y_rep)) and 100 * x_size >= {per_cent} * y_size
        and {100 + per_cent} * least(x_size - x_place, y_size - y_place) >= {per_cent} * (x_size + y_size)"""
    return x.join(y, "token").where(fits).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def _met(few: DataFrame, all_: DataFrame, texts: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Links (a, b, la, lb) on the full sets between (rep, group, label) ``few`` and ``all_``: for every a, one with each other label of a block.

    Blocks of HELD shingles of the one side meet blocks of PASSING bytes of the other, each pair of a group once; the overlaps
    of a set with all that are held are counted together.
    """
    own = few.join(texts.select("rep", "text"), "rep").withColumn("size", F.octet_length("text").cast("long"))
    other = all_.join(texts.select("rep", "text"), "rep").withColumn("size", F.octet_length("text").cast("long"))
    parts = lambda df, most, name: df.groupBy("group").agg(F.ceil(F.sum("size") / most).cast("int").alias(name))
    # a shingle takes two bytes of text at least
    cut = parts(own, 2 * HELD, "h").join(parts(other, PASSING, "k"), "group").select("group", F.greatest("h", F.lit(1)).alias("h"), F.greatest("k", F.lit(1)).alias("k"))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    left = own.join(cut, "group").withColumn("i", part("h")).withColumn("j", each("k")).select("group", "i", "j", "rep", "label", "text")
    right = other.join(cut, "group").withColumn("j", part("k")).withColumn("i", each("h")).select("group", "i", "j", "rep", "label", "text").toDF("group_", "i_", "j_", "rep", "label", "text")

    def run(held: pa.Table, passing: pa.Table) -> pa.Table:
        sets = [shingles(x.as_buffer(), width) for x in held.column("text")]
        out: list[tuple[int, int, int, int]] = []
        if sets and passing.num_rows:
            reps, labels = (held.column(c).to_numpy() for c in ("rep", "label"))
            sizes, tokens = np.array([len(x) for x in sets]), np.concatenate(sets)
            order = np.argsort(tokens)
            owner = np.repeat(np.arange(len(sets)), sizes)[order]
            known, first = np.unique(tokens[order], return_index=True)
            first = np.append(first, len(tokens))
            linked: set[tuple[int, int]] = set()
            for rep, label, x in zip(passing.column("rep").to_pylist(), passing.column("label").to_pylist(), passing.column("text")):
                h = shingles(x.as_buffer(), width)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                at = at[known[at] == h]
                n = first[at + 1] - first[at]
                common = np.bincount(owner[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
                for q in np.flatnonzero((common > 0) & (labels != label) & (100 * common >= per_cent * (sizes + len(h) - common))).tolist():
                    if (q, label) not in linked:
                        linked.add((q, label))
                        out.append((int(reps[q]), rep, int(labels[q]), label))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["a", "b", "la", "lb"])

    return left.groupBy("group", "i", "j").cogroup(right.groupBy("group_", "i_", "j_")).applyInArrow(run, "a long, b long, la long, lb long")


def block_links(rows: DataFrame, texts: DataFrame, width: int, per_cent: int) -> list[DataFrame]:
    """Links (a, b) that join all similar sets of different labels that share one of the tokens of ``rows``.

    Sets that share tokens, over any number of steps, are a group. Whatever lies outside a group's main component meets some
    of its members, then, if still outside, all of the group: so what the last, exact meeting costs is the sets without a link to most others.
    """
    heads = rows.groupBy("token").agg(F.min("rep").alias("head"))
    groups = components(rows.join(heads, "token").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct())
    now = written(groups.toDF("rep", "group").join(rows.select("rep", "label").distinct(), "rep"), "groups")
    found = []
    for i in range(ROUNDS + 1):
        sizes = now.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
        top = sizes.groupBy("group").agg(F.max(F.struct("n", "label")).alias("x")).select("group", F.col("x.label").alias("main"), F.col("x.n").alias("n"))
        placed = now.join(top, "group")
        few = placed.where("label <> main").select("rep", "group", "label")
        if few.isEmpty():
            break
        members = placed.where(F.pmod(F.xxhash64("rep", F.lit(i)), F.col("n")) < HEADS).where("label = main") if i < ROUNDS else placed
        links = written(_met(few, members.select("rep", "group", "label"), texts, width, per_cent), "links")
        found.append(links.select("a", "b"))
        roots = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        then = written(now.join(roots.toDF("label", "root"), "label", "left").select("rep", "group", F.coalesce("root", "label").alias("label")), "groups")
        dropped(now)
        now = then
    dropped(now)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets are similar: doc_id, n_shingles, component_id, kept.

    One row per input row. Null text, or text without words, is an empty set: linked with
    nothing, its component its own id, kept. Fewer words than ``width`` make one shingle.
    Rows with one doc_id are one node; a null doc_id links with nothing, its component is null
    and it is kept. Equal rows get equal results; other columns are ignored; no rows give none.
    """
    prepare(docs.sparkSession)
    rows = written(signatures(docs, width), "signatures")
    classes = written(rows.where("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")

    keys = _keys(classes)
    hot = keys.groupBy("key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keys.join(hot.hint("shuffle_hash"), "key").where("rep <> head"), "members")

    pairs = members.groupBy(F.col("head").alias("a"), F.col("rep").alias("b")).agg(F.max("n").alias("n"))
    stars = written(_distances(pairs, classes), "stars")
    possible = F.expr(f"h <= {MAX_DISTANCE} and 100 * least(na, nb) >= {per_cent} * greatest(na, nb)")
    linked = written(confirmed(stars.where(possible), docs, width, per_cent), "linked")

    # of each bucket that isn't one component yet, its classes with their components so far
    roots = written(components(linked), "roots")
    own = members.join(roots.toDF("rep", "root"), "rep", "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("label"))
    mixed = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_ = written(own.join(mixed.hint("shuffle_hash"), "key"), "open")
    few = open_.where(f"n <= {CROWD}")
    one, two = few.select("key", F.col("rep").alias("x"), F.col("label").alias("lx")), few.select("key", F.col("rep").alias("y"), F.col("label").alias("ly"))
    near = one.join(two, "key").where("x < y and lx <> ly").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    crowd = open_.where(f"n > {CROWD}").select("rep", "label").distinct()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts = written(sifted(named, crowd.select(F.col("rep").alias("doc_id"))).join(crowd.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("rep"), "label", "text"), "crowd")
    prefix = written(prefixes(texts, rareness(texts, width), width, per_cent), "prefixes")
    costs = written(token_costs(prefix), "costs")
    cold, hot = (prefix.join(costs.where(f"pairs {sign} {HOT_PAIRS}").select("token"), "token") for sign in ("<=", ">"))
    cross = near.unionByName(_prefix_pairs(cold, per_cent)).distinct()
    second = written(_distances(cross, classes).where(possible), "cross")
    more = written(confirmed(second, docs, width, per_cent), "more")
    for links in block_links(written(hot, "hot"), texts, width, per_cent):
        more = more.unionByName(links)

    named = rows.join(classes.select("fp1", "fp2", "n_shingles", "rep"), ["fp1", "fp2", "n_shingles"], "left").select("doc_id", "n_shingles", "rep")
    several = named.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    same = named.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    # the components so far are the nodes of what was found since
    late = more.unionByName(same)
    for c in ("a", "b"):
        late = late.join(roots.toDF(c, "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    top = components(late.select("a", "b"))
    for x in (members, stars, open_, texts, prefix, second):
        dropped(x)
    found = named.join(roots.toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep")).join(top.toDF("label", "root"), "label", "left")
    component = F.coalesce("root", "label", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
