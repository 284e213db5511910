"""Mixing sources to target weights by the cube method (Deville and Tille 2004).

A source with target t and size s is to be taken r = t / s times. Each of its documents is
taken floor(r) times, and once more with chance p = r - floor(r). Those chances form a point
in a cube. The flight phase moves the point to a vertex along directions that keep both
balancing totals of the source, sizes and documents, so the sample has (nearly)
exactly the wanted words and documents. With three documents in hand and two constraints
such a direction always exists, u = (z3 - z2, z1 - z3, z2 - z1) for sizes z, and each
step decides at least one of them: a stream with a state of three documents a source.
Long documents come first, so that what stays undecided is short.

Blocks of documents fly by themselves, each leaving at most two undecided; those fly
together in the next level, a level of fewer blocks each time. The last level, of one block's
size in all, keeps a reserve of each source back; the landing decides these few documents together.
Blocks come from hashes of the rows and steps from seeded hashes, so reruns agree however
the rows are partitioned, and no task holds a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from ..plans.numbering import numbered
from .common import WORD, prepare

#: Documents a block flies together on average.
BLOCK = 20_000
_M64 = (1 << 64) - 1


def weights_by_order(sources: list[str | None], cycle: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights repeating ``cycle`` over the sources by code point, null last."""
    ordered = sorted((x for x in sources if x is not None), key=lambda x: x.encode("utf-8"))
    return {x: float(cycle[i % len(cycle)]) for i, x in enumerate([*ordered, *([None] if None in sources else [])])}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], ceiling: float = 3.0) -> dict[str | None, float]:
    """Shares of all sizes by weight; none above ``ceiling`` times its size, the excess reshared."""
    total, free, out = float(sum(sizes.values())), dict(weights), {}
    while free:
        sum_w = sum(free.values())
        rest = total - sum(out.values())
        over = [s for s, w in free.items() if rest * w / sum_w > ceiling * sizes[s]]
        if not over:
            out.update({s: rest * w / sum_w for s, w in free.items()})
            break
        for s in over:
            out[s] = ceiling * sizes[s]
            del free[s]
    return out


def _uniform(state: int) -> tuple[int, float]:
    """A step of splitmix64 and a number in [0, 1)."""
    state = (state + 0x9E3779B97F4A7C15) & _M64
    z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
    return state, ((z ^ (z >> 31)) >> 11) / (1 << 53)


class Flight:
    """The flight phase over a stream of one block and source; ``add`` and ``end`` yield (row, chance)."""

    def __init__(self, seed: int):
        self.state, self.hand = seed & _M64, []

    def _step(self) -> Iterator[tuple[int, float]]:
        h = self.hand
        if len(h) == 3:
            z = [x[1] for x in h]
            u = [z[2] - z[1], z[0] - z[2], z[1] - z[0]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        else:  # two of one size
            u = [1.0, -1.0]
        up = min((1 - x[2]) / c if c > 0 else -x[2] / c for x, c in zip(h, u) if c)
        down = min(x[2] / c if c > 0 else (x[2] - 1) / c for x, c in zip(h, u) if c)
        self.state, r = _uniform(self.state)
        by = up if r * (up + down) < down else -down
        kept = []
        for x, c in zip(h, u):
            p = x[2] + by * c
            if p < 1e-9 or p > 1 - 1e-9:
                yield x[0], float(p > 0.5)
            else:
                kept.append((x[0], x[1], p))
        self.hand = kept

    def add(self, row: int, size: float, chance: float) -> Iterator[tuple[int, float]]:
        if chance <= 0 or chance >= 1:
            yield row, chance
            return
        self.hand.append((row, size, chance))
        if len(self.hand) == 3:
            yield from self._step()

    def end(self) -> Iterator[tuple[int, float]]:
        if len(self.hand) == 2 and self.hand[0][1] == self.hand[1][1]:
            yield from self._step()
        yield from ((row, p) for row, _, p in self.hand)
        self.hand = []


#: Documents of a source that are kept back for the landing.
RESERVE = 32


def landed(sizes: np.ndarray, chances: np.ndarray, seed: int) -> np.ndarray:
    """0 or 1 for each document of a source's last group, in order of falling size.

    All but a reserve spread over the sizes fly. The reserve and what the flight leaves make the landing
    problem: from seeded draws by their chances, single changes and exchanges are made as long as
    they bring the totals of words, then documents, nearer; the best of several draws is taken.
    """
    out = chances.copy()
    open_ = np.flatnonzero((chances > 0) & (chances < 1))
    kept = set(open_[np.unique(np.linspace(0, len(open_) - 1, min(RESERVE, len(open_))).astype(int))].tolist()) if len(open_) else set()
    flight = Flight(seed)
    for i in open_:
        if i not in kept:
            for k, p in flight.add(int(i), float(sizes[i]), float(chances[i])):
                out[k] = p
    for k, p in flight.end():
        out[k] = p
    at = np.flatnonzero((out > 0) & (out < 1))
    if not len(at):
        return out
    z, p = sizes[at].astype(np.float64), out[at]
    words, docs, light = float(z @ p), float(p.sum()), 1e-3 * max(1.0, float(np.median(z)))
    state, best = flight.state, None

    def cost(w: np.ndarray, d: np.ndarray) -> np.ndarray:
        return abs(w - words) + light * abs(d - docs)

    for _ in range(16):
        draw = np.empty(len(at))
        for j in range(len(at)):
            state, draw[j] = _uniform(state)
        x = (draw < p).astype(np.float64)
        now = float(cost(z @ x, x.sum()))
        for _ in range(200):
            flip = 1 - 2 * x
            dz = z * flip
            one = cost(z @ x + dz, x.sum() + flip)
            two = cost(z @ x + dz[:, None] + dz[None, :], x.sum() + flip[:, None] + flip[None, :])
            np.fill_diagonal(two, one)
            i, j = np.unravel_index(int(np.argmin(two)), two.shape)
            if two[i, j] >= now - 1e-9:
                break
            now = float(two[i, j])
            for k in {int(i), int(j)}:
                x[k] = 1 - x[k]
        if best is None or now < best[0]:
            best = (now, x)
    out[at] = best[1]
    return out


def _land(rows: DataFrame, seed: int) -> DataFrame:
    """The last level, of about BLOCK rows in all: a group for each source."""
    names = rows.columns

    def run(pdf):
        pdf = pdf.sort_values(["size", "h", "h2"], ascending=[False, True, True], kind="stable")
        pdf["chance"] = landed(pdf["size"].to_numpy(), pdf["chance"].to_numpy(), seed * 0x9E3779B9 + int(pdf["source_no"].iloc[0]) + 1)
        return pdf[names]

    return rows.groupBy("source_no").applyInPandas(run, rows.schema)


def _fly(rows: DataFrame, blocks: int, seed: int) -> DataFrame:
    """One level over rows (h, source_no, size, chance, ...): same rows with new chances."""
    block = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(blocks)).cast("int")
    ready = rows.withColumn("block", block).repartition("block", "source_no").sortWithinPartitions("block", "source_no", F.desc("size"), "h", "h2")
    order = ready.columns
    i_block, i_source, i_size, i_chance = (order.index(x) for x in ("block", "source_no", "size", "chance"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flight, waiting = None, None, []

        def out(part: pa.RecordBatch, chance: np.ndarray) -> pa.RecordBatch:
            return part.set_column(i_chance, "chance", pa.array(chance))

        # a row in hand may be of an earlier batch: it waits there as a row of its own
        for part in parts:
            chance = part.column(i_chance).to_numpy().copy()
            block, source, size = (part.column(i).to_numpy() for i in (i_block, i_source, i_size))
            done = np.zeros(len(chance), bool)
            for i in range(len(chance)):
                at = (block[i], source[i])
                if at != now:
                    if flight is not None:
                        for (w, j), p in [*flight.end()]:
                            if w is None:
                                chance[j], done[j] = p, True
                            else:
                                yield out(w, np.array([p]))
                    now, flight = at, Flight(seed * 0x9E3779B9 + int(block[i]) * 0x85EBCA6B + int(source[i]) + 1)
                for (w, j), p in flight.add((None, i), float(size[i]), float(chance[i])):
                    if w is None:
                        chance[j], done[j] = p, True
                    else:
                        yield out(w, np.array([p]))
            if flight is not None:
                flight.hand = [((part.slice(x[0][1], 1) if x[0][0] is None else x[0][0], 0), x[1], x[2]) for x in flight.hand]
            yield out(part, chance).filter(pa.array(done))
        if flight is not None:
            for (w, _), p in [*flight.end()]:
                yield out(w, np.array([p]))

    return ready.mapInArrow(run, ready.schema).drop("block")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with h and h2 (replacing columns so named): 128 bits of hash of (doc_id as long, source, text), nulls told apart from values."""
    own = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")]
    marked = [x for c in own for x in (c, c.isNull())]
    return docs.withColumns({"h": F.xxhash64(*marked), "h2": F.xxhash64(F.lit("mix"), *reversed(marked))})


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h, h2): words of the text (null: 0) and the row's hash."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return keyed(docs.select("doc_id", "source", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), "h", "h2")


def targeted(rows: DataFrame, weights: dict[str | None, float] | None, ceiling: float) -> DataFrame:
    """(source, source_no, source_size, n, target) of rows (source, size), as ``targets`` and ``weights_by_order`` say.

    Sources stay a table however many there are. The level L, with targets min(L * weight, ceiling * size),
    only rises from round to round, so a round is one aggregate over that table and the driver holds L alone.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    own = numbered(totals, [F.col("source").asc_nulls_last()], "source_no")
    if weights is None:
        weight = F.pmod("source_no", F.lit(3)) + 1.0
    else:
        named = {k: float(v) for k, v in weights.items() if k is not None}
        found = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.col("source")] if named else F.lit(None).cast("double")
        found = F.coalesce(found, F.when(F.col("source").isNull(), F.lit(weights.get(None)).cast("double")))
        weight = F.coalesce(found, F.raise_error(F.concat(F.lit("mixing: no weight for source "), F.coalesce("source", F.lit("null")))).cast("double"))
    own = written(own.withColumn("weight", weight.cast("double")), "sources")
    most = F.col("source_size") * F.lit(float(ceiling))
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > most
        w, held, size, n = own.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, most)), F.sum("source_size"), F.count_if(over)).first()
        if n == capped or not w:
            break
        capped, level = n, (float(size) - (held or 0.0)) / w
    return own.select("source", "source_no", "source_size", "n", F.least(F.col("weight") * level, most).alias("target"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, ceiling: float = 3.0, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken, h, h2.

    One row per input row. Null text has size 0. A null source is a source of its own. Sources
    without words have target 0 and nothing is taken of them. Equal rows are separate
    documents; a null doc_id is as any other. No rows give none. Without ``weights`` the
    sources weigh 1, 2, 3, repeating, by code point, null last; a source that given weights lack is an error.
    """
    prepare(docs.sparkSession)
    rows = written(sized(docs), "sizes")
    table = written(targeted(rows, weights, ceiling), "targets")
    n, sources = table.agg(F.sum("n"), F.count(F.lit(1))).first()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12).cast("long")
    table = table.select(F.col("source").alias("__s"), F.col("source_no").cast("int").alias("source_no"), "source_size", "target", whole.alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("chance"))
    # the table is read from files, so its size is known: Spark broadcasts it only while that is small
    flying = rows.join(table, rows["source"].eqNullSafe(table["__s"])).drop("__s")
    blocks = max(1, -(-(n or 0) // block))
    level, decided = 0, None
    while True:
        flying = written(_fly(flying, blocks, seed + level) if blocks > 1 else _land(flying, seed), "flight")
        part = flying.where("chance in (0d, 1d)")
        decided = part if decided is None else decided.unionByName(part)
        if blocks == 1:
            break
        flying = flying.where("chance > 0d and chance < 1d")
        # at most two are left of each source in a block; a level has at most a fourth of the blocks
        blocks, level = max(1, min(blocks // 4, -(-2 * blocks * sources // block))), level + 1
    copies = F.col("whole") + F.col("chance").cast("long")
    return decided.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "h", "h2")
