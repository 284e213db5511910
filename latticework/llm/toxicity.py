"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer, a trie that reads a word letter by letter, maps words to classes with weights: I (insult), T and S (threats,
weak and strong), U (target), N (negation), R (reported speech), O (other). It is followed by the composition
of five transducers that rewrite a clause's classes: an insult soon after another counts more, so does one near a
target; a threat becomes a completed one (H) when a target stands near it, before or after; negation and reported
speech weaken what follows. The composed machine reads a clause once; the weights of its I and H
add up to the clause's value, and a logistic regression maps a document's clause values to a score.

Insults and threats are learned from labelled documents: words and word starts of 4 to 6 letters that toxic documents
have more often than clean ones, threats those that show it only in clauses with a target, by a
log-likelihood ratio test and least odds. Learning takes a bounded sample, about ``MAX_PER_LABEL`` documents of each label
chosen by a hash of the id. Entries that pass both tests in two toxic documents or more are ordered by weight, and at most ``LEXICON``
are kept. While fitting the regression, a document's own vote is left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import prepare

MAX_PER_LABEL, LEXICON, STEMS, LEAST_RATIO, LEAST_ODDS, CAP = 20_000, 4000, (4, 5, 6), 14.0, 4.3, 6.0
_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 200_000
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n…]+")

CLASSES: dict[str, frozenset[str]] = {
    "T": frozenset("kill hurt destroy punch beat shoot stab burn töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()),
    "U": frozenset("you your yours yourself ye thou du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tú tus vosotros".split()),
    "N": frozenset("not never nobody isn aren wasn weren don doesn didn nicht kein keine niemals ne jamais aucun nunca jamás ningún".split()),
    "R": frozenset("said says say called calls wrote writes quoted quote reported sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split()),
}
SEED_INSULTS = {w: 2.0 for w in "idiot moron stupid scum worthless pathetic".split()}


class Transducer:
    """Deterministic weighted transducer: ``step(state, symbol) -> (state, symbol, factor)``.

    Arcs that aren't given go to ``rest(state)`` and copy the symbol.
    """

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]], states: int, symbols: str, rest):
        self.table = {(q, a): arcs.get((q, a), (rest(q), a, 1.0)) for q in range(states) for a in symbols}
        self.states, self.symbols = states, symbols

    def compose(self, other: Transducer) -> Transducer:
        """First self, then ``other`` on its output; states that can be reached are numbered as they are met."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            q, r = todo.pop()
            for a in self.symbols:
                q2, b, w = self.table[(q, a)]
                r2, c, v = other.table[(r, b)]
                if (q2, r2) not in number:
                    number[q2, r2] = len(number)
                    todo.append((q2, r2))
                arcs[(number[q, r], a)] = (number[q2, r2], c, w * v)
        return Transducer(arcs, len(number), self.symbols, lambda q: 0)


_SYMBOLS = "ITSUNROH"
#: Weights of a weak and a strong threat, completed by a target.
WEAK, STRONG = 2.0, 4.0


def _window(opener: str, hits: str, factor: float, reach: int) -> Transducer:
    """For ``reach`` symbols after an opener, the weights of ``hits`` are multiplied by ``factor``."""
    arcs: dict[tuple[int, str], tuple[int, str, float]] = {}
    for q in range(reach + 1):
        arcs[(q, opener)] = (reach, opener, 1.0)
        for h in hits:
            if q:
                arcs[(q, h)] = (reach if h == opener else q - 1, h, factor)
    return Transducer(arcs, reach + 1, _SYMBOLS, lambda q: max(0, q - 1))


def _threat(reach: int) -> Transducer:
    """A threat within ``reach`` symbols of a target, in either order, becomes a completed one.

    States: 0; 1.. a weak threat waits for a target; then a strong one; then a target waits for a threat. A target's own
    weight is 1, so that completing a threat before it gives that threat's weight.
    """
    weak, strong, target = (lambda k: k), (lambda k: reach + k), (lambda k: 2 * reach + k)
    arcs: dict[tuple[int, str], tuple[int, str, float]] = {}
    for q in range(3 * reach + 1):
        kind, left = ("", 0) if not q else (("weak", "strong", "target")[(q - 1) // reach], (q - 1) % reach + 1)
        arcs[(q, "T")] = (target(left), "H", 1.0) if kind == "target" else (strong(left) if kind == "strong" else weak(reach), "T", 1.0)
        arcs[(q, "S")] = (target(left), "H", 1.0) if kind == "target" else (strong(reach), "S", 1.0)
        arcs[(q, "U")] = (target(reach), "H", STRONG if kind == "strong" else WEAK) if kind in ("weak", "strong") else (target(reach), "U", 1.0)
    return Transducer(arcs, 3 * reach + 1, _SYMBOLS, lambda q: 0 if q in (0, 1, reach + 1, 2 * reach + 1) else q - 1)


#: In order: insult after insult, insult near a target, threat with target, negation, reported speech.
PARTS = [("insult", _window("I", "I", 1.2, 3)), ("target", _window("U", "I", 1.3, 4)), ("threat", _threat(5)), ("negation", _window("N", "IH", 0.5, 3)), ("report", _window("R", "IH", 0.6, 5))]


@cache
def grammar() -> Transducer:
    """The composition of the five parts."""
    whole = PARTS[0][1]
    for _, part in PARTS[1:]:
        whole = whole.compose(part)
    return whole


def clause_value(symbols: list[tuple[str, float]], machine: Transducer | None = None) -> float:
    """Sum of the weights that the composed grammar gives to a clause's insults and completed threats."""
    table = (machine or grammar()).table
    q, total = 0, 0.0
    for s, w in symbols:
        q, out, factor = table[(q, s)]
        if out == "I" or out == "H":
            total += w * factor
    return total


class Trie:
    """The lexicon transducer: reads a word's letters; a word's own entry comes before that of its shortest known start."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, entry: tuple) -> None:
        """``word`` ends in ``*`` for all words that go on from there."""
        node, end = self.root, "*" if word.endswith("*") else ""
        for c in word[:-1] if end else word:
            node = node.setdefault(c, {})
        node[end or "."] = entry

    def read(self, word: str) -> tuple | None:
        node, start = self.root, None
        for i, c in enumerate(word):
            if start is None and i and "*" in node:
                start = node["*"]
            node = node.get(c)
            if node is None:
                return start
        return node.get(".", start)


def ratio(pos: float, neg: float, p: float, n: float) -> float:
    """Log-likelihood ratio of a feature in pos of p and neg of n documents; 0 if it isn't more frequent in the first."""
    if pos <= 0 or p <= 0 or pos / p <= neg / max(n, 1):
        return 0.0
    q = (pos + neg) / (p + n)

    def ll(k: float, m: float, r: float) -> float:
        return (k * math.log(r) if k else 0.0) + ((m - k) * math.log(1 - r) if m > k else 0.0)

    r1, r2 = min(pos / p, 1 - 1e-9), (min(max(neg / n, 1e-12), 1 - 1e-9) if n else q)
    return 2 * (ll(pos, p, r1) + ll(neg, n, r2) - ll(pos, p, q) - ll(neg, n, q))


def weight(pos: float, neg: float, p: float, n: float) -> float:
    """Log odds ratio, at most CAP; 0 where the test isn't passed or it is below LEAST_ODDS.

    A word that toxic documents merely have more often, as the longer ones, isn't an insult.
    """
    if ratio(pos, neg, p, n) < LEAST_RATIO:
        return 0.0
    w = min(CAP, math.log((pos + 0.5) / (p - pos + 0.5)) - math.log((neg + 0.5) / (n - neg + 0.5)))
    return w if w >= LEAST_ODDS else 0.0


def weight_column(pos: Column, neg: Column, p: float, n: float) -> Column:
    """``weight`` as an expression, for p toxic and n clean documents."""

    def ll(k: Column, m: float, r: Column) -> Column:
        return F.when(k > 0, k * F.log(r)).otherwise(0.0) + F.when(k < m, (m - k) * F.log(1 - r)).otherwise(0.0)

    least, most = F.lit(1e-12), F.lit(1 - 1e-9)
    q = (pos + neg) / (p + n)
    r1, r2 = F.least(pos / p, most), (F.least(F.greatest(neg / n, least), most) if n else q)
    test = 2 * (ll(pos, p, r1) + ll(neg, n, r2) - ll(pos, p, q) - ll(neg, n, q))
    odds = F.log((pos + 0.5) / (p - pos + 0.5)) - F.log((neg + 0.5) / (n - neg + 0.5))
    return F.when((pos > 0) & (pos / p > neg / max(n, 1)) & (test >= LEAST_RATIO) & (odds >= LEAST_ODDS), F.least(odds, F.lit(CAP))).otherwise(0.0)


def clauses(text: str) -> Iterator[list[str]]:
    """The words of each clause of a lower-case text."""
    own: list[str] = []
    for t in _TOKEN.findall(text):
        if t[0].isalpha():
            own.append(t)
        elif own:
            yield own
            own = []
    if own:
        yield own


def seen_in(text: str) -> set[str]:
    """What a document votes for: its words and their starts, and with ``!`` those that share a clause with a target."""
    words, near = set(), set()
    for own in clauses(text.lower()):
        words.update(own)
        if not CLASSES["U"].isdisjoint(own):
            near.update(own)
    starts = lambda ws: ws | {w[:k] + "*" for w in ws for k in STEMS if len(w) > k}
    return starts(words) | {"!" + x for x in starts(near)} | {""}


class Scorer:
    def __init__(self, model: dict):
        self.m = model
        self.trie = Trie()
        for c in "TUNR":
            for w in CLASSES[c]:
                self.trie.add(w, (c, None))
        for w, v in model["seeds"].items():
            self.trie.add(w, ("I", None, v))
        # learned entries come over the built-in ones
        for x, votes in model["lexicon"].items():
            if x[0] == "!":
                self.trie.add(x[1:], ("T", votes))
        for x, votes in model["lexicon"].items():
            if x[0] != "!":
                self.trie.add(x, ("I", votes))
        #: word -> class and weight, for texts without a label; cleared when full
        self.memo: dict[str, tuple[str, float]] = {}

    def classed(self, w: str, label: int | None) -> tuple[str, float]:
        """Class and weight of a word; a training document's label leaves its vote out."""
        e = self.trie.read(w)
        if e is None:
            return "O", 0.0
        if e[1] is None:
            return e[0], e[2] if e[0] == "I" else WEAK if e[0] == "T" else 1.0
        # a threat away from any target has no vote to leave out, nor a value
        v = weight(max(0.0, e[1][0] - (label == 1)), max(0.0, e[1][1] - (label == 0)), self.m["p"] - (label == 1), self.m["n"] - (label == 0))
        if v <= 0:
            return "O", 0.0
        return ("I", v) if e[0] == "I" else ("S", STRONG) if v >= (LEAST_ODDS + CAP) / 2 else ("T", WEAK)

    def features(self, text: str | None, label: int | None = None) -> tuple[float, float]:
        """(sum of clause values, clauses with a value)."""
        if not text:
            return 0.0, 0.0
        low, memo = text.lower(), self.memo if label is None else {}
        if len(memo) > _MEMO:
            memo.clear()
        bad = False
        for w in set(_WORD.findall(low)):
            v = memo.get(w)
            if v is None:
                v = memo[w] = self.classed(w, label)
            bad = bad or v[0] in "ITS"
        if not bad:
            return 0.0, 0.0
        total, n = 0.0, 0
        for own in clauses(low):
            v = clause_value([memo[w] for w in own])
            total += v
            n += v > 0
        return total, float(n)

    def score(self, text: str | None) -> float:
        s, n = self.features(text)
        a, b, c = self.m["coef"]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(s) + c * math.log1p(n)))))


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by damped Newton steps; slopes below 0 are set to 0."""
    x = np.column_stack([np.ones(len(x)), np.log1p(x)])
    w = np.array([-2.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        r = np.array([0.0, ridge, ridge])
        g = x.T @ (p - y) + r * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(r) + 1e-6 * np.eye(3)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0.0)
    return [float(v) for v in w]


#: Without labels of both kinds: a seeded insult makes a document toxic.
DEFAULT = {"lexicon": {}, "seeds": SEED_INSULTS, "p": 0, "n": 0, "coef": [-1.0, 2.0, 0.0]}


def learned(docs: DataFrame, labels: DataFrame, may_learn: Column) -> dict:
    """The model from the labelled documents of which ``may_learn`` (a condition on doc_id) holds.

    A document with several labels counts as toxic if one says so; null texts, ids and labels teach nothing; rows that repeat an
    id count each; a text is read whole. Without documents of both labels the seeded model is returned.
    """
    prepare(docs.sparkSession)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(may_learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return DEFAULT
    share = F.when(F.col("toxic") == 1, min(1.0, MAX_PER_LABEL / sizes[1])).otherwise(min(1.0, MAX_PER_LABEL / sizes[0]))
    sample = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20) < share)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = named.join(F.broadcast(sample), "doc_id").select("toxic", "text")  # about 2 * MAX_PER_LABEL ids

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Counter(), Counter()]
        for part in parts:
            for y, x in zip(part.column(0).to_pylist(), part.column(1)):
                found[y].update(seen_in(x.as_py()))
        for y in (0, 1):
            items = list(found[y].items())
            for i in range(0, len(items), 8192):
                k, v = zip(*items[i : i + 8192])
                zero = [0] * len(k)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(v if y else zero, pa.int64()), pa.array(zero if y else v, pa.int64())], names=["feature", "pos", "neg"])

    votes = written(rows.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 2 or feature = ''"), "votes")
    whole = votes.where("feature = ''").first()
    if whole is None or not whole["pos"] or not whole["neg"]:
        return DEFAULT
    p, n = whole["pos"], whole["neg"]
    # entries that count only without one clean document's vote weigh 0 in scoring, but show the fit what such hits are worth
    value = weight_column(F.col("pos"), F.greatest(F.col("neg") - 1, F.lit(0)), float(p), float(n - 1))
    passed = votes.where("feature <> ''").withColumn("value", value).where("value > 0")
    # a threat is what shows nothing without a target in its clause
    plain = passed.where("not startswith(feature, '!')")
    threats = passed.where("startswith(feature, '!')").join(plain.select(F.concat(F.lit("!"), "feature").alias("feature")), "feature", "left_anti")
    kept = plain.unionByName(threats).orderBy((F.col("value") * F.col("pos")).desc(), "feature").limit(LEXICON).collect()
    lexicon = {r["feature"]: (float(r["pos"]), float(r["neg"])) for r in kept}
    model = {"lexicon": lexicon, "seeds": {}, "p": float(p), "n": float(n), "coef": [-1.0, 2.0, 0.0]}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def feature(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in parts:
            ys = part.column(0).to_pylist()
            f = [scorer.features(x.as_py(), y) for y, x in zip(ys, part.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array([a for a, _ in f], pa.float64()), pa.array([b for _, b in f], pa.float64())], names=["y", "s", "n"])

    got = rows.mapInArrow(feature, "y int, s double, n double").groupBy("y", "s", "n").agg(F.count(F.lit(1)).alias("k")).orderBy("y", "s", "n").toArrow()
    y, s, c, k = (got.column(i).to_numpy() for i in ("y", "s", "n", "k"))  # at most the sample's size
    return model | {"coef": _regression(np.repeat(np.column_stack([s, c]), k, axis=0), np.repeat(y, k))}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of ``docs`` and score, predicted (replacing columns so named); 1 is toxic, from 0.5.

    Null and empty texts get the score of a text without a match. Equal texts get equal scores; texts are read whole,
    however long. One row per input row, no rows give none. A score of just 0.5 is predicted toxic.
    """
    from pyspark.sql import types as T

    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # at most LEXICON entries
    kept = docs.drop("score", "predicted")
    at = kept.columns.index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in parts:
            s = [scorer.score(x.as_py()) for x in part.column(at)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=[*part.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)
