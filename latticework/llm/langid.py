"""Language identification, word first with back-off to character n-grams.

A known word is worth its log frequency in each language. An unseen word is worth the mean
log frequency of its known n-grams, of the longest order (4 down to 1, with word edges) of
which any is known. A document goes to the language of the largest sum over its words.

Learning takes a bounded sample: about ``DOCS_PER_LANGUAGE`` documents of each language,
chosen by a hash of their ids. Every language keeps its own most frequent words and n-grams, as many
as ``quota`` says, so a large one doesn't crowd out a small one. Any number of languages is learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written
from .common import prepare

DOCS_PER_LANGUAGE, WORDS, GRAMS = 4000, 60_000, 60_000
#: Words (and n-grams) that a language keeps at least, however many languages there are.
LEAST_KEPT = 2000
#: Words of evidence that the score takes into account at most.
EVIDENCE = 30
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose values are kept by a scorer at most, and numbers that they may take.
_CACHE, _CELLS = 200_000, 4_000_000


def quota(total: int, languages: int) -> int:
    """Words or n-grams that each language keeps, of ``total`` for all of them."""
    return max(LEAST_KEPT, total // max(1, languages))


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


def learned(docs: DataFrame, may_learn: Column) -> dict:
    """The model: languages, and by kind (0 words, 1 to 4 n-grams) the log frequency of what isn't known and the tokens' gains over it.

    Null texts and languages teach nothing; rows that repeat count as often; a text is counted whole. No rows give a model
    without languages. The model's size is bounded by the quotas of the languages that ``docs`` names.
    """
    prepare(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = written(named.groupBy(F.col("lang").alias("__lang")).agg((F.lit(float(DOCS_PER_LANGUAGE)) / F.count(F.lit(1))).alias("__share")), "languages")
    langs = sorted(r[0] for r in sizes.select("__lang").collect())  # a row a language, as the model has
    if not langs:
        return {"langs": [], "base": {}, "tokens": {}}
    sample = named.join(sizes, F.col("lang") == F.col("__lang")).where(F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(1 << 20)) / float(1 << 20) < F.col("__share")).select("lang", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for part in parts:
            for s, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found.setdefault(s, Counter()).update(_WORD.findall(x.lower()))
        for s, c in found.items():
            g: Counter = Counter()
            for w, k in c.items():
                for n in (1, 2, 3, 4):
                    for x in grams(w, n):
                        g[(n, x)] += k
            rows = [(s, 0, w, k) for w, k in c.items()] + [(s, n, x, k) for (n, x), k in g.items()]
            for i in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[i : i + 8192])], names=["lang", "kind", "token", "n"])

    counts = written(sample.mapInArrow(run, "lang string, kind long, token string, n long").groupBy("lang", "kind", "token").agg(F.sum("n").alias("n")), "counts")
    # of each language the most frequent, cut in every task before the shuffle
    by = Window.partitionBy("lang", F.col("kind") > 0).orderBy(F.desc("n"), "kind", "token")
    most = F.when(F.col("kind") > 0, quota(GRAMS, len(langs))).otherwise(quota(WORDS, len(langs)))
    ranked = counts.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= max(quota(GRAMS, len(langs)), quota(WORDS, len(langs)))).where(F.col("__r") <= most)
    kept = ranked.select(F.col("kind").alias("__kind"), F.col("token").alias("__token")).distinct()
    # a token that one language keeps is counted in all
    rows = counts.join(kept, (F.col("kind") == F.col("__kind")) & (F.col("token") == F.col("__token"))).select("lang", "kind", "token", "n").toArrow()
    at = {s: i for i, s in enumerate(langs)}
    found: dict[int, dict[str, list[tuple[int, int]]]] = {k: {} for k in range(5)}
    for s, kind, token, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "kind", "token", "n"))):
        found[kind].setdefault(token, []).append((at[s], n))
    base, tokens = {}, {}
    for kind, own in found.items():
        total = np.zeros(len(langs))
        for e in own.values():
            for i, n in e:
                total[i] += n
        base[kind] = tuple(np.log(0.5 / (total + 0.5 * max(1, len(own)))).tolist())
        tokens[kind] = {t: tuple((i, math.log((n + 0.5) / 0.5)) for i, n in sorted(e)) for t, e in own.items()}
    return {"langs": langs, "base": base, "tokens": tokens}


class Scorer:
    def __init__(self, model: dict):
        self.model, self.langs = model, model["langs"]
        self.room = max(2, min(_CACHE, _CELLS // max(1, len(self.langs))))
        self.rows = np.zeros((self.room, max(1, len(self.langs))), np.float32)
        self.at: dict[str, int] = {}
        self.base = model["base"]
        self.words = model["tokens"].get(0, {}).get
        self.orders = [(n, model["tokens"].get(n, {}).get) for n in (4, 3, 2, 1)]
        self.none = [0.0] * len(self.langs)

    def _row(self, kind: int, found: list[tuple[tuple[int, float], ...]]) -> list[float]:
        """Mean log frequency by language of tokens of one kind."""
        out, k = list(self.base[kind]), len(found)
        for e in found:
            for i, v in e:
                out[i] += v / k
        return out

    def value(self, word: str) -> list[float]:
        """Log frequency of a word by language."""
        e = self.words(word)
        if e is not None:
            return self._row(0, [e])
        w = f"<{word}>"
        for n, get in self.orders:
            m = len(w) - n + 1
            known = [x for x in map(get, [w[i : i + n] for i in range(m)] if n > 1 else word) if x is not None]
            if known:
                return self._row(n, known)
        return self.none

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = Counter(_WORD.findall(text.lower())) if text else None
        if not counts or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        total, seen = np.zeros(len(self.langs)), sum(counts.values())
        items = list(counts.items())
        for i in range(0, len(items), self.room // 2):
            rows, part = [], items[i : i + self.room // 2]
            if len(self.at) + len(part) > self.room:
                self.at.clear()
            for w, _ in part:
                r = self.at.get(w)
                if r is None:
                    r = self.at[w] = len(self.at)
                    self.rows[r] = self.value(w)
                rows.append(r)
            total += np.array([n for _, n in part], np.float64) @ self.rows[rows]
        mean = total / seen
        best = int(np.argmax(mean))
        p = np.exp((mean - mean[best]) * min(seen, EVIDENCE))
        return self.langs[best], float(1.0 / p.sum())


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score (replacing columns so named).

    ``und`` with score 0 where the text is null or has no letter (or no language was
    learned); ties go to the smaller name. Equal texts get equal predictions, texts are read whole, however
    long. One row per input row, no rows give none.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # bounded by the languages' quotas
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index("text")
    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in parts:
            found = [scorer(x.as_py()) for x in part.column(at)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
