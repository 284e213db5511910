"""A corpus pipeline of five operators; part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import bpe, langid, minhash, mixing, toxicity
from latticework.llm.common import prepare
from latticework.llm.queries import language_model, toxic_model
from latticework.plans.lineage import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter (``und``) go. The language found replaces a null one.

    Null, empty and letterless texts go; ids and ties don't matter: equal texts share one fate. Repeated rows
    stay repeated. Very long texts are read whole. Other columns than those of documents are left out. No rows give none.
    """
    prepare(spark)
    found = langid.predicted(docs.select(*COLUMNS), language_model(docs)).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by a model from the labelled documents of ``sf_dir``.

    Null and empty texts have no insult and stay. Equal texts share one fate, repeated rows stay repeated, very long texts
    are read whole. Other columns than those of documents are left out. No rows give none.
    """
    prepare(spark)
    model = toxic_model(spark, sf_dir)
    return toxicity.scored(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8): the smallest id; null ids stay.

    Of rows that repeat a kept id, one stays.
    """
    prepare(spark)
    found = minhash.near_duplicates(docs, width=5, per_cent=80)
    kept = found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    # texts are shuffled once, against a hash table of ids, at every size alike
    named = docs.select(*COLUMNS).where("doc_id is not null").join(kept.hint("shuffle_hash"), "doc_id")
    single = named.where("n = 1").select(*COLUMNS)
    one = named.where("n > 1").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("x")).select("doc_id", "x.*").select(*COLUMNS)
    return single.unionByName(one).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: each document as often as the mix takes it.

    Null text counts 0 words; a null source is one of its own; null ids are kept as they come. Equal rows share the copies
    that the mix gives them. Other columns than those of documents are left out. No rows give none.
    """
    prepare(spark)
    # equal rows share their copies
    copies = mixing.mix(docs).groupBy("h", "h2").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    keyed = mixing.keyed(docs.select(*COLUMNS))
    known = F.coalesce("copies", F.raise_error("mixing: a document has no row in the mix").cast("long"))
    taken = keyed.join(copies.hint("shuffle_hash"), ["h", "h2"], "left").where(known > 0)
    each = F.expr("sequence(1, cast(copies div n as int))")
    out = taken.where("copies >= n").withColumn("__i", F.explode(each)).select(*COLUMNS)
    rest = taken.where("n > 1 and copies % n > 0").groupBy("h", "h2").agg(F.first(F.struct(*COLUMNS)).alias("x"), F.first(F.expr("cast(copies % n as int)")).alias("k"))
    return out.unionByName(rest.withColumn("__i", F.explode(F.expr("sequence(1, k)"))).select("x.*").select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count of the byte-level BPE for each document, and digests of its ids and of their decoding.

    Null text is as the empty one; one row for each row, repeated rows too; very long texts are encoded whole. No rows give none.
    """
    prepare(spark)
    return bpe.coded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mixed), ("byte_bpe", encoded)]
#: Learned models, a seeded sample and hashes of ids can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
