"""One query for each operator of this subpackage, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from . import bpe, embed_dedup, langid, lm_score, minhash, mixing, tiff, toxicity, url_filter, warc_audit
from .common import crc_mod, prepare


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a cube-method mix takes of each document."""
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_compression_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression cross-entropy of each document; the domain is that of the documents labelled good."""
    docs, labels = (_read(spark, sf_dir, t) for t in ("documents", "labels"))
    return lm_score.cross_entropy(docs, labels.where("quality = 1"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with Jaccard similarity of 2-word shingles of 0.8 or more."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), width=2, per_cent=80)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings at cosine 0.9 or more."""
    return embed_dedup.near_vectors(_read(spark, sf_dir, "embeddings"), least=0.9)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's url."""
    return url_filter.judged(_read(spark, sf_dir, "pages"))


def toxic_model(spark: SparkSession, sf_dir: str) -> dict:
    return toxicity.learned(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document."""
    found = toxicity.scored(_read(spark, sf_dir, "documents").select("doc_id", "text"), toxic_model(spark, sf_dir))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def language_model(docs: DataFrame) -> dict:
    return langid.learned(docs, crc_mod("doc_id", 4) != 2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document."""
    docs = _read(spark, sf_dir, "documents")
    found = langid.predicted(docs.select("doc_id", "text"), language_model(docs))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of their decoding."""
    return bpe.coded(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as TIFF and read back."""
    return tiff.text_media(_read(spark, sf_dir, "documents"))


#: Records of an archive in the drill.
PER_ARCHIVE = 1000


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the pages' archives against a replica with damage of known places.

    The drill's replica has the first character of html replaced where the id is 5 modulo 997, the last ten characters
    overwritten at 7 modulo 1499, lacks the record at 11 modulo 1999, has one more after 13 modulo 2503, and holds
    the record at 17 modulo 3001 two places later.
    """
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    order = [F.col("page_id").asc_nulls_last(), F.col("url").asc(), F.xxhash64("html").asc()]
    rows = numbered(pages, order, "place").withColumn("archive", F.expr(f"place div {PER_ARCHIVE}"))
    at = F.coalesce("page_id", F.lit(-1))
    shown = lambda html, mark="": (F.concat(F.lit("urn:page:" + mark), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"), warc_audit.record(F.col("page_id"), F.col("url"), html).alias("record"))
    ours = rows.select("archive", F.col("place").alias("position"), *shown(F.col("html")))
    cut = F.when(F.pmod(at, F.lit(1499)) == 7, F.expr("substring(html, 1, greatest(length(html) - 10, 0)) || '0000000000'")).otherwise(F.col("html"))
    damaged = F.when(F.pmod(at, F.lit(997)) == 5, F.expr("'#' || substring(html, 2)")).otherwise(cut)
    position = 2 * F.col("place") + F.when(F.pmod(at, F.lit(3001)) == 17, 5).otherwise(0)
    theirs = rows.where(F.pmod(at, F.lit(1999)) != 11).select("archive", position.alias("position"), *shown(damaged))
    more = rows.where(F.pmod(at, F.lit(2503)) == 13).select("archive", (2 * F.col("place") + 1).alias("position"), *shown(F.col("html"), "again:"))
    return warc_audit.audit(ours, theirs.unionByName(more))


def tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page of a TIFF file of each document: its payload, and the first 576 bytes in tiles; codecs take turns."""
    found = tiff.page_rows(tiff.text_files(_read(spark, sf_dir, "documents")), key="doc_id", column="data")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "page", "width", "height", "samples", "compression", "predictor", "tiled", F.octet_length("pixels").cast("long").alias("n_pixels"), "error")


_RECORD = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen({h})::varchar || chr(13) || chr(10) || chr(13) || chr(10) || {h} || chr(13) || chr(10) || chr(13) || chr(10)"
_PLACED = "SELECT *, row_number() OVER (PARTITION BY archive ORDER BY position) - 1 AS no, (sum(n) OVER (PARTITION BY archive ORDER BY position))::bigint AS hi FROM {0}"

ORACLE_SQL: dict[str, str] = {
    "op10_warc_fixity": f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, row_number() OVER (ORDER BY page_id NULLS LAST) - 1 AS place, coalesce(page_id, -1) AS pid FROM pages),
d AS (SELECT *, place // {PER_ARCHIVE} AS archive, CASE WHEN pid % 997 = 5 THEN '#' || substring(html, 2)
    WHEN pid % 1499 = 7 THEN substring(html, 1, greatest(length(html) - 10, 0)) || '0000000000' ELSE html END AS bad FROM p),
x AS (SELECT archive, place AS position, 'urn:page:' || coalesce(page_id::varchar, '') AS record_id, {_RECORD.format(h='html')} AS r FROM d),
y AS (SELECT archive, 2 * place + CASE WHEN pid % 3001 = 17 THEN 5 ELSE 0 END AS position, 'urn:page:' || coalesce(page_id::varchar, '') AS record_id, {_RECORD.format(h='bad')} AS r FROM d WHERE pid % 1999 <> 11
    UNION ALL SELECT archive, 2 * place + 1, 'urn:page:again:' || coalesce(page_id::varchar, ''), {_RECORD.format(h='html')} FROM d WHERE pid % 2503 = 13),
x1 AS (SELECT archive, position, record_id, strlen(r) AS n, sha256(r) AS sha FROM x), y1 AS (SELECT archive, position, record_id, strlen(r) AS n, sha256(r) AS sha FROM y),
x2 AS (SELECT *, hi - n AS lo FROM ({_PLACED.format('x1')})), y2 AS (SELECT *, hi - n AS lo FROM ({_PLACED.format('y1')})),
l AS (SELECT *, sha256(lo::varchar || '-' || hi::varchar || ':' || sha) AS leaf FROM x2), m AS (SELECT *, sha256(lo::varchar || '-' || hi::varchar || ':' || sha) AS leaf FROM y2),
t1 AS (SELECT archive, no // 10 AS no, min(lo) AS lo, max(hi) AS hi, string_agg(leaf, '' ORDER BY no) AS c FROM l GROUP BY 1, 2),
t2 AS (SELECT archive, no // 10 AS no, min(lo) AS lo, max(hi) AS hi, string_agg(sha256(lo::varchar || '-' || hi::varchar || ':' || c), '' ORDER BY no) AS c FROM t1 GROUP BY 1, 2),
t3 AS (SELECT archive, min(lo) AS lo, max(hi) AS hi, string_agg(sha256(lo::varchar || '-' || hi::varchar || ':' || c), '' ORDER BY no) AS c FROM t2 GROUP BY 1),
j AS (SELECT coalesce(l.archive, m.archive) AS archive, coalesce(l.record_id, m.record_id) AS record_id, coalesce(l.no, m.no) AS no, coalesce(l.lo, m.lo) AS lo, coalesce(l.hi, m.hi) AS hi,
    coalesce(l.sha, m.sha) AS record_sha256, coalesce(l.leaf, m.leaf) AS leaf_sha256,
    CASE WHEN l.no IS NULL THEN 'added' WHEN m.no IS NULL THEN 'missing' WHEN l.sha <> m.sha THEN 'corrupt' WHEN l.leaf <> m.leaf THEN 'shifted' ELSE 'ok' END AS status
    FROM l FULL JOIN m ON l.archive = m.archive AND l.record_id = m.record_id)
SELECT j.archive::bigint AS archive, no::bigint AS no, record_id, j.lo::bigint AS lo, j.hi::bigint AS hi, record_sha256, leaf_sha256, sha256(t3.lo::varchar || '-' || t3.hi::varchar || ':' || t3.c) AS archive_root, status
FROM j LEFT JOIN t3 ON t3.archive = j.archive""",
    "tiff_pages": """
WITH d AS (SELECT doc_id, ((greatest(strlen(coalesce(text, '')), 1) + 575) // 576) * 576 AS n, coalesce(doc_id, 0) % 4 AS k FROM documents)
SELECT doc_id, page::int AS page, 24::int AS width, (CASE WHEN page = 0 THEN n ELSE 576 END // 24)::int AS height, 1::int AS samples, (CASE k WHEN 0 THEN 1 WHEN 1 THEN 8 WHEN 2 THEN 32773 ELSE 5 END)::int AS compression,
    (CASE WHEN page = 0 THEN 1 ELSE 2 END)::int AS predictor, page = 1 AS tiled, (CASE WHEN page = 0 THEN n ELSE 576 END)::bigint AS n_pixels, NULL::varchar AS error
FROM d, (VALUES (0), (1)) v(page)""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_compression_score, op3_minhash_dedup, op4_embedding_dedup, op5_url_filter, op6_toxicity, op7_language_id, op8_byte_bpe, op9_tiff_media, op10_warc_fixity, tiff_pages)
}
