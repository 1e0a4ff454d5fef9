"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import langid, mixing, neardup, outliers, pieces, quality, tiff, urls, warc, wrappers


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a page is good if the document it shows is of good quality and not toxic
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double").alias("good"))
    return urls.judge(_read(spark, sf_dir, "pages"), labels, urls.page_document(F.col("path")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(_read(spark, sf_dir, "documents"))


def op3_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = quality.page_sites(_read(spark, sf_dir, "pages").select("url"))
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), sites)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_read(spark, sf_dir, "documents"))


def op6_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def segmented(docs: DataFrame) -> DataFrame:
    """Sampled segmentations: piece ids, their number and digest, and whether decoding gives each text back."""
    marked = docs.select("doc_id", "text", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_md5"))
    back = pieces.round_trip(marked, carry=("text_md5",))
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("pieces_xxhash64"), F.length("text").cast("long").alias("n_chars"), "text_md5", (F.md5("text") == F.col("text_md5")).alias("lossless"))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmented(_read(spark, sf_dir, "documents"))


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(tiff.store_texts(_read(spark, sf_dir, "documents")))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read_archives(warc.stored_archives(_read(spark, sf_dir, "pages")))
    # a revisit has no payload; its length and digest are those that its record states
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    digest = F.coalesce(F.sha1("payload"), F.col("payload_digest"))
    return back.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_mix_sources": op2_mix_sources,
    "op3_wrapper_extraction": op3_wrapper_extraction,
    "op4_site_quality": op4_site_quality,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_crf_language_id": op6_crf_language_id,
    "op7_tiff_media": op7_tiff_media,
    "op8_sampled_pieces": op8_sampled_pieces,
    "op9_robust_outliers": op9_robust_outliers,
    "op10_warc_round_trip": op10_warc_round_trip,
}

ORACLE: dict[str, str] = {
    "op1_url_filters": urls.sql(),
    "op2_mix_sources": mixing.SQL,
    "op10_warc_round_trip": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS stored FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
          CASE WHEN stored IS NOT NULL AND page_id IS DISTINCT FROM stored THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN page_id IS DISTINCT FROM stored THEN stored END AS refers_to, CAST(NULL AS VARCHAR) AS error
        FROM m""",
}
