"""A corpus pipeline: language, quality, near-duplicates, source mix and segmentation, a stage each.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet and
reads again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import langid, mixing, neardup, pieces, quality
from stratagraph.llm.queries import segmented
from stratagraph.llm.runtime import cut, delete, made, release, shared_folder

#: Least share of a text's words that its language must have for the text to stay.
LEAST_LANGUAGE_SHARE = 0.5
#: Bytes of bitmaps that may be broadcast: a bit for each of half a billion rows.
BITMAP_BYTES = 64 << 20


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, n, and the columns of documents) in a written table: whole rows as structs, so that no column of theirs
    clashes with an operator's, and a number each, since ids may be null or repeat, with other texts."""
    whole = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n"))
    return cut(whole).select("row", "n", *(f"row.{c}" for c in ("doc_id", "text", "lang", "source")))


def _rows_of(rows: DataFrame, chosen: DataFrame, copies: bool = False) -> DataFrame:
    """The numbered rows that are in `chosen` (n, copies): as they are, or so many times (MAX_EPOCHS at most).

    The choice is gathered into bitmaps, a bit for a row, in buckets of 32,768 consecutive numbers, so that the rows
    themselves stay where they are: bitmaps of up to BITMAP_BYTES are broadcast, larger ones join by bucket.
    """
    levels = range(1, int(mixing.MAX_EPOCHS) + 1 if copies else 2)
    marks = chosen.select(F.shiftright("n", 15).alias("bucket"), F.col("n").bitwiseAND(32767).alias("place"), (F.col("copies") if copies else F.lit(1)).alias("copies"))
    bits = [F.expr(f"bitmap_construct_agg(place) FILTER (WHERE copies >= {k})").alias(f"bits{k}") for k in levels]
    bits = cut(marks.repartition("bucket").groupBy("bucket").agg(*bits))
    if bits.count() * 4096 * len(levels) <= BITMAP_BYTES:
        bits = F.broadcast(bits)
    held = lambda k: F.expr(f"coalesce(shiftright(cast(conv(hex(substring(bits{k}, int((n & 32767) div 8) + 1, 1)), 16, 10) as int), int(n & 7)) & 1, 0)")
    out = rows.select("row", "n").join(bits, F.shiftright("n", 15) == F.col("bucket")).withColumn("copies", sum((held(k) for k in levels), F.lit(0))).filter("copies > 0")
    if copies:
        out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words, and those in which no language has half of the words, go; rows are judged where they are read.

    Null and empty texts go; repeated rows and ids are judged row by row; long texts count whole; a share of
    exactly one half stays; an empty table gives an empty one; any further columns, whatever their names, are carried.
    """
    found = langid.predict(docs.select(F.struct("*").alias("row")), langid.fit(docs), id_col="row", text="row.text")
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of good quality is below one half go.

    A null text has the evidence of an empty one; a null id has no label and no page; repeated rows and ids are
    judged row by row; a posterior of exactly one half stays; empty tables and further columns as above.
    """
    rows = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sites = quality.page_sites(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url"))
    return _rows_of(rows, quality.classify(rows.drop("row"), labels, sites, carry=("n",)).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays: the one with the least id, then by its text; null ids come last.

    Texts without words are classes of their own and all stay; of repeated rows one stays; long texts count
    whole; empty tables and further columns as above.
    """
    rows = _numbered(docs)
    found = neardup.classes(rows.select("n", "text"), id_col="n").select(F.col("doc_id").alias("m"), "class_id")
    ids = rows.select("n", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), "n").alias("place"))
    least = found.join(ids, F.col("m") == F.col("n")).groupBy("class_id").agg(F.min("place").alias("place"))
    return _rows_of(rows, least.select("place.n"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Null texts are never taken; a null source is a source; of rows with equal keys each is taken or not by
    itself; empty tables and further columns as above.
    """
    rows = _numbered(docs)
    mixed = mixing.mix(rows.drop("row"), carry=("n",)).filter("taken > 0")
    return _rows_of(rows, mixed.select("n", F.expr("taken div size").alias("copies")), copies=True)


def sentencepiece_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations, their piece ids, and that decoding gives each text back.

    Null and empty texts have no pieces; rows with equal ids and texts get equal pieces; an empty table gives
    an empty one; further columns are left out.
    """
    return segmented(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece_round_trip),
]

#: The conditional random field, the sampling and the consistent weighted samples have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what lies between them is in the shared checkpoint folder, and goes once it has been read."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path, since = f"{folder}/{k}-{name}", len(made(spark))
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, since)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
