"""Cached answers that hold as long as the files they rest on stay the same.

An entry is (cache_key, schema_version, result, manifest), the manifest mapping each evidence file to
its hash when the answer was found; it counts only if every evidence file of the question still has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def cache_key(file: Column, line: Column, character: Column) -> Column:
    return F.sha2(F.concat_ws(":", file, line.cast("string"), character.cast("string")), 256)


def file_hashes(files: DataFrame) -> DataFrame:
    """file_path and hash of files (file_path, content)."""
    return files.select("file_path", F.sha2(F.col("content"), 256).alias("hash"))


def entries(answers: DataFrame, hashes: DataFrame) -> DataFrame:
    """Entries of answers (cache_key, result, evidence_files); files that can't be read are missing from the manifest."""
    rows = answers.select("cache_key", "result", F.explode_outer("evidence_files").alias("file_path")).join(hashes, "file_path", "left")
    known = F.collect_set(F.when(F.col("hash").isNotNull(), F.struct("file_path", "hash")))
    return rows.groupBy("cache_key").agg(F.first("result").alias("result"), F.map_from_entries(known).alias("manifest")).withColumn("schema_version", F.lit(SCHEMA_VERSION))


def fresh(cached: DataFrame, asked: DataFrame, hashes: DataFrame) -> DataFrame:
    """cache_key and result of the questions (cache_key, evidence_files) whose entry still holds."""
    met = asked.select("cache_key", "evidence_files").join(cached.filter(F.col("schema_version") == SCHEMA_VERSION), "cache_key")
    checked = met.select("cache_key", "result", "manifest", F.explode_outer("evidence_files").alias("file_path")).join(hashes, "file_path", "left")
    same = F.col("file_path").isNull() | F.coalesce(F.try_element_at("manifest", F.col("file_path")) == F.col("hash"), F.lit(False))
    return checked.groupBy("cache_key").agg(F.first("result").alias("result"), F.min(same).alias("ok")).filter("ok").select("cache_key", "result")
