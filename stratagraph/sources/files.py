"""Source trees as tables: walking, reading and searching files with Spark's readers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that are never walked.
SKIPPED = ("node_modules", ".git", "dist", "build", "target", ".cache", "out")


def walk(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), skip: tuple[str, ...] = SKIPPED, only: DataFrame | None = None) -> DataFrame:
    """file_path (below the root), length and modified of all files; `only` keeps the paths that it lists (file_path)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    top = root.split("://", 1)[-1].rstrip("/") + "/"
    at = F.instr(F.col("path"), top)
    out = files.select(F.expr(f"substring(path, instr(path, '{top}') + {len(top)})").alias("file_path"), "length", "modified", "path").filter(at > 0)
    if extensions:
        out = out.filter(F.lower(F.element_at(F.split("file_path", r"\."), -1)).isin(*(e.lstrip(".").lower() for e in extensions)))
    out = out.filter(~F.arrays_overlap(F.split("file_path", "/"), F.array(*map(F.lit, skip)))) if skip else out
    return out if only is None else out.join(only.select("file_path").distinct(), "file_path", "left_semi")


def lines(spark: SparkSession, root: str) -> DataFrame:
    """path and text of every line."""
    return spark.read.format("text").option("recursiveFileLookup", "true").load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ** crosses directories, * and ? don't, {a,b} are alternatives; one without a slash fits in any directory."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
            continue
        depth += (c == "{") - (c == "}" and depth > 0)
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:"}.get(c) or (")" if c == "}" and depth >= 0 and "{" in glob[:i] else "|" if c == "," and depth else re.escape(c))
        i += 1
    return ("^" if "/" in glob else "^(?:.*/)?") + out.lstrip("/") + "$"


def matching(df: DataFrame, globs: list[str] | None, column: str = "file_path") -> DataFrame:
    """The rows whose path fits any of the globs and none of those that begin with !."""
    wanted = [glob_pattern(g) for g in globs or [] if not g.startswith("!")]
    unwanted = [glob_pattern(g[1:]) for g in globs or [] if g.startswith("!")]
    if wanted:
        df = df.filter(F.col(column).rlike("|".join(f"(?:{p})" for p in wanted)))
    for p in unwanted:
        df = df.filter(~F.col(column).rlike(p))
    return df


def find(spark: SparkSession, root: str, globs: list[str] | None = None, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """file_path, length and modified of the files that the globs fit."""
    return matching(walk(spark, root, (), skip), globs).drop("path")


def search(spark: SparkSession, root: str, pattern: str, ignore_case: bool = False, globs: list[str] | None = None, word: bool = False, literal: bool = False) -> DataFrame:
    """file_path, line, column and text of the lines that match a regular expression, or that hold a text as it is."""
    pattern = re.escape(pattern) if literal else pattern
    pattern = ("(?i)" if ignore_case else "") + (rf"\b(?:{pattern})\b" if word else pattern)
    files = matching(walk(spark, root, (), ()), globs).select("file_path", "path")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("__p"), "content")
    texts = files.join(read, F.col("path") == F.col("__p")).select("file_path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("line", "text"))
    at = F.regexp_instr("text", F.lit(pattern))
    return texts.filter(F.col("text").rlike(pattern)).select("file_path", (F.col("line") + 1).cast("long").alias("line"), at.alias("column"), "text")


def count_matches(spark: SparkSession, root: str, pattern: str, **options) -> DataFrame:
    """file_path and how many of its lines match."""
    return search(spark, root, pattern, **options).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


def fixtures(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON documents, one to a file; a bad one is a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(root)
