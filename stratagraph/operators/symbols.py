"""Symbol search and places: scans of the nodes with pushed filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators.hops import LIMIT
from stratagraph.plans.graph import Graph, contains_literal


def _rows(nodes: DataFrame, *more) -> DataFrame:
    return nodes.select("kind", "canonical_name", "file_path", F.col("line").alias("line_number"), *more)


def by_name(g: Graph, pattern: str, limit: int = LIMIT) -> DataFrame:
    return _rows(g.nodes.filter(contains_literal(F.col("canonical_name"), pattern))).orderBy("canonical_name", "kind").limit(limit)


def by_kind(g: Graph, kind: str, limit: int = LIMIT) -> DataFrame:
    return _rows(g.nodes.filter(F.col("kind") == kind)).orderBy("canonical_name").limit(limit)


def by_doc(g: Graph, pattern: str, limit: int = LIMIT) -> DataFrame:
    return _rows(g.nodes.filter(contains_literal(F.col("doc"), pattern)), "doc").orderBy("canonical_name", "kind").limit(limit)


def _in_file(path: str):
    return (F.col("file_path") == path) | F.endswith(F.lower(F.col("file_path")), F.lit("/" + path.lower()))


def in_file(g: Graph, path: str, limit: int = LIMIT) -> DataFrame:
    return _rows(g.nodes.filter(_in_file(path)), "end_line").orderBy(F.col("line_number").asc_nulls_first(), "canonical_name").limit(limit)


def at_location(g: Graph, path: str, line: int, limit: int = LIMIT) -> DataFrame:
    """Symbols whose lines cover the place: the innermost first, modules last."""
    end = F.coalesce("end_line", "line")
    hit = g.nodes.filter(_in_file(path) & (F.col("line") <= line) & (end >= line))
    out = _rows(hit, "end_line", (end - F.col("line")).alias("span"))
    return out.orderBy(F.when(F.col("kind") == "module", 1).otherwise(0), "span", F.col("line_number").desc(), "canonical_name").limit(limit)


def at_locations(g: Graph, probes: DataFrame, bucket: int = 256) -> DataFrame:
    """For every probe (probe_id, file_path, line) the innermost symbol around it.

    A range join as an equi-join: symbols are repeated for each run of `bucket` lines that they
    cover, so that a probe meets only the symbols of its file and run.
    """
    end = F.coalesce("end_line", "line")
    spans = g.nodes.filter(F.col("file_path").isNotNull() & F.col("line").isNotNull()).select("canonical_name", "kind", F.col("file_path").alias("f"), F.col("line").alias("low"), end.alias("high"))
    spans = spans.withColumn("run", F.explode(F.sequence(F.floor(F.col("low") / bucket), F.floor(F.greatest("low", "high") / bucket))))
    p = probes.withColumn("at", F.floor(F.col("line") / bucket))
    met = p.join(spans, (F.col("file_path") == F.col("f")) & (F.col("at") == F.col("run")) & F.col("line").between(F.col("low"), F.col("high")))
    rank = F.struct((F.col("kind") == "module").alias("m"), (F.col("high") - F.col("low")).alias("span"), (-F.col("low")).alias("l"), F.col("canonical_name"))
    return met.groupBy("probe_id").agg(F.min(rank)["canonical_name"].alias("canonical_name"))
