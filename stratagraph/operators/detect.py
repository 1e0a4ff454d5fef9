"""Detectors: symbols that something never refers to, two-cycles and self loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators.hops import LIMIT
from stratagraph.plans.graph import Graph

EXPORTABLE = ("function", "class", "interface")


def _shown(nodes: DataFrame, limit: int, *more: str) -> DataFrame:
    return nodes.select("kind", "canonical_name", "file_path", F.col("line").alias("line_number"), *more).orderBy("canonical_name", "kind", *more).limit(limit)


def _without(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    ids = edges.select(F.col(f"{end}_node_id").alias("node_id")).filter(F.col("node_id").isNotNull()).distinct()
    return nodes.join(ids, "node_id", "left_anti")


def module_entry_points(g: Graph, limit: int = LIMIT) -> DataFrame:
    return _shown(_without(g.nodes.filter("kind = 'module'"), g.edges.filter("edge_kind = 'imports'"), "dst"), limit)


def orphan_modules(g: Graph, limit: int = LIMIT) -> DataFrame:
    imports = g.edges.filter("edge_kind = 'imports'")
    return _shown(_without(_without(g.nodes.filter("kind = 'module'"), imports, "dst"), imports, "src"), limit)


def dead_exports(g: Graph, limit: int = LIMIT) -> DataFrame:
    n = g.nodes.filter(F.col("kind").isin(*EXPORTABLE) & F.col("exported"))
    return _shown(_without(n, g.edges.filter(F.col("edge_kind").isin("calls", "references_type", "extends", "implements")), "dst"), limit)


def undocumented_exports(g: Graph, limit: int = LIMIT) -> DataFrame:
    return _shown(g.nodes.filter(F.col("kind").isin(*EXPORTABLE) & F.col("exported") & F.col("doc").isNull()), limit)


def unused_fields(g: Graph, limit: int = LIMIT) -> DataFrame:
    n = _without(g.nodes.filter("kind = 'field'").drop("owning_class"), g.edges.filter(F.col("edge_kind").isin("reads_field", "writes_field")), "dst")
    parent = g.of("contains").select(F.col("dst_node_id").alias("node_id"), F.col("src").alias("owning_class"))
    return _shown(n.join(parent, "node_id", "left"), limit, "owning_class")


def two_cycles(g: Graph, edge_kind: str, kinds: tuple[str, ...], label: str, limit: int = LIMIT) -> DataFrame:
    """Pairs a < b with edges both ways.

    An edge and its reverse have the same pair of ends: one grouping by that pair, instead of a self-join.
    """
    e = g.of(edge_kind).filter(F.col("src_kind").isin(*kinds) & F.col("dst_kind").isin(*kinds) & (F.col("src") != F.col("dst")))
    pair = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.col("src") < F.col("dst")).alias("there"), F.max(F.col("src") > F.col("dst")).alias("back"), F.min(F.when(F.col("src") < F.col("dst"), F.col("src_kind"))).alias("kind"))
    return pair.filter("there and back").select("kind", F.col("a").alias("canonical_name"), F.col("a").alias("caller"), F.col("b").alias("callee"), F.lit(label).alias("edge_kind")).orderBy("caller", "callee").limit(limit)


def recursive_methods(g: Graph, limit: int = LIMIT) -> DataFrame:
    e = g.of("calls").filter((F.col("src_node_id") == F.col("dst_node_id")) & F.col("src_kind").isin("function", "method"))
    return e.select(F.col("src_kind").alias("kind"), F.col("src").alias("canonical_name"), F.col("src_file").alias("file_path"), F.col("src_line").alias("line_number")).distinct().orderBy("canonical_name", "kind").limit(limit)
