"""A snapshot as DataFrames, laid out for the intents.

Edges carry their ends' names, kinds and places, so that a one-hop intent is a pruned scan with
pushed filters and no join. Tables are partitioned by kind: an intent reads only the kinds it asks for.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagraph.sources import star
from stratagraph.sources.tables import settle, shared_folder

EDGE_DEFAULTS = {"log_level": "string", "template": "string", "subsystem": "string", "registration_api": "string", "site_file": "string", "site_line": "long", "access_path": "string", "timer_condition": "string", "resolution_kind": "string"}


@dataclass(frozen=True)
class Graph:
    """One snapshot. `edges` has all edges, `named` those with both ends present."""

    nodes: DataFrame
    edges: DataFrame
    observations: DataFrame

    @property
    def named(self) -> DataFrame:
        return self.edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())

    def of(self, *kinds: str) -> DataFrame:
        return self.named.filter(F.col("edge_kind").isin(*kinds))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


def with_tail(nodes: DataFrame) -> DataFrame:
    """Nodes with `tail`, what follows the last # of the name: names are looked up by it, with an equality that is pushed down."""
    name = F.col("canonical_name")
    return nodes.withColumn("tail", F.when(name.contains("#"), F.substring_index(name, "#", -1)))


def with_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with src, dst and their kinds, files and lines; null where an end has no node."""
    for name, kind in EDGE_DEFAULTS.items():
        if name not in edges.columns:
            edges = edges.withColumn(name, F.lit(None).cast(kind))
    for end in ("src", "dst"):
        side = nodes.select(F.col("node_id").alias(f"{end}_node_id"), F.col("canonical_name").alias(end), F.col("kind").alias(f"{end}_kind"), F.col("file_path").alias(f"{end}_file"), F.col("line").alias(f"{end}_line"))
        edges = edges.join(side, f"{end}_node_id", "left")
    return edges


def graph_of(nodes: DataFrame, edges: DataFrame, observations: DataFrame) -> Graph:
    """A graph of plain tables, for small and temporary ones."""
    nodes = with_tail(nodes)
    return Graph(nodes, with_names(nodes, edges), observations)


def stored(nodes: DataFrame, edges: DataFrame, observations: DataFrame, path: str) -> Graph:
    """Writes the snapshot partitioned by kind, names joined in once, and reads it from there.

    Rows are rebalanced by kind: Spark joins small kinds' tasks and splits large ones by size.
    """
    spark = nodes.sparkSession
    nodes = with_tail(nodes)
    nodes.hint("rebalance", "kind").write.partitionBy("kind").parquet(f"{path}/nodes")
    nodes = spark.read.schema(nodes.schema).parquet(f"{path}/nodes")
    named = with_names(nodes, edges)
    named.hint("rebalance", "edge_kind").write.partitionBy("edge_kind").parquet(f"{path}/edges")
    observations.write.parquet(f"{path}/observations")
    return Graph(nodes, spark.read.schema(named.schema).parquet(f"{path}/edges"), spark.read.schema(observations.schema).parquet(f"{path}/observations"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The star schema's graph; written once for a session and folder."""
    held = spark.sparkContext.__dict__.setdefault("_stratagraph_graphs", {})
    if sf_dir not in held:
        t = star.star_tables(spark, sf_dir)
        held[sf_dir] = stored(t["nodes"], t["edges"], t["observations"], f"{shared_folder(spark)}/strata-graphs/{uuid.uuid4().hex}")
    return held[sf_dir]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _ending(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(asked, name) of the symbols that end in # and a name asked for: one scan, by the names' own last parts."""
    wanted = F.broadcast(nodes.sparkSession.createDataFrame([(n, n.rpartition("#")[2]) for n in names], "asked string, last string"))
    at = nodes.filter(F.col("tail").isin(*{n.rpartition("#")[2] for n in names})).select("canonical_name", "tail")
    return at.join(wanted, (F.col("tail") == F.col("last")) & F.endswith(F.col("canonical_name"), F.concat(F.lit("#"), F.col("asked")))).select("asked", F.col("canonical_name").alias("name")).distinct()


def resolved(nodes: DataFrame, names: list[str], candidates: int = 20) -> DataFrame:
    """One column `name`: the names asked for, and for each the first symbols that end in `#name`. Bounded by 21 rows a name."""
    first = F.row_number().over(Window.partitionBy("asked").orderBy("name"))
    ends = _ending(nodes, names).withColumn("n", first).filter(F.col("n") <= candidates).select("name")
    return F.broadcast(nodes.sparkSession.createDataFrame([(n,) for n in names], "name string").unionByName(ends).distinct())


def first_resolved(nodes: DataFrame, name: str) -> DataFrame:
    """One row `name`: the first symbol that ends in `#name`, or the name itself."""
    ends = _ending(nodes, [name]).agg(F.min("name").alias("m"))
    return F.broadcast(ends.select(F.coalesce("m", F.lit(name)).alias("name")))


def ilike(column: Column, pattern: str) -> Column:
    return column.ilike(pattern)


def contains_literal(column: Column, text: str) -> Column:
    """Case-insensitive, with wildcards taken as they are."""
    return F.lower(column).contains(text.lower())


__all__ = ["Graph", "contains_literal", "empty", "first_resolved", "graph_of", "ilike", "resolved", "settle", "star_graph", "stored", "with_names"]
