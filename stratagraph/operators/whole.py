"""Whole-graph operators: export, filters, subgraphs, comparison and the dashboard's aggregates.

A `Whole` is nodes keyed by name and edges between names; filters compose lazily, and nothing is
collected before a renderer asks for it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.plans.graph import Graph
from stratagraph.sources.tables import held, settle, settled_small

NODE = ("id", "kind", "file_path", "line", "end_line", "line_count", "exported", "doc", "owning_class")
EDGE = ("src", "dst", "kind", "resolution_kind")


@dataclass(frozen=True)
class Whole:
    nodes: DataFrame
    edges: DataFrame


def export(g: Graph) -> Whole:
    """All nodes, and the edges whose ends both have one."""
    nodes = g.nodes.withColumnRenamed("canonical_name", "id").select(*NODE)
    return Whole(nodes, g.named.select("src", "dst", F.col("edge_kind").alias("kind"), "resolution_kind"))


def induced(w: Whole, ids: DataFrame) -> Whole:
    """The nodes in `ids` (id) and the edges inside them."""
    inside = lambda end: ids.select(F.col("id").alias(end))
    return Whole(w.nodes.join(ids, "id", "left_semi"), w.edges.join(inside("src"), "src", "left_semi").join(inside("dst"), "dst", "left_semi").select(*EDGE))


def of_kinds(w: Whole, symbol_kinds: list[str] | None = None, edge_kinds: list[str] | None = None) -> Whole:
    if edge_kinds:
        w = replace(w, edges=w.edges.filter(F.col("kind").isin(*edge_kinds)))
    if symbol_kinds:
        kept = w.nodes.filter(F.col("kind").isin(*symbol_kinds))
        w = induced(Whole(kept, w.edges), kept.select("id"))
    return w


def center(w: Whole, query: str) -> str | None:
    """The node that a query means: by its name, or else the end of one, or else a part of one."""
    rank = F.when(F.col("id") == query, 0).when(F.col("id").endswith("#" + query), 1).when(F.col("id").contains(query), 2)
    best = w.nodes.select("id", rank.alias("r")).filter("r IS NOT NULL").agg(F.min(F.struct("r", "id")).alias("m")).first()["m"]
    return best["id"] if best else None


def distances(edges: DataFrame, root: str, hops: int, direction: str = "both") -> DataFrame:
    """(id, dist) of what is within `hops` of the root, by breadth-first levels."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    steps = held({"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct())
    seen = frontier = held(edges.sparkSession.createDataFrame([(root, 0)], "id string, dist int"))
    for d in range(1, hops + 1):
        step = frontier.join(steps, frontier["id"] == steps["a"]).select(F.col("b").alias("id")).distinct()
        frontier = held(step.join(seen, "id", "left_anti").withColumn("dist", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = held(seen.unionByName(frontier))
    return seen


def center_subgraph(w: Whole, query: str, hops: int = 2, direction: str = "both") -> Whole:
    root = center(w, query)
    if root is None:
        return Whole(w.nodes.filter(F.lit(False)), w.edges.filter(F.lit(False)))
    return induced(w, distances(w.edges, root, hops, direction).select("id"))


def data_path_subgraph(w: Whole, src: str, dst: str, depth: int = 6) -> Whole:
    """The union of all shortest chains over field_of_type and aggregates."""
    none = Whole(w.nodes.filter(F.lit(False)), w.edges.filter(F.lit(False)))
    a, b = center(w, src), center(w, dst)
    if a is None or b is None:
        return none
    data = w.edges.filter(F.col("kind").isin("field_of_type", "aggregates"))
    depth = min(max(depth, 1), 20)
    ahead = settled_small(distances(data, a, depth, "out"))
    total = ahead.filter(F.col("id") == b).first()
    if total is None:
        return none
    behind = settled_small(distances(data, b, total["dist"], "in"))
    # an edge is on a shortest chain if what lies before and after it adds up
    on = data.join(ahead.select(F.col("id").alias("src"), F.col("dist").alias("d1")), "src").join(behind.select(F.col("id").alias("dst"), F.col("dist").alias("d2")), "dst").filter(F.col("d1") + F.col("d2") + 1 == total["dist"]).select(*EDGE)
    ids = on.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Whole(w.nodes.join(ids, "id", "left_semi"), on)


def top_by_degree(w: Whole, n: int) -> Whole:
    """The n nodes with the most edge ends, ties by name, and the edges inside them."""
    ends = w.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count()
    kept = w.nodes.select("id").join(ends, "id", "left").orderBy(F.coalesce("count", F.lit(0)).desc(), "id").limit(n).select("id")
    return induced(w, settle(kept))


def filtered(w: Whole, symbol_kinds=None, edge_kinds=None, center_of: str | None = None, hops: int = 2, direction: str = "both", data_path: tuple[str, str] | None = None, depth: int = 6, max_nodes: int | None = None) -> Whole:
    """All filters, in the order kinds, centre, data path, size."""
    w = of_kinds(w, symbol_kinds, edge_kinds)
    if center_of:
        w = center_subgraph(w, center_of, hops, direction)
    if data_path:
        w = data_path_subgraph(w, *data_path, depth)
    return top_by_degree(w, max_nodes) if max_nodes else w


def diff(a: Whole, b: Whole) -> DataFrame:
    """Nodes by name and edges by (src, dst, kind) that only one side has, or both: item, change, key, src, dst, kind.

    One grouping for each table instead of three joins; metadata doesn't count.
    """
    def sides(x: DataFrame, y: DataFrame, keys: list[str], item: str) -> DataFrame:
        both = x.select(*keys, F.lit(1).alias("s")).unionByName(y.select(*keys, F.lit(2).alias("s")))
        grouped = both.groupBy(*keys).agg(F.min("s").alias("low"), F.max("s").alias("high"))
        return grouped.select(F.lit(item).alias("item"), F.when(F.col("high") == 1, "removed").when(F.col("low") == 2, "added").otherwise("common").alias("change"), *keys)

    nodes = sides(a.nodes, b.nodes, ["id"], "node").select("item", "change", F.col("id").alias("src"), F.lit("").alias("dst"), F.lit("").alias("kind"))
    return nodes.unionByName(sides(a.edges, b.edges, ["src", "dst", "kind"], "edge").select("item", "change", "src", "dst", "kind"))


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("item", "change").agg(F.count(F.lit(1)).alias("n"))


def totals(g: Graph) -> DataFrame:
    return g.nodes.agg(F.count(F.lit(1)).alias("total_nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("total_edges")))  # one row each


def edge_kinds(g: Graph) -> DataFrame:
    return g.edges.groupBy("edge_kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "edge_kind")


def resolution_kinds(g: Graph) -> DataFrame:
    e = g.edges.filter((F.col("edge_kind") == "calls") & F.col("resolution_kind").isNotNull())
    return e.groupBy("resolution_kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "resolution_kind")


#: More rows than a list can have.
EVERYTHING = 2**31 - 1
#: The dashboard's lists: title, intent, limit.
DASHBOARD = (
    ("top_imported_modules", "find_top_imported_modules", 10), ("top_called_functions", "find_top_called_functions", 10), ("top_implemented_interfaces", "find_top_implemented_interfaces", 10),
    ("largest_modules", "find_largest_modules", 10), ("long_functions", "find_long_functions", 10), ("directories", "find_modules_by_directory", 15), ("classes_by_method_count", "find_classes_by_method_count", 10),
    ("classes_by_field_count", "find_classes_by_field_count", 10), ("widely_referenced_types", "find_widely_referenced_types", 10), ("tightly_coupled_modules", "find_tightly_coupled_modules", 10),
    ("top_touched_types", "find_top_touched_types", 10), ("top_field_writers", "find_top_field_writers", 10), ("top_field_readers", "find_top_field_readers", 10), ("top_hot_fields", "find_top_hot_fields", 10),
    ("god_methods", "find_god_methods", 10), ("import_cycles", "find_import_cycles", 20), ("call_cycles", "find_call_cycles", 20), ("entry_points", "find_module_entry_points", 1000),
    ("dead_exports", "find_dead_exports", 1000), ("unused_fields", "find_unused_fields", 1000), ("external_imports", "find_external_imports", 15),
)


def dashboard(g: Graph) -> dict:
    """Totals, histograms and the lists: the first rows of each, and how many there are without the limit."""
    from stratagraph.plans.catalog import Request, build

    out: dict = totals(g).first().asDict()
    out["edge_kinds"] = {r["edge_kind"]: r["n"] for r in edge_kinds(g).collect()}
    out["resolution_kinds"] = {r["resolution_kind"]: r["n"] for r in resolution_kinds(g).collect()}
    for title, intent, limit in DASHBOARD:
        rows = [r.asDict() for r in build(g, Request(intent, limit=limit)).collect()]
        count = len(rows) if len(rows) < limit else build(g, Request(intent, limit=EVERYTHING)).count()
        out[title] = {"rows": rows, "count": count, "capped": count > len(rows)}
    return out


def render(board: dict, form: str = "text") -> str:
    if form == "json":
        return json.dumps(board, indent=2, default=str)
    mark, lines = ("## ", "- ") if form == "markdown" else ("", "  ")
    out = [f"{mark}totals", f"{lines}{board['total_nodes']} nodes, {board['total_edges']} edges"]
    for title, value in board.items():
        if isinstance(value, dict):
            out.append(f"{mark}{title}")
            rows = value.get("rows")
            out += [f"{lines}{k}: {v}" for k, v in value.items()] if rows is None else [f"{lines}{r.get('canonical_name')}" for r in rows]
            if value.get("capped") is True:
                out.append(f"{lines}(of {value['count']})")
    return "\n".join(out)


def document_lines(w: Whole, workspace: str, snapshot_id: int, totals_row) -> DataFrame:
    """The document of a (filtered) graph as lines in order, (at, line): together they are one JSON text."""
    head = json.dumps({"workspace": workspace, "snapshot_id": snapshot_id, "total_nodes": totals_row["total_nodes"], "total_edges": totals_row["total_edges"]})
    spark = w.nodes.sparkSession
    options = {"ignoreNullFields": "false"}
    nodes = w.nodes.select(F.struct(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).alias("at"), F.to_json(F.struct(*NODE), options).alias("row"))
    edges = w.edges.select(F.struct(F.lit(3).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("kind").alias("c")).alias("at"), F.to_json(F.struct(*EDGE), options).alias("row"))

    def listed(rows: DataFrame) -> DataFrame:
        first = rows.agg(F.min(F.struct("at", "row")).alias("m"))  # the row that no comma stands before
        return rows.crossJoin(F.broadcast(first)).select("at", F.concat(F.when(F.struct("at", "row") == F.col("m"), "").otherwise(","), F.col("row")).alias("line"))

    mark = lambda part, text: (({"part": part, "a": "", "b": "", "c": ""}), text)
    frame = spark.createDataFrame([mark(0, head[:-1] + ', "nodes": ['), mark(2, '], "edges": ['), mark(4, "]}")], "at struct<part:int,a:string,b:string,c:string>, line string")
    return frame.unionByName(listed(nodes)).unionByName(listed(edges))


def write_graph_json(w: Whole, workspace: str, snapshot_id: int, totals_row, path: str) -> None:
    """Writes the document from the executors, of any size: files in order, which one after the other are one JSON text."""
    document_lines(w, workspace, snapshot_id, totals_row).orderBy("at").select("line").write.mode("overwrite").text(path)


def graph_json(w: Whole, workspace: str, snapshot_id: int, totals_row) -> dict:
    """The document of a graph that its caller wants in memory; others write_graph_json()."""
    return json.loads("\n".join(r["line"] for r in document_lines(w, workspace, snapshot_id, totals_row).orderBy("at").select("line").toLocalIterator()))
