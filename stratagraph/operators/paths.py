"""Traversals by frontiers: each hop joins the frontier with the edges and drops what was reached before.

Breadth-first intents keep a node once, at its least depth, with the least path there; so a frontier
is never larger than the node set. Intents that ask for simple paths enumerate them, which may be
exponential: they stop with an error beyond `max_paths` instead of cutting the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators.hops import LIMIT
from stratagraph.plans.graph import Graph, first_resolved
from stratagraph.sources.tables import held

MAX_PATHS = 1_000_000


class TooManyPaths(RuntimeError):
    """A simple-path query has more paths than asked to hold."""


def clamp(depth: int | None, default: int, low: int, high: int) -> int:
    return min(max(depth or default, low), high)


def name_edges(g: Graph, *kinds: str) -> DataFrame:
    """Distinct edges between names, written once; each hop reads them."""
    return held(g.of(*kinds).select("src", "dst").distinct())


def shortest_path(g: Graph, src: str, dst: str, kinds: tuple[str, ...], depth: int, label: str, kind: str | None = None) -> DataFrame:
    """The hops of the shortest path, of equal ones that with the least names: path_index, caller, callee, chain_depth."""
    edges = name_edges(g, *kinds)
    target = first_resolved(g.nodes, dst).first()["name"]
    frontier = first_resolved(g.nodes, src).select("name", F.array("name").alias("path"))
    seen = held(frontier.select("name"))
    frontier, hit = held(frontier), None
    for _ in range(depth):
        step = frontier.join(edges, frontier["name"] == edges["src"]).groupBy("dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path")).select(F.col("dst").alias("name"), "path")
        frontier = held(step.join(seen, "name", "left_anti"))
        found = frontier.filter(F.col("name") == target)
        if not found.isEmpty():
            hit = found
            break
        if frontier.isEmpty():
            break
        seen = held(seen.unionByName(frontier.select("name")))
    if hit is None:
        hit = frontier.filter(F.lit(False))
    hops = hit.select(F.size("path").alias("n"), "path", F.posexplode("path").alias("i", "caller")).filter("i < n - 1")
    return hops.select(
        F.lit(kind or "function").alias("kind"), "caller", F.expr("path[i + 1]").alias("callee"), F.expr("path[i + 1]").alias("canonical_name"), F.lit(label).alias("edge_kind"),
        F.col("i").cast("long").alias("path_index"), (F.col("n") - 1).cast("long").alias("chain_depth"),
    ).orderBy("path_index")


def transitive(g: Graph, root: str, kinds: tuple[str, ...], depth: int, limit: int = LIMIT) -> DataFrame:
    """Everything reachable from the root, without it, with its least depth."""
    edges = name_edges(g, *kinds)
    frontier = held(first_resolved(g.nodes, root).select("name", F.lit(0).alias("depth")))
    seen = frontier
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["name"] == edges["src"]).select(F.col("dst").alias("name")).distinct().join(seen, "name", "left_anti")
        frontier = held(step.withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = held(seen.unionByName(frontier))
    return seen.filter("depth > 0").select(F.lit("module").alias("kind"), F.col("name").alias("canonical_name"), F.col("depth").cast("long").alias("depth")).orderBy("depth", "canonical_name").limit(limit)


def simple_paths(g: Graph, root: str, kinds: tuple[str, ...], depth: int, max_paths: int = MAX_PATHS, closing: bool = False) -> DataFrame:
    """All simple paths from the root of up to `depth` hops (path); with `closing` those that then return to it."""
    edges = name_edges(g, *kinds)
    frontier = held(first_resolved(g.nodes, root).select(F.array("name").alias("path")))
    out, total = [frontier], 1
    closed = []
    for d in range(depth):
        step = frontier.join(edges, F.element_at("path", -1) == edges["src"])
        if closing and d:
            closed.append(step.filter(F.col("dst") == F.col("path")[0]).select(F.concat("path", F.array("dst")).alias("path")))
        frontier = held(step.filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        n = frontier.count()
        total += n
        if total > max_paths:
            raise TooManyPaths(f"more than {max_paths} simple paths of {d + 1} hops; ask for less depth")
        if not n:
            break
        out.append(frontier)
    parts = closed if closing else out
    if not parts:
        return frontier.filter(F.lit(False))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


ARROW = " -> "


def deepest_chain(g: Graph, root: str, depth: int, kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
    """The longest simple path from the root, of equal ones the first in order."""
    p = simple_paths(g, root, kinds, depth).select(F.array_join("path", ARROW).alias("path"), (F.size("path") - 1).cast("long").alias("depth")).filter("depth > 0")
    return p.orderBy(F.col("depth").desc(), "path").limit(1).select(F.lit("function").alias("kind"), F.substring_index("path", ARROW, 1).alias("canonical_name"), "path", "depth")


def cycles_through(g: Graph, root: str, depth: int, limit: int = LIMIT, min_len: int = 2, kinds: tuple[str, ...] = ("imports",)) -> DataFrame:
    """Cycles from the root back to it; of those with the same members the first in order."""
    p = simple_paths(g, root, kinds, depth, closing=True)
    p = p.withColumn("length", (F.size("path") - 1).cast("long")).filter(F.col("length") >= min_len).withColumn("members", F.array_join(F.array_sort(F.array_distinct("path")), "|"))
    best = p.groupBy("members").agg(F.min(F.struct("length", F.array_join("path", ARROW).alias("path"))).alias("b"))
    return best.select(F.lit("module").alias("kind"), F.col("b.path").alias("canonical_name"), F.col("b.path").alias("cycle_path"), F.col("b.length").alias("cycle_length")).orderBy("cycle_length", "cycle_path").limit(limit)


def data_footprint(g: Graph, root: str, depth: int, limit: int = LIMIT, mode: str = "simple") -> DataFrame:
    """Fields that the root and what it calls read or write, by hop distance.

    simple: a function stands at every length of a simple path to it. min_hop: only at its least, by breadth-first search.
    """
    if mode == "min_hop":
        reach = transitive(g, root, ("calls",), depth, 1 << 30).select(F.col("canonical_name").alias("api"), F.col("depth").alias("hop_distance"))
        reach = reach.unionByName(first_resolved(g.nodes, root).select(F.col("name").alias("api"), F.lit(0).cast("long").alias("hop_distance")))
    else:
        reach = simple_paths(g, root, ("calls",), depth).select(F.element_at("path", -1).alias("api"), (F.size("path") - 1).cast("long").alias("hop_distance")).distinct()
    e = g.of("reads_field", "writes_field")
    out = reach.join(e, reach["api"] == e["src"]).select(F.col("dst_kind").alias("kind"), F.col("dst").alias("canonical_name"), F.col("src").alias("caller"), F.col("dst").alias("callee"), "edge_kind", "hop_distance").distinct()
    return out.orderBy("hop_distance", "edge_kind", "callee", "caller").limit(limit)
