"""One-hop intents: edges of some kinds at a set of names, shown from one end.

All of them are one table of specifications and one plan: scan the edge kinds asked for, keep the
edges whose matched end is in the (broadcast, bounded) set of resolved names, project, and take the
first `limit` rows of a total order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.plans.graph import Graph, ilike, resolved

LIMIT = 200
ORDER = ("canonical_name", "caller", "callee", "edge_kind")


@dataclass(frozen=True)
class Hop:
    """kinds of edges; `match` is the end looked up and `item` the end shown, whose place is at `place`."""

    kinds: tuple[str, ...]
    match: str  # src or dst
    item: str
    place: str = ""
    extra: dict[str, str] = field(default_factory=dict)  # column: SQL over the edge's columns
    only: str = ""  # a further condition


CALLS = ("calls", "runtime_calls")

HOPS: dict[str, Hop] = {
    "who_calls_api": Hop(CALLS, "dst", "src"),
    "what_api_calls": Hop(CALLS, "src", "dst"),
    "find_api_logs": Hop(("logs_event",), "src", "dst", "src", {"log_level": "coalesce(log_level, 'UNKNOWN')", "template": "coalesce(template, dst)", "subsystem": "subsystem"}, "dst_kind = 'log_point'"),
    "find_api_timer_triggers": Hop(CALLS, "dst", "src", "src", {"timer_condition": "timer_condition"}, "src_kind = 'timer'"),
    "show_registration_chain": Hop(("registers_callback",), "dst", "src", "src", {"registrar": "src", "callback": "dst", "registration_api": "coalesce(registration_api, src)"}),
    "show_dispatch_sites": Hop(("dispatches_to",), "dst", "src", "src", {"dispatch_file": "coalesce(src_file, site_file, '')", "dispatch_line": "coalesce(src_line, site_line)"}),
    "find_struct_writers": Hop(("writes_field",), "dst", "src", "src", {"writer": "src"}),
    "find_struct_readers": Hop(("reads_field",), "dst", "src", "src", {"reader": "src"}),
    "find_struct_owners": Hop(("owns",), "dst", "src", "src", {"owner": "src"}),
    "find_api_struct_writes": Hop(("writes_field",), "src", "dst", "src"),
    "find_api_struct_reads": Hop(("reads_field",), "src", "dst", "src"),
    "find_module_imports": Hop(("imports",), "src", "dst"),
    "find_module_dependents": Hop(("imports",), "dst", "src"),
    "find_module_symbols": Hop(("contains",), "src", "dst"),
    "find_class_inheritance": Hop(("extends",), "src", "dst"),
    "find_class_subtypes": Hop(("extends",), "dst", "src"),
    "find_interface_implementors": Hop(("implements",), "dst", "src"),
    "find_type_dependencies": Hop(("references_type",), "src", "dst"),
    "find_type_consumers": Hop(("references_type",), "dst", "src"),
    "find_field_type": Hop(("field_of_type",), "src", "dst"),
    "find_type_aggregates": Hop(("aggregates",), "src", "dst"),
    "find_type_aggregators": Hop(("aggregates",), "dst", "src"),
    "find_type_fields": Hop(("contains",), "src", "dst", only="dst_kind IN ('field', 'enum_variant')"),
}
#: Intents that are others under a second name.
ALIASES = {
    "find_callback_registrars": "show_registration_chain", "where_struct_modified": "find_struct_writers", "where_struct_initialized": "find_struct_readers",
    "find_api_field_writes": "find_api_struct_writes", "find_api_field_reads": "find_api_struct_reads", "find_field_writers": "find_struct_writers", "find_field_readers": "find_struct_readers",
}


def rows_of(edges: DataFrame, item: str, place: str = "", extra: dict[str, str | Column] | None = None) -> DataFrame:
    """The columns that all edge intents share, shown from one end."""
    at = place or item
    more = [(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in (extra or {}).items()]
    return edges.select(F.col(f"{item}_kind").alias("kind"), F.col(item).alias("canonical_name"), F.col("src").alias("caller"), F.col("dst").alias("callee"), "edge_kind", "confidence", "derivation", F.col(f"{at}_file").alias("file_path"), F.col(f"{at}_line").alias("line_number"), *more)


def first(rows: DataFrame, limit: int = LIMIT, order: tuple = ORDER) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def hop(g: Graph, intent: str, names: list[str], limit: int = LIMIT, log_level: str | None = None) -> DataFrame:
    s = HOPS[ALIASES.get(intent, intent)]
    edges = g.of(*s.kinds)
    if s.only:
        edges = edges.filter(s.only)
    if log_level is not None:
        edges = edges.filter(F.col("log_level") == log_level)
    at = resolved(g.nodes, names)
    edges = edges.join(at, edges[s.match] == at["name"], "left_semi")
    return first(rows_of(edges, s.item, s.place, s.extra), limit)


def runtime_callers(g: Graph, names: list[str], limit: int = LIMIT) -> DataFrame:
    """Observed invokers and runtime_calls edges; of equal (caller, callee) the observation with the least id wins."""
    at = resolved(g.nodes, names)
    o = g.observations.filter(F.col("kind") == "runtime_invocation")
    o = o.join(at, o["target_api"] == at["name"], "left_semi").select(
        F.lit("api").alias("kind"), F.coalesce("immediate_invoker", F.lit("unknown")).alias("caller"), F.col("target_api").alias("callee"), "runtime_trigger", "dispatch_chain", "confidence",
        F.lit("runtime").alias("derivation"), F.lit(0).alias("prio"), F.col("observation_id").alias("tie"),
    )
    e = g.of("runtime_calls")
    e = e.join(at, e["dst"] == at["name"], "left_semi").select(F.col("src_kind").alias("kind"), F.col("src").alias("caller"), F.col("dst").alias("callee"), F.lit(None).cast("string").alias("runtime_trigger"), F.lit(None).cast("string").alias("dispatch_chain"), "confidence", "derivation", F.lit(1).alias("prio"), F.col("edge_id").alias("tie"))
    both = o.unionByName(e)
    rest = [c for c in both.columns if c not in ("caller", "callee")]
    best = both.groupBy("caller", "callee").agg(F.min(F.struct("prio", "tie", *(c for c in rest if c not in ("prio", "tie")))).alias("b"))
    out = best.select("b.kind", F.col("caller").alias("canonical_name"), "caller", "callee", F.lit("runtime_calls").alias("edge_kind"), "b.confidence", "b.derivation", "b.runtime_trigger", "b.dispatch_chain")
    return first(out, limit)


def observations(g: Graph, names: list[str], limit: int = LIMIT, trace_id: str | None = None) -> DataFrame:
    """Runtime invocations of the names."""
    at = resolved(g.nodes, names)
    o = g.observations.filter((F.col("kind") == "runtime_invocation") & F.col("target_api").isNotNull())
    if trace_id is not None:
        o = o.filter(F.col("observation_id") == trace_id)
    o = o.join(at, o["target_api"] == at["name"], "left_semi")
    out = o.select("kind", F.col("target_api").alias("canonical_name"), F.col("immediate_invoker").alias("caller"), F.col("target_api").alias("callee"), "observation_id", "runtime_trigger", "dispatch_chain", "confidence")
    return first(out, limit, ("canonical_name", "caller", "observation_id"))


def log_pattern(g: Graph, pattern: str, limit: int = LIMIT) -> DataFrame:
    """Log edges whose log point or template has the pattern, in which % and _ are wildcards."""
    like = f"%{pattern}%"
    e = g.of("logs_event").filter(ilike(F.col("dst"), like) | F.coalesce(ilike(F.col("template"), like), F.lit(False)))
    return first(rows_of(e, "src", "src", {"log_level": "coalesce(log_level, 'UNKNOWN')", "template": "coalesce(template, dst)"}), limit)


def field_access_path(g: Graph, struct_name: str | None, field_name: str | None, limit: int = LIMIT) -> DataFrame:
    """Accesses to fields whose name begins with the struct's and ends with the field's (LIKE patterns, any case)."""
    e = g.of("reads_field", "writes_field")
    if struct_name:
        e = e.filter(ilike(F.col("dst"), struct_name + "%"))
    if field_name:
        e = e.filter(ilike(F.col("dst"), "%" + field_name))
    return first(rows_of(e, "src", "src", {"access_path": "coalesce(access_path, dst)"}), limit)


def cross_module_path(g: Graph, src: str, dst: str, limit: int = LIMIT) -> DataFrame:
    """The direct edges of any kind from one name to another."""
    a, b = resolved(g.nodes, [src]), resolved(g.nodes, [dst])
    e = g.named
    e = e.join(a, e["src"] == a["name"], "left_semi")
    return first(rows_of(e.join(b, e["dst"] == b["name"], "left_semi"), "dst", "src"), limit)


def hot_call_paths(g: Graph, names: list[str], limit: int = LIMIT) -> DataFrame:
    """All edges that touch the names; without names all edges."""
    e = g.named
    if names:
        at = resolved(g.nodes, names)
        out = e.join(at, e["src"] == at["name"], "left_semi")
        e = out.unionByName(e.join(at, e["src"] == at["name"], "left_anti").join(at, F.col("dst") == at["name"], "left_semi"))
    return first(rows_of(e, "src"), limit)


def sibling_symbols(g: Graph, name: str, limit: int = LIMIT) -> DataFrame:
    """The other children of the symbol's first container."""
    at = resolved(g.nodes, [name])
    c = g.of("contains")
    parent = F.broadcast(c.join(at, c["dst"] == at["name"], "left_semi").agg(F.min("src").alias("parent")))
    e = c.join(parent, c["src"] == parent["parent"], "left_semi").join(at, c["dst"] == at["name"], "left_anti")
    return first(rows_of(e, "dst").distinct(), limit, (F.col("line_number").asc_nulls_first(), "canonical_name", "caller"))


def module_interactions(g: Graph, a: str, b: str, limit: int = LIMIT) -> DataFrame:
    """Calls and type references from one module (or its members) to another."""
    inside = lambda c, m: (F.col(c) == m) | F.startswith(F.lower(F.col(c)), F.lit(m.lower() + "#"))
    e = g.of("calls", "references_type").filter(inside("src", a) & inside("dst", b))
    return first(rows_of(e, "dst", "src", {"resolution_kind": "resolution_kind"}), limit, ("edge_kind", "caller", "callee"))
