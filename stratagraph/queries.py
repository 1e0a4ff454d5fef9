"""All queries of the graph engine over the star graph, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.operators import ingest, symbols, whole
from stratagraph.plans import oracle
from stratagraph.plans.catalog import CATALOG, Request, build
from stratagraph.plans.graph import star_graph
from stratagraph import row_queries
from stratagraph.sources.star import duckdb_ctes
from stratagraph.streaming.incremental import event_counts

CATALOG_MODULE, LOG_MODULE = "module:parts/catalog", "module:users/log"
BRAND = "Brand_11"
_MANY = [f"S{i}" for i in range(1, 31)]

#: What each intent is asked with; those not listed need nothing.
REQUESTS: dict[str, dict] = {
    **dict.fromkeys(("who_calls_api", "what_api_calls", "find_api_struct_writes", "find_api_struct_reads", "find_api_field_writes", "find_api_field_reads", "find_type_dependencies"), {"names": ["S7", "S48"]}),
    "find_api_timer_triggers": {"names": _MANY},
    **dict.fromkeys(("who_calls_api_at_runtime", "why_api_invoked", "show_api_runtime_observations", "show_runtime_flow_for_trace"), {"names": ["S1", "S6", "S7"]}),
    **dict.fromkeys(("find_api_logs", "find_api_logs_by_level"), {"names": ["U1", "U2"], "log_level": "ERROR"}),
    **dict.fromkeys(("show_registration_chain", "find_callback_registrars"), {"names": _MANY}),
    "show_dispatch_sites": {"names": _MANY},
    **dict.fromkeys(("find_struct_writers", "find_struct_readers", "where_struct_modified", "where_struct_initialized"), {"struct_name": BRAND + ".P12"}),
    "find_struct_owners": {"struct_name": BRAND}, "find_class_inheritance": {"names": ["Brand_25"]},
    **dict.fromkeys(("find_field_writers", "find_field_readers", "find_field_type"), {"names": ["Brand_25.P4", "Brand_3.P8", "Brand_11.P12", "Brand_8.P16", "Brand_25.P100"]}),
    "find_field_access_path": {"struct_name": "module:parts/catalog#brand_1", "field_name": "7"},
    **dict.fromkeys(("find_module_imports", "find_module_dependents", "find_transitive_dependencies"), {"names": ["module:ASIA/NATION_7"]}), "find_import_cycles_deep": {"names": ["module:MIDDLE EAST/NATION_9"]},
    **dict.fromkeys(("find_module_symbols", "find_module_top_exports", "find_module_summary"), {"names": [CATALOG_MODULE]}),
    **dict.fromkeys(("find_class_subtypes", "find_type_aggregates", "find_type_consumers", "find_type_fields", "find_symbol_degree", "find_sibling_symbols"), {"names": [BRAND]}),
    **dict.fromkeys(("find_interface_implementors", "find_type_aggregators"), {"names": ["ECONOMY", "PROMO"]}),
    "find_api_by_log_pattern": {"pattern": "user did p_rch"},
    "show_cross_module_path": {"src": "timer:nightly", "dst": "S11"},
    "show_hot_call_paths": {"names": ["S7"]},
    "find_module_interactions": {"src": "module:ASIA/NATION_7", "dst": CATALOG_MODULE},
    "find_symbols_by_name": {"pattern": "nation_1#s"}, "find_symbols_by_kind": {"pattern": "class"}, "find_symbols_by_doc": {"pattern": "parts OF"},
    "find_symbols_in_file": {"file_path": "NATION_7"}, "find_symbol_at_location": {"file_path": "ASIA/NATION_7", "line_number": 80},
    "find_long_functions": {"depth": 60},
    "find_call_chain": {"src": "S7", "dst": "S48"}, "find_data_path": {"src": "Brand_12", "dst": "Brand_1", "depth": 4},
    "find_deepest_call_chain": {"names": ["S7"], "depth": 5}, "find_api_data_footprint": {"names": ["S7"], "depth": 3},
}


def request(intent: str) -> Request:
    return Request(intent, **REQUESTS.get(intent, {}))


def _query(intent: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(star_graph(spark, sf_dir), request(intent))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {intent: _query(intent) for intent in CATALOG}
ORACLE: dict[str, str] = {intent: oracle.sql(request(intent)) for intent in CATALOG}


# Whole-graph operators, the dashboard's aggregates and streaming aggregates run as batches.


def _whole(make) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(whole.export(star_graph(spark, sf_dir)))


def _thinned(w: whole.Whole) -> whole.Whole:
    """The other side of a comparison: without calls from exported suppliers, and without fields of one brand."""
    return whole.Whole(w.nodes.filter(~F.col("id").startswith(f"{CATALOG_MODULE}#Brand_7.")), w.edges.filter(~((F.col("kind") == "calls") & F.col("src").endswith("7"))))


_CENTER = "S7"
QUERIES |= {
    "graph_nodes": _whole(lambda w: w.nodes),
    "graph_edges": _whole(lambda w: w.edges),
    "graph_symbol_kinds": _whole(lambda w: whole.of_kinds(w, ["class", "field", "interface"]).edges),
    "graph_edge_kinds": _whole(lambda w: whole.of_kinds(w, None, ["calls", "imports"]).edges),
    "graph_center": _whole(lambda w: whole.center_subgraph(whole.of_kinds(w, None, ["calls"]), _CENTER, 2, "out").nodes.select("id", "kind")),
    "graph_center_both": _whole(lambda w: whole.center_subgraph(whole.of_kinds(w, None, ["calls"]), _CENTER, 1, "both").edges),
    "graph_data_path": _whole(lambda w: whole.data_path_subgraph(w, "Brand_12", "Brand_1", 4).edges),
    "graph_top_degree": _whole(lambda w: whole.top_by_degree(w, 40).nodes.select("id", "kind")),
    "graph_diff": _whole(lambda w: whole.diff(w, _thinned(w)).filter("change != 'common'")),
    "graph_diff_counts": _whole(lambda w: whole.diff_counts(whole.diff(w, _thinned(w)))),
    "dashboard_totals": lambda spark, sf_dir: whole.totals(star_graph(spark, sf_dir)),
    "dashboard_edge_kinds": lambda spark, sf_dir: whole.edge_kinds(star_graph(spark, sf_dir)),
    "dashboard_resolution_kinds": lambda spark, sf_dir: whole.resolution_kinds(star_graph(spark, sf_dir)),
    "event_windows": lambda spark, sf_dir: event_counts(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", F.col("value").cast("double").alias("value"))).select("window_start", "event_type", "n", F.round("total", 4).alias("total")),
    "symbols_at_locations": lambda spark, sf_dir: _located(star_graph(spark, sf_dir)),
    "enclosing_functions": lambda spark, sf_dir: _enclosed(star_graph(spark, sf_dir)),
    "roll_up_aggregates": lambda spark, sf_dir: _rolled(star_graph(spark, sf_dir)),
}


def _located(g) -> DataFrame:
    probes = g.nodes.filter("kind = 'function'").select(F.col("canonical_name").alias("probe_id"), "file_path", (F.col("line") + 3).alias("line"))
    return symbols.at_locations(g, probes)


def _enclosed(g) -> DataFrame:
    sites = g.nodes.filter("kind IN ('function', 'field')").select(F.col("canonical_name").alias("site_id"), "file_path", (F.col("line") + 7).alias("line"))
    return ingest.enclosing_function(sites, g.nodes.filter("kind = 'function'"))


def _rolled(g) -> DataFrame:
    return ingest.roll_up_aggregates(g.of("contains").select("src", "dst"), g.of("field_of_type").select("src", "dst"))


_WITH = duckdb_ctes()
_EDGES = "SELECT src, dst, edge_kind AS kind, resolution_kind FROM ne"
_NODE_LIST = "canonical_name AS id, kind, file_path, line, end_line, line_count, exported, doc, owning_class"
_S7 = f"(SELECT min(canonical_name) FROM nodes WHERE ends_with(canonical_name, '#{_CENTER}'))"
_DIFF = f""", n2 AS (SELECT canonical_name AS id FROM nodes WHERE NOT starts_with(canonical_name, '{CATALOG_MODULE}#Brand_7.')),
e1 AS MATERIALIZED (SELECT DISTINCT src, dst, edge_kind AS kind FROM ne), e2 AS MATERIALIZED (SELECT DISTINCT src, dst, edge_kind AS kind FROM ne WHERE NOT (edge_kind = 'calls' AND ends_with(src, '7'))),
d AS (SELECT 'node' AS item, 'removed' AS change, canonical_name AS src, '' AS dst, '' AS kind FROM nodes WHERE starts_with(canonical_name, '{CATALOG_MODULE}#Brand_7.')
  UNION ALL SELECT 'node', 'common', id, '', '' FROM n2
  UNION ALL SELECT 'edge', 'removed', * FROM (SELECT * FROM e1 EXCEPT SELECT * FROM e2)
  UNION ALL SELECT 'edge', 'common', * FROM e2)
"""
ORACLE |= {
    "graph_nodes": _WITH + f"SELECT {_NODE_LIST} FROM nodes",
    "graph_edges": _WITH + _EDGES,
    "graph_symbol_kinds": _WITH + _EDGES + " WHERE src_kind IN ('class', 'field', 'interface') AND dst_kind IN ('class', 'field', 'interface')",
    "graph_edge_kinds": _WITH + _EDGES + " WHERE edge_kind IN ('calls', 'imports')",
    "graph_center": _WITH + f", reach AS (SELECT {_S7} AS id, 0 AS d UNION SELECT dst, d + 1 FROM reach JOIN ne ON src = id AND edge_kind = 'calls' WHERE d < 2) SELECT canonical_name AS id, kind FROM nodes WHERE canonical_name IN (SELECT id FROM reach)",
    "graph_center_both": _WITH + f", around AS (SELECT {_S7} AS id UNION SELECT dst FROM ne WHERE edge_kind = 'calls' AND src = {_S7} UNION SELECT src FROM ne WHERE edge_kind = 'calls' AND dst = {_S7}) {_EDGES} WHERE edge_kind = 'calls' AND src IN (SELECT id FROM around) AND dst IN (SELECT id FROM around)",
    "graph_data_path": _WITH + f""", steps AS (SELECT DISTINCT src, dst, edge_kind, resolution_kind FROM ne WHERE edge_kind IN ('field_of_type', 'aggregates')),
walk AS (SELECT ['{CATALOG_MODULE}#Brand_12'] AS path UNION ALL SELECT list_append(path, dst) FROM walk JOIN steps ON path[-1] = src WHERE len(path) <= 4 AND NOT list_contains(path, dst)),
hit AS (SELECT path FROM walk WHERE path[-1] = '{CATALOG_MODULE}#Brand_1'), best AS (SELECT path FROM hit WHERE len(path) = (SELECT min(len(path)) FROM hit)),
pairs AS (SELECT DISTINCT path[i] AS a, path[i + 1] AS b FROM best, (SELECT unnest(range(1, 6)) AS i) WHERE i < len(path))
SELECT src, dst, edge_kind AS kind, resolution_kind FROM steps JOIN pairs ON src = a AND dst = b""",
    "graph_top_degree": _WITH + "SELECT id, kind FROM (SELECT canonical_name AS id, n.kind, (SELECT count(*) FROM ne WHERE src = canonical_name) + (SELECT count(*) FROM ne WHERE dst = canonical_name) AS d FROM nodes n ORDER BY d DESC, id LIMIT 40)",
    "graph_diff": _WITH + _DIFF + "SELECT * FROM d WHERE change <> 'common'",
    "graph_diff_counts": _WITH + _DIFF + "SELECT item, change, count(*)::BIGINT AS n FROM d GROUP BY ALL",
    "dashboard_totals": _WITH + "SELECT (SELECT count(*) FROM nodes)::BIGINT AS total_nodes, (SELECT count(*) FROM edges)::BIGINT AS total_edges",
    "dashboard_edge_kinds": _WITH + "SELECT edge_kind, count(*)::BIGINT AS n FROM edges GROUP BY ALL",
    "dashboard_resolution_kinds": _WITH + "SELECT resolution_kind, count(*)::BIGINT AS n FROM edges WHERE edge_kind = 'calls' AND resolution_kind IS NOT NULL GROUP BY ALL",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "symbols_at_locations": _WITH + """SELECT probe_id, canonical_name FROM (SELECT p.canonical_name AS probe_id, n.canonical_name, row_number() OVER (PARTITION BY p.canonical_name ORDER BY n.kind = 'module', coalesce(n.end_line, n.line) - n.line, n.line DESC, n.canonical_name) AS rn
FROM nodes p JOIN nodes n ON n.file_path = p.file_path AND p.line + 3 BETWEEN n.line AND coalesce(n.end_line, n.line) WHERE p.kind = 'function') WHERE rn = 1""",
    "enclosing_functions": _WITH + """SELECT s.canonical_name AS site_id, coalesce(arg_min(f.canonical_name, struct_pack(a := f.line, b := f.canonical_name)), '(file-scope)') AS function
FROM nodes s LEFT JOIN nodes f ON f.kind = 'function' AND f.file_path = s.file_path AND s.line + 7 BETWEEN f.line AND f.line + 500 WHERE s.kind IN ('function', 'field') GROUP BY s.canonical_name""",
    "roll_up_aggregates": _WITH + "SELECT DISTINCT c.src, f.dst, 'aggregates' AS edge_kind, 0.95::DOUBLE AS confidence FROM ne c JOIN ne f ON f.edge_kind = 'field_of_type' AND c.dst = f.src WHERE c.edge_kind = 'contains'",
}

QUERIES |= row_queries.QUERIES
ORACLE |= row_queries.ORACLE
