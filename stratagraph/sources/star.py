"""A star schema (suppliers, parts, orders, events) as a property graph, so that every intent has data.

One ANSI text defines nodes, edges and observations; Spark and any other SQL engine can run it.
Nations are modules and suppliers their functions. Of all orders' lines it is counted which supplier
follows which: a supplier calls the CALLS that most often follow it, and a module imports the IMPORTS
modules that its own most often call. Brands are classes with parts as fields, which suppliers read
or write if any line says so; part types are interfaces; events are logs. All rows of all tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "supplier", "customer", "part", "lineitem", "events")

#: How many others a supplier calls and a module imports: those that most often follow.
CALLS, IMPORTS = 4, 2

CTES = """
module_of AS (SELECT n_nationkey, 'module:' || r_name || '/' || n_name AS module, r_name || '/' || n_name AS path FROM {nation} JOIN {region} ON n_regionkey = r_regionkey),
sup AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal, module, path, module || '#S' || CAST(s_suppkey AS STRING_) AS name FROM {supplier} JOIN module_of ON s_nationkey = n_nationkey),
prt AS (SELECT p_partkey, 'module:parts/catalog#' || replace(p_brand, '#', '_') AS class, 'module:parts/catalog#' || replace(p_brand, '#', '_') || '.P' || CAST(p_partkey AS STRING_) AS name,
  'module:parts/catalog#' || replace(p_type, ' ', '_') AS type, p_size FROM {part}),
cls AS (SELECT class, count(*) AS parts, row_number() OVER (ORDER BY class) - 1 AS i FROM prt GROUP BY class),
usr AS (SELECT 'module:users/log#U' || CAST(user_id % 50 AS STRING_) AS name, event_type, event_id, user_id % 50 AS u, ts FROM {events}),
hop AS (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS b FROM {lineitem}),
follows AS (SELECT a, b, count(*) AS n FROM hop WHERE b IS NOT NULL GROUP BY a, b),
call AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM follows) t WHERE r <= {CALLS}),
near AS (SELECT x.module AS a, y.module AS b, sum(n) AS n FROM follows JOIN sup x ON a = x.s_suppkey JOIN sup y ON b = y.s_suppkey WHERE x.module <> y.module GROUP BY x.module, y.module),
import AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM near) t WHERE r <= {IMPORTS}),
acc AS (SELECT DISTINCT l_suppkey, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'writes_field' ELSE 'reads_field' END AS edge_kind FROM {lineitem}),
attr AS (SELECT DISTINCT class, class || '.size_' || CAST(CAST(floor(p_size / 10) AS INT) AS STRING_) AS name FROM prt),
raw_nodes AS (
  SELECT module AS name, 'module' AS kind, path AS file_path, 1 AS line, CAST(NULL AS BIGINT) AS end_line, (SELECT count(*) FROM sup s WHERE s.module = m.module) AS line_count, CAST(NULL AS BOOLEAN) AS exported, CAST(NULL AS STRING_) AS doc, CAST(NULL AS STRING_) AS owning_class FROM module_of m
  UNION ALL SELECT 'module:parts/catalog', 'module', 'parts/catalog', 1, NULL, (SELECT count(*) FROM prt), NULL, NULL, NULL
  UNION ALL SELECT 'module:users/log', 'module', 'users/log', 1, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT name, 'function', path, s_suppkey + 1, s_suppkey + 10 + s_suppkey % 90, 10 + s_suppkey % 90, s_suppkey % 2 = 0, CASE WHEN s_suppkey % 3 = 0 THEN s_name END, NULL FROM sup
  UNION ALL SELECT class, 'class', 'parts/catalog', i + 2, i + 2 + parts, parts, true, CASE WHEN i % 2 = 0 THEN 'Parts of ' || class END, NULL FROM cls
  UNION ALL SELECT name, 'field', 'parts/catalog', p_partkey % 1000 + 30, NULL, NULL, NULL, NULL, class FROM prt
  UNION ALL SELECT name, 'field', 'parts/catalog', NULL, NULL, NULL, NULL, NULL, class FROM attr
  UNION ALL SELECT 'module:users/log#Log', 'class', 'users/log', 1, 60, 60, true, NULL, NULL
  UNION ALL SELECT DISTINCT type, 'interface', 'parts/catalog', 1, NULL, NULL, true, CAST(NULL AS STRING_), CAST(NULL AS STRING_) FROM prt
  UNION ALL SELECT DISTINCT name, 'method', 'users/log', u + 1, NULL, NULL, false, CAST(NULL AS STRING_), CAST(NULL AS STRING_) FROM usr
  UNION ALL SELECT DISTINCT 'log:' || event_type, 'log_point', CAST(NULL AS STRING_), NULL, NULL, NULL, NULL, CAST(NULL AS STRING_), CAST(NULL AS STRING_) FROM usr
  UNION ALL SELECT 'timer:nightly', 'timer', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
fot AS (SELECT name, type, class FROM prt),
raw_edges AS (
  SELECT 'contains' AS edge_kind, module AS src, name AS dst, 1.0 AS confidence, 'clangd' AS derivation, CAST(NULL AS STRING_) AS log_level, CAST(NULL AS STRING_) AS template, CAST(NULL AS STRING_) AS subsystem, CAST(NULL AS STRING_) AS registration_api, CAST(NULL AS STRING_) AS site_file, CAST(NULL AS BIGINT) AS site_line, CAST(NULL AS STRING_) AS access_path, CAST(NULL AS STRING_) AS timer_condition, CAST(NULL AS STRING_) AS resolution_kind FROM sup
  UNION ALL SELECT 'contains', 'module:parts/catalog', class, 1.0, 'clangd', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM cls
  UNION ALL SELECT 'contains', class, name, 1.0, 'clangd', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM prt
  UNION ALL SELECT 'contains', class, name, 1.0, 'clangd', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM attr
  UNION ALL SELECT 'contains', 'module:users/log', 'module:users/log#Log', 1.0, 'clangd', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT DISTINCT 'contains', 'module:users/log#Log', name, 1.0, 'clangd', NULL, NULL, NULL, NULL, NULL, CAST(NULL AS BIGINT), NULL, NULL, NULL FROM usr
  UNION ALL SELECT 'owns', min(s.name), p.class, 0.9, 'clangd', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM acc JOIN sup s ON l_suppkey = s_suppkey JOIN prt p ON l_partkey = p_partkey WHERE edge_kind = 'writes_field' GROUP BY p.class
  UNION ALL SELECT DISTINCT 'contains', 'module:parts/catalog', type, 1.0, 'clangd', NULL, NULL, NULL, NULL, NULL, CAST(NULL AS BIGINT), NULL, NULL, NULL FROM prt
  UNION ALL SELECT DISTINCT 'contains', 'module:users/log', name, 1.0, 'clangd', NULL, NULL, NULL, NULL, NULL, CAST(NULL AS BIGINT), NULL, NULL, NULL FROM usr
  UNION ALL SELECT DISTINCT 'calls', x.name, y.name, 0.95, 'clangd', NULL, NULL, NULL, NULL, NULL, CAST(NULL AS BIGINT), NULL, NULL, CASE WHEN x.module = y.module THEN 'local' ELSE 'named-import' END FROM call JOIN sup x ON a = x.s_suppkey JOIN sup y ON b = y.s_suppkey
  UNION ALL SELECT edge_kind, s.name, p.name, 0.9, 'clangd', NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN s_suppkey % 2 = 0 THEN 'self.' || p.name END, NULL, NULL FROM acc JOIN sup s ON l_suppkey = s_suppkey JOIN prt p ON l_partkey = p_partkey
  UNION ALL SELECT 'imports', a, b, 1.0, 'clangd', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM import
  UNION ALL SELECT DISTINCT 'imports', module, 'module:ext_' || c_mktsegment, 1.0, 'clangd', NULL, NULL, NULL, NULL, NULL, CAST(NULL AS BIGINT), NULL, NULL, NULL FROM {customer} JOIN module_of ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'references_type', s.name, p.class, 0.9, 'clangd', NULL, NULL, NULL, NULL, NULL, CAST(NULL AS BIGINT), NULL, NULL, NULL FROM acc JOIN sup s ON l_suppkey = s_suppkey JOIN prt p ON l_partkey = p_partkey WHERE edge_kind = 'writes_field'
  UNION ALL SELECT 'references_type', x.class, y.class, 0.9, 'clangd', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM cls x JOIN cls y ON y.i = 24 - x.i AND x.i <> y.i
  UNION ALL SELECT 'extends', x.class, y.class, 1.0, 'clangd', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM cls x JOIN cls y ON y.i = x.i % 5 WHERE x.i >= 5
  UNION ALL SELECT DISTINCT 'implements', class, type, 1.0, 'clangd', NULL, NULL, NULL, NULL, NULL, CAST(NULL AS BIGINT), NULL, NULL, NULL FROM prt WHERE p_size >= 45
  UNION ALL SELECT 'field_of_type', name, type, 0.95, 'clangd', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM fot
  UNION ALL SELECT DISTINCT 'aggregates', class, type, 0.95, 'clangd', NULL, NULL, NULL, NULL, NULL, CAST(NULL AS BIGINT), NULL, NULL, NULL FROM fot
  UNION ALL SELECT 'aggregates', type, min(class), 0.95, 'clangd', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM fot GROUP BY type
  UNION ALL SELECT DISTINCT 'logs_event', name, 'log:' || event_type, 0.9, 'clangd', CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'purchase' THEN 'DEBUG' ELSE 'INFO' END, CASE WHEN u % 2 = 0 THEN 'user did ' || event_type END, 'EVENTS', NULL, NULL, CAST(NULL AS BIGINT), NULL, NULL, NULL FROM usr
  UNION ALL SELECT 'registers_callback', x.name, y.name, 0.9, 'clangd', NULL, NULL, NULL, CASE WHEN x.s_acctbal >= 8000 THEN 'register_hook' END, NULL, NULL, NULL, NULL, NULL FROM sup x JOIN sup y ON y.s_suppkey = x.s_suppkey + 1 WHERE x.s_acctbal >= 5000
  UNION ALL SELECT 'dispatches_to', x.name, y.name, 0.9, 'hybrid', NULL, NULL, NULL, NULL, 'hw/dispatch.c', x.s_suppkey, NULL, NULL, NULL FROM sup x JOIN sup y ON y.s_suppkey = x.s_suppkey + 6 WHERE x.s_acctbal < 2000
  UNION ALL SELECT 'runtime_calls', 'timer:nightly', name, 0.8, 'runtime', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'every ' || CAST(s_suppkey AS STRING_) || ' s', NULL FROM sup WHERE s_acctbal BETWEEN 2000 AND 5000),
raw_observations AS (
  SELECT 'obs:' || CAST(event_id AS STRING_) AS observation_id, 'runtime_invocation' AS kind, s.name AS target_api, CASE WHEN u % 3 = 0 THEN 'timer:nightly' ELSE usr.name END AS immediate_invoker, CASE WHEN u % 3 = 0 THEN 'timer' ELSE 'event' END AS runtime_trigger, usr.name || ' -> dispatch -> ' || s.name AS dispatch_chain, 0.7 AS confidence
  FROM usr JOIN sup s ON s.s_suppkey = u WHERE event_type = 'purchase')
"""

NODE_COLUMNS = "'graph_node:1:symbol:' || name AS node_id, name AS canonical_name, kind, file_path, CAST(line AS BIGINT) AS line, CAST(end_line AS BIGINT) AS end_line, CAST(line_count AS BIGINT) AS line_count, exported, doc, owning_class"
EDGE_COLUMNS = "'graph_edge:1:' || edge_kind || ':' || src || ':' || dst AS edge_id, edge_kind, 'graph_node:1:symbol:' || src AS src_node_id, 'graph_node:1:symbol:' || dst AS dst_node_id, CAST(confidence AS DOUBLE) AS confidence, derivation, log_level, template, subsystem, registration_api, site_file, CAST(site_line AS BIGINT) AS site_line, access_path, timer_condition, resolution_kind"
OBSERVATION_COLUMNS = "observation_id, 'graph_node:1:symbol:' || target_api AS node_id, kind, target_api, immediate_invoker, runtime_trigger, dispatch_chain, CAST(confidence AS DOUBLE) AS confidence"


def _filled(string: str) -> str:
    return CTES.replace("STRING_", string).replace("{CALLS}", str(CALLS)).replace("{IMPORTS}", str(IMPORTS))


def duckdb_ctes() -> str:
    """WITH clauses that define nodes, edges (with the ends' names, kinds and places) and observations."""
    text = _filled("VARCHAR")
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    ends = ", ".join(f"{e}.canonical_name AS {e}, {e}.kind AS {e}_kind, {e}.file_path AS {e}_file, {e}.line AS {e}_line" for e in ("src", "dst"))
    return f"""WITH RECURSIVE {text},
nodes AS MATERIALIZED (SELECT {NODE_COLUMNS} FROM raw_nodes),
edges AS MATERIALIZED (SELECT e.*, {ends} FROM (SELECT {EDGE_COLUMNS} FROM raw_edges) e LEFT JOIN nodes src ON e.src_node_id = src.node_id LEFT JOIN nodes dst ON e.dst_node_id = dst.node_id),
ne AS (SELECT * FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
observations AS (SELECT {OBSERVATION_COLUMNS} FROM raw_observations)
"""


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """nodes, edges and observations of the star schema in a folder, without a snapshot id."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    text = _filled("STRING")
    pick = lambda columns, name: spark.sql(f"WITH {text} SELECT {columns} FROM {name}", **frames)
    return {"nodes": pick(NODE_COLUMNS, "raw_nodes"), "edges": pick(EDGE_COLUMNS, "raw_edges"), "observations": pick(OBSERVATION_COLUMNS, "raw_observations")}
