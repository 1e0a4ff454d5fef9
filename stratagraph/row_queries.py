"""Ingest, response and reconciliation operators as queries over tables derived from the star schema, with their DuckDB forms.

The inputs are one portable text over whole tables, which Spark and DuckDB both run: facts of several
producers about suppliers and order lines, some of them broken; runtime rows of orders; and entities
with the relations that are expected of them beside those that answers give.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.extract.producers import RUST, TYPESCRIPT, C
from stratagraph.operators import cache, hops, ingest, reconcile, respond
from stratagraph.plans.catalog import CATALOG
from stratagraph.plans.graph import star_graph
from stratagraph.sources.star import duckdb_ctes
from stratagraph.sources.store import SnapshotStore
from stratagraph.sources.tables import shared_folder

TABLES = ("nation", "region", "supplier", "customer", "part", "orders", "lineitem", "events")
S = "CAST({} AS STRING_)".format

INPUTS = f"""
fact AS (
  SELECT s_suppkey AS seq, 'symbol' AS kind, 'a' AS producer, CAST(0.8 AS DOUBLE) AS confidence, 'function' AS symbol_kind, s_name AS name, 'n' || {S('s_nationkey')} || '.c' AS file_path, s_suppkey AS line,
    CAST(NULL AS STRING_) AS edge_kind, CAST(NULL AS STRING_) AS src_symbol, CAST(NULL AS STRING_) AS dst_symbol, CAST(NULL AS STRING_) AS derivation, CAST(NULL AS STRING_) AS site_file, CAST(NULL AS BIGINT) AS site_line, CAST(NULL AS STRING_) AS source_kind FROM {{supplier}}
  UNION ALL SELECT 1000000000 + s_suppkey, 'symbol', 'b', CAST(CASE WHEN s_acctbal > 0 THEN 0.9 ELSE 0.8 END AS DOUBLE), CASE WHEN s_acctbal < 9000 THEN 'function' END, s_name, 'n' || {S('s_nationkey')} || '.c', s_suppkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {{supplier}}
  UNION ALL SELECT 2000000000 + c_custkey, CASE WHEN c_acctbal < 0 THEN 'rumour' ELSE 'symbol' END, 'a', CAST(1 AS DOUBLE), 'struct', CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END, 'c.h', c_custkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {{customer}}
  UNION ALL SELECT 3000000000 + l_orderkey * 10 + l_linenumber, 'edge', CASE WHEN l_quantity > 2 THEN 'c' END, CAST(0.5 AS DOUBLE) + l_tax * 8, NULL, NULL, NULL, NULL, CASE WHEN l_returnflag = 'R' THEN 'writes_field' ELSE 'reads_field' END,
    CASE WHEN l_discount < 0.09 THEN 'S' || {S('l_suppkey')} END, CASE WHEN l_discount > 0.01 THEN 'P' || {S('l_partkey')} END, CASE WHEN l_linenumber < 7 THEN 'clangd' END, 'o' || {S('l_linenumber')} || '.c', l_partkey, CASE WHEN l_returnflag = 'R' THEN 'file_line' END FROM {{lineitem}}),
runtime AS (
  SELECT 'C' || {S('o_custkey')} AS target_api, CASE WHEN o_orderstatus = 'F' THEN 'irq' ELSE 'P' || o_orderpriority END AS invoker, o_orderstatus AS runtime_trigger, CASE WHEN o_orderstatus <> 'O' THEN 'P' || o_orderpriority END AS c1,
    CASE WHEN o_orderstatus <> 'O' THEN 'D' || {S('o_custkey')} END AS c2, CASE WHEN o_orderstatus <> 'O' THEN 'C' || {S('o_custkey')} END AS c3, CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END AS chained, CASE WHEN o_orderstatus = 'F' THEN 'log_line' END AS source_kind, count(*) AS n
  FROM {{orders}} GROUP BY o_custkey, o_orderstatus, o_orderpriority),
indirect AS (
  SELECT 'C' || {S('o_custkey')} AS target_api, CASE WHEN o_totalprice > 1000 THEN 'O' || {S('o_orderkey')} END AS name, CASE WHEN o_orderstatus <> 'P' THEN 'o.c' ELSE '' END AS file_path, o_orderkey AS line, CASE WHEN o_orderpriority < '2' THEN 'request_irq' END AS registration_api,
    CASE WHEN o_orderpriority < '3' THEN 'table' END AS container_type, CASE WHEN o_orderpriority < '4' THEN 'dispatch' END AS dispatch_function, CASE WHEN o_orderstatus = 'F' THEN 'irq' END AS trigger_kind, CASE WHEN o_orderpriority < '3' THEN o_orderpriority END AS trigger_key, CAST(NULL AS STRING_) AS pattern_name,
    CASE WHEN o_orderpriority < '4' THEN CAST(o_custkey % 7 AS DOUBLE) END AS score FROM {{orders}}),
registration AS (
  SELECT CASE WHEN p_size < 10 THEN 'request_irq' WHEN p_size < 20 THEN 'ops' ELSE p_name END AS registrar, 'P' || {S('p_partkey')} AS callback, {S('p_size')} AS dispatch_key, CASE WHEN p_size >= 10 THEN 'static struct ' || replace(p_brand, '#', '_') END AS struct_type, 'p.c' AS file_path, p_partkey AS line FROM {{part}}),
template AS (
  SELECT 1 AS seq, 'request_irq' AS registration_api, 'hw_irq' AS s1, 'do_irq' AS s2, '%CALLBACK%' AS s3, 'hardware_interrupt' AS trigger_kind, 'irq %KEY% fired' AS trigger_description
  UNION ALL SELECT 2, '__struct_field:Brand_11.20', 'syscall', 'vfs->read', '%CALLBACK%', 'event', 'a call of %KEY%'
  UNION ALL SELECT 3, '__struct_field:Brand_11.21', 'syscall', 'vfs->write', '%CALLBACK%', 'event', 'a call of %KEY%'
  UNION ALL SELECT 4, '__struct_field:Brand_12.30', 'timer', 'run %KEY%', '%CALLBACK%', 'timer_expiry', 'after %KEY%'),
hardware AS (SELECT 'IRQ controller' AS name, 'interrupt' AS kind, 'hw_irq' AS step UNION ALL SELECT 'clock', 'timer', 'timer' UNION ALL SELECT 'cpu', 'thread', 'do_irq'),
spelling AS (
  SELECT c_custkey AS id, CASE c_nationkey % 5 WHEN 0 THEN '_' WHEN 1 THEN '__' WHEN 2 THEN ' ' ELSE '' END || CASE WHEN c_acctbal < 0 THEN '___' ELSE c_name END || CASE c_nationkey % 3 WHEN 0 THEN '___RAM' WHEN 1 THEN '___' || c_mktsegment ELSE '' END AS symbol,
    '/w/' || CASE c_nationkey % 6 WHEN 0 THEN 'rom/x/patch/' WHEN 1 THEN 'rom/y/' WHEN 2 THEN 'v2rom/orig/' WHEN 3 THEN 'ramv3/' WHEN 4 THEN 'orig/' ELSE 'a\\b/' END || c_mktsegment || CASE WHEN c_acctbal > 0 THEN '_patch.c' ELSE '.c' END AS path FROM {{customer}}),
item AS (
  SELECT 'S' || {S('l_suppkey')} AS entity, 'P' || {S('l_partkey')} AS part, l_returnflag AS flag, l_linestatus AS status, l_orderkey * 10 + l_linenumber AS seq, l_discount AS discount, l_quantity AS quantity FROM {{lineitem}}),
wanted AS (
  SELECT entity, CASE WHEN flag = 'R' THEN 'structures' WHEN flag = 'A' THEN 'calls_out' ELSE 'logs' END AS bucket, entity AS src, part AS dst, CASE WHEN flag = 'R' THEN 'write' WHEN flag = 'A' THEN 'call_direct' ELSE 'emit_log' END AS edge_kind,
    min(seq) AS seq FROM item WHERE discount < 0.08 GROUP BY entity, flag, part),
answered AS (
  SELECT entity, CASE WHEN flag = 'R' THEN 'find_api_struct_writes' WHEN flag = 'A' THEN 'what_api_calls' ELSE 'find_api_logs' END AS intent, entity AS caller, part AS callee, CASE WHEN flag = 'R' THEN 'write' WHEN flag = 'A' THEN 'call_direct' ELSE 'emit_log' END AS edge_kind,
    CASE WHEN discount < 0.06 THEN discount * 10 ELSE 0 END AS confidence, CASE WHEN status = 'O' THEN 'clangd' WHEN quantity < 25 THEN 'c_parser' END AS derivation, seq FROM item WHERE discount > 0.02),
asked AS (
  SELECT e.entity, i.intent, CASE WHEN s_acctbal < 0 THEN 'error' WHEN s_acctbal > 5000 THEN 'enriched' ELSE 'hit' END AS status, CASE WHEN s_acctbal > 9000 THEN 0 ELSE 3 END AS items, CASE WHEN s_acctbal > 4000 THEN 6 ELSE 1 END AS minimum
  FROM (SELECT 'S' || {S('s_suppkey')} AS entity, s_acctbal FROM {{supplier}}) e CROSS JOIN (SELECT 'find_api_struct_writes' AS intent UNION ALL SELECT 'what_api_calls' UNION ALL SELECT 'find_api_logs') i),
scored AS (
  SELECT 'C' || {S('c_custkey')} AS entity, c_mktsegment AS family, CAST((c_custkey * 7 % 11) AS DOUBLE) / 10 AS coverage, CAST((c_custkey * 3 % 8) AS DOUBLE) / 7 AS backend, CAST((c_custkey % 5) AS DOUBLE) / 4 AS evidence, CASE WHEN c_acctbal > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS consistency,
    c_acctbal < -900 AS has_s0_s1 FROM {{customer}}),
run AS (
  SELECT event_type AS family, {S('event_id')} AS run_id, event_id AS ts, CAST(event_id * 37 % 101 AS DOUBLE) / 100 AS confidence, CASE event_id % 5 WHEN 0 THEN 'S0' WHEN 1 THEN 'S1' WHEN 2 THEN 'S2' WHEN 3 THEN 'S3' ELSE 'none' END AS max_severity FROM {{events}}),
fixture AS (
  SELECT 'S' || {S('s_suppkey')} AS entity, '{{"kind": "' || CASE s_nationkey % 6 WHEN 0 THEN 'api' WHEN 1 THEN 'struct' WHEN 2 THEN 'ring' WHEN 3 THEN 'log_point' WHEN 4 THEN 'what' ELSE 'thread' END || '", "kind_verbose": "k", "canonical_name": ' || CASE WHEN s_acctbal < 0 THEN '5' ELSE '"' || s_name || '"' END
    || ', "aliases": ' || CASE s_nationkey % 4 WHEN 0 THEN '{{}}' ELSE '[]' END || ', "source": ' || CASE s_nationkey % 5 WHEN 0 THEN 'null' ELSE '{{"file": "f.c", "line": ' || {S('s_nationkey % 3')} || '}}' END || ', "description": "' || CASE WHEN s_acctbal > 5000 THEN 'a longer text' ELSE 'short' END || '", "relations": '
    || CASE WHEN s_acctbal > 9500 THEN '[]' ELSE '{{"calls_in_direct": [' || CASE WHEN s_acctbal > 3000 THEN '{{}}' ELSE '' END || '], "calls_in_runtime": [], "calls_out": [], "registrations_in": [], "registrations_out": [], "structures": ' || CASE WHEN s_acctbal > 1000 THEN '[{{}}]' ELSE '7' END || ', "logs": [], "owns": []' || CASE WHEN s_acctbal > 2000 THEN ', "uses": []' ELSE '' END || '}}' END
    || CASE WHEN s_nationkey > 12 THEN ', "contract": ' || CASE WHEN s_nationkey > 18 THEN '3' ELSE '{{"required_directions": {{}}, "minimum_counts": {{}}}}' END ELSE '' END || '}}' AS json FROM {{supplier}})
"""


def _table(spark: SparkSession, sf_dir: str, name: str, columns: str = "*") -> DataFrame:
    # a backslash in a string literal is an escape to Spark only, and so are braces that aren't a table's
    text = INPUTS.replace("STRING_", "STRING").replace("a\\b/", "a\\\\b/").replace("{", "{{").replace("}", "}}")
    for t in TABLES:
        text = text.replace("{{" + t + "}}", "{" + t + "}")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return spark.sql(f"WITH {text} SELECT {columns} FROM {name}", **frames)


def _duck(select: str, more: str = "") -> str:
    text = INPUTS.replace("STRING_", "VARCHAR")
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return f"WITH {text}{', ' + more if more else ''} {select}"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(key: str, values: dict[str, str], otherwise: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in values.items()) + f" ELSE {otherwise} END"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def put(make):
        QUERIES[name] = make
        if sql is not None:
            ORACLE[name] = sql
        return make

    return put


# Facts


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _table(spark, sf_dir, "fact").withColumn("produced_by", F.when(F.col("producer").isNotNull(), F.array("producer")).otherwise(F.array().cast("array<string>"))).drop("producer")
    f = f.withColumns({"evidence_file": F.col("site_file"), "evidence_line": F.col("site_line")})
    return spark.createDataFrame([], ingest.FACTS).unionByName(f, allowMissingColumns=True)


_REASON = """CASE WHEN kind = 'rumour' THEN 'unknown fact kind' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence outside 0 to 1' WHEN producer IS NULL THEN 'no producer'
  WHEN kind = 'symbol' AND (name IS NULL OR symbol_kind IS NULL) THEN 'a symbol without name or kind' WHEN kind = 'edge' AND ((src_symbol IS NULL AND dst_symbol IS NULL) OR derivation IS NULL) THEN 'an edge without kind, ends or derivation' END"""
_MERGED = f"""good AS (SELECT *, CASE WHEN kind = 'symbol' THEN 'symbol|' || symbol_kind || '|' || name || '|' || file_path || ':' || line ELSE 'edge|' || edge_kind || '|' || coalesce(src_symbol, '') || '->' || coalesce(dst_symbol, '') || '|' || site_file || ':' || site_line END AS fact_key FROM fact WHERE ({_REASON}) IS NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY fact_key ORDER BY confidence DESC, seq) AS rn FROM good),
merged AS (SELECT b.* EXCLUDE (seq), m.seq, m.producers FROM best b JOIN (SELECT fact_key, min(seq) AS seq, array_to_string(list_sort(list(DISTINCT producer)), ',') AS producers FROM good GROUP BY fact_key) m USING (fact_key) WHERE rn = 1)"""


@_query("fact_rejects", _duck(f"SELECT kind, {_REASON} AS reason, count(*)::BIGINT AS n FROM fact WHERE ({_REASON}) IS NOT NULL GROUP BY ALL"))
def fact_rejects(spark, sf_dir):
    return ingest.validate(_facts(spark, sf_dir))[1].groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@_query("fact_merge", _duck("SELECT fact_key, kind, name, confidence, seq, producers FROM merged", _MERGED))
def fact_merge(spark, sf_dir):
    return ingest.merge(ingest.validate(_facts(spark, sf_dir))[0]).select("fact_key", "kind", "name", "confidence", "seq", F.array_join("produced_by", ",").alias("producers"))


def _rows(spark, sf_dir) -> dict[str, DataFrame]:
    return ingest.to_rows(ingest.merge(ingest.validate(_facts(spark, sf_dir))[0]), 5)


@_query("fact_nodes", _duck("SELECT 5::BIGINT AS snapshot_id, 'graph_node:5:symbol:' || name AS node_id, name AS canonical_name, arg_max(symbol_kind, (confidence, -seq)) AS kind, arg_max(file_path, (confidence, -seq)) AS file_path, arg_max(line, (confidence, -seq)) AS line FROM merged WHERE kind = 'symbol' GROUP BY name", _MERGED))
def fact_nodes(spark, sf_dir):
    return _rows(spark, sf_dir)["nodes"].select("snapshot_id", "node_id", "canonical_name", "kind", "file_path", "line")


_EDGE_ID = "concat_ws(':', 'graph_edge:5', edge_kind, src_symbol, dst_symbol)"


@_query("fact_edges", _duck(f"SELECT {_EDGE_ID} AS edge_id, arg_max(edge_kind, (confidence, -seq)) AS edge_kind, arg_max('graph_node:5:symbol:' || src_symbol, (confidence, -seq)) AS src_node_id, arg_max('graph_node:5:symbol:' || dst_symbol, (confidence, -seq)) AS dst_node_id, max(confidence) AS confidence, 'clangd' AS derivation FROM merged WHERE kind = 'edge' GROUP BY 1", _MERGED))
def fact_edges(spark, sf_dir):
    return _rows(spark, sf_dir)["edges"].select("edge_id", "edge_kind", "src_node_id", "dst_node_id", "confidence", "derivation")


@_query("fact_evidence", _duck(f"SELECT 'graph_evidence:5:' || {_EDGE_ID} AS evidence_id, {_EDGE_ID} AS edge_id, 'file_line' AS source_kind, arg_max(site_file, (confidence, -seq)) AS file_path, arg_max(site_line, (confidence, -seq)) AS line FROM merged WHERE kind = 'edge' AND source_kind IS NOT NULL GROUP BY 1, 2", _MERGED))
def fact_evidence(spark, sf_dir):
    return _rows(spark, sf_dir)["evidence"].select("evidence_id", "edge_id", "source_kind", "file_path", "line")


@_query("fact_upsert", _duck("SELECT name AS canonical_name, max(CASE WHEN producer = 'b' THEN 2 ELSE 1 END)::INT AS version FROM fact WHERE kind = 'symbol' AND producer IN ('a', 'b') AND symbol_kind = 'function' GROUP BY name"))
def fact_upsert(spark, sf_dir):
    f = _table(spark, sf_dir, "fact").filter("kind = 'symbol' AND symbol_kind = 'function'")
    side = lambda p, v: f.filter(F.col("producer") == p).select(F.col("name").alias("canonical_name"), F.lit(v).alias("version"))
    return ingest.upsert(side("a", 1), side("b", 2), ["canonical_name"])


@_query("captured_functions", duckdb_ctes() + "SELECT canonical_name AS name, file_path, line FROM nodes WHERE kind = 'function'")
def captured_functions(spark, sf_dir):
    return ingest.captured(star_graph(spark, sf_dir).nodes)


_PURGED = "file_path IN (SELECT path FROM module_of WHERE starts_with(path, 'AFRICA'))"


@_query("purge_files", duckdb_ctes() + f""", gone AS (SELECT node_id FROM nodes WHERE {_PURGED})
SELECT 'nodes' AS item, kind, count(*)::BIGINT AS n FROM nodes WHERE node_id NOT IN (SELECT node_id FROM gone) GROUP BY ALL
UNION ALL SELECT 'edges', edge_kind, count(*)::BIGINT FROM edges WHERE src_node_id NOT IN (SELECT node_id FROM gone) GROUP BY ALL
UNION ALL SELECT 'observations', kind, count(*)::BIGINT FROM observations WHERE node_id NOT IN (SELECT node_id FROM gone) GROUP BY ALL""")
def purge_files(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    paths = g.nodes.filter("kind = 'module' AND file_path LIKE 'AFRICA%'").select("file_path").distinct()
    evidence = spark.createDataFrame([], "evidence_id string, edge_id string, node_id string")
    kept = ingest.purge_files({"nodes": g.nodes, "edges": g.edges, "evidence": evidence, "observations": g.observations}, paths)
    count = lambda t, kind: kept[t].groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("item"), "kind", "n")
    return count("nodes", "kind").unionByName(count("edges", "edge_kind")).unionByName(count("observations", "kind"))


# Runtime callers


@_query("runtime_links", duckdb_ctes() + "SELECT o.observation_id, n.canonical_name IS NOT NULL AS linked FROM (SELECT observation_id, target_api FROM observations UNION ALL SELECT observation_id || '?', immediate_invoker FROM observations) o LEFT JOIN (SELECT DISTINCT canonical_name FROM nodes WHERE kind = 'function') n ON canonical_name = target_api")
def runtime_links(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    rows = g.observations.select("observation_id", "target_api").unionByName(g.observations.select(F.concat("observation_id", F.lit("?")).alias("observation_id"), F.col("immediate_invoker").alias("target_api")))
    linked, rest = ingest.link_callers(rows, g.nodes)
    return linked.select("observation_id", F.lit(True).alias("linked")).unionByName(rest.select("observation_id", F.lit(False).alias("linked")))


@_query("indirect_callers", _duck("SELECT target_api, name AS immediate_invoker, concat_ws('>', registration_api, container_type, dispatch_function) AS dispatch_chain, file_path AS site_file, line AS site_line, coalesce(trigger_kind, trigger_key, pattern_name, 'unknown') AS runtime_trigger, CASE WHEN score IS NULL THEN 0.5::DOUBLE ELSE least(score / 5, 1.0::DOUBLE) END AS confidence FROM indirect WHERE name IS NOT NULL AND file_path <> ''"))
def indirect_callers(spark, sf_dir):
    return ingest.caller_rows(_table(spark, sf_dir, "indirect")).withColumn("dispatch_chain", F.array_join("dispatch_chain", ">"))


def _chains(spark, sf_dir) -> dict[str, DataFrame]:
    r = _table(spark, sf_dir, "runtime")
    chain = F.when(F.col("chained") == 1, F.array("c1", "c2", "c3")).otherwise(F.array().cast("array<string>"))
    rows = r.select("target_api", F.col("invoker").alias("immediate_invoker"), "runtime_trigger", chain.alias("dispatch_chain"), (F.col("n") / 100).alias("confidence"), "source_kind", F.when(F.col("source_kind").isNotNull(), F.lit("r.log")).alias("evidence_file"))
    return ingest.materialize_chains(rows, 7)


_STEPS = """chain AS (SELECT *, CASE WHEN chained = 1 THEN c1 || ' -> ' || c2 || ' -> ' || c3 ELSE '' END AS given, (target_api, invoker, runtime_trigger, CASE WHEN chained = 1 THEN c1 || ' -> ' || c2 || ' -> ' || c3 ELSE '' END, n) AS o FROM runtime),
pair AS (SELECT o, target_api, invoker, n, 0 AS i, CASE WHEN chained = 1 THEN c1 ELSE invoker END AS a, CASE WHEN chained = 1 THEN c2 ELSE target_api END AS b FROM chain UNION ALL SELECT o, target_api, invoker, n, 1, c2, c3 FROM chain WHERE chained = 1),
step AS (SELECT *, CASE WHEN a = invoker AND b = target_api THEN 'graph_edge:7:runtime_invokes:' || invoker || ':' || target_api ELSE 'graph_edge:7:runtime_chain:' || i || ':' || a || ':' || b END AS edge_id FROM pair)"""
_WHO = lambda c: f"CASE WHEN {c} = target_api THEN 'graph_node:7:symbol:' ELSE 'graph_node:7:runtime:unknown:' END || {c}"


@_query("runtime_chain_edges", _duck(f"SELECT edge_id, arg_max({_WHO('a')}, o) AS src_node_id, arg_max({_WHO('b')}, o) AS dst_node_id, arg_max(n / 100, o) AS confidence, arg_max(CASE WHEN a = invoker AND b = target_api THEN 'runtime_observed' ELSE 'runtime_chain_step' END, o) AS runtime_call_kind, arg_max(i, o)::BIGINT AS chain_index FROM step GROUP BY edge_id", _STEPS))
def runtime_chain_edges(spark, sf_dir):
    return _chains(spark, sf_dir)["edges"].select("edge_id", "src_node_id", "dst_node_id", "confidence", "runtime_call_kind", "chain_index")


@_query("runtime_chain_nodes", _duck(f"SELECT DISTINCT {_WHO('x')} AS node_id, x AS canonical_name, CASE WHEN x = target_api THEN 'function' ELSE 'unknown' END AS kind FROM (SELECT target_api, invoker AS x FROM chain UNION ALL SELECT target_api, target_api FROM chain UNION ALL SELECT target_api, a FROM pair UNION ALL SELECT target_api, b FROM pair)", _STEPS))
def runtime_chain_nodes(spark, sf_dir):
    return _chains(spark, sf_dir)["nodes"].select("node_id", "canonical_name", "kind")


@_query("runtime_chain_observations", _duck("SELECT 'graph_observation:7:' || target_api || ':' || invoker AS observation_id, 'graph_node:7:symbol:' || target_api AS node_id, arg_max(runtime_trigger, o) AS runtime_trigger, arg_max(given, o) AS dispatch_chain, arg_max(n / 100, o) AS confidence FROM chain GROUP BY target_api, invoker", _STEPS))
def runtime_chain_observations(spark, sf_dir):
    return _chains(spark, sf_dir)["observations"].select("observation_id", "node_id", "runtime_trigger", "dispatch_chain", "confidence")


@_query("runtime_chain_evidence", _duck("SELECT 'graph_evidence:7:' || e AS evidence_id, e AS edge_id, source_kind, 'r.log' AS file_path FROM (SELECT DISTINCT source_kind, 'graph_edge:7:runtime_chain:1:' || c2 || ':' || c3 AS e FROM chain WHERE source_kind IS NOT NULL)", _STEPS))
def runtime_chain_evidence(spark, sf_dir):
    return _chains(spark, sf_dir)["evidence"].select("evidence_id", "edge_id", "source_kind", "file_path")


def _called(spark, sf_dir) -> DataFrame:
    templates = _table(spark, sf_dir, "template").withColumn("chain", F.array("s1", "s2", "s3"))
    return ingest.runtime_calls(_table(spark, sf_dir, "registration"), templates)


_CALLED = """typed AS (SELECT *, replace(struct_type, 'static struct ', '') AS st FROM registration),
met AS (SELECT r.*, t.*, 0 AS rank, t.s2 AS step2 FROM typed r JOIN template t ON r.registrar = t.registration_api
  UNION ALL SELECT r.*, t.*, 1, t.s2 FROM typed r JOIN template t ON '__struct_field:' || st || '.' || dispatch_key = t.registration_api
  UNION ALL SELECT r.*, t.*, 2, CASE WHEN contains(t.s2, '->') THEN regexp_replace(t.s2, '[^>]*$', dispatch_key) ELSE t.s2 END FROM typed r JOIN template t ON starts_with(t.registration_api, '__struct_field:' || st || '.')),
called AS (SELECT registrar, callback, dispatch_key, s1, replace(step2, '%KEY%', dispatch_key) AS step2, trigger_kind, replace(trigger_description, '%KEY%', dispatch_key) AS trigger_description FROM (SELECT *, row_number() OVER (PARTITION BY registrar, callback ORDER BY rank, seq) AS rn FROM met) WHERE rn = 1)"""


@_query("template_calls", _duck("SELECT registrar, callback, s1 || '>' || step2 || '>' || callback AS dispatch_chain, trigger_kind, trigger_description, step2 AS src_symbol FROM called", _CALLED))
def template_calls(spark, sf_dir):
    return _called(spark, sf_dir).select("registrar", "callback", F.array_join("dispatch_chain", ">").alias("dispatch_chain"), "trigger_kind", "trigger_description", "src_symbol")


@_query("hardware_dispatch", _duck("SELECT DISTINCT h.name AS src_symbol, CASE WHEN h.step = s1 THEN step2 ELSE callback END AS dst_symbol, (CASE WHEN h.step = s1 THEN 0 ELSE 1 END)::BIGINT AS position, trigger_kind FROM called JOIN hardware h ON h.step = s1 OR h.step = step2", _CALLED))
def hardware_dispatch(spark, sf_dir):
    return ingest.hardware_dispatch(_called(spark, sf_dir), _table(spark, sf_dir, "hardware"))[1].select("src_symbol", "dst_symbol", "position", "trigger_kind")


@_query("hardware_nodes", _duck("SELECT DISTINCT h.name, h.kind AS hw_kind FROM called JOIN hardware h ON h.step = s1 OR h.step = step2", _CALLED))
def hardware_nodes(spark, sf_dir):
    return ingest.hardware_dispatch(_called(spark, sf_dir), _table(spark, sf_dir, "hardware"))[0].select("name", "hw_kind")


# Snapshots


@_query("snapshot_lifecycle", duckdb_ctes() + "SELECT 1::BIGINT AS snapshot_id, 'ready' AS status, '/ws:abc:1' AS fingerprint, true AS latest, (SELECT count(*) FROM nodes)::BIGINT AS nodes, (SELECT count(*) FROM ne)::BIGINT AS edges UNION ALL SELECT 2, 'failed', '/ws:abc:2', false, 0, 0 UNION ALL SELECT 3, 'building', '/ws:abc:3', false, 0, 0")
def snapshot_lifecycle(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    store = SnapshotStore(spark, f"{shared_folder(spark)}/strata-stores/{uuid.uuid4().hex}")
    ids = [store.begin("/ws", "abc", v) for v in "123"]
    store.commit(ids[0], store.write(ids[0], {"nodes": g.nodes, "edges": g.edges, "observations": g.observations}))
    store.fail(ids[1], "no compiler")
    latest = store.latest_ready("/ws")
    counts = [(i, store.graph(i).nodes.count(), store.graph(i).named.count()) for i in ids]
    sizes = spark.createDataFrame(counts, "snapshot_id long, nodes long, edges long")
    return store.current().join(sizes, "snapshot_id").select("snapshot_id", "status", "fingerprint", (F.col("snapshot_id") == latest).alias("latest"), "nodes", "edges")


# Responses


def _edge_rows(spark, sf_dir, *kinds: str) -> DataFrame:
    return hops.rows_of(star_graph(spark, sf_dir).of(*kinds), "src")


_EDGE_ROWS = "SELECT src_kind AS kind, src AS canonical_name, src AS caller, dst AS callee, edge_kind, confidence, derivation, src_file AS file_path, src_line AS line_number FROM ne"
_KINDS = {k: k for k in respond.KIND_VERBOSE} | respond.KIND_ALIASES
_NAMES = respond.EDGE_NAMES | {"calls": "call_direct"}


@_query("protocol_nodes", duckdb_ctes() + f"""SELECT '1:' || canonical_name AS node_id, k AS kind, {_case('k', respond.KIND_VERBOSE, "'unknown_entity'")} AS kind_verbose, coalesce(file_path, 'unknown') AS file, greatest(1, coalesce(line_number, 1))::BIGINT AS line,
CASE WHEN e IN ('read', 'write') THEN 'structures' ELSE 'calls_out' END AS bucket, e AS edge_kind, {_case('e', respond.EDGE_VERBOSE, 'NULL')} AS edge_kind_verbose, caller AS src_name, callee AS dst_name, confidence AS overall_conf
FROM (SELECT *, {_case('kind', _KINDS, "'unknown'")} AS k, {_case('edge_kind', _NAMES, "'call_runtime'")} AS e FROM ({_EDGE_ROWS}))""")
def protocol_nodes(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    rows = hops.rows_of(g.named, "src")
    return respond.nodes("what_api_calls", rows).select("node_id", "kind", "kind_verbose", "file", "line", "bucket", "edge_kind", "edge_kind_verbose", "src_name", "dst_name", "overall_conf")


@_query("flat_edges", duckdb_ctes() + f"""SELECT '1:' || caller AS "from", '1:' || callee AS "to", kind, max(confidence) AS confidence FROM (SELECT caller, callee, confidence, {_case(f"({_case('edge_kind', _NAMES, chr(39) + 'call_runtime' + chr(39))})", respond.LEGACY_EDGES, "'operates_on_struct'")} AS kind FROM ({_EDGE_ROWS})) GROUP BY ALL""")
def flat_edges(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return respond.flat_edges(respond.nodes("what_api_calls", hops.rows_of(g.named, "src"))).select("from", "to", "kind", "confidence")


@_query("flat_nodes", duckdb_ctes() + f"""SELECT '1:' || canonical_name AS id, coalesce(file_path, '') AS file_path, CASE WHEN s THEN caller END AS writer, CASE WHEN s THEN callee END AS target, CASE WHEN s THEN edge_kind END AS edge_kind, CASE WHEN s THEN CASE WHEN edge_kind = 'writes_field' THEN 'runtime' ELSE 'static' END END AS derivation
FROM (SELECT *, edge_kind IN ('reads_field', 'writes_field') AS s FROM ({_EDGE_ROWS}))""")
def flat_nodes(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    return respond.flat_nodes(respond.nodes("what_api_calls", hops.rows_of(g.named, "src"))).select("id", "file_path", "writer", "target", "edge_kind", "derivation")


@_query("projected_runtime_callers", duckdb_ctes() + f"""SELECT caller AS runtime_caller_api_name, callee AS runtime_called_api_name, {_case('edge_kind', respond.INVOCATIONS, _q(respond.UNKNOWN_INVOCATION))} AS runtime_caller_invocation_type_classification, confidence AS runtime_relation_confidence_score, derivation AS runtime_relation_derivation_source FROM ({_EDGE_ROWS})""")
def projected_runtime_callers(spark, sf_dir):
    rows = hops.rows_of(star_graph(spark, sf_dir).named, "src")
    return respond.project("who_calls_api_at_runtime", rows).select("runtime_caller_api_name", "runtime_called_api_name", "runtime_caller_invocation_type_classification", "runtime_relation_confidence_score", "runtime_relation_derivation_source")


@_query("projected_observations", duckdb_ctes() + "SELECT target_api AS target_api_name, runtime_trigger AS runtime_trigger_event_description, dispatch_chain AS runtime_execution_path_from_entrypoint_to_target_api, immediate_invoker AS runtime_immediate_caller_api_name, confidence AS runtime_confidence_score, 'runtime_calls' AS edge_kind, 'runtime' AS derivation FROM observations")
def projected_observations(spark, sf_dir):
    rows = star_graph(spark, sf_dir).observations.select("kind", "target_api", "immediate_invoker", "runtime_trigger", "dispatch_chain", "confidence")
    return respond.project("why_api_invoked", rows).select("target_api_name", "runtime_trigger_event_description", "runtime_execution_path_from_entrypoint_to_target_api", "runtime_immediate_caller_api_name", "runtime_confidence_score", "edge_kind", "derivation")


@_query("projected_struct_writers", duckdb_ctes() + "SELECT src AS current_structure_runtime_writer_api_name, edge_kind AS current_structure_runtime_structure_operation_type_classification, confidence AS current_structure_runtime_structure_operation_confidence_score, derivation AS current_structure_runtime_relation_derivation_source, access_path AS current_api_runtime_structure_access_path_expression FROM ne WHERE edge_kind = 'writes_field'")
def projected_struct_writers(spark, sf_dir):
    rows = hops.rows_of(star_graph(spark, sf_dir).of("writes_field"), "src", "", {"writer": "src", "access_path": "access_path"})
    out = respond.project("find_struct_writers", rows)
    return out.drop("current_structure_runtime_target_structure_name")


@_query("projected_timers", duckdb_ctes() + "SELECT src AS current_api_runtime_timer_identifier_name, timer_condition AS current_api_runtime_timer_trigger_condition_description, confidence AS current_api_runtime_timer_trigger_confidence_score, dst AS callee FROM ne WHERE edge_kind = 'runtime_calls' AND src_kind = 'timer'")
def projected_timers(spark, sf_dir):
    rows = hops.rows_of(star_graph(spark, sf_dir).of("runtime_calls").filter("src_kind = 'timer'"), "src", "src", {"timer_condition": "timer_condition"})
    return respond.project("find_api_timer_triggers", rows).select("current_api_runtime_timer_identifier_name", "current_api_runtime_timer_trigger_condition_description", "current_api_runtime_timer_trigger_confidence_score", "callee")


@_query("caller_roles", duckdb_ctes() + f"""SELECT src AS name, t AS invocation_type, {_case('t', respond.ROLES, "'runtime_caller'")} AS caller_role, max(confidence) AS confidence FROM (SELECT src, confidence, {_case('edge_kind', respond.CALLER_TYPES, "'unknown'")} AS t FROM ne) GROUP BY ALL""")
def caller_roles(spark, sf_dir):
    rows = hops.rows_of(star_graph(spark, sf_dir).named, "src")
    return respond.callers(rows).select("name", "invocation_type", "caller_role", "confidence")


_BARE = r"regexp_replace(regexp_replace(trim(symbol), '^_+', ''), '___[A-Za-z0-9_]+$', '')"
_CANON = f"CASE WHEN {_BARE} = '' THEN trim(symbol) ELSE {_BARE} END"


@_query("symbol_spellings", _duck(f"SELECT id, c AS canonical, array_to_string([c, '_' || c, '__' || c, c || '___RAM', '_' || c || '___RAM', c || '___ROM', '_' || c || '___ROM'], ',') || CASE WHEN symbol IN (c, '_' || c, '__' || c, c || '___RAM', '_' || c || '___RAM', c || '___ROM', '_' || c || '___ROM') THEN '' ELSE ',' || symbol END AS aliases FROM (SELECT *, {_CANON} AS c FROM spelling)"))
def symbol_spellings(spark, sf_dir):
    return _table(spark, sf_dir, "spelling").select("id", respond.canonical_column(F.col("symbol")).alias("canonical"), F.array_join(respond.alias_column(F.col("symbol")), ",").alias("aliases"))


@_query("normal_paths", _duck(r"SELECT id, regexp_replace(regexp_replace(regexp_replace(replace(path, '\', '/'), '/(?:rom/[^/]+|v[0-9]+rom|ramv[0-9]+)/(?:patch|orig)/', '/src/', 'g'), '/(?:rom/[^/]+|v[0-9]+rom|ramv[0-9]+)/', '/src/', 'g'), '_patch(\.[^./]+)$', '\1') AS path FROM spelling"))
def normal_paths(spark, sf_dir):
    return _table(spark, sf_dir, "spelling").select("id", respond.normal_path_column(F.col("path")).alias("path"))


# Reconciliation

_BUCKET = {i: b for b, intents in respond.INTENT_BUCKETS.items() for i in intents}


@_query("intent_buckets", "SELECT * FROM (VALUES " + ", ".join(f"({_q(i)}, {_q(_BUCKET.get(i, 'uses'))})" for i in CATALOG) + ") t(intent, bucket)")
def intent_buckets(spark, sf_dir):
    return spark.createDataFrame([(i,) for i in CATALOG], "intent string").select("intent", respond.bucket_of(F.col("intent")).alias("bucket"))


_ANSWER_BUCKET = _case("intent", _BUCKET, "'uses'")
_FOUND = f"found AS (SELECT entity, {_ANSWER_BUCKET} AS bucket, caller AS src, callee AS dst, edge_kind, CASE WHEN confidence = 0 THEN 0.5::DOUBLE ELSE confidence END AS confidence, coalesce(derivation, 'clangd') AS derivation, seq FROM answered)"
_ONCE = _FOUND + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY entity, src, dst, edge_kind ORDER BY confidence DESC, derivation = 'clangd' DESC, CASE WHEN derivation = 'clangd' THEN -seq ELSE seq END) AS rn, min(seq) OVER (PARTITION BY entity, src, dst, edge_kind) AS first_seq FROM found),
once AS (SELECT * EXCLUDE (seq, rn, first_seq), first_seq AS seq FROM ordered WHERE rn = 1)"""


def _found(spark, sf_dir) -> DataFrame:
    return reconcile.normalized(_table(spark, sf_dir, "answered"))


def _wanted(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "wanted").withColumns({"confidence": F.lit(0.9), "derivation": F.lit("clangd")})


@_query("relation_dedupe", _duck("SELECT entity, bucket, src, dst, edge_kind, confidence, derivation, seq FROM once", _ONCE))
def relation_dedupe(spark, sf_dir):
    return reconcile.dedupe(_found(spark, sf_dir)).select("entity", "bucket", "src", "dst", "edge_kind", "confidence", "derivation", "seq")


@_query("relation_enrich", _duck("SELECT entity, bucket, src, dst, edge_kind, confidence, row_number() OVER (PARTITION BY entity, bucket ORDER BY confidence DESC, late, seq, src, dst, edge_kind)::BIGINT AS position FROM (SELECT entity, bucket, src, dst, edge_kind, 0.9::DOUBLE AS confidence, seq, 0 AS late FROM wanted UNION ALL SELECT entity, bucket, src, dst, edge_kind, confidence, seq, 1 FROM once)", _ONCE))
def relation_enrich(spark, sf_dir):
    return reconcile.enrich(_wanted(spark, sf_dir), _found(spark, sf_dir)).select("entity", "bucket", "src", "dst", "edge_kind", "confidence", "position")


@_query("relation_contracts", _duck("""SELECT entity, concat_ws(',', CASE WHEN bool_or(bucket = 'calls_out') THEN 'call_direct' END, CASE WHEN bool_or(bucket = 'structures') THEN 'write' END, CASE WHEN bool_or(bucket = 'logs') THEN 'emit_log' END) AS kinds, CASE WHEN bool_or(bucket = 'calls_out') THEN 'outgoing' ELSE '' END AS directions, array_to_string(list_sort(list(DISTINCT bucket)), ',') AS minimums FROM wanted GROUP BY entity"""))
def relation_contracts(spark, sf_dir):
    c = reconcile.contracts(_wanted(spark, sf_dir))
    return c.select("entity", F.array_join("required_relation_kinds", ",").alias("kinds"), F.array_join("required_directions", ",").alias("directions"), F.array_join("minimum_buckets", ",").alias("minimums"))


def _differences(spark, sf_dir) -> DataFrame:
    asked = _table(spark, sf_dir, "asked")
    found = _table(spark, sf_dir, "answered").select("entity", "intent", respond.bucket_of(F.col("intent")).alias("bucket"), F.col("caller").alias("src"), F.col("callee").alias("dst"), "edge_kind")
    least = asked.select("entity", respond.bucket_of(F.col("intent")).alias("bucket"), "minimum")
    return reconcile.compare(_wanted(spark, sf_dir), asked, found, least)


_DIFFERENCES = f"""asked2 AS (SELECT *, {_ANSWER_BUCKET} AS bucket FROM asked),
want AS (SELECT a.entity, a.intent, a.bucket, w.src || '|' || w.dst || '|' || w.edge_kind AS k FROM asked2 a JOIN wanted w ON a.entity = w.entity AND a.bucket = w.bucket WHERE items > 0),
have AS (SELECT a.entity, a.intent, a.bucket, w.caller || '|' || w.callee || '|' || w.edge_kind AS k FROM asked2 a JOIN answered w ON a.entity = w.entity AND a.intent = w.intent WHERE items > 0),
diff AS (
  SELECT entity, intent, bucket, 'status' AS field, 'hit|enriched' AS expected, status AS actual, 'consistency' AS mismatch_type FROM asked2 WHERE status NOT IN ('hit', 'enriched')
  UNION ALL SELECT entity, intent, bucket, 'data.items.length', '>0', '0', 'missing' FROM asked2 WHERE items = 0
  UNION ALL SELECT entity, intent, bucket, 'rel.' || bucket, k, NULL, 'extra' FROM want w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.entity = w.entity AND h.intent = w.intent AND h.k = w.k)
  UNION ALL SELECT DISTINCT entity, intent, bucket, 'rel.' || bucket, NULL, k, 'extra' FROM have h WHERE NOT EXISTS (SELECT 1 FROM want w WHERE h.entity = w.entity AND h.intent = w.intent AND h.k = w.k)
  UNION ALL SELECT entity, intent, bucket, 'rel.' || bucket || ' (minimum_count)', '>=' || minimum, n::VARCHAR, 'evidence_weak' FROM (SELECT a.*, (SELECT count(*) FROM have h WHERE h.entity = a.entity AND h.intent = a.intent) AS n FROM asked2 a WHERE items > 0 AND EXISTS (SELECT 1 FROM want w WHERE w.entity = a.entity AND w.intent = a.intent)) WHERE n < minimum),
classified AS (SELECT *, {_case("mismatch_type || '|' || field", {k: s for k, (s, _) in reconcile.RULES.items()}, "'S3'")} AS severity, {_case("mismatch_type || '|' || field", {k: r for k, (_, r) in reconcile.RULES.items()}, "'UNKNOWN_' || upper(mismatch_type) || '_' || upper(replace(field, '.', '_'))")} AS rule_id FROM diff),
result AS (SELECT a.entity, a.intent, a.bucket, count(field) AS total_diffs, count(field) FILTER (severity IN ('S0', 'S1')) AS fail_count, count(field) FILTER (severity = 'S2') AS warn_count, count(field) FILTER (severity = 'S3') AS pass_count FROM asked2 a LEFT JOIN classified c ON a.entity = c.entity AND a.intent = c.intent GROUP BY ALL),
outcome AS (SELECT *, CASE WHEN fail_count > 0 THEN 'fail' WHEN warn_count > 0 THEN 'warn' ELSE 'pass' END AS ci_outcome FROM result)"""


@_query("compare_answers", _duck("SELECT entity, intent, bucket, field, expected, actual, mismatch_type, severity, rule_id FROM classified", _DIFFERENCES))
def compare_answers(spark, sf_dir):
    return _differences(spark, sf_dir).drop("outcome")


@_query("compare_results", _duck("SELECT * FROM outcome", _DIFFERENCES))
def compare_results(spark, sf_dir):
    return reconcile.results(_table(spark, sf_dir, "asked"), _differences(spark, sf_dir)).select("entity", "intent", "bucket", "total_diffs", "fail_count", "warn_count", "pass_count", "ci_outcome")


@_query("compare_report", _duck("SELECT count(*)::BIGINT AS total_entities, count(*) FILTER (w = 0)::BIGINT AS fail_entities, count(*) FILTER (w = 1)::BIGINT AS warn_entities, count(*) FILTER (w = 2)::BIGINT AS pass_entities, CASE WHEN min(w) = 0 THEN 'fail' WHEN min(w) = 1 THEN 'warn' ELSE 'pass' END AS ci_outcome FROM (SELECT entity, min(CASE ci_outcome WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END) AS w FROM outcome GROUP BY entity)", _DIFFERENCES))
def compare_report(spark, sf_dir):
    return reconcile.aggregate(reconcile.report(reconcile.results(_table(spark, sf_dir, "asked"), _differences(spark, sf_dir))))


@_query("run_ids", _duck("""SELECT status, 'run-' || lpad(lower(printf('%x', list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(s, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: xor((h * 33) % 4294967296, c)))), 8, '0') AS run_id
FROM (SELECT status, array_to_string(list_sort(list(DISTINCT entity)), ',') AS s FROM asked GROUP BY status)"""))
def run_ids(spark, sf_dir):
    return reconcile.run_ids(_table(spark, sf_dir, "asked"), "status")


_SCORED = """graded AS (SELECT *, 0::DOUBLE + coverage * 0.25::DOUBLE + backend * 0.35::DOUBLE + evidence * 0.2::DOUBLE + consistency * 0.2::DOUBLE AS confidence FROM scored),
judged AS (SELECT *, CASE WHEN has_s0_s1 THEN 'FAIL' WHEN confidence >= 0.85::DOUBLE THEN 'PASS' WHEN confidence >= 0.7::DOUBLE THEN 'WARN' ELSE 'FAIL' END AS outcome FROM graded)"""


@_query("confidence_scores", _duck("SELECT entity, round(confidence, 9) AS confidence, outcome, ((coverage < 0.5)::INT + (backend < 0.7::DOUBLE)::INT + (evidence < 0.7::DOUBLE)::INT + (consistency < 1)::INT + (confidence < 0.7::DOUBLE)::INT)::INT AS hints FROM judged", _SCORED))
def confidence_scores(spark, sf_dir):
    return reconcile.score(_table(spark, sf_dir, "scored")).select("entity", F.round("confidence", 9).alias("confidence"), "outcome", F.size("hints").alias("hints"))


@_query("family_scores", _duck("SELECT family, count(*)::BIGINT AS entity_count, round(avg(confidence), 6) AS avg_confidence, CASE WHEN bool_or(has_s0_s1) THEN 'FAIL' WHEN avg(confidence) >= 0.85::DOUBLE THEN 'PASS' WHEN avg(confidence) >= 0.7::DOUBLE THEN 'WARN' ELSE 'FAIL' END AS ci_outcome, count(*) FILTER (confidence < 0.7::DOUBLE)::INT AS low FROM judged GROUP BY family", _SCORED))
def family_scores(spark, sf_dir):
    return reconcile.families(reconcile.score(_table(spark, sf_dir, "scored"))).select("family", "entity_count", F.round("avg_confidence", 6).alias("avg_confidence"), "ci_outcome", F.size("low_confidence_entities").alias("low"))


_GRADE = lambda c: f"CASE WHEN {c} >= 0.85::DOUBLE THEN 'PASS' WHEN {c} >= 0.7::DOUBLE THEN 'WARN' ELSE 'FAIL' END"
_RANK = lambda c: f"CASE {c} WHEN 'S0' THEN 4 WHEN 'S1' THEN 3 WHEN 'S2' THEN 2 WHEN 'S3' THEN 1 ELSE 0 END"


@_query("confidence_trend", _duck(f"""SELECT family, run_id, prior_run_id, round(d, 9) AS confidence_delta, worse AS severity_escalated, crossed AS ci_boundary_crossed, CASE WHEN crossed <> 'none' THEN 'THRESHOLD_BREACH' WHEN d > 0.05::DOUBLE THEN 'IMPROVING' WHEN d < -0.05::DOUBLE OR worse THEN 'DEGRADING' ELSE 'STABLE' END AS verdict
FROM (SELECT *, confidence - was AS d, {_RANK('max_severity')} > {_RANK('was_severity')} AS worse, CASE WHEN g0 || '->' || g1 IN ('PASS->WARN', 'PASS->FAIL', 'WARN->FAIL') THEN g0 || '->' || g1 ELSE 'none' END AS crossed
  FROM (SELECT *, {_GRADE('was')} AS g0, {_GRADE('confidence')} AS g1 FROM (SELECT *, lag(run_id) OVER w AS prior_run_id, lag(confidence) OVER w AS was, lag(max_severity) OVER w AS was_severity FROM run WINDOW w AS (PARTITION BY family ORDER BY ts, run_id)) WHERE prior_run_id IS NOT NULL))"""))
def confidence_trend(spark, sf_dir):
    return reconcile.trend(_table(spark, sf_dir, "run"), ["family"]).select("family", "run_id", "prior_run_id", F.round("confidence_delta", 9).alias("confidence_delta"), "severity_escalated", "ci_boundary_crossed", "verdict")


_COMPLETE = f"""filled AS (SELECT 'S' || s_suppkey AS entity, {', '.join(f"(SELECT count(*) FROM wanted w WHERE w.entity = 'S' || s_suppkey AND bucket = {_q(b)}) AS {b}" for b in respond.BUCKETS)} FROM supplier),
complete AS (SELECT *, calls_in_direct + calls_in_runtime + registrations_in > 0 AS t1, calls_out + structures + logs + owns > 0 AS t2, uses + registrations_out > 0 AS t3 FROM filled),
points AS (SELECT *, (CASE WHEN t1 THEN 5 ELSE 0 END + CASE WHEN t2 THEN 4 ELSE 0 END + CASE WHEN t3 THEN 1 ELSE 0 END) / 10 * 100 AS score FROM complete)"""


def _complete(spark, sf_dir) -> DataFrame:
    entities = _table(spark, sf_dir, "asked", "entity")
    return reconcile.completeness(_wanted(spark, sf_dir), entities)


@_query("completeness_scores", _duck(f"SELECT entity, t1 AS tier1_complete, t2 AS tier2_complete, t3 AS tier3_complete, score::DOUBLE AS completeness_score, ({' + '.join(f'({b} = 0)::INT' for b in respond.BUCKETS)})::INT AS missing, structures::BIGINT AS structures FROM points", _COMPLETE))
def completeness_scores(spark, sf_dir):
    return _complete(spark, sf_dir).select("entity", "tier1_complete", "tier2_complete", "tier3_complete", F.col("completeness_score").cast("double").alias("completeness_score"), F.size("missing_relations").alias("missing"), "structures")


@_query("completeness_audit", _duck("SELECT count(*)::BIGINT AS total_apis, round(avg(score), 1)::DOUBLE AS average_completeness_score, count(*) FILTER (t1 AND NOT t2 AND NOT t3)::BIGINT AS tier1_only, count(*) FILTER (t1 AND t2 AND NOT t3)::BIGINT AS tier1_and_2, count(*) FILTER (t1 AND t2 AND t3)::BIGINT AS tier1_and_2_and_3, sum(calls_out + structures + logs)::BIGINT AS total_relations FROM points", _COMPLETE))
def completeness_audit(spark, sf_dir):
    return reconcile.audit(_complete(spark, sf_dir)).select("total_apis", F.col("average_completeness_score").cast("double").alias("average_completeness_score"), "tier1_only", "tier1_and_2", "tier1_and_2_and_3", "total_relations")


@_query("completeness_follow_up", _duck("SELECT entity, score::DOUBLE AS completeness_score FROM points WHERE score < 70 ORDER BY score, entity LIMIT 10", _COMPLETE))
def completeness_follow_up(spark, sf_dir):
    return reconcile.needing_follow_up(_complete(spark, sf_dir)).select("entity", F.col("completeness_score").cast("double").alias("completeness_score"))


_JSON = lambda path: f"json_type(json, '$.{path}')"
_FILLED = lambda b: f"coalesce(json_array_length(json, '$.relations.{b}'), 0) > 0 AND {_JSON('relations.' + b)} = 'ARRAY'"
_BROKEN = [
    ("kind", f"NOT coalesce((json ->> '$.kind') IN ({', '.join(map(_q, reconcile.FAMILIES))}), false)"), ("canonical_name", f"{_JSON('canonical_name')} <> 'VARCHAR'"), ("aliases", f"{_JSON('aliases')} <> 'ARRAY'"), ("source", f"{_JSON('source')} <> 'OBJECT'"),
    ("source.line", f"{_JSON('source')} = 'OBJECT' AND CAST(json ->> '$.source.line' AS INT) <= 0"), ("relations", f"{_JSON('relations')} <> 'OBJECT'"), ("relations.structures", f"{_JSON('relations')} = 'OBJECT' AND {_JSON('relations.structures')} <> 'ARRAY'"), ("relations.uses", f"{_JSON('relations')} = 'OBJECT' AND {_JSON('relations.uses')} IS NULL"),
    *((f"relations[{'|'.join(needed)}]", f"{_JSON('relations')} = 'OBJECT' AND (json ->> '$.kind') = {_q(family)} AND NOT (" + " OR ".join(_FILLED(b) for b in needed) + ")") for family, needed in reconcile.FAMILIES.items()),
    ("contract", f"{_JSON('contract')} <> 'OBJECT'"), ("contract.required_directions", f"{_JSON('contract')} = 'OBJECT' AND {_JSON('contract.required_directions')} <> 'ARRAY'"),
]


@_query("schema_errors", _duck(" UNION ALL ".join(f"SELECT entity, {_q(field)} AS field, 'error' AS severity FROM fixture WHERE {broken}" for field, broken in _BROKEN) + " UNION ALL SELECT entity, 'description', 'warning' FROM fixture WHERE length(json ->> '$.description') < 10"))
def schema_errors(spark, sf_dir):
    return reconcile.schema_errors(_table(spark, sf_dir, "fixture"))


@_query("relation_verifier", duckdb_ctes() + ", " + """want AS (SELECT src AS entity, src, dst, edge_kind FROM ne WHERE edge_kind IN ('calls', 'imports') UNION ALL SELECT src, src, dst || '?', edge_kind FROM ne WHERE edge_kind IN ('extends', 'calls') UNION ALL SELECT src || '?', src, dst, edge_kind FROM ne WHERE edge_kind = 'extends')
SELECT entity, want, have, CASE WHEN entity NOT IN (SELECT canonical_name FROM nodes) THEN 'node-missing' WHEN have = want THEN 'pass' WHEN have > 0 THEN 'partial' ELSE 'fail' END AS status
FROM (SELECT w.entity, count(*)::BIGINT AS want, count(h.src)::BIGINT AS have FROM want w LEFT JOIN (SELECT DISTINCT src, dst, edge_kind FROM ne) h ON w.src = h.src AND w.dst = h.dst AND w.edge_kind = h.edge_kind GROUP BY w.entity)""")
def relation_verifier(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    e = lambda *kinds: g.of(*kinds).select(F.col("src").alias("entity"), "src", "dst", "edge_kind")
    odd = e("extends", "calls").withColumn("dst", F.concat("dst", F.lit("?")))
    unknown = e("extends").withColumn("entity", F.concat("entity", F.lit("?")))
    return reconcile.verify(e("calls", "imports").unionByName(odd).unionByName(unknown), g.named, g.nodes)


# Cached answers


@_query("cache_fresh", _duck("SELECT p_partkey AS part, sha256('f' || p_size || '.c:' || p_partkey || ':' || p_size) AS cache_key FROM part WHERE p_size % 7 <> 0 AND (p_size + 1) % 7 <> 0 AND p_size < 45"))
def cache_fresh(spark, sf_dir):
    """Parts as questions that rest on two files each; the files of every seventh size have changed, the largest can't be read."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = lambda k: F.concat(F.lit("f"), (F.col("p_size") + k).cast("string"), F.lit(".c"))
    asked = part.select(cache.cache_key(name(0), F.col("p_partkey"), F.col("p_size")).alias("cache_key"), F.col("p_partkey").alias("result"), F.array(name(0), name(1)).alias("evidence_files"))
    sizes = spark.range(60).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".c")).alias("file_path"), "id")
    content = lambda changed: F.concat(F.lit("v"), F.col("id").cast("string"), changed).cast("binary")
    then = cache.file_hashes(sizes.select("file_path", content(F.lit("")).alias("content")))
    now = cache.file_hashes(sizes.filter("id <= 45").select("file_path", content(F.when(F.col("id") % 7 == 0, "!").otherwise("")).alias("content")))
    return cache.fresh(cache.entries(asked, then), asked.drop("result"), now).select(F.col("result").alias("part"), "cache_key")


# Front ends, on sources that are made from the tables: a file for each part or supplier

_SOURCES = {
    "typescript": (
        """import { Base } from "./base"
import * as lib from "lib"
/** Part {x}. */
export class P{x} extends Base implements Named {
  size: Map<string, Base[]>
  note?: Named | null
  get(b: Base) { lib.fmt(this.size); this.note = b.make(); helper() }
}
interface Named { id: number }
enum Kind { A, B = 2 }
type Pair = Base | Named
function helper() { return new P{x}() }
const go = async () => { await helper(); JSON.parse("{}") }
""",
        """contains|M|M#P{x}|1|||4
contains|M#P{x}|M#P{x}.size|1|||5
contains|M#P{x}|M#P{x}.note|1|||6
contains|M#P{x}|M#P{x}.get|1|||7
contains|M|M#Named|1|||9
contains|M#Named|M#Named.id|1|||9
contains|M|M#Kind|1|||10
contains|M#Kind|M#Kind.A|1|||10
contains|M#Kind|M#Kind.B|1|||10
contains|M|M#Pair|1|||11
contains|M|M#helper|1|||12
contains|M|M#go|1|||13
imports|M|module:parts/base.ts|1|||1
imports|M|module:lib|1|||2
extends|M#P{x}|module:parts/base.ts#Base|1|named-import||4
implements|M#P{x}|M#Named|1|local||4
references_type|M#P{x}|module:parts/base.ts#Base|0.95|named-import||5
references_type|M#P{x}|M#Named|0.95|local||6
references_type|M#P{x}.get|module:parts/base.ts#Base|0.95|named-import||7
references_type|M#Pair|module:parts/base.ts#Base|0.95|named-import||11
references_type|M#Pair|M#Named|0.95|local||11
field_of_type|M#P{x}.size|module:parts/base.ts#Base|0.95|named-import|map.array|5
field_of_type|M#P{x}.note|M#Named|0.95|local|optional|6
aggregates|M#P{x}|module:parts/base.ts#Base|0.95|||4
aggregates|M#P{x}|M#Named|0.95|||4
calls|M#P{x}.get|module:lib#fmt|0.95|namespace-member||7
calls|M#P{x}.get|module:parts/base.ts#Base.make|0.95|param-member||7
calls|M#P{x}.get|M#helper|0.95|local||7
calls|M#helper|M#P{x}|0.95|constructor||12
calls|M#go|M#helper|0.95|local||13
calls|M#go|JSON.parse|0.7|member||13
reads_field|M#P{x}.get|M#P{x}.size|0.95|||7
writes_field|M#P{x}.get|M#P{x}.note|0.95|||7""",
        "parts/P{x}.ts", ("parts/base.ts", "export class Base {}"), TYPESCRIPT,
    ),
    "rust": (
        """use std::collections::HashMap;
use crate::base::Base;
pub struct P{x} { pub all: Vec<Base>, by: HashMap<String, Box<Kind>> }
enum Kind { Unit, Of(Base) }
trait Named { fn id(&self) -> Kind; }
impl Named for P{x} { fn id(&self) -> Kind { self.all.len(); self.by = Base::new(); helper(self.all) } }
fn helper(b: Base) -> Kind { crate::base::make(b); crate::gone::make(b); Kind::Of(b) }
""",
        """contains|M|M#P{x}|1|||3
contains|M#P{x}|M#P{x}.all|1|||3
contains|M#P{x}|M#P{x}.by|1|||3
contains|M|M#Kind|1|||4
contains|M#Kind|M#Kind.Unit|1|||4
contains|M#Kind|M#Kind.Of|1|||4
contains|M|M#Named|1|||5
contains|M|M#id|1|||5
contains|M#P{x}|M#P{x}.id|1|||6
contains|M|M#helper|1|||7
imports|M|module:std::collections#HashMap|1|||1
imports|M|module:crate::base#Base|1|||2
implements|M#P{x}|M#Named|1|||6
references_type|M#P{x}|module:src/base.rs#Base|0.95|named-import||3
references_type|M#P{x}|module:std::collections#HashMap|0.95|named-import||3
references_type|M#P{x}|M#Kind|0.95|local||3
references_type|M#Kind|module:src/base.rs#Base|0.95|named-import||4
references_type|M#Named|M#Kind|0.95|local||5
references_type|M#id|M#Kind|0.95|local||5
references_type|M#P{x}.id|M#Kind|0.95|local||6
references_type|M#helper|module:src/base.rs#Base|0.95|named-import||7
references_type|M#helper|M#Kind|0.95|local||7
field_of_type|M#P{x}.all|module:src/base.rs#Base|0.95|named-import|vec|3
field_of_type|M#P{x}.by|M#Kind|0.95|local|map.box|3
field_of_type|M#Kind.Of|module:src/base.rs#Base|0.95|named-import|direct|4
aggregates|M#P{x}|module:src/base.rs#Base|0.95|||3
aggregates|M#P{x}|M#Kind|0.95|||3
aggregates|M#Kind|module:src/base.rs#Base|0.95|||4
calls|M#P{x}.id|len|0.7|member||6
calls|M#impl_Named.id|len|0.7|member||6
calls|M#P{x}.id|module:src/base.rs#Base.new|0.95|scoped-named||6
calls|M#impl_Named.id|module:src/base.rs#Base.new|0.95|scoped-named||6
calls|M#P{x}.id|M#helper|0.95|local||6
calls|M#impl_Named.id|M#helper|0.95|local||6
calls|M#helper|module:src/base.rs#make|0.95|scoped-crate||7
calls|M#helper|crate::gone::make|0.7|scoped-bare||7
calls|M#helper|M#Kind.Of|0.95|scoped-local||7
reads_field|M#P{x}.id|M#P{x}.all|0.95|||6
writes_field|M#P{x}.id|M#P{x}.by|0.95|||6""",
        "src/p{x}.rs", ("src/base.rs", "pub struct Base;"), RUST,
    ),
    "c": (
        """#include <linux/irq.h>
#include "base.h"
struct p{x} { int n; struct base *b; };
static int read{x}(struct p{x} *p, base_t *t) { p->n = 1; if (p->b) pr_err("NET: bad"); return common(p, 2); }
int open{x}(struct p{x} *p)
{
    struct ops *o = 0;
    request_irq(5, read{x}, 0, "x", p);
    o->read = read{x};
    return unknown(p);
}
static const struct file_operations fops{x} = { .open = open{x}, .close = unknown };
""",
        """contains|F|p{x}|1|||3
contains|F|read{x}|1|||4
contains|F|open{x}|1|||5
imports|F|linux/irq.h|1|||1
imports|F|base.h|1|||2
field_of_type|p{x}.b|base|0.85||direct|3
aggregates|p{x}|base|0.85|||3
references_type|read{x}|p{x}|0.85|||4
references_type|read{x}|base_t|0.85|||4
references_type|open{x}|p{x}|0.85|||5
writes_field|read{x}|p.n|0.85|||4
reads_field|read{x}|p.b|0.85|||4
logs_event|read{x}|log:pr_err:4|0.9|||4
calls|read{x}|common|1|||4
writes_field|open{x}|o.read|0.85|||9
registers_callback|request_irq|read{x}|0.9|||8
registers_callback|o.read|read{x}|0.9|||9
registers_callback|fops{x}|open{x}|0.9|||12""",
        "drivers/p{x}.c", ("include/base.h", "struct base { int a; };\ntypedef struct { int a; } base_t;\nint common(struct base *b, int n) { return 0; }"), C,
    ),
}


def _files(spark: SparkSession, sf_dir: str, path: str, text: str) -> DataFrame:
    """A file for each part. The keys are dealt out before texts are made of them: a table of few bytes is read by one or two tasks, and its files take long to parse."""
    made = lambda t: F.replace(F.lit(t), F.lit("{x}"), F.col("p_partkey").cast("string"))
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return keys.select(made(path).alias("file_path"), made(text).alias("text"))


def _extracted(language: str):
    text, _, path, extra, producer = _SOURCES[language]

    def run(spark, sf_dir):
        files = _files(spark, sf_dir, path, text)
        files = files.unionByName(spark.createDataFrame([extra], "file_path string, text string"))
        found = producer.facts(spark, files, ("edge",), ("edge_kind", "src_symbol", "dst_symbol", "confidence", "resolution_kind", "tags", "site_file", "site_line")).filter(F.col("site_file") != extra[0])
        containment = F.when(F.col("tags").contains('"containment"'), F.get_json_object("tags", "$.containment"))  # few tags are parsed
        return found.select("edge_kind", "src_symbol", "dst_symbol", "confidence", "resolution_kind", containment.alias("containment"), F.col("site_line").alias("line"))

    return run


def _extracted_sql(language: str) -> str:
    _, edges, path, _, _ = _SOURCES[language]
    rows = ", ".join("(" + ", ".join(_q(x) if x else "NULL" for x in line.split("|")) + ")" for line in edges.splitlines())
    named = lambda c: f"replace(CASE WHEN {c} = 'F' THEN {_q(path)} WHEN {c} = 'M' OR starts_with({c}, 'M#') THEN {_q('module:' + path)} || substr({c}, 2) ELSE {c} END, '{{x}}', p_partkey::VARCHAR)"
    return f"SELECT k AS edge_kind, {named('s')} AS src_symbol, {named('d')} AS dst_symbol, c::DOUBLE AS confidence, h AS resolution_kind, t AS containment, l::BIGINT AS line FROM part, (VALUES {rows}) e(k, s, d, c, h, t, l)"


for _language in _SOURCES:
    _query(f"extract_{_language}", _extracted_sql(_language))(_extracted(_language))


@_query("extract_symbols", """SELECT symbol_kind, replace(replace(n, 'M', 'module:parts/P' || p_partkey || '.ts'), '{x}', p_partkey::VARCHAR) AS name, l::BIGINT AS line, e::BIGINT AS end_line, x AS exported, replace(d, '{x}', p_partkey::VARCHAR) AS doc
FROM part, (VALUES ('module', 'M', 1, 14, NULL, NULL), ('class', 'M#P{x}', 4, 8, true, '/** Part {x}. */'), ('field', 'M#P{x}.size', 5, NULL, NULL, NULL), ('field', 'M#P{x}.note', 6, NULL, NULL, NULL), ('method', 'M#P{x}.get', 7, 7, NULL, NULL),
  ('interface', 'M#Named', 9, 9, NULL, NULL), ('field', 'M#Named.id', 9, NULL, NULL, NULL), ('enum', 'M#Kind', 10, 10, NULL, NULL), ('enum_variant', 'M#Kind.A', 10, NULL, NULL, NULL), ('enum_variant', 'M#Kind.B', 10, NULL, NULL, NULL),
  ('typedef', 'M#Pair', 11, 11, NULL, NULL), ('function', 'M#helper', 12, 12, NULL, NULL), ('function', 'M#go', 13, 13, NULL, NULL)) s(symbol_kind, n, l, e, x, d)""")
def extract_symbols(spark, sf_dir):
    text, _, path, _, producer = _SOURCES["typescript"]
    return producer.facts(spark, _files(spark, sf_dir, path, text), ("symbol",), ("symbol_kind", "name", "line", "end_line", "exported", "doc"))
