"""The data model: a snapshot-versioned property multigraph in five tables."""

from __future__ import annotations


# Fixed values of the domain: the vocabularies that facts and rows are written in.
EDGE_KINDS = (
    "calls", "runtime_calls", "registers_callback", "dispatches_to", "reads_field", "writes_field", "uses_macro", "logs_event",
    "operates_on_struct", "imports", "contains", "extends", "implements", "references_type", "field_of_type", "aggregates",
)
SYMBOL_KINDS = (
    "function", "struct", "union", "enum", "typedef", "macro", "global_var", "field", "param", "class", "interface", "namespace",
    "module", "method", "enum_variant",
)
RUNTIME_KINDS = ("api", "thread", "signal", "interrupt", "timer", "ring", "module", "hw_block", "dispatch_table", "message", "log_point", "unknown")
DERIVATIONS = ("clangd", "llm", "runtime", "hybrid")
LOG_LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "VERBOSE", "TRACE", "UNKNOWN")
EVIDENCE_SOURCES = ("file_line", "clangd_response", "log_line", "runtime_parser")
SNAPSHOT_STATUS = ("building", "ready", "failed")
FACT_KINDS = ("symbol", "type", "aggregate-field", "edge", "evidence", "observation")
RESPONSE_STATUS = ("hit", "enriched", "llm_fallback", "not_found", "error")




#: As DDL text, since parsing needs a session. Nested values that queries read are columns of their own.
SNAPSHOTS = "snapshot_id long, workspace_root string, compile_db_hash string, parser_version string, source_revision string, status string, created_at timestamp, ready_at timestamp, failed_at timestamp, fail_reason string, fingerprint string, metadata string"
NODES = "snapshot_id long, node_id string, canonical_name string, kind string, file_path string, line long, end_line long, line_count long, exported boolean, doc string, owning_class string, payload string"
EDGES = "snapshot_id long, edge_id string, edge_kind string, src_node_id string, dst_node_id string, confidence double, derivation string, log_level string, template string, subsystem string, registration_api string, site_file string, site_line long, access_path string, timer_condition string, resolution_kind string, metadata string"
EVIDENCE = "snapshot_id long, evidence_id string, edge_id string, node_id string, source_kind string, file_path string, line long, payload string"
OBSERVATIONS = "snapshot_id long, observation_id string, node_id string, kind string, observed_at timestamp, confidence double, target_api string, immediate_invoker string, runtime_trigger string, dispatch_chain string, site_file string, site_line long, payload string"
TABLES = {"nodes": NODES, "edges": EDGES, "evidence": EVIDENCE, "observations": OBSERVATIONS}


def names_of(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]
