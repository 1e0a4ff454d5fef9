"""What answers look like: projections, the node protocol, callers, and the spellings of symbols and paths.

Shaping a table of rows is column expressions, so that answers of any size are shaped where they are;
the functions with a text in and out are for names that a request brings.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the protocol: buckets of relations, kinds of nodes and edges, and what they are called at length.
BUCKETS = ("calls_in_direct", "calls_in_runtime", "calls_out", "registrations_in", "registrations_out", "structures", "logs", "owns", "uses")
#: The bucket that an intent's answer fills; intents that aren't listed fill `uses`.
INTENT_BUCKETS = {
    "calls_in_direct": ("who_calls_api",),
    "calls_in_runtime": ("who_calls_api_at_runtime", "why_api_invoked", "show_runtime_flow_for_trace", "show_api_runtime_observations", "show_hot_call_paths"),
    "calls_out": ("what_api_calls", "show_dispatch_sites", "show_cross_module_path"),
    "registrations_in": ("show_registration_chain", "find_callback_registrars"),
    "structures": (
        "find_struct_writers", "find_struct_readers", "where_struct_initialized", "where_struct_modified", "find_field_access_path", "find_api_struct_writes", "find_api_struct_reads", "find_field_type", "find_type_fields",
        "find_type_aggregates", "find_type_aggregators", "find_api_field_writes", "find_api_field_reads", "find_field_writers", "find_field_readers", "find_data_path", "find_struct_cycles", "find_api_data_footprint",
        "find_top_touched_types", "find_top_field_writers", "find_top_field_readers", "find_unused_fields", "find_top_hot_fields", "find_classes_by_field_count", "find_field_co_access",
    ),
    "logs": ("find_api_logs", "find_api_logs_by_level", "find_api_by_log_pattern"),
    "owns": ("find_struct_owners", "find_api_timer_triggers"),
}
KIND_VERBOSE = {
    "api": "application_programming_interface", "struct": "structure_type", "union": "union_type", "enum": "enumeration_type", "typedef": "typedef_alias", "class": "class_type", "field": "structure_field",
    "macro": "preprocessor_macro", "global_var": "global_variable", "param": "function_parameter", "thread": "thread_context", "signal": "signal_trigger", "interrupt": "interrupt_source", "timer": "timer_trigger",
    "ring": "ring_endpoint", "module": "module_boundary", "hw_block": "hardware_execution_block", "dispatch_table": "dispatch_table", "message": "inter_thread_message", "log_point": "log_emission_point",
    "enum_variant": "enum_variant_member", "interface": "interface_type", "method": "class_method", "namespace": "namespace_module",
}
KIND_ALIASES = {
    "function": "api", "global": "global_var", "globalvar": "global_var", "parameter": "param", "irq": "interrupt", "isr": "interrupt", "hardware_block": "hw_block", "hwblock": "hw_block",
    "message_queue": "message", "thread_message": "message", "message_function": "message", "log": "log_point", "variant": "enum_variant",
}
EDGE_NAMES = {
    "registers_callback": "register", "dispatches_to": "dispatch", "reads_field": "read", "writes_field": "write", "logs_event": "emit_log", "operates_on_struct": "use",
    "runtime_calls": "call_runtime", "indirect_calls": "call_runtime",
}
EDGE_VERBOSE = {
    "call_direct": "static_direct_calls", "call_runtime": "runtime_invokes_api", "register": "registers_callback_handler", "dispatch": "dispatches_execution_to_api", "read": "reads_structure_field",
    "write": "writes_structure_field", "init": "initializes_structure_state", "mutate": "mutates_structure_state", "owner": "owns_structure_entity", "use": "uses_dependency_entity",
    "inherit": "inherits_from_parent_type", "implement": "implemented_by_concrete_type", "emit_log": "emits_runtime_log_event",
}
LEGACY_EDGES = {"call_direct": "calls", "call_runtime": "indirect_calls", "register": "registers_callback", "dispatch": "dispatches_to", "read": "reads_field", "write": "writes_field", "emit_log": "logs_event"}
LEGACY_OTHER = "operates_on_struct"
RUNTIME_INTENTS = ("who_calls_api_at_runtime", "why_api_invoked", "show_runtime_flow_for_trace", "show_api_runtime_observations", "find_api_timer_triggers")
STRUCT_ROLES = {"find_struct_writers": "writer", "where_struct_modified": "writer", "find_struct_readers": "reader", "where_struct_initialized": "initializer", "find_struct_owners": "owner"}
INVOCATIONS = {"calls": "runtime_direct_call", "registers_callback": "runtime_callback_registration_call", "runtime_calls": "runtime_function_pointer_call", "dispatches_to": "runtime_dispatch_table_call"}
UNKNOWN_INVOCATION = "runtime_unknown_call_path"
CALLER_TYPES = {
    "calls": "direct_call", "api_call": "direct_call", "direct_call": "direct_call", "runtime_calls": "runtime_function_pointer_call", "indirect_calls": "runtime_function_pointer_call",
    "registers_callback": "interface_registration", "dispatches_to": "interface_registration", "interface_registration": "interface_registration",
    "runtime_direct_call": "runtime_direct_call", "runtime_callback_registration_call": "runtime_callback_registration_call", "runtime_function_pointer_call": "runtime_function_pointer_call", "runtime_dispatch_table_call": "runtime_dispatch_table_call",
}
ROLES = {"direct_call": "direct_caller", "interface_registration": "registrar"}


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _of(values: dict, key: Column, otherwise: str) -> Column:
    return F.coalesce(F.try_element_at(_map(values), key), F.lit(otherwise))


def intent_bucket(intent: str) -> str:
    return next((b for b, intents in INTENT_BUCKETS.items() if intent in intents), "uses")


def bucket_of(intent: Column) -> Column:
    return _of({i: b for b, intents in INTENT_BUCKETS.items() for i in intents}, intent, "uses")


def node_kind(kind: Column) -> Column:
    """The protocol's kind for a row's."""
    raw = F.regexp_replace(F.lower(F.coalesce(kind, F.lit("unknown"))), r"[\s-]+", "_")
    known = {k: k for k in KIND_VERBOSE} | KIND_ALIASES
    return _of(known, raw, "unknown")


def edge_name(edge_kind: Column, derivation: Column) -> Column:
    raw = F.lower(F.coalesce(edge_kind, F.lit("")))
    direct = F.when(F.lower(F.coalesce(derivation, F.lit(""))) == "runtime", "call_runtime").otherwise("call_direct")
    return F.when(raw.isin("calls", "api_call", "direct_call"), direct).otherwise(_of(EDGE_NAMES, raw, "call_runtime"))


def invocation(edge_kind: Column) -> Column:
    return _of(INVOCATIONS, F.coalesce(edge_kind, F.lit("")), UNKNOWN_INVOCATION)


def _have(rows: DataFrame, *names: str) -> Column:
    """The first of the columns that the rows have and that isn't null."""
    there = [F.col(n) for n in names if n in rows.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def project(intent: str, rows: DataFrame) -> DataFrame:
    """Rows of runtime and struct intents under their long names; others are as they are."""
    have = lambda *names: _have(rows, *names)
    place = [have("file_path").alias("file_path"), (F.col("line_number") if "line_number" in rows.columns else F.lit(None).cast("long")).alias("line_number")]
    sure = F.col("confidence").cast("double") if "confidence" in rows.columns else F.lit(None).cast("double")
    if intent in STRUCT_ROLES:
        role = STRUCT_ROLES[intent]
        out = [have(role).alias(f"current_structure_runtime_{role}_api_name"), have("target", "struct_name").alias("current_structure_runtime_target_structure_name")]
        out += [have("edge_kind").alias("current_structure_runtime_structure_operation_type_classification"), sure.alias("current_structure_runtime_structure_operation_confidence_score"), have("derivation").alias("current_structure_runtime_relation_derivation_source")]
        return rows.select(*out, *([F.col("access_path").alias("current_api_runtime_structure_access_path_expression")] if "access_path" in rows.columns else []))
    if intent not in RUNTIME_INTENTS:
        return rows
    if intent == "who_calls_api_at_runtime":
        same = [have(c).alias(c) for c in ("caller", "callee", "edge_kind", "derivation")]
        return rows.select(
            have("kind").alias("kind"), have("canonical_name", "caller").alias("canonical_name"), *same, sure.alias("confidence"), have("caller").alias("runtime_caller_api_name"), have("callee").alias("runtime_called_api_name"),
            invocation(have("edge_kind")).alias("runtime_caller_invocation_type_classification"), sure.alias("runtime_relation_confidence_score"), have("derivation").alias("runtime_relation_derivation_source"), *place,
        )
    if intent == "find_api_timer_triggers":
        score = F.coalesce(F.col("timer_trigger_confidence_score").cast("double"), sure) if "timer_trigger_confidence_score" in rows.columns else sure
        return rows.select(
            F.coalesce(have("kind"), F.lit("timer")).alias("kind"), have("canonical_name", "timer_identifier_name", "caller").alias("canonical_name"), have("caller", "timer_identifier_name", "canonical_name").alias("caller"), have("callee").alias("callee"),
            F.coalesce(have("edge_kind"), F.lit("runtime_calls")).alias("edge_kind"), score.alias("confidence"), have("derivation").alias("derivation"), *place, have("timer_identifier_name", "caller", "canonical_name").alias("current_api_runtime_timer_identifier_name"),
            have("timer_trigger_condition_description", "timer_condition").alias("current_api_runtime_timer_trigger_condition_description"), score.alias("current_api_runtime_timer_trigger_confidence_score"), have("derivation").alias("current_api_runtime_timer_relation_derivation_source"),
        )
    # an observation's names are those of its invoker and target, which the rows also call caller and callee
    invoker, target = have("immediate_invoker", "caller"), have("target_api", "callee")
    return rows.select(
        have("kind").alias("kind"), F.coalesce(have("canonical_name"), invoker, target).alias("canonical_name"), invoker.alias("caller"), target.alias("callee"), F.coalesce(have("edge_kind"), F.lit("runtime_calls")).alias("edge_kind"),
        F.coalesce(have("derivation"), F.lit("runtime")).alias("derivation"), sure.alias("confidence"), target.alias("target_api_name"), have("runtime_trigger").alias("runtime_trigger_event_description"),
        have("dispatch_chain").alias("runtime_execution_path_from_entrypoint_to_target_api"), invoker.alias("runtime_immediate_caller_api_name"), have("dispatch_site", "site_file").alias("runtime_dispatch_source_location"), sure.alias("runtime_confidence_score"), *place,
    )


def nodes(intent: str, rows: DataFrame, snapshot_id: int = 1, api_name: str | None = None) -> DataFrame:
    """Rows as nodes of the protocol, each with its one relation: the bucket that it is in and the edge's ends."""
    have = lambda *names: F.when(_have(rows, *names) != "", _have(rows, *names))
    asked = F.lit(api_name).cast("string")
    name = F.coalesce(have("canonical_name"), have("runtime_caller_api_name"), have("caller"), have("callee"), have("registrar"), have("callback"), F.lit("unknown"))
    kind = node_kind(_have(rows, "kind"))
    edge = edge_name(_have(rows, "edge_kind"), _have(rows, "derivation"))
    logs = F.lit(intent in ("find_api_logs", "find_api_logs_by_level"))
    logs = logs | ((kind == "log_point") & have("api_name").isNotNull()) if "api_name" in rows.columns else logs
    registers = F.lit(intent in ("show_registration_chain", "find_callback_registrars")) | F.coalesce(have("registrar"), have("callback"), have("registration_api")).isNotNull()
    outgoing = intent == "what_api_calls"
    src = F.when(logs, F.coalesce(have("api_name"), asked)).when(registers, F.coalesce(have("registrar"), name)).otherwise(F.coalesce(have("runtime_caller_api_name"), have("caller"), asked if outgoing else F.lit(None).cast("string")))
    dst = F.when(logs, name).when(registers, F.coalesce(have("callback"), asked)).otherwise(F.coalesce(have("callee"), name if outgoing else asked))
    edge = F.when(logs, "emit_log").when(registers, "register").otherwise(edge)
    is_source = F.coalesce(name == src, F.lit(False))
    incoming = F.when(edge == "call_direct", "calls_in_direct").otherwise("calls_in_runtime")
    bucket = (
        F.when(src.isNull() | dst.isNull(), F.lit(None)).when(logs, "logs").when(registers, F.when(is_source, "registrations_out").otherwise("registrations_in"))
        .when(edge.isin("read", "write", "init", "mutate"), "structures").when(edge == "use", "uses").when(is_source, "calls_out").otherwise(incoming)
    )
    sure = F.col("confidence").cast("double") if "confidence" in rows.columns else F.lit(None).cast("double")
    line = F.greatest(F.lit(1).cast("long"), F.coalesce(F.col("line_number").cast("long") if "line_number" in rows.columns else F.lit(None).cast("long"), F.lit(1).cast("long")))
    node_id = lambda c: F.concat(F.lit(f"{snapshot_id}:"), c)
    placed = lambda c: F.when(bucket.isNotNull(), c)
    out = rows.select(
        node_id(name).alias("node_id"), kind.alias("kind"), _of(KIND_VERBOSE, kind, "unknown_entity").alias("kind_verbose"), name.alias("canonical_name"), F.coalesce(have("file_path"), F.lit("unknown")).alias("file"), line.alias("line"),
        F.coalesce(sure, F.lit(0.7)).alias("overall_conf"), bucket.alias("bucket"), placed(edge).alias("edge_kind"), placed(src).alias("src_name"), placed(dst).alias("dst_name"),
        placed(F.coalesce(sure, F.when(logs | registers, 1.0).otherwise(0.7))).alias("edge_confidence"), placed(have("registration_api")).alias("register_call"),
    )
    return out.withColumn("edge_kind_verbose", F.try_element_at(_map(EDGE_VERBOSE), F.col("edge_kind"))).withColumns({"src_node_id": node_id(F.col("src_name")), "dst_node_id": node_id(F.col("dst_name"))})


#: Buckets whose edges a flat answer shows.
FLAT_BUCKETS = ("calls_in_runtime", "calls_in_direct", "calls_out", "registrations_in", "registrations_out", "structures", "logs")


def flat_edges(protocol: DataFrame) -> DataFrame:
    """The edges of protocol nodes, one for each (from, to, kind): the surest."""
    kind = _of(LEGACY_EDGES, F.col("edge_kind"), LEGACY_OTHER)
    e = protocol.filter(F.col("bucket").isin(*FLAT_BUCKETS)).select(F.col("src_node_id").alias("from"), F.col("dst_node_id").alias("to"), kind.alias("kind"), "edge_kind", "edge_confidence", "register_call")
    return e.groupBy("from", "to", "kind").agg(F.max(F.struct("edge_confidence", "edge_kind", "register_call")).alias("b")).select("from", "to", "kind", "b.edge_kind", F.col("b.edge_confidence").alias("confidence"), F.col("b.register_call").alias("via_registration_api"))


def flat_nodes(protocol: DataFrame) -> DataFrame:
    """Protocol nodes as flat rows: with what a caller or a struct access adds."""
    known = F.col("file") != "unknown"
    caller = (F.col("bucket") == "calls_in_runtime") & (F.col("src_node_id") == F.col("node_id"))
    struct = F.col("bucket") == "structures"
    how = F.when(F.col("edge_kind") == "dispatch", "runtime_dispatch_table_call").when(F.col("edge_kind") == "register", "runtime_callback_registration_call").when(F.col("edge_kind") == "call_direct", "direct_call").otherwise("runtime_function_pointer_call")
    return protocol.select(
        F.col("node_id").alias("id"), F.col("canonical_name").alias("symbol"), F.when(known, F.col("file")).otherwise("").alias("file_path"), F.col("line").alias("line_number"), "kind", F.col("overall_conf").alias("confidence"),
        F.when(caller, F.col("canonical_name")).alias("runtime_caller_api_name"), F.when(caller, how).alias("runtime_caller_invocation_type_classification"),
        F.when(struct, F.col("src_name")).alias("writer"), F.when(struct, F.col("dst_name")).alias("target"), F.when(struct, _of(LEGACY_EDGES, F.col("edge_kind"), LEGACY_OTHER)).alias("edge_kind"),
        F.when(struct, F.when(F.col("edge_kind").isin("write", "mutate"), "runtime").otherwise("static")).alias("derivation"),
    )


def canonical(symbol: str) -> str:
    """Without leading underscores and a ___SUFFIX; what would be empty stays as it is."""
    trimmed = symbol.strip()
    return re.sub(r"___[A-Za-z0-9_]+\Z", "", re.sub(r"^_+", "", trimmed)) or trimmed


def canonical_column(symbol: Column) -> Column:
    """canonical() of a column."""
    trimmed = F.trim(symbol)
    bare = F.regexp_replace(F.regexp_replace(trimmed, "^_+", ""), r"___[A-Za-z0-9_]+\z", "")
    return F.when(bare == "", trimmed).otherwise(bare)


def aliases(symbol: str) -> list[str]:
    """All spellings a symbol may be stored under, without repeats."""
    c = canonical(symbol)
    return list(dict.fromkeys([c, f"_{c}", f"__{c}", f"{c}___RAM", f"_{c}___RAM", f"{c}___ROM", f"_{c}___ROM", symbol]))


def alias_column(symbol: Column) -> Column:
    c = canonical_column(symbol)
    wrap = lambda before, after: F.concat(F.lit(before), c, F.lit(after))
    return F.array_distinct(F.array(c, wrap("_", ""), wrap("__", ""), wrap("", "___RAM"), wrap("_", "___RAM"), wrap("", "___ROM"), wrap("_", "___ROM"), symbol))


#: A variant's directories, with patch or orig below them and without; both stand for the sources.
_VARIANT = r"/(?:rom/[^/]+|v[0-9]+rom|ramv[0-9]+)/"
_STEPS = ((_VARIANT + r"(?:patch|orig)/", "/src/"), (_VARIANT, "/src/"), (r"_patch(?=\.[^./]+$)", ""))


def normal_path(path: str) -> str:
    """Variant directories and file names as those of the sources."""
    out = path.strip().replace("\\", "/")
    for pattern, new in _STEPS:
        out = re.sub(pattern, new, out)
    return out


def normal_path_column(path: Column) -> Column:
    out = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    for pattern, new in _STEPS:
        out = F.regexp_replace(out, pattern, new)
    return out


def callers(rows: DataFrame, target: str | None = None) -> DataFrame:
    """Rows of a caller intent as callers: name, place, role, invocation_type and confidence; one of each name and type, the surest.

    With a target, rows of the target itself are left out, as the static source does.
    """
    kind = F.coalesce(_have(rows, "runtime_caller_invocation_type_classification", "edge_kind"), F.lit("calls" if target else ""))
    how = _of(CALLER_TYPES, kind, "unknown")
    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(0.6 if target else 0.7))
    out = rows.select(canonical_column(_have(rows, "canonical_name", "caller")).alias("name"), normal_path_column(F.coalesce(_have(rows, "file_path"), F.lit(""))).alias("file_path"), F.coalesce(F.col("line_number") if "line_number" in rows.columns else F.lit(None).cast("long"), F.lit(0).cast("long")).alias("line_number"), how.alias("invocation_type"), sure.alias("confidence"))
    out = out.filter(F.coalesce(F.col("name"), F.lit("")) != "")
    if target is not None:
        out = out.filter(F.col("name") != canonical(target))
    best = out.groupBy("name", "invocation_type").agg(F.max_by(F.struct("file_path", "line_number", "confidence"), F.struct("confidence", "file_path", "line_number")).alias("b"))
    return best.select("name", "b.file_path", "b.line_number", _of(ROLES, F.col("invocation_type"), "runtime_caller").alias("caller_role"), "invocation_type", "b.confidence")


def split_roles(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Callers and registrars, each the surest first, then by name."""
    order = [F.col("confidence").desc(), "name", "invocation_type"]
    return found.filter("caller_role != 'registrar'").orderBy(*order), found.filter("caller_role = 'registrar'").orderBy(*order)
