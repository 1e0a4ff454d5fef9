"""The closed catalogue of intents: how each is built, and what a request must have."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from stratagraph.operators import detect, hops, paths, ranks, symbols
from stratagraph.plans.graph import Graph, empty

ROW = "kind string, canonical_name string, caller string, callee string, edge_kind string, confidence double, derivation string, file_path string, line_number long"


@dataclass
class Request:
    """What an intent may be asked with. Names are the api's and its aliases."""

    intent: str
    names: list[str] = field(default_factory=list)
    struct_name: str | None = None
    field_name: str | None = None
    src: str | None = None
    dst: str | None = None
    pattern: str | None = None
    log_level: str | None = None
    trace_id: str | None = None
    file_path: str | None = None
    line_number: int | None = None
    depth: int | None = None
    limit: int = hops.LIMIT
    snapshot_id: int = 1

    @property
    def name(self) -> str:
        return self.names[0]


@dataclass(frozen=True)
class Intent:
    build: Callable[[Graph, Request], DataFrame]
    #: Fields that must be set; without them the answer is empty.
    needs: tuple[str, ...] = ()


def _hop(intent: str) -> Intent:
    return Intent(lambda g, r: hops.hop(g, intent, r.names, r.limit), ("names",))


def _struct(intent: str) -> Intent:
    return Intent(lambda g, r: hops.hop(g, intent, [r.struct_name] if r.struct_name else r.names, r.limit), ("struct_name|names",))


def _top(edge_kind: str, kind: str | None = None) -> Intent:
    return Intent(lambda g, r: ranks.top_by_incoming(g, edge_kind, kind, r.limit))


def _cycle(edge_kind: str, kinds: tuple[str, ...], label: str) -> Intent:
    return Intent(lambda g, r: detect.two_cycles(g, edge_kind, kinds, label, r.limit))


_CALL, _DATA = ("calls",), ("field_of_type", "aggregates")
CATALOG: dict[str, Intent] = {name: _hop(name) for name in (*hops.HOPS, *hops.ALIASES)}
CATALOG |= {name: _struct(name) for name in ("find_struct_writers", "find_struct_readers", "find_struct_owners", "where_struct_modified", "where_struct_initialized")}
CATALOG |= {
    "who_calls_api_at_runtime": Intent(lambda g, r: hops.runtime_callers(g, r.names, r.limit), ("names",)),
    "why_api_invoked": Intent(lambda g, r: hops.observations(g, r.names, r.limit), ("names",)),
    "show_runtime_flow_for_trace": Intent(lambda g, r: hops.observations(g, r.names, r.limit, r.trace_id), ("names",)),
    "show_api_runtime_observations": Intent(lambda g, r: hops.observations(g, r.names, r.limit), ("names",)),
    "find_api_logs_by_level": Intent(lambda g, r: hops.hop(g, "find_api_logs", r.names, r.limit, r.log_level), ("names", "log_level")),
    "find_api_by_log_pattern": Intent(lambda g, r: hops.log_pattern(g, r.pattern, r.limit), ("pattern",)),
    "find_field_access_path": Intent(lambda g, r: hops.field_access_path(g, r.struct_name, r.field_name, r.limit), ("struct_name|field_name",)),
    "show_cross_module_path": Intent(lambda g, r: hops.cross_module_path(g, r.src, r.dst, r.limit), ("src", "dst")),
    "show_hot_call_paths": Intent(lambda g, r: hops.hot_call_paths(g, r.names, r.limit)),
    "find_sibling_symbols": Intent(lambda g, r: hops.sibling_symbols(g, r.name, r.limit), ("names",)),
    "find_module_interactions": Intent(lambda g, r: hops.module_interactions(g, r.src, r.dst, r.limit), ("src", "dst")),
    "find_symbols_by_name": Intent(lambda g, r: symbols.by_name(g, r.pattern, r.limit), ("pattern",)),
    "find_symbols_by_kind": Intent(lambda g, r: symbols.by_kind(g, r.pattern, r.limit), ("pattern",)),
    "find_symbols_by_doc": Intent(lambda g, r: symbols.by_doc(g, r.pattern, r.limit), ("pattern",)),
    "find_symbols_in_file": Intent(lambda g, r: symbols.in_file(g, r.file_path, r.limit), ("file_path",)),
    "find_symbol_at_location": Intent(lambda g, r: symbols.at_location(g, r.file_path, r.line_number, r.limit), ("file_path", "line_number")),
    "find_top_imported_modules": _top("imports", "module"),
    "find_top_called_functions": _top("calls"),
    "find_top_implemented_interfaces": _top("implements", "interface"),
    "find_largest_modules": Intent(lambda g, r: ranks.largest_modules(g, r.limit)),
    "find_long_functions": Intent(lambda g, r: ranks.long_functions(g, r.depth or 50, r.limit)),
    "find_modules_by_directory": Intent(lambda g, r: ranks.modules_by_directory(g, r.limit)),
    "find_classes_by_method_count": Intent(lambda g, r: ranks.members_per_type(g, ("class",), "method", "method_count", r.limit)),
    "find_classes_by_field_count": Intent(lambda g, r: ranks.members_per_type(g, ranks.TYPES, "field", "field_count", r.limit)),
    "find_widely_referenced_types": Intent(lambda g, r: ranks.widely_referenced_types(g, r.limit)),
    "find_tightly_coupled_modules": Intent(lambda g, r: ranks.tightly_coupled_modules(g, r.limit)),
    "find_top_touched_types": Intent(lambda g, r: ranks.top_touched_types(g, r.limit)),
    "find_top_field_writers": Intent(lambda g, r: ranks.top_field_accessors(g, "writes_field", r.limit)),
    "find_top_field_readers": Intent(lambda g, r: ranks.top_field_accessors(g, "reads_field", r.limit)),
    "find_top_hot_fields": Intent(lambda g, r: ranks.top_hot_fields(g, r.limit)),
    "find_field_co_access": Intent(lambda g, r: ranks.field_co_access(g, r.limit)),
    "find_unique_callers": Intent(lambda g, r: ranks.unique_callers(g, r.limit)),
    "find_god_methods": Intent(lambda g, r: ranks.god_methods(g, r.limit)),
    "find_module_top_exports": Intent(lambda g, r: ranks.module_top_exports(g, r.name, r.limit), ("names",)),
    "find_symbol_degree": Intent(lambda g, r: ranks.symbol_degree(g, r.name), ("names",)),
    "find_module_summary": Intent(lambda g, r: ranks.modules_overview(g, 1, r.name), ("names",)),
    "find_modules_overview": Intent(lambda g, r: ranks.modules_overview(g, r.limit)),
    "find_external_imports": Intent(lambda g, r: ranks.external_imports(g, r.limit)),
    "find_module_entry_points": Intent(lambda g, r: detect.module_entry_points(g, r.limit)),
    "find_orphan_modules": Intent(lambda g, r: detect.orphan_modules(g, r.limit)),
    "find_dead_exports": Intent(lambda g, r: detect.dead_exports(g, r.limit)),
    "find_undocumented_exports": Intent(lambda g, r: detect.undocumented_exports(g, r.limit)),
    "find_unused_fields": Intent(lambda g, r: detect.unused_fields(g, r.limit)),
    "find_import_cycles": _cycle("imports", ("module",), "imports"),
    "find_type_cycles": _cycle("references_type", ("class", "interface"), "references_type"),
    "find_struct_cycles": _cycle("aggregates", ("struct", "class", "interface"), "data_cycle"),
    "find_call_cycles": _cycle("calls", ("function", "method"), "call_cycle"),
    "find_recursive_methods": Intent(lambda g, r: detect.recursive_methods(g, r.limit)),
    "find_call_chain": Intent(lambda g, r: paths.shortest_path(g, r.src, r.dst, _CALL, paths.clamp(r.depth, 6, 1, 10), "calls"), ("src", "dst")),
    "find_data_path": Intent(lambda g, r: paths.shortest_path(g, r.src, r.dst, _DATA, paths.clamp(r.depth, 6, 1, 10), "data_path", "struct"), ("src", "dst")),
    "find_deepest_call_chain": Intent(lambda g, r: paths.deepest_chain(g, r.name, paths.clamp(r.depth, 8, 1, 12)), ("names",)),
    "find_transitive_dependencies": Intent(lambda g, r: paths.transitive(g, r.name, ("imports",), paths.clamp(r.depth, 10, 1, 20), r.limit), ("names",)),
    "find_import_cycles_deep": Intent(lambda g, r: paths.cycles_through(g, r.name, paths.clamp(r.depth, 5, 3, 8), r.limit), ("names",)),
    "find_api_data_footprint": Intent(lambda g, r: paths.data_footprint(g, r.name, paths.clamp(r.depth, 6, 1, 20), r.limit), ("names",)),
}


def lacking(request: Request) -> list[str]:
    """Which of the needed fields a request has none of."""
    return [n for n in CATALOG[request.intent].needs if not any(getattr(request, f) not in (None, "", []) for f in n.split("|"))]


def build(g: Graph, request: Request) -> DataFrame:
    """The plan of a request; an unknown intent or a missing field gives no rows."""
    if request.intent not in CATALOG or lacking(request):
        return empty(g.spark, ROW)
    return CATALOG[request.intent].build(g, request)
