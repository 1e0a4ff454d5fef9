"""The engine: requests in, answers out, with enrichers run on a miss.

A request is validated, planned from the catalogue and collected up to its limit. If it misses,
deterministic enrichers run in order, a language-model one once and only if all of them failed, and
were no more than the policy's passes; each success is followed by another lookup, and if that
misses too, by the next enricher. Errors of a lookup are the answer's, never an empty hit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from stratagraph.operators import respond
from stratagraph.plans.catalog import CATALOG, Request, build
from stratagraph.plans.graph import Graph

# Other spellings of intents, what requests must have, how complete an answer is.
INTENT_ALIASES = {"who_calls": "who_calls_api", "where_struct_init": "where_struct_initialized"}
NEED_NAMES = (
    "who_calls_api", "who_calls_api_at_runtime", "why_api_invoked", "what_api_calls", "show_registration_chain", "show_dispatch_sites", "find_callback_registrars", "show_api_runtime_observations",
    "find_api_timer_triggers", "find_api_logs", "find_api_logs_by_level", "find_api_struct_writes", "find_api_struct_reads",
)
NEED_STRUCT = ("where_struct_initialized", "where_struct_modified", "find_struct_owners", "find_struct_readers", "find_struct_writers", "find_field_access_path")
NEED_MORE = {
    "find_field_access_path": ("field_name",), "show_runtime_flow_for_trace": ("trace_id",), "find_api_by_log_pattern": ("pattern",), "find_api_logs_by_level": ("log_level",),
    "show_cross_module_path": ("src", "dst"), "find_data_path": ("src", "dst"),
}
FACETS = ("runtime_callers", "runtime_callees", "runtime_structure_access", "runtime_logs", "runtime_timers")
COMPLETENESS = {"hit": "runtime_facet_data_fully_available", "not_found": "runtime_facet_data_not_yet_ingested"}
PARTIAL = "runtime_facet_data_partially_available"
MAX_STEPS = 12
MAX_PASSES = 2


@dataclass
class Enricher:
    """A named producer: run() returns whether it added anything to the graph it answers from."""

    name: str
    run: Callable[[Request], bool]
    is_model: bool = False


@dataclass
class Answer:
    status: str
    rows: list[dict] = field(default_factory=list)
    path: str = ""
    attempts: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    @property
    def facets(self) -> dict[str, str]:
        return dict.fromkeys((f"{f}_facet_completeness_status" for f in FACETS), COMPLETENESS.get(self.status, PARTIAL))


def parse_intent(text: str) -> str | None:
    """An intent's name in any case, with blanks or dashes for underscores, or another spelling of it; null if there is none."""
    name = re.sub(r"[\s-]+", "_", text.strip().lower())
    name = INTENT_ALIASES.get(name, name)
    return name if name in CATALOG else None


def problems(request: Request) -> list[str]:
    """What is wrong with a request."""
    out = []
    if request.intent not in CATALOG:
        out.append(f"unknown intent {request.intent}")
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x > 0
    if not whole(request.snapshot_id):
        out.append("snapshot_id must be a positive integer")
    if request.intent in NEED_NAMES and not any(request.names):
        out.append(f"{request.intent} needs names")
    if request.intent in NEED_STRUCT and not request.struct_name:
        out.append(f"{request.intent} needs struct_name")
    out += [f"{request.intent} needs {name}" for name in NEED_MORE.get(request.intent, ()) if not getattr(request, name)]
    for name in ("depth", "limit", "line_number"):
        if (value := getattr(request, name)) is not None and not whole(value):
            out.append(f"{name} must be a positive integer")
    return out


class Engine:
    def __init__(self, graph: Callable[[], Graph], enrichers: Sequence[Enricher] = ()):
        """graph: gives the graph to look in, anew after each enrichment."""
        self.graph, self.enrichers = graph, enrichers

    def _lookup(self, request: Request) -> list[dict]:
        rows = build(self.graph(), request).limit(request.limit)
        return [r.asDict(recursive=True) for r in respond.project(request.intent, rows).collect()]

    def query(self, request: Request) -> Answer:
        request.intent = parse_intent(request.intent) or request.intent
        if errors := problems(request):
            return Answer("error", errors=errors)
        try:
            rows = self._lookup(request)
            if rows:
                return Answer("hit", rows, "db_hit")
            return self._enrich(request)
        except Exception as e:  # whatever broke the lookup is what the caller gets to see
            return Answer("error", errors=[f"{type(e).__name__}: {e}"])

    def _enrich(self, request: Request) -> Answer:
        attempts: list[dict] = []
        for e in sorted(self.enrichers, key=lambda e: e.is_model)[:MAX_STEPS]:
            if e.is_model and (any(a["status"] != "failed" for a in attempts) or not 0 < len(attempts) <= MAX_PASSES):
                continue
            try:
                done = e.run(request)
                attempts.append({"enricher": e.name, "status": "success" if done else "failed"})
            except Exception as error:  # an enricher is foreign code
                done = False
                attempts.append({"enricher": e.name, "status": "failed", "error": str(error)})
            if done and (rows := self._lookup(request)):
                return Answer("llm_fallback" if e.is_model else "enriched", rows, "db_miss_llm_last_resort" if e.is_model else "db_miss_deterministic", attempts)
        return Answer("not_found", path="db_miss_deterministic", attempts=attempts)

    def callers(self, symbol: str, limit: int = 50) -> tuple[str, list[dict], list[dict]]:
        """The source that has callers of a symbol under any of its spellings, observed ones first, its callers and its registrars."""
        names = respond.aliases(symbol)
        for source, target in (("who_calls_api_at_runtime", None), ("who_calls_api", symbol)):
            rows = build(self.graph(), Request(source, names=names, limit=limit))
            found, registrars = respond.split_roles(respond.callers(rows, target))
            found, registrars = ([r.asDict() for r in x.collect()] for x in (found, registrars))
            if found or registrars:
                return source, found, registrars
        return "none", [], []

    def is_empty(self) -> bool:
        """Whether the snapshot has no edge at all."""
        return self.graph().edges.limit(1).isEmpty()

    def diagnostic(self) -> dict | None:
        """What to do if nothing can be found in the snapshot."""
        if not self.is_empty():
            return None
        return {"code": "empty_ready_snapshot_suspected", "path": "ingest_remediation_required"}
