"""Intents on a small graph with exact expected rows, and properties of the whole-graph operators."""

import pytest

from stratagraph.operators import paths, whole
from stratagraph.plans.catalog import CATALOG, Request, build
from stratagraph.plans.engine import Engine, Enricher, parse_intent, problems
from stratagraph.plans.graph import EDGE_DEFAULTS, graph_of

NODE = "node_id string, canonical_name string, kind string, file_path string, line long, end_line long, line_count long, exported boolean, doc string, owning_class string"
EDGE = "edge_id string, edge_kind string, src_node_id string, dst_node_id string, confidence double, derivation string, " + ", ".join(f"{k} {v}" for k, v in EDGE_DEFAULTS.items())
OBS = "observation_id string, node_id string, kind string, target_api string, immediate_invoker string, runtime_trigger string, dispatch_chain string, confidence double"

SYMBOLS = [
    ("foo", "function", "/src/a.c", 10, 20), ("bar", "function", "/src/b.c", 5, 9), ("baz", "function", "/src/c.c", 7, None), ("on_timer", "function", "/src/t.c", 1, 90), ("register_timer", "function", "/src/t.c", 100, 120),
    ("dispatch", "function", "/src/d.c", 3, 4), ("vdev", "struct", "/src/v.h", 1, 30), ("vdev.state", "field", None, None, None), ("vdev.flags", "field", None, None, None), ("vdev.unused", "field", None, None, None),
    ("LOG_INIT", "log_point", None, None, None), ("scan_timer", "timer", None, None, None), ("module:src/a.ts", "module", "src/a.ts", 1, 50), ("module:src/b.ts", "module", "src/b.ts", 1, 60),
    ("module:src/a.ts#Foo", "class", "src/a.ts", 2, 40), ("module:src/a.ts#Base", "class", "src/a.ts", 41, 49), ("module:src/a.ts#Foo.run", "method", "src/a.ts", 3, 30), ("module:src/b.ts#Named", "interface", "src/b.ts", 2, 6),
]
LINKS = [
    ("calls", "foo", "bar", {}), ("runtime_calls", "foo", "baz", {}), ("calls", "bar", "baz", {}), ("calls", "baz", "foo", {}), ("calls", "baz", "baz", {}), ("calls", "bar", "foo", {}),
    ("registers_callback", "register_timer", "on_timer", {"registration_api": "timer_register"}), ("dispatches_to", "dispatch", "on_timer", {}), ("runtime_calls", "scan_timer", "on_timer", {"timer_condition": "every 5 s"}),
    ("writes_field", "foo", "vdev.state", {"access_path": "v->state"}), ("reads_field", "bar", "vdev.flags", {}), ("writes_field", "bar", "vdev.state", {}), ("reads_field", "foo", "vdev.flags", {}),
    ("contains", "vdev", "vdev.state", {}), ("contains", "vdev", "vdev.flags", {}), ("contains", "vdev", "vdev.unused", {}), ("logs_event", "foo", "LOG_INIT", {"log_level": "ERROR", "template": "init failed: 100%"}),
    ("imports", "module:src/a.ts", "module:src/b.ts", {}), ("imports", "module:src/b.ts", "module:src/a.ts", {}), ("imports", "module:src/a.ts", "lodash", {}), ("contains", "module:src/a.ts", "module:src/a.ts#Foo", {}),
    ("contains", "module:src/a.ts", "module:src/a.ts#Base", {}), ("contains", "module:src/a.ts#Foo", "module:src/a.ts#Foo.run", {}), ("extends", "module:src/a.ts#Foo", "module:src/a.ts#Base", {}), ("implements", "module:src/a.ts#Foo", "module:src/b.ts#Named", {}),
]


@pytest.fixture(scope="module")
def g(spark):
    i = lambda n: f"graph_node:1:symbol:{n}"
    nodes = [(i(n), n, k, f, a, b, (b - a + 1) if b else None, k in ("class", "interface"), f"about {n}" if n.endswith("Foo") else None, None) for n, k, f, a, b in SYMBOLS]
    edges = [(f"e{j}", k, i(s), i(d), 0.9, "clangd", *(m.get(c) for c in EDGE_DEFAULTS)) for j, (k, s, d, m) in enumerate(LINKS)]
    obs = [("o1", i("on_timer"), "runtime_invocation", "on_timer", "dispatch", "timer", "tick -> dispatch -> on_timer", 0.8)]
    graph = graph_of(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame(obs, OBS))
    return type(graph)(graph.nodes.cache(), graph.edges.cache(), graph.observations)


def names(g, intent, column="canonical_name", **p):
    return [r[column] for r in build(g, Request(intent, **p)).collect()]


def test_all_84_intents_are_there():
    assert len(CATALOG) == 84


def test_callers_and_callees(g):
    assert names(g, "who_calls_api", names=["baz"]) == ["bar", "baz", "foo"]
    row = build(g, Request("who_calls_api", names=["bar"])).first()
    assert (row.caller, row.file_path, row.line_number) == ("foo", "/src/a.c", 10)
    assert names(g, "what_api_calls", names=["foo"]) == ["bar", "baz"]
    assert names(g, "who_calls_api", names=["nobody"]) == []


def test_observation_wins_over_edge(g):
    rows = {r.caller: r for r in build(g, Request("who_calls_api_at_runtime", names=["on_timer"])).collect()}
    assert rows["dispatch"].runtime_trigger == "timer" and rows["dispatch"].dispatch_chain.count("->") == 2 and "scan_timer" in rows


def test_logs(g):
    assert names(g, "find_api_logs_by_level", names=["foo"], log_level="ERROR") == ["LOG_INIT"]
    assert names(g, "find_api_logs_by_level", names=["foo"], log_level="WARN") == []
    assert names(g, "find_api_by_log_pattern", pattern="INIT_fail") == ["foo"]  # _ is a wildcard here


def test_struct_access(g):
    assert names(g, "find_struct_writers", struct_name="vdev.state") == ["bar", "foo"]
    assert names(g, "where_struct_initialized", struct_name="vdev.flags") == ["bar", "foo"]
    assert len(names(g, "find_field_access_path", struct_name="VDEV")) == 4
    assert build(g, Request("find_field_access_path", field_name="state")).filter("caller = 'foo'").first().access_path == "v->state"


def test_registration_dispatch_timer(g):
    assert build(g, Request("show_registration_chain", names=["on_timer"])).first().registration_api == "timer_register"
    assert names(g, "show_dispatch_sites", names=["on_timer"]) == ["dispatch"]
    assert build(g, Request("find_api_timer_triggers", names=["on_timer"])).first().timer_condition == "every 5 s"


def test_names_resolve_by_their_end(g):
    assert names(g, "find_class_inheritance", names=["Foo"]) == ["module:src/a.ts#Base"]
    assert names(g, "find_sibling_symbols", names=["Foo"]) == ["module:src/a.ts#Base"]


def test_search_is_literal_and_ignores_case(g):
    assert names(g, "find_symbols_by_name", pattern="FOO") == ["foo", "module:src/a.ts#Foo", "module:src/a.ts#Foo.run"]
    assert names(g, "find_symbols_by_name", pattern="%") == []
    assert names(g, "find_symbol_at_location", file_path="a.ts", line_number=5) == ["module:src/a.ts#Foo.run", "module:src/a.ts#Foo", "module:src/a.ts"]


def test_detectors(g):
    assert names(g, "find_unused_fields") == ["vdev.unused"]
    assert names(g, "find_external_imports") == ["lodash"]
    assert [(r.caller, r.callee) for r in build(g, Request("find_call_cycles")).collect()] == [("bar", "foo")]
    assert names(g, "find_recursive_methods") == ["baz"]
    assert [(r.caller, r.callee) for r in build(g, Request("find_import_cycles")).collect()] == [("module:src/a.ts", "module:src/b.ts")]


def test_field_pairs_need_two_callers(g):
    r = build(g, Request("find_field_co_access")).collect()
    assert [(x.caller, x.callee, x.co_count) for x in r] == [("vdev.flags", "vdev.state", 2)]


def test_paths(g):
    chain = build(g, Request("find_call_chain", src="foo", dst="baz")).collect()
    assert [(r.caller, r.callee) for r in chain] == [("foo", "bar"), ("bar", "baz")]
    assert build(g, Request("find_deepest_call_chain", names=["foo"])).first().path == "foo -> bar -> baz"
    assert [(r.canonical_name, r.depth) for r in build(g, Request("find_transitive_dependencies", names=["module:src/a.ts"])).collect()] == [("module:src/b.ts", 1)]
    assert build(g, Request("find_import_cycles_deep", names=["module:src/a.ts"])).first().cycle_length == 2
    hops = {(r.caller, r.callee, r.hop_distance) for r in build(g, Request("find_api_data_footprint", names=["foo"])).collect()}
    assert ("bar", "vdev.flags", 1) in hops and ("foo", "vdev.state", 0) in hops
    with pytest.raises(paths.TooManyPaths):
        paths.simple_paths(g, "foo", ("calls",), 3, max_paths=2)


def test_a_name_that_ends_another_is_not_a_cycle(spark):
    """Names are compared whole: b may follow ab on a path."""
    i = lambda n: f"graph_node:1:symbol:{n}"
    nodes = spark.createDataFrame([(i(n), n, "function", *[None] * 7) for n in ("ab", "c", "b")], NODE)
    edges = spark.createDataFrame([(f"{a}{b}", "calls", i(a), i(b), 1.0, "clangd", *[None] * len(EDGE_DEFAULTS)) for a, b in (("ab", "c"), ("c", "b"))], EDGE)
    g2 = graph_of(nodes, edges, spark.createDataFrame([], OBS))
    assert build(g2, Request("find_deepest_call_chain", names=["ab"])).first().path == "ab -> c -> b"


def test_missing_parameters_give_no_rows(g):
    assert build(g, Request("who_calls_api")).count() == 0 and build(g, Request("no_such_intent")).count() == 0


def test_whole_graph(g):
    w = whole.export(g)
    assert whole.diff(w, w).filter("change != 'common'").isEmpty()
    top = whole.top_by_degree(w, 3)
    assert top.nodes.count() == 3 and top.nodes.join(w.nodes, "id", "left_anti").isEmpty()
    assert whole.center(w, "Foo") == "module:src/a.ts#Foo" and whole.center_subgraph(w, "nothing like it").nodes.isEmpty()
    assert {r.id for r in whole.center_subgraph(whole.of_kinds(w, None, ["extends"]), "Foo", 1).nodes.collect()} == {"module:src/a.ts#Foo", "module:src/a.ts#Base"}
    board = whole.dashboard(g)
    assert board["edge_kinds"]["calls"] == 5 and "unused_fields" in whole.render(board, "markdown")
    assert whole.graph_json(w, "/ws", 1, whole.totals(g).first())["total_edges"] == len(LINKS)


def test_engine(g):
    assert parse_intent(" Who  calls -API ") == "who_calls_api" and parse_intent("who-calls") == "who_calls_api" and parse_intent("where struct init") == "where_struct_initialized" and parse_intent("callers") is None
    assert problems(Request("who_calls_api", limit=0, names=["a"])) and problems(Request("nope")) and problems(Request("who_calls_api", names=["a"], snapshot_id=0))
    assert problems(Request("show_runtime_flow_for_trace", names=["a"])) and not problems(Request("show_runtime_flow_for_trace", trace_id="t")) and not problems(Request("find_module_imports"))
    assert problems(Request("find_field_access_path", struct_name="s")) and not problems(Request("find_field_access_path", struct_name="s", field_name="f"))
    calls = []
    e = Engine(lambda: g, [Enricher("model", lambda r: calls.append("m") or False, True), Enricher("parser", lambda r: calls.append("p") or True)])
    assert e.query(Request("who_calls_api", names=["baz"])).status == "hit"
    missed = e.query(Request("who_calls_api", names=["nobody"]))
    assert missed.status == "not_found" and calls == ["p"]  # the model is asked only if all others failed
    assert e.query(Request("who_calls_api")).status == "error"
    assert missed.facets["runtime_logs_facet_completeness_status"] == "runtime_facet_data_not_yet_ingested" and missed.path == "db_miss_deterministic"
    e = Engine(lambda: g, [Enricher("model", lambda r: calls.append("m") or True, True), Enricher("parser", lambda r: calls.append("p"))])
    assert e.query(Request("who_calls_api", names=["nobody"])).status == "not_found" and calls == ["p", "p", "m"]
    source, callers, registrars = e.callers("_on_timer___RAM")
    assert source == "who_calls_api_at_runtime" and {c["name"] for c in callers} == {"dispatch", "scan_timer"} and not registrars
    assert not e.is_empty() and e.diagnostic() is None
    row = e.query(Request("who_calls_api_at_runtime", names=["on_timer"])).rows[0]
    assert row["runtime_caller_api_name"] == row["caller"] and row["runtime_caller_invocation_type_classification"] == "runtime_function_pointer_call"
