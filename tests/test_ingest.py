"""Facts to snapshots, streaming equality, reconciliation."""

import datetime as dt

from pyspark.sql import functions as F

from stratagraph.operators import ingest, reconcile, respond
from stratagraph.sources import files
from stratagraph.sources.store import SnapshotStore
from stratagraph.streaming import incremental


def facts(spark, rows):
    names = [p.split()[0] for p in ingest.FACTS.split(", ")]
    return spark.createDataFrame([tuple(({"seq": i, "produced_by": ["a"], "confidence": 1.0} | r).get(n) for n in names) for i, r in enumerate(rows)], ingest.FACTS)


SYMBOL = {"kind": "symbol", "symbol_kind": "function", "name": "f", "file_path": "a.c", "line": 1}
EDGE = {"kind": "edge", "edge_kind": "calls", "src_symbol": "f", "dst_symbol": "g", "derivation": "clangd"}


def test_validation(spark):
    bad = [{"kind": "symbol", "symbol_kind": "function"}, SYMBOL | {"confidence": 1.5}, SYMBOL | {"produced_by": []}, {"kind": "edge", "edge_kind": "calls"}, EDGE | {"derivation": None}, {"kind": "evidence", "source_kind": "file_line"}, {"kind": "type", "spelling": "int"}, {"kind": "what"}, SYMBOL | {"confidence": float("nan")}]
    good, rejected = ingest.validate(facts(spark, [SYMBOL, *bad]))
    assert good.count() == 1 and rejected.count() == len(bad) and rejected.filter("reason IS NULL").isEmpty()


def test_merge_takes_the_surest_and_all_producers(spark):
    rows = [SYMBOL | {"confidence": 0.5, "doc": "1"}, SYMBOL | {"confidence": 0.9, "doc": "2", "produced_by": ["b"]}, SYMBOL | {"confidence": 0.9, "doc": "3"}]
    m = ingest.merge(facts(spark, rows))
    r = m.first()
    assert (m.count(), r.doc, r.confidence, r.produced_by) == (1, "2", 0.9, ["a", "b"])
    elsewhere = [SYMBOL, SYMBOL | {"line": 2}, EDGE, EDGE | {"site_file": "a.c", "site_line": 3}]
    keys = sorted(r.fact_key for r in ingest.merge(facts(spark, elsewhere)).collect())
    assert keys == ["edge|calls|f->g|", "edge|calls|f->g|a.c:3", "symbol|function|f|a.c:1", "symbol|function|f|a.c:2"]
    again = ingest.merge(m.select(*[p.split()[0] for p in ingest.FACTS.split(", ")]))
    assert again.first().asDict() == r.asDict()


def test_snapshots_and_files(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    snap = store.begin("/ws", "abc", "1")
    assert store.latest_ready("/ws") is None and store.tables(snap)["nodes"].count() == 0
    rows = ingest.to_rows(ingest.merge(facts(spark, [SYMBOL, SYMBOL | {"name": "g", "file_path": "b.c"}, EDGE, EDGE | {"src_symbol": "g", "dst_symbol": "f"}])), snap)
    store.commit(snap, store.write(snap, rows))
    assert store.latest_ready("/ws") == snap and store.graph(snap).of("calls").count() == 2
    changed = spark.createDataFrame([("a.c",)], "file_path string")
    assert incremental.apply_batch(store, snap, changed, facts(spark, [SYMBOL | {"name": "f2"}]), "b1")
    assert not incremental.apply_batch(store, snap, changed, facts(spark, [SYMBOL | {"name": "again"}]), "b1")  # a batch that runs again
    g = store.graph(snap)
    assert {r.canonical_name for r in g.nodes.collect()} == {"f2", "g"}
    left = g.edges.collect()  # the edge from b.c stays, dangling; that from a.c is gone
    assert [(r.src, r.dst) for r in left] == [("g", None)]
    back = EDGE | {"src_symbol": "f2", "dst_symbol": "g", "source_kind": "file_line", "evidence_file": "a.c", "evidence_line": 4}
    incremental.sink(store, snap, lambda c: facts(spark, [SYMBOL, SYMBOL | {"name": "f2", "line": 9}, back]), many=1)(changed, 1)  # as one version again
    tables = store.tables(snap)
    assert {(r.canonical_name, r.line) for r in tables["nodes"].collect()} == {("f", 1), ("f2", 9), ("g", 1)} and {(r.src, r.dst) for r in store.graph(snap).edges.collect()} == {("g", "f"), ("f2", "g")} and tables["evidence"].count() == 1
    row = store.current().filter(f"snapshot_id = {snap}").first()
    assert row.version == 2 and row.deltas is None
    ids = [store.begin("/w2", "h", "1") for _ in range(2)]
    assert len(set(ids)) == 2
    other = store.begin("/ws", "abc", "2")
    store.fail(other, "no compiler")
    assert store.latest_ready("/ws") == snap


def test_runtime_chains(spark):
    schema = "target_api string, immediate_invoker string, runtime_trigger string, dispatch_chain array<string>, confidence double, source_kind string"
    rows = spark.createDataFrame([("t", "inv", "irq", ["x", "inv", "t"], 0.7, "log_line"), ("u", "inv", "irq", [], 0.5, None)], schema)
    out = {k: v.collect() for k, v in ingest.materialize_chains(rows, 1).items()}
    edges = {r.edge_id: r for r in out["edges"]}
    assert set(edges) == {"graph_edge:1:runtime_chain:0:x:inv", "graph_edge:1:runtime_invokes:inv:t", "graph_edge:1:runtime_invokes:inv:u"}
    assert edges["graph_edge:1:runtime_invokes:inv:t"].dst_node_id == "graph_node:1:symbol:t" and edges["graph_edge:1:runtime_invokes:inv:t"].chain_index == 1
    assert {(r.canonical_name, r.kind, r.role) for r in out["nodes"]} == {("t", "function", "target"), ("u", "function", "target"), ("inv", "unknown", "invoker"), ("x", "unknown", "trigger")}
    assert [r.edge_id for r in out["evidence"]] == ["graph_edge:1:runtime_invokes:inv:t"] and len(out["observations"]) == 2


def test_templates(spark):
    reg = spark.createDataFrame([("api", "cb", "k", None), ("ops", "cb2", "close", "static struct ops"), ("ops", "cb3", "read", "struct ops"), ("none", "cb4", "", None)], "registrar string, callback string, dispatch_key string, struct_type string")
    t = spark.createDataFrame([(1, "api", ["hw", "api", "%CALLBACK%"], "signal", "%KEY%"), (2, "__struct_field:ops.read", ["vfs->read", "%KEY%"], "event", "d")], "seq int, registration_api string, chain array<string>, trigger_kind string, trigger_description string")
    calls = ingest.runtime_calls(reg, t)
    got = {r.callback: (r.dispatch_chain, r.src_symbol, r.trigger_description) for r in calls.collect()}
    assert got == {"cb": (["hw", "api", "cb"], "api", "k"), "cb2": (["vfs->close", "close"], "vfs->close", "d"), "cb3": (["vfs->read", "read"], "vfs->read", "d")}
    nodes, edges = ingest.hardware_dispatch(calls, spark.createDataFrame([("IRQ", "interrupt", "hw")], "name string, kind string, step string"))
    assert [r.name for r in nodes.collect()] == ["IRQ"] and [(r.src_symbol, r.dst_symbol, r.position) for r in edges.collect()] == [("IRQ", "api", 0)]


def test_producers_run_beside_each_other(spark):
    class One:
        def __init__(self, rows, applies=True):
            self.rows, self.applies = rows, applies

        def applies_to(self, context):
            return self.applies

        def facts(self, spark, context):
            if self.rows is None:
                raise ValueError("broken")
            return facts(spark, self.rows)

    found, report = ingest.run_producers(spark, {"a": One([SYMBOL, EDGE]), "b": One(None), "c": One([], False)}, None)
    assert found.count() == 2 and [r["status"] for r in report] == ["ok", "failed", "skipped"] and report[0]["counts"] == {"symbol": 1, "edge": 1}


def test_linking(spark):
    nodes = spark.createDataFrame([("f", "function")], "canonical_name string, kind string")
    linked, rest = ingest.link_callers(spark.createDataFrame([("f",), ("nope",)], "target_api string"), nodes)
    assert linked.count() == 1 and rest.first().warning == "no symbol for nope"


def test_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(f"f{i % 3}", t + dt.timedelta(milliseconds=100 * i + 5000 * (i // 10))) for i in range(30)]
    df = spark.createDataFrame(rows, "file_path string, ts timestamp")
    end = spark.createDataFrame([("end", t + dt.timedelta(days=1))], "file_path string, ts timestamp")
    (tmp_path / "in").mkdir()
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.debounced(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = {(r.file_path, r.n) for r in incremental.debounced(df).collect()}
    assert {(r.file_path, r.n) for r in spark.table("bursts").filter("file_path != 'end'").collect()} == batch


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.c").write_text("int x;\nint y; // TODO\n")
    (tmp_path / "node_modules/b.c").write_text("TODO")
    assert [r.file_path for r in files.walk(spark, str(tmp_path), (".c",)).collect()] == ["src/a.c"]
    assert files.search(spark, str(tmp_path / "src"), "todo", ignore_case=True).count() == 1


RELATION = "entity string, bucket string, src string, dst string, edge_kind string, confidence double, derivation string, seq long"


def test_relations(spark):
    rows = [("e", "logs", "a", "b", "calls", 0.9, "llm", 1), ("e", "uses", "a", "b", "calls", 0.9, "clangd", 2), ("e", "uses", "a", "b", "calls", 0.9, "c_parser", 3), ("e", "uses", "a", "c", "calls", 0.4, "c_parser", 4), ("e", "uses", "a", "c", "calls", 0.4, "llm", 5)]
    once = {r.dst: r for r in reconcile.dedupe(spark.createDataFrame(rows, RELATION)).collect()}
    assert (once["b"].derivation, once["b"].bucket, once["b"].seq) == ("clangd", "uses", 1) and once["c"].derivation == "c_parser"
    have = spark.createDataFrame([("e", "uses", "x", "y", "calls", 0.5, "clangd", 9)], RELATION)
    assert [(r.src, r.dst, r.position) for r in reconcile.enrich(have, spark.createDataFrame(rows, RELATION)).orderBy("position").collect()] == [("a", "b", 1), ("x", "y", 2), ("a", "c", 3)]
    raw = spark.createDataFrame([("e", "what_api_calls", "", "f", "g", None, 0.0, None, 1)], "entity string, intent string, caller string, api string, callee string, edge_kind string, confidence double, derivation string, seq long")
    n = reconcile.normalized(raw).first()
    assert (n.bucket, n.src, n.dst, n.edge_kind, n.confidence, n.derivation) == ("calls_out", "f", "g", "unknown", 0.5, "clangd")
    c = reconcile.contracts(spark.createDataFrame([("e", b, "a", "b", k, 1.0, "clangd", 1) for b, k in (("structures", "write"), ("structures", "read"), ("calls_in_direct", "x"), ("calls_out", "x"), ("uses", "x"))], RELATION)).first()
    assert (c.required_relation_kinds, c.required_directions, c.minimum_buckets) == (["call_direct", "read", "write"], ["incoming", "outgoing"], ["calls_in_direct", "calls_out", "structures"])


def test_comparison(spark):
    want = spark.createDataFrame([("e", "calls_out", "a", "b", "x", 1.0, "clangd", 1), ("e", "calls_out", "a", "c", "x", 1.0, "clangd", 2), ("e", "structures", "a", "s", "write", 1.0, "clangd", 3)], RELATION)
    answers = spark.createDataFrame([("e", "what_api_calls", "hit", 2), ("e", "find_struct_writers", "error", 1), ("f", "who_calls_api", "not_found", 0)], "entity string, intent string, status string, items int")
    found = spark.createDataFrame([("e", "what_api_calls", "calls_out", "a", "b", "x"), ("e", "what_api_calls", "calls_out", "a", "z", "x"), ("e", "what_api_calls", "calls_out", "a", "z", "x"), ("e", "find_struct_writers", "structures", "a", "s", "write")], "entity string, intent string, bucket string, src string, dst string, edge_kind string")
    least = spark.createDataFrame([("e", "structures", 2), ("e", "calls_out", 2)], "entity string, bucket string, minimum long")
    diffs = reconcile.compare(want, answers, found, least)
    got = {(r.intent, r.field, r.expected, r.actual, r.severity, r.rule_id) for r in diffs.collect()}
    assert got == {
        ("what_api_calls", "rel.calls_out", "a|c|x", None, "S2", "EXTRA_RELATION"), ("what_api_calls", "rel.calls_out", None, "a|z|x", "S2", "EXTRA_RELATION"),
        ("find_struct_writers", "status", "hit|enriched", "error", "S0", "CONSISTENCY_STATUS"), ("find_struct_writers", "rel.structures (minimum_count)", ">=2", "1", "S3", "WEAK_EVIDENCE"),
        ("who_calls_api", "status", "hit|enriched", "not_found", "S0", "CONSISTENCY_STATUS"), ("who_calls_api", "data.items.length", ">0", "0", "S0", "MISSING_ITEMS"),
    }
    results = reconcile.results(answers, diffs)
    assert {(r.entity, r.intent): r.ci_outcome for r in results.collect()} == {("e", "what_api_calls"): "warn", ("e", "find_struct_writers"): "fail", ("f", "who_calls_api"): "fail"}
    total = reconcile.aggregate(reconcile.report(results)).first()
    assert (total.total_entities, total.fail_entities, total.ci_outcome) == (2, 2, "fail")
    page = reconcile.markdown(results, diffs, "now")
    assert "## CI Outcome: ❌ FAIL" in page and "| `rel.calls_out` | \"a|c|x\" | null | extra | S2 | `EXTRA_RELATION` |" in page
    odd = reconcile.classify(spark.createDataFrame([("rel.uses", "extra")], "field string, mismatch_type string")).first()
    assert (odd.severity, odd.rule_id, odd.outcome) == ("S3", "UNKNOWN_EXTRA_REL_USES", "pass")


def test_run_ids(spark):
    assert reconcile.run_id(["b", "a"]) == "run-0b873b0a"
    names = [("x", n) for n in ("alpha", "be_ta", "gamma")] + [("y", "a"), ("y", "b")]
    got = {r.run: r.run_id for r in reconcile.run_ids(spark.createDataFrame(names, "run string, entity string"), "run").collect()}
    assert got == {"x": reconcile.run_id(["alpha", "be_ta", "gamma"]), "y": "run-0b873b0a"}


def test_scores_and_trends(spark):
    scored = reconcile.score(spark.createDataFrame([("a", "x", 1.0, 1.0, 1.0, 1.0, False), ("b", "x", 1.0, 1.0, 1.0, 1.0, True), ("c", "y", 0.4, 0.6, 0.6, 0.5, False), ("d", "y", 0.7, 0.7, 0.7, 0.8, False)], "entity string, family string, coverage double, backend double, evidence double, consistency double, has_s0_s1 boolean"))
    rows = {r.entity: r for r in scored.collect()}
    assert [rows[k].outcome for k in "abcd"] == ["PASS", "FAIL", "FAIL", "WARN"] and [len(rows[k].hints) for k in "abcd"] == [0, 0, 5, 1]
    fam = {r.family: r for r in reconcile.families(scored).collect()}
    assert fam["x"].ci_outcome == "FAIL" and fam["y"].low_confidence_entities == ["c"]
    runs = [("r1", 1, 0.80, "S2"), ("r2", 2, 0.84, "S2"), ("r3", 3, 0.90, "S2"), ("r4", 4, 0.84, "S2"), ("r5", 5, 0.83, "S1"), ("r6", 6, 0.77, "none"), ("r7", 7, 0.80, "S3")]
    got = reconcile.trend(spark.createDataFrame(runs, "run_id string, ts long, confidence double, max_severity string")).orderBy("ts").collect()
    assert [(r.verdict, r.ci_boundary_crossed) for r in got] == [("STABLE", "none"), ("IMPROVING", "none"), ("THRESHOLD_BREACH", "PASS->WARN"), ("DEGRADING", "none"), ("DEGRADING", "none"), ("DEGRADING", "none")]
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    full = reconcile.completeness(spark.createDataFrame([("a", "calls_in_direct", "x", "y", "c", 1.0, "clangd", 1), ("a", "owns", "x", "y", "c", 1.0, "clangd", 1), ("b", "uses", "x", "y", "c", 1.0, "clangd", 1), ("b", "uses", "x", "z", "c", 1.0, "clangd", 1)], RELATION), entities)
    assert {r.entity: float(r.completeness_score) for r in full.collect()} == {"a": 90.0, "b": 10.0, "c": 0.0}
    audit = reconcile.audit(full).first()
    assert (audit.total_apis, audit.tier1_and_2, audit.total_relations, float(audit.average_completeness_score)) == (3, 1, 4, 33.3)
    assert [r.entity for r in reconcile.needing_follow_up(full).collect()] == ["c", "b"]


def test_forms(spark):
    buckets = ", ".join(f'"{b}": []' for b in respond.BUCKETS)
    good = '{"kind": "struct", "kind_verbose": "s", "canonical_name": "n", "aliases": [], "source": {"file": "f", "line": 3}, "description": "long enough", "relations": {' + buckets.replace('"structures": []', '"structures": [{}]') + "}}"
    rows = [("good", good), ("family", good.replace("[{}]", "[]")), ("line", good.replace("3}", "0}")), ("broken", "{"), ("list", "[]"), ("short", good.replace("long enough", "short")), ("null", None), ("what", good.replace('"struct"', '"what"'))]
    got = {}
    for r in reconcile.schema_errors(spark.createDataFrame(rows, "entity string, json string")).collect():
        got.setdefault(r.entity, []).append((r.field, r.severity))
    assert got == {"family": [("relations[structures]", "error")], "line": [("source.line", "error")], "broken": [("(root)", "error")], "list": [("(root)", "error")], "short": [("description", "warning")], "null": [("(root)", "error")], "what": [("kind", "error")]}
    want = spark.createDataFrame([("e", "logs", "a", "b", "calls", 0.9, "llm", 1), ("e", "uses", "a", "c", "calls", 1.0, "clangd", 2)], RELATION)
    have = spark.createDataFrame([("a", "b", "calls")], "src string, dst string, edge_kind string")
    assert reconcile.verify(want, have, spark.createDataFrame([("e",)], "canonical_name string")).first().status == "partial"


def test_spellings(spark):
    names = {"__foo___RAM": "foo", "foo___Ram": "foo", "___": "___", " _x ": "x", "a___b": "a", "": ""}
    paths = {"a/rom/b_patch.c": "a/rom/b.c", "/my/orig/f.c": "/my/orig/f.c", "/a/rom/x/patch/f_patch.c": "/a/src/f.c", "/a/v2rom/f.c": "/a/src/f.c", "\\a\\ramv3\\orig\\f.c": "/a/src/f.c", "/a/rom/x/f.c": "/a/src/f.c"}
    assert {n: respond.canonical(n) for n in names} == names and {p: respond.normal_path(p) for p in paths} == paths
    assert respond.aliases("_x") == ["x", "_x", "__x", "x___RAM", "_x___RAM", "x___ROM", "_x___ROM"] and len(respond.aliases("x___Q")) == 8
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", respond.canonical_column(F.col("n")).alias("c"), respond.alias_column(F.col("n")).alias("a"))
    assert all(r.c == names[r.n] and r.a == respond.aliases(r.n) for r in df.collect())
    assert all(r.c == paths[r.p] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", respond.normal_path_column(F.col("p")).alias("c")).collect())


def test_protocol(spark):
    rows = spark.createDataFrame([("function", "f", "f", "g", "calls", 0.9, "clangd", "/a.c", 0), ("IRQ", "i", "i", "g", "runtime_calls", None, "runtime", None, None), ("struct", "s", "w", "s", "writes_field", 0.5, "clangd", "a", 3)], "kind string, canonical_name string, caller string, callee string, edge_kind string, confidence double, derivation string, file_path string, line_number long")
    n = {r.canonical_name: r for r in respond.nodes("who_calls_api", rows, 3, "g").collect()}
    assert (n["f"].kind, n["f"].bucket, n["f"].edge_kind, n["f"].line, n["f"].src_node_id) == ("api", "calls_out", "call_direct", 1, "3:f")
    assert (n["i"].kind, n["i"].overall_conf, n["i"].file) == ("interrupt", 0.7, "unknown") and (n["s"].bucket, n["s"].edge_kind_verbose) == ("structures", "writes_structure_field")
    flat = respond.flat_edges(respond.nodes("who_calls_api", rows.unionByName(rows), 3, "g")).collect()
    assert {(r["from"], r["to"], r["kind"]) for r in flat} == {("3:f", "3:g", "calls"), ("3:i", "3:g", "indirect_calls"), ("3:w", "3:s", "writes_field")}
    regs = spark.createDataFrame([("cb", "reg", "cb", "timer_setup")], "canonical_name string, registrar string, callback string, registration_api string")
    r = respond.nodes("show_registration_chain", regs).first()
    assert (r.bucket, r.edge_kind, r.src_name, r.register_call, r.edge_confidence) == ("registrations_in", "register", "reg", "timer_setup", 1.0)
    callers, registrars = respond.split_roles(respond.callers(spark.createDataFrame([("_f", "calls", 0.5), ("f", "calls", 0.9), ("r", "registers_callback", 0.9), ("q", "what", None)], "canonical_name string, edge_kind string, confidence double")))
    assert [(x.name, x.caller_role, x.confidence) for x in callers.collect()] == [("f", "direct_caller", 0.9), ("q", "runtime_caller", 0.7)] and [x.name for x in registrars.collect()] == ["r"]
