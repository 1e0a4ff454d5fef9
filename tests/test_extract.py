"""Front ends: what they find in a file, and what joins with other files add."""

import json

import pytest

from stratagraph.extract import c, lexer, rust, typescript
from stratagraph.extract.facts import MARK, Facts
from stratagraph.extract.producers import RUST, TYPESCRIPT, C, registrations
from stratagraph.operators import ingest
from stratagraph.sources import files


def read(module, path, source, **options):
    f = Facts("t")
    module.extract(path, source, f, **options)
    name = lambda n: n.replace(f"module:{path}", "M") if n else n
    symbols = {name(r["name"]): r for r in f.rows if r["kind"] == "symbol"}
    edges = {(r["edge_kind"], name(r["src_symbol"]), name(r["dst_symbol"])): r for r in f.rows if r["kind"] == "edge"}
    return symbols, edges


def of(edges, kind):
    return {(s, d) for k, s, d in edges if k == kind}


TS = """import def, { a, b as c, type T } from "pkg"
import * as ns from "lib"
export * from "other"
/** Says hello. */
export class Foo<X extends T> extends Base implements Named {
  private x: Map<string, Foo[]> = new Map()
  y?: T | null
  constructor(private q: T) { super(q); this.x = y; this.x.get(1) }
  async run(t: T, n = c(1)): Promise<T> {
    t.go(); this.run(t); const v = new Foo(); v.run(t); ns.fmt`x${a(2)}`;
    if (this.y) { this.y++ }
    return await other.b.c(/re(g/.test(this.q))
  }
}
interface Named { name: string; f(x: Foo): T }
type U<V> = Foo | V | { k: T[] }
enum E { A, B = 2 }
export const go = async (f: Foo) => { f.run(); JSON.parse("a") }
export default function () { go(1) }
const w = other as Foo
function* gen() { yield* go(); w.zap() }
const o = { key: () => { a() }, m() { c() } }
namespace NS { export function inner() { def() } }
"""


def test_typescript_symbols():
    s, e = read(typescript, "a.ts", TS)
    kinds = {n: r["symbol_kind"] for n, r in s.items()}
    assert kinds == {
        "M": "module", "M#Foo": "class", "M#Foo.x": "field", "M#Foo.y": "field", "M#Foo.constructor": "method", "M#Foo.run": "method", "M#v": "global_var", "M#Named": "interface", "M#Named.name": "field", "M#U": "typedef",
        "M#E": "enum", "M#E.A": "enum_variant", "M#E.B": "enum_variant", "M#go": "function", "M#default": "function", "M#w": "global_var", "M#gen": "function", "M#m": "method", "M#NS": "namespace", "M#inner": "function",
    }
    foo = s["M#Foo"]
    assert (foo["line"], foo["end_line"], foo["exported"], foo["doc"]) == (5, 14, True, "/** Says hello. */") and s["M#Named"]["exported"] is None and s["M#Foo.run"]["owning_class"] == "Foo"
    assert json.loads(s["M#E.B"]["tags"]) == {"value": "2"}
    assert ("M#Foo", "M#Foo.run") in of(e, "contains") and ("M", "M#Foo") in of(e, "contains") and ("M#E", "M#E.A") in of(e, "contains")


def test_typescript_edges():
    _, e = read(typescript, "a.ts", TS)
    assert of(e, "imports") == {("M", "module:pkg"), ("M", "module:lib"), ("M", "module:other")}
    assert of(e, "extends") == {("M#Foo", "Base")} and e["extends", "M#Foo", "Base"]["confidence"] == 0.7 and e["implements", "M#Foo", "M#Named"]["confidence"] == 1.0
    kinds = {(s, d): r["resolution_kind"] for (k, s, d), r in e.items() if k == "calls"}
    assert kinds == {
        ("M", "Map"): "constructor", ("M#Foo.constructor", "super"): "raw", ("M#Foo.constructor", "this.x.get"): "member", ("M#Foo.run", "module:pkg#b"): "named-import", ("M#Foo.run", "module:pkg#T.go"): "param-member",
        ("M#Foo.run", "M#Foo.run"): "var-member", ("M#Foo.run", "M#Foo"): "constructor", ("M#Foo.run", "module:lib#fmt"): "namespace-member", ("M#Foo.run", "module:pkg#a"): "named-import", ("M#Foo.run", "other.b.c"): "member",
        ("M#Foo.run", "test"): "member", ("M#go", "M#Foo.run"): "param-member", ("M#go", "JSON.parse"): "member", ("M", "M#go"): "local", ("M#gen", "M#go"): "local", ("M#gen", "M#Foo.zap"): "var-member", ("M#key", "module:pkg#a"): "named-import",
        ("M#m", "module:pkg#b"): "named-import", ("M#inner", "module:pkg"): "default-import",
    }
    tags = lambda *k: json.loads(e[k]["tags"])
    assert tags("calls", "M#Foo.run", "other.b.c") == {"awaited": True} and tags("calls", "M#gen", "M#go") == {"yielded": True, "delegated": True} and tags("calls", "M#Foo.run", "module:lib#fmt") == {"tagged_template": True}
    assert tags("field_of_type", "M#Foo.x", "M#Foo") == {"containment": "map.array", "key_type": "string", "type_expr": "Map<string, Foo[]>"} and tags("field_of_type", "M#Foo.y", "module:pkg#T")["containment"] == "optional"
    assert of(e, "aggregates") == {("M#Foo", "M#Foo"), ("M#Foo", "module:pkg#T")}
    assert of(e, "writes_field") == {("M#Foo.constructor", "M#Foo.x"), ("M#Foo.run", "M#Foo.y")} and of(e, "reads_field") == {("M#Foo.constructor", "M#Foo.x"), ("M#Foo.run", "M#Foo.y")}
    assert {("M#U", "M#Foo"), ("M#U", "module:pkg#T"), ("M#Foo.run", "module:pkg#T"), ("M#w", "M#Foo"), ("M#Named", "M#Foo")} <= of(e, "references_type")
    assert e["references_type", "M#w", "M#Foo"]["confidence"] == 0.9


def test_jsx():
    _, e = read(typescript, "a.tsx", 'import {Card} from "c"\nexport function App({n}: P) { const q = <T,>(x: T) => x; return <div title="it\'s"><Card t="x" {...n} on={() => hit()}>don\'t <b.C/> {list.map(x => <Item key={x}/>)}</Card></div> }')
    assert of(e, "calls") == {("M#App", "module:c#Card"), ("M#App", "hit"), ("M#App", "b.C"), ("M#App", "list.map"), ("M#App", "Item")}
    assert json.loads(e["calls", "M#App", "module:c#Card"]["tags"]) == {"jsx_tag": "Card", "props": ["t", "on"], "has_spread": True}


RS = """use std::collections::{HashMap, hash_map::Entry as E};
pub struct Foo<'a, T: Clone> { pub a: Vec<Bar>, b: HashMap<String, &'a Bar>, c: Option<Box<dyn Named>> }
struct Pair(pub Bar, u32);
pub enum Bar { Unit, Tup(Foo, i32) }
trait Named { fn name(&self) -> Bar; }
impl<'a, T: Clone> Named for Foo<'a, T> where T: Copy {
    fn name(&self) -> Bar { self.a.push(1); self.b = x; let y = &mut self.c; let z = self.a; helper(1) }
}
impl Foo { pub fn new() -> Self { Foo::make("x").unwrap(); it.collect::<Vec<_>>(); HashMap::new(); a::b::c(1); match z { Some(q) => f(q), Bar::Tup(a, b) => 1 } } }
fn helper(v: Bar) -> Option<Foo> { println!("{}", deep()); 'a' }
"""


def test_rust():
    s, e = read(rust, "src/a.rs", RS)
    assert {n: r["symbol_kind"] for n, r in s.items()} == {
        "M": "module", "M#Foo": "struct", "M#Foo.a": "field", "M#Foo.b": "field", "M#Foo.c": "field", "M#Pair": "struct", "M#Pair.0": "field", "M#Pair.1": "field", "M#Bar": "enum", "M#Bar.Unit": "enum_variant", "M#Bar.Tup": "enum_variant",
        "M#Named": "interface", "M#name": "function", "M#Foo.name": "method", "M#Foo.new": "method", "M#helper": "function",
    }
    assert s["M#Foo"]["exported"] and s["M#Pair"]["exported"] is None
    assert of(e, "imports") == {("M", "module:std::collections#HashMap"), ("M", "module:std::collections::hash_map#Entry")} and of(e, "implements") == {("M#Foo", "M#Named")}
    containment = {(a, b): json.loads(r["tags"])["containment"] for (k, a, b), r in e.items() if k == "field_of_type"}
    assert containment == {("M#Foo.a", "M#Bar"): "vec", ("M#Foo.b", "M#Bar"): "map.ref", ("M#Foo.c", "M#Named"): "option.box.dyn_trait", ("M#Pair.0", "M#Bar"): "direct", ("M#Bar.Tup", "M#Foo"): "direct"}
    kinds = {(a, b): r["resolution_kind"] for (k, a, b), r in e.items() if k == "calls"}
    assert kinds == {
        ("M#Foo.name", "push"): "member", ("M#impl_Named.name", "push"): "member", ("M#Foo.name", "M#helper"): "local", ("M#impl_Named.name", "M#helper"): "local", ("M#Foo.new", "M#Foo.make"): "scoped-local", ("M#Foo.new", "unwrap"): "member",
        ("M#Foo.new", "collect"): "member", ("M#Foo.new", "module:std::collections#HashMap.new"): "scoped-named", ("M#Foo.new", "a::b::c"): "scoped-bare", ("M#Foo.new", "f"): "bare", ("M#helper", "deep"): "bare",
    }
    assert of(e, "writes_field") == {("M#Foo.name", "M#Foo.b"), ("M#Foo.name", "M#Foo.c")} and of(e, "reads_field") == {("M#Foo.name", "M#Foo.a")}


CC = """#include <linux/irq.h>
#include "b.h"
struct ops { int (*read)(int); };
struct dev { int x; struct ops *o; point_t at; };
static int my_read(struct dev *d, point_t *p) { d->x = 1; if (d->o->y == 2) { pr_err("BPF: bad %d\\n", d->x); } return helper(d, 2); }
int helper(struct dev *d, int n)
{
    struct ops *o = get();
    request_irq(5, my_read, helper, "x", d);
    o->read = my_read;
    dev_info(d->dev, "hello");
    return 0;
}
static const struct file_operations fops = { .read = my_read, .open = unknown };
SYSCALL_DEFINE3(read, int, fd)
{ return 0; }
"""


def test_c():
    s, e = read(c, "a.c", CC)
    assert {(n, r["symbol_kind"]) for n, r in s.items()} >= {("ops", "struct"), ("dev", "struct"), ("my_read", "function"), ("helper", "function"), ("__do_sys_read", "function")}
    assert of(e, "imports") == {("a.c", "linux/irq.h"), ("a.c", "b.h")} and ("a.c", "my_read") in of(e, "contains")
    log = e["logs_event", "my_read", "log:pr_err:5"]
    assert (log["log_level"], log["template"], log["subsystem"]) == ("ERROR", "BPF: bad %d\\n", "BPF") and e["logs_event", "helper", "log:dev_info:11"]["template"] == "hello"
    assert ("my_read", "d.x") in of(e, "writes_field") and ("my_read", "d->o.y") in of(e, "reads_field") and e["writes_field", "helper", "o.read"]["access_path"] == "o.read"
    assert ("syscall_dispatch", "__do_sys_read") in of(e, "runtime_calls")


def frame(spark, given):
    return spark.createDataFrame(list(given.items()), "file_path string, text string")


def test_c_targets_are_known_names(spark):
    found = C.facts(spark, frame(spark, {"a.c": CC, "t.h": "typedef struct { int a; } point_t;\n", "x.py": "no"})).collect()
    by = lambda kind: {(r.src_symbol, r.dst_symbol) for r in found if r.edge_kind == kind}
    assert by("calls") == {("my_read", "helper")}
    assert by("registers_callback") == {("request_irq", "my_read"), ("o.read", "my_read"), ("fops", "my_read"), ("syscall_table", "__do_sys_read")}
    assert by("references_type") == {("my_read", "dev"), ("my_read", "point_t"), ("helper", "dev")} and by("field_of_type") == {("dev.o", "ops"), ("dev.at", "point_t")} and by("aggregates") == {("dev", "ops"), ("dev", "point_t")}
    assert {r.spelling for r in found if r.kind == "type"} == {"ops", "dev", "point_t"}
    regs = registrations(C.facts(spark, frame(spark, {"a.c": CC}))).filter("registrar = 'o.read'").first()
    assert (regs.callback, regs.dispatch_key, regs.struct_type) == ("my_read", "read", "struct ops")


def test_imports_mean_files(spark):
    given = {
        "src/a.ts": 'import { f } from "./b"\nimport g from "../lib"\nimport { h } from "./gone"\nimport { k } from "./c.js"\nf(); g(); h(); k()', "src/b.tsx": "export const f = () => 1", "lib/index.ts": "", "src/c.ts": "", "bad.ts": "class {{{ ((",
    }
    found = TYPESCRIPT.facts(spark, frame(spark, given))
    a = found.filter("src_symbol = 'module:src/a.ts'").collect()
    assert {r.dst_symbol for r in a if r.edge_kind == "imports"} == {"module:src/b.tsx", "module:lib/index.ts", "module:src/gone", "module:src/c.ts"}
    assert {r.dst_symbol for r in a if r.edge_kind == "calls"} == {"module:src/b.tsx#f", "module:lib/index.ts", "module:src/gone#h", "module:src/c.ts#k"}
    assert found.filter("name = 'module:bad.ts'").count() == 1 and found.filter(f"dst_symbol LIKE '%{MARK}%'").isEmpty()
    rs = RUST.facts(spark, frame(spark, {"src/m.rs": "use crate::a::Thing;\nuse crate::zz::Gone;\nfn f() { crate::a::go(); crate::no::go(); Thing::new(); Gone::new(); }", "src/a.rs": "", "x.ts": ""}))
    calls = {r.dst_symbol: (r.confidence, r.resolution_kind) for r in rs.filter("edge_kind = 'calls'").collect()}
    assert calls == {"module:src/a.rs#go": (0.95, "scoped-crate"), "crate::no::go": (0.7, "scoped-bare"), "module:src/a.rs#Thing.new": (0.95, "scoped-named"), "module:crate::zz#Gone.new": (0.95, "scoped-named")}


def test_files_to_a_graph(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "src/a.ts").write_text('import { f } from "./b"\nexport function go() { f() }\n')
    (tmp_path / "src/b.ts").write_text("export function f() {}\n")
    (tmp_path / ".hidden/c.ts").write_text("export function hid() {}\n")
    found, report = ingest.run_producers(spark, {"ts": TYPESCRIPT, "rust": RUST}, str(tmp_path))
    assert [r["status"] for r in report] == ["ok", "skipped"] and report[0]["counts"]["symbol"] == 4
    good, bad = ingest.validate(found)
    rows = ingest.to_rows(ingest.merge(good), 1)
    assert bad.isEmpty() and rows["edges"].filter("edge_kind = 'calls' AND dst_node_id = 'graph_node:1:symbol:module:src/b.ts#f'").count() == 1
    assert rows["evidence"].count() == 1 and {r.name for r in ingest.captured(rows["nodes"]).collect()} == {"module:src/a.ts#go", "module:src/b.ts#f"}


def test_globs(spark, tmp_path):
    for p in ("src/a.ts", "src/deep/b.ts", "src/c.js", "d.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("let TODO = 1\nfoo.bar\n")
    paths = lambda *g: sorted(r.file_path for r in files.find(spark, str(tmp_path), list(g)).collect())
    assert paths("*.ts") == ["src/a.ts", "src/deep/b.ts"] and paths("src/*.{ts,js}") == ["src/a.ts", "src/c.js"] and paths("src/**", "!**/deep/**") == ["src/a.ts", "src/c.js"] and paths("?.md") == ["d.md"] and paths("[a-b].ts") == ["src/a.ts", "src/deep/b.ts"]
    hits = files.search(spark, str(tmp_path), "todo", ignore_case=True, globs=["*.ts"]).collect()
    assert {(r.file_path, r.line, r.column) for r in hits} == {("src/a.ts", 1, 5), ("src/deep/b.ts", 1, 5)}
    assert files.search(spark, str(tmp_path), "o.b", literal=True, globs=["d.md"]).count() == 1 and files.search(spark, str(tmp_path), "TOD", word=True).count() == 0
    assert {r.n for r in files.count_matches(spark, str(tmp_path), "o").collect()} == {1}


@pytest.mark.parametrize("source", ["", "`${", "<div>", "class", "import", "export {", "((([[[{{{", "const x = ", "a?.b?.(c", "\x00﻿", "x" * 50_000, "f(" * 300])
def test_odd_sources(source):
    for module, path in ((typescript, "a.tsx"), (typescript, "a.ts"), (rust, "a.rs"), (c, "a.c")):
        read(module, path, source)


def test_brackets_have_partners():
    t = lexer.script("f(`a${g({b: 1})}c`, [1])", False)
    assert all(t.match[t.match[k]] == k for k in t.match) and t.text.count("`") == 1 and len(t.match) == 10


def test_cached_answers_hold_while_their_files_do(spark):
    from pyspark.sql import functions as F

    from stratagraph.operators import cache

    hashes = lambda rows: spark.createDataFrame(rows, "file_path string, hash string")
    asked = spark.createDataFrame([("k1", "r1", ["a", "b"]), ("k2", "r2", ["b"]), ("k3", "r3", []), ("k4", "r4", ["gone"])], "cache_key string, result string, evidence_files array<string>")
    held = cache.entries(asked, hashes([("a", "1"), ("b", "2")]))
    fresh = lambda now: sorted(r.result for r in cache.fresh(held, asked.drop("result"), hashes(now)).collect())
    assert fresh([("a", "1"), ("b", "2")]) == ["r1", "r2", "r3"] and fresh([("a", "9"), ("b", "2")]) == ["r2", "r3"] and fresh([("a", "1")]) == ["r3"]
    assert cache.fresh(held.withColumn("schema_version", F.lit(0)), asked, hashes([("a", "1"), ("b", "2")])).count() == 0


def _parts(spark, folder, n=40):
    spark.range(n).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(folder / "part.parquet"))
    return str(folder)


def test_few_bytes_of_keys_are_parsed_by_many_tasks(spark, tmp_path):
    from stratagraph import row_queries
    from stratagraph.sources.tables import made

    before = len(made(spark))
    rows = row_queries.QUERIES["extract_typescript"](spark, _parts(spark, tmp_path))
    assert rows.count() == 40 * 33 and rows.filter("dst_symbol = 'module:parts/base.ts#Base.make'").count() == 40
    parsed = spark.read.parquet(made(spark)[before])
    assert len(parsed.inputFiles()) > 4


def test_symbols_alone_need_no_table(spark, tmp_path):
    from stratagraph import row_queries
    from stratagraph.sources.tables import made

    before = len(made(spark))
    assert row_queries.QUERIES["extract_symbols"](spark, _parts(spark, tmp_path)).count() == 40 * 13 and len(made(spark)) == before
    rows = TYPESCRIPT.facts(spark, frame(spark, {"a.ts": TS}), ("symbol",))
    assert {r.kind for r in rows.collect()} == {"symbol"} and rows.dtypes == TYPESCRIPT.facts(spark, frame(spark, {"a.ts": TS})).dtypes


def test_c_decides_what_its_own_file_defines(spark):
    f = Facts("c")
    c.extract("a.c", CC, f)
    needs = {(r["edge_kind"], r["src_symbol"], r["dst_symbol"]): r["needs"] for r in f.rows if r["kind"] == "edge"}
    assert needs["calls", "my_read", "helper"] is None and needs["references_type", "my_read", "dev"] is None and needs["references_type", "my_read", "point_t"] == "types" and needs["calls", "helper", "get"] == "functions"
    assert {d: n for (k, s, d), n in needs.items() if k == "registers_callback" and s == "request_irq"} == {"my_read": None}
    source = "int mine(void) { return 0; }\nint f(void) { request_irq(1, other, mine); return 0; }\n"
    called = lambda given: {r.dst_symbol for r in C.facts(spark, frame(spark, given)).filter("edge_kind = 'registers_callback'").collect()}
    assert called({"a.c": source}) == {"mine"} and called({"a.c": source, "b.c": "int other(void) { return 0; }"}) == {"other"}


def test_only_marked_paths_are_joined(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = RUST.facts(spark, frame(spark, {"src/m.rs": "use crate::a::Thing;\nfn f() { crate::a::go(); crate::zz::go(); Thing::new(); g(); }", "src/a.rs": ""}))
        assert {r.dst_symbol for r in found.filter("edge_kind = 'calls'").collect()} == {"module:src/a.rs#go", "crate::zz::go", "module:src/a.rs#Thing.new", "g"}
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_c_hands_over_only_what_is_asked_for(spark):
    from stratagraph.sources.tables import made

    files, asked = frame(spark, {"a.c": CC, "b.c": "int get(void) { return 0; }"}), ("edge_kind", "dst_symbol", "site_line", "evidence_file")
    before = len(made(spark))
    found = C.facts(spark, files, ("edge",), asked)
    assert found.columns == list(asked) and sorted(map(str, found.collect())) == sorted(map(str, C.facts(spark, files, ("edge",)).select(*asked).collect()))
    assert not {"template", "doc", "qualified_name", "otherwise_dst", "access_path"} & set(spark.read.parquet(made(spark)[before]).columns)


@pytest.mark.parametrize("source, texts, lines", [
    ('#define A \\\n b  \nx = "open \n', ["#define A \\\n b  ", "x", "=", '"open '], [1, 3, 3, 3]),
    ("a // note\n  /* more\n */ .5 + 'c' ; é # \n#", ["a", ".5", "+", "'c'", ";", "é", "#", "#"], [1, 3, 3, 3, 3, 3, 3, 4]),
])
def test_tokens_of_c_are_what_stands_there(source, texts, lines):
    t = lexer.c(source)
    assert t.text == texts and t.line == lines and [source[a:b] for a, b in zip(t.start, t.end)] == texts


def test_rust_hands_over_only_what_is_asked_for(spark):
    from stratagraph.sources.tables import made

    files, asked = frame(spark, {"src/m.rs": "use crate::a::Thing;\nfn f() { crate::a::go(); crate::zz::go(); Thing::new(); g(); }", "src/a.rs": ""}), ("edge_kind", "dst_symbol", "confidence", "site_line")
    before = len(made(spark))
    found = RUST.facts(spark, files, ("edge",), asked)
    assert found.columns == list(asked) and sorted(map(str, found.collect())) == sorted(map(str, RUST.facts(spark, files, ("edge",)).select(*asked).collect()))
    assert not {"seq", "evidence", "template", "access_path", "needs"} & set(spark.read.parquet(made(spark)[before]).columns)


def test_rust_types_without_an_end_end():
    s, _ = read(rust, "a.rs", "struct P { all: B }\ntrait Named { fn id(&self) -> fn; }\nimpl Named for P { fn id(&self) -> Kind { self.all.len() } }\nfn helper(b: B) -> Kind { go(b) }\n")
    assert "M#Named" in s
