"""Parsers, scanner, store, and the whole way from files to a graph."""
import io
import json
import subprocess

import pytest

from graphloom.config import Config
from graphloom.errors import EngineError, ParseFailed, StoreVersionError, UnsupportedLanguage
from graphloom.functions import text as X
from graphloom.plans import engine, tools
from graphloom.sources import git, scan, store
from graphloom.sources.parsers import default_registry
from graphloom.sources.parsers.go import Go

PARSERS = default_registry()


def parse(path, text):
    return PARSERS.parse(path, text.encode())


def defs(f):
    return {(n["label"], n["qualified_name"]) for n in f.nodes}


def test_typescript():
    f = parse("a.ts", "export function greet(name: string): string { return `hi ${name}`; }")
    (n,) = f.nodes
    assert (n["label"], n["name"], n["is_exported"], n["parameter_count"], n["return_type"], n["id"]) == ("Function", "greet", True, 1, "string", "a.ts::greet::1")
    f = parse("a.ts", "class User {\n  private name: string;\n  async load(a, b = [1, 2]) { return this.api.get(a); }\n  static of() {}\n}\nconst add = (a: number, b: number) => a + b;\nexport const go = async function () {};\ninterface S { area(): number }\nenum C { A }\nexport type Id = string;\nabstract class Q { abstract go(): void }")
    assert defs(f) == {("Class", "User"), ("Property", "User.name"), ("Method", "User.load"), ("Method", "User.of"), ("Function", "add"), ("Function", "go"), ("Interface", "S"), ("Enum", "C"), ("TypeAlias", "Id"), ("Class", "Q"), ("Method", "Q.go")}
    load = next(n for n in f.nodes if n["name"] == "load")
    assert (load["is_async"], load["parameter_count"], load["start_line"]) == (True, 2, 3)
    assert [(c["receiver"], c["callee_name"], c["caller_id"]) for c in f.calls] == [("this.api", "get", "a.ts::load::3")]


def test_typescript_imports_calls_heritage():
    f = parse("a.ts", "import { User, Role as UserRole } from './m';\nimport def from './d';\nimport * as ns from 'ns';\nimport './side';\nexport { X } from './x';\n// import { no } from './no'\nconsole.log(greet('a(b'), new User());\nclass Admin extends User implements A, B {}\ninterface I extends J {}")
    assert [(i["imported_name"], i["alias"], i["is_default"], i["is_namespace"], i["module_path"]) for i in f.imports] == [("User", None, False, False, "./m"), ("Role", "UserRole", False, False, "./m"), ("def", None, True, False, "./d"), ("ns", None, False, True, "ns"), ("*", None, False, True, "./side"), ("*", None, False, True, "./x")]
    assert {c["callee_name"] for c in f.calls} == {"log", "greet", "User"}
    assert [(h["child_id"], h["parent_name"], h["kind"]) for h in f.heritage] == [("a.ts::Admin::8", "User", "Extends"), ("a.ts::Admin::8", "A", "Implements"), ("a.ts::Admin::8", "B", "Implements"), ("a.ts::I::9", "J", "Extends")]


def test_javascript():
    f = parse("a.js", "import { x } from './x';\nclass A extends B { run() { x(); y.z(); } }\nconst f = (a) => a;\nfunction g() {}\nconst r = require('q');")
    assert defs(f) == {("Class", "A"), ("Method", "A.run"), ("Function", "f"), ("Function", "g")}
    assert len(f.imports) == 1 and len(f.calls) >= 2


def test_python():
    f = parse("a.py", "import os.path\nfrom m import x as y, z\nfrom .n import *\nclass Admin(User, ns.Base):\n    name: str = ''\n    def __init__(self, a): print(a)\n    @staticmethod\n    def of(x, y): return User(x)\n    def _hidden(self): pass\n@deco(1)\nasync def run(a, *b): pass")
    assert defs(f) == {("Class", "Admin"), ("Property", "Admin.name"), ("Method", "Admin.__init__"), ("Method", "Admin.of"), ("Function", "run")}
    by = {n["name"]: n for n in f.nodes}
    assert by["__init__"]["parameter_count"] == 1 and by["run"]["is_async"] and by["run"]["annotations"] == ["deco"] and by["of"]["is_static"]
    assert [(i["imported_name"], i["module_path"], i["alias"], i["is_namespace"]) for i in f.imports] == [("os.path", "os/path", None, True), ("x", "m", "y", False), ("z", "m", None, False), ("*", "./n", None, True)]
    assert {c["callee_name"] for c in f.calls} >= {"print", "User"}
    assert [(h["parent_name"], h["kind"]) for h in f.heritage] == [("User", "Extends")]
    assert parse("b.py", "def (:").nodes == []
    broken = parse("c.py", "class A:\n    def f(self):\n        x = = 1\n        return g(1).h()\n\ndef k(:\n    pass\n\ndef ok():\n    z[0].w()\n")
    assert defs(broken) == {("Class", "A"), ("Method", "A.f"), ("Function", "ok")}
    assert [(c["receiver"], c["callee_name"]) for c in broken.calls] == [("g(1)", "h"), (None, "g"), ("z[0]", "w")]
    with pytest.raises(ParseFailed):
        parse("d.py", "x = 1\0\n" * 3)


def calls(path, text):
    return [(c["receiver"], c["callee_name"], c["arguments_count"]) for c in parse(path, text).calls]


def test_receivers_are_whole_expressions():
    got = calls("a.ts", "a().b(); x[0].c(); this.d().e(1).g(2, 3); new Foo().bar(); new Q; new a.B(1); a?.b(); q!.r(); 'lit'.trim(); a\n  .b1()\n  .c1(); f(...h()); (a as T).z(); k(x < y, z > w); m<T>(1);")
    assert got == [
        (None, "a", 0), ("a()", "b", 0), ("x[0]", "c", 0), ("this", "d", 0), ("this.d()", "e", 1), ("this.d().e(1)", "g", 2), (None, "Foo", 0), ("new Foo()", "bar", 0), ("a", "b", 0), ("q!", "r", 0), ("'lit'", "trim", 0),
        ("a", "b1", 0), ("a\n  .b1()", "c1", 0), (None, "f", 1), (None, "h", 0), ("(a as T)", "z", 0), (None, "k", 2), (None, "m", 1), (None, "Q", 0),
    ]
    assert calls("a.ts", "s(`t ${inner(1, `u ${deep()}`)} v(x)`)") == [(None, "s", 1), (None, "inner", 2), (None, "deep", 0)]
    assert calls("a.go", "package s\nfunc f() { a.b().c(1); x[0].d(); v.(Q).m(); T{A: 1}.n(); if ok(a) { go run() } }") == [("a", "b", 0), ("a.b()", "c", 1), ("x[0]", "d", 0), ("v.(Q)", "m", 0), ("T{A: 1}", "n", 0), (None, "ok", 1), (None, "run", 0)]
    assert calls("a.rs", "fn f() { a.b()?.c(1); U::new(x).go(); std::io::read(); p!(\"{}\", self.k()); v![1, f()].it(); Vec::<u8>::w(1); \"s\".len(); }") == [
        (None, "p", 0), (None, "v", 0), ("a", "b", 0), ("a.b()?", "c", 1), ("U", "new", 1), ("U::new(x)", "go", 0), ("std::io", "read", 0), ("v![1, f()]", "it", 0), ("Vec::<u8>", "w", 1), ('"s"', "len", 0),
    ]


def test_members_that_are_no_calls():
    f = parse("a.ts", "const o = { meth(a, b) { deep(); }, async go(): void { }, k: f(1) };\ntype T = { h(): void, i(x): string };\nexport default class extends Q { mm() { g(); } }")
    assert [c["callee_name"] for c in f.calls] == ["deep", "f", "g"] and f.heritage == []
    assert defs(f) == {("Method", "meth"), ("Method", "go"), ("TypeAlias", "T"), ("Method", "mm")}


GO = 'package sample\n\nimport "fmt"\n\ntype Embedded struct {\n\tID string\n}\n\ntype User struct {\n\tEmbedded\n\tNameValue string\n}\n\ntype Repository interface {\n\tSave(user User) error\n}\n\nfunc NewUser(name string) User {\n\tfmt.Println(name)\n\treturn User{NameValue: name}\n}\n\nfunc (u User) Name() string {\n\treturn u.NameValue\n}\n\nfunc helper(a, b int) {}\n'


def test_go():
    f = parse("s.go", GO)
    assert defs(f) == {("Struct", "Embedded"), ("Struct", "User"), ("Interface", "Repository"), ("Method", "Repository.Save"), ("Function", "NewUser"), ("Method", "User.Name"), ("Function", "helper")}
    by = {n["name"]: n for n in f.nodes}
    assert by["NewUser"]["is_exported"] and not by["helper"]["is_exported"] and by["helper"]["parameter_count"] == 2
    assert [(c["receiver"], c["callee_name"]) for c in f.calls] == [("fmt", "Println")]
    assert [(h["child_id"], h["parent_name"]) for h in f.heritage] == [("s.go::User::9", "Embedded")]
    assert [(i["imported_name"], i["is_namespace"]) for i in f.imports] == [("fmt", True)]
    assert {h["parent_name"] for h in Go(named_fields=True).parse("s.go", GO.encode()).heritage} == {"Embedded", "string"}


def test_rust():
    f = parse("s.rs", "use crate::services::UserService as Service;\nuse std::{io, fmt::Display as D};\npub struct User { name: String }\npub trait Repository: Base + Send { fn save(&self, user: User); }\nimpl Repository for User {\n    fn save(&self, user: User) { println!(\"{}\", user.name()); }\n}\nimpl<'a> User { pub fn new(name: String) -> Self { Self { name } } pub fn name(&self) -> &str { &self.name } }\npub async fn build_user<'a>(x: &'a str) -> User { User::new(x) }\nmacro_rules! mm { () => {} }\nmod inner {}\ntype T = u8;\nenum E { A }")
    assert defs(f) >= {("Struct", "User"), ("Trait", "Repository"), ("Impl", "User"), ("Function", "build_user"), ("Method", "User.name"), ("Method", "Repository.save"), ("Macro", "mm"), ("Namespace", "inner"), ("TypeAlias", "T"), ("Enum", "E")}
    by = {n["name"]: n for n in f.nodes}
    assert by["build_user"]["is_async"] and by["build_user"]["is_exported"] and by["name"]["parameter_count"] == 0 and by["name"]["return_type"] == "&str"
    assert ("User", "new") in [(c["receiver"], c["callee_name"]) for c in f.calls] and "println" in [c["callee_name"] for c in f.calls]
    assert [(i["imported_name"], i["module_path"], i["alias"]) for i in f.imports] == [("UserService", "services", "Service"), ("io", "std", None), ("Display", "std/fmt", "D")]
    assert ("s.rs::User::3", "Repository", "Implements") in [(h["child_id"], h["parent_name"], h["kind"]) for h in f.heritage]


def test_registry():
    assert PARSERS.languages() == ["go", "javascript", "python", "rust", "typescript"]
    assert PARSERS.detect("a/b.kt") == "kotlin" and PARSERS.detect("a") is None
    with pytest.raises(UnsupportedLanguage):
        PARSERS.parse("a.kt", b"")


# --- scanning --------------------------------------------------------------------------------


def tree(at, files):
    for path, text in files.items():
        p = at / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return at


def paths(root, **more):
    return [p for p, _ in scan.walk(root, **more) if p.endswith(".ts")]


def test_walk(tmp_path):
    assert paths(tree(tmp_path / "a", {"node_modules/dep.ts": "", "main.ts": ""})) == ["main.ts"]
    assert paths(tree(tmp_path / "b", {".gitignore": "generated/\n*.gen.ts\n!keep.gen.ts\n# no\n", "generated/x.ts": "", "a.gen.ts": "", "keep.gen.ts": "", "main.ts": ""})) == ["keep.gen.ts", "main.ts"]
    assert paths(tree(tmp_path / "c", {"src/.gitignore": "skip.ts", "src/skip.ts": "", "src/keep.ts": "", "skip.ts": ""})) == ["skip.ts", "src/keep.ts"]
    root = tree(tmp_path / "d", {"real/x.ts": ""})
    (root / "link").symlink_to(root / "real")
    assert paths(root) == ["real/x.ts"]
    root = tree(tmp_path / "e", {".gitignore": "!dist", "dist/x.ts": ""})
    assert paths(root) == []  # settings can't be negated


def test_globs_and_rules():
    assert scan.glob("*.gen.ts", "a/b.gen.ts") and not scan.glob("a*", "ba") and scan.glob("*", "") and scan.glob("a*b*c", "a/x/b/c")
    assert scan.parse_rule("# c", "") is None and scan.parse_rule(r"\#x", "").pattern == "#x"
    assert scan.parse_rule("/x/", "b") == scan.Rule("x", "b", True, False)


def test_scan(spark, tmp_path):
    root = tree(tmp_path, {"a.ts": "x", "b.py": "y", "c.kt": "z", "d.txt": "", "big.ts": "x" * 99})
    got = scan.scan(spark, root, Config(max_file_size=50)).collect()
    assert sorted((r.relative_path, r.language, r.size) for r in got) == [("a.ts", "typescript", 1), ("b.py", "python", 1)]
    assert [r.relative_path for r in scan.scan(spark, root, languages=("python",)).collect()] == ["b.py"]
    assert scan.scan(spark, tree(tmp_path / "none", {"x.txt": ""})).count() == 0


def test_config():
    assert Config().max_processes == 200
    c = Config.from_env({"GG_MAX_FILE_SIZE": "7", "GG_WORKER_THREADS": "x"})
    assert c.max_file_size == 7 and c.worker_threads == Config().worker_threads


def test_percent():
    assert X.percent_decode(X.percent_encode("a b/c%")) == "a b/c%" and X.percent_encode(" ") == "%20"


# --- from files to a graph -------------------------------------------------------------------

FILES = {
    "src/models/user.ts": "export class User {\n  getName(): string { return fmt(this.name); }\n}\nexport function fmt(s: string): string { return s.trim(); }\n",
    "src/models/index.ts": "export { User } from './user';\n",
    "src/app.ts": "import { User, fmt as f } from './models/user';\nexport class Admin extends User { }\nexport function handleRequest() { const u = new User(); step2(); return f('x'); }\nfunction step2() { return step3(); }\nfunction step3() { return 1; }\n",
    "src/bad.py": "def (:\n",
}


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_analyze(spark, tmp_path):
    root, out = tree(tmp_path / "repo", FILES), str(tmp_path / "graph")
    reg = store.Registry(tmp_path / "registry.json")
    a = engine.analyze(spark, str(root), out, registry=reg)
    assert (a.files_scanned, a.added, a.full) == (4, 4, True)
    got = ids(a.graph.edges)
    assert len(got) == len(set(got))
    assert {
        "src/app.ts::handleRequest::3-[CALLS]->src/app.ts::step2::4", "src/app.ts::handleRequest::3-[CALLS]->src/models/user.ts::User::1", "src/app.ts::handleRequest::3-[CALLS]->src/models/user.ts::fmt::4",
        "src/app.ts::Admin::2-[EXTENDS]->src/models/user.ts::User::1", "file::src/models/index.ts-[IMPORTS]->file::src/models/user.ts", "folder::src-[CONTAINS]->file::src/app.ts",
    } <= set(got)
    assert reg.listing()[0]["name"] == "repo" and not reg.listing()[0]["stale"]
    assert a.graph.nodes.filter("label = 'Process'").count() == 1
    # nothing changed
    b = engine.analyze(spark, str(root), out)
    assert (b.files_scanned, b.unchanged) == (0, 4) and ids(b.graph.edges) == got
    # one file changed, one gone: as a first run would have it
    (root / "src/app.ts").write_text(FILES["src/app.ts"] + "export function main() { handleRequest(); }\n")
    (root / "src/models/index.ts").unlink()
    c = engine.analyze(spark, str(root), out)
    assert (c.modified, c.deleted, c.unchanged, c.full) == (1, 1, 2, False)
    d = engine.analyze(spark, str(root), str(tmp_path / "other"))
    assert ids(c.graph.edges) == ids(d.graph.edges) and ids(c.graph.nodes) == ids(d.graph.nodes)
    serve(spark, reg)
    interchange(spark, c.graph, out, tmp_path)
    assert store.clean(spark, str(root), out, reg) and reg.listing() == [] and not store.exists(spark, out)


def serve(spark, reg):
    """The tool server over the graph of test_analyze."""
    server = tools.Server(spark, reg)

    def ask(method, **params):
        return json.loads(server.line(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))

    assert ask("initialize")["result"]["serverInfo"]["name"] == "graphloom"
    assert server.line('{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == {"query", "context", "impact", "list_repos"}
    hits = json.loads(ask("tools/call", name="query", arguments={"query": "handleRequest"})["result"]["content"][0]["text"])
    assert hits[0]["name"] == "handleRequest"
    found = json.loads(ask("tools/call", name="impact", arguments={"name": "step3", "depth": 5})["result"]["content"][0]["text"])
    assert {"src/app.ts::step2::4", "src/app.ts::handleRequest::3"} <= {h["node_id"] for h in found}
    assert ask("tools/call", name="impact", arguments={"name": "x", "direction": "left"})["error"]["code"] == tools.PARAMS
    assert ask("nothing")["error"]["code"] == tools.METHOD
    assert json.loads(server.line("{"))["error"]["code"] == tools.PARSE
    uris = [r["uri"] for r in ask("resources/list")["result"]["resources"]]
    assert uris == ["graphloom://repos", "graphloom://repo/repo/graph"]
    whole = json.loads(ask("resources/read", uri=uris[1])["result"]["contents"][0]["text"])
    assert any(n["name"] == "Admin" for n in whole["nodes"])
    out = io.StringIO()
    server.serve(io.StringIO('\n{"id": 2, "method": "ping"}\n'), out)
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 2, "result": {}}


def interchange(spark, graph, out, tmp_path):
    hashes = store.load(spark, out)[1]
    at = str(tmp_path / "lines")
    store.write_json(graph, hashes, at)
    again, same = store.read_json(spark, at)
    row = lambda df: sorted(map(repr, df.collect()))
    assert row(again.nodes) == row(graph.nodes.select(*again.nodes.columns)) and row(again.edges) == row(graph.edges.select(*again.edges.columns)) and row(same) == row(hashes.select(*same.columns))
    spark.createDataFrame([('{"kind": "version", "version": 9}',)], "value string").write.text(str(tmp_path / "nine"))
    with pytest.raises(StoreVersionError):
        store.read_json(spark, str(tmp_path / "nine"))


def test_a_run_that_breaks_off_leaves_the_graph(spark, tmp_path):
    """Tables of a generation without a manifest don't count, and are gone after the next run."""
    root, out = tree(tmp_path / "repo", FILES), str(tmp_path / "graph")
    a = engine.analyze(spark, str(root), out)
    before = ids(a.graph.edges)
    (root / "src/app.ts").unlink()
    broken = store.Generation(spark, out, store.manifest(spark, out))
    broken.put(a.graph.nodes.limit(1), "nodes")
    assert ids(store.load(spark, out)[0].edges) == before
    (tmp_path / "graph/manifests/7.json").write_text('{"version": 1, "gen')  # cut off
    assert ids(store.load(spark, out)[0].edges) == before
    b = engine.analyze(spark, str(root), out)
    assert b.deleted == 1 and not (tmp_path / "graph" / broken.folder).exists()
    assert ids(b.graph.edges) == ids(engine.analyze(spark, str(root), str(tmp_path / "other")).graph.edges) != before


def test_a_comment_keeps_the_graph(spark, tmp_path):
    root, out = tree(tmp_path / "repo", FILES), str(tmp_path / "graph")
    engine.analyze(spark, str(root), out)
    first = store.manifest(spark, out)
    (root / "src/app.ts").write_text(FILES["src/app.ts"] + "// no fact\n")
    b = engine.analyze(spark, str(root), out)
    second = store.manifest(spark, out)
    assert (b.modified, b.files_scanned) == (1, 1) and second["tables"]["edges"] == first["tables"]["edges"] and second["tables"]["file_hashes"] != first["tables"]["file_hashes"]
    assert engine.analyze(spark, str(root), out).unchanged == 4


def test_communities_are_kept_where_calls_are_the_same(spark, tmp_path):
    root, out = tree(tmp_path / "repo", FILES), str(tmp_path / "graph")
    engine.analyze(spark, str(root), out)
    first = store.manifest(spark, out)
    (root / "src/models/index.ts").write_text("export { User } from './user';\nimport '../app';\n")
    b = engine.analyze(spark, str(root), out)
    second = store.manifest(spark, out)
    assert second["notes"] == first["notes"] and second["tables"]["edges"][0] != first["tables"]["edges"][0] and b.process_stats["total_processes"] == 1
    c = engine.analyze(spark, str(root), str(tmp_path / "other"))
    assert ids(b.graph.edges) == ids(c.graph.edges) and ids(b.graph.nodes) == ids(c.graph.nodes)
    (root / "src/app.ts").write_text(FILES["src/app.ts"].replace("step2(); ", ""))
    d = engine.analyze(spark, str(root), out)
    assert store.manifest(spark, out)["notes"]["digest"] != first["notes"]["digest"] and d.modified == 1


def test_walk_on_executors(spark, tmp_path):
    root = tree(tmp_path, {f"d{k}/e{k}/f{j}.ts": "" for k in range(6) for j in range(3)} | {".gitignore": "f1.ts\n", "d2/.gitignore": "!f1.ts\n", "top.ts": ""})
    want = sorted(p for p, _ in scan.walk(root) if p.endswith(".ts"))
    assert len(want) == 14
    for upper in (1, 2, 4, 100):
        assert sorted(r.relative_path for r in scan.listing(spark, root, upper=upper).collect()) == want


def test_empty_repository(spark, tmp_path):
    a = engine.analyze(spark, str(tree(tmp_path / "r", {"readme.txt": ""})), str(tmp_path / "g"))
    assert ids(a.graph.nodes) == ["project::root"] and a.graph.edges.count() == 0


def test_git(tmp_path):
    root = tree(tmp_path / "r", {"a.ts": "one"})
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "one")
    (root / "a.ts").write_text("two")
    assert (git.checkout(root, "HEAD", tmp_path / "out") / "a.ts").read_text() == "one"
    assert git.checkout(root, "WorkTree", tmp_path / "x") == root
    with pytest.raises(EngineError):
        git.resolve(root, "nothing")


def test_stream(spark, tmp_path):
    from graphloom.streaming import incremental

    schema = "relative_path string, language string, content binary, arrived long"
    inbox = str(tmp_path / "in")
    spark.createDataFrame([("a.py", "python", bytearray(b"def f(): pass\n"), 1), ("a.py", "python", bytearray(b"def g(): f()\n"), 2), ("b.py", "python", bytearray(b"x()\n"), 1)], schema).coalesce(1).write.parquet(inbox)
    seen = []

    def linked(state, number):
        seen.append((sorted(r.name for r in state.tables["nodes"].collect()), sorted(r.callee_name for r in state.tables["calls"].collect()), state.files.count()))

    def drain():
        q = incremental.follow(spark.readStream.schema(schema).parquet(inbox), str(tmp_path / "cp"), str(tmp_path / "facts"), linked)
        q.processAllAvailable()
        q.stop()

    drain()
    assert seen == [(["g"], ["f", "x"], 2)]
    # a stream that is started again goes on with the files of before; a batch that comes twice counts once
    spark.createDataFrame([("b.py", "python", None, 3), ("c.py", "python", bytearray(b"def h(): y()\n"), 3)], schema).coalesce(1).write.mode("append").parquet(inbox)
    drain()
    assert seen[1] == (["g", "h"], ["f", "y"], 2)
    state = incremental.FactTables(spark, str(tmp_path / "facts"), most_parts=2)
    batch = spark.createDataFrame([("d.py", "python", bytearray(b"z()\n"), 4)], schema)
    for _ in range(2):
        state.apply(batch, 2)
    assert sorted(r.callee_name for r in state.tables["calls"].collect()) == ["f", "y", "z"] and state.files.count() == 3
    assert len(store.manifest(spark, state.path)["tables"]["calls"]) == 1  # parts became one
