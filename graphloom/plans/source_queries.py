"""Queries of the parsers (P1-P8, P10-P18): five source texts for each part, and the facts that they hold, as an oracle.

The texts are written here with § for the part's key and §7 for its remainder by 7; so are the facts, by hand, so that
SQL needs no parser.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import facts
from ..sources.parsers import default_registry
from ..sources.parsers.base import File
from ..staging import staged
from .bench_views import Views
from .registry import query

TEXTS = {
    "ts/f§.ts": """\
import { Widget as W§, Gear } from './w§7';
import def§ from "pkg/d";
import * as ns from 'ns§7';
import './side';
export { X } from './x§7';
// import { no } from './no'
export class C§ extends B§7 implements I§7, J {
  private size: number;
  static make(a: string, b = [1, 2]): C§ { return new C§(a); }
  async load(key) { this.api.get(key); mk().run(1).go(); arr[0].call(`x ${inner(key)} y`); }
}
export interface S§ { area(): number }
enum E§ { A }
export type T§ = string;
export const add§ = (a: number, b: number): number => a + b;
function hidden§() { return helper§7({ meth() { deep(); } }); }
abstract class Q§ extends C§ { abstract go(): void }
""",
    "js/f§.js": """\
import { a§ } from './a§7';
const r = require('q');
export class K§ extends P§7 { run(x) { x.y(§); } }
export default function main§(a, b) { return new K§(); }
const f§ = (a) => g(a);
""",
    "py/f§.py": """\
import os.path
from m§7 import x as y§, z
from .n§ import *
class A§(U§7, ns.Base):
    name: str = ''
    def __init__(self, a): print(a)
    @staticmethod
    def of(x, y):
        return U§7(x).go()[0].end()
    def _hidden(self): pass
@deco(1)
async def run§(a, *b):
    x = = 1
    return h(a)
""",
    "go/f§.go": """\
package s
import "fmt"
import al "pkg/p§7"
type Base§ struct { ID string }
type User§ struct {
	Base§
	Name string
}
type Repo§ interface {
	Save(u User§) error
}
func New§(name string, n int) User§ {
	fmt.Println(name, al.F(n).G())
	return User§{Name: name}
}
func (u User§) get() string { return rows[0].Load() }
""",
    "rs/f§.rs": """\
use crate::services::Svc§ as S;
use std::{io, fmt::Display as D};
pub struct User§ { name: String }
pub trait Repo§: Base§7 + Send { fn save(&self, user: User§); }
impl Repo§ for User§ {
    fn save(&self, user: User§) { self.db()?.put(user.id(), §); println!("{}", user.name()); }
}
impl User§ { pub fn new(name: String) -> Self { check(name).ok() } }
pub async fn build§(x: u8) -> User§ { User§::new(list[0].key()) }
mod inner§ {}
enum E§ { A }
""",
}

#: Files of languages without a parser, and of none.
OTHERS = {"kt/f§.kt": "fun f§() {}\nval x = 1\nfun g() {}\n", "doc/f§.txt": "text §\n"}


def _values(rows: str, *names: str) -> str:
    """A table of the lines of `rows`, cells parted by |, for each part; an empty cell is null, and a cell of ~ an empty text."""
    cells = [[c.strip() for c in line.split("|")] for line in rows.strip().splitlines()]
    quoted = lambda c: "''" if c == "~" else "NULL" if c == "" else "'" + c.replace("'", "''") + "'"
    table = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in cells)
    shown = ", ".join(f"replace(replace({n}, '§7', CAST(p_partkey % 7 AS VARCHAR)), '§', CAST(p_partkey AS VARCHAR)) AS {n}" for n in names)
    return f"(SELECT p_partkey, {shown} FROM part, (VALUES {table}) AS t({', '.join(names)})) x"


# path, label, name, first and last line, container, exported, arity, return type, visibility, static, async
_DEFINED = """
ts/f§.ts | Class | C§ | 7 | 11 | | true | | | | false | false
ts/f§.ts | Property | size | 8 | 8 | C§ | false | | | private | false | false
ts/f§.ts | Method | make | 9 | 9 | C§ | false | 2 | C§ | | true | false
ts/f§.ts | Method | load | 10 | 10 | C§ | false | 1 | | | false | true
ts/f§.ts | Interface | S§ | 12 | 12 | | true | | | | false | false
ts/f§.ts | Enum | E§ | 13 | 13 | | false | | | | false | false
ts/f§.ts | TypeAlias | T§ | 14 | 14 | | true | | | | false | false
ts/f§.ts | Function | add§ | 15 | 15 | | true | 2 | number | | false | false
ts/f§.ts | Function | hidden§ | 16 | 16 | | false | 0 | | | false | false
ts/f§.ts | Method | meth | 16 | 16 | | false | 0 | | | false | false
ts/f§.ts | Class | Q§ | 17 | 17 | | false | | | | false | false
ts/f§.ts | Method | go | 17 | 17 | Q§ | false | 0 | void | | false | false
js/f§.js | Class | K§ | 3 | 3 | | true | | | | false | false
js/f§.js | Method | run | 3 | 3 | K§ | false | 1 | | | false | false
js/f§.js | Function | main§ | 4 | 4 | | true | 2 | | | false | false
js/f§.js | Function | f§ | 5 | 5 | | false | 1 | | | false | false
py/f§.py | Class | A§ | 4 | 10 | | true | | | | false | false
py/f§.py | Property | name | 5 | 5 | A§ | true | | | | false | false
py/f§.py | Method | __init__ | 6 | 6 | A§ | false | 1 | | | false | false
py/f§.py | Method | of | 8 | 9 | A§ | true | 1 | | | true | false
py/f§.py | Function | run§ | 12 | 14 | | true | 2 | | | false | true
go/f§.go | Struct | Base§ | 4 | 4 | | true | | | | false | false
go/f§.go | Struct | User§ | 5 | 8 | | true | | | | false | false
go/f§.go | Interface | Repo§ | 9 | 11 | | true | | | | false | false
go/f§.go | Method | Save | 10 | 10 | Repo§ | true | 1 | error | | false | false
go/f§.go | Function | New§ | 12 | 15 | | true | 2 | User§ | | false | false
go/f§.go | Method | get | 16 | 16 | User§ | false | 0 | string | | false | false
rs/f§.rs | Struct | User§ | 3 | 3 | | true | | | pub | false | false
rs/f§.rs | Trait | Repo§ | 4 | 4 | | true | | | pub | false | false
rs/f§.rs | Namespace | inner§ | 10 | 10 | | false | | | | false | false
rs/f§.rs | Enum | E§ | 11 | 11 | | false | | | | false | false
rs/f§.rs | Impl | User§ | 5 | 7 | | false | | | | false | false
rs/f§.rs | Impl | User§ | 8 | 8 | | false | | | | false | false
rs/f§.rs | Method | save | 4 | 4 | Repo§ | false | 1 | | | false | false
rs/f§.rs | Method | save | 6 | 6 | User§ | false | 1 | | | false | false
rs/f§.rs | Method | new | 8 | 8 | User§ | true | 1 | Self | pub | false | false
rs/f§.rs | Function | build§ | 9 | 9 | | true | 1 | User§ | pub | false | true
"""
_NODES = _values(_DEFINED, "path", "label", "name", "a", "b", "container", "exported", "arity", "returned", "visible", "static", "async")
_ID = "path || '::' || name || '::' || a AS id"

# caller, name, receiver, line, arguments
_CALLED = """
ts/f§.ts::make::9 | C§ | | 9 | 1
ts/f§.ts::load::10 | get | this.api | 10 | 1
ts/f§.ts::load::10 | mk | | 10 | 0
ts/f§.ts::load::10 | run | mk() | 10 | 1
ts/f§.ts::load::10 | go | mk().run(1) | 10 | 0
ts/f§.ts::load::10 | call | arr[0] | 10 | 1
ts/f§.ts::load::10 | inner | | 10 | 1
ts/f§.ts::hidden§::16 | helper§7 | | 16 | 1
ts/f§.ts::hidden§::16 | deep | | 16 | 0
js/f§.js::__module__ | require | | 2 | 1
js/f§.js::K§::3 | y | x | 3 | 1
js/f§.js::main§::4 | K§ | | 4 | 0
js/f§.js::f§::5 | g | | 5 | 1
py/f§.py::__init__::6 | print | | 6 | 1
py/f§.py::of::8 | end | U§7(x).go()[0] | 9 | 0
py/f§.py::of::8 | go | U§7(x) | 9 | 0
py/f§.py::of::8 | U§7 | | 9 | 1
py/f§.py::__module__ | deco | | 11 | 1
py/f§.py::run§::12 | h | | 14 | 1
go/f§.go::New§::12 | Println | fmt | 13 | 2
go/f§.go::New§::12 | F | al | 13 | 1
go/f§.go::New§::12 | G | al.F(n) | 13 | 0
go/f§.go::get::16 | Load | rows[0] | 16 | 0
rs/f§.rs::save::6 | db | self | 6 | 0
rs/f§.rs::save::6 | put | self.db()? | 6 | 2
rs/f§.rs::save::6 | id | user | 6 | 0
rs/f§.rs::save::6 | println | | 6 | 0
rs/f§.rs::User§::8 | check | | 8 | 1
rs/f§.rs::User§::8 | ok | check(name) | 8 | 0
rs/f§.rs::build§::9 | new | User§ | 9 | 1
rs/f§.rs::build§::9 | key | list[0] | 9 | 0
"""

# file, name, module, alias, default, namespace, line
_IMPORTED = """
ts/f§.ts | Widget | ./w§7 | W§ | false | false | 1
ts/f§.ts | Gear | ./w§7 | | false | false | 1
ts/f§.ts | def§ | pkg/d | | true | false | 2
ts/f§.ts | ns | ns§7 | | false | true | 3
ts/f§.ts | * | ./side | | false | true | 4
ts/f§.ts | * | ./x§7 | | false | true | 5
js/f§.js | a§ | ./a§7 | | false | false | 1
py/f§.py | os.path | os/path | | false | true | 1
py/f§.py | x | m§7 | y§ | false | false | 2
py/f§.py | z | m§7 | | false | false | 2
py/f§.py | * | ./n§ | | false | true | 3
go/f§.go | fmt | fmt | | false | true | 2
go/f§.go | al | pkg/p§7 | al | false | true | 3
rs/f§.rs | Svc§ | services | S | false | false | 1
rs/f§.rs | io | std | | false | false | 2
rs/f§.rs | Display | std/fmt | D | false | false | 2
"""

# child, parent, kind
_INHERITED = """
ts/f§.ts::C§::7 | B§7 | Extends
ts/f§.ts::C§::7 | I§7 | Implements
ts/f§.ts::C§::7 | J | Implements
ts/f§.ts::Q§::17 | C§ | Extends
js/f§.js::K§::3 | P§7 | Extends
py/f§.py::A§::4 | U§7 | Extends
go/f§.go::User§::5 | Base§ | Extends
rs/f§.rs::Repo§::4 | Base§7 | Extends
rs/f§.rs::Repo§::4 | Send | Extends
rs/f§.rs::User§::3 | Repo§ | Implements
"""


#: So many files are parsed in a task (some seconds); a table of parts, a few bytes a row, would be one task by its size.
FILES_OF_A_TASK = 4000


def sources(v: Views, texts: dict[str, str] = TEXTS) -> DataFrame:
    """relative_path, content, one of each text for each part. The parts are dealt out by the count of files, before they become texts."""
    key = F.col("p_partkey").cast("string")
    told = lambda c: F.replace(F.replace(c, F.lit("§7"), (F.col("p_partkey") % 7).cast("string")), F.lit("§"), key)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in texts.items()])).alias("t")
    tasks = -(-v.part.count() * len(texts) // FILES_OF_A_TASK)
    rows = v.part.select("p_partkey").repartition(max(1, tasks)).select("p_partkey", each)
    return rows.select(told(F.col("t.path")).alias("relative_path"), told(F.col("t.text")).cast("binary").alias("content"))


def parsed(v: Views, folder: str | None = None) -> DataFrame:
    return facts.parse(sources(v, {p: t for p, t in TEXTS.items() if folder is None or p.startswith(folder)}))


def nodes(v: Views, folder: str | None = None) -> DataFrame:
    return parsed(v, folder).select(F.explode("nodes").alias("n")).select("n.*")


# --- dispatch --------------------------------------------------------------------------------


@query("""SELECT f.relative_path || p_partkey || '.' || ext AS relative_path, lang AS language, ok AS parsed FROM part, (VALUES ('ts/f', 'ts', 'typescript', true), ('js/f', 'js', 'javascript', true), ('py/f', 'py', 'python', true), ('go/f', 'go', 'go', true), ('rs/f', 'rs', 'rust', true), ('kt/f', 'kt', 'kotlin', false), ('doc/f', 'txt', NULL, false)) AS f(relative_path, ext, lang, ok)""")
def p1_dispatch(v: Views) -> DataFrame:
    """Which parser a file goes to, by its extension; one without a parser gives an error and no facts."""
    from ..functions.text import extension
    from ..schema import language_of_extension

    got = facts.parse(sources(v, TEXTS | OTHERS))
    return got.select("relative_path", language_of_extension(extension(F.col("relative_path"))).alias("language"), (F.col("error").isNull() & (F.size("nodes") > 0)).alias("parsed"))


class Functions:
    """A parser that is added to the known ones: a function for each line that begins with `fun`."""

    language, extensions = "kotlin", ("kt",)

    def parse(self, path: str, data: bytes):
        f = File(path, data, self.language)
        at = 0
        for line in f.text.split("\n"):
            if line.startswith("fun "):
                f.define("Function", line[4:].split("(")[0], at, at + len(line))
            at += len(line) + 1
        return f.done()


def with_functions():
    made = default_registry()
    made.register(Functions())
    return made


@query("SELECT 'kt/f' || p_partkey || '.kt' AS path, name, line FROM (SELECT p_partkey, 'f' || p_partkey AS name, 1 AS line FROM part UNION ALL SELECT p_partkey, 'g', 3 FROM part) x UNION ALL SELECT 'js/f' || p_partkey || '.js', 'main' || p_partkey, 4 FROM part")
def p2_added_parser(v: Views) -> DataFrame:
    got = facts.parse(sources(v, {p: t for p, t in (TEXTS | OTHERS).items() if p.startswith(("kt", "js"))}), registry=with_functions)
    own = got.select("relative_path", F.explode("nodes").alias("n")).filter("n.language = 'kotlin' or n.name like 'main%'")
    return own.select(F.col("relative_path").alias("path"), "n.name", F.col("n.start_line").alias("line"))


# --- definitions -----------------------------------------------------------------------------


def _definitions(language: str) -> str:
    return f"SELECT {_ID}, label, name, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, container AS container_name FROM {_NODES} WHERE starts_with(path, '{language}/')"


def _defined(v: Views, folder: str) -> DataFrame:
    return nodes(v, f"{folder}/").select("id", "label", "name", "start_line", "end_line", "container_name")


@query(_definitions("ts"))
def p3_typescript_definitions(v: Views) -> DataFrame:
    return _defined(v, "ts")


@query(_definitions("js"))
def p4_javascript_definitions(v: Views) -> DataFrame:
    return _defined(v, "js")


@query(_definitions("py"))
def p5_python_definitions(v: Views) -> DataFrame:
    return _defined(v, "py")


@query(_definitions("go"))
def p6_go_definitions(v: Views) -> DataFrame:
    return _defined(v, "go")


@query(_definitions("rs"))
def p7_rust_definitions(v: Views) -> DataFrame:
    return _defined(v, "rs")


@query(f"SELECT caller_id, callee_name, receiver, CAST(line AS INT) AS line, CAST(n AS INT) AS arguments_count FROM {_values(_CALLED, 'caller_id', 'callee_name', 'receiver', 'line', 'n')}")
def p8_calls(v: Views) -> DataFrame:
    return parsed(v).select(F.explode("calls").alias("c")).select("c.caller_id", "c.callee_name", "c.receiver", "c.line", "c.arguments_count")


# --- imports and heritage --------------------------------------------------------------------

_IMPORTS = _values(_IMPORTED, "source_file", "imported_name", "module_path", "alias", "d", "ns", "line")


def _imports(*folders: str) -> str:
    kept = " OR ".join(f"starts_with(source_file, '{f}/')" for f in folders)
    return f"SELECT source_file, imported_name, module_path, alias, d = 'true' AS is_default, ns = 'true' AS is_namespace, CAST(line AS INT) AS line FROM {_IMPORTS} WHERE {kept}"


def _imported(v: Views, *folders: str) -> DataFrame:
    rows = facts.parse(sources(v, {p: t for p, t in TEXTS.items() if p.split("/")[0] in folders}))
    return rows.select(F.explode("imports").alias("i")).select("i.*")


@query(_imports("ts", "js"))
def p10_script_imports(v: Views) -> DataFrame:
    return _imported(v, "ts", "js")


@query(_imports("py"))
def p11_python_imports(v: Views) -> DataFrame:
    return _imported(v, "py")


@query(_imports("go"))
def p12_go_imports(v: Views) -> DataFrame:
    return _imported(v, "go")


@query(_imports("rs"))
def p13_rust_imports(v: Views) -> DataFrame:
    return _imported(v, "rs")


@query(f"SELECT child_id, parent_name, kind, string_split(child_id, '::')[1] AS file_path FROM {_values(_INHERITED, 'child_id', 'parent_name', 'kind')}")
def p14_heritage(v: Views) -> DataFrame:
    return parsed(v).select(F.explode("heritage").alias("h")).select("h.*")


# --- what is known of a definition -----------------------------------------------------------


@query(f"SELECT {_ID}, exported = 'true' AS is_exported FROM {_NODES}")
def p15_exports(v: Views) -> DataFrame:
    return nodes(v).select("id", "is_exported")


@query(f"SELECT {_ID}, CAST(arity AS INT) AS parameter_count FROM {_NODES}")
def p16_arity(v: Views) -> DataFrame:
    return nodes(v).select("id", "parameter_count")


@query(f"SELECT {_ID}, returned AS return_type, visible AS visibility, static = 'true' AS is_static, async = 'true' AS is_async, container AS container_name FROM {_NODES}")
def p17_signatures(v: Views) -> DataFrame:
    return nodes(v).select("id", "return_type", "visibility", "is_static", "is_async", "container_name")


# names whose text has no key in it, or its remainder only; the enumerations of two languages are written alike
_SAME, _BY_7 = "('size', 'load', 'meth', 'go', 'name', '__init__', 'new')", "('of')"


@query(f"""SELECT path || '::' || name || '::' || a AS id, CASE WHEN name IN {_SAME} THEN min(path || '::' || name || '::' || a) OVER (PARTITION BY name) WHEN label = 'Enum' THEN min(path || '::' || name || '::' || a) OVER (PARTITION BY name) WHEN name IN {_BY_7} THEN min(path || '::' || name || '::' || a) OVER (PARTITION BY name, p_partkey % 7) ELSE path || '::' || name || '::' || a END AS first_alike FROM {_NODES}""")
def p18_body_hashes(v: Views) -> DataFrame:
    """For each definition the first whose body's hash is the same: that of the same text."""
    own = staged(nodes(v).select("id", "body_hash"), "bodies")
    return own.join(own.groupBy("body_hash").agg(F.min("id").alias("first_alike")), "body_hash").select("id", "first_alike")
