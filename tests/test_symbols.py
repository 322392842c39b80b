import pytest

from corpusloom.operators import symbols as S
from corpusloom.operators.members import with_export_flag, with_members
from corpusloom.plans.ingest import enriched

PYTHON = '''import os
from .a import b as c

class Calculator:
    """Adds."""
    async def add(self, x, y):
        return x + y

    def _hidden(self): return 1

def _free(a,
          b=2):
    def inner():
        pass
    return a

if True:
    @deco
    def late():
        pass
'''
SCRIPT = """import x from './x';
/** Pays. */
export class PaymentService {
  constructor(a) {
    this.a = { b: '}' };
  }
  async pay(n) {
    if (n) { return `}${n}`; }
  }
}
export const go = async (p) => {
  return p;
};
function plain() { return /[}]/.test('a'); }
"""
RUST = """use a::b;
/// A user.
pub struct User { id: u64 }
impl User {
    pub fn new(id: u64) -> Self {
        let c = '}';
        Self { id }
    }
}
pub(crate) enum E { A, B }
fn free<'a>(x: &'a str) -> &'a str { x }
"""


def by_name(found):
    return {s[1]: s for s in found}


def test_python():
    s = by_name(S.python_symbols(PYTHON))
    assert set(s) == {"Calculator", "Calculator.add", "Calculator._hidden", "_free", "late"}
    assert s["Calculator.add"][7] == "async def add(self, x, y)" and s["Calculator.add"][9]
    assert s["_free"][8] is False and s["Calculator"][6] == "Adds." and s["late"][3] == 19
    assert s["Calculator"][10] == ["os", ".a.b as c"]


def test_scripts():
    s = by_name(S.brace_symbols(SCRIPT, rust=False))
    assert set(s) == {"PaymentService", "PaymentService.constructor", "PaymentService.pay", "go", "plain"}
    assert s["PaymentService"][8] and s["PaymentService"][7].endswith("class PaymentService")
    assert (s["PaymentService.pay"][3], s["PaymentService.pay"][4], s["PaymentService.pay"][9]) == (7, 9, True)
    assert "Pays" in s["PaymentService"][6]
    t = by_name(S.brace_symbols("export interface I {\n  a: string;\n}\nenum E { A }\n", rust=False))
    assert t["I"][0] == "interface" and t["E"][0] == "enum"


def test_rust():
    s = by_name(S.brace_symbols(RUST, rust=True))
    assert set(s) == {"User", "impl User", "impl User.new", "E", "free"}
    assert s["impl User.new"][7] == "pub fn new(id: u64) -> Self" and s["impl User.new"][2] == "impl User"
    assert s["User"][6] == "/// A user." and s["E"][8]


def test_fallback_and_table(spark):
    files = [("r", "a.py", "python", PYTHON), ("r", "bad.py", "python", "def (:\n" * 70), ("r", "x.md", "markdown", "# a\n"), ("r", "none.rs", "rust", None), ("r", "y", None, "t")]
    df = spark.createDataFrame(files, "repo string, file string, language string, text string")
    rows = S.symbols(df).collect()
    bad = [r for r in rows if r.file == "bad.py"]
    assert len(bad) == 2 and all(r.ast_parse_failure and r.symbol_type == "chunk" for r in bad)
    assert {r.chunk_id for r in rows if r.file == "a.py"} >= {"r::a.py::Calculator::4"}
    assert S.symbols(df.where("false")).count() == 0
    found = S.symbols(df)
    owner = {r.symbol_name: r.members for r in with_members(found.unionByName(found)).collect()}
    assert owner == {"Calculator": ["add", "_hidden"]}


def test_register_parser(spark):
    S.register_parser("Lines", lambda text: [("function", x, None, i + 1, i + 1, x, None, x, False, False, [], None) for i, x in enumerate(text.split())])
    try:
        df = spark.createDataFrame([("r", "f", "lines", "a b")], "repo string, file string, language string, text string")
        assert sorted(r.symbol_name for r in S.symbols(df).collect()) == ["a", "b"]
    finally:
        S.PARSERS.pop("lines")


def test_export_flags(spark):
    df = spark.createDataFrame([("A.b", False, ["A"]), ("x", None, ["y"]), ("x", True, None), (None, None, None)], "symbol_name string, exported boolean, exports array<string>")
    assert [r.is_exported for r in with_export_flag(df).collect()] == [True, False, True, False]


def test_unbalanced_is_a_failure():
    with pytest.raises(SyntaxError):
        S.brace_symbols("function f() {", rust=False)


def test_all_import_names():
    names = lambda text, rust=False: S.brace_symbols(text + ("\nfn f() {}\n" if rust else "\nfunction f() {}\n"), rust)[0][10]
    assert names("import { a, b as c, type D } from 'x';") == ["a", "c", "D"]
    assert names("import * as n from 'x'\nimport './side'\nimport d, {\n  e, // f\n  default as g,\n} from \"y\";") == ["n", "d", "e", "g"]
    assert names("import type { T } from 'x'; import h, * as i from 'y'; const j = import('z');") == ["T", "h", "i"]
    assert names("import type from 'x'; import k = require('y');") == ["type", "k"]
    assert names("use x::{a, b};\nuse x as y;\npub use p::q::r as s;", True) == ["a", "b", "y", "s"]
    assert names("use std::{\n    io::{self, Read as R},\n    fmt,\n};\nuse crate::k;", True) == ["io", "R", "fmt", "k"]


def test_export_names():
    names = lambda text: S.brace_symbols(text + "\nfunction f() {}\n", False)[0][12]
    assert names("export { a, b as c, d as default };\nexport { default as e } from 'x';\nexport * from 'y'; export * as g from 'z';") == ["a", "c", "d", "e", "g"]
    assert names("export const a = (x, y) => { return [x, y]; }, b = 2;\nexport let { c, d: e, ...h } = o\nexport var [i, , j = 1] = p;") == ["a", "b", "c", "e", "h", "i", "j"]
    assert names("export const m: Map<string, number> = new Map<string, A, B>(), n = 1\nother(), no") == ["m", "n"]
    assert names("export async function* a() {}\nexport abstract class B {}\nexport interface C {}\nexport const enum D { x }\nexport type E = { y: 1 };") == ["a", "B", "C", "D", "E"]
    for text, name in {"A;": "A", "defineConfig({ a: 1 });": "defineConfig", "Vue.extend({})": "Vue.extend", "class P extends Q {}": "P", "async function r() {}": "r", "function () {}": "default_export", "class extends Q {}": "default_export", "{ a: 1 };": "default_export", "x => x;": "default_export", "'text'\nname();": "default_export", "a + b;": "default_export", "/* note */ A\n": "A"}.items():
        assert names("export default " + text) == [name], text


def test_enriched_flags_what_the_file_exports(spark):
    files = [("r", "a.js", "javascript", "class A {\n  run() {\n  }\n}\nfunction b() {\n}\nfunction c() {\n}\nexport { A, b };\n")]
    found = enriched(S.symbols(spark.createDataFrame(files, "repo string, file string, language string, text string")))
    assert {r.symbol_name: r.exported for r in found.collect()} == {"A": True, "A.run": True, "b": True, "c": False}
