"""Scanners on small texts, import and cone rules on small tables."""

from depscope.operators import symbols as sym

TS = """// function no() {}
export interface Shape extends Base<T>, Other { area(): number; name: string }
export class Sq extends Base implements Shape, Gen<X> {
  constructor(a) { this.a = "}" }
  async area(x: {a: 1}): Promise<number> { if (x) { f(x) } return 1 }
}
function outer() { function inner() { return 1 } return inner() }
export const add = (a: number, b = (1)) : number => a + b;
const o = { m() { return 1 } };
type T<A> = { a: A } | string
"""


def names(found):
    return {(n, k) for n, k, *_ in found}


def test_typescript():
    found = sym.scan_typescript(TS)
    assert names(found) == {
        ("Shape", "interface"), ("Shape.area", "interface_method"), ("Shape.name", "interface_method"), ("Sq", "class"), ("Sq.constructor", "method"),
        ("Sq.area", "method"), ("outer", "function"), ("inner", "function"), ("add", "arrow"), ("T", "type"),
    }
    of = {f[0]: f for f in found}
    assert of["Shape"][5] == ["Other"] and of["Sq"][5:] == (["Base"], ["Shape"])
    assert TS[of["add"][2] : of["add"][3]] == "const add = (a: number, b = (1)) : number => a + b;"
    assert TS[of["Sq.area"][2] : of["Sq.area"][3]].endswith("return 1 }")


def test_python_and_its_fallback():
    text = "LIM = 3\nclass A:\n    X = 1\n    def m(self):\n        Y = 2\ndef f(): return 1\n"
    assert names(sym.scan_python(text)) == {("LIM", "constant"), ("A", "class"), ("A.m", "function"), ("Y", "constant"), ("f", "function")}
    assert names(sym.scan_python("def g(:\n  class B")) == {("g", "function"), ("B", "class")}


def test_go():
    text = "const (\n\tA = 1\n\tB = 2\n)\nvar x int\ntype T struct {\n\tn int\n}\nfunc (t *T) M(a int) (int, error) {\n\treturn a\n}\nfunc Fn(a int) int { return a }\n"
    found = sym.scan_go(text)
    assert names(found) == {("A", "constant"), ("B", "constant"), ("x", "variable"), ("T", "struct"), ("T.M", "method"), ("Fn", "function")}
    assert next(text[f[2] : f[3]] for f in found if f[0] == "B").startswith("const (")


def test_rust():
    text = "mod a;\npub mod b { fn q() {} }\npub struct P;\nimpl<'a> Shape for Q { pub fn m(&self) -> i32 { f(1) } }\nconst X: i32 = 1;\nfn main<T>(a: &'a str) -> T { 1 }\n"
    assert names(sym.scan_rust(text)) == {("a", "module"), ("b", "module"), ("q", "function"), ("P", "struct"), ("Shape.m", "function"), ("X", "constant"), ("main", "function")}


def test_odd_files(spark):
    rows = [("r", "a.ts", "// é\nfunction f() {}"), ("r", "b.ts", None), ("r", "c.ts", ""), ("r", "d.py", "\0"), ("r", "e.txt", "function g() {}"), ("r", "f.rs", "fn h() {")]
    found = sym.extract_symbols(spark.createDataFrame(rows, "repo string, path string, content string")).collect()
    assert {(r["name"], r["start"], r["end"]) for r in found} == {("f", 6, 21), ("h", 0, 8)}  # offsets in bytes
    assert sym.extract_symbols(spark.createDataFrame([], "repo string, path string, content string")).count() == 0


def test_python_imports(spark):
    paths = spark.createDataFrame([("r", p) for p in ("p/__init__.py", "p/a.py", "p/q/b.py", "c.py")], "repo string, path string")
    asked = [("p/q/b.py", "..a"), ("p/q/b.py", "."), ("p/a.py", "."), ("p/a.py", "c"), ("p/a.py", "p.q.b"), ("p/a.py", "os")]
    found = sym.resolve_imports_py(spark.createDataFrame([("r", *a) for a in asked], "repo string, importer_file string, import_path string"), paths)
    got = {(r["importer_file"], r["import_path"]): r["imported_file"] for r in found.collect()}
    assert got == dict(zip(asked, ["p/a.py", None, "p/__init__.py", "c.py", "p/q/b.py", None], strict=True))


def test_rust_and_go_imports(spark):
    paths = spark.createDataFrame([("r", p) for p in ("src/x.rs", "y/mod.rs", "lib/u/b.go", "lib/u/a.go")], "repo string, path string")
    ask = lambda *a: spark.createDataFrame([("r", *x) for x in a], "repo string, importer_file string, import_path string")
    rust = sym.resolve_imports_rust(ask(("src/main.rs", "x"), ("src/main.rs", "y"), ("main.rs", "z")), paths)
    assert {r["import_path"]: r["imported_file"] for r in rust.collect()} == {"x": "src/x.rs", "y": "y/mod.rs", "z": None}
    go = sym.resolve_imports_go(ask(("m.go", "example.com/lib/u"), ("m.go", "fmt")), paths)
    assert {r["import_path"]: r["imported_file"] for r in go.collect()} == {"example.com/lib/u": "lib/u/a.go", "fmt": None}


def test_recovery_of_the_queue(spark, tmp_path):
    """Queued before a restart, delivered after it."""
    from depscope.streaming.routing import pending_queue, run_to_table

    schema = "agent_id string, ts timestamp, turn int, id long"
    write = lambda rows: spark.createDataFrame(rows, "agent_id string, t long, turn int, id long").selectExpr("agent_id", "timestamp_seconds(t) ts", "turn", "id").write.mode("append").parquet(f"{tmp_path}/in")
    start = lambda: run_to_table(pending_queue(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    write([("a", 1, 0, 11), ("a", 2, 0, 12), ("b", 1, 0, 13)])
    start()
    write([("a", 3, 1, 90), ("a", 4, 0, 14), ("", 9999, 1, 91)])  # the last lets the watermark pass
    start()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r["agent_id"], r["delta_id"], r["delivered_by"]) for r in got} == {("a", 11, 90), ("a", 12, 90)}


def test_calls_of_four_languages(spark):
    from depscope.operators.graph import extract_calls

    rows = [
        ("a.ts", "// no(1)\n/* nor(2)\n neither(3) */ if (f(a)) { while(b) {} }\nclass K { area(x) { return g<number>(x) } }\nfunction h(a) { return new N(a).run() }\nconst s = 'q(1)' + \"r(2)\" + `t(3)`; foo (2); a.b.c(); m.get(1); p.catch(e); super(1); interface I { m(x): void }"),
        ("b.py", "# no(1)\ndef f(a):\n    '''nor(2)'''\n    return g(h.k (a), 'x(1)')\nclass K(f2(), object): pass\nprint(a) if (a) else None\n"),
        ("c.go", "// no(1)\nfunc (t *T) M(a int) int { return p.F(a) }\nfunc G(a int) { for (a > 0) { h(`x(1)`) } }\ntype I interface { N(x int) }\n"),
        ("d.rs", "// no(1)\nfn k(a: &'a str) { if (a) { T::f(a); b.g(); m!(1); h(\"x(1)\", 'c') } }\nstruct P(i32);"),
        ("e.md", "f(1)"), ("g.ts", None), ("h.ts", ""),
    ]
    found = extract_calls(spark.createDataFrame([("r", *r) for r in rows], "repo string, path string, content string")).collect()
    got = {}
    for r in found:
        got.setdefault(r["caller_file"], set()).add(r["called_name"])
    assert got == {"a.ts": {"f", "g", "run", "foo", "c", "get", "catch"}, "b.py": {"g", "k", "f2", "print"}, "c.go": {"F", "h"}, "d.rs": {"f", "g", "h"}}


def test_a_large_literal_is_masked(spark):
    from depscope.operators.graph import extract_calls

    text = "x = '" + "a" * 300000 + "(1)'; // " + "b(2) " * 50000 + "\nreal(1)"
    found = extract_calls(spark.createDataFrame([("r", "a.ts", text)], "repo string, path string, content string")).collect()
    assert [r["called_name"] for r in found] == ["real"]


def test_aliases(spark):
    from depscope.operators.graph import path_aliases

    configs = [("r", "", '{"compilerOptions":{"baseUrl":"src","paths":{"~/*":["./*"],"~/lib/*":["lib/*","no/*"]}}}'), ("r", "a", '{"compilerOptions":'), ("r", "a/b", '{"compilerOptions":{}}')]
    df = spark.createDataFrame(configs, "repo string, dir string, json string")
    roots = spark.createDataFrame([("r", "a"), ("r", "a/b/c"), ("q", "a")], "repo string, root string")
    assert {tuple(r) for r in path_aliases(df, roots).collect()} == {("r", "a", "~", "src"), ("r", "a", "~/lib", "src/lib")}


def test_scan_of_a_folder(spark, tmp_path):
    from depscope.sources.trees import scan_source_files

    for name, data in (("p/__init__.py", b"x = 1"), ("p/q/.hidden.ts", b"f()"), ("a.TS", b"\xff g()"), ("n.rs", b"a\0b"), ("e.go", b""), ("r.md", b"no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: (r["lang"], r["content"], r["n_bytes"], r["parse_ok"]) for r in scan_source_files(spark, str(tmp_path)).collect()}
    assert got == {
        "p/__init__.py": ("python", "x = 1", 5, True), "p/q/.hidden.ts": ("typescript", "f()", 3, True), "a.TS": ("typescript", "\ufffd g()", 5, True),
        "n.rs": ("rust", "a\0b", 3, False), "e.go": ("go", "", 0, True),
    }


def test_saving_one_repository_keeps_the_others(spark, tmp_path):
    from depscope.operators.reports import load_tables, save_tables

    table = lambda *r: {"t": spark.createDataFrame(r, "repo string, k long, v long")}
    save_tables(table(("a", 1, 1), ("a", 1, 1), ("a", 1, 2)), str(tmp_path), {"t": ["repo", "k"]})
    save_tables(table(("b", 1, 1), ("b", 2, 1)), str(tmp_path), {"t": ["repo", "k"]})
    back = load_tables(spark, str(tmp_path), {"t": "k long, v long, repo string", "none": "k long"})
    assert sorted((r["repo"], r["k"]) for r in back["t"].collect()) == [("a", 1), ("b", 1), ("b", 2)]
    assert back["none"].count() == 0


def test_diff_with_names_defined_twice(spark):
    from depscope.operators.activity import same_fingerprints, symbol_diff, symbol_fingerprint

    rows = [("r", "f", "n", "old", 1), ("r", "f", "n", "new", 9), ("q", "f", "n", "new", 1)]
    df = spark.createDataFrame(rows, "repo string, file string, name string, body string, start long")
    assert symbol_diff(df, df).count() == 0
    other = spark.createDataFrame([("r", "f", "n", "new", 1), ("r", "g", "m", "x", 1)], df.schema)
    assert {tuple(r) for r in symbol_diff(df, other).collect()} == {("q", "f", "n", "removed"), ("r", "g", "m", "added")}
    runs = [symbol_fingerprint(df), symbol_fingerprint(df.repartition(3))]
    assert all(r["passed"] for r in same_fingerprints(*runs).collect())


def test_changed_files_come_first(spark):
    from depscope.operators.activity import dedup_diagnostics

    rows = [(1, 1, f, line, 1, code, "m") for f, line, code in (("a", 1, "X"), ("a", 2, "X"), ("b", 3, "X"), ("c", 9, "Y"), ("d", 4, "Z"))]
    df = spark.createDataFrame(rows, "run_id long, attempt long, file string, line long, col long, code string, message string")
    changed = spark.createDataFrame([(1, "c")], "run_id long, file string")
    assert [r["file"] for r in dedup_diagnostics(df, changed).orderBy("rank").collect()] == ["c", "a", "b"]


def test_names_beyond_latin_letters(spark):
    files = spark.createDataFrame([("r", "a.py", "class Größe:\n    def 長(self): pass\n"), ("r", "b.ts", "function été(x) { }\n")], "repo string, path string, content string")
    assert sorted(r["name"] for r in sym.extract_symbols(files).collect()) == ["Größe", "Größe.長", "été"]


def test_declarations_by_scope():
    """Overloads, object types, regular expressions and templates with brackets in them, members of classes and interfaces."""
    src = """abstract class A<T extends { a: B }> extends C implements I, J<K>, L {
  x = a => { return /}/.test(`${b}}`) }
  over(x: string): void;
  over(x): { y: number } { return f(x) }
  static async *gen<U>() { }
  get v() { return 1 }
  private w = function inner() { }
}
interface I extends X, Y<Z> { m(x: number): void; readonly p?: string
  q: { r(): void }
}
type U = | 'a' // {
  | { b: string };
const f = (x: number): { y: 1 } => ({ y: 1 }), g = 2, h = async <T>(z) => { const k = y => y }
let n: (a) => void = null, o = p => p
declare function sig(x): void;
export default function () { }
function last(a = { b: '}' }) { }
"""
    found = {(s[0], s[1]): src[s[2] : s[3]] for s in sym.scan_typescript(src)}
    assert set(found) == {
        ("A", "class"), ("A.over", "method"), ("A.gen", "method"), ("A.v", "method"), ("inner", "function"), ("I", "interface"), ("I.m", "interface_method"), ("I.p", "interface_method"),
        ("I.q", "interface_method"), ("U", "type"), ("f", "arrow"), ("h", "arrow"), ("k", "arrow"), ("o", "arrow"), ("last", "function"),
    }
    assert found["A.over", "method"] == "over(x): { y: number } { return f(x) }" and found["A.gen", "method"] == "static async *gen<U>() { }"
    assert found["U", "type"].endswith("| { b: string };") and found["I.p", "interface_method"] == "readonly p?: string" and found["I.q", "interface_method"] == "q: { r(): void }"
    assert found["f", "arrow"] == found["h", "arrow"] and found["h", "arrow"].endswith("const k = y => y }") and found["o", "arrow"] == "let n: (a) => void = null, o = p => p"
    heads = {s[0]: (s[5], s[6]) for s in sym.scan_typescript(src) if s[1] in ("class", "interface")}
    assert heads == {"A": (["C"], ["I", "L"]), "I": (["X"], [])}
