"""Calls and imports of awkward sources in four languages, by hand; linear time on large ones."""

import time

import pytest

from depscope.operators.graph import extract_calls, extract_imports, resolve_imports
from depscope.operators.references import READERS
from depscope.operators.symbols import SCANNERS


def read(lang, src, kind):
    return [name for k, name in READERS[lang](src.encode().decode("latin-1")) if k == kind]


CALLS = [
    ("typescript", "type T = { m(x): void; n(); o: { p(): q } }", []),
    ("typescript", "class A { over(x: string): void; over(x) { go(x) }\n z = 3\n zz() { } #p(a) { t(a) } get v() { return w() } static x = y(1) }", ["go", "t", "w", "y"]),
    ("typescript", "declare class D { dm(): void }\nfunction over(x: string): void;\nfunction over(x) { }", []),
    ("typescript", 'let re = /"/; hidden(1); return /f(4)\\/[/"]/.test(g(5)); x = a / b(1) / c(2); y = (d) / e(3)', ["hidden", "test", "g", "b", "c", "e"]),
    ("typescript", "`a ${f(`${g(1)}`)} b ${{a: h(2)}.a}` + `${'}'}`; i(3)", ["f", "g", "h", "i"]),
    ("typescript", "new a.b.C(x).run(); f<T[]>(x); a?.(1); b?.c(2); for (const x of (y)) of(x); async (x) => k(x); async(1)", ["run", "f", "a", "c", "of", "k", "async"]),
    ("typescript", "x = { m(a) { n(a) }, q: r(1), *gen() { }, async w() {} }", ["n", "r"]),
    ("typescript", "if (a)\n  b(x)\nelse c(y)\nswitch (z) { case d(1): e(2)\n g(3) }\ncond\n ? p(1)\n : q(2)\ns.if(1)", list("bcdegpq") + ["if"]),
    ("typescript", "interface I<T> extends J<T> { m(x: number): void\n n(): string\n new (x): I; p: (a) => void }", []),
    ("typescript", "<div>it's {f(1)}</div>\ng(2)", ["f", "g"]),
    ("typescript", "@Input() name; import('./dyn'); super(x); const s = 'no(1)' // not(2)\n/* nor(3) */ yes(4)", ["Input", "yes"]),
    ("python", "match (a):\n  case (b):\n    f(1)\nmatch (c)\n", ["f", "match"]),
    ("python", 'f"{g(1)} {h(2)!r:>{w(3)}}"\n@deco(1)\nclass A(B): pass\nx = a.b.c(d)(e)\n', ["g", "h", "w", "deco", "c"]),
    ("python", "print 'x(1)' # y(2)\ndef f(x):\n  return g(x)\nmatch (a):\n", ["g"]),
    ("go", "func (t *T) M(a int) int { return pkg.Do(F[int](a)) }\ntype I interface { A(x int); B() int\n C() }\nvar s = `no(1)`\nfunc G[T any](x T) { func() { h(1) }() }", ["Do", "F", "h"]),
    ("rust", 'fn f<\'a>(x: &\'a str) -> char { println!("{}", g(1)); let c = \'"\'; let Some(v) = h(2) else { return k(3) }; T::new(1).run() }', ["h", "k", "new", "run"]),
    ("rust", "fn f() { match x { Some(y) => l(y), Ok(A(z)) | Err(z) if q(z) => m(z), _ => Some(1) } } enum E { A(i32) } struct P(i32); #[derive(Clone)] fn g(h: impl Fn(i32)) {}", ["l", "q", "m", "Some"]),
    ("rust", 'let s = r#"a("b")"#; let t = br"c(1)"; /* d(1) /* e(2) */ f(3) */ w(4); x::<i32>(5)', ["w"]),
]
IMPORTS = [
    ("typescript", "const s = 'import x from \"./ghost\"'; // import './no'\nimport a, { b as c } from '../lib/a'\nimport type { T } from './t'; import './side'; import x from 'react'; import * as y from 'lib/y'; export * from './z'", ["../lib/a", "./t", "./side", "lib/y"]),
    ("typescript", "`${import('./dyn')} import './no'`; import.meta.x; import z = require('./z')", []),
    ("python", '"""\nimport ghost\n"""\nimport os, sys as s, a.b\nfrom . import z\nfrom ..a.b import (c,\n d)\nif x:\n    import late\n', ["os", "sys", "a.b", ".", "..a.b", "late"]),
    ("python", "print 1\nimport os, sys as s\nfrom .a import b\n'import no'\n", ["os", "sys", ".a"]),
    ("go", '// import "no"\nimport (\n "fmt"\n a "x/y"\n _ "z"\n)\nimport "w"\nvar s = `\nimport "no"\n`\nfunc f() { x("no") }', ["fmt", "x/y", "z", "w"]),
    ("rust", "/* use no::a; /* mod no; */ use no::b; */ pub(crate) use good::y; mod x; mod z { use inner::q; } use crate::k; use self::m; use ::ext::n; use a as b; fn f() -> impl T + use<'a> {}", ["good", "x", "inner", "ext", "a"]),
]


@pytest.mark.parametrize("lang,src,want", CALLS)
def test_calls(lang, src, want):
    assert list(dict.fromkeys(read(lang, src, "call"))) == want


@pytest.mark.parametrize("lang,src,want", IMPORTS)
def test_imports(lang, src, want):
    assert read(lang, src, "import") == want


LARGE = [
    ("typescript", 'const a = "' + "\\n" * 500_000 + '"; f(1)'),
    ("typescript", '"' + '\\"' * 500_000 + "\nf(1)"),
    ("typescript", "/[" * 300_000),
    ("typescript", "a<" * 300_000 + "f(1)"),
    ("typescript", "class a " * 60_000),
    ("typescript", "type a<" * 60_000),
    ("typescript", "function f(){ " * 70_000),
    ("typescript", "function f(){ " * 30_000 + "}" * 30_000),
    ("typescript", "const f = () => { " * 30_000),
    ("typescript", "interface A { m(): void; " * 30_000),
    ("typescript", "${" * 100_000 + "`${" * 100_000),
    ("rust", '"\\"' * 300_000),
    ("rust", "a|b(" * 100_000),
    ("rust", "impl A { fn f() { " * 30_000),
    ("typescript", "class A { " + "static " * 60_000),
    ("typescript", "class A { " + "static<" * 60_000),
    ("typescript", "interface A { " + "m(): void; " * 30_000),
    ("typescript", "const a = (x): " * 30_000),
    ("typescript", "const a = <" * 30_000),
    ("go", "func f() interface{} " * 30_000),
    ("go", "const (\n" * 30_000),
    ("rust", "const " * 60_000),
    ("python", "def f(:\n" * 60_000),
]


@pytest.mark.parametrize("lang,src", LARGE, ids=lambda x: x[:14])
def test_large_sources_take_linear_time(lang, src):
    for run in (lambda s: list(READERS[lang](s)), SCANNERS[lang]):
        times = []
        for part in (src[: len(src) // 4], src):
            start = time.perf_counter()
            run(part)
            times.append(time.perf_counter() - start)
        assert times[1] < 20 and times[1] < 12 * max(times[0], 0.1)


def test_one_table_of_imports_and_calls(spark):
    rows = [("r", "a.ts", "import './b'\nf(1)"), ("r", "b.py", "import c\ng(é(1))\ng(2)"), ("r", "c.go", None), ("r", "d.md", "f(1)"), ("r", "e.rs", ""), ("r", "f.ts", "x(\0)")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    assert sorted(tuple(r) for r in extract_calls(files).collect()) == [("r", "a.ts", "f"), ("r", "b.py", "g"), ("r", "b.py", "é"), ("r", "f.ts", "x")]
    assert sorted(tuple(r) for r in extract_imports(files).collect()) == [("r", "a.ts", "typescript", 0, "./b"), ("r", "b.py", "python", 0, "c")]
    assert extract_calls(files.limit(0)).count() == 0


def test_aliases_of_the_nearest_root(spark):
    texts = {p: "import '@/x'" for p in ("a/m.ts", "b/m.ts", "a/in/m.ts", "c/m.ts")} | {p: "" for p in ("a/src/x.ts", "b/src/x.ts", "a/in/lib/x.tsx")}
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo string, path string, content string")
    aliases = spark.createDataFrame([("r", "a", "@", "a/src"), ("r", "b", "@", "b/src"), ("r", "a/in", "@", "a/in/lib")], "repo string, root string, prefix string, target string")
    got = {r["importer_file"]: r["imported_file"] for r in resolve_imports(extract_imports(files), files, aliases).collect()}
    assert got == {"a/m.ts": "a/src/x.ts", "b/m.ts": "b/src/x.ts", "a/in/m.ts": "a/in/lib/x.tsx", "c/m.ts": None}
