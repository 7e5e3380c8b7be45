import base64
import math
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import bpe, functions, generated, gll, language, packing, quantiles, syntax
from codeloom.llm.peg import Grammar

FILES = "path string, workspace_id string, language string, content string, size long, line_count long, last_indexed long, valid string, reason string"


def files(spark, *rows):
    """Rows of (path, language, content) with columns whose names clash with those of results."""
    return spark.createDataFrame([(p, "w", lang, text, 1, 1, 1, "clash", "clash") for p, lang, text in rows], FILES)


# --- 2 ----------------------------------------------------------------------
def _error(values, sketch, q):
    s = np.sort(values)
    v = sketch.quantiles([q])[0]
    low, high = np.searchsorted(s, v, "left"), np.searchsorted(s, v, "right")
    want = math.ceil(q * len(s))
    return max(0, low + 1 - want, want - high)


@pytest.mark.parametrize("shape", ["normal", "heavy", "constant", "few", "sorted"])
def test_rank_error_is_within_the_stated_bound(shape):
    rng = np.random.default_rng(4)
    n = 120_000
    x = {"normal": rng.normal(size=n), "heavy": rng.pareto(0.5, n), "constant": np.full(n, 7.0), "few": rng.integers(0, 5, n).astype(float), "sorted": np.arange(n, dtype=float)}[shape]
    whole = quantiles.Sketch()
    for part in np.array_split(x, 37):
        s = quantiles.Sketch()
        for piece in np.array_split(part, 5):
            s.add(piece)
        whole.merge(quantiles.Sketch.load(s.dump()))
    assert whole.n == n and sum(len(lv[0]) << h for h, lv in enumerate(whole.levels)) == n
    assert whole.quantiles([0, 1]) == [x.min(), x.max()] and len(whole.dump()) < 80_000
    for q in (0.5, 0.9, 0.99, 0.999):
        assert _error(x, whole, q) <= quantiles.rank_error() * (1 - q) * n + 1


def test_small_sketches_are_exact_and_empty_ones_say_none():
    s = quantiles.Sketch()
    s.add(np.array([3.0, 1.0, 2.0]))
    assert s.quantiles([0.5, 0.99]) == [2.0, 3.0] and quantiles.Sketch().quantiles([0.5]) == [None]


def test_sketches_of_groups_nulls_and_rollup(spark):
    data = [("a", "x", float(i)) for i in range(2000)] + [("a", "y", -1.0), (None, "x", 5.0), ("b", "x", None), ("c", None, float("nan")), ("b", "y", float("inf"))]
    df = spark.createDataFrame(data, "tool string, ws string, v double").withColumn("sketch", F.lit(1)).withColumn("n", F.lit(2))
    fine = quantiles.merge_sketches(quantiles.partial_sketches(df, ["tool", "ws"], "v"), ["tool", "ws"])
    got = {(r.tool, r.ws): (r.n, r.p50, r.max) for r in quantiles.read_percentiles(fine).collect()}
    assert got[None, "x"] == (1, 5.0, 5.0) and got["a", "y"] == (1, -1.0, -1.0) and got["b", "y"][2] == float("inf") and ("c", None) not in got and ("b", "x") not in got
    rolled = {(r.grouping, r.tool, r.ws): r.n for r in quantiles.read_percentiles(quantiles.roll_up(fine, ["tool", "ws"], {"tool": ["tool"], "all": []})).collect()}
    assert rolled == {("tool", "a", None): 2001, ("tool", None, None): 1, ("tool", "b", None): 1, ("all", None, None): 2003}
    assert quantiles.partial_sketches(df.limit(0), ["tool"], "v").count() == 0


def test_hot_groups_are_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SPLIT", 300)
    df = spark.createDataFrame([("hot", float(i)) for i in range(2000)] + [("cold", 1.0), (None, 2.0)], "k string, v double")
    got = {r.k: (r.n, r.min, r.max) for r in quantiles.read_percentiles(quantiles.group_sketches(df, ["k"], "v")).collect()}
    assert got == {"hot": (2000, 0.0, 1999.0), "cold": (1, 1.0, 1.0), None: (1, 2.0, 2.0)}


def test_a_hot_group_of_one_value_is_split_by_row(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SPLIT", 300)
    df = spark.range(3000).selectExpr("'hot' AS k", "-1.0D AS v").unionAll(spark.range(5).selectExpr("'cold'", "1.0D"))
    got = {r.k: (r.n, r.p50) for r in quantiles.read_percentiles(quantiles.group_sketches(df, ["k"], "v")).collect()}
    assert got == {"hot": (3000, -1.0), "cold": (5, 1.0)}


def test_bounds_hold_over_many_merges_and_small_sections(spark):
    rng = np.random.default_rng(0)
    for k in (8, 16):
        x, whole = rng.lognormal(size=40_000), quantiles.Sketch(k)
        for part in np.array_split(x, 500):
            s = quantiles.Sketch(k)
            s.add(part)
            whole.merge(s)
        for q in (0.5, 0.95, 0.99, 0.999):
            assert _error(x, whole, q) <= quantiles.rank_error(k) * (1 - q) * len(x) + 1
    rows = spark.createDataFrame([("a" if i % 3 else None, float(i * i % 997)) for i in range(3000)], "tool string, v double")
    sets = {"tool": ["tool"], "all": []}
    sketches = quantiles.roll_up(quantiles.merge_sketches(quantiles.partial_sketches(rows, ["tool"], "v", 8), ["tool"]), ["tool"], sets)
    got = quantiles.check_bounds(sketches, rows, ["tool"], sets, "v", 8).collect()
    assert len(got) == 18 and all(r.within and r.compacted for r in got)


def test_percentiles_by_tool_and_workspace_come_first():
    from codeloom.llm.queries import QUERIES

    assert next(n for n in QUERIES if n.startswith("p2_")) == "p2_percentiles"


# --- 4 ----------------------------------------------------------------------
VALID = {
    "python": ["x = [i for i in y if i]\n", "async def f(a, /, *b, c: int = 1, **d) -> None:\n    async with a as b, c:\n        yield\n", "match x:\n    case {'a': [1, *r], **k} if r: pass\n    case P(x=1) | None: pass\n", "x: int\nx.y: int = 3\na, *b = c = d\nlambda: (yield)\n", "f'{a!r:>{w}}' f\"{f'{b}'}\"\n", "if (n := 1): pass\nelse: pass", "@a.b(c)\nclass D(E, metaclass=F): x = 1\n", "print(*a, **b, sep='')\nx[1:2, ::3]\n"],
    "javascript": ["a => ({b, ...c, [d]: 1, get e() {return 1}, async *f() {}})", "for (const [a, b] of c) d: for (;;) break d", "x = /[/]\\//g.test(`a${`b${c}`}d`) ? y : z", "import a, {b as c} from 'd'; export default class extends e { static #f = 1; static {} }", "a\n++b\nlet c = d ?? e?.f?.[0]", "if (a) b; else c\nvar async = 1, of\nasync (x) => await x"],
    "typescript": ["type A<T extends B = C> = T extends (infer U)[] ? U : never", "function f(this: X, a?: number, ...b: string[]): a is Y { return <any>a! as unknown as Z }", "abstract class A<T> extends B<T> implements C, D { private readonly x?: Map<string, Array<T>>; constructor(public a: string) { super() } get y(): number { return 1 } abstract z(): void }", "enum E { A = 1, B }\ndeclare module 'x' { export const y: number }\nlet v: { [k: string]: number; m?(): void } = {}", "const g = <T,>(x: T): x is T => f<T>(x) < 3"],
    "java": ["package a.b; import static c.D.*; @X(y = {1, 2}) public final class A<T extends B & C> extends D<T> implements E { int[] x = {1, 2}; A() { this(1); } <U> U f(final U... u) throws G { return (U) h.<V>i(j::k, L[]::new, (m, n) -> m + n); } }", "record P(int x, int y) { P { if (x < 0) throw new E(); } } sealed interface S permits P {} enum Q { A(1) { void f() {} }, B; }", "class A { void f() { for (var x : y) { switch (z) { case 1, 2 -> a(); default -> { } } } try (var r = s()) { } catch (B | C e) { } String t = \"\"\"\n a\"\"\"; if (o instanceof B b && b.c) d: while (true) break d; } }"],
    "go": ["package a\nimport (\n\t\"b\"\n\t. \"c\"\n)\ntype T[K comparable, V any] struct {\n\t*E\n\tm map[K][]V `json:\"x\"`\n}\nfunc (t *T[K, V]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := t.m[k]; ok && v == (T{}) {\n\t\treturn\n\t}\n\tfor i := range []int{1, 2} {\n\t\tselect {\n\t\tcase <-c:\n\t\tdefault:\n\t\t}\n\t}\n\tswitch y := x.(type) {\n\tcase *T, nil:\n\t}\n\tgo func() {}()\n\treturn x, nil\n}\n"],
    "rust": ["#![a]\nuse a::{b, c::*, d as e};\npub(crate) async unsafe fn f<'a, T: B + 'a, const N: usize>(&'a mut self, (x, y): (u8, u8)) -> Result<Vec<Vec<T>>, E> where T: C<D = E> { let Some(z) = g()? else { return Err(h!(\"{}\", 1)) }; match z { 1 | 2..=9 if x => {} A { b, .. } => c, _ => {} } if a < b { S { x: 1, ..d } } else { x as u8 } }", "impl<T> A for B<T> { type C = D; const E: &'static str = r#\"a\"b\"#; } macro_rules! m { ($a:expr) => { $a + 1 }; }\nstruct U; enum V { A(u8), B { c: char } = 1 }", "fn f() { for i in 0.. { g(i) }\n unreachable!() }"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}}', "1", "[]"],
    "toml": ["a = 1\n[b.c]\nd = [1, 2,\n 3] # x\n'q r' = 2024-01-01T00:00:00Z\n[[e]]\nf = { g = \"h\", i.j = 0x1F }\n", "", '"a".b = """x\ny"""'],
}
BROKEN = {
    "python": ["def f(:\n    pass\n", "if x\n    pass\n", "x = = 1\n", "  x = 1\n", "def f():\npass\n", "x = 'a\n", "f() = 1\n", "[1, 2\n", "x = (1]\n", "<<<<<<< HEAD\nx = 1\n", "import a from b\n", "for x y: pass\n", "class: pass\n"],
    "javascript": ["let x = ;", "function (", "a b", "if (x { }", "x = 'a\n'", "/* open", "`a${b", "=======\n", "({a: 1,, b})", "for (;;", "class { constructor() }}"],
    "typescript": ["let x: = 1", "interface A { b: }", "function f(a: ) {}", "export async functon f() {}", "enum { }", "x = <<<<<<< y"],
    "java": ["class A { int x = = 1; }", "class A { void f() { return } }", "class A {", "int x;}", "class A { String s = \"a\n\"; }", "package a\nclass A {}"],
    "go": ["package a\nfunc f( {\n}\n", "func f() {}\n", "package a\nvar x = = 1\n", "package a\nfunc f() { if x { \n", "package a\nx := 1\n"],
    "rust": ["fn f( {}", "fn f() { let x = ; }", "struct A { b }", "fn f() { x + }", "fn f() {", "let x = 1;", "fn f() { 'ab' }"],
    "json": ["{'a': 1}", '{"a": 1,}', "[1, 2", "# x\n", '{"a" 1}', "01", '"a\nb"', "nul"],
    "toml": ["a = \n", "= 1\n", "a : 1\n", "[a\n", "a = [1, 2\n", "a = 'b\n", "<<<<<<< x\n", "a = 1 b = 2\n"],
}


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid_sources(lang, text):
    assert syntax.judge(lang, text + " " if not text else text)[0] in (True, None)


@pytest.mark.parametrize(("lang", "text"), [(k, t) for k, v in BROKEN.items() for t in v])
def test_broken_sources(lang, text):
    assert syntax.judge(lang, text)[0] is False


def test_causes_and_places():
    assert syntax.judge("python", "x = 1\n<<<<<<< HEAD\ny = 2\n")[:4] == (False, 2, 1, "conflict_marker")
    assert syntax.judge("rust", "fn f() {\n    x")[3] == "truncated"
    assert syntax.judge("java", 'class A {\n  String s = "a\n}')[1:] == (2, 14, "open_string")
    assert syntax.judge("python", "class {{ x }}: pass\n")[3] == "template"
    assert syntax.judge("cobol", "x") == (None,) * 4 and syntax.judge(None, "x") == (None,) * 4 and syntax.judge("python", " \n") == (None,) * 4


def test_packrat_takes_linear_time_and_deep_nesting():
    assert syntax.judge("json", "[" * 20_000 + "]" * 20_000)[0] is True
    assert syntax.judge("javascript", "(" * 2000 + "a" + ")" * 2000)[0] is True
    assert syntax.judge("json", "[" * 150_000 + "]" * 150_000)[0] is True
    assert syntax.judge("json", "[" * 150_000 + "]" * 149_999) == (False, 1, 300_000, "truncated")
    assert syntax.judge("javascript", "(" * 30_000 + "a b" + ")" * 30_000)[:3] == (False, 1, 30_003)
    assert syntax.judge("typescript", "let x = " + "a ? b : " * 20_000 + "a;\n")[0] is True
    g = Grammar("file <- a* EOF\na <- b 'x' / b 'y'\nb <- '(' a ')' / 'n'\n")
    assert g.parse([*["("] * 500, "n", *["y", ")"] * 500, "y", "EOF"])[0]


def test_check_syntax_table(spark):
    df = files(spark, ("a.py", "python", "x = 1\n"), ("b.py", "Python ", "x = (\n"), ("c.py", "python", None), ("d", None, "x"), ("e.js", "javascript", "  ")).unionByName(files(spark, ("f.py", "python", "x = (")).withColumn("last_indexed", F.lit(0).cast("long"))).unionByName(files(spark, ("f.py", "python", "x = 1"), ("f.py", "python", "x = 1")))
    got = {r.path: r.valid for r in syntax.check_syntax(df).collect()}
    assert got == {"a.py": True, "b.py": False, "c.py": None, "d": None, "e.js": None, "f.py": True}
    rate = {(r.workspace_id, r.language): (r.files, r.broken) for r in syntax.rates(syntax.check_syntax(df)).collect()}
    assert rate == {("w", "python"): (2, 0), ("w", "Python "): (1, 1)}
    assert syntax.check_syntax(df.limit(0)).count() == 0


# --- 5 ----------------------------------------------------------------------
def test_generated_and_hand_written(spark):
    numbers = "DATA = [\n" + "    1, 2, 3, 4, 5, 6, 7, 8,\n" * 40 + "]\n"
    minified = "".join(f"function f{i}(a,b){{return a>{i}?b:a}}" for i in range(40))
    encoded = 'x = "' + base64.b64encode(bytes(range(256)) * 4).decode() + '"\n'
    hand = "def f(a):\n    return a + 1\n" * 20
    df = files(
        spark,
        ("a/package-lock.json", "json", "{}"), ("a/x.js", "javascript", minified), ("a/n.py", "python", numbers), ("a/e.py", "python", encoded), ("a/node_modules/l/x.js", "javascript", "a()"), ("a/vendor_payments/x.py", "python", hand),
        ("a/g.go", "go", "// Code generated by stub. DO NOT EDIT.\npackage a\n"), ("a/h.py", "python", '# writes the banner\nBANNER = "Code generated by x. DO NOT EDIT."\n' + hand), ("a/i.py", "python", "# quidiff v1.2.3\n# (c) 2020\n" + hand), ("a/j.py", "python", hand + "# This file was automatically generated by x\n"), ("a/k.py", "python", None), ("a/l.py", "python", ""), ("generated/m.py", "python", None), ("a/o.js", "javascript", "/** Auto-generated method stub */\nfunction f() {}\n"), ("a/p.ts", "typescript", "// This used to be generated by a tool, no longer\nlet x = 1\n"),
    )
    got = {r.path: r.reason for r in generated.classify(df).collect()}
    assert got == {"a/package-lock.json": "lock", "a/x.js": "minified", "a/n.py": "data", "a/e.py": "encoded", "a/node_modules/l/x.js": "vendored", "a/vendor_payments/x.py": None, "a/g.go": "generated", "a/h.py": None, "a/i.py": "vendored", "a/j.py": None, "a/k.py": None, "a/l.py": None, "generated/m.py": "generated", "a/o.js": None, "a/p.ts": None}
    assert generated.classify(df.limit(0)).count() == 0


def test_banners_around_long_licences(spark):
    licence = "".join(f"Permission clause {i} of this licence holds for every copy of the work.\n" for i in range(75))
    hashes = "".join(f"# {line}\n" for line in licence.splitlines())
    slashes = "".join(f"// {line}\n" for line in licence.splitlines())
    assert len(licence) > 5000
    df = files(
        spark,
        ("a/behind.py", "python", hashes + "# @generated\nx = 1\n"), ("a/behind.ts", "typescript", slashes + "\n/* Code generated by x. DO NOT EDIT. */\nlet x = 1\n"), ("a/first.js", "javascript", "/*! quilib v1.2.3\n" + licence + "*/\nf()\n"), ("a/last.java", "java", "/*\n" + licence + " * @generated\n */\nclass A {}\n"),
        ("a/top.go", "go", "/* Code generated by x. DO NOT EDIT.\n" + licence + "*/\npackage a\n"), ("a/hand.py", "python", hashes + "x = 1\n# @generated\n"), ("a/open.js", "javascript", "/* @generated\n" + licence), ("a/huge.js", "javascript", "/*\n" + " * * a\n" * 200_000 + "@generated */\nf()\n"), ("a/marks.py", "python", ("#" * 80 + "\n") * 20_000 + "x = 1\n"),
    )
    got = {r.path: r.reason for r in generated.classify(df).collect()}
    assert got == {"a/behind.py": "generated", "a/behind.ts": "generated", "a/first.js": "vendored", "a/last.java": "generated", "a/top.go": "generated", "a/hand.py": None, "a/open.js": None, "a/huge.js": "generated", "a/marks.py": None}


def test_tables_of_literals(spark):
    rng = random.Random(3)
    rows = lambda one, n=250: "".join("    " + ", ".join(one() for _ in range(8)) + ",\n" for _ in range(n))
    decimals, signed = rows(lambda: f"{rng.random():.3f}"), rows(lambda: f"-{rng.random():.3f}")
    powers = rows(lambda: f"{rng.random():.3f}e-{rng.randrange(9)}")
    blob = "".join('    b"' + "".join(f"\\x{rng.randrange(256):02x}" for _ in range(16)) + '"\n' for _ in range(60))
    settings = "".join(f"limit_{i} = {i}\nratio_{i} = -0.{i}\n" for i in range(40))
    df = files(
        spark,
        ("a/d.py", "python", "W = [\n" + decimals + "]\n"), ("a/s.py", "python", "W = [\n" + signed + "]\n"), ("a/e.ts", "typescript", "const w = [\n" + powers + "]\n"), ("a/f.java", "java", "class A { float[] w = {\n" + decimals.replace(",", "f,") + "}; }\n"), ("a/x.py", "python", "B = (\n" + blob + ")\n"),
        ("a/w.json", "json", "[\n" + decimals.rstrip(",\n") + "]\n"), ("a/m.json", "json", "{" + ",".join(f'"key{i}":"value{i}"' for i in range(90)) + "}"), ("a/w.toml", "toml", "w = [\n" + signed + "]\n"), ("a/c.toml", "toml", settings), ("a/c.json", "json", "{\n" + ",\n".join(f'  "limit_{i}": -0.{i}' for i in range(60)) + "\n}\n"), ("a/h.py", "python", "def f(a):\n    return a[1] - 0.5 * a[0] + 1e-3\n" * 20),
    )
    got = {r.path: (r.reason, r.number_density) for r in generated.classify(df).collect()}
    assert {p: reason for p, (reason, _) in got.items()} == {"a/d.py": "data", "a/s.py": "data", "a/e.ts": "data", "a/f.java": "data", "a/x.py": "data", "a/w.json": "data", "a/m.json": "minified", "a/w.toml": "data", "a/c.toml": None, "a/c.json": None, "a/h.py": None}
    assert all(0.49 < got[p][1] < 0.51 for p in ("a/d.py", "a/s.py", "a/e.ts", "a/f.java", "a/w.json"))


def test_layout_numbers(spark):
    r = generated.layout(spark.createDataFrame([("ab 1\r\n22\n",)], "content string")).first()
    assert (r.chars, r.lines, r.max_line, round(r.space_share, 4), round(r.number_density, 4)) == (9, 2, 4, 0.4444, 0.6667)


# --- 7 ----------------------------------------------------------------------
def test_gll_takes_ambiguous_and_left_recursive_grammars():
    g = gll.Grammar("s = e\ne = e '+' e | 'n' | e e", {}, "s")
    p = gll.Parse(g, ["n", "+", "n", "n", "+"], {})
    p.run([0, 2])
    assert p.matches(0) == [1, 3, 4] and p.matches(2) == [3, 4]
    empty = gll.Grammar("s = a* 'x'?\na = 'y' | 'y' 'y'", {}, "s")
    p = gll.Parse(empty, ["y", "y", "x"], {})
    p.run([0])
    assert p.matches(0) == [0, 1, 2, 3]


SOURCES = {
    "python": ("import a\n@d\nasync def f(self, x: int = 3, *ys, **kw) -> int:\n    '''Says more here.'''\n    return 1\n\nclass C:\n    def g(self):\n        def h(q): pass\n        return (\n", [("f", ["self", "x", "ys", "kw"]), ("g", ["self"]), ("h", ["q"])]),
    "rust": ("fn a<T: B>(&self, x: Vec<(u8, T)>, mut y: &mut Z) -> Option<T> where T: C { if x { } }\nfn b(\nimpl D { pub fn c(_: u8) {} }\n", [("a", ["self", "x", "y"]), ("c", ["_"])]),
    "go": ("package p\nfunc (r *R) A(x, y int, z ...string) (int, error) {\n\treturn 1, nil\n}\nfunc B( {\nfunc C() {}\n", [("A", ["x", "y", "z"]), ("C", [])]),
    "java": ("class A { @X public <T> Map<String, List<T>> f(final int[] a, T... b) throws E { g(a); return null; }\n void h() { int x = (; }\n int k(long q) { return 1; } ", [("f", ["a", "b"]), ("h", []), ("k", ["q"])]),
    "javascript": ("export async function f(a, {b, c} = {}, ...d) { if (x) { y() } }\nclass K { static m(q = (1, 2)) { return 1 }\n broken( { }\nconst g = async (z) => { w() }\n", [("f", ["a", "d"]), ("m", ["q"]), ("g", ["z"])]),
    "typescript": ("class K { private async m<T>(this: K, a?: Map<string, T>, b: () => void = x): Promise<void> { } }\n", [("m", ["this", "a", "b"])]),
}


@pytest.mark.parametrize("lang", SOURCES)
def test_functions_out_of_broken_files(lang):
    text, want = SOURCES[lang]
    assert [(n, p) for _, _, n, p in functions.find_functions(lang, text)] == want


PLACES = {
    "python": ("x = (1,\ndef f(a):\n    return a\n", ["f"]),
    "rust": ("x = \"cut \" here\nfn a() {}\njunk pub fn b() {}\n", ["a", "b"]),
    "go": ("package p\nx =\nfunc a() {}\nvar m = T{f: 1, g: func() {\n} +\nfunc b(x int) {}\n", ["a", "b"]),
    "java": ("class A {\n int x = 1 +\n int f(int a) { return a; }\n", ["f"]),
    "javascript": ("let o = { a() {}, b(q) {} }\n<% if lane %>\nexport function c(x) { d(x); }\nlet y = d(x)\nconst z = \n  d(y);\nfunction e() {}\nm.x = function g(p) {}\n", ["a", "b", "c", "e", "g"]),
    "typescript": ("const note = \"cut here\nexport function f(a: T): U { return a }\nlet v = 1\nasync function g() {}\ninterface I { h(a: T): void; }\n", ["f", "g", "h"]),
}


@pytest.mark.parametrize("lang", PLACES)
def test_functions_behind_anything(lang):
    text, want = PLACES[lang]
    assert [n for _, _, n, _ in functions.find_functions(lang, text)] == want


BEHIND = {"python": "def last(a):\n    return a\n", "rust": ";fn last(a: u8) {}\n", "go": ";func last(a int) {}\n", "java": ";int last(int a) { return a; }\n", "javascript": ";function last(a) { return a }\n", "typescript": ";function last(a: T) { return a }\n"}


@pytest.mark.parametrize("lang", BEHIND)
@pytest.mark.parametrize("fault", ["\x01 \x02 \x03\n", "x = \"cut here\n", "a ) ] }\n", "/* open\n"])
def test_functions_behind_thousands_of_faults(lang, fault):
    text = fault * 3000 + BEHIND[lang]
    assert [(n, p) for _, _, n, p in functions.find_functions(lang, text)][-1:] == [("last", ["a"])]


def test_recovery_keeps_the_state_of_lines_and_templates():
    text = "class C:\n    def f(self):\n        x = (1]\n      y = 2\n    def g(self):\n        pass\n"
    assert [n for _, _, n, _ in functions.find_functions("python", text)] == ["f", "g"]
    assert [n for _, _, n, _ in functions.find_functions("javascript", "function f() { x = `a${b} \n }\nfunction g() { }\n")][-1:] == ["g"]
    assert [n for _, _, n, _ in functions.find_functions("rust", "/* a /* b */ open\nfn f() {}\n/* /* c */ */ fn g() {}\n")] == ["f", "g"]


@pytest.mark.parametrize(
    ("doc", "more"),
    [
        ("/** TODO: document */", False), ("// eslint-disable-next-line", False), ('"""Drain the depot."""', False), ("/** Drains depots. */", False), ("/**\n * @param cur the cur\n * @return\n */", False), ("/// -----", False), ("# n/a", False), ("/** {@inheritDoc} */", False), ("// region helpers", False), ("/** @since 2.1 */", False), ("<summary></summary>", False), ("", False), (None, False), ("// See above.", False), ('"""Args:\n    cur:\n"""', False),
        ("/** TODO: make this faster once the index exists */", True), ("// Fails on an empty depot.", True), ("/// 排序步骤跳过没有变化的文件。", True), ("/** @param cur the shared ledger to use */", True), ("/** Drain the depot.\n * Older rows win. */", True), ("# noqa\n# Rounds half to even", True),
    ],
)
def test_trivial_documentation(doc, more):
    assert bool(functions.residue(doc, "drainDepot", ["cur"])) is more


SYMBOLS = "id string, name string, kind string, language string, file_path string, signature string, doc_comment string, code_context string, last_indexed long, symbol_id string, description string"


def test_documented_functions_table(spark):
    s = lambda i, doc, code="def f(a):\n    pass", kind="function", name="f", at=1, lang="python": (i, name, kind, lang, "p", None, doc, code, at, "clash", "clash")
    data = [s("a", "# Adds up all that is left"), s("b", "# TODO"), s("c", None), s("d", "# Adds up", code=" "), s("e", "# Adds up", kind="class"), s("g", "# Adds up", kind=None), s("h", "# Adds up"), s("h", "# TODO", at=2), s(None, "# Adds up"), s("i", "# Adds up", lang=None, name=None), s("j", "# the a", code="def f(a:\n  ???")]
    df = spark.createDataFrame(data, SYMBOLS)
    assert {r.symbol_id for r in functions.documented_functions(df).collect()} == {"a", "i"}
    assert functions.documented_functions(df.limit(0)).count() == 0


def test_residues_that_the_corpus_repeats_are_templates(spark):
    s = lambda i, doc, name: (f"{name}{i}", f"{name}{i}", "function", "python", "p", None, doc, f"def {name}{i}(a):\n    pass", 1, "clash", "clash")
    many = [s(i, f"# Helper of load{i}", "load") for i in range(30)] + [s(i, "# Documentation goes here.", "here") for i in range(12)]
    told = [s(i, f"# Rounds {'xyz'[i % 3] * 3} half to even and logs it", "told") for i in range(60)] + [s(i, "# Fails early", "rare") for i in range(7)]
    got = {r.symbol_id for r in functions.documented_functions(spark.createDataFrame(many + told, SYMBOLS), texts=False).collect()}
    assert got == {f"told{i}" for i in range(60)} | {f"rare{i}" for i in range(7)}


def test_comments_and_lines_of_many_functions():
    text = "".join(f"# tells {i}\n# more\ndef f{i}(a):\n    return a\n\n" for i in range(300))
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    at = text.index("def f299")
    assert functions.comment_before("python", text, at, breaks) == "# tells 299\n# more"
    assert functions.comment_before("go", "/* a\n b */\nfunc f() {}\n", 11, [4, 10, 22]) == "/* a\n b */"
    assert functions.comment_before("python", "def f(): pass", 0, []) is None


def test_templates_are_dropped(spark):
    d = spark.createDataFrame([(str(i), "Does the usual thing.") for i in range(40)] + [(f"x{i}", f"Tells {chr(97 + i)} apart") for i in range(20)], "symbol_id string, description string")
    assert {r.symbol_id[0] for r in functions.pairs(d).collect()} == {"x"}
    assert functions.pairs(d.limit(0)).count() == 0


# --- 8 ----------------------------------------------------------------------
@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks())


def _plain(encoder, word: bytes):
    """Merges by scanning all pairs again and again."""
    ids = [encoder.byte[b] for b in word]
    while True:
        pairs = [(encoder._pair(a, b), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        best = min(pairs, default=(bpe.NONE, 0))
        if best[0] == bpe.NONE:
            return ids
        ids[best[1]:best[1] + 2] = [best[0]]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=60))
def test_merges_against_plain_scans(encoder, word):
    assert encoder.merge(word) == _plain(encoder, word)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(encoder, text):
    assert bpe.decode(encoder.encode(text), bpe.read_ranks()) == text


def test_against_the_library(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks().splitlines())}
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("Hello world's <|endoftext|>", "日本語 🙂\u200d", "a" * 5000, " \n\n\t x", "été\r\n"):
        assert encoder.encode(text) == lib.encode_ordinary(text)


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (None, "Hello"), (1, "Hello world"), (4, "x" * 100_000)], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("tokens", F.lit(1))
    got = sorted(((r.doc_id, list(r.ids)) for r in bpe.encode(df).collect()), key=lambda x: (x[0] is None, x[0] or 0, len(x[1])))
    assert got[0] == got[1] == (1, [15496, 995]) and got[2][1] == got[3][1] == [] and got[-1] == (None, [15496]) and len(got) == 6
    counts = {r.doc_id: r.tokens for r in bpe.encode(df, counts_only=True).collect()}
    assert counts[2] == counts[3] == 0 and counts[1] == 2


# --- 9 ----------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_plans_use_every_item_once(counts):
    plan = packing.plan(counts, 64)
    used: dict[int, int] = {}
    for times, share, pattern in plan:
        window = 64 // share
        assert sum(pattern) <= window and times > 0 and (share == 1 or (window - sum(pattern)) * packing.SLACK <= window)
        for s in pattern:
            used[s] = used.get(s, 0) + times
    assert used == counts and len(plan) <= 64 * 8
    slots = packing.Slots(plan, 64, 4)
    rows = [(s, r) for s, n in counts.items() for r in range(n)]
    got = slots.place(np.array([s for s, _ in rows], np.int64), np.array([r for _, r in rows], np.int64))
    spans: dict[int, list] = {}
    for (s, _), c, at in zip(rows, got["container_id"], got["at"]):
        spans.setdefault(c, []).append((at, at + s))
    assert sorted(spans) == list(range(slots.containers))
    for found in spans.values():
        found.sort()
        assert found[0][0] >= 0 and found[-1][1] <= 64 and all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert all(len(set(t)) == 1 or c >= slots.containers - 3 for c, t in got.groupby("container_id")["tier"].apply(list).items())


def test_tiers_matter_and_waste_little():
    rng = np.random.default_rng(2)
    sizes, n = np.unique(np.minimum(2048, rng.lognormal(5.5, 1.1, 40_000).astype(int) + 1), return_counts=True)
    counts = dict(zip(sizes.tolist(), n.tolist()))
    plan = packing.plan(counts, 2048)
    slots = packing.Slots(plan, 2048, 64)
    assert {share for _, share, _ in plan} == set(packing.TIERS)
    assert slots.containers <= math.ceil(sum(s * n for s, n in counts.items()) / 2048) * 1.01 + len(packing.TIERS)


def test_packing_table(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([0, 1, 5, 30, 64, 65, 200])) for i in range(600)] + [(600, None), (601, -3), (None, 7), (5, 5)]
    df = spark.createDataFrame(data, "doc_id long, tokens long").withColumn("part", F.lit("clash"))
    got = packing.pack(df, capacity=64, step=4).collect()
    fill, total = {}, 0
    for r in got:
        if r.container_id is None:
            assert r.length == 0
            continue
        fill.setdefault(r.container_id, []).append((r["at"], r["at"] + r.length))
        total += r.length
    for spans in fill.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 64 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert total == sum(max(0, n or 0) for _, n in data) and total / (64 * len(fill)) > 0.95 and sorted(fill) == list(range(len(fill)))
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert all(len(v) == v[0].parts for k, v in by_doc.items() if k not in (5, None)) and {r.parts for r in got if r.length and r.length < 64 and r.start == 0} <= {1, 2, 4}
    steps = {}
    for r in got:
        if r.container_id is not None:
            steps.setdefault(r.step_group, set()).add(r.container_id)
    assert all(1 <= len(c) <= 4 for c in steps.values()) and sorted(steps) == list(range(len(steps)))
    assert packing.pack(df.limit(0), capacity=64).count() == 0


def test_fill_report(spark):
    df = spark.createDataFrame([(1, 60), (2, 4), (3, 10)], "doc_id long, tokens long")
    packed = packing.pack(df, capacity=64)
    got = {r.tier: (r.windows, r["items"], r.tokens, r.unused) for r in packing.fill_report(packed).collect()}
    assert got == {64: (2, 3, 74, 54)}
    assert packing.check(packed, 64).collect() == [(3, 74, 0, 0, 0, True, True)]
    assert packing.check(packing.pack(df.limit(0)), 64).collect() == [(0, 0, 0, 0, 0, True, True)]


# --- 10 ---------------------------------------------------------------------
def test_labels():
    want = {"en-US": "en", " EN ": "en", "English": "en", "français": "fr", "zh-Hans": "zh", "por": "pt", "und": None, "": None, "??": None, "n/a": None, "-": None, None: None, "ko": "", "Klingon": ""}
    assert {k: language.label_code(k) for k in want} == want


def test_prose_alone_makes_sentences():
    text = "# Heading here\n\nfix(core): It reads the `lines` first. The (`x`) index waits!\n\n```\nreturn a. b c d.\n```\n| a | b |\n* Il ne trouve pas la route.\n\nfoo(bar);\nfragment without end"
    got = [(s, full) for s, _, full in language.sentences(text)]
    assert [g[0].replace("  ", " ") for g in got if g[1]] == ["It reads the lines first.", "The ( ) index waits!", "Il ne trouve pas la route."] or len([g for g in got if g[1]]) == 3
    assert language.sentences(None) == language.sentences(" \n") == language.sentences("def f(x):\n    return x\n") == []
    assert [f for *_, f in language.sentences("这个解析器会重新建立引用关系。次の公開の前に名前を変えてください。")] == [True, True]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    f = language.Field()
    n = len(language.LANGUAGES)
    f.t = rng.normal(size=(n, n))
    e = rng.normal(size=(1, 3, n))
    import itertools

    z, want = 0.0, np.zeros((3, n))
    for path in itertools.product(range(n), repeat=3):
        w = np.exp(sum(e[0, i, k] for i, k in enumerate(path)) + sum(f.t[a, b] for a, b in zip(path, path[1:])))
        z += w
        for i, k in enumerate(path):
            want[i, k] += w
    got, moves, logz = f.marginals(e, np.array([3]))
    assert np.allclose(got[0], want / z) and np.isclose(logz[0], np.log(z)) and np.isclose(moves.sum(), 2)
    padded, _, logz2 = f.marginals(np.concatenate([e, np.zeros((1, 2, n))], 1), np.array([3]))
    assert np.allclose(padded[0, :3], want / z) and np.isclose(logz2[0], np.log(z))


SENTENCES = {
    "en": "The index reads the {} lines before it writes them to the disk. We could not find where the {} was defined.",
    "de": "Der Index liest die {} Zeilen bevor er sie auf die Platte schreibt. Wir konnten nicht finden, wo die {} festgelegt ist.",
    "fr": "L'index lit les {} lignes avant de les écrire sur le disque. Nous ne trouvons pas où la {} est définie.",
    "es": "El índice lee las {} líneas antes de guardarlas en el disco. No encontramos dónde se define la {} nueva.",
    "nl": "De index leest de {} regels voordat hij ze naar de schijf schrijft. Wij kunnen niet vinden waar de {} wordt vastgelegd.",
    "ru": "Индекс читает {} строки перед записью на диск. Мы не нашли где определена эта {} переменная.",
    "ja": "この索引は行を先に読みます。私たちは定義を見つけられません。",
    "zh": "这个索引先读取修改过的行。我们没有找到定义的地方。",
}
NOUNS = ["quota", "ledger", "turbine", "parcel", "meter", "voucher", "depot", "kiln"]


def _training(rng):
    rows = [(SENTENCES[k].format(rng.choice(NOUNS), rng.choice(NOUNS)), k) for k in SENTENCES for _ in range(25)]
    return rows + [(SENTENCES["fr"].format("x", "y"), "en")] * 6  # wrong labels


def test_field_on_held_out_and_mixed_text(spark):
    field = language.train(_training(random.Random(5)))
    held = [(k, SENTENCES[k].format("silo", "harvest")) for k in SENTENCES]
    for k, text in held:
        found = language.sentences(text)
        assert {lang for lang, _ in field.label([[w for _, w, _ in found]])[0]} == {k}
    mixed = SENTENCES["en"].format("a", "b") + "\n\n" + SENTENCES["de"].format("a", "b")
    docs = [(1, SENTENCES["en"].format("q", "w"), "EN"), (2, SENTENCES["fr"].format("q", "w"), "en"), (3, SENTENCES["de"].format("q", "w"), None), (4, mixed, "en"), (5, None, None), (6, "", "xx"), (7, "x = 1;", None), (8, SENTENCES["ja"], "Japanese"), (9, SENTENCES["es"].format("q", "w"), "ko"), (None, SENTENCES["nl"].format("q", "w"), "de")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("confidence", F.lit("clash"))
    seg = language.segment(df, field=field)
    got = sorted(((r.doc_id or 0, r.lang) for r in language.mislabelled(seg).collect()))
    assert got == [(0, "nl"), (2, "fr"), (3, "de"), (4, "de"), (4, "en"), (9, "es")]
    assert language.segment(df.limit(0)).count() == 0  # also fits on nothing


def test_features_cover_whole_words():
    long = "a" * 30 + "straße" + "b" * 30
    assert set(language.features(long)) != set(language.features("a" * 30 + "strasse" + "b" * 30))


def test_a_field_is_fitted_once_and_saved(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(_training(random.Random(5)))], "doc_id long, text string, lang string")
    first = language.fitted(df, "doc_id", "text", "lang")
    monkeypatch.setattr(language, "_fields", {})
    monkeypatch.setattr(language, "train", None)  # must not be called again
    again = language.fitted(df, "doc_id", "text", "lang")
    assert (again.w == first.w).all() and (again.t == first.t).all()


def test_held_out_accuracy_without_the_lexicon(monkeypatch):
    monkeypatch.setattr(language, "features", lambda w, f=language.features: [x for x in f(w) if x not in {language.zlib.crc32(f"l{k}".encode()) % language.BUCKETS for k in language.LANGUAGES}])
    field = language.train(_training(random.Random(5)))
    for k in SENTENCES:
        found = language.sentences(SENTENCES[k].format("silo", "harvest"))
        assert {lang for lang, _ in field.label([[w for _, w, _ in found]])[0]} == {k}


def test_stretches_keep_their_places(spark):
    field = language.train(_training(random.Random(5)))
    de, en = (SENTENCES[k].format("quota", "ledger") for k in ("de", "en"))
    inside = "Der Index liest die Zeilen, the index writes them before it reads them to the disk, bevor er sie auf die Platte schreibt."
    docs = [(1, f"{de}\n\n```\n{en}\n```\n{en}\r\n\r\n{de}\n\n{en}", "de"), (2, inside, "de"), (3, None, None), (4, "x = 1;", "en")]
    seg = sorted(map(tuple, language.stretches(spark.createDataFrame(docs, "doc_id long, text string, lang string"), field=field).collect()))
    text = docs[0][1]
    assert [(r[0], r[2], r[5]) for r in seg] == [(1, 0, "de"), (1, 1, "en"), (1, 2, "de"), (1, 3, "en"), (2, 0, "de"), (2, 1, "en"), (2, 2, "de")]
    assert [text[r[3]:r[4]] for r in seg if r[0] == 1] == [x.rstrip(".") for x in (de, en, de, en)] and seg[1][3] > text.index("```\n" + en[:3], 5)
    assert "writes them before it reads" in inside[seg[5][3]:seg[5][4]] and all(0.1 < r[7] <= 1 for r in seg)


def test_placed_words_are_those_of_sentences():
    hard = ["* cafe\u0301 na\u00efve.\r\nfix(core): It\u200b reads `x` the foo_bar lines\u2028first (now).  \n\n> [x] Il ne trouve pas https://a.b/c la route! Ja.\n```\nfor x in y:\n```\nend", "\u8fd9\u4e2a\u3002\u6b21\u306e\u304b\u3099\u3002\u1112\u1161\u11ab \u1100\u1173\u11af.", "", None]
    hard += [x.format("a b", "c") for x in SENTENCES.values()]
    for text in hard:
        got = language.placed_words(text)
        assert [[w for w, _, _ in s] for s in got] == [w for _, w, _ in language.sentences(text)]
        for w, a, b in (x for s in got for x in s):
            assert language._INVISIBLE.sub("", unicodedata.normalize("NFC", text[a:b])).lower() == w
