import ast
import json
import tomllib
import warnings

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkbom.llm import syntax as S

GOOD = {
    "py": ["", "x = 1\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': b, **c} | None: pass\n", "async def f(a, /, b=1, *c, d, **e) -> int:\n    async with a as b, c: yield b\n    return await x\n", "f'{x!r:>{w}} {y=}'\n",
           "type A[T: int] = list[T]\nclass B[*Ts](C, metaclass=M): x: int = 3\n", "try: pass\nexcept* (A, B) as e: pass\n", "a, *b = c = lambda *a, k=1: (yield)\nx = [i async for i in j if i if k]\n", "print(*a, b=1, **c)\n", "with (open(a) as b, c): pass\n", "del a[1:2, ::3], b.c\nx[*y] = (z := 1)\n"],
    "js": ["", "a = b\n++c\n", "for (const [k, v] of Object.entries(x)) { if (a) continue\n else b() }", "const f = async ({a, b = 2, ...c}, [d]) => ({ a, [b]: 1, get x() { return 1 }, async *g() {} })", "x = a ? /re[/]x/g.test(b) : c / d / e",
           "`a${`b${c}`}d`", "class A extends B { #p = 1; static { this.x = 2 } static async m() { super.m(); return #p in this } get [k]() { return new.target } }", "l: for (;;) { break l }", "let async = 1; async\n(a)", "do x++; while (x < 5) y()", "return_ = a?.b?.[c]?.(d) ?? e", "var let_ = function* () { yield* a }"],
    "java": ["class A { int x = (int) y + (z) - 1; List<Map<String, int[]>> m = new ArrayList<>() {{ add(null); }}; }", "record P<T>(int a, T... b) implements I { P { if (a < 0) throw new X(); } }", "sealed interface S permits A, B {} enum E { X(1) { void f() {} }, Y; E(int... a) {} }",
             "class A { void f() { var r = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; if (o instanceof String s && s.length() > 2 == a < b) g(A::new, x -> x + 1, (a, b) -> { }); for (int i = 0, j = 1; i < n; i++, j--) l[i] >>>= 2; try (var z = q(); w) { } catch (A | B e) { } } }",
             '@A(x = {1, 2}) class B { @Override public <T extends C & D> T m() throws E { return this.<T>n("""\n  text "q" \\\n """); } int[] a[] = {{1}, {}}; }', "package a.b; import static c.D.*; @interface I { int v() default 1; }"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"]}', "3", ' "x" '],
    "toml": ["", 'a.b = 1\n[t."x y"]\nk = [1,\n 2, # c\n]\n[[q]]\nd = 1979-05-27T07:32:00Z\n[[q]]\ni = {a = 1, b.c = "x"}\n', "x = '''a\nb'''\ny = 0xFF_F\nz = -inf\n"],
}
BAD = {
    "py": ["print 'x'\n", "def f(:\n", "if x:\npass\n", "x = (1,\n", "f() = 1\n", "a b\n", "\tx\n        y\n", "try:\n    pass\n", "except A, B: pass\n", "x = 0777\n", "<<<<<<< HEAD\n", "f'{'\n", "f(a=1, b)\n", "x = “a”\n"],
    "js": ["{\"a\": 1, \"b\": 2}", "const = 4;", "let s = 'open", "a b", "import x from 'y'\nexport default x", "function f( { }", "x = `a${", "if (a", "foo(,)", "}", "<<<<<<< HEAD", "return a +;"],
    "java": ["class A { int x = ; }", "class A { void f() { a + b; } }", "class A {", "from x import y", "class A { void f() { retrun x y; } }", "package a;\npackage b;", "class A { String s = \"open; }"],
    "json": ["", "{'a': 1}", "[1,]", '{"a": 1,}', "// c\n{}", "01", '{"a": 1} x', "NaN", '"a\nb"'],
    "toml": ["a = 1\na = 2\n", "a =\n", "[t\n", "a = 01\n", "[a]\n[a]\n", "a = {b = 1,}\n", "x = 'a\n", "a b = 1\n", "a = 1\n[a.b]\n", "k = 1 2\n"],
}


MORE_GOOD = {
    "py": ['def f(a, b=1, /, c=2, *, d, e=1, **k): pass\n', 'lambda a, *b, c=1, **d: 0', 'def f(*a: *T, b): pass\n', "b'a' b'\\xff'", "match x:\n case -1-2j | {'a': 1, **r} | A(1, b=2,): pass\n",
        'try: pass\nexcept* A: pass\nexcept* B: pass\n', "r'\\x4'", "rb'\\x'", "f'{x!r:>{w}}' rf'\\N{x}'", 'del (a, b), [c], d.e\n', '*a, = b\n', "x = '\\N{BULLET}'", 'def f(a, /): pass', 'lambda: (yield)',
        "print(f'{x = }')", '_ = 1\nmatch _:\n case _: pass'],
    "js": ['if (a) /re/.test(b)', 'while (x) /a/.exec(y);', '0b11; 0o17; 1_000n; .5e3; 1.; 0x1fn; 017; 09.5', '({a = 1} = x)', '[{a = 1}] = y', '({a = 1}) => a', 'async ({a = 1}, b) => await b', 'for ({a = 1} of y) ;',
        '({x: {a = 1}, y} = z)', 'f(async x => await x, 1)', 'async function f() { for await (const x of y) await x }', 'function* g() { const x = yield 1; yield* a }', 'var await = 1, yield = 2; await + yield',
        'x = function () { return /a/ }', 'function f() { return }', 'a = b\n/c/d', 'const [a, {b = 1, ...c}, ...d] = e, {f: {g = 1} = {}} = h', '(a) = 1; (a.b) = 2; ++a.b; a.b--; [a, b.c] = [1, 2]',
        'if (a) function f() {}', 'let x, y = 1; const z = 2; for (const i = 0; ;) {}', 'for (let i in o) for (x.y of z) ;', 'a?.b.c(1)?.[d]; new A; new A.B(1).c; new (f())()',
        'class A { static #x = 1; get() {} async *[Symbol.iterator]() { yield await 1 } static async of(x) { return x } }', 'const f = async () => { await g(); }; const h = async (x) => (await x).y',
        'label: for (;;) { continue label }', 'x = {get, set, async, await: 1, yield: 2, let: 3, static: 4, get a() { return 1 }}', '`${`${a}`}` + tag`x`', 'switch (a) { case /x/.test(b): break; default: }',
        'var { a, b: [c] } = d;', "'use strict'\nvar a = 1\n;(function () { return 1 })()", 'x = a ? (b) : c => d', 'export_ = 1', "o = { async f() { await 1 }, *g() { yield 1 }, 'a'() { return }, 1() {} }",
        'do x++; while (x < 5)\ny()', 'async function f() { return await Promise.all(xs.map(async (x) => await g(x))) }', 'const fn = async function () { await a }', '', 'var a = function(){}, b = /x/',
        'a = b ? /x/ : /y/', 'x = y / z / w', 'x = (y) / z', 'x[0] / y', 'if (x) { } /re/.exec(y)', 'f(/a/, [/b/])', 'const {a, ...rest} = b', "import('x').then(({ default: d }) => d)", "'\\u{1F600}\\x41\\\n'"],
    "toml": ['a = "x"', 'a="x" # c', 'a = 1979-02-28', '[a.b.c]\n[a]\nd = 1', '[[a]]\n[a.b]\n[[a]]\n[a.b]', 'a = ["x", {b = "y"}, [\'z\']]', 'a.b.c = 1\na.b.d = 2\n[a.b.e]', "k = '''x\r\ny'''", 'a = {b.c = 1, b.d = 2}',
        '"a.b" = 1\na.b = 2', '[a]', 'a = 2000-02-29 07:32:00', 'x = "\\u00e9\\U0001F600"', 'a = [\n[1, 2], # c\n]'],
    "java": ['module a.b { requires x; exports y; }', '@X open module a { requires transitive static b.c; exports d to e, f; opens g; uses h; provides i with j, k; }',
        'class A { int x = 07, y = 0; double z = 09.5, w = 09e1, v = 0_7; List<@N String> l; int requires = 1; }', 'class A { void f() { exports.add(1); opens = to.with(2); } }', ''],
    "json": ['1', '{}'],
}
MORE_BAD = {
    "py": ['def f(a=1, b): pass\n', 'def f(*): pass\n', 'def f(**k, a): pass\n', 'lambda **k, a: 0\n', 'def f(a, /, b, /): pass\n', '"a" b"b"\n', 'b"é"\n', 'match x:\n case 1+1: pass\n',
        'match x:\n case {**a, "b": 1}: pass\n', 'match x:\n case A(b=1, c): pass\n', 'try: pass\nexcept A: pass\nexcept* B: pass\n', "x = '\\x4'\n", "x = '\\N{no such}'\n", "f'{x!z}'\n", 'del *a\n', "f'{a b}'\n",
        'def f(*, **k): pass\n', 'def f(a, *, /): pass\n'],
    "js": ['return 1', 'await x', 'yield 1', 'const x;', 'let let = 1', '({a:1, b = 2})', 'if (a) let x = 1', '1 = 2', 'a?.b = 1', 'x = 08n', 'f() = 1', 'x = {a = 1}', 'f({a = 1})', 'while (1) class A {}',
        'function f() { await x }', 'x => { yield 1 }', "'\\x4'", 'a = /x/gz1;', 'for (const x;;) {}', 'function f(...a, b) {}', '0_1', 'if (x) const y = 1', 'f(async x => 1, await z)', '[{a = 1}]'],
    "toml": ['a = 1979-02-30', 'a = \'\\ud800\'\nb = "\\ud800"', 'a = 1\na = 2', 'a.b = 1\na = 2', '[a]\n[a]', 'a = {b = 1}\n[a.c]', 'a = {b = 1}\na.c = 2', '[[a]]\n[a]', 'a = []\n[[a]]', 'a = [{b = 1, b = 2}]',
        '[a.b]\n[a]\nb.c = 1', 'a = "x" "y"'],
    "java": ['class A { int x = 09; }', 'module a { foo b; }', 'class A { void f() { const int x = 1; } }'],
    "json": ['[1] x', '\ufeff1'],
}


@pytest.mark.parametrize("ext", GOOD)
def test_more_good_and_bad_with_and_without_a_last_line_break(ext):
    for texts, good in ((MORE_GOOD[ext] + GOOD[ext], True), (MORE_BAD[ext], False)):
        for text in texts:
            for end in ("", "\n"):
                assert (S.first_error(ext, text.rstrip("\n") + end) is None) == good or ext == "py" and "\n" in text.strip() and not end, text


@pytest.mark.parametrize("ext", GOOD)
def test_good_and_bad(ext):
    for text in GOOD[ext]:
        assert S.first_error(ext, text) is None, text
    for text in BAD[ext]:
        assert S.first_error(ext, text), text


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_mutations_agree_with_the_standard_library(data):
    warnings.simplefilter("ignore")
    ext = data.draw(st.sampled_from(["py", "json", "toml"]))
    text = data.draw(st.sampled_from(GOOD[ext]))
    at = data.draw(st.integers(0, len(text)))
    cut = data.draw(st.integers(0, 3))
    text = text[:at] + data.draw(st.sampled_from(["", "(", ")", "]", "=", ",", "x", "\n", " ", "1", "'", ":", "if "])) + text[at + cut :]
    try:
        {"py": ast.parse, "json": lambda t: json.loads(t, parse_constant=int), "toml": tomllib.loads}[ext](text)
        good = True
    except Exception:
        good = False
    assert (S.first_error(ext, text) is None) == good, text


def test_a_fault_of_the_parser_is_seen_and_ends_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "first_error", lambda e, t: [][1])
    assert S.verdict("py", "x = 1") == ("failed", None, "IndexError") and S.verdict("py", None)[0] == "unread" and S.verdict("txt", "")[0] == "unknown"
    rows = spark.createDataFrame([("r", "python", "failed"), ("r", "python", "broken"), ("r", "python", "parsed"), ("s", "json", "failed"), ("r", "python", "unread")], "root string, language string, status string")
    assert {tuple(r) for r in S.rates(rows).collect()} == {("r", "python", 3, 1, 1, 0.5), ("s", "json", 1, 0, 1, None)}


def test_status_and_rates(spark):
    rows = [(1, "r", "a.py", "x = 1", "x"), (1, "r", "a.py", "x = 1", "x"), (2, "r", "b.py", "x =", "x"), (3, "r", "c.py", None, None), (4, "s", "d.txt", "?", "x"), (5, None, "e.json", "", "x"), (6, "r", "f.js", "f(" * 3000 + ")" * 3000, "x")]
    df = spark.createDataFrame(rows, "file_id long, root string, file string, content string, status string")
    got = {r.file_id: r.status for r in S.parse_status(df).collect()}
    assert got == {1: "parsed", 2: "broken", 3: "unread", 4: "unknown", 5: "broken", 6: "broken"} | {6: got[6]}
    assert {(r.root, r.language, r.files, r.broken) for r in S.rates(S.parse_status(df)).collect()} >= {("r", "python", 2, 1), (None, "json", 1, 1)}
    assert S.parse_status(df.limit(0)).count() == 0
