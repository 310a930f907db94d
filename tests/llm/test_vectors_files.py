"""Nearest vectors, hand-written files and syntax checks."""

import random
import shutil
import subprocess

import numpy as np
import pytest

from skein.llm import handwritten, neighbors, syntax, validity
from skein.llm.syntax import data
from skein.llm.syntax.base import Reject

VECTORS = "point_id bigint, dense_vector array<float>, rep int, ids string"


def brute(rows, k, least):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    n = np.linalg.norm(x, axis=1)
    out = {}
    for a in range(len(ids)):
        sims = np.round(np.sum(x * x[a], axis=1) / (n * n[a]), 6)
        order = [b for b in np.lexsort((ids, -sims)) if ids[b] != ids[a]][:k]
        out[int(ids[a])] = [(int(ids[b]), float(sims[b])) for b in order if sims[b] >= least]
    return out


def near(df, **k):
    out = {}
    for r in neighbors.nearest_vectors(df, **k).orderBy("point_id", "rank").collect():
        out.setdefault(r.point_id, []).append((r.neighbor, r.similarity))
    return out


def test_small_sets_are_exact_with_copies_and_dirt(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64)).astype(np.float32)
    good = [(i, base[i].tolist()) for i in range(40)] + [(100 + i, base[0].tolist()) for i in range(30)] + [(200 + i, (base[1] * (i + 2)).tolist()) for i in range(10)]
    dirt = [(900, None), (901, [0.0] * 64), (902, [1.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [1.0] * 63), (905, [None] + [1.0] * 63), (906, []), (None, base[2].tolist())]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + dirt + good[:5]], VECTORS)
    got, want = near(df, k=5), brute(good, 5, -1)
    assert set(got) == set(want)
    for i in want:
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], abs=1.1e-6)
        if i >= 100 or i == 0:
            assert got[i] == want[i]
    assert near(df, k=3, min_similarity=0.9999) == {i: v for i, v in brute(good, 3, 0.9999).items() if v}
    assert near(df.limit(0)) == {}
    assert near(spark.createDataFrame([(1, base[0].tolist(), 0, "")], VECTORS)) == {}


def test_recall_over_many_lists(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(60, 64))
    x = (centers[rng.integers(0, 60, 3000)] + 0.35 * rng.normal(size=(3000, 64))).astype(np.float32)
    x[:1000] = (centers[0] + 0.2 * rng.normal(size=(1000, 64))).astype(np.float32)  # a third lies in one place
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], VECTORS)
    for more in ({"list_size": 60}, {"list_size": 60, "longest": 40, "probes": 12}):  # the latter divides its lists once more
        got, want = near(df, k=5, **more), brute(rows, 5, -1)
        assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * sum(map(len, want.values()))
    assert neighbors.recall(df, neighbors.nearest_vectors(df, k=5, list_size=60), every=7).first().recall >= 0.9
    got, want = near(df, k=5, list_size=60), brute(rows, 5, -1)
    found = sum(len({n for n, _ in got[i]} & {n for n, _ in want[i]}) for i in want) / (5 * len(want))
    assert found >= 0.9
    pairs = {(r.point_a, r.point_b) for r in neighbors.similar_pairs(neighbors.nearest_vectors(df, k=5, min_similarity=0.85, list_size=60), 0.85).collect()}
    true = {(min(i, n), max(i, n)) for i, v in want.items() for n, s in v if s >= 0.85}
    assert len(pairs & true) >= 0.9 * len(true) and all(a < b for a, b in pairs)


def test_balanced_centroids_split_a_crowd():
    rng = np.random.default_rng(2)
    x = neighbors.unit(np.concatenate([np.ones((900, 8)) + 0.01 * rng.normal(size=(900, 8)), rng.normal(size=(300, 8))])).astype(np.float32)
    c = neighbors.balanced_centroids(x, 24)
    near_crowd = (c @ neighbors.unit(np.ones((1, 8)))[0] > 0.99).sum()
    assert near_crowd >= 12 and np.bincount(np.argmax(x @ c.T, axis=1)).max() < 200
    assert len(neighbors.balanced_centroids(np.ones((500, 4), np.float32) / 2, 10)) >= 5


CODE = "import logging\n\ndef load(a, b):\n    total = a + b\n    for item in source(total):\n        total = merge(item, 3)\n    return total\n"
FILES = "record_id bigint, collection string, rel_path string, language string, content string, kinds string, evidence int"


def kinds_of(spark, *files):
    rows = [(i, c, p, None, t, "x", 1) for i, (c, p, t) in enumerate(files)]
    got = {r.record_id: r.kinds for r in handwritten.classify_files(spark.createDataFrame(rows + rows[:2], FILES)).collect()}
    return [got.get(i) for i in range(len(files))]


def test_kinds_of_files(spark):
    rng = random.Random(1)
    table = "DATA = [\n" + "\n".join(", ".join(str(rng.randint(0, 10**6)) for _ in range(10)) + "," for _ in range(60)) + "\n]\n"
    fields = "".join(f"def get_field_{i:03}(row):\n    return row[{i}]\n\n" for i in range(80))
    minified = "".join(f"function {rng.choice('abc')}(e){{return e.{rng.choice(['x', 'y'])}({rng.randint(0, 99)})}}var {rng.choice('def')}=1;" for _ in range(60))
    files = [
        ("a", "src/x.py", CODE), ("a", "src/x.py", None), ("a", "src/x.py", ""), ("a", None, CODE), ("a", "src/y.py", "# Code generated by tool. DO NOT EDIT.\n" + CODE), ("a", "src/z_pb2.py", CODE),
        ("a", "src/banner.py", 'BANNER = "Code generated by tool. DO NOT EDIT."\n' + CODE), ("a", "src/w.py", '# banner text: "DO NOT EDIT" goes to line 1\n' + CODE), ("a", "package-lock.json", "{}"), ("a", "src/fields.py", fields),
        ("a", "node_modules/x/i.js", "f(1)"), ("a", "src\\vendors\\i.js", "f(1)"), ("a", "lib/q.js", "/*! quick v1.2.3 | (c) quick contributors | MIT licence */\nf(1)"), ("a", "src/l.js", "// Copyright the project authors. All files share one licence.\nf(1)"),
        ("a", "src/t.py", table), ("a", "src/t2.py", "import os\n" + table), ("a", "src/small.py", "SIZES = [1, 2, 3]\n" + CODE), ("a", "s/app.js", minified), ("a", "s/data.json", table), ("a", "x.min.js", "f(1)"),
    ]
    got = kinds_of(spark, *files)
    assert got == [[], None, [], [], ["generated"], ["generated"], [], [], ["generated"], ["generated"], ["vendored"], [], ["vendored"], [], ["blob"], [], [], ["minified"], [], ["minified"]]
    assert handwritten.classify_files(spark.createDataFrame([], FILES)).count() == 0


def test_copies_in_several_repositories(spark):
    rng = random.Random(6)
    words = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    body = "\n".join(f"{rng.choice(words)}({rng.choice(words)}, {rng.choice(words)});" for _ in range(40))
    copied = body + "\n" + body
    files = [("a", "m/x.js", copied), ("b", "n/y.js", copied), ("b", "n/z.js", "\n".join(f"{rng.choice(words)}({rng.choice(words)});" for _ in range(50)))]
    assert kinds_of(spark, *files) == [["vendored"], ["vendored"], []]
    assert kinds_of(spark, ("a", "m/x.js", copied), ("a", "n/y.js", copied)) == [[], []]


def test_copies_without_repetition(spark):
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(400)]
    line = lambda: f"{rng.choice(words)} = {rng.choice(words)}({rng.choice(words)}, {rng.choice(words)});\n"
    body, own, other = ("".join(line() for _ in range(60)) for _ in range(3))
    files = [("a", "m/x.js", body), ("b", "n/y.js", "".join(line() for _ in range(9)) + body), ("a", "m/own.js", own), ("b", "n/part.js", other + body[: len(body) // 3]), ("a", "m/s.js", "f(x);\n"), ("b", "n/s.js", "f(x);\n")]
    assert kinds_of(spark, *files) == [["vendored"], ["vendored"], [], [], [], []]
    assert kinds_of(spark, ("a", "m/x.js", body), ("a", "n/y.js", body)) == [[], []]


def test_random_literals_are_blobs(spark):
    rng = random.Random(21)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    short = "KEYS = [\n" + "".join(", ".join(f'"{some(letters, 8)}"' for _ in range(6)) + ",\n" for _ in range(50)) + "]\n"
    keyed = "const t = {\n" + "".join(f"  '{some(letters, 5)}': '{some(letters, 12)}',\n" for _ in range(90)) + "};\n"
    nouns = [some("aeioulmnrst", 2) + e for e in ("ing", "tion", "ment", "ness", "able", "er") for _ in range(15)]
    prose = "MESSAGES = [\n" + "".join(f'    "The {rng.choice(nouns)} of the {rng.choice(nouns)} was not {rng.choice(nouns)} here",\n' for _ in range(60)) + "]\n"
    files = [("a", "src/k.py", short), ("a", "src/k.js", keyed), ("a", "src/m.py", prose), ("a", "src/i.py", "import os\n" + short), ("a", "src/k.json", short), ("a", "src/c.py", CODE * 3 + short[: len(short) // 5])]
    assert not handwritten.is_data("src/k.py", short, len(short))
    assert kinds_of(spark, *files) == [["blob"], ["blob"], [], [], [], []]


def test_marks_after_a_long_licence():
    licence = "/*\n" + "".join(f" * Line {i} of the licence.\n" for i in range(14)) + " */\n\n"
    assert handwritten.evidence("src/a.go", licence + "// Code generated by tool. DO NOT EDIT.\npackage a\n") == ["generated"]
    assert handwritten.evidence("src/a.go", licence + "package a\n\n// Code generated by tool. DO NOT EDIT.\n") == []


def test_segments_do_not_see_their_neighbours():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 50, 500).astype(np.uint64)
    flat = np.concatenate([rng.integers(0, 50, 40).astype(np.uint64), x, np.full(10, 3, np.uint64), x])
    file, name, start, span = handwritten.segments(flat, np.repeat([0, 1, 3, 4], [40, 500, 10, 500]), 5)
    of = lambda i: list(zip(name[file == i].tolist(), start[file == i].tolist(), span[file == i].tolist()))
    assert of(1) == of(4) and len(of(1)) > 3 and not of(2) and not of(3)
    assert all(sum(s for *_, s in of(i)) == n and min(s for *_, s in of(i)) >= 32 for i, n in ((0, 40), (1, 500)))


def test_grammar_sizes():
    symbols = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 9, 8, 7], dtype=np.uint64)
    tokens, size, (at, _, covered) = handwritten.grammars(symbols, np.array([0] * 9 + [1] * 3), 2)
    assert tokens.tolist() == [9, 3] and size[1] == 3 and size[0] < 9
    same = np.full(4096, 5, dtype=np.uint64)
    tokens, size, (at, _, covered) = handwritten.grammars(same, np.zeros(4096, int), 1)
    assert size[0] <= 30 and covered.max() == 4096


GOOD = {
    "python": ["", "x = 1\r\n", "match x:\n    case [1, *_]: pass\n", "\ufeffx = 1"],
    "json": ['{"a": [1, 2.5e3, null]}', "1" * 5000, '"\\u00e9"'],
    "xml": ['<?xml version="1.0" encoding="ISO-8859-1"?><a b="1">\u00e9<!-- x --></a>', "<a/>"],
    "toml": ["", 'a = "x"\n[b]\nc = [1, 2]\n'],
    "yaml": ["", "a: 1\nb:\n- x\n- y: z\n  w: |\n    text: here\n     more\n", "--- \n- [a, {b: c}, 'd''e']\n- &x !t \"q\\n\"\n- *x\n...\n", "just\n  some text\n", "? a\n: b\n", "a: >-\n  <<<<<<< kept\n  =======\n", "k: v # c\n\n\n# end"],
    "javascript": ["", "a\nb", "x = /[/]}/g.test(y) / 2", "for (const [a, b] of c) { if (a) continue; }", "async () => { await x; for await (const y of z); }", "class A extends B { #p = 1; static { } get x() { return this.#p } }", "let {a = 1, ...b} = c, [d,,e] = f; `x${`y${1}`}`", "label: while (1) break label", "export default class {}\nimport a, {b as c} from 'x'", "a ?. b ?? c; x = a ? (b) : c => d", "if (a) b; else c\n++d"],
    "typescript": ["let x: Array<Map<string, number[]>> = new Map<string, number>() as any;", "type A<T> = T extends (infer U)[] ? U : never; interface B<T = {}> extends C<T> { (x: number): string; [k: string]: any; readonly y?: T }", "abstract class D<T extends E> { constructor(private readonly a: string, b?: number) { super() } abstract f(): void; }", "x = a < b; f<T>(y); enum F { A = 1, B }", "declare module 'm' { export const a: number }", "const g = <T,>(x: T): x is T => true; let t: [a: string, b?: number] = y!;"],
    "go": ["package a\n", 'package a\nimport (\n\t"fmt"\n)\nfunc (t *T[K]) F(a, b int, c ...string) (x int, err error) {\n\tif x := f(); x > 0 {\n\t}\n\tfor i, v := range m {\n\t\tgo func() { ch <- T{A: i} }()\n\t}\n\tswitch v := x.(type) {\n\tcase int:\n\t}\n\treturn\n}\n', "package a\ntype T[K comparable] struct {\n\tA int `x`\n\tpkg.B\n}\nvar x = map[string][]int{\"a\": {1}}\n"],
    "java": ["", "package a.b; import static c.D.*; @X(1) public final class E<T extends F & G> extends H<T> implements I { int[] a = {1, 2}, b; E() { this.a = new int[3]; } <U> U m(final U... x) throws J { for (var y : z) { if (y instanceof K k && k.l()) return (U) x[0]; } return switch (q) { case 1, 2 -> { yield null; } default -> (a, b) -> a + b; }; } }", "record P(int x) { } sealed interface S permits P { } enum Q { A(1) { }, B; Q(int... i) { } }", 'class T { String s = """\n  a "x" {\n  """; char c = \'{\'; Runnable r = Foo::bar; int m() { label: do { x >>>= 2; } while (a < b && c > d); try (var z = f()) { } finally { } return 1; } }'],
    "csharp": ["", "using System; namespace A.B; public sealed class C<T> : D<T>, E where T : class, new() { public int X { get; private set; } = 1; int this[int i] => a[i]; public static C<T> operator +(C<T> a, C<T> b) => a; async Task<int> F(ref int x, params int[] y) { await foreach (var z in G()) { yield return z; } var q = from a in b where a > 1 select new { a }; return o switch { int i when i > 0 => 1, { L: > 3 } => 2, _ => throw new E() }; } }", 'class A { string s = $"a{b:N2}{(c ? "x" : "y")}", t = @"c:\\d""q""", u = """\n raw " {\n """; char c = \'}\'; int? n = null; List<int> l = [1, ..r]; }', "#if X\nint x = 1; Console.WriteLine(x);\n#endif\n"],
}
BAD = {
    "python": ["def f(:\n", "x = (1\n", "if x:\n", "x = \ufffd1", "<<<<<<< HEAD\nx\n"],
    "json": ["", "{} {}", "{'a': 1}", "[1,]", "NaN", "// x\n{}", '"a\nb"'],
    "xml": ["", "<a>", "<a><b></a></b>", "<a b=1/>", "<a/><b/>", "&x;"],
    "toml": ["a = ", "[a\n", "a = 1\na = 2\n"],
    "yaml": ["a: b: c\n", "a: [1, 2\n", "a: 'x\n", "a:\n  b: 1\n c: 2\n", "- a\nb: c\n", "a: 1\n=======\nb: 2\n", "\ta: 1\n", "a: |\n    x\n  y\n", "a: 1\n>>>>>>> 3fa91c2 (x)\n", "a: @x\n", "{a, , b}\n", "a: \"\\q\"\n", "k: *\n"],
    "javascript": ["let x = ;", "f(1", "a b", "return 1", "break", "'abc", "`a${b", "if (a) else b", "<<<<<<< HEAD\n", "{\"a\": 1, \"b\": 2}", "f() = 1", "/(/", "x = /a/gg", "const a", "3in", "class { }", "#!x\n)", "let x = 1 2"],
    "typescript": ["let x: = 1", "type A = ;", "interface B { x: }", "function f(a: number: string) {}", "const x: number", "# notes\n", "enum { A }"],
    "go": ["", "func f() {}\n", "package a\nfunc f() {\n", "package a\nfunc f()\n{\n}\n", "package a\nvar x = \n", "package a\nfunc f() {\n\tx := \n}\n", "package a\nfunc f() {\n\tfor a, b := g() {\n\t}\n}\n", "package a\nfunc f() {\n\tif x := 1 {\n\t}\n}\n", "package a\nfunc f() {\n\tgo x\n}\n", "package a\nvar s = \"a\n", "package a\nx := 1\n"],
    "java": ["class A { void f() { x } }", "class A { void f() { int y = 1 } }", "class A { f() { } }", "class A { void f() { if (x { } } }", "class A {", "class A { } }", "package a", "class A { void f() { a + b; } }", 'class A { String s = "x; }', "class A { int[] a = new int[]; }", "class A { void f(int a,) { } }"],
    "csharp": ["class A { void F() { x } }", "class A { int x = 1 }", "class A {", "namespace A { int x; ", "class A { void F() { a + b; } }", 'class A { string s = $"{a"; }', "class A { int X { } }", "class A { void F(int a,) { } }", "using System\nclass A { }", "class A { void F() { a + b = c; } }"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_grammars(language):
    for text in GOOD[language]:
        syntax.GRAMMARS[language](text)
    for text in BAD[language]:
        with pytest.raises(Reject):
            syntax.GRAMMARS[language](text)


def test_deep_nesting_is_no_crash():
    for language in syntax.GRAMMARS:
        for text in ("(" * 3000 + ")" * 3000, "[" * 3000 + "]" * 3000, "{" * 5000):
            assert syntax.accepts(language, text) in (True, False)


@pytest.mark.skipif(not shutil.which("node"), reason="no JavaScript engine here")
def test_javascript_agrees_with_an_engine(tmp_path):
    rng = random.Random(8)
    base = "const lib = require('./x');\n\nfunction f(a, b) {\n  for (const k of g(a)) {\n    if (k > 3) { a = b ? [1, 2] : []; } else { c = /[({]\\/+/g.test(a); }\n    s = `x ${a}\n}`;\n  }\n  return a.map((x) => x + 1);\n}\nclass A { m(x) { return 'it\\'s'; } }\n"
    for n in range(60):
        i = rng.randrange(len(base))
        text = base[:i] + rng.choice(["", "(", ")", "{", "}", ";", "'", "=", ","]) + base[i + rng.randint(0, 2) :]
        (tmp_path / "t.js").write_text(text)
        (tmp_path / "t.cjs").write_text(text)
        ok = subprocess.run(["node", "--check", str(tmp_path / "t.cjs")], capture_output=True).returncode == 0
        if "return" in text and not ok:  # a module wrapper allows what a script does not
            pass
        assert syntax.accepts("javascript", text) == ok, (n, text)


def test_nesting_changes_no_verdict():
    """Within the grammars' own limits, a hundred thousand brackets are judged as three are."""
    n = 100_000
    good = {"json": ("[", "", "]"), "toml": ("[", "", "]"), "javascript": ("(", "1", ")"), "typescript": ("[", "1", "]"), "go": ("(", "1", ")"), "java": ("(", "1", ")"), "csharp": ("(", "1", ")")}
    frame = {"json": ("", ""), "toml": ("x=", ""), "javascript": ("x=", ";"), "typescript": ("let x=", ";"), "go": ("package p\nvar x = ", "\n"), "java": ("class A{int x=", ";}"), "csharp": ("class A{int x=", ";}")}
    for language, (left, core, right) in good.items():
        before, after = frame[language]
        assert syntax.accepts(language, before + left * n + core + right * n + after), language
        for bad in (left * n + core + right * (n - 1), left * n + ";" + right * n):
            assert not syntax.accepts(language, before + bad + after), language
    for text, ok in (('{"a":' * n + "1" + "}" * n, True), ('{"a":' * n + "}" * n, False), ("[1," * n + "]" * n, False), ("[1,2,{}]", True)):
        assert syntax.accepts("json", text) == ok
    data.deep_json('{"a": [1, -2.5e3, "\\u00e9", {}, []], "b": null}')
    for text in ("", "[", "{,}", '{"a"}', "[1,]", "[1 2]", '{"a":1,}', "01", "1 2"):
        with pytest.raises(Reject):
            data.deep_json(text)


def test_csharp_sections_that_are_left_out():
    for text, ok in (
        ("#if A\nclass X {\n#else\nclass X : Y {\n#endif\n}\n", True), ("class A{}\n#if false\nplain words, it's so\n#endif\n", True), ("#define A\n#if A && !(B || C)\nclass X{}\n#elif D\n(((\n#else\n)))\n#endif", True),
        ("#if A\nclass X{}", False), ("class X{}\n#endif", False), ("#if A == true\n((\n#endif", True), ("#if A != true\n((\n#endif", False), ("#region a\nclass X{}", False), ("#if A\n#if B\n((\n#endif\n#else\nclass X{}\n#endif", True),
        ("#if\nclass X{}\n#endif", False), ('class X{ string s = @"\n#if x\n"; }', True), ("class X{ int a; # if\n}", False),
    ):
        assert syntax.accepts("csharp", text) == ok, text


def test_files_are_judged_and_diagnosed(spark):
    rows = [
        (1, "c", "a.py", "python", "x = 1"), (2, "c", "b.py", "python", "package a\n\nfunc f() {\n\treturn\n}\n"), (3, "c", "c.py", "python", "def f(:\n  ("), (4, "c", "d.md", "markdown", "# ("), (5, "c", "e", None, "("), (6, "c", "f", "unknown", "("),
        (7, "c", "g.json", "json", ""), (8, "c", "h.go", "go", None), (9, None, "i.ts", "TypeScript", "let x = ;"), (10, "c", "j.py", "python", ""),
    ]
    files = spark.createDataFrame([(*r, True, "x") for r in rows + rows[:3]], "record_id bigint, collection string, rel_path string, language string, content string, valid boolean, parses_as string")
    got = {r.record_id: (r.valid, r.parses_as) for r in validity.check_files(files).collect()}
    assert got == {1: (True, "toml"), 2: (False, "go"), 3: (False, None), 4: (None, None), 5: (None, None), 6: (None, None), 7: (False, None), 9: (False, None), 10: (True, "python")}
    rates = {(r.collection, r.language): (r.files, r.invalid, r.wrong_extension, r.damaged, r.rate) for r in validity.invalid_rates(validity.check_files(files)).collect()}
    assert rates == {("c", "python"): (4, 2, 1, 1, 0.5), ("c", "json"): (1, 1, 0, 1, 1.0), (None, "TypeScript"): (1, 1, 0, 1, 1.0)}
    assert validity.check_files(files.limit(0)).count() == 0
