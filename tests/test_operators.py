"""Search, relations, state, graph and evaluation on small tables."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import vectors
from skein.operators import chunking, dependencies, evaluation, graph, incremental, relations, search, state

HITS = "query_id int, scorer string, collection string, point_id int, chunk_id string, score double"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_fusion_across_collections(spark):
    hits = spark.createDataFrame([(1, "dense", "a", 1, "chunk-b", 0.9), (1, "dense", "a", 2, "chunk-a", 0.8), (1, "dense", "b", 3, "chunk-a", 0.7), (1, "dense", "b", 4, "chunk-z", None)], HITS)
    out = search.cross_collection_rrf(hits).orderBy("position").collect()
    assert [(r.collection, r.chunk_id) for r in out] == [("b", "chunk-a"), ("a", "chunk-b"), ("a", "chunk-a")]
    assert out[0].score == 0.7


def test_fusion_does_not_depend_on_row_order(spark):
    data = [(1, c, f"c{i}", i + 1) for c in ("dense", "sparse") for i in range(6)]
    for seed in range(2):
        random.Random(seed).shuffle(data)
        got = search.fused(spark.createDataFrame(data, "query_id int, scorer string, chunk_id string, rank int"), ["query_id"], ["chunk_id"], 4, [F.col("chunk_id")])
        assert [r.chunk_id for r in got.orderBy("position").collect()] == ["c0", "c1", "c2", "c3"]


def test_adaptive_rerank(spark):
    far = [(1, "dense", "a", 1, "x", 0.9), (1, "sparse", "a", 1, "x", 5.0), (1, "dense", "a", 2, "y", 0.1), (1, "multivector", "a", 2, "y", 9.0)]
    near = [(2, "dense", "a", 1, "x", 0.9), (2, "sparse", "a", 2, "y", 5.0), (2, "multivector", "a", 2, "y", 9.0)]
    out = search.adaptive_rerank(spark.createDataFrame(far + near, HITS))
    first = {r.query_id: (r.chunk_id, r.skipped) for r in out.where("position = 1").collect()}
    assert first == {1: ("x", True), 2: ("y", False)}
    assert search.rerank_counters(out).first().asDict() == {"total": 2, "skipped": 1, "reranked": 1}


def test_vector_functions(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0], [[1.0, 0.0], [0.0, 2.0]])], "a array<double>, z array<double>, s array<double>, d array<array<double>>")
    got = r.select(vectors.norm(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("z")).alias("c0"), vectors.cosine(F.col("a"), F.col("s")).alias("c1"), vectors.normalized(F.col("z")).alias("u"), vectors.max_similarity(F.array("a"), F.col("d")).alias("m")).first()
    assert (got.n, got.c0, got.c1, got.u, got.m) == (5.0, 0.0, 0.0, [0.0, 0.0], 8.0)


def test_search_validates():
    for k in (0, 31):
        with pytest.raises(ValueError):
            search.validate(k)
    with pytest.raises(ValueError):
        search.validate(5, 30, 1)


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 200), st.integers(2, 30), st.data())
def test_windows_cover_every_line(spark, n, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    files = spark.createDataFrame([("c", "f", "python", "\n".join(map(str, range(n))))], "collection string, path string, language string, content string")
    got = chunking.windows(files, size, overlap).select("start_line", "end_line", "content").orderBy("start_line").collect()
    assert got[0].start_line == 1 and got[-1].end_line == n
    assert all(b.start_line == a.start_line + size - overlap for a, b in zip(got, got[1:]))
    assert all(r.content.split("\n") == [str(i) for i in range(r.start_line - 1, r.end_line)] for r in got)


def test_windows_reject_endless_overlap(spark):
    with pytest.raises(ValueError):
        chunking.windows(spark.createDataFrame([], "collection string, path string, language string, content string"), 10, 10)


def test_syntax_nodes():
    code = "import os\n\n@dec\ndef foo():\n    pass\n\nclass Bar:\n    def baz(self):\n        pass\n"
    assert chunking.syntax_nodes(code, "python") == [(3, 5, "foo", "function"), (7, 9, "Bar", "class")]
    assert [n[2] for n in chunking.syntax_nodes(code, "python", 2)] == ["baz"]
    assert chunking.syntax_nodes("package a\n\nfunc F(x int) int {\n\treturn 1 // }\n}\n", "go") == [(3, 5, "F", "function")]
    assert chunking.procedure_spans("SELECT 1\nCREATE PROCEDURE dbo.MyProc AS\nBEGIN\n  SELECT 1\nEND\nGO\n") == [(2, 5, "dbo.MyProc")]


def test_imports():
    assert chunking.imported_names("from a.b import c as d, e", "python") == ["d", "e"]
    assert chunking.imported_names("from a import *", "python") is None
    assert chunking.imported_names("import java.util.List;", "java") == ["List"]
    assert chunking.imported_names("import { a as b, c } from 'x';", "typescript") == ["b", "c"]
    assert chunking.imported_names('import "net/http"', "go") == ["http"]
    assert chunking.imported_names("use a::b as c;", "rust") == ["c"]
    assert chunking.imported_names('#include "x/y.h"', "c") == ["y"]
    for line, language, names in (
        ("import java.util.*;", "java", None), ("package a.b;", "java", None), ("import static a.B.c;", "java", ["c"]), ("using A.B;", "csharp", ["B"]), ("using X = A.B;", "csharp", ["X"]), ("using var f = Open();", "csharp", []),
        ("using (var f = Open())", "csharp", []), ("using Stream f = Open();", "csharp", []), ("namespace A.B;", "csharp", None), ("import D, { type T, a as b } from 'x';", "typescript", ["D", "T", "b"]), ("import type { T } from 'x';", "typescript", ["T"]),
        ("import * as ns from 'x';", "javascript", ["ns"]), ("import 'x';", "javascript", []), ("const { a, b: c } = require('x');", "javascript", ["a", "c"]), ("const f = { a, b };", "javascript", []), ("if (x) { y }", "javascript", []),
        ('import h "net/http"', "go", ["h"]), ('_ "a/b"', "go", []), ('. "a/b"', "go", None), ('"a/b"', "go", ["b"]), ("use a::{b, c as d, e::{self, f}};", "rust", ["b", "d", "e", "f"]), ("use a::*;", "rust", None), ("import x", "sql", []),
        ("import a.b.c", "python", ["c"]), ("x = 1", "python", []), ("import (", "python", []), ('#include <vector>', "cpp", []), ("#define N 3", "c", ["N"]),
    ):
        assert chunking.imported_names(line, language) == names, line
    assert chunking.declared('package a\n\nimport (\n\t"fmt" // x\n\ty "b/z"\n)\n', "go") == ["*", "fmt", "y"]
    assert chunking.declared("from a import (\n  b,\n  c as d,\n)\n\ndef f():\n    import e\n", "python") == ["b", "d", "e"]
    header = chunking.with_import_header("x = List()", ["import java.util.List;", "import java.util.Map;"], "java")
    assert header == "import java.util.List;\nx = List()"
    assert chunking.with_import_header(header, ["import java.util.List;"], "java") == header


def test_dependencies():
    pom = "<parent><groupId>g</groupId><artifactId>p</artifactId><version>1</version></parent><dependency><groupId>a</groupId>\n<artifactId>b</artifactId></dependency>"
    assert dependencies.manifest_dependencies(pom, "pom.xml") == [("b", "a", "", "compile", "maven"), ("p", "g", "1", "parent", "maven")]
    assert dependencies.manifest_dependencies('{"devDependencies": {"x": "^1"}}', "a/package.json") == [("x", "", "^1", "devDependencies", "npm")]
    assert dependencies.manifest_dependencies("require (\n  a/b v1\n  // c\n)\nrequire a/b v2\n", "go.mod") == [("b", "a/b", "v1", "", "go")]
    assert dependencies.manifest_dependencies('[dependencies]\nserde = "1"\n[dev-dependencies]\nx = "2"\n', "Cargo.toml") == [("serde", "", "1", "", "cargo"), ("x", "", "2", "dev", "cargo")]
    assert dependencies.manifest_dependencies("implementation 'g:a:1'\nproject(':lib')", "build.gradle") == [("a", "g", "1", "", "gradle"), ("lib", "", "", "project", "gradle")]
    assert [d[0] for d in dependencies.manifest_dependencies("numpy>=1\n# x\nrich\n", "requirements.txt")] == ["numpy", "rich"]
    assert [d[0] for d in dependencies.manifest_dependencies('<PackageReference Include="A" Version="1" /><ProjectReference Include="..\\B\\B.csproj" />', "x.csproj")] == ["A", "B"]
    assert dependencies.manifest_dependencies("x", "main.go") == []
    nested = '{"name": "n", "dependencies": {"a": "1", "b": {"x": "y"}}, "peerDependencies": {"c": "2"}}'
    assert [(d.artifact, d.scope) for d in dependencies.manifest_dependencies(nested, "package.json")] == [("a", "dependencies"), ("c", "peerDependencies")]
    assert [d.artifact for d in dependencies.manifest_dependencies('x "dependencies": {"a": "1"} "devDependencies": {', "package.json")] == ["a"]
    full = '<?xml version="1.0"?><project xmlns="http://x/y"><!-- <dependency><groupId>no</groupId><artifactId>no</artifactId></dependency> --><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><scope>test</scope></dependency></dependencies></project>'
    assert dependencies.manifest_dependencies(full, "pom.xml") == [("a", "g", "", "test", "maven")]
    assert [d.artifact for d in dependencies.manifest_dependencies(full[:-20] + "<", "pom.xml")] == ["a"]
    assert dependencies.manifest_dependencies('[dependencies]\nserde = { version = "1", features = ["x"] }\nlocal = { path = "." }\n', "Cargo.toml") == [("serde", "", "1", "", "cargo"), ("local", "", "", "", "cargo")]
    assert [d.artifact for d in dependencies.manifest_dependencies('[project]\ndependencies = [\n  "numpy>=1", # "no"\n  "rich[x] ; python_version > \'3\'",\n]\n', "pyproject.toml")] == ["numpy", "rich"]
    assert [d.artifact for d in dependencies.manifest_dependencies("[metadata]\nname = x\n[options]\ninstall_requires =\n  a>1\n  b\n", "setup.cfg")] == ["a", "b"]
    assert dependencies.manifest_dependencies('// api "n:o:1"\napi(platform("g:a:1"))\ntestImplementation "g:b"\n', "build.gradle.kts") == [("a", "g", "1", "", "gradle"), ("b", "g", "", "", "gradle")]
    for path in ("pom.xml", "a.csproj", "package.json", "build.gradle", "go.mod", "Cargo.toml", "pyproject.toml", "requirements.txt", "setup.cfg"):
        assert dependencies.manifest_dependencies("", path) == [] and isinstance(dependencies.manifest_dependencies("{<[(\"", path), list)


def test_dependency_matches(spark):
    names = spark.createDataFrame([("my-contracts",), ("log",), ("my-app",)], "collection string")
    deps = spark.createDataFrame([("my-contracts", None, "my-app"), ("my-contracts-definitions", "com.example.contracts", ""), ("other", "com.example.my-contracts", ""), ("logback", None, ""), ("MY_CONTRACTS", None, "my-contracts")], "artifact string, group string, self string")
    got = rows(relations.match_dependencies(deps, names), "artifact", "collection", "confidence")
    assert ("my-contracts", "my-contracts", "exact") in got and ("my-contracts-definitions", "my-contracts", "exact") in got and ("other", "my-contracts", "fuzzy") in got
    assert not any(a == "MY_CONTRACTS" for a, _, _ in got)


CHUNKS = "point_id int, chunk_id string, collection string, rel_path string, content string, start_line int, symbol_name string, symbol_type string, language string"


def chunk_table(spark):
    return spark.createDataFrame([
        (1, "c1", "a", "x.py", "def foo(): bar()", 1, "foo", "function", "python"), (2, "c2", "a", "y.py", "def bar(): svc.run()", 1, "bar", "function", "python"),
        (3, "c3", "b", "z.py", "foo(); unknown.call()", 1, None, None, "python"), (4, "c4", "b", "w.py", None, 1, "run", "function", None),
    ], CHUNKS)


def test_resolved_calls(spark):
    c = chunk_table(spark)
    imports = spark.createDataFrame([("a", "y.py", "svc")], "collection string, rel_path string, name string")
    got = dict(((r.point_id, r.token), r.target) for r in relations.resolve_calls(relations.calls(c), relations.definitions(c), imports).collect())
    assert got[(1, "bar")] == "a:y.py::bar" and got[(3, "unknown.call")] == "b::callee::unknown.call" and got[(2, "svc.run")] == "a::callee::svc.run"


def test_imported_receiver_decides(spark):
    defined = spark.createDataFrame([("a", "svc/one.py", "run"), ("a", "other/two.py", "run")], "collection string, rel_path string, symbol_name string")
    sites = spark.createDataFrame([(1, "a", "m.py", "Svc.run"), (2, "a", "n.py", "Svc.run")], "point_id int, collection string, rel_path string, token string")
    imports = spark.createDataFrame([("a", "m.py", "svc")], "collection string, rel_path string, name string")
    got = {r.point_id: r.target for r in relations.resolve_calls(sites, defined, imports).collect()}
    assert got == {1: "a:svc/one.py::run", 2: "a::callee::Svc.run"}


def test_queries_and_engine_read_imports(spark, tmp_path):
    from skein.engine import Engine
    from skein.plans import relations as plans
    from skein.plans import state as state_plans

    c = spark.createDataFrame([
        (1, "c1", "a", "svc/one.py", "def run(): pass", 1, "run", "function", "python"), (2, "c2", "a", "other/two.py", "def run(): pass", 1, "run", "function", "python"),
        (3, "c3", "a", "m.py", "svc.run()", 5, None, None, "python"), (4, "c4", "a", "n.py", "svc.run()", 1, None, None, "python"), (5, "c5", "a", "o.py", "import svc\nsvc.run()", 1, None, None, "python"),
    ], CHUNKS)
    files = spark.createDataFrame([(1, "a", "m.py", "python", "import svc\n\n\n\nsvc.run()", 1), (2, "a", "n.py", "python", "svc.run()", 1)], "record_id int, collection string, rel_path string, language string, content string, scanned_at int")
    c.write.parquet(f"{tmp_path}/chunks.parquet")
    files.write.parquet(f"{tmp_path}/file_records.parquet")
    want = [(3, "a:svc/one.py::run"), (4, "a::callee::svc.run"), (5, "a:svc/one.py::run")]
    assert rows(plans.resolved_calls(spark, str(tmp_path)).where("token = 'svc.run'"), "point_id", "target") == want
    assert rows(state_plans.graph_edges(spark, str(tmp_path)).where("token = 'svc.run'"), "src", "dst") == [(f"c{i}", t) for i, t in want]
    near = Engine(spark, c.withColumn("dense_vector", F.lit(None).cast("array<float>"))).expand_search_context(["c5"], 2)
    assert "c1" in {r.chunk_id for r in near.collect()}


def test_keys_and_walks_of_all_families(spark):
    e = spark.createDataFrame([
        ("IN_FILE", "c1", "a:f"), ("IN_FILE", "c2", "a:f"), ("DEFINES", "c1", "s"), ("CALLS", "c1", "s"), ("IMPORTS", "a:f", "i"), ("DECLARES_ENDPOINT", "c1", "/p"), ("HTTP_CALLS", "c3", "/p"), ("HTTP_CALLS", "c1", "/p"),
        ("CONFIGURES", "c4", "/q"), ("RESOLVES_TO", "x", "a"), ("IN_COLLECTION", "a:f", "a"), ("BUILD_DEPENDS", "a:f", "x"),
    ], "type string, src string, dst string")
    assert rows(graph.neighbor_keys(e), "chunk_id", "keys") == [("c1", 3), ("c2", 1), ("c3", 1), ("c4", 1)]
    walk = lambda **k: rows(graph.expand(e, spark.createDataFrame([("c1",)], "key string"), 2, **k), "key", "hop")
    assert walk() == [("/p", 1), ("a:f", 1), ("c1", 0), ("c2", 2), ("c3", 2), ("i", 2), ("s", 1), ("x", 2)]
    assert walk(types=("IN_FILE", "DEFINES")) == [("a:f", 1), ("c1", 0), ("c2", 2), ("s", 1)]
    assert ("a", 2) in walk(hubs=True)


def test_service_edges_and_usages(spark):
    c = chunk_table(spark)
    edges = relations.service_edges(relations.calls(c), relations.definitions(c))
    assert rows(edges, "from", "to") == [("a", "b"), ("b", "a")]
    assert rows(relations.adjacency(edges), "service", "calls", "called_by") == [("a", "b", "b"), ("b", "a", "a")]
    names = spark.createDataFrame([("foo",)], "symbol_name string")
    assert rows(relations.usages(c, names), "defined_in", "used_in") == [("a", "b")]
    kinds = {r.rel_path: r.match_type for r in relations.cross_references(c, relations.calls(c), names).collect()}
    assert kinds == {"x.py": "call_site", "z.py": "call_site"}


def test_matching_paths_equal_brute_force(spark):
    rng = random.Random(7)
    paths = {(c, "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))) for c in "xy" for _ in range(25)}
    df = spark.createDataFrame(sorted(paths), "collection string, path string")
    got = {(r.caller_collection, r.caller, r.endpoint_collection, r.endpoint) for r in relations.matching_paths(df, df).collect()}

    def match(p, q):
        return p.count("/") and q.count("/") and (f"/{p}/" in f"/{q}/" or f"/{q}/" in f"/{p}/")

    assert got == {(c, p, e, q) for c, p in paths for e, q in paths if c != e and match(p, q)}


def test_usages_of_any_number_of_names(spark):
    names = [f"n{i:05}" for i in range(10_050)]
    kind = "symbol_name string, collection string, content string"
    c = spark.createDataFrame([(n, "a", "x") for n in names] + [("z", "b", " ".join(names[:6_000])), ("z", "b", "_".join(names[6_000:])), (None, "b", None), ("y", "c", "n0")], kind)
    got = relations.usages(c, c.select("symbol_name")).where("symbol_name like 'n%'")
    assert rows(got, "symbol_name", "defined_in", "used_in") == [(n, "a", "b") for n in names]
    odd = ["a.b()", "\u00e4\u00f6", "a", "ab", "abc", "abcd", "a" * 3_000, "operator +", "", "absent"]
    uses = ["xa.b()", "-\u00e4\u00f6\u00fc", "xabcd", "b" * 1_500 + "a" * 3_000, "(operator +)", None, ""]
    c = spark.createDataFrame([(n, "a", "-") for n in odd] + [("q", f"u{i}", t) for i, t in enumerate(uses)], kind)
    want = sorted((n, "a", f"u{i}") for n in odd for i, t in enumerate(uses) if n and t and n in t)
    assert rows(relations.usages(c, c.select("symbol_name").where("symbol_name <> 'q'")), "symbol_name", "defined_in", "used_in") == want
    assert relations.usages(c, c.select("symbol_name").limit(0)).count() == 0


def test_graph(spark):
    c = chunk_table(spark)
    resolved = relations.resolve_calls(relations.calls(c), relations.definitions(c))
    e = graph.edges(c, resolved)
    near = graph.expand(e, spark.createDataFrame([("c1",)], "key string"), 2)
    hops = {r.key: r.hop for r in near.collect()}
    assert hops["c1"] == 0 and hops["a:y.py::bar"] == 1 and hops["c2"] == 2 and "a" not in hops
    assert graph.callers(e, c, spark.createDataFrame([("foo",)], "token string")).where("chunk_id = 'c3'").first().symbol_type == "other"
    assert graph.nodes(c, resolved).groupBy("label", "key").count().where("count > 1").count() == 0


def test_service_graph_and_deletion(spark):
    rows = [(1, "k1", "a", "Api.java", '@GetMapping("/users/list") x', 1, None, None, "java"), (2, "k2", "b", "c.py", 'get("/api/users")', 1, None, None, "python"), (3, "k3", "b", "app.yml", "url: /api/users", 1, None, None, "yaml")]
    c = spark.createDataFrame(rows, CHUNKS)
    imports = spark.createDataFrame([("b", "c.py", "requests")], "collection string, path string, name string")
    deps = spark.createDataFrame([("b", "pom.xml", "lib-a-client", "g", "1", "compile", "maven")], "collection string, path string, artifact string, `group` string, version string, scope string, ecosystem string")
    got = {(r.type, r.src, r.dst) for r in graph.service_edges(c, imports, deps, spark.createDataFrame([("lib-a",), ("b",)], "collection string")).collect()}
    assert got == {("IMPORTS", "b:c.py", "b::import::requests"), ("DECLARES_ENDPOINT", "k1", "users/list"), ("HTTP_CALLS", "k1", "users/list"), ("HTTP_CALLS", "k2", "api/users"), ("CONFIGURES", "k3", "api/users"), ("BUILD_DEPENDS", "b:pom.xml", "maven:g:lib-a-client"), ("RESOLVES_TO", "maven:g:lib-a-client", "lib-a")}
    assert graph.endpoints(c).first().asDict() == {"path": "users/list", "method": "GET"}
    c = chunk_table(spark)
    resolved = relations.resolve_calls(relations.calls(c), relations.definitions(c))
    n, e = graph.delete_files(graph.nodes(c, resolved), graph.edges(c, resolved), spark.createDataFrame([("a", "x.py")], "collection string, rel_path string"), c)
    keys = {r.key for r in n.collect()}
    assert "c1" not in keys and "a:x.py" not in keys and "a:x.py::foo" in keys and e.where("src = 'c1' or dst = 'a:x.py'").count() == 0 and e.where("src = 'c2'").count() > 0


def test_unknown_ids_and_paths(spark):
    c = chunk_table(spark)
    assert rows(search.missing_ids(c, spark.createDataFrame([(1,), (9,), (9,)], "point_id int")), "point_id") == [(9,)]
    assert [r.chunk_id for r in search.chunks_of_paths(c, spark.createDataFrame([("b", "z.py"), ("a", "y.py")], "collection string, rel_path string"), 1).collect()] == ["c2"]


def test_changes(spark):
    scanned = spark.createDataFrame([("c", "new", "h1", 5.0), ("c", "same", "H2", 9.0), ("c", "touched", "h3", 7.0), ("c", "other", "h9", 1.0), ("c", "zero", "h5", 0.0)], "collection string, path string, hash string, mtime double")
    stored = spark.createDataFrame([("c", "same", "h2", 3.0), ("c", "touched", "x", 7.0004), ("c", "other", "h4", 2.0), ("c", "gone", "h6", 1.0), ("c", "zero", "h6", 0.0)], "collection string, path string, hash string, mtime double")
    got = {r.path: r.change for r in state.classify_changes(scanned, stored).collect()}
    assert got == {"new": "new", "same": "unchanged", "touched": "unchanged", "other": "modified", "gone": "stale", "zero": "modified"}
    assert rows(state.stale_paths(stored, scanned), "path") == [("gone",)]


def test_schema_decision():
    base = dict(dense_size=64, sparse=True, multivector=False, multivector_size=None, quantization=None)
    assert state.schema_decision(None, base) == "create" and state.schema_decision(base, base) == "keep" and state.schema_decision(base, base, True) == "recreate"
    for field, value in [("dense_size", 32), ("sparse", False), ("multivector", True), ("multivector_size", 8), ("quantization", "int8")]:
        assert state.schema_decision(base, base | {field: value}) == "recreate"


def test_metrics(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (3, "z", 1)], "query_id int, chunk_id string, rank int")
    qrels = spark.createDataFrame([(1, "b", 3), (1, "x", 1), (2, "q", 1), (3, "z", 0)], "query_id int, chunk_id string, grade int")
    got = {r.query_id: r for r in evaluation.query_metrics(run, qrels).collect()}
    assert set(got) == {1, 2} and (got[1].recall, got[1].mrr, got[2].ndcg) == (0.5, 0.5, 0.0)
    assert got[1].ndcg == round((3 / math.log2(3)) / (3 + 1 / math.log2(3)), 6)
    table = lambda *v: spark.createDataFrame(list(zip("abc", v)), "metric string, value double")
    deltas = {r.metric: (r.delta_percent, r.regression) for r in evaluation.compare(table(0.0, 1.0, 0.9), table(0.0, 0.0, 1.0)).collect()}
    assert deltas == {"a": (0.0, False), "b": (100.0, False), "c": (-10.0, True)}


def test_anchor_ladder(spark):
    points = spark.createDataFrame([("k1", "c", "a/x.py", "f", 3), ("k2", "c", "a/x.py", "g", 10), ("k3", "c", "a/x.py", "g", 20), ("k4", "c", "b/y.md", None, 1)], "chunk_id string, collection string, rel_path string, symbol_name string, start_line int")
    anchors = spark.createDataFrame([(1, "c", "a/x.py", "f", 9), (2, "c", "a/x.py", "g", 18), (3, "c", "a/x.py", None, 4), (4, "c", "old/y.md", None, 1), (5, "c", "none.py", "q", 1)], "anchor_id int, collection string, rel_path string, symbol string, line int")
    got = {r.anchor_id: (r.chunk_id, r.method) for r in evaluation.resolve_anchors(anchors, points).collect()}
    assert got == {1: ("k1", "content"), 2: ("k3", "nearest_line"), 3: ("k1", "basename"), 4: ("k4", "basename"), 5: (None, "unresolved")}


def test_pending_records(spark):
    files = "record_id bigint, collection string, rel_path string, sha256_hash string, scanned_at timestamp, content string, extra int"
    f = spark.sql("""SELECT * FROM VALUES (1L, 'c', './a.py', 'AA', timestamp'2026-01-01 00:00:00'), (1L, 'c', './a.py', 'AA', timestamp'2026-01-01 00:00:00'), (2L, 'c', 'a.py', 'bb', timestamp'2026-01-02 00:00:00'),
      (3L, 'c', 'a.py', null, timestamp'2026-01-03 00:00:00'), (4L, 'c', 'd\\\\b.py', 'cc', timestamp'2026-01-01 00:00:00'), (5L, null, 'n.py', 'dd', null), (6L, 'c', 'e.py', 'ee', timestamp'2026-01-01 00:00:00') t(record_id, collection, rel_path, sha256_hash, scanned_at)""")
    m = spark.sql("""SELECT * FROM VALUES ('c', 'a.py', 'aa', 0.0, 1L, timestamp'2026-01-01 00:00:00'), ('c', 'd/b.py', 'CC', 0.0, 1L, timestamp'2026-01-01 00:00:00'), ('c', 'e.py', 'ee', 0.0, 2L, timestamp'2026-01-01 00:00:00') t(collection, rel_path, sha256, mtime, run_id, recorded_at)""")
    r = spark.sql("""SELECT * FROM VALUES (1L, 'c', 'completed', timestamp'2026-01-01 05:00:00'), (1L, 'c', 'completed', timestamp'2026-01-01 05:00:00'), (2L, 'c', 'failed', timestamp'2026-01-02 05:00:00'), (3L, 'c', 'running', null) t(run_id, collection, status, finished_at)""")
    assert sorted(x.record_id for x in incremental.pending_records(f, m, r).collect()) == [2, 5, 6]
    empty = spark.createDataFrame([], files)
    assert incremental.pending_records(empty, m, r).count() == 0
    assert incremental.pending_records(f, m.limit(0), r.limit(0)).count() == 4


LISTING = "path string, size long, checksum string"


def _broken(df):
    raise RuntimeError("executor lost")


def test_manifest_store_survives_failures(spark, tmp_path):
    store = incremental.ManifestStore(spark, tmp_path.as_uri())
    listing = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", 2, "y"), (None, None, "n")], LISTING)
    with pytest.raises(RuntimeError):
        store.run(listing, _broken)
    assert store.output() is None and store.manifest().count() == 0
    first = store.run(listing, lambda df: df)
    assert store.run(listing, lambda df: df) is None
    more = listing.where("path = 'b'").unionByName(spark.createDataFrame([("a", 1, "z")], LISTING))
    second = store.run(more, lambda df: df)
    assert first != second and store.output(first).count() == 3 and [r.checksum for r in store.output(second).collect()] == ["z"]
    assert store.pending(more).count() == 0 and store.run(listing.limit(0), lambda df: df) is None


def test_manifest_store_takes_content_that_comes_back(spark, tmp_path):
    store = incremental.ManifestStore(spark, tmp_path.as_uri(), snapshot_every=3)
    versions = ["A", "B", "A", "A", "B", "B", "C", "A"]
    ran = [store.run(spark.createDataFrame([("f", 1, v), ("g", 1, "same")], LISTING), lambda df: df) is not None for v in versions]
    assert ran == [True, True, True, False, True, False, True, True]
    assert sorted(r.checksum for r in store.output().collect()) == ["A", "A", "A", "B", "B", "C", "same"]
    assert [c["whole"] for c in store.commits()] == [False, False, True, False, False, True] and store.manifest().count() == 2


def test_manifest_store_crash_then_another_listing(spark, tmp_path):
    """A run dies after its output was written, or before its commit; the next one sees more files: nothing is stored twice."""
    store = incremental.ManifestStore(spark, tmp_path.as_uri())
    a, b = spark.createDataFrame([("a", 1, "x")], LISTING), spark.createDataFrame([("b", 1, "x")], LISTING)
    commit = store._commit
    store._commit = lambda *_: _broken(None)
    with pytest.raises(RuntimeError):
        store.run(a, lambda df: df)
    assert store.output() is None
    store._commit = commit
    store.run(a.unionByName(b), lambda df: df)
    assert sorted(r.path for r in store.output().collect()) == ["a", "b"]
    assert spark.read.parquet(f"{store.root}/out").count() == 2  # what the dead run left is gone


def test_manifest_store_listing_that_moves(spark, tmp_path):
    """Files that arrive while a batch runs are neither committed nor lost."""
    store = incremental.ManifestStore(spark, (tmp_path / "store").as_uri())
    source = str(tmp_path / "files")
    spark.createDataFrame([("a", 1, "x")], LISTING).write.mode("append").parquet(source)

    def process(df):
        spark.createDataFrame([("b", 1, "y")], LISTING).write.mode("append").parquet(source)
        return df

    listing = lambda: spark.read.parquet(source)
    store.run(listing(), process)
    assert [r.path for r in store.manifest().collect()] == ["a"]
    store.run(listing(), lambda df: df)
    assert sorted(r.path for r in store.output().collect()) == ["a", "b"]


def test_manifest_store_refuses_a_second_run(spark, tmp_path):
    store, other = (incremental.ManifestStore(spark, tmp_path.as_uri()) for _ in range(2))

    def process(df):
        other._commit(0, "other", 1, False)
        return df

    with pytest.raises(Exception, match="exist"):
        store.run(spark.createDataFrame([("a", 1, "x")], LISTING), process)


def test_files_in_chunks(spark):
    from skein.operators import chunking

    body = "def foo():\n    return 1\n\n\nclass Bar:\n    def baz(self):\n        return 2\n"
    got = chunking.file_chunks(body, "python", "sample.py")
    assert [(c[0], c[2], c[4]) for c in got] == [(1, "foo", "f3791711a476f9ce370d58605e354b193054026f92cb412e63938a429547ee4f"), (5, "Bar", "16ca50508dd9714562b1944daccd94dc0c9ac1ab6f22c4cab934446635271da6")]
    sql = "SELECT 1\n" * 70 + "CREATE PROCEDURE dbo.P AS\nBEGIN\nSELECT 2\nEND\n" + "SELECT 3\n" * 70
    got = chunking.file_chunks(sql, "sql", "p.sql")
    assert ("dbo.P", "procedure", 71, 74) in [(c[2], c[3], c[0], c[1]) for c in got] and all(c[1] < 71 or c[0] > 74 for c in got if c[2] is None)
    names = {language: [c[2] for c in chunking.file_chunks(t, language, "x")] for language, t in {
        "rust": "pub fn a(x: u8) -> u8 {\n  x\n}\nimpl T {\n  fn b() {}\n}\n", "c": "int f(int x) {\n  if (x) { return 1; }\n  return 0;\n}\nstruct S { int a; };\n", "cpp": "class A : B {\n void m() {}\n};\nint A::n() const {\n  return 1;\n}\n",
    }.items()}
    assert names == {"rust": ["a", "T"], "c": ["f", "S"], "cpp": ["A", "n"]}
    files = spark.createDataFrame([("c", "a.py", "python", body), ("c", "n", None, "x"), ("c", "e.py", "python", ""), ("c", "o.py", "python", None)], "collection string, path string, language string, content string")
    assert rows(chunking.chunk_files(files), "path", "start_line") == [("a.py", 1), ("a.py", 5), ("n", 1)] and chunking.chunk_files(files.limit(0)).count() == 0


def test_point_uuids(spark):
    import uuid

    from skein.functions import text

    names = ["src/foo.py:10", "a.py:1", "b.py:2", "", "ü:3"]
    got = [r.u for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.name_uuid(F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names] and got[0] == "e76dab7b-dd95-5ceb-b893-6930a5076f1e"


def test_references_are_merged_and_linked(spark):
    from skein.operators import references

    schema = "symbol_name string, collection string, rel_path string, start_line int, match_type string, score double, reference_type string"
    data = [("s", "a", "p", 1, "import_search", 0.9, "import"), ("s", "a", "p", 1, "semantic", 0.4, "usage"), ("s", "a", "q", 1, "exact_symbol", 1.0, "definition"), ("s", "b", "r", 2, "semantic", 0.5, "usage"), ("s", "b", "r", 2, "call_site", 1.0, "usage"), ("s", None, None, None, "call_site", 1.0, "x"), ("s", "a", "z", 1, "other", 1.0, "x")]
    got = rows(references.merged(spark.createDataFrame(data + data[:2], schema)).where("collection is not null"), "collection", "rel_path", "match_type", "score", "reference_type")
    assert got == [("a", "p", "semantic", 0.4, "usage"), ("a", "q", "exact_symbol", 1.0, "definition"), ("b", "r", "call_site", 1.0, "call_site")]
    found = spark.createDataFrame([
        ("S", "a", "d", "definition", "class S {", "S"), ("S", "b", "c", "call_site", "S()", ""), ("S", "b", "u", "usage", "x: S", ""), ("S", "b", "n", "usage", "none", ""), ("S", "a", "v", "usage", "x: S", ""), ("S", "c", "o", "definition", "class O {", "O"),
        ("S", "b", "h", "http_call", 'uri("/api/x/y")', ""), ("S", "c", "e", "endpoint_definition", '@GetMapping("/api/x/y")', ""), ("S", "b", "k", "service_config", "path: /api/x/y", ""),
    ], "symbol_name string, collection string, rel_path string, reference_type string, content string, own_symbol string")
    got = rows(references.links(found), "kind", "from_path", "to_path")
    assert got == [("code_dependency", "c", "d"), ("code_dependency", "u", "d"), ("http_dependency", "h", "e"), ("http_dependency", "k", "e")]
    assert references.links(found.limit(0)).count() == 0


def test_nearest_of_a_set(spark):
    import numpy as np

    from skein.operators import search

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    x[:20] = x[0]  # a third are copies
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0]), (102, [0.0] * 4), (103, [float("nan")] * 4), (None, x[3].tolist())]
    df = spark.createDataFrame(data, "point_id bigint, dense_vector array<float>")
    asked = df.where("point_id % 7 = 0").withColumnRenamed("point_id", "query_id")
    for block in (3, 1000):
        got = rows(search.dense_topk_set(df, asked, 5, dim=4, block=block), "query_id", "rank", "point_id")
        want = []
        for q in range(0, 60, 7):
            y = x.astype(float)
            s = np.round(y @ y[q] / (np.linalg.norm(y, axis=1) * np.linalg.norm(y[q])), 6)
            want += [(q, n + 1, int(p)) for n, p in enumerate(np.lexsort((np.arange(60), -s))[:5])]
        assert got == sorted(want)
    assert search.dense_topk_set(df, asked.limit(0), 5, dim=4).count() == 0


def test_stems_of_arrays(spark):
    from skein.functions import terms

    got = spark.createDataFrame([(["running", "connection"],), ([],), (None,), (["files", "files"],)], "t array<string>").select(terms.stems_udf("t").alias("s")).collect()
    assert [r.s for r in got] == [["run", "connect"], [], None, ["file", "file"]]


def test_sparse_search_equals_brute_force(spark):
    import pyarrow as pa

    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(150)] + [(500, None), (501, ""), (502, "running w1 runs"), (503, "w3"), (504, "w3")]
    asked = [(q, " ".join(rng.choices(words, k=3))) for q in range(20)] + [(90, "run"), (91, "nothing here"), (92, None), (93, "")]
    df, qs = spark.createDataFrame(docs, "point_id bigint, content string"), spark.createDataFrame(asked, "query_id int, query_text string")
    weights = lambda t: {w: c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(t) / 256)) for w, c in ((w, t.count(w)) for w in set(t))}
    stemmed = lambda t: ["run" if w in ("running", "runs") else {"nothing": "noth"}.get(w, w) for w in (t or "").split()]
    want = []
    for q, t in asked:
        mine, found = weights(stemmed(t)), []
        for i, c in docs:
            other = weights(stemmed(c))
            if set(mine) & set(other):
                found.append((-round(sum(mine[w] * other[w] for w in mine if w in other), 6), i))
        want += [(q, n + 1, i) for n, (_, i) in enumerate(sorted(found)[:4])]
    for block in (7, 10_000):
        assert rows(search.sparse_topk(df, qs, 4, block=block), "query_id", "rank", "point_id") == sorted(want)
    index = search.SparseQueries.of(pa.array([1, 1, 2]), pa.array(["a", "b", "a"]), [1.0, 2.0, 3.0])
    texts = pa.array([["a"], None, ["a", "b", "b"], [], ["c"], ["b"], ["a"]])
    whole, cut = (sorted(zip(*(x.tolist() for x in index.best(texts, 2, pairs=n)))) for n in (100, 1))
    assert whole == cut and {(d, q) for d, q, _ in whole} == {(2, 0), (5, 0), (0, 1), (6, 1)}
    assert search.sparse_topk(df.limit(0), qs, 4).count() == search.sparse_topk(df, qs.limit(0), 4).count() == 0
