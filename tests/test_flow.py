"""Sources, streams, the engine, entry points and plans."""

import importlib
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skein.engine import Engine, SkeinError
from skein.sources import workspace
from skein.streaming import ingest

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


def test_workspace_scan(spark, tmp_path):
    counts = workspace.generate_corpus(str(tmp_path), 20)
    assert counts == workspace.generate_corpus(str(tmp_path), 20) and sum(counts.values()) == 20
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("1")
    (tmp_path / "bin.py").write_bytes(b"a\0b")
    (tmp_path / "skip.py").write_text("x")
    (tmp_path / "README").write_text("x")
    found = workspace.scan_workspace(spark, str(tmp_path), ["skip.py"])
    assert found.count() == 20 and found.where("path = 'skip.py' or path like '%node_modules%'").count() == 0
    row = found.where("language = 'python'").first()
    assert row.sha256_hash == spark.range(1).select(F.sha2(F.lit(row.content), 256).alias("h")).first().h and row.mtime > 1e9


def test_golden_queries(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('# note\n\n{"query_id": "q1", "query_text": "x", "tags": ["a"], "anchors": [{"rel_path": "p", "line": 3, "grade": 2}]}\n')
    got = workspace.read_golden(spark, str(tmp_path / "g.jsonl")).collect()
    assert len(got) == 1 and got[0].anchors[0].grade == 2
    (tmp_path / "c.json").write_text('{"candidates": [{"model": "m", "status": "included"}, {"model": "n", "status": "skipped"}]}')
    assert [c["model"] for c in workspace.read_candidates(str(tmp_path / "c.json"), "included")] == ["m"]


def test_stream_ingests_once(spark, tmp_path):
    def record(i, path, content, at):
        return spark.createDataFrame([(i, "c", path, "python", content)], "record_id bigint, collection string, rel_path string, language string, content string").withColumns({"sha256_hash": F.sha2("content", 256), "scanned_at": F.lit(at).cast("timestamp")})

    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    record(1, "a.py", "x = 1", "2026-01-01").write.mode("append").parquet(src)
    ingest.ingest_stream(spark, src, out, state).awaitTermination()
    record(2, "a.py", "x = 2", "2026-01-02").union(record(3, "b.py", "y", "2026-01-02")).write.mode("append").parquet(src)
    for _ in range(2):
        ingest.ingest_stream(spark, src, out, state).awaitTermination()
    got = sorted((r.path, r.content) for r in ingest.ChunkTable(spark, out).read().collect())
    assert got == [("a.py", "x = 2"), ("b.py", "y")]


@needs_data
def test_windows_stream_like_tables(spark, tmp_path):
    events = spark.read.parquet(str(DATA / "events.parquet"))
    stream = spark.readStream.schema(events.schema).parquet(str(DATA / "events*.parquet"))
    q = ingest.event_windows(stream, late=None).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").exceptAll(ingest.event_windows(events)).count() == 0 and spark.table("w").count() == ingest.event_windows(events).count()


@needs_data
def test_engine(spark):
    chunks = spark.read.parquet(str(DATA / "chunks.parquet")).distinct().join(spark.read.parquet(str(DATA / "embedded_chunks.parquet")).select("point_id", "dense_vector").dropDuplicates(["point_id"]), "point_id")
    engine = Engine(spark, chunks, embed=lambda text: [1.0] + [0.0] * 63)
    names = [r.collection for r in engine.list_collections().collect()]
    hits = engine.search_codebase("return", 5, names[0], names[1:3], max_content_chars=10).collect()
    assert 0 < len(hits) <= 5 and all(len(h.content or "") <= 10 for h in hits)
    assert "content" not in engine.search_symbols("return", 3, collection=names[0]).columns
    row = chunks.first()
    assert engine.get_chunk(row.chunk_id).count() == 1 and engine.get_file_outline(row.rel_path, row.collection).count() >= 1
    assert engine.get_collection_summary(names[0]).count() == 1 and engine.get_health().count() == 1
    assert engine.expand_search_context([row.chunk_id, "none"], 1).where(F.col("chunk_id") == row.chunk_id).count() >= 1
    found = engine.find_cross_references(row.symbol_name or "x", names[:2], query="return", member="run").collect()
    assert {r.match_type for r in found} <= {"semantic", "exact_symbol", "import_search", "call_site"} and len({(r.collection, r.rel_path, r.start_line) for r in found}) == len(found) > 0
    assert engine.recommend_code(texts=["x"], limit=3).count() == 3
    late = Engine(spark, chunks.withColumn("multivector", F.array("dense_vector")), engine.embed, embed_tokens=lambda text: [[1.0] + [0.0] * 63])
    assert 0 < late.search_codebase("return", 5, names[0], rerank=True).count() <= 5
    with pytest.raises(SkeinError):
        engine.search_codebase("x", 5, rerank=True)
    assert engine.map_service_dependencies(names[:2]).count() == 0
    for call in (lambda: engine.search_codebase("x", 99), lambda: engine.recommend_code([]), lambda: engine.find_outlier_chunks([1], max_similarity=2), lambda: engine.map_service_dependencies(["a"]), lambda: Engine(spark, chunks).search_codebase("x")):
        with pytest.raises(SkeinError) as e:
            call()
        assert e.value.body()["error"]["kind"] == "validation"


def test_engine_maps_services(spark):
    rows = [(1, "k1", "svc-a", "Client.cs", 'http.GetAsync("/api/users/list")', 1), (2, "k2", "svc-b", "Users.cs", '[HttpGet("api/users/list")]', 1), (3, "k3", "svc-a", "pom.xml", "<dependency><groupId>g</groupId><artifactId>svc-b-client</artifactId></dependency>", 1)]
    chunks = spark.createDataFrame(rows, "point_id int, chunk_id string, collection string, rel_path string, content string, start_line int")
    got = {(r["from"], r["to"], r["kind"]) for r in Engine(spark, chunks).map_service_dependencies(["svc-a", "svc-b"]).collect()}
    assert got == {("svc-a", "svc-b", "http_call"), ("svc-a", "svc-b", "build_dependency")}


@needs_data
def test_entry_points(spark):
    entry = importlib.import_module("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert entry.entry(spark).count() >= 0


def test_core_does_not_need_the_corpus_package(monkeypatch):
    root = Path(__file__).resolve().parent.parent / "skein"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "skein.llm" not in path.read_text() and "from .llm" not in path.read_text(), path
    for name in [n for n in sys.modules if n == "__spark_entry__" or n.startswith("skein.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "skein.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "p7_found" in entry.queries() and "p1_found" not in entry.queries()


@needs_data
def test_plans(spark):
    from skein.plans import catalog

    def plan(name):
        return catalog.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()

    assert "TakeOrderedAndProject" in plan("dense_topk") and "WindowGroupLimit" in plan("per_collection_topk")
    for name in ("collection_summary", "list_collections", "files_per_language", "shared_symbols", "find_symbols", "file_outline", "graph_nodes"):
        scans = [line for line in plan(name).split("\n") if "FileScan" in line and "chunks.parquet" in line]
        assert scans and (name == "graph_nodes" or not any("content" in line for line in scans)), name
    assert plan("bm25_weights").count("Python") <= plan("bm25_weights").count("ArrowEvalPython") + plan("bm25_weights").count("pythonUDF")  # the stemmer alone, by Arrow batches
    for name in ("callees", "token_freq", "hybrid_rrf", "service_edges", "p7_found", "collection_summary"):
        assert "Python" not in plan(name) and "Arrow" not in plan(name) and "CartesianProduct" not in plan(name)
    assert "dense_vector" not in plan("dir_tree") and "content" not in plan("delta_classify")


def test_workspace_reads_no_excluded_content(spark, tmp_path):
    """A file too large to be read fails a scan only if it is read."""
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "big.js").write_text("x" * 5000)
    (tmp_path / "a [1].py").write_text("x = 1\n")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        assert [r.path for r in workspace.scan_workspace(spark, str(tmp_path)).collect()] == ["a [1].py"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    (tmp_path / "empty").mkdir()
    assert workspace.scan_workspace(spark, str(tmp_path / "empty")).count() == 0


def test_late_scans_change_nothing(spark, tmp_path):
    def batch(n, *rows):
        df = spark.createDataFrame([(i, "c", p, "python", t, at) for i, p, t, at in rows], "record_id bigint, collection string, rel_path string, language string, content string, scanned_at string")
        ingest.ingest_batch(tables, df.withColumns({"sha256_hash": F.sha2("content", 256), "scanned_at": F.col("scanned_at").cast("timestamp")}), n)

    tables = ingest.ChunkTable(spark, str(tmp_path / "t"), buckets=4)
    got = lambda: sorted((r.path, r.content) for r in tables.read().collect())
    batch(0, (1, "a.py", "new", "2026-01-05"), (2, "b.py", "b", "2026-01-01"))
    batch(1, (3, "a.py", "old", "2026-01-02"), (4, "c.py", "c", "2026-01-03"))
    assert got() == [("a.py", "new"), ("b.py", "b"), ("c.py", "c")]
    batch(2, (5, "./a.py", "newer", "2026-01-06"))
    batch(2, (5, "./a.py", "newer", "2026-01-06"))  # repeated
    assert got() == [("a.py", "newer"), ("b.py", "b"), ("c.py", "c")] and len(tables.versions()) == 2
    folders = [p for p in (tmp_path / "t" / "data").glob("v*/bucket=*")]
    assert len(folders) <= len({f for v in tables.versions() for f in tables.folders(v).values()})


def test_engine_indexes_and_describes(spark, tmp_path):
    root = tmp_path / "svc"
    root.mkdir()
    (root / "a.py").write_text("import os\n\ndef f():\n    return os.name\n")
    (root / "package.json").write_text('{"dependencies": {"other-client": "1"}}')
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "b.py").write_text("x = 1\n")
    empty = spark.createDataFrame([], "collection string, rel_path string, content string")
    made = Engine(spark, empty).index_all({"svc": str(root), "other": str(tmp_path / "other")})
    rows = {(r.collection, r.path): r for r in made.collect()}
    assert rows["svc", "a.py"].symbol_name == "f" and rows["svc", "a.py"].content.startswith("import os\ndef f") and rows["svc", "package.json"].symbol_type == "manifest"
    engine = Engine(spark, made.withColumnRenamed("path", "rel_path").withColumn("point_id", F.monotonically_increasing_id()))
    assert [(r.artifact, r.stands_for, r.confidence) for r in engine.get_collection_dependencies("svc").collect()] == [("other-client", "other", "exact")]
    assert engine.get_collection_tree("svc").count() == 0


def test_embedding_providers(spark):
    import numpy as np

    from skein.functions import embedding

    rows = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "ab"), (5, "c")], "id int, content string")

    def dense():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    got = {r.id: r.dense_vector for r in embedding.dense_vectors(rows, dense, 2, prefix="q: ").collect()}
    assert got[2] is got[3] is None and got[1] == got[4] and got[1] == pytest.approx([5 / 26**0.5, 1 / 26**0.5])
    with pytest.raises(Exception, match="dimensions"):
        embedding.dense_vectors(rows, dense, 3).collect()

    def tokens():
        return lambda texts: [(np.arange(2 * len(t) + 2).reshape(-1, 2), [0] + [1] * len(t)) for t in texts]

    many = {r.id: r.multivector for r in embedding.token_vectors(rows, tokens, 2, longest=2).collect()}
    assert many[1] == [[2.0, 3.0]] and many[2] == [[0.0, 0.0]] and many[3] is None
    assert embedding.token_vectors(rows.limit(0), tokens, 2).count() == 0
