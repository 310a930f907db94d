"""Corpus encoding, rank aggregation and splitting against other ways to the same result."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import ranking, splitting, tokens

VOCABULARY = Path(tokens.DEFAULT_VOCABULARY)
TEXTS = [None, "", " ", "Hello, world!  it's\t\r\n 2024", "<|endoftext|> plain", "aaaaaaaa" * 400, "ünïcödé 漢字 🙂🙂 \u0000", "x" * 3 + " " * 50, "don't I'LL", "\n\n\n", "def f(x):\n    return x**2\n" * 200, "日本語" * 500]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    if not VOCABULARY.exists():
        pytest.skip("vocabulary is not here")
    t = tokenizers.Tokenizer.from_file(str(VOCABULARY))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoding_equals_the_library(spark, reference):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1)], "doc_id bigint, text string, ids string, tokens int")
    got = tokens.encode_corpus(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert r.ids == reference(TEXTS[r.doc_id]), r.doc_id
    counts = {r.doc_id: r.tokens for r in tokens.count_tokens(docs.select("doc_id", "text", "ids"), keep=("ids",)).collect()}
    assert counts == {i: len(reference(t)) for i, t in enumerate(TEXTS)}
    assert tokens.encode_corpus(docs.limit(0)).count() == 0


def test_merges_of_random_words(reference):
    table = tokens.MergeTable.load()
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdehnorst'") for _ in range(rng.randint(1, 40))).replace("'", "") or "a" for _ in range(500)]
    flat, cuts = table.encode(words)
    assert [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [reference(w) for w in words]


def test_encoder_forgets_within_bounds(reference):
    encoder = tokens.Encoder(tokens.MergeTable.load(), remember=3)
    for text in ("a b c d e f g", "h i j k", "a b"):
        ids, lengths = encoder.batch([text, None])
        assert ids.tolist() == reference(text) and lengths.tolist() == [len(reference(text)), 0]


HITS = "query_id int, scorer string, collection string, point_id int, score double, rank int, size int"


def test_median_ranks_equal_brute_force(spark):
    rng = random.Random(5)
    data = []
    for q in (1, 2, None):
        for c in ("a", "b", None):
            for s in ("dense", "sparse", "multivector")[: rng.randint(1, 3)]:
                for p in rng.sample(range(10), rng.randint(1, 9)):
                    data.append((q, s, c, p + (100 if c == "b" else 200 if c is None else 0), rng.choice([1.0, 2.0, 3.0, -5.0, 1e300, float("nan"), None]), 7, 7))
    data += data[:5]
    got = ranking.median_rank(spark.createDataFrame(data, HITS)).collect()
    best = {}
    for q, s, c, p, v, *_ in data:
        if v is not None and v == v:
            best[q, c, s, p] = max(v, best.get((q, c, s, p), -float("inf")))
    lists = {}
    for (q, c, s, p), v in best.items():
        lists.setdefault((q, c), {}).setdefault(s, {})[p] = v
    expected = {}
    for (q, c), of in lists.items():
        for p in {p for points in of.values() for p in points}:
            ranks = [1 + sum(v > points[p] for v in points.values()) if p in points else len(points) + 1 for points in of.values()]
            expected[q, c, p] = (float(np.median(ranks)), round(sum(ranks) / len(ranks), 9), max(ranks), len(of), sum(p in points for points in of.values()))
    assert {(r.query_id, r.collection, r.point_id): (r.median_rank, round(r.mean_rank, 9), r.worst_rank, r.lists, r.held) for r in got} == expected
    for q in (1, 2, None):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        keys = [(r.median_rank, r.mean_rank, r.point_id) for r in mine]
        assert keys == sorted(keys)
    assert ranking.median_rank(spark.createDataFrame([], HITS)).count() == 0


def test_scale_does_not_matter_and_weights_do(spark):
    hits = [(1, "dense", "a", p, v, 0, 0) for p, v in ((1, 0.9), (2, 0.8), (3, 0.1))] + [(1, "sparse", "a", p, v, 0, 0) for p, v in ((2, 9e9), (1, 5.0), (3, 1.0))]
    order = lambda **k: [r.point_id for r in ranking.median_rank(spark.createDataFrame(hits, HITS), **k).orderBy("position").collect()]
    assert order() == [1, 2, 3] and order(weights={"sparse": 3.0}) == [2, 1, 3]


def test_hot_query_is_ranked_whole(spark):
    hits = spark.range(5000).select(F.lit(1).alias("query_id"), F.lit("dense").alias("scorer"), F.lit("a").alias("collection"), F.col("id").cast("int").alias("point_id"), (F.col("id") % 1000).cast("double").alias("score"), F.lit(0).alias("rank"), F.lit(0).alias("size"))
    got = ranking.median_rank(hits).orderBy("position").select("point_id", "median_rank", "position").collect()
    assert len(got) == 5000 and [r.position for r in got] == list(range(1, 5001))
    assert all(r.median_rank == 1 + 5 * (999 - r.point_id % 1000) for r in got)


def test_running_sums(spark):
    for n in (1, 255, 256, 257, 1000):
        values = [i % 7 for i in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(splitting.running_sums(F.col("v")).alias("s")).first().s
        assert got == [sum(values[:i]) for i in range(n)]


def test_leading_points(spark):
    data = [(1, s, "a", p, float(10 - p), 0, 0) for s in ("dense", "sparse") for p in range(6)] + [(1, "dense", "b", 50, 1.0, 0, 0), (2, "dense", "a", 1, 5.0, 0, 0), (2, "sparse", "a", 2, 5.0, 0, 0)]
    got = ranking.leading_everywhere(ranking.median_rank(spark.createDataFrame(data, HITS)))
    assert sorted((r.query_id, r.point_id) for r in got.collect()) == [(1, 0), (1, 1), (1, 2)]


CHUNKS = "point_id int, content string, start_line int, symbol_name string, piece int, lead string"


def test_pieces(spark):
    rng = random.Random(9)
    code = "\r\n".join(("" if rng.random() < 0.15 else "    " * rng.randint(0, 3)) + "x" * rng.randint(0, 60) + ";" for _ in range(400))
    texts = [None, "", "a" * 2400, "b" * 2401, code, "é🙂" * 4000, "\n" * 5000, "word " * 2000, "y" * 9000 + "\nshort\n" + "z" * 3000, code[:2399] + "\n\nend" * 3]
    chunks = spark.createDataFrame([(i, t, 10, f"s{i}", 1, "k") for i, t in enumerate(texts)] + [(4, code, 10, "s4", 1, "k"), (3, texts[3], None, None, 1, "k")], CHUNKS)
    got = splitting.split_oversized(chunks).collect()
    for i, t in enumerate(texts):
        mine = sorted((r for r in got if r.point_id == i and r.start_line is not None), key=lambda r: r.piece)
        if not t:
            assert not mine
            continue
        assert [r.piece for r in mine] == list(range(1, len(mine) + 1)) and all(r.pieces == len(mine) for r in mine)
        assert (len(mine) > 1) == (len(t) > 2400) and all(0 < len(r.content) <= 2400 for r in mine)
        assert "".join(r.content[r.lead :] for r in mine) == t
        at = 0
        for a, b in zip([None, *mine], mine):
            assert b.start_line == 10 + t[: at - b.lead].count("\n") and b.symbol_name == f"s{i}"
            assert b.end_line == 10 + t[: at + len(b.content) - b.lead].count("\n") - t[: at + len(b.content) - b.lead].endswith("\n")
            if a is not None and b.lead:
                assert a.content.endswith(b.content[: b.lead])
            at += len(b.content) - b.lead
    pieces = [r for r in got if r.point_id == 4]
    assert all(r.content[: r.lead].count("\n") == 3 for r in pieces if r.piece > 1)
    assert all(not r.content.endswith("\r") for r in got if r.point_id == 4)
    assert any(r.start_line is None and r.piece == 2 for r in got if r.point_id == 3)
    assert splitting.split_oversized(chunks.limit(0)).count() == 0


def test_cuts_fall_on_the_strongest_boundary(spark):
    block = "def f():\n" + "    x = 1\n" * 40 + "\n"
    chunks = spark.createDataFrame([(1, block * 12, 1, None, 0, "")], CHUNKS)
    got = splitting.split_oversized(chunks, limit=2400).orderBy("piece").collect()
    assert all(r.content.endswith("\n\n") for r in got[:-1]) and all(r.content[r.lead :].startswith("def f") for r in got)
