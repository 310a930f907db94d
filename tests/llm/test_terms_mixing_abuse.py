"""Distinctive terms, mixing and the abuse classifier."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import abuse, distinctive, mixing

CHUNKS = "point_id bigint, content string, term string, score double, _text int"
TEXTS = {1: "return Foo foo_bar $x ünder return", 2: "return return baz", 3: "Foo baz baz baz qux", 4: "", 5: None, 6: "!!! ---", 7: "a" * 60_000 + " b", 8: "İstanbul ١٢ x²"}


def terms_of(text):
    return Counter(re.findall(r"(?:[^\W_]|[_$])+", re.sub("[²]", " ", text.lower())))


def chunk_table(spark):
    data = [(i, t, "k", 0.5, 1) for i, t in TEXTS.items()]
    return spark.createDataFrame(data + data[:3] + [(None, "null id", "k", 0.5, 1)], CHUNKS)


def expected():
    counts = {i: terms_of(t) for i, t in TEXTS.items() if t}
    total, mass, held = sum(sum(c.values()) for c in counts.values()), Counter(), Counter()
    for c in counts.values():
        mass.update(c)
        held.update(c.keys())
    out = {}
    for i, c in counts.items():
        p = {t: n / sum(c.values()) for t, n in c.items()}
        for _ in range(3000):
            e = {t: c[t] * 0.1 * p[t] / (0.1 * p[t] + 0.9 * mass[t] / total) for t in c}
            p = {t: x / sum(e.values()) for t, x in e.items()}
        out |= {(i, t): (p[t], c[t], held[t], mass[t] / total) for t in c}
    return out


@pytest.mark.parametrize("common", [1e-5, 0.2, 2.0])
def test_scores_equal_plain_iteration(spark, monkeypatch, common):
    """However many terms count as common: broadcast all, some, or none."""
    monkeypatch.setattr(distinctive, "COMMON", common)
    got = {(r.point_id, r.term): (r.score, r.mass, r.records, r.background) for r in distinctive.distinctive_terms(chunk_table(spark)).collect()}
    want = expected()
    assert set(got) == set(want)
    for k in want:
        assert got[k][1:] == pytest.approx(want[k][1:]) and got[k][0] == pytest.approx(want[k][0], abs=2e-4), k


def test_term_filters_come_after_scoring(spark):
    every = {(r.point_id, r.term): r.score for r in distinctive.distinctive_terms(chunk_table(spark)).collect()}
    some = distinctive.distinctive_terms(chunk_table(spark), min_count=2, min_records=2, max_records=2).collect()
    assert {(r.point_id, r.term) for r in some} == {(1, "return"), (2, "return"), (3, "baz")}
    assert all(r.score == every[r.point_id, r.term] for r in some)
    assert distinctive.distinctive_terms(chunk_table(spark).limit(0)).count() == 0


def test_slices_do_not_matter(monkeypatch, spark):
    whole = sorted(map(tuple, distinctive.distinctive_terms(chunk_table(spark)).collect()))
    monkeypatch.setattr(distinctive, "SLICE", 10)
    cut = sorted(map(tuple, distinctive.distinctive_terms(chunk_table(spark)).collect()))
    assert [r[:2] for r in cut] == [r[:2] for r in whole] and [r[2] for r in cut] == pytest.approx([r[2] for r in whole], abs=1e-4)


def test_sparse_vectors(spark):
    data = [(1, [5, 7], [1.0, 2.0], 0), (1, [5, 7], [1.0, 2.0], 0), (2, [5, 9, 9], [1.0, 1.5], 0), (3, None, [1.0], 0), (4, [], [], 0), (5, [1], None, 0), (6, [5, -1, 8, 4], [float("nan"), 1.0, -2.0, None], 0), (7, [3, 3], [1.0, 1.0], 0)]
    df = spark.createDataFrame(data, "point_id bigint, sparse_indices array<bigint>, sparse_values array<float>, term int")
    got = {(r.point_id, r.term): (r.mass, r.records) for r in distinctive.distinctive_indices(df).collect()}
    assert got == {(1, 5): (1.0, 2), (1, 7): (2.0, 1), (2, 5): (1.0, 2), (2, 9): (1.5, 1), (7, 3): (2.0, 1)}
    assert distinctive.distinctive_indices(df.limit(0)).count() == 0


def test_converged_model_is_the_fixed_point():
    rng = np.random.default_rng(1)
    mass, background = rng.integers(1, 30, 200).astype(float), rng.dirichlet(np.ones(200))
    p = distinctive.parsimonious(np.zeros(200, int), mass, background, tolerance=1e-12, rounds=200_000)
    low, high = 1e-9, mass.sum() * 10  # the closed form: p = max(0, mass / z - 9 * background) with z such that p adds up to 1
    for _ in range(200):
        z = (low + high) / 2
        low, high = (z, high) if np.maximum(0, mass / z - 9 * background).sum() > 1 else (low, z)
    assert np.abs(p - np.maximum(0, mass / z - 9 * background)).max() < 1e-4


def test_plan_meets_targets_and_limits():
    tokens, targets, repeats = {"a": 1000, "b": 500, "c": 10, "d": 0}, {"a": 0.5, "b": 0.3, "c": 0.1, "d": 0.1}, {"a": 1, "b": 2, "c": 3, "d": 2}
    for total in (None, 100, 1000, 1500, 10**9):
        plan = mixing.plan_mix(tokens, targets, repeats, total)
        assert all(b <= tokens[k] * repeats[k] * (1 + 1e-9) for k, b in plan.budgets.items()) and "d" not in plan.budgets
        assert sum(plan.budgets.values()) == pytest.approx(plan.total)
    exact = mixing.plan_mix(tokens, targets, repeats, 100)
    assert {k: b / 100 for k, b in exact.budgets.items()} == pytest.approx({"a": 0.5 / 0.9, "b": 0.3 / 0.9, "c": 0.1 / 0.9}) and set(exact.exponents.values()) == {1}
    path = mixing.plan_mix(tokens, targets, repeats, 400, shared=True)
    assert len(set(path.exponents.values())) == 1 and 0 < path.exponents["c"] < 1 and path.budgets["c"] == pytest.approx(30, rel=1e-6)
    own = mixing.plan_mix(tokens, targets, repeats, 400)
    a = own.exponents["c"]
    assert own.exponents["a"] == own.exponents["b"] == 1 and 0 < a < 1 and own.budgets["c"] == pytest.approx(30, rel=1e-6)
    assert (10 / 1510) ** (1 - a) * (0.1 / 0.9) ** a == pytest.approx(30 / 400) and own.budgets["a"] / own.budgets["b"] == pytest.approx(5 / 3)
    assert mixing.plan_mix({}, targets, repeats).budgets == {}


def test_temperature_meets_entropy():
    shares = {"a": 0.9, "b": 0.09, "c": 0.01}
    goal = (mixing.entropy(shares) + math.log(3)) / 2
    a, w = mixing.weights_for_entropy(shares, goal)
    assert 0 < a < 1 and mixing.entropy(w) == pytest.approx(goal, abs=1e-9)
    assert mixing.tempered(shares, 0)["c"] == pytest.approx(1 / 3)


def test_mixture(spark):
    rng = random.Random(4)
    spelled = {"issue": ["issue", " ISSUE ", "Issue"], "code_file": ["code-file", "CODE_FILE"], "tiny": ["tiny"], "other": ["other"]}
    data = [(i, " word" * rng.randint(1, 30), rng.choice(spelled[s]), 1, 2) for i, s in enumerate(rng.choices(["issue", "code_file", "other"], [5, 3, 2], k=1500) + ["tiny"] * 3)]
    data += [(5000, None, "issue", 1, 2), (5001, "", "issue", 1, 2), (5002, "x", None, 1, 2), data[0]]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string, tokens int, copies int")
    targets = spark.createDataFrame([("issue", 0.3, 3), ("code_file", 0.5, 2), ("tiny", 0.1, 4), ("none", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mixture(docs, targets)
    rows, facts = mixed.collect(), {r.source: r for r in report.collect()}
    limits = {"issue": 3, "code_file": 2, "tiny": 4}
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.copies <= limits[r.source] for r in rows)
    total = sum(r.tokens * r.copies for r in rows)
    for s, r in facts.items():
        mine = sum(x.tokens * x.copies for x in rows if x.source == s)
        assert r.mixed_tokens == mine and r.actual_share == pytest.approx(mine / total)
    assert set(facts) == {"issue", "code_file", "tiny", "none"} and facts["none"].actual_share == 0
    assert facts["tiny"].passes == 4.0 and facts["issue"].actual_share / facts["code_file"].actual_share == pytest.approx(0.6, rel=0.05)
    assert sorted(map(tuple, mixing.mixture(docs, targets)[0].collect())) == sorted(map(tuple, rows))
    small, _ = mixing.mixture(docs, targets, total_tokens=500)
    assert abs(sum(r.tokens * r.copies for r in small.collect()) - 500) < 120
    assert facts["tiny"].exponent < 1 and facts["issue"].exponent == 1 and facts["none"].exponent is None
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0))):
        m, r = mixing.mixture(d, t)
        assert m.count() == 0 and all(x.actual_share == 0 for x in r.collect())


def test_budgets_are_filled_with_documents_that_fit(spark):
    """A huge document within the part that is drawn does not end it."""
    sizes = [5000 if i % 7 == 0 else 10 + i % 13 for i in range(400)]
    docs = spark.createDataFrame([(i, "s", n) for i, n in enumerate(sizes)], "doc_id bigint, source string, tokens bigint")
    docs = docs.withColumn("key", F.xxhash64("doc_id")).withColumn("block", F.pmod("key", F.lit(4)).cast("int"))
    for budget in (30, 700, 4000, 6000, 20_000, sum(sizes)):
        got = mixing.fill(docs, {"s": budget}).collect()
        drawn = sum(r.tokens for r in got if r.extra)
        left = [r.tokens for r in got if not r.extra]
        assert len(got) == 400 and 0 <= budget - drawn < (min(left) if budget < 5000 else 5000 if left else 1)


BAD = ["you are a worthless idiot", "shut up you moron", "du bist ein vollidiot", "ferme ta gueule connard", "i will hurt you"]
GOOD = ["the build fails after the last change", "stupid question does this cache", "the word list holds idiot and moron", "please add a test", "der ablauf bricht ab", "il manque un test"]


def test_spelling_tricks_are_undone():
    assert abuse.plain("m.o.r.o.n") == abuse.plain("M O R O N") == abuse.plain("moooron") == abuse.plain("m0r0n") == abuse.plain("m​oron") == abuse.plain("mоrоn") == "moron"
    assert abuse.plain("call getUserName(12)") == abuse.plain("call fetch_it(7)")
    assert abuse.sentences("One thing. Two things!\nthree") == ["one thing", "two things", "thre"]


def test_classifier_learns_from_documents(spark):
    rng = random.Random(2)

    def doc(bad):
        lines = rng.sample(GOOD, 3) + ([rng.choice(BAD)] if bad else [])
        rng.shuffle(lines)
        return ".\n".join(lines)

    data = [(i, doc(i % 4 == 0), " Issue" if i % 2 else "chat-log", 1.0) for i in range(400)]
    labels = [(i, "r1", int(i % 4 == 0) if rng.random() > 0.05 else int(i % 4 != 0)) for i in range(0, 240)] + [(1, "r2", None), (300, None, None), (9999, "r1", 1)]
    docs = spark.createDataFrame(data + [(1000, None, None, 1.0), (1001, "", "x", 1.0), (1002, "  ", "x", 1.0), (1003, "you m0r0n, shut up" + " filler text" * 5000, "x", 1.0), data[7]], "doc_id bigint, text string, source string, score double")
    scored = abuse.score_abuse(docs, spark.createDataFrame(labels, "doc_id bigint, rater string, abusive int")).collect()
    score = {r.doc_id: r.score for r in scored}
    assert len(scored) == len(score) == 404 and all(0 <= s <= 1 for s in score.values())
    right = sum((score[i] >= abuse.THRESHOLD) == (i % 4 == 0) for i in range(240, 400))
    assert right >= 152
    assert score[1000] == score[1001] == score[1002] == 0 and score[1003] >= abuse.THRESHOLD
    assert {r.source for r in scored} == {"issue", "chat_log", "x", None}


def test_classifier_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "you moron", "a", 1)], "doc_id bigint, text string, source string, abusive int")
    for labels in ([], [(1, "r", 1)], [(1, "r", None)]):
        scored = abuse.score_abuse(docs, spark.createDataFrame(labels, "doc_id bigint, rater string, abusive int"))
        assert [r.score < 1e-9 for r in scored.collect()] == [True]
    assert abuse.score_abuse(docs.limit(0), spark.createDataFrame([(1, "r", 1)], "doc_id bigint, rater string, abusive int")).count() == 0
    rates = abuse.abuse_rates(spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.1), (3, None, 0.0)], "doc_id int, source string, score double"))
    assert {r.source: (r.documents, r.abusive, r.rate) for r in rates.collect()} == {"a": (2, 1, 0.5), None: (1, 0, 0.0)}
