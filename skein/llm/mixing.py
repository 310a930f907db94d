"""Mixing sources to target weights.

Weights lie on the tempered path between the sources' own token shares s and their targets t: w = s^(1-a) * t^a. The
exponent a is bisected: 1 (the target itself) if the budget allows it, else the largest a at which the source need not be
repeated more often than it may. One exponent for all sources would let one tiny source pull every other one away from its target; by
default each source that its limit binds has its own. Without targets,
w ~ s^a is bisected to a target entropy. The weights become token budgets, and a budget becomes whole passes over a
source plus the leading part of a block permutation of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.tokens import DEFAULT_VOCABULARY, count_tokens
from skein.session import cut

#: Blocks of the permutation of a source: enough that one block of a source is a small part of it.
BLOCKS = 4096


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, ``_`` for ``-``."""
    return F.replace(F.lower(F.trim(source)), F.lit("-"), F.lit("_"))


def bisect(holds: Callable[[float], bool], low: float, high: float, steps: int = 60) -> float:
    """The greatest x in [low, high] (to the last bisection step) with ``holds(x)``, given that it holds up to some x."""
    if holds(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def tempered(shares: dict[str, float], exponent: float, targets: dict[str, float] | None = None) -> dict[str, float]:
    """Normalised s^a, or s^(1-a) * t^a with targets; sources without tokens or target get 0."""
    raw = {k: (s ** (1 - exponent) * targets.get(k, 0.0) ** exponent if targets is not None else s**exponent) if s > 0 else 0.0 for k, s in shares.items()}
    total = sum(raw.values())
    return {k: v / total if total else 0.0 for k, v in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def weights_for_entropy(shares: dict[str, float], target: float) -> tuple[float, dict[str, float]]:
    """Exponent in [0, 1] and weights s^a whose entropy comes down to ``target`` nats (flat weights if it is higher)."""
    a = bisect(lambda x: entropy(tempered(shares, x)) >= target, 0.0, 1.0)
    return a, tempered(shares, a)


@dataclass(frozen=True)
class MixPlan:
    """What a mixture will hold: the total budget, tokens to draw per source, and the exponent found for each."""

    total: float
    budgets: dict[str, float]
    exponents: dict[str, float]


def limited(share: float, goal: float, most: float) -> tuple[float, float]:
    """(exponent a, weight) of a source with a natural share and a goal whose weight may be ``most`` at most.

    The weight is share^(1-a) * goal^a with the a nearest to 1 that keeps the limit, bisected; if none does, a is 0 and the weight the limit itself.
    """
    at = lambda a: share ** (1 - a) * goal**a
    if share <= goal:
        a = bisect(lambda x: at(x) <= most * (1 + 1e-12), 0.0, 1.0)
    else:  # the weight goes up with the share: what lacks elsewhere makes it grow towards its limit
        a = 1 - bisect(lambda x: at(1 - x) <= most * (1 + 1e-12), 0.0, 1.0)
    return a, min(at(a), most)


def plan_mix(
    tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: float | None = None, shortfall: float = 0.02, shared: bool = False
) -> MixPlan:
    """Budgets from the tokens each source has, its target share and how often it may be repeated at most.

    Targets of sources without tokens are out of reach; the others' are scaled to add up to 1. Without ``total`` the
    mixture is the largest in which the shares that the repetition limits keep from sources add up to ``shortfall`` at
    most (bisected). A total beyond what all sources may give together is reduced to that. A source whose share would
    take it over its limit comes down from its goal towards its natural share by an exponent of its own, and what
    it lacks goes to the others in proportion to their goals, which may take these to their limits in turn; all others keep exponent 1. With
    ``shared`` there is one exponent for all sources, which goes down until all limits hold.
    """
    have = {k: n for k, n in tokens.items() if n > 0 and targets.get(k, 0.0) > 0 and repeats.get(k, 0) > 0}
    if not have:
        return MixPlan(0.0, {}, {})
    room = {k: n * repeats[k] for k, n in have.items()}
    goal_sum, all_room, all_have = sum(targets[k] for k in have), float(sum(room.values())), sum(have.values())
    goals, shares = {k: targets[k] / goal_sum for k in have}, {k: n / all_have for k, n in have.items()}
    if total is None:
        lacking = lambda t: sum(max(0.0, goals[k] - room[k] / t) for k in have)
        total = bisect(lambda t: lacking(t) <= shortfall, min(room[k] / goals[k] for k in have), all_room)
    total = min(total, all_room)
    if shared:
        fits = lambda x: all(w * total <= room[k] * (1 + 1e-12) for k, w in tempered(shares, x, goals).items())
        a = bisect(fits, 0.0, 1.0)
        return MixPlan(total, {k: min(w * total, float(room[k])) for k, w in tempered(shares, a, goals).items()}, dict.fromkeys(have, a))
    exponents, weights, held = dict.fromkeys(have, 1.0), dict(goals), {}
    while over := [k for k in have if k not in held and weights[k] * total > room[k] * (1 + 1e-12)]:
        for k in over:
            exponents[k], held[k] = limited(shares[k], goals[k], room[k] / total)
        free = sum(goals[k] for k in have if k not in held)
        left = 1 - sum(held.values())
        if not free:  # every source is at its limit
            held = {k: room[k] / total for k in have}
        weights = {k: held[k] if k in held else goals[k] / free * left for k in have}
    return MixPlan(total, {k: min(w * total, float(room[k])) for k, w in weights.items()}, exponents)


def _of(values: dict[str, float], otherwise: float) -> Column:
    """The value of the row's source; there is one entry per target source."""
    known = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))]) if values else F.lit(None).cast("map<string,double>")
    return F.coalesce(F.try_element_at(known, F.col("source")), F.lit(otherwise))


def leading_part(docs: DataFrame, rest: dict[str, float]) -> DataFrame:
    """``docs`` (doc_id, source, tokens, key, block) with extra: 1 for the leading documents of each source's block permutation whose tokens add up to at most ``rest``.

    Blocks are summed first, so that only the documents of the one block in which a source's part ends are put in order.
    """
    blocks = docs.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # over BLOCKS rows a source
    placed = blocks.withColumn("before", before).withColumn("rest", _of(rest, 0.0))
    # blocks that lie whole within the rest, the one block that the rest ends in, and those beyond it
    inside = F.when(F.col("before") + F.col("size") <= F.col("rest"), 1).when(F.col("before") < F.col("rest"), 0).otherwise(-1)
    drawn = docs.join(placed.select("source", "block", "before", "rest", inside.alias("inside")), ["source", "block"])
    upto = F.sum("tokens").over(W.partitionBy("source", "block").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    edge = drawn.where(F.col("inside") == 0).withColumn("extra", (F.col("before") + upto <= F.col("rest")).cast("int"))
    whole = drawn.where(F.col("inside") != 0).withColumn("extra", (F.col("inside") == 1).cast("int"))
    return whole.unionByName(edge).select(*docs.columns, "extra")


def fill(docs: DataFrame, rest: dict[str, float], rounds: int = 4) -> DataFrame:
    """doc_id, source, tokens, extra of all ``docs``: extra is 1 for documents of at most ``rest`` tokens of their source together.

    The leading part is taken; then, of the documents behind it that still fit into what is left, the leading part again. What remains open is
    less than one document: the one that the last round stopped at, or any that is left.
    """
    done, pool, rest = [], docs, dict(rest)
    columns = ["doc_id", "source", "tokens", "extra"]
    for _ in range(rounds):
        fits = F.col("tokens") <= _of(rest, 0.0)
        done.append(pool.where(~fits).withColumn("extra", F.lit(0)).select(*columns))
        marked = cut(leading_part(pool.where(fits), rest))
        done.append(marked.where("extra = 1").select(*columns))
        pool = marked.where("extra = 0").drop("extra")
        got = marked.where("extra = 1").groupBy("source").agg(F.sum("tokens").alias("n")).collect()  # one row per target source
        if not got:
            break
        for r in got:
            rest[r.source] -= r.n
    done.append(pool.withColumn("extra", F.lit(0)).select(*columns))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mixture(
    docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, shortfall: float = 0.02, seed: int = 17, vocabulary: str = DEFAULT_VOCABULARY, shared: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) of ``docs`` (doc_id, text, source) under ``targets`` (source, target_share, max_repeats).

    Mixture: doc_id, source, tokens, copies (how often the document is used, at least 1, at most max_repeats).
    Report, one row per target source: source, target_share, actual_share, max_repeats, documents, source_tokens,
    mixed_tokens, passes (mixed over source tokens), exponent (below 1 where the repetition limit binds, null for sources that are not mixed). Sources are compared by :func:`source_name`; a document whose
    source is null or has no target, and one without tokens (null, empty text), is not mixed. A source without
    documents gets 0. Repeated rows of a document count once, repeated targets by their greatest values; a null share is 0, null repeats
    mean 1. Tokens are counted over all documents; only one row per target source comes to the driver.
    """
    goals = targets.where(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("source"))
    goals = goals.agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    named = docs.where(F.col("source").isNotNull()).select("doc_id", source_name(F.col("source")).alias("source"), "text")
    counted = count_tokens(named, keep=("source",), vocabulary=vocabulary).where(F.col("tokens") > 0)
    counted = counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("s")).select("doc_id", "s.source", "s.tokens")
    key = F.xxhash64(F.lit(seed), "doc_id")
    counted = cut(counted.select("*", key.alias("key"), F.shiftrightunsigned(key, 64 - BLOCKS.bit_length() + 1).cast("int").alias("block")))
    sizes = counted.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("documents"))
    rows = goals.join(sizes, "source", "left").na.fill(0, ["source_tokens", "documents"]).collect()  # one row per target source
    plan = plan_mix({r.source: r.source_tokens for r in rows}, {r.source: r.target_share for r in rows}, {r.source: r.max_repeats for r in rows}, total_tokens, shortfall, shared)

    passes, rest = {}, {}
    for r in rows:
        budget = plan.budgets.get(r.source, 0.0)
        passes[r.source] = min(int((budget + 0.5) // r.source_tokens), r.max_repeats) if r.source_tokens else 0
        rest[r.source] = max(0.0, budget - passes[r.source] * r.source_tokens) if passes[r.source] < r.max_repeats else 0.0
    mine = counted.where(F.col("source").isin(*[r.source for r in rows]) if rows else F.lit(False))
    mixed = fill(mine, rest).select("doc_id", "source", "tokens", (_of(passes, 0).cast("int") + F.col("extra")).alias("copies")).where(F.col("copies") > 0)

    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    facts = [(r.source, r.target_share, r.max_repeats, r.documents, r.source_tokens, plan.exponents.get(r.source)) for r in rows]
    facts = docs.sparkSession.createDataFrame(facts, "source string, target_share double, max_repeats int, documents bigint, source_tokens bigint, exponent double")
    report = facts.join(F.broadcast(used), "source", "left").na.fill(0, ["mixed_tokens"])  # one row per target source
    everything = F.sum("mixed_tokens").over(W.partitionBy(F.lit(1)))
    report = report.select(
        "source", "target_share", F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(0.0).alias("actual_share"), "max_repeats", "documents", "source_tokens", "mixed_tokens",
        F.when(F.col("source_tokens") > 0, F.col("mixed_tokens") / F.col("source_tokens")).otherwise(0.0).alias("passes"), "exponent",
    )
    return mixed, report
