"""Most similar vectors for every vector: balanced posting lists.

Centroids come from a balanced hierarchical clustering of a bounded sample; they are searched by an in-memory graph of
near centroids. Every vector is written to the lists of its nearest centroids, boundary vectors to several of them
(those within a ratio of the nearest distance), and looks for its neighbours in a few more, pruned by a wider ratio.
Lists of near centroids are kept together by one task, to which a vector is sent once for all of them.
Equal vectors are one entry with their smallest ids, so a third of all rows being copies of one vector makes no list
long. A list that is long all the same, because the sample has too few vectors for so many or they crowd, is taken apart into posting
lists of its own by the task that holds it. Candidates are found with single-precision products and ranked by the double-precision cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.vectors import usable
from skein.operators.search import dense_topk_set, top_per
from skein.session import cut, parts

#: Equal vectors are gathered by this many salts first; those with more than HOT copies are also joined by them.
SALTS, HOT = 256, 4096
#: Lists in a group.
TOGETHER = 12


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(norms > 0, norms, 1)[:, None]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Cluster of each row of unit vectors; a size penalty keeps the clusters alike in size."""
    centers = x[rng.choice(len(x), k, replace=False)]
    fair = len(x) / k
    penalty = np.zeros(k, dtype=np.float32)
    for _ in range(rounds):
        near = np.argmax(x @ centers.T - penalty, axis=1)
        sizes = np.bincount(near, minlength=k)
        penalty += 0.02 * (sizes / fair - 1).clip(-1, 4).astype(np.float32)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers = np.where((sizes > 0)[:, None], unit(sums), x[rng.choice(len(x), k)])
    return near


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 11) -> np.ndarray:
    """About ``lists`` unit centroids; splits go on until no cluster holds much more than its even share of ``x``."""
    rng = np.random.default_rng(seed)
    most = max(1, math.ceil(len(x) / max(1, lists)))
    todo, found = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most * 1.5:
            found.append(unit(x[rows].mean(axis=0, keepdims=True))[0])
            continue
        k = min(16, max(2, round(len(rows) / most)))
        near = _kmeans(x[rows], k, rng)
        if np.bincount(near).max() == len(rows):  # all alike: any split is as good
            near = rng.integers(0, k, len(rows))
        todo += [rows[near == c] for c in range(k) if (near == c).any()]
    return np.ascontiguousarray(found, dtype=np.float32)


@dataclass(frozen=True)
class ListIndex:
    """Centroids, the graph of their nearest centroids, entry points spread over them, and the group of near lists that each belongs to."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    group: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, degree: int = 16) -> ListIndex:
        c = balanced_centroids(unit(sample.astype(np.float32)), lists)
        degree = min(degree, len(c) - 1)
        graph = np.zeros((len(c), degree), dtype=np.int32)
        for i in range(0, len(c), 512):
            sims = c[i : i + 512] @ c.T
            sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
            if degree:
                graph[i : i + 512] = np.argpartition(-sims, degree - 1, axis=1)[:, :degree]
        pivots = balanced_centroids(c, max(1, math.isqrt(len(c)))) if len(c) > 1 else c
        heads = balanced_centroids(c, max(1, len(c) // TOGETHER)) if len(c) > 1 else c
        return cls(c, graph, np.unique(np.argmax(pivots @ c.T, axis=1)).astype(np.int32), np.argmax(c @ heads.T, axis=1).astype(np.int32))

    @cached_property
    def around(self) -> list[np.ndarray]:
        """The centroids within two steps of the graph from each entry point."""
        return [np.unique(np.concatenate([[e], self.graph[e], self.graph[self.graph[e]].ravel()])) for e in self.entries]

    def search(self, x: np.ndarray, beam: int = 8, starts: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(lists, cosines), nearest first, of the ``beam`` centroids nearest to each unit vector among those around its ``starts`` nearest entry points.

        All vectors that start at one point are compared with the centroids around it in one product. Where these are fewer than ``beam``, -1 stands for none.
        """
        ids, sims = [], []
        for i in range(0, len(x), 8192):
            a, b = self._search(x[i : i + 8192], beam, starts)
            ids.append(a)
            sims.append(b)
        return np.concatenate(ids), np.concatenate(sims)

    def _search(self, x: np.ndarray, beam: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
        starts = min(starts, len(self.entries))
        near = np.argpartition(-(x @ self.centroids[self.entries].T), starts - 1, axis=1)[:, :starts]
        ids, sims = np.full((len(x), starts, beam), -1, np.int32), np.full((len(x), starts, beam), -3, np.float32)
        order = np.argsort(near, axis=None, kind="stable")
        ends = np.cumsum(np.bincount(near.ravel(), minlength=len(self.entries)))
        for e, (begin, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
            if begin == end:
                continue
            row, slot = np.divmod(order[begin:end], starts)
            those = self.around[e]
            found = x[row] @ self.centroids[those].T
            keep = min(beam, len(those))
            top = np.argpartition(-found, keep - 1, axis=1)[:, :keep]
            ids[row, slot, :keep], sims[row, slot, :keep] = those[top], np.take_along_axis(found, top, 1)
        ids, sims = ids.reshape(len(x), -1), sims.reshape(len(x), -1)
        order = np.argsort(ids, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -3
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > -3, ids, -1), sims


@dataclass(frozen=True)
class Reach:
    """How far a vector reaches: it is held by up to ``replicas`` lists within ``replicate_ratio`` of its nearest distance, and searches up to ``probes`` within ``probe_ratio``."""

    replicate_ratio: float
    replicas: int
    probe_ratio: float
    probes: int

    def lists(self, index: ListIndex, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, held, searched) for every list that a unit vector is held by or searches."""
        ids, sims = index.search(x, self.probes)
        away = np.sqrt(np.maximum(2 - 2 * sims, 1e-12))
        near = away[:, :1]
        searched = away <= near * self.probe_ratio
        held = (away <= near * self.replicate_ratio) & (np.arange(ids.shape[1]) < self.replicas)
        row, col = np.nonzero((searched | held) & (ids >= 0))
        return row, ids[row, col], held[row, col], searched[row, col]


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def dealt(spark: SparkSession, groups: int, partitions: int) -> np.ndarray:
    """A number for each group by which a shuffle deals the groups out evenly: hashes of few keys would leave some tasks without one and give others several."""
    ids = spark.range(0, 16 * (groups + partitions) + 64, 1, 1).select(F.col("id").cast("int").alias("id")).select("id", F.pmod(F.hash("id"), F.lit(partitions)).alias("at")).toPandas()
    by_task = [ids.id[ids["at"] == n].tolist() for n in range(partitions)]
    return np.array([by_task[g % partitions][g // partitions] for g in range(groups)], dtype=np.int32)


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """(entries, members): an entry (rep, h1, h2, ids, copies, vector) per distinct usable vector, and all ids as (h1, h2, salt, ids).

    Usable: ``dim`` finite components, not all zero. An entry's ``ids`` are the ``keep`` smallest that
    share the vector; ``members`` has all of them in up to SALTS rows a vector, so that a hot vector is in no single row. Two hashes
    of 64 bits stand for the vector, which is so moved twice only.
    """
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(v, dim)).select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: (x + F.lit(0.0).cast("float")).cast("float")).alias("vector"))
    keyed = rows.select("*", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    members = keyed.groupBy("h1", "h2", "salt").agg(F.collect_set("id").alias("ids"), F.first("vector").alias("vector"))
    first = F.slice(F.array_sort("ids"), 1, keep)
    whole = members.groupBy("h1", "h2").agg(F.sum(F.size("ids")).alias("copies"), F.slice(F.array_sort(F.flatten(F.collect_list(first))), 1, keep).alias("ids"), F.first("vector").alias("vector"))
    return whole.select(F.col("ids")[0].alias("rep"), "h1", "h2", "ids", "copies", "vector"), members.drop("vector")


def nearest_vectors(
    vectors: DataFrame, k: int = 5, min_similarity: float = -1.0, id_col: str = "point_id", vector_col: str = "dense_vector", dim: int = 64,
    list_size: int = 500, sample_rows: int = 100_000, longest: int = 8_000, replicate_ratio: float = 1.2, replicas: int | None = None, probe_ratio: float = 1.6, probes: int | None = None,
) -> DataFrame:
    """point_id, neighbor, similarity (cosine, 6 places), rank (1 to k): the k most similar other points of every usable vector.

    Order: similarity, then the smaller id. Of these, rows below ``min_similarity`` are left out. Every usable vector is
    indexed and every one searches; the centroids are fitted on at most ``sample_rows`` of them, a list for every ``list_size``
    vectors, or for eight of the sample where that is fewer; a list that so holds more than ``longest`` is divided once more within its task, by its own vectors. A vector lies in the lists
    of up to ``replicas`` centroids within ``replicate_ratio`` of its nearest distance, and searches up to ``probes`` within
    ``probe_ratio``; by default these grow slowly with the number of lists (8 probes and 4 replicas at 243), as a vector's neighbors lie in
    ever more of them; the accuracy loss is what lies in none (see :func:`recall`). Unusable vectors (null, of another length, with null, NaN or infinite
    components, all zero) and null ids give no rows; repeated rows count once; an id with several vectors is
    searched by each and may occur with each. Other columns are ignored.
    """
    entries, members = distinct_vectors(vectors, id_col, vector_col, dim, k + 1)
    entries = cut(entries)
    n = entries.count()
    lists = max(1, min(n // list_size, sample_rows // 8))
    wanted = min(n, sample_rows, 24 * lists)
    part = min(1.0, 1.1 * wanted / max(n, 1))
    picked = entries.where(F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(1_000_000)) < int(part * 1_000_000) + 1).select("vector").limit(wanted).toArrow()
    sample = _matrix(picked.column(0), dim) if picked.num_rows else np.ones((1, dim), np.float32)
    tasks = parts(entries)
    probes = probes or max(6, round(8 * (lists / 243) ** 0.2))
    replicas = replicas or -(-probes // 2)
    index, reach = ListIndex.fit(sample, lists), Reach(replicate_ratio, replicas, probe_ratio, probes)
    number = dealt(vectors.sparkSession, int(index.group.max()) + 1, tasks)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column("vector"), dim).astype(np.float64)).astype(np.float32)
            row, ids, held, _ = reach.lists(index, x)
            together = index.group[ids]
            order = np.lexsort((together, row))
            row, ids, held, together = row[order], ids[order], held[order], together[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (together[1:] != together[:-1])]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array((ids * 2 + held).astype(np.int32)))
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[together[first]]), lists, batch.column("rep").take(at), batch.column("ids").take(at), batch.column("vector").take(at)], names=["group", "lists", "rep", "ids", "vector"]
            )

    placed = entries.select("rep", "ids", "vector").mapInArrow(place, "group int, lists array<int>, rep bigint, ids array<bigint>, vector array<float>")

    def posted(row: np.ndarray, at: np.ndarray, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows that search, rows that are held) of every list."""
        order = np.argsort(at, kind="stable")
        row, held, at = row[order], held[order], at[order]
        edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else []
        for a, b in zip(edges[:-1], edges[1:]):
            yield row[a:b], row[a:b][held[a:b]]

    def searches(x: np.ndarray, lists: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows that search, 512 at most, rows that are searched): of every list, or of those that a long one is divided into."""
        for seekers, data in lists:
            parts = [(seekers, data)]
            if len(data) > longest:
                own = ListIndex.fit(x[data[:: max(1, len(data) // 50_000)]], len(data) // list_size)
                row, at, held, _ = reach.lists(own, x[seekers])
                parts = posted(seekers[row], at, held & np.isin(seekers[row], data))
            for q, c in parts:
                for i in range(0, len(q) if len(c) else 0, 512):
                    yield q[i : i + 512], c

    def look(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("vector"), dim).astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        small = (x / norms[:, None]).astype(np.float32)
        rep = table.column("rep").to_numpy()
        ids = table.column("ids").combine_chunks()
        id_flat, id_ends = ids.flatten().to_numpy(), np.cumsum(ids.value_lengths().to_numpy())
        id_starts = id_ends - np.diff(np.concatenate([[0], id_ends]))
        out_q, out_id, out_sim = [], [], []
        lists = table.column("lists").combine_chunks()
        coded = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(x)), lists.value_lengths().to_numpy())
        for seekers, data in searches(small, posted(row, coded >> 1, (coded & 1).astype(bool))):
            best = min(k + 1, len(data))
            sims = small[seekers] @ small[data].T
            floor = np.partition(sims, len(data) - best, axis=1)[:, len(data) - best] - 4e-6
            q, c = np.nonzero(sims >= np.maximum(floor, np.float32(min_similarity - 1e-5))[:, None])
            q, c = seekers[q], data[c]
            exact = np.round(np.einsum("ij,ij->i", x[q], x[c]) / (norms[q] * norms[c]), 6)
            ok = exact >= min_similarity
            q, c, exact = q[ok], c[ok], exact[ok]
            many = id_ends[c] - id_starts[c]
            ends = np.cumsum(many)
            other = id_flat[np.repeat(id_starts[c] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
            q, exact = np.repeat(q, many), np.repeat(exact, many)
            order = np.lexsort((other, -exact, q))
            q, other, exact = q[order], other[order], exact[order]
            first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
            place_in = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
            top = place_in <= k
            out_q.append(rep[q[top]])
            out_id.append(other[top])
            out_sim.append(exact[top])
        empty = np.zeros(0)
        return pa.table({"rep": pa.array(np.concatenate([*out_q, empty]).astype(np.int64)), "near": pa.array(np.concatenate([*out_id, empty]).astype(np.int64)), "sim": pa.array(np.concatenate([*out_sim, empty]))})

    found = placed.repartition(tasks, "group").groupBy("group").applyInArrow(look, "rep bigint, near bigint, sim double")
    # at most probes * probes * (k + 1) candidates an entry
    best = found.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("less"), "near"))), 1, k + 1).alias("best"))

    answers = best.join(entries.select("rep", "copies", "h1", "h2"), "rep")
    rows = answers.where(F.col("copies") == 1).select(F.col("rep").alias("id"), "best")
    few = members.join(answers.where((F.col("copies") > 1) & (F.col("copies") <= HOT)), ["h1", "h2"])
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    many = members.join(answers.where(F.col("copies") > HOT).select("h1", "h2", "best", salts), ["h1", "h2", "salt"])
    rows = rows.unionByName(few.select(F.explode("ids").alias("id"), "best")).unionByName(many.select(F.explode("ids").alias("id"), "best"))
    others = F.slice(F.filter("best", lambda x: x["near"] != F.col("id")), 1, k)
    rows = rows.select(F.col("id").alias(id_col), F.posexplode(others).alias("rank", "hit"))
    return rows.select(id_col, F.col("hit.near").alias("neighbor"), (-F.col("hit.less")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def similar_pairs(nearest: DataFrame, at_least: float, id_col: str = "point_id") -> DataFrame:
    """point_a < point_b of the pairs in which one is among the nearest of the other, at this similarity or more."""
    near = nearest.where(F.col("similarity") >= at_least)
    return near.select(F.least(id_col, "neighbor").alias("point_a"), F.greatest(id_col, "neighbor").alias("point_b")).distinct()


def recall(vectors: DataFrame, nearest: DataFrame, k: int = 5, every: int = 100, floor: float = 0.85, id_col: str = "point_id", vector_col: str = "dense_vector", dim: int = 64) -> DataFrame:
    """queries, neighbors, found, recall, recall_above: how much of the exact k nearest :func:`nearest_vectors` has found.

    Queries are all usable vectors whose id is divisible by ``every``; they are compared with all vectors, block by
    block. ``recall_above`` counts only neighbors of a similarity of ``floor`` or more. Without queries the recalls are null.
    """
    rows = vectors.where(usable(F.col(vector_col), dim)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).distinct()
    exact = dense_topk_set(rows, rows.where(F.col("id") % every == 0).select(F.col("id").alias("query"), "vector"), k + 1, key="id", query_key="query", vector="vector", dim=dim)
    exact = top_per(exact.where(F.col("query") != F.col("id")).drop("rank"), ["query"], [F.desc("score"), F.col("id")], k)
    got = nearest.where(F.col(id_col) % every == 0).select(F.col(id_col).alias("query"), F.col("neighbor").alias("id"), F.lit(1).alias("got")).distinct()
    both = exact.join(got, ["query", "id"], "left")
    hit, above = F.coalesce("got", F.lit(0)), F.col("score") >= floor
    return both.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("neighbors"), F.coalesce(F.sum(hit), F.lit(0)).alias("found"), F.avg(hit).alias("recall"), F.avg(F.when(above, hit)).alias("recall_above"))
