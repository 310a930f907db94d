"""How distinctive a term is per record: a parsimonious language model.

Each record's terms are explained by a mixture of the record's own model and the collection's background. Expectation
maximisation moves the mass that the background explains out of the record's model; the converged probabilities rank
its terms. Frequent terms' background is broadcast (at most 1 / COMMON of them exist, whatever the data), all others'
is joined to the records that hold them. Records are tokenised with numpy over flat arrays; terms are keyed by 64 bits.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut

#: A term with at least this share of the collection's mass is common; there can be no more than 1 / COMMON such terms.
COMMON = 1e-5
#: Characters that are tokenised at once; bounds a task's memory. A longer text is still taken whole.
SLICE = 1_000_000
#: The odd base of the polynomial term hash.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Per code point: 1 within terms, 0 outside, -1 not yet known."""
    table = np.full(0x110000, -1, dtype=np.int8)
    table[:128] = [chr(i).isalnum() or chr(i) in "_$" for i in range(128)]
    return table


def _in_term(points: np.ndarray) -> np.ndarray:
    table = _classes()
    known = table[points]
    if (known < 0).any():
        for p in np.unique(points[known < 0]):
            kind = unicodedata.category(chr(p))
            table[p] = kind[0] == "L" or kind == "Nd"
        known = table[points]
    return known > 0


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]:
    """(record, key, count, names) of the distinct terms of each text, sorted by record and key.

    A term is a maximal run of letters, decimal digits, ``_`` or ``$`` in the lower-cased text.
    """
    lowered = [t.lower() for t in texts]
    joined = "\n".join(lowered)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.concatenate([[False], _in_term(points), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, lambda _: []
    up, down = _powers(1 << int(len(points)).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)])])
    keys = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)).view(np.int64)
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), dtype=np.int64, count=len(lowered)))
    owner = np.searchsorted(bounds, start, side="right")
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]))
    count = np.diff(np.concatenate([first, [len(owner)]]))
    at = order[first]

    def names(chosen: np.ndarray) -> list[str]:
        spots = at[chosen]
        return [joined[a:b] for a, b in zip(start[spots].tolist(), end[spots].tolist())]

    return owner[first], keys[first], count.astype(np.float64), names


def parsimonious(owner: np.ndarray, mass: np.ndarray, background: np.ndarray, weight: float = 0.1, tolerance: float = 1e-6, rounds: int = 200) -> np.ndarray:
    """Converged term probabilities of each record's own model.

    ``owner`` is ascending; ``mass`` are term counts, ``background`` collection probabilities; ``weight`` is the share
    of the record's own model in the mixture. Iterates until no probability moves by ``tolerance``; a record whose terms
    have converged takes no further part.
    """
    if not len(owner):
        return np.zeros(0)
    result = np.empty(len(mass))
    index = np.arange(len(mass))
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(owner)]]))
    p = mass / np.repeat(np.add.reduceat(mass, starts), sizes)
    rest = (1 - weight) * background
    for _ in range(rounds):
        own = weight * p
        e = mass * own / (own + rest)
        new = e / np.repeat(np.add.reduceat(e, starts), sizes)
        moved = np.maximum.reduceat(np.abs(new - p), starts) > tolerance
        p = new
        if moved.all():
            continue
        stay = np.repeat(moved, sizes)
        result[index[~stay]] = p[~stay]
        index, mass, rest, p = index[stay], mass[stay], rest[stay], p[stay]
        sizes = sizes[moved]
        starts = np.cumsum(sizes) - sizes
        if not len(index):
            return result
    result[index] = p
    return result


def _slices(values: list) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about SLICE characters (or list entries) each."""
    begin = total = 0
    for i, v in enumerate(values):
        total += len(v)
        if total >= SLICE:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(values):
        yield begin, len(values)


def _text_records(batch: pa.RecordBatch):
    texts = batch.column(1).to_pylist()
    for a, b in _slices(texts):
        yield a, b, *text_terms(texts[a:b])


def _sparse_records(batch: pa.RecordBatch):
    indices, values = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    for a, b in _slices(indices):
        sizes = [min(len(x), len(y)) for x, y in zip(indices[a:b], values[a:b])]
        owner = np.repeat(np.arange(b - a), sizes)
        keys = np.array([-1 if k is None else k for x, n in zip(indices[a:b], sizes) for k in x[:n]], dtype=np.int64)
        mass = np.array([np.nan if v is None else v for y, n in zip(values[a:b], sizes) for v in y[:n]], dtype=np.float64)
        good = (keys >= 0) & np.isfinite(mass) & (mass > 0)
        owner, keys, mass = owner[good], keys[good], mass[good]
        order = np.lexsort((keys, owner))
        owner, keys, mass = owner[order], keys[order], mass[order]
        if len(owner):
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]))
            owner, keys, mass = owner[first], keys[first], np.add.reduceat(mass, first)
        yield a, b, owner, keys, mass, lambda chosen, keys=keys: keys[chosen]


def _distinctive(records: DataFrame, extract, term_type: pa.DataType, weight: float, min_mass: float, min_records: int, max_records: int | None) -> DataFrame:
    """The operator over ``records`` (id first, then what ``extract`` reads), one row per id."""
    id_col, id_type = records.columns[0], records.schema[0].dataType.simpleString()
    arrow_term = {"string": "string", "int64": "bigint"}[str(term_type)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, keys, mass, _ in extract(batch):
                distinct, where = np.unique(keys, return_inverse=True)
                held = np.bincount(where, minlength=len(distinct))
                total = np.bincount(where, weights=mass, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(held), pa.array(total)], names=["key", "held", "mass"])

    partial = records.mapInArrow(count, "key bigint, held bigint, mass double")
    background = cut(partial.groupBy("key").agg(F.sum("held").alias("held"), F.sum("mass").alias("mass")))
    everything = background.agg(F.sum("mass")).first()[0] or 0.0
    common = background.where(F.col("mass") >= everything * COMMON)  # at most 1 / COMMON rows
    table = common.toArrow().sort_by("key") if everything else common.toArrow()
    common_keys, common_held, common_mass = (table.column(c).to_numpy() for c in ("key", "held", "mass"))

    def find(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common_keys, keys), max(len(common_keys) - 1, 0))
        return at, common_keys[at] == keys if len(common_keys) else np.zeros(len(keys), bool)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, owner, keys, _, _ in extract(batch):
                other = ~find(keys)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[other] + a)), pa.array(keys[other])], names=[id_col, "key"])

    found = records.mapInArrow(rare, f"`{id_col}` {id_type}, key bigint").join(background.where(F.col("mass") < everything * COMMON), "key")
    lists = found.groupBy(id_col).agg(F.collect_list(F.struct("key", "held", "mass")).alias("_rare")).withColumnRenamed(id_col, "_id")
    joined = records.join(lists, F.col(id_col) == F.col("_id"), "left").select(*records.columns, "_rare")
    names = [id_col, "term", "score", "mass", "records", "background"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            for a, b, owner, keys, mass, spell in extract(batch):
                at, known = find(keys)
                held, total = np.zeros(len(keys), np.int64), np.zeros(len(keys))
                held[known], total[known] = common_held[at[known]], common_mass[at[known]]
                part = lists.slice(a, b - a)
                flat = part.flatten()
                if len(flat):
                    sizes = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                    rare_owner = np.repeat(np.arange(b - a), sizes)
                    rare_key, rare_held, rare_mass = (flat.field(i).to_numpy() for i in range(3))
                    order = np.lexsort((rare_key, rare_owner))
                    spots = np.flatnonzero(~known)  # in the same order: by record, then key
                    held[spots], total[spots] = rare_held[order], rare_mass[order]
                p = parsimonious(owner, mass, total / everything, weight)
                chosen = (mass >= min_mass) & (held >= min_records)
                if max_records is not None:
                    chosen &= held <= max_records
                chosen = np.flatnonzero(chosen)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner[chosen] + a)), pa.array(spell(chosen), type=term_type), pa.array(p[chosen]), pa.array(mass[chosen]), pa.array(held[chosen]), pa.array(total[chosen] / everything)], names=names,
                )

    return joined.mapInArrow(score, f"`{id_col}` {id_type}, term {arrow_term}, score double, mass double, records bigint, background double")


def distinctive_terms(
    chunks: DataFrame, id_col: str = "point_id", text_col: str = "content", weight: float = 0.1, min_count: int = 1, min_records: int = 1, max_records: int | None = None
) -> DataFrame:
    """Every term of every record: id, term, score, mass (its count there), records (that hold it), background.

    ``score`` is the term's converged probability in the record's own model: near 0 for what the collection explains,
    high for terms the record is about. ``min_count``, ``min_records`` and ``max_records`` leave out rows of the result
    after scoring; the model always covers all terms of all records. Rows with one id count once (with the greatest
    text); null ids, null and empty texts and texts without terms give no rows; other columns are ignored.
    """
    texts = chunks.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(id_col, F.col(text_col).alias("_text"))
    records = texts.groupBy(id_col).agg(F.max("_text").alias("_text"))
    return _distinctive(records, _text_records, pa.string(), weight, min_count, min_records, max_records)


def distinctive_indices(vectors: DataFrame, id_col: str = "point_id", indices: str = "sparse_indices", values: str = "sparse_values", weight: float = 0.1) -> DataFrame:
    """The same over sparse vectors: terms are indices, their mass the values.

    Of lists of unequal length the pairs up to the shorter one's end exist; pairs with a null or negative index and
    those whose value is null, not finite or not positive are no pairs; repeated indices add up. Null vectors give no rows.
    """
    some = vectors.where(F.col(id_col).isNotNull() & (F.size(indices) > 0) & (F.size(values) > 0))
    some = some.select(id_col, F.struct(F.col(indices).cast("array<bigint>").alias("i"), F.col(values).cast("array<double>").alias("v")).alias("_pairs"))
    records = some.groupBy(id_col).agg(F.max("_pairs").alias("_pairs"))
    return _distinctive(records.select(id_col, "_pairs.i", "_pairs.v"), _sparse_records, pa.int64(), weight, 0, 1, None)
