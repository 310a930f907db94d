"""Encoding a corpus with a public byte-level BPE tokenizer.

The pre-tokens ("words") of a whole Arrow batch are merged together: their symbols lie in one flat numpy array, each
round finds every adjacent pair by binary search over the sorted pair keys, and merges in each word all occurrences of
its lowest-ranked pair. A word leaves the array when none of its pairs can merge. Words are remembered per task up to
a bound, so frequent ones are merged once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the pre-token pattern of the byte-level tokenizers.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEVER = np.int64(2**31 - 1)


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = [""] * 256, 256
    for b in range(256):
        if b in printable:
            names[b] = chr(b)
        else:
            names[b], spare = chr(spare), spare + 1
    return names


class MergeTable:
    """Byte ids, and per mergeable pair of ids its rank and the id of the merged symbol, sorted by pair key."""

    def __init__(self, byte_ids: np.ndarray, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        self.byte_ids, self.keys, self.ranks, self.merged = byte_ids, keys, ranks, merged

    @classmethod
    def load(cls, path: str = DEFAULT_VOCABULARY) -> MergeTable:
        """From a ``tokenizers`` JSON file of a byte-level BPE."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        byte_ids = np.array([vocab[name] for name in _byte_names()], dtype=np.int64)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(byte_ids, keys[order], order.astype(np.int64), merged[order])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets): the ids of ``words[i]`` are ``flat[offsets[i]:offsets[i + 1]]``."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), sizes)
        done_symbols, done_owner = [], []
        last = len(self.keys) - 1
        while len(symbols) > 1:
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.searchsorted(self.keys, key)
            np.minimum(at, last, out=at)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], NEVER)
            rank = np.append(rank, NEVER)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(owner)))
            best = np.minimum.reduceat(rank, starts)
            over = best == NEVER
            if over.any():
                gone = np.repeat(over, lengths)
                done_symbols.append(symbols[gone])
                done_owner.append(owner[gone])
                if over.all():
                    symbols, owner = symbols[:0], owner[:0]
                    break
                keep = ~gone
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                at = np.append(at, 0)[keep]
                best, lengths = best[~over], lengths[~over]
            else:
                at = np.append(at, 0)
            hit = np.flatnonzero(rank == np.repeat(best, lengths))
            # of overlapping occurrences (a a a) the leftmost count: every other one within a run of neighbours
            first = np.append(True, np.diff(hit) != 1)
            run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = self.merged[at[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols = np.concatenate([*done_symbols, symbols])
        owner = np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(raw))
        return symbols[order].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=4)
def _word_finder():
    import regex

    return regex.compile(WORD_PATTERN).findall


class Encoder:
    """Encodes batches of texts; remembers up to ``remember`` words of up to 64 characters between batches."""

    def __init__(self, merges: MergeTable, remember: int = 200_000):
        self.merges, self.remember = merges, remember
        self.known: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, lengths) of the texts; null and empty texts have no ids."""
        find = _word_finder()
        words = [find(t) if t else [] for t in texts]
        new: dict[str, int] = {}
        if len(self.known) > self.remember:
            self.known, self.flat, self.offsets = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        known, base = self.known, len(self.offsets) - 1
        for ws in words:
            for w in ws:
                if w not in known and w not in new:
                    new[w] = base + len(new)
        flat, offsets = self.flat, self.offsets
        if new:
            more, cuts = self.merges.encode(list(new))
            flat = np.concatenate([flat, more])
            offsets = np.concatenate([offsets, offsets[-1] + cuts[1:]])
            if max(map(len, new)) <= 64:
                known.update(new)
                self.flat, self.offsets, new = flat, offsets, {}
        look = known if not new else known | new
        index = np.fromiter((look[w] for ws in words for w in ws), dtype=np.int64, count=sum(map(len, words)))
        begin, size = offsets[index], offsets[index + 1] - offsets[index]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begin - (ends - size), size) + np.arange(total)]
        per_text = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        token_ends = np.concatenate([[0], ends])
        return ids, token_ends[bounds[1:]] - token_ends[bounds[:-1]]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col``, ``ids array<int>``: the token ids of every text, without special tokens.

    Empty and null texts give an empty list; texts that look like special tokens are ordinary text; a null id is kept.
    One row per input row: repeated rows give repeated results. Other columns are ignored, whatever their names.
    """
    merges = MergeTable.load(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges)
        for b in batches:
            ids, lengths = encoder.batch(b.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``tokens bigint``: how many ids :func:`encode_corpus` gives each text."""
    merges = MergeTable.load(vocabulary)
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges)
        for b in batches:
            _, lengths = encoder.batch(b.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lengths)], names=[*names, "tokens"])

    fields = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return spread(docs.select(*names, text_col)).mapInArrow(run, f"{fields}, tokens bigint")
