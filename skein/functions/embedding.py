"""Embedding texts by a caller's model, batch by batch in the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Gives a dense model: texts to an array of one row a text.
DenseModel = Callable[[list[str]], np.ndarray]
#: Gives for every text its token vectors and the attention mask of its tokens.
TokenModel = Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _extended(rows: DataFrame, text_col: str, field: str, values: Callable[[list[str]], pa.Array]) -> DataFrame:
    names, at = rows.columns, rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, values(b.column(at).to_pylist())], names=[*names, field.split()[0]])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{types}, {field}")


def dense_vectors(rows: DataFrame, load: Callable[[], DenseModel], dim: int, text_col: str = "content", prefix: str = "", normalize: bool = True, batch: int = 64) -> DataFrame:
    """``rows`` with ``dense_vector array<float>``: the model's vectors of the texts, in order, with ``prefix`` in front of them.

    ``load`` makes the model, once a task. Equal texts of a batch are embedded once. Null and blank texts have no vector. A
    vector of another size than ``dim`` is an error.
    """

    model: list[DenseModel] = []

    def values(texts: list[str | None]) -> pa.Array:
        if not model:
            model.append(load())
        known = list(dict.fromkeys(t for t in texts if t and t.strip()))
        vectors = {}
        for i in range(0, len(known), batch):
            x = np.asarray(model[0]([prefix + t for t in known[i : i + batch]]), dtype=np.float32)
            if x.shape != (len(known[i : i + batch]), dim):
                raise ValueError(f"the model gave {x.shape} for {len(known[i : i + batch])} texts of {dim} dimensions")
            vectors.update(zip(known[i : i + batch], unit_rows(x) if normalize else x))
        return pa.array([vectors.get(t) for t in texts], type=pa.list_(pa.float32()))

    return _extended(rows, text_col, "dense_vector array<float>", values)


def token_vectors(rows: DataFrame, load: Callable[[], TokenModel], dim: int, text_col: str = "content", longest: int = 512, batch: int = 16) -> DataFrame:
    """``rows`` with ``multivector array<array<float>>``: the vectors of each text's tokens whose attention mask is 1, ``longest`` at most.

    A text without such a token has one zero vector; null texts have none.
    """

    model: list[TokenModel] = []

    def values(texts: list[str | None]) -> pa.Array:
        if not model:
            model.append(load())
        known, vectors = list(dict.fromkeys(t for t in texts if t is not None)), {}
        for i in range(0, len(known), batch):
            for t, (x, mask) in zip(known[i : i + batch], model[0](known[i : i + batch])):
                kept = np.asarray(x, dtype=np.float32).reshape(-1, dim)[:longest][np.asarray(mask).astype(bool)[:longest]]
                vectors[t] = (kept if len(kept) else np.zeros((1, dim), np.float32)).tolist()
        return pa.array([vectors.get(t) for t in texts], type=pa.list_(pa.list_(pa.float32())))

    return _extended(rows, text_col, "multivector array<array<float>>", values)
