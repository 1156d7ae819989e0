"""Pluggable embedders and the rebuild of a model's collection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Turns a batch of texts into a matrix, one row a text.

    One with a limit says so in an attribute ``most_chars``; without it whole texts are given.
    """

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder that needs no model: signed hashed words, brought to unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dimensions))
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = xxhash.xxh64_intdigest(word)
                out[row, h % dimensions] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)

    return embed


#: Models known by default; an unknown name falls back to the first.
REGISTRY = {"small": 64, "base": 96, "large": 128}


def model_or_default(name: str | None) -> str:
    return name if name in REGISTRY else next(iter(REGISTRY))


def embedded(docs: DataFrame, id_col: str, text: str, model: str, embedder: Embedder | None = None) -> DataFrame:
    """``(model_key, id, vector)`` of whole texts, or of as many first characters as the embedder's ``most_chars``."""
    model = model_or_default(model)
    run_on = embedder or hashing_embedder(REGISTRY[model])
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                vectors = np.asarray(run_on(pdf["text"].fillna("").tolist()), np.float32)
                yield pd.DataFrame({"model_key": model, "id": pdf["id"].to_numpy(), "vector": list(vectors)})

    most = getattr(run_on, "most_chars", None)
    given = docs.select(F.col(id_col).alias("id"), (F.col(text) if most is None else F.substring(text, 1, most)).alias("text"))
    return given.mapInPandas(run, f"model_key string, id {kind}, vector array<float>")


def upserted(collection: DataFrame, new: DataFrame) -> DataFrame:
    """The collection with ``new`` in place of what it had for the same model and id; a repeated job changes nothing."""
    return collection.join(new.select("model_key", "id"), ["model_key", "id"], "left_anti").unionByName(new)
