"""Embedders: objects that turn texts into unit vectors, used as Arrow functions; and one that needs no weights.

An embedder has a model_key, a dimension, normalized, a fingerprint over all that defines its vectors, and ``vectors``
for a list of texts. Passages and queries have prefixes of their own. ``HashedEmbedder`` counts words and letter
trigrams in signed hash places: no meaning beyond shared spelling, but the same everywhere, offline.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.similarity import trigrams


class Embedder(Protocol):
    model_key: str
    dimension: int
    normalized: bool

    @property
    def fingerprint(self) -> str: ...

    def vectors(self, texts: list[str]) -> np.ndarray: ...


#: Texts whose parts are counted together.
COUNTED = 256


@lru_cache(maxsize=200_000)
def _hash(part: str) -> int:
    return int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")


@dataclass(frozen=True)
class HashedEmbedder:
    model_key: str = "hashed-v1"
    dimension: int = 256
    normalized: bool = True
    passage_prefix: str = ""
    query_prefix: str = ""

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def vectors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i in range(0, len(texts), COUNTED):
            parts = [[_hash(part) for part in [*text.lower().split(), *trigrams(text)]] for text in texts[i : i + COUNTED]]
            hashes = np.array([h for x in parts for h in x], np.uint64)
            cell = np.repeat(np.arange(len(parts)), [len(x) for x in parts]) * self.dimension + (hashes % np.uint64(self.dimension)).astype(np.int64)
            signed = np.bincount(cell, np.where(hashes >> np.uint64(63), 1.0, -1.0), len(parts) * self.dimension)
            out[i : i + COUNTED] = signed.reshape(len(parts), self.dimension)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(text: Column, embedder: Embedder, query: bool = False) -> Column:
    """The vector of each text; null for null. The embedder travels to the workers once for each task."""
    prefix = getattr(embedder, "query_prefix" if query else "passage_prefix", "")

    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        found = iter(embedder.vectors([prefix + t for t in texts[known]])) if known.any() else iter(())
        return pd.Series([next(found).astype(np.float32) if k else None for k in known])

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)


#: Embedders by name; ``none`` means that there is only the lexical strategy.
FACTORIES = {"hashed": HashedEmbedder}


def embedder_for(name: str) -> Embedder | None:
    if name == "none":
        return None
    if name not in FACTORIES:
        raise ValueError(f"no embedder {name}; there are none, {', '.join(sorted(FACTORIES))}")
    return FACTORIES[name]()
