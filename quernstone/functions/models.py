"""Model-backed steps behind one protocol: a model maps a batch of texts to a batch of answers.

Real models (embedders, rerankers, graders, writers) are plugged in by registering a factory; the offline defaults
are deterministic, so that everything around them can be tested. A factory runs once per Python worker.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Model = Callable[[list[str]], list]
_FACTORIES: dict[str, Callable[[], Model]] = {}
_LOADED: dict[str, Model] = {}


def register(name: str, factory: Callable[[], Model]) -> None:
    _FACTORIES[name] = factory


def _load(name: str, factory: Callable[[], Model]) -> Model:
    if name not in _LOADED:
        _LOADED[name] = factory()
    return _LOADED[name]


def factory_of(name: str) -> Callable[[], Model]:
    if name not in _FACTORIES:
        raise ValueError(f"no model is registered as {name!r}; there are {sorted(_FACTORIES)}")
    return _FACTORIES[name]


def apply_model(name: str, returns: str, *inputs: Column, fail_open: bool = True) -> Column:
    """The model's answer for each row, the inputs joined by line feeds.

    If a batch fails its rows are asked one by one; a row that fails by itself is null if ``fail_open``, else an error.
    """
    factory = factory_of(name)

    def one(model: Model, text: str) -> object:
        try:
            return model([text])[0]
        except Exception:
            if not fail_open:
                raise
            return None

    @F.pandas_udf(returns)
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            model, asked = _load(name, factory), [t or "" for t in texts]
            try:
                yield pd.Series(model(asked))
            except Exception:
                yield pd.Series([one(model, t) for t in asked])

    return answer(F.concat_ws("\n", *inputs) if len(inputs) > 1 else inputs[0])


def hash_embedder(dim: int = 64) -> Callable[[], Model]:
    """Feature hashing of words with signs, length 1."""

    def factory() -> Model:
        def embed(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = np.zeros(dim)
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1 if h & 0x80000000 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype("float32").tolist())
            return out

        return embed

    return factory


register("hash-embedder", hash_embedder())
register("echo", lambda: lambda texts: list(texts))
