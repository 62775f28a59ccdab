"""Models plug in here: an embedder turns texts into vectors, a reranker scores (query, text).

The hashing embedder and the overlap reranker need no weights and are the same on every machine.
``SentenceEmbedder`` and ``CrossReranker`` are adapters of models with weights; their library is
imported, and the model loaded, once per Python worker on first use. A maker of models is known by
its ``name`` and arguments, so two makers never share a model.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafsift.config import EMBEDDING_MODEL, EMBEDDING_TOKENS, RERANKING_MODEL, RERANKING_TOKENS


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class HashingEmbedder:
    """Signed hashed words, scaled to unit length; a text without words is a vector of zeros."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()
                out[i, int(h[:8], 16) % self.size] += 1.0 if h[8] >= "8" else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


class OverlapReranker:
    """Share of the query's words found in the text."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            ws = set(re.findall(r"\w+", (q or "").lower()))
            out.append(len(ws & set(re.findall(r"\w+", (t or "").lower()))) / len(ws) if ws else 0.0)
        return out


class SentenceEmbedder:
    """A sentence-transformers model. ``model`` is a name or a folder of weights."""

    def __init__(self, model: str | None = None, tokens: int = EMBEDDING_TOKENS):
        from sentence_transformers import SentenceTransformer

        self.model = SentenceTransformer(model or os.getenv("EMBEDDING_MODEL", EMBEDDING_MODEL))
        self.model.max_seq_length = tokens

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.model.encode(list(texts)), dtype=np.float64)


class CrossReranker:
    """A sentence-transformers cross-encoder. ``model`` is a name or a folder of weights."""

    def __init__(self, model: str | None = None, tokens: int = RERANKING_TOKENS):
        from sentence_transformers import CrossEncoder

        self.model = CrossEncoder(model or os.getenv("RERANKER_MODEL", RERANKING_MODEL), max_length=tokens)

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [float(s) for s in self.model.predict(list(pairs))]


class Maker:
    """Makes a model in a worker: ``Maker("bge", SentenceEmbedder, "folder")``."""

    def __init__(self, name: str, make: Callable, *args, **settings):
        self.name, self.make, self.args, self.settings = name, make, args, settings

    def __call__(self) -> object:
        return self.make(*self.args, **self.settings)


_loaded: dict[object, object] = {}


def _once(make: Callable[[], object]) -> object:
    """The model of a maker or a class, loaded on first use; of other callables a new one, as nothing names them safely."""
    if isinstance(make, Maker):
        key = (make.name, repr(make.args), repr(sorted(make.settings.items())))
    elif isinstance(make, type):
        key = f"{make.__module__}.{make.__qualname__}"
    else:
        return make()
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def embed(text: Column, make: Callable[[], Embedder] = HashingEmbedder) -> Column:
    """Vectors of a text column, batch by batch. Marked as not repeatable so that no rule runs it twice."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _once(make)
        for s in batches:
            yield pd.Series(list(model.encode(s.fillna("").tolist())))

    return run.asNondeterministic()(text)


def rerank_scores(query: Column, text: Column, make: Callable[[], Reranker] = OverlapReranker) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _once(make)
        for q, t in batches:
            yield pd.Series(model.predict(list(zip(q.fillna(""), t.fillna("")))), dtype=float)

    return run.asNondeterministic()(query, text)


_BEST = "struct<texto:string,score:double>"


def nearest_sentence(sentences: Column, vector: list[float], make: Callable[[], Embedder] = HashingEmbedder) -> Column:
    """(texto, score) of the first sentence most similar to a query's vector by cosine; null where there is none."""
    want = np.asarray(vector, dtype=np.float64)

    def score(model, flat: list[str]) -> np.ndarray:
        m = np.asarray(model.encode(flat), dtype=np.float64)
        norm = np.linalg.norm(m, axis=1) * np.linalg.norm(want)
        return np.divide(m @ want, norm, out=np.zeros(len(flat)), where=norm > 0)

    return _best_by(sentences, score, make)


def best_sentence_reranked(sentences: Column, query: str, make: Callable[[], Reranker] = OverlapReranker) -> Column:
    """(texto, score) of the first sentence a reranker scores highest for the query as written."""
    return _best_by(sentences, lambda model, flat: np.asarray(model.predict([(query, s) for s in flat]), dtype=np.float64), make)


def _best_by(sentences: Column, score: Callable, make: Callable) -> Column:
    @F.pandas_udf(_BEST)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _once(make)
        for lists in batches:
            lists = [[] if x is None else list(x) for x in lists]
            flat = [s for x in lists for s in x]
            got = np.round(score(model, flat), 9) if flat else np.empty(0)
            rows, at = [], 0
            for x in lists:
                k = at + int(np.argmax(got[at : at + len(x)])) if x else None
                rows.append((None, None) if k is None else (flat[k], float(got[k])))
                at += len(x)
            yield pd.DataFrame(rows, columns=["texto", "score"])

    got = run.asNondeterministic()(sentences)
    return F.when(F.size(sentences) > 0, got)
