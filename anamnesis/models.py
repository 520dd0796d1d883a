"""Pluggable models: what they must offer, deterministic stand-ins, and how they run.

A model is given as a loader that each executor calls once; rows reach it in
Arrow batches. On the driver a fault of a model never fails a retrieval.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    model: str
    version: str
    dimensions: int

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def complete(self, prompt: str) -> str: ...


class Extractor(Protocol):
    def extract(self, texts: Sequence[str]) -> list[list[tuple[str, str]]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: Sequence[str]) -> list[float]: ...


class Silent:
    """The generator without a model: it says nothing."""

    def complete(self, prompt: str) -> str:
        return ""


def skip_retrieval(query: str, generator: Generator | None) -> bool:
    """Whether the generator's verdict begins with SKIP; without one, never."""
    if generator is None:
        return False
    try:
        return generator.complete(query).strip().upper().startswith("SKIP")
    except Exception:
        return False


def hypothetical(query: str, generator: Generator | None) -> str:
    """The text to embed for a query: a made-up answer, or the query itself."""
    try:
        return (generator.complete(query).strip() if generator else "") or query
    except Exception:
        return query


def decompose(query: str, generator: Generator | None, most: int = 4) -> list[str]:
    """The query and the sub-queries that the generator names, a line each; on a
    fault or without one, the query alone."""
    try:
        said = generator.complete(f"Split into sub-questions, one a line: {query}") if generator else ""
    except Exception:
        said = ""
    lines = [x.strip().lstrip("-*0123456789.) ").strip() for x in said.splitlines()]
    return list(dict.fromkeys([query, *[x for x in lines if x]]))[: most + 1]


def model_vectors(rows: DataFrame, load: Callable[[], Embedder], key: str = "key", text: str = "text") -> DataFrame:
    """(key, embedding); the model is loaded once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "embedding": model.embed_batch(pdf[text].fillna("").tolist())})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<double>")


def embed_or_nothing(text: str, embedder: Embedder) -> list[float]:
    """The vector, or none on a fault, so that only the word arm runs."""
    try:
        return embedder.embed_batch([text])[0]
    except Exception:
        return []


def model_scores(rows: DataFrame, load: Callable[[], Reranker], query: str = "query_text", text: str = "text") -> DataFrame:
    """Rows with ``model_score``; the model is loaded once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            parts = [pd.Series(model.score(q, part[text].tolist()), index=part.index, dtype=float) for q, part in pdf.groupby(query)]
            yield pdf.assign(model_score=pd.concat(parts) if parts else pd.Series(dtype=float))

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", model_score double")


def model_entities(rows: DataFrame, load: Callable[[], Extractor], key: str = "key", text: str = "text") -> DataFrame:
    """(key, name, label) of every entity that a model finds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            found = model.extract(pdf[text].fillna("").tolist())
            yield pd.DataFrame([(k, n, label) for k, e in zip(pdf[key], found, strict=True) for n, label in e], columns=[key, "name", "label"])

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, name string, label string")


def layered(cheap: Column, costly: Column, least: int) -> Column:
    """The cheap extractor's names, or the costly one's where they are too few."""
    return F.when(F.size(cheap) < least, costly).otherwise(cheap)
