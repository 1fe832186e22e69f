"""Settings and model registries as frozen values; the tables are small enough to be joined by broadcast."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import chunking, vectors
from .settings import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]


@dataclass(frozen=True)
class Embedding:
    dimension: int
    backend: str
    passage_prefix: str = ""
    query_prefix: str = ""


#: Known embedding models (fixed values).
EMBEDDINGS = {
    "BAAI/bge-m3": Embedding(1024, "local"),
    "nomic-ai/nomic-embed-text-v1.5": Embedding(768, "local", "search_document: ", "search_query: "),
    "intfloat/multilingual-e5-large": Embedding(1024, "local", "passage: ", "query: "),
    "google/gemini-embedding-001": Embedding(3072, "api"),
    "baai/bge-m3": Embedding(1024, "api"),
}
#: Known language models: served id, backend, label, billions of parameters (fixed values).
LANGUAGE_MODELS = {
    "gemma-4-e2b": ("gemma4:e2b", "ollama", "Gemma 4 e2B", 2.0),
    "gemma-4-e4b": ("gemma4:e4b", "ollama", "Gemma 4 e4B", 4.0),
    "gemma-4-31b": ("google/gemma-4-31b-it", "openrouter", "Gemma 4 31B", 31.0),
    "gemini-flash-lite": ("google/gemini-3.1-flash-lite-preview", "openrouter", "Gemini 3.1 Flash Lite", 0.0),
}

Embedder = Callable[[DataFrame, str, str, int], DataFrame]
#: Backends that can run here: (rows, key, text, dimension) -> (key, embedding). Others are registered by their user.
EMBEDDERS: dict[str, Embedder] = {"hashing": vectors.embedded}


def embedder(backend: str) -> Embedder:
    if backend not in EMBEDDERS:
        raise ValueError(f"no embedder for backend {backend}; known: {sorted(EMBEDDERS)}")
    return EMBEDDERS[backend]


def chunker(name: str) -> Callable[[str, int, int], list[str]]:
    """section_aware or recursive."""
    if name not in chunking.STRATEGIES:
        raise ValueError(f"unknown chunker {name}; known: {sorted(chunking.STRATEGIES)}")
    return chunking.STRATEGIES[name]


def embedding_table(spark: SparkSession) -> DataFrame:
    """(model, dimension, backend, passage_prefix, query_prefix)."""
    return spark.createDataFrame([(k, e.dimension, e.backend, e.passage_prefix, e.query_prefix) for k, e in EMBEDDINGS.items()], "model string, dimension int, backend string, passage_prefix string, query_prefix string")
