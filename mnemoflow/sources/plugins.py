"""What can be plugged in: retrievers, stage models, vectors. The defaults are deterministic and offline."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, lexical_index, retrieval
from .cut import cut


class Retriever(Protocol):
    def retrieve(self, queries: DataFrame, corpus: DataFrame) -> DataFrame:
        """(query_id, event_id, score, rank)."""


class StageModel(Protocol):
    def complete(self, prompts: DataFrame) -> DataFrame:
        """(key, response) of (key, prompt)."""


class Lexical:
    def __init__(self, k: int = 20) -> None:
        self.k = k

    def retrieve(self, queries: DataFrame, corpus: DataFrame) -> DataFrame:
        return retrieval.bm25(corpus, queries, self.k)


class StoredLexical:
    """Hits of a stored index, which has been built of the corpus; the corpus given is not read."""

    def __init__(self, index: lexical_index.LexicalIndex, k: int = 20) -> None:
        self.index, self.k = index, k

    def retrieve(self, queries: DataFrame, corpus: DataFrame) -> DataFrame:
        return lexical_index.search(self.index, queries, self.k, cut)


class Vector:
    def __init__(self, vectors: DataFrame, query_vectors: DataFrame, k: int = 20) -> None:
        self.vectors, self.query_vectors, self.k = vectors, query_vectors, k

    def retrieve(self, queries: DataFrame, corpus: DataFrame) -> DataFrame:
        return retrieval.knn(self.vectors, self.query_vectors.join(queries.select("query_id"), "query_id"), self.k)


class Hybrid:
    """Both, fused."""

    def __init__(self, lexical: Lexical, vector: Vector, k: int = 10) -> None:
        self.lexical, self.vector, self.k = lexical, vector, k

    def retrieve(self, queries: DataFrame, corpus: DataFrame) -> DataFrame:
        return retrieval.fuse(self.lexical.retrieve(queries, corpus), self.vector.retrieve(queries, corpus), self.k).withColumnRenamed("rrf_score", "score")


class EntityGraph:
    """Walks with restarts from a question's entities over the graph of events and entities."""

    def __init__(self, k: int = 10, damping: float = graph.DAMPING, eps: float = graph.EPS) -> None:
        self.k, self.damping, self.eps = k, damping, eps

    def retrieve(self, queries: DataFrame, corpus: DataFrame) -> DataFrame:
        return graph.ppr(corpus, queries, self.k, self.damping, self.eps)


class DualLevelGraph:
    """A question's entities and the relations between them, in turns."""

    def __init__(self, k: int = 10, mode: str = "hybrid") -> None:
        self.k, self.mode = k, mode

    def retrieve(self, queries: DataFrame, corpus: DataFrame) -> DataFrame:
        return graph.dual_level(corpus, queries, self.k, self.mode).withColumn("score", 1.0 / F.col("rank"))
