"""Retrieval experiments as Spark jobs: search, query expansion, evaluation and comparison."""

from quern.params import Bm25, KnnParams, W2vParams

__all__ = ["Bm25", "KnnParams", "W2vParams"]
