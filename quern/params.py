"""Typed parameters of the retrieval and expansion operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bm25:
    """Saturation (``k1``) and length normalisation (``b``).

    A string names a column of the clauses instead of a constant, so one scan of the
    postings can score several settings side by side.
    """

    k1: float | str = 1.2
    b: float | str = 0.75

    def columns(self) -> list[str]:
        return [p for p in (self.k1, self.b) if isinstance(p, str)]

    def k1_column(self) -> Column:
        return F.col(self.k1) if isinstance(self.k1, str) else F.lit(float(self.k1))

    def b_column(self) -> Column:
        return F.col(self.b) if isinstance(self.b, str) else F.lit(float(self.b))


@dataclass(frozen=True)
class KnnParams:
    """Expansion from clusters of nearest feedback documents.

    ``lam`` is the weight of the original terms; new terms weigh ``1 - lam``.
    ``df_scope`` counts document frequency over the query's clusters or the collection.
    """

    first_ret: int = 10
    n_neighbours: int = 5
    min_doc_c: int = 6
    top_n: int = 25
    lam: float = 0.7
    df_scope: str = "cluster"

    def __post_init__(self) -> None:
        if self.df_scope not in ("cluster", "collection"):
            raise ValueError(f"df_scope must be 'cluster' or 'collection', not {self.df_scope!r}")


@dataclass(frozen=True)
class W2vParams:
    """Expansion from word vectors of one query's feedback documents.

    ``vector_size`` is the number of components a vector keeps, ``negative`` the shift of the
    association weights, as negative samples would cause it.
    """

    first_ret: int = 10
    vector_size: int = 75
    window: int = 3
    min_count: int = 1
    negative: int = 5
    top_n: int = 7
    lam: float = 0.7
