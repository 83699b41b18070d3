"""Retrieval with query expansion from pseudo-relevant documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import Tokenizer, tokenize
from quern.operators.clusters import (
    best_cluster_terms,
    best_clusters,
    cluster_members,
    clusters_of_hits,
    term_scores,
    top_terms,
)
from quern.operators.embeddings import balanced_terms, hit_tokens, local_vectors, similar_terms
from quern.operators.feedback import dominant_hits, nearest_hits, tfidf_l2
from quern.operators.lattice import grid_expansion
from quern.operators.retrieval import QUERY, query_terms, search, weighted_clauses
from quern.params import KnnParams, W2vParams
from quern.sources.term_index import TermIndex
from quern.storage import written


def feedback(index: TermIndex, clauses: DataFrame, first_ret: int) -> DataFrame:
    """First retrieval, written: the pseudo-relevant documents of every query."""
    return written(search(index, clauses, first_ret), "hits")


def knn_members(
    hits: DataFrame, terms: DataFrame, params: KnnParams, key: Sequence[str] = QUERY
) -> DataFrame:
    """Documents of the clusters around dominant hits, written."""
    weights = tfidf_l2(terms, key)
    neighbours = written(nearest_hits(hits, weights, params.n_neighbours, key), "neighbours")
    dominant = dominant_hits(neighbours, params.min_doc_c, key)
    return written(cluster_members(dominant, neighbours, key), "members")


def knn_expansion(
    clauses: DataFrame,
    members: DataFrame,
    terms: DataFrame,
    index: TermIndex,
    top_n: int | Column = 25,
    df_scope: str = "cluster",
    key: Sequence[str] = QUERY,
) -> DataFrame:
    """Top terms of each query's best cluster: (key, term, score, rank).

    ``terms`` are the postings of the hits (see ``hit_terms``).
    """
    best = best_clusters(clauses, members, terms, key)
    placed = written(clusters_of_hits(members, best, key), "placed")
    scored = term_scores(best_cluster_terms(placed, terms, key), index, df_scope, key)
    return top_terms(scored, top_n, key)


def clauses_or_fallback(
    original: DataFrame, new: DataFrame, lam: float, key: Sequence[str] = QUERY
) -> DataFrame:
    """Weighted clauses of expanded queries, and the plain clauses of queries without expansion.

    Both kinds then go through one search, so the postings are scanned once.
    """
    expanded = new.select(*key).distinct()
    plain = original.join(expanded, [*key], "left_anti").select(*key, "term", "boost")
    rest = original.join(expanded, [*key], "left_semi")
    boosts = new.select(*key, "term", F.lit(1.0).alias("boost"))
    return weighted_clauses(rest, boosts, lam, key).unionByName(plain)


def knn_search(
    index: TermIndex,
    queries: DataFrame,
    params: KnnParams = KnnParams(),
    size: int = 10,
    tokenizer: Tokenizer = tokenize,
) -> DataFrame:
    """Expansion by nearest-neighbour clusters; queries without a dominant hit run unexpanded."""
    clauses = written(query_terms(queries, tokenizer=tokenizer), "clauses")
    hits = feedback(index, clauses, params.first_ret)
    new = grid_expansion(index, clauses, hits, [params]).drop("config_id")
    return search(index, clauses_or_fallback(clauses, new, params.lam), size)


def w2v_expansion(
    hits: DataFrame,
    documents: DataFrame,
    clauses: DataFrame,
    params: W2vParams,
    key: Sequence[str] = QUERY,
    tokenizer: Tokenizer = tokenize,
    choose: Callable[[DataFrame, int, Sequence[str]], DataFrame] = balanced_terms,
) -> DataFrame:
    """Terms nearest to the query's terms by its own vectors: (key, term, score, rank).

    ``choose`` picks ``top_n`` of them from (key, q_term, term, score, rank).
    """
    vectors = written(local_vectors(hit_tokens(hits, documents, key, tokenizer), params, key), "vectors")
    return choose(similar_terms(vectors, clauses, params.top_n, key), params.top_n, key)


def w2v_search(
    index: TermIndex,
    documents: DataFrame,
    queries: DataFrame,
    params: W2vParams = W2vParams(),
    size: int = 10,
    tokenizer: Tokenizer = tokenize,
) -> DataFrame:
    """Expansion by word vectors; new terms weigh (1 - lambda) times their similarity."""
    clauses = written(query_terms(queries, tokenizer=tokenizer), "clauses")
    hits = feedback(index, clauses, params.first_ret)
    new = written(w2v_expansion(hits, documents, clauses, params, tokenizer=tokenizer), "expansion")
    boosts = new.select("query_id", "term", F.col("score").alias("boost"))
    return search(index, weighted_clauses(clauses, boosts, params.lam), size)
