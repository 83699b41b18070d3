"""Clusters of neighbours around dominant documents, and their expansion terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scoring import (
    SCORE_DIGITS,
    bm25_idf,
    bm25_saturation,
    collection_weight,
)
from quern.operators.retrieval import QUERY
from quern.params import Bm25
from quern.sources.term_index import TermIndex


def cluster_members(
    dominant: DataFrame, neighbours: DataFrame, key: Sequence[str] = QUERY
) -> DataFrame:
    """(key, cluster_id, doc_id, k): the neighbours of each dominant document, in order."""
    lists = neighbours.select(*key, F.col("doc_id").alias("cluster_id"), "nbr_id", "k")
    return lists.join(dominant.select(*key, "cluster_id"), [*key, "cluster_id"]).select(
        *key, "cluster_id", F.col("nbr_id").alias("doc_id"), "k"
    )


def cluster_texts(
    members: DataFrame, documents: DataFrame, key: Sequence[str] = QUERY
) -> DataFrame:
    """(key, cluster_id, text): texts of a cluster's documents in neighbour order, joined by a blank."""
    ordered = F.array_sort(F.collect_list(F.struct("k", "text")))
    return (
        documents.select("doc_id", "text")
        .join(members, "doc_id")
        .groupBy(*key, "cluster_id")
        .agg(F.array_join(ordered.getField("text"), " ").alias("text"))
    )


def cluster_terms(
    members: DataFrame, hit_terms: DataFrame, key: Sequence[str] = QUERY
) -> DataFrame:
    """Terms of all clusters: (key, cluster_id, term, tf, cluster_df).

    Counts of the concatenated text come from the postings of its documents; ``cluster_df`` is
    the number of the query's clusters that hold the term. A query's clusters are bounded by
    its hits, so its rows are placed together once for both.
    """
    same_term = Window.partitionBy(*key, "term")
    return (
        hit_terms.select(*key, "doc_id", "term", "tf")
        .join(members.select(*key, "cluster_id", "doc_id"), [*key, "doc_id"])
        .repartition(*key)
        .groupBy(*key, "cluster_id", "term")
        .agg(F.sum("tf").alias("tf"))
        .withColumn("cluster_df", F.count(F.lit(1)).over(same_term))
    )


def cluster_lengths(
    members: DataFrame, hit_terms: DataFrame, key: Sequence[str] = QUERY
) -> DataFrame:
    """(key, cluster_id, dl, n_clusters, avg_length): tokens of each cluster, and the query's mean."""
    per_query = Window.partitionBy(*key)
    doc_lengths = hit_terms.groupBy(*key, "doc_id").agg(F.max("dl").alias("doc_dl"))
    return (
        members.join(doc_lengths, [*key, "doc_id"])
        .groupBy(*key, "cluster_id")
        .agg(F.sum("doc_dl").alias("dl"))
        .withColumn("n_clusters", F.count(F.lit(1)).over(per_query))
        .withColumn("avg_length", F.avg("dl").over(per_query))
    )


def best_clusters(
    clauses: DataFrame,
    members: DataFrame,
    hit_terms: DataFrame,
    key: Sequence[str] = QUERY,
    bm25: Bm25 = Bm25(),
) -> DataFrame:
    """The query's best cluster by BM25 over its own clusters: (key, cluster_id, score).

    Only postings of the query's own terms are put into clusters.
    """
    matched = hit_terms.join(clauses.select(*key, "term", "boost"), [*key, "term"])
    part = (
        F.col("boost")
        * bm25_idf(F.col("n_clusters"), F.col("cluster_df"))
        * bm25_saturation(F.col("tf"), F.col("dl"), F.col("avg_length"), bm25)
    )
    first = Window.partitionBy(*key).orderBy(F.desc("score"), "cluster_id")
    boosts = clauses.select(*key, "term", "boost")
    return (
        cluster_terms(members, matched, key)
        .join(boosts, [*key, "term"])
        .join(cluster_lengths(members, hit_terms, key), [*key, "cluster_id"])
        .groupBy(*key, "cluster_id")
        .agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") == 1)
        .select(*key, "cluster_id", "score")
    )


def clusters_of_hits(
    members: DataFrame, best: DataFrame, key: Sequence[str] = QUERY
) -> DataFrame:
    """(key, doc_id, cluster_ids, best_id): the clusters a hit is in; best_id where one is the best."""
    best_id = best.select(*key, F.col("cluster_id").alias("best_id"))
    is_best = F.when(F.col("cluster_id") == F.col("best_id"), F.col("best_id"))
    return (
        members.join(best_id, [*key])
        .groupBy(*key, "doc_id")
        .agg(F.collect_list("cluster_id").alias("cluster_ids"), F.max(is_best).alias("best_id"))
    )


def best_cluster_terms(
    placed: DataFrame, hit_terms: DataFrame, key: Sequence[str] = QUERY
) -> DataFrame:
    """Terms of the best cluster only, as ``cluster_terms`` has them.

    ``placed`` comes from ``clusters_of_hits``. Each posting of a hit is read once, however many
    clusters its document is in; one grouping counts both the best cluster and all clusters.
    """
    in_best = F.col("best_id").isNotNull()
    holders = F.array_distinct(F.flatten(F.collect_list("cluster_ids")))
    return (
        hit_terms.select(*key, "doc_id", "term", "tf")
        .join(placed, [*key, "doc_id"])
        .groupBy(*key, "term")
        .agg(
            F.max("best_id").alias("cluster_id"),
            F.sum(F.when(in_best, F.col("tf"))).alias("tf"),
            F.size(holders).cast("long").alias("cluster_df"),
        )
        .where(F.col("tf").isNotNull())
        .select(*key, "cluster_id", "term", "tf", "cluster_df")
    )


def term_scores(
    terms: DataFrame, index: TermIndex, df_scope: str = "cluster", key: Sequence[str] = QUERY
) -> DataFrame:
    """tf * log10(N / df) of cluster terms: (key, cluster_id, term, tf, df, score).

    N is the size of the collection; df counts the query's clusters or the collection.
    """
    if df_scope == "collection":
        scoped = terms.join(index.statistics.select("term", "df"), "term")
    else:
        scoped = terms.withColumn("df", F.col("cluster_df"))
    score = collection_weight(F.col("tf"), F.lit(index.n_docs), F.col("df"))
    return scoped.select(*key, "cluster_id", "term", "tf", "df", score.alias("score"))


def top_terms(
    scores: DataFrame, top_n: int | Column = 25, key: Sequence[str] = QUERY
) -> DataFrame:
    """First ``top_n`` terms per key by score, then term."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "term")
    return (
        scores.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select(*key, "term", "score", "rank")
    )


def new_terms(
    candidates: DataFrame, query_terms: DataFrame, key: Sequence[str] = QUERY
) -> DataFrame:
    """Candidate terms without duplicates (best score kept) and without the query's own terms."""
    return (
        candidates.groupBy(*key, "term")
        .agg(F.max("score").alias("score"))
        .join(query_terms, [*key, "term"], "left_anti")
    )
