"""Document-term weights, neighbours and dominant documents within each query's hits.

A query has at most ``first_ret`` hits, so every group below is bounded by that parameter
and by the length of its documents. Rows are therefore placed by query once, and the
windows and groupings on finer keys that follow need no further exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scoring import smoothed_idf
from quern.operators.retrieval import QUERY
from quern.sources.term_index import posting_rows

SIMILARITY_DIGITS = 9


def hit_terms(hits: DataFrame, documents: DataFrame, key: Sequence[str] = QUERY) -> DataFrame:
    """Postings of the hits: (key, doc_id, n_hits, term, tf, dl).

    ``documents`` is the forward index: one row is fetched for each hit, and the postings are not read.
    """
    per_query = Window.partitionBy(*key)
    counted = hits.select(*key, "doc_id", F.count(F.lit(1)).over(per_query).alias("n_hits"))
    fetched = documents.join(counted, "doc_id").select(*key, "doc_id", "n_hits", "dl", "terms")
    return posting_rows(fetched).select(*key, "doc_id", "n_hits", "term", "tf", "dl")


def tfidf_l2(terms: DataFrame, key: Sequence[str] = QUERY) -> DataFrame:
    """Document-term weights fitted on each query's hits, at unit length per document."""
    same_term = Window.partitionBy(*key, "term")
    same_doc = Window.partitionBy(*key, "doc_id")
    raw = F.col("tf") * smoothed_idf(F.col("n_hits"), F.count(F.lit(1)).over(same_term))
    return (
        terms.repartition(*key)
        .withColumn("raw", raw)
        .withColumn("length", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(same_doc)))
        .select(*key, "doc_id", "term", (F.col("raw") / F.col("length")).alias("weight"))
    )


def similar_hits(weights: DataFrame, key: Sequence[str] = QUERY) -> DataFrame:
    """Cosine of hits of one query that share a term: (key, doc_id, nbr_id, similarity), both ways.

    Documents meet only on a common term: each row sees the hits before it in its term's list.
    """
    before = (
        Window.partitionBy(*key, "term")
        .orderBy("doc_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    product = F.col("weight") * F.col("earlier.weight")
    cosine = (
        weights.withColumn("list", F.collect_list(F.struct("doc_id", "weight")).over(before))
        .select(*key, "doc_id", "weight", F.explode("list").alias("earlier"))
        .groupBy(*key, "doc_id", F.col("earlier.doc_id").alias("nbr_id"))
        .agg(F.round(F.sum(product), SIMILARITY_DIGITS).alias("similarity"))
        .where(F.col("similarity") > 0)
    )
    both = F.array(
        F.struct("doc_id", "nbr_id"),
        F.struct(F.col("nbr_id").alias("doc_id"), F.col("doc_id").alias("nbr_id")),
    )
    return cosine.select(*key, F.explode(both).alias("pair"), "similarity").select(
        *key, "pair.doc_id", "pair.nbr_id", "similarity"
    )


def neighbour_lists(
    hits: DataFrame, weights: DataFrame, key: Sequence[str] = QUERY
) -> DataFrame:
    """(key, doc_id, nbr_ids): all hits of the query, nearest first, ties by id.

    A document is its own neighbour at similarity 1. Hits without a common term follow in
    order of id, without ever being paired.
    """
    per_query = Window.partitionBy(*key)
    members = hits.select(
        *key, "doc_id", F.array_sort(F.collect_set("doc_id").over(per_query)).alias("ids")
    )
    near = (
        similar_hits(weights, key)
        .groupBy(*key, "doc_id")
        .agg(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "nbr_id")).alias("near"))
    )
    itself = F.array(F.struct(F.lit(-1.0).alias("d"), F.col("doc_id").alias("nbr_id")))
    found = F.when(F.col("near").isNull(), itself).otherwise(F.concat(itself, F.col("near")))
    return (
        members.join(near, [*key, "doc_id"], "left")
        .select(*key, "doc_id", "ids", F.array_sort(found).getField("nbr_id").alias("near_ids"))
        .select(
            *key,
            "doc_id",
            F.concat("near_ids", F.array_except("ids", "near_ids")).alias("nbr_ids"),
        )
    )


def first_neighbours(
    lists: DataFrame, n_neighbours: int | Column, key: Sequence[str] = QUERY
) -> DataFrame:
    """(key, doc_id, nbr_id, k): the first ``n_neighbours`` of each list, k from 1."""
    size = F.lit(n_neighbours) if isinstance(n_neighbours, int) else n_neighbours
    return lists.select(
        *key, "doc_id", F.posexplode(F.slice("nbr_ids", 1, size)).alias("pos", "nbr_id")
    ).select(*key, "doc_id", "nbr_id", (F.col("pos") + 1).alias("k"))


def nearest_hits(
    hits: DataFrame, weights: DataFrame, n_neighbours: int = 5, key: Sequence[str] = QUERY
) -> DataFrame:
    """k nearest hits of each hit; fewer where the query has fewer hits."""
    return first_neighbours(neighbour_lists(hits, weights, key), n_neighbours, key)


def dominant_hits(
    neighbours: DataFrame, min_doc_c: int | Column = 6, key: Sequence[str] = QUERY
) -> DataFrame:
    """Hits that occur in more than ``min_doc_c`` neighbour lists: (key, cluster_id, occurrences)."""
    return (
        neighbours.groupBy(*key, F.col("nbr_id").alias("cluster_id"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > min_doc_c)
    )
