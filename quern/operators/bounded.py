"""Ranked retrieval that scores only documents which can still be among the best.

The index knows how much each term can add to a score. A query's threshold is the score that its
``size`` best known documents reach: candidates are the champions of its terms, scored in full from the
forward index. Terms that cannot reach the threshold together are left out at first; documents
without any of the other, essential terms are never looked at, and of the rest only those that could
still pass are completed. The result is that of ``search``.

It pays for queries with rare terms beside common ones, whose long lists are then read for few
documents. Where all terms are equally common, or the clauses many, ``search`` has less to do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scoring import SCORE_DIGITS, bm25_saturation
from quern.operators.retrieval import QUERY, beside_postings, clause_weights, top_hits
from quern.params import Bm25
from quern.sources.term_index import TermIndex, posting_rows
from quern.storage import setting, written

#: Known documents that the threshold is taken from, as a multiple of ``size``.
TRIED = 2
#: Part of the threshold that terms left out at first may make up together. Less of it leaves out fewer
#: terms, but then fewer documents can still pass.
SHARE = 0.5
#: Scores are compared after rounding, so a document may be this much below the threshold.
SLACK = 10.0**-SCORE_DIGITS


def bounded_search(
    index: TermIndex,
    clauses: DataFrame,
    size: int = 10,
    key: Sequence[str] = QUERY,
    bm25: Bm25 = Bm25(),
) -> DataFrame:
    """Best ``size`` documents per key: (key, doc_id, score, rank), as ``search`` returns them.

    The postings are read twice: for the essential terms, and for the others of documents that can pass.
    Both readings stay in the documents' buckets, so the hits are written under the setting that this needs. Clauses may have any boost; one below zero bounds a
    score by nothing.
    """
    plan = written(essential_terms(index, clauses, size, key, bm25), "search-plan")
    with setting(plan.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        found = passing(index, plan, key, bm25)
        return written(top_hits(completed(index, plan, found, key, bm25), size, key), "bounded-hits")


def saturation(index: TermIndex, tf: Column, dl: Column, bm25: Bm25) -> Column:
    return bm25_saturation(tf, dl, F.lit(index.avg_length or 1.0), bm25)


def most_of_term(index: TermIndex, bm25: Bm25) -> Column:
    """Largest saturation that a term's profile allows."""
    return F.array_max(F.transform("profile", lambda p: saturation(index, p["tf"], p["dl"], bm25)))


def thresholds(index: TermIndex, weights: DataFrame, size: int, key: Sequence[str], bm25: Bm25) -> DataFrame:
    """(key, floor): the ``size``-th best full score among the most promising champions; null with fewer."""
    champion = weights.select(*key, *bm25.columns(), "weight", F.explode("champions").alias("c"))
    part = F.col("weight") * saturation(index, F.col("c.tf"), F.col("c.dl"), bm25)
    promising = Window.partitionBy(*key).orderBy(F.desc("partial"), "doc_id")
    tried = (
        champion.groupBy(*key, F.col("c.doc_id").alias("doc_id"))
        .agg(F.sum(part).alias("partial"))
        .withColumn("place", F.row_number().over(promising))
        .where(F.col("place") <= TRIED * size)
        .select(*key, "doc_id")
    )
    rows = posting_rows(index.documents.join(tried, "doc_id"))
    full = F.col("weight") * saturation(index, F.col("tf"), F.col("dl"), bm25)
    scores = (
        rows.join(weights.select(*key, *bm25.columns(), "term", "weight"), [*key, "term"])
        .groupBy(*key, "doc_id")
        .agg(F.sum(full).alias("score"))
    )
    best = F.sort_array(F.collect_list("score"), asc=False)  # at most TRIED * size
    return scores.groupBy(*key).agg(F.get(best, F.lit(size - 1)).alias("floor"))


def essential_terms(index: TermIndex, clauses: DataFrame, size: int, key: Sequence[str], bm25: Bm25) -> DataFrame:
    """(key, term, weight, essential, floor, rest): the weights, and which terms a passing document must hold one of.

    The terms with the smallest bounds are not essential as long as their bounds add up to less than
    ``SHARE`` of ``floor``; ``rest`` is that sum.
    """
    weights = written(clause_weights(index, clauses, key, bm25, ["profile", "champions"]), "weights")
    floor = thresholds(index, weights, size, key, bm25)
    bound = F.greatest("weight", F.lit(0.0)) * most_of_term(index, bm25)
    rising = Window.partitionBy(*key).orderBy("bound", "term")
    known = weights.join(floor, [*key], "left").withColumn("floor", F.coalesce(F.col("floor") - SLACK, F.lit(float("-inf"))))
    together = known.select(*key, *bm25.columns(), "term", "weight", "floor", bound.alias("bound")).withColumn(
        "together", F.sum("bound").over(rising)
    )
    left_out = F.when(F.col("together") < SHARE * F.col("floor"), F.col("together"))
    return together.select(
        *key, *bm25.columns(), "term", "weight", "floor", left_out.isNull().alias("essential"),
        F.coalesce(F.max(left_out).over(Window.partitionBy(*key)), F.lit(0.0)).alias("rest"),
    )


def _parts(index: TermIndex, plan: DataFrame, key: Sequence[str], bm25: Bm25) -> DataFrame:
    """What each clause of ``plan`` adds to the score of each document with its term."""
    part = F.col("weight") * saturation(index, F.col("tf"), F.col("dl"), bm25)
    others = [c for c in ("floor", "rest") if c in plan.columns]
    return index.postings.join(beside_postings(plan), "term").select(*key, "doc_id", *others, part.alias("part"))


def passing(index: TermIndex, plan: DataFrame, key: Sequence[str] = QUERY, bm25: Bm25 = Bm25()) -> DataFrame:
    """(key, doc_id, partial, floor): documents with an essential term whose score can reach the threshold."""
    essential = plan.where("essential").drop("essential")
    return (
        _parts(index, essential, key, bm25)
        .groupBy(*key, "doc_id")
        .agg(F.sum("part").alias("partial"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
        .where(F.col("partial") + F.col("rest") >= F.col("floor"))
        .drop("rest")
    )


def completed(
    index: TermIndex, plan: DataFrame, found: DataFrame, key: Sequence[str] = QUERY, bm25: Bm25 = Bm25()
) -> DataFrame:
    """(key, doc_id, score) of the documents of ``found``, with what their other terms add, if it reaches the threshold."""
    others = _parts(index, plan.where("not essential").drop("essential", "floor", "rest"), key, bm25)
    both = found.hint("shuffle_hash").join(others, [*key, "doc_id"], "left")
    total = F.first("partial") + F.coalesce(F.sum("part"), F.lit(0.0))
    return (
        both.groupBy(*key, "doc_id")
        .agg(total.alias("total"), F.first("floor").alias("floor"))
        .where(F.col("total") >= F.col("floor"))
        .select(*key, "doc_id", F.round("total", SCORE_DIGITS).alias("score"))
    )
