"""Ranked retrieval for a whole table of queries at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scoring import SCORE_DIGITS, bm25_idf, bm25_saturation
from quern.functions.text import Tokenizer, tokenize
from quern.params import Bm25
from quern.sources.term_index import TermIndex
from quern.storage import written

QUERY = ("query_id",)
#: Clauses up to this number, some 100 bytes each, are sent to every executor.
BROADCAST_CLAUSES = 200_000


def query_terms(
    queries: DataFrame, key: Sequence[str] = QUERY, tokenizer: Tokenizer = tokenize
) -> DataFrame:
    """(key, term, boost): each occurrence of a term in the query text counts once."""
    return (
        queries.select(*key, F.explode_outer(tokenizer(F.col("text"))).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy(*key, "term")
        .agg(F.count(F.lit(1)).cast("double").alias("boost"))
    )


def weighted_clauses(
    original: DataFrame, expanded: DataFrame, lam: float, key: Sequence[str] = QUERY
) -> DataFrame:
    """Original clauses at ``lam`` and new clauses at ``1 - lam`` times their own boost.

    Duplicates stay: a term on both sides has both boosts.
    """
    return original.select(*key, "term", (F.col("boost") * lam).alias("boost")).unionByName(
        expanded.select(*key, "term", (F.col("boost") * (1 - lam)).alias("boost"))
    )


def clause_weights(
    index: TermIndex, clauses: DataFrame, key: Sequence[str], bm25: Bm25, also: Sequence[str] = ()
) -> DataFrame:
    """(key, settings, term, weight) of all clauses whose term is known, weight being boost times idf."""
    extra = bm25.columns()
    weight = F.col("boost") * bm25_idf(F.lit(index.n_docs), F.col("df"))
    known = index.statistics.select("term", "df")
    return (
        clauses.groupBy(*key, *extra, "term")
        .agg(F.sum("boost").alias("boost"))
        .join(known.join(index.terms.select("term", *also), "term") if also else known, "term")
        .select(*key, *extra, "term", weight.alias("weight"), *also)
    )


def beside_postings(weights: DataFrame) -> DataFrame:
    """Written ``weights``, marked to be broadcast up to ``BROADCAST_CLAUSES`` rows, so that postings stay in their buckets.

    A join by shuffle on the term would exchange a row for each query and document with a common term. Where
    ``spark.sql.autoBroadcastJoinThreshold`` forbids broadcasts, or with more rows, it is left to Spark.
    """
    threshold = weights.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    allowed = not threshold.startswith("-") and weights.count() <= BROADCAST_CLAUSES
    return F.broadcast(weights) if allowed else weights


def search(
    index: TermIndex,
    clauses: DataFrame,
    size: int = 10,
    key: Sequence[str] = QUERY,
    bm25: Bm25 = Bm25(),
) -> DataFrame:
    """Best ``size`` documents per key: (key, doc_id, score, rank).

    A document matches when it holds any clause's term, and scores the sum of boost times
    BM25. Clauses with their idf are written first; up to ``BROADCAST_CLAUSES`` of them, the
    postings are scanned in place, added up per document shard and cut to ``size`` before
    the only exchange. A larger set of clauses is joined by shuffle on the term.
    """
    weights = beside_postings(written(clause_weights(index, clauses, key, bm25), "weights"))
    saturation = bm25_saturation(F.col("tf"), F.col("dl"), F.lit(index.avg_length), bm25)
    scores = (
        index.postings.join(weights, "term")
        .groupBy(*key, "doc_id")
        .agg(F.round(F.sum(F.col("weight") * saturation), SCORE_DIGITS).alias("score"))
    )
    return top_hits(scores, size, key)


def search_settings(
    index: TermIndex,
    clauses: DataFrame,
    settings: Mapping[str, Bm25],
    size: int = 10,
    key: Sequence[str] = QUERY,
    label: str = "method",
) -> DataFrame:
    """Runs of the same clauses under several constant settings: (label, key, doc_id, score, rank).

    As ``search`` with the setting in the key, but a posting meets a clause once, whatever the number of settings:
    each has its own sum in one row per key and document.
    """
    weights = beside_postings(written(clause_weights(index, clauses, key, Bm25()), "weights"))

    def score(bm25: Bm25) -> Column:
        saturation = bm25_saturation(F.col("tf"), F.col("dl"), F.lit(index.avg_length), bm25)
        return F.round(F.sum(F.col("weight") * saturation), SCORE_DIGITS)

    sums = index.postings.join(weights, "term").groupBy(*key, "doc_id").agg(
        *[score(bm25).alias(f"score_{i}") for i, bm25 in enumerate(settings.values())]
    )
    each = F.array(*[F.struct(F.lit(m).alias(label), F.col(f"score_{i}").alias("score")) for i, m in enumerate(settings)])
    scores = sums.select(*key, "doc_id", F.inline(each))
    return top_hits(scores, size, [*key, label]).select(label, *key, "doc_id", "score", "rank")


def top_hits(scores: DataFrame, size: int, key: Sequence[str] = QUERY) -> DataFrame:
    """Rank by score, then document id, and keep the first ``size``."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "doc_id")
    return (
        scores.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= size)
        .select(*key, "doc_id", "score", "rank")
    )


def bm25_search(
    index: TermIndex, queries: DataFrame, size: int = 10, tokenizer: Tokenizer = tokenize
) -> DataFrame:
    """Plain BM25 retrieval of ``queries`` (query_id, text)."""
    return search(index, query_terms(queries, tokenizer=tokenizer), size)


def run_rows(run: DataFrame, tag: str) -> DataFrame:
    """A run in the layout evaluation tools read: query, iteration, document, rank, score, tag."""
    return run.select(
        "query_id", F.lit("Q0").alias("iteration"), "doc_id", "rank", "score", F.lit(tag).alias("tag")
    )
