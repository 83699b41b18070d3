"""Word vectors of one query's feedback documents, nearest terms, and nearest vectors of a table.

A term's vector holds the contexts it occurs with more often than chance: its positive pointwise
mutual information with each context, from counts in a sliding window, smoothed and shifted as in
skip-gram training with negative samples, which factorises the same matrix. Counting it directly
needs no random numbers, learning rate or epochs. A query has at most ``first_ret`` hits, so its rows
are placed together once; the windows and groupings on finer keys that follow need no further exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import Tokenizer, tokenize
from quern.operators.retrieval import QUERY
from quern.params import W2vParams

SIMILARITY_DIGITS = 6
WEIGHT_DIGITS = 6
#: Exponent that lifts rare contexts, as the noise of skip-gram training has it.
SMOOTHING = 0.75

Settings = W2vParams | Mapping[int, W2vParams]


def hit_tokens(
    hits: DataFrame,
    documents: DataFrame,
    key: Sequence[str] = QUERY,
    tokenizer: Tokenizer = tokenize,
) -> DataFrame:
    """Token lists of the hits: (key, rank, tokens). Only texts that were hit are tokenised."""
    return (
        documents.select("doc_id", "text")
        .join(hits.select(*key, "doc_id", "rank"), "doc_id")
        .select(*key, "rank", tokenizer(F.col("text")).alias("tokens"))
    )


def vocabulary(terms: DataFrame, min_count: int = 1, key: Sequence[str] = QUERY) -> DataFrame:
    """Terms of each query's hits that occur at least ``min_count`` times: (key, term, n)."""
    return (
        terms.groupBy(*key, "term")
        .agg(F.sum("tf").alias("n"))
        .where(F.col("n") >= min_count)
    )


def setting(params: Settings, name: str) -> Column:
    """A parameter, or its value for the row's ``config_id`` where settings are numbered."""
    if isinstance(params, W2vParams):
        return F.lit(getattr(params, name))
    return F.create_map(*[F.lit(x) for i, p in params.items() for x in (i, getattr(p, name))])[F.col("config_id")]


def cooccurrences(
    tokens: DataFrame, params: Settings = W2vParams(), key: Sequence[str] = QUERY
) -> DataFrame:
    """(key, term, context, n): how often terms meet in a window, near ones counting more.

    Terms below ``min_count`` are dropped first, so that the window reaches over them. At distance
    g a pair counts ``window + 1 - g`` times, as windows of random width would have it. Every pair
    counts both ways. The key must hold ``config_id`` where ``params`` are numbered.
    """
    widest = max(p.window for p in ([params] if isinstance(params, W2vParams) else params.values()))
    same_term = Window.partitionBy(*key, "term")
    in_order = Window.partitionBy(*key, "rank").orderBy("pos")
    words = (
        tokens.repartition(*key)
        .select(*key, "rank", F.posexplode("tokens").alias("pos", "term"))
        .withColumn("count", F.count(F.lit(1)).over(same_term))
        .where(F.col("count") >= setting(params, "min_count"))
    )
    later = [
        F.struct(F.lead("term", g).over(in_order).alias("context"), (setting(params, "window") + 1 - g).alias("n"))
        for g in range(1, widest + 1)
    ]
    near = (
        words.select(*key, "term", F.array(*later).alias("later"))
        .select(*key, "term", F.explode("later").alias("next"))
        .where(F.col("next.context").isNotNull() & (F.col("next.n") > 0))
    )
    both = F.array(
        F.struct("term", F.col("next.context").alias("context")),
        F.struct(F.col("next.context").alias("term"), F.col("term").alias("context")),
    )
    return (
        near.select(*key, F.explode(both).alias("pair"), F.col("next.n").alias("n"))
        .groupBy(*key, "pair.term", "pair.context")
        .agg(F.sum("n").alias("n"))
    )


def local_vectors(
    tokens: DataFrame, params: Settings = W2vParams(), key: Sequence[str] = QUERY
) -> DataFrame:
    """Vectors of each query's terms, one row per component: (key, term, context, weight).

    weight = ln(n * S / (n_term * n_context ** 0.75)) - ln(negative), positive ones only, S being the
    sum of the smoothed context counts. A vector keeps its ``vector_size`` largest components, the first
    contexts among equals. A term that meets nothing more often than chance has no rows.
    """
    of_term, of_context = Window.partitionBy(*key, "term"), Window.partitionBy(*key, "context")
    strongest = Window.partitionBy(*key, "term").orderBy(F.desc("weight"), "context")
    smooth = F.pow(F.col("context_n"), F.lit(SMOOTHING))
    information = F.log(F.col("n") * F.col("all_smooth") / (F.col("term_n") * smooth))
    shift = F.log(F.greatest(setting(params, "negative"), F.lit(1)))
    return (
        cooccurrences(tokens, params, key)
        .withColumn("term_n", F.sum("n").over(of_term))
        .withColumn("context_n", F.sum("n").over(of_context))
        .withColumn("share", smooth / F.count(F.lit(1)).over(of_context))
        .withColumn("all_smooth", F.sum("share").over(Window.partitionBy(*key)))
        .withColumn("weight", F.round(information - shift, WEIGHT_DIGITS))
        .where(F.col("weight") > 0)
        .withColumn("place", F.row_number().over(strongest))
        .where(F.col("place") <= setting(params, "vector_size"))
        .select(*key, "term", "context", "weight")
    )


def similar_terms(
    vectors: DataFrame, query_terms: DataFrame, top_n: int | Column = 7, key: Sequence[str] = QUERY
) -> DataFrame:
    """Nearest new terms of each query term by cosine: (key, q_term, term, score, rank).

    ``vectors`` comes from ``local_vectors``; terms meet on a common context only. The query's own
    terms are not new.
    """
    own_key = [*key, "term"]
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*own_key)))
    unit = vectors.select(*own_key, "context", (F.col("weight") / length).alias("unit"))
    asked = query_terms.select(*own_key).distinct().withColumn("asked", F.lit(True))
    marked = unit.join(asked, own_key, "left")
    probes = marked.where("asked").select(
        *key, F.col("term").alias("q_term"), "context", F.col("unit").alias("probe")
    )
    order = Window.partitionBy(*key, "q_term").orderBy(F.desc("score"), "term")
    return (
        marked.where("asked is null").join(probes, [*key, "context"])
        .groupBy(*key, "q_term", "term")
        .agg(F.round(F.sum(F.col("unit") * F.col("probe")), SIMILARITY_DIGITS).alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select(*key, "q_term", "term", "score", "rank")
    )


def balanced_terms(
    similar: DataFrame, top_n: int | Column = 7, key: Sequence[str] = QUERY
) -> DataFrame:
    """Round-robin choice over the query's terms: best rank first, then score, then term.

    A term found from several query terms keeps its best rank and best score.
    """
    order = Window.partitionBy(*key).orderBy("near_rank", F.desc("score"), "term")
    return (
        similar.groupBy(*key, "term")
        .agg(F.max("score").alias("score"), F.min("rank").alias("near_rank"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select(*key, "term", "score", "rank")
    )
