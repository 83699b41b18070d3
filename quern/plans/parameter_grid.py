"""Evaluation of a grid of expansion settings on training queries, best setting per metric."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scoring import to_digits
from quern.functions.text import Tokenizer, tokenize
from quern.operators.embeddings import balanced_terms, hit_tokens, local_vectors, similar_terms
from quern.operators.evaluation import METRIC_DIGITS, long_metrics, query_metrics
from quern.operators.lattice import grid_expansion, setting_value
from quern.operators.retrieval import query_terms, search
from quern.params import KnnParams, W2vParams
from quern.plans.expanded_search import feedback
from quern.sources.term_index import TermIndex
from quern.storage import written

Params = KnnParams | W2vParams
CONFIG = ["config_id", "query_id"]


def knn_grid_runs(
    index: TermIndex,
    queries: DataFrame,
    grid: Sequence[KnnParams],
    size: int = 10,
    tokenizer: Tokenizer = tokenize,
) -> DataFrame:
    """Runs of all settings: (config_id, query_id, doc_id, score, rank), config_id from 1.

    The postings are read for one first retrieval, as deep as any setting needs, and for one last search
    of all expanded queries. Queries without an expansion under a setting run unexpanded there.
    """
    clauses = written(query_terms(queries, tokenizer=tokenizer), "clauses")
    hits = feedback(index, clauses, max(p.first_ret for p in grid))
    new = grid_expansion(index, clauses, hits, grid)
    config_clauses = clauses.withColumn(
        "config_id", F.explode(F.array(*[F.lit(i) for i in range(1, len(grid) + 1)]))
    )
    expanded = new.select(*CONFIG).distinct().withColumn("expanded", F.lit(True))
    lam = setting_value(grid, "lam")
    boost = F.when(F.col("expanded"), F.col("boost") * lam).otherwise(F.col("boost"))
    original = config_clauses.join(expanded, CONFIG, "left").withColumn("boost", boost)
    added = new.select(*CONFIG, "term", (1 - lam).alias("boost"))
    clauses = original.select(*CONFIG, "term", "boost").unionByName(added)
    return search(index, clauses, size, CONFIG)


def w2v_grid_runs(
    index: TermIndex,
    documents: DataFrame,
    queries: DataFrame,
    grid: Sequence[W2vParams],
    size: int = 10,
    tokenizer: Tokenizer = tokenize,
) -> DataFrame:
    """Runs of all word-vector settings, as ``knn_grid_runs`` has them.

    One pass takes the vectors of every query under all settings.
    """
    clauses = written(query_terms(queries, tokenizer=tokenizer), "clauses")
    ids = F.array(*[F.lit(i) for i in range(1, len(grid) + 1)])
    hits = (
        feedback(index, clauses, max(p.first_ret for p in grid))
        .withColumn("config_id", F.explode(ids))
        .where(F.col("rank") <= setting_value(grid, "first_ret"))
    )
    config_clauses = clauses.withColumn("config_id", F.explode(ids))
    tokens = hit_tokens(hits, documents, CONFIG, tokenizer)
    vectors = written(local_vectors(tokens, dict(enumerate(grid, start=1)), CONFIG), "vectors")
    top_n = setting_value(grid, "top_n")
    similar = similar_terms(vectors, config_clauses, top_n, CONFIG)
    new = written(balanced_terms(similar, top_n, CONFIG), "expansion")
    lam = setting_value(grid, "lam")
    original = config_clauses.select(*CONFIG, "term", (F.col("boost") * lam).alias("boost"))
    added = new.select(*CONFIG, "term", (F.col("score") * (1 - lam)).alias("boost"))
    return search(index, original.unionByName(added), size, CONFIG)


def grid_means(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Mean of each metric per setting: (config_id, metric, mean)."""
    values = long_metrics(query_metrics(runs, qrels, CONFIG), CONFIG)
    return values.groupBy("config_id", "metric").agg(
        to_digits(F.avg("value"), METRIC_DIGITS).alias("mean")
    )


def best_settings(means: DataFrame, grid: Sequence[Params]) -> DataFrame:
    """Best setting per metric with its parameters; the first of equal settings."""
    order = Window.partitionBy("metric").orderBy(F.desc("mean"), "config_id")
    return (
        means.withColumn("place", F.row_number().over(order))
        .where(F.col("place") == 1)
        .select("metric", "config_id", "mean", *[setting_value(grid, f.name).alias(f.name) for f in fields(grid[0])])
    )
