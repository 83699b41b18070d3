"""Effectiveness of runs against graded judgments.

Queries count when they have both hits and judgments. A hit without a judgment is not
relevant; relevant means grade 1 or more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scoring import discounted, to_digits
from quern.operators.retrieval import QUERY

METRIC_DIGITS = 4
METRICS = ("map", "p_5", "ndcg_10")


def judged_hits(run: DataFrame, qrels: DataFrame, key: Sequence[str] = QUERY) -> DataFrame:
    """(key, doc_id, rank, grade): hits with their grade, 0 where unjudged."""
    return run.join(qrels, ["query_id", "doc_id"], "left").select(
        *key, "doc_id", "rank", F.coalesce("grade", F.lit(0)).alias("grade")
    )


def judged_queries(qrels: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, n_relevant, ideal_dcg): what the judgments alone say about a query."""
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    counts = qrels.groupBy("query_id").agg(
        F.count(F.when(F.col("grade") >= 1, True)).alias("n_relevant")
    )
    ideal = (
        qrels.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= depth)
        .groupBy("query_id")
        .agg(F.sum(discounted(F.col("grade"), F.col("place"))).alias("ideal_dcg"))
    )
    return counts.join(ideal, "query_id")


def query_metrics(
    run: DataFrame,
    qrels: DataFrame,
    key: Sequence[str] = QUERY,
    precision_depth: int = 5,
    ndcg_depth: int = 10,
) -> DataFrame:
    """Average precision, precision and nDCG per query: (key, map, p_k, ndcg_k), unrounded."""
    relevant = (F.col("grade") >= 1).cast("int")
    seen = F.sum(relevant).over(
        Window.partitionBy(*key)
        .orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = (
        judged_hits(run, qrels, key)
        .withColumn("seen", seen)
        .groupBy(*key)
        .agg(
            F.sum(relevant * F.col("seen") / F.col("rank")).alias("precision_sum"),
            F.sum(F.when(F.col("rank") <= precision_depth, relevant).otherwise(0)).alias("early"),
            F.sum(
                F.when(
                    F.col("rank") <= ndcg_depth, discounted(F.col("grade"), F.col("rank"))
                ).otherwise(0.0)
            ).alias("dcg"),
        )
    )
    precision = F.when(F.col("n_relevant") > 0, F.col("precision_sum") / F.col("n_relevant"))
    ndcg = F.when(F.col("ideal_dcg") > 0, F.col("dcg") / F.col("ideal_dcg"))
    return sums.join(judged_queries(qrels, ndcg_depth), "query_id").select(
        *key,
        F.coalesce(precision, F.lit(0.0)).alias("map"),
        (F.col("early") / precision_depth).alias(f"p_{precision_depth}"),
        F.coalesce(ndcg, F.lit(0.0)).alias(f"ndcg_{ndcg_depth}"),
    )


def long_metrics(
    wide: DataFrame, key: Sequence[str] = QUERY, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """One row per metric: (key, metric, value)."""
    return wide.unpivot([*key], [*metrics], "metric", "value")


def with_all_row(metrics: DataFrame, key: Sequence[str] = ("metric",)) -> DataFrame:
    """Long metrics as text ids with one more row ``all`` per metric: the mean over queries.

    Rows and means are two grouping sets of one scan.
    """
    each, total = [*key, "query_id"], [*key]
    grouped = metrics.groupingSets([each, total], *each).agg(
        F.avg("value").alias("value"), F.grouping("query_id").alias("is_all")
    )
    id_q = F.when(F.col("is_all") == 1, F.lit("all")).otherwise(F.col("query_id").cast("string"))
    return grouped.select(*key, id_q.alias("id_q"), to_digits(F.col("value"), METRIC_DIGITS).alias("value"))


def split_queries(queries: DataFrame, n_train: int = 150, n_test: int = 100) -> DataFrame:
    """(query_id, part): the first ``n_train`` ids train, of the others the last ``n_test`` test.

    The two cut-off ids come from bounded top-n selections, so the queries are never put into
    one global order.
    """
    ids = queries.select("query_id")
    last_train = ids.orderBy("query_id").limit(n_train).agg(F.max("query_id")).scalar()
    first_test = ids.orderBy(F.desc("query_id")).limit(n_test).agg(F.min("query_id")).scalar()
    return ids.select(
        "query_id",
        F.when(F.col("query_id") <= last_train, "train")
        .when(F.col("query_id") >= first_test, "test")
        .otherwise("unused")
        .alias("part"),
    )
