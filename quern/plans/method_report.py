"""One table per comparison: means, differences, extremes and significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scoring import to_digits
from quern.operators.comparison import beside_base, extremes
from quern.operators.evaluation import METRIC_DIGITS
from quern.operators.significance import difference_sums, rank_verdicts, verdict, with_t
from quern.storage import written

GROUP = ["method", "metric"]


def method_report(long: DataFrame, baseline: str = "base") -> DataFrame:
    """(method, metric, means, mean difference, extremes with their query, p-values, verdicts).

    ``long`` (method, metric, id_Q, value) is read once. Every value is put beside its baseline and
    written; all means, extremes and sums of the tests are aggregates of one scan of that, and the
    signed ranks another. ``mean_difference`` compares the means over all queries of each side, the other
    columns the queries that both have.
    """
    rows = written(beside_base(long, baseline), "beside-base")
    pairs = rows.where((F.col("method") != baseline) & F.col("base_value").isNotNull())
    difference = to_digits(F.col("value") - F.col("base_value"), METRIC_DIGITS)
    both = F.col("base_value").isNotNull()
    sums = rows.groupBy(*GROUP).agg(
        F.avg("value").alias("own_mean"),
        to_digits(F.avg("base_value"), METRIC_DIGITS).alias("base_mean"),
        to_digits(F.avg(F.when(both, F.col("value"))), METRIC_DIGITS).alias("method_mean"),
        *extremes(difference),
        *difference_sums(),
    )
    base_own = F.max(F.when(F.col("method") == baseline, F.col("own_mean"))).over(Window.partitionBy("metric"))
    tested = with_t(
        sums.withColumn("mean_difference", to_digits(F.col("own_mean") - base_own, METRIC_DIGITS))
        .where((F.col("method") != baseline) & (F.col("n") > 0))
    )
    return tested.withColumnRenamed("p", "p_t").join(rank_verdicts(pairs), GROUP).select(
        *GROUP,
        "n",
        "base_mean",
        "method_mean",
        "mean_difference",
        (-F.col("gain.loss") + 0.0).alias("max_difference"),
        F.col("gain.id").alias("max_id"),
        F.col("loss.difference").alias("min_difference"),
        F.col("loss.id").alias("min_id"),
        "p_t",
        "p_wilcoxon",
        verdict("p_t", "mean_d").alias("verdict_t"),
        verdict("p_wilcoxon", "ranks").alias("verdict_wilcoxon"),
    )
