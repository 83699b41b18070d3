"""Method tables side by side, joined on the query id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scoring import to_digits
from quern.operators.evaluation import METRIC_DIGITS, METRICS


def combine_metrics(long: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Method table (id_Q, metrics..., method) from long metrics (method, metric, id_Q, value).

    One grouping gives what joining one frame per metric would: only ids that have every
    metric stay. Two values of one metric for the same method and id are two runs and end the job:
    choose one run, or tell them apart in ``method``.
    """

    def only(metric: str) -> Column:
        value = F.when(F.col("metric") == metric, F.col("value"))
        two = F.raise_error(F.concat(F.lit(f"two values of {metric} for id "), F.first("id_Q").cast("string")))
        return F.when(F.count(value) > 1, two.cast("double")).otherwise(F.max(value)).alias(metric)

    of_metric = [only(m) for m in metrics]
    return (
        long.groupBy("method", "id_Q")
        .agg(*of_metric)
        .dropna(subset=[*metrics])
        .select("id_Q", *metrics, "method")
    )


def long_table(table: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Method table to (method, metric, id_Q, value)."""
    return table.unpivot(["method", "id_Q"], [*metrics], "metric", "value").select(
        "method", "metric", "id_Q", "value"
    )


def preview(table: DataFrame, n: int = 5) -> DataFrame:
    """First rows in order of id, so that the preview is repeatable."""
    return table.orderBy("id_Q", "method").limit(n)


def id_range(table: DataFrame, low: int, high: int, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of the queries from ``low`` to ``high``, both included."""
    return table.where(F.col("id_Q").between(low, high)).select(*columns)


def stack_methods(base: DataFrame, method: DataFrame) -> DataFrame:
    """Rows of two method tables below each other, matched by column name."""
    return base.unionByName(method)


def paired(long: DataFrame, baseline: str = "base") -> DataFrame:
    """Baseline and method values of the same query and metric.

    (method, metric, id_Q, base_value, value, difference), difference = method - baseline
    without rounding. Ids that only one side has drop out.
    """
    base = long.where(F.col("method") == baseline).select(
        "metric", "id_Q", F.col("value").alias("base_value")
    )
    return (
        long.where(F.col("method") != baseline)
        .join(base, ["metric", "id_Q"])
        .select(
            "method",
            "metric",
            "id_Q",
            "base_value",
            "value",
            (F.col("value") - F.col("base_value")).alias("difference"),
        )
    )


def beside_base(long: DataFrame, baseline: str = "base") -> DataFrame:
    """``long`` with the baseline's value of the same query and metric, null where it has none.

    All methods, the baseline included, from one scan and one exchange by metric and id.
    """
    same = Window.partitionBy("metric", "id_Q")
    base = F.max(F.when(F.col("method") == baseline, F.col("value"))).over(same)
    return long.select("method", "metric", "id_Q", "value", base.alias("base_value"))


def method_difference(pairs: DataFrame) -> DataFrame:
    """Differences at the precision of the published values."""
    return pairs.withColumn("difference", to_digits(F.col("difference"), METRIC_DIGITS))


def column_difference(
    base: DataFrame, method: DataFrame, column: str, suffix: str
) -> DataFrame:
    """One metric of two method tables: (id_Q, column, column + suffix, difference)."""
    other = method.select("id_Q", F.col(column).alias(column + suffix))
    return (
        base.select("id_Q", column)
        .join(other, "id_Q")
        .withColumn("difference", to_digits(F.col(column + suffix) - F.col(column), METRIC_DIGITS))
    )


def extremes(difference: Column) -> list[Column]:
    """Aggregates of the largest gain and largest loss, each with its query; ties go to the smallest id.

    Nothing is sorted; rows without a difference do not count.
    """
    row = F.struct("base_value", "value")
    known = difference.isNotNull()
    gain = F.struct((-difference).alias("loss"), F.col("id_Q").alias("id"), row.alias("row"))
    loss = F.struct(difference.alias("difference"), F.col("id_Q").alias("id"), row.alias("row"))
    return [F.min(F.when(known, gain)).alias("gain"), F.min(F.when(known, loss)).alias("loss")]


def difference_extremes(differences: DataFrame) -> DataFrame:
    """Largest gain and largest loss per method and metric, each with its query and values."""
    return (
        differences.groupBy("method", "metric")
        .agg(*extremes(F.col("difference")))
        .select(
            "method",
            "metric",
            (-F.col("gain.loss") + 0.0).alias("max_difference"),
            F.col("gain.id").alias("max_id"),
            F.col("gain.row.base_value").alias("max_base_value"),
            F.col("gain.row.value").alias("max_value"),
            F.col("loss.difference").alias("min_difference"),
            F.col("loss.id").alias("min_id"),
            F.col("loss.row.base_value").alias("min_base_value"),
            F.col("loss.row.value").alias("min_value"),
        )
    )


def method_means(table: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of each metric per method."""
    return table.groupBy("method").agg(
        *[to_digits(F.avg(m), METRIC_DIGITS).alias(m) for m in metrics]
    )


def mean_difference(long: DataFrame, baseline: str = "base") -> DataFrame:
    """Mean of a method minus mean of the baseline, each over its own queries."""
    means = long.groupBy("method", "metric").agg(F.avg("value").alias("mean"))
    base = means.where(F.col("method") == baseline).select(
        "metric", F.col("mean").alias("base_mean")
    )
    return (
        means.where(F.col("method") != baseline)
        .join(base, "metric")
        .select(
            "method",
            "metric",
            to_digits(F.col("mean") - F.col("base_mean"), METRIC_DIGITS).alias("mean_difference"),
        )
    )
