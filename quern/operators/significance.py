"""Paired tests over all methods and metrics at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.probability import exact_rank_sum, two_sided_normal, two_sided_t
from quern.functions.scoring import to_digits
from quern.operators.evaluation import METRIC_DIGITS
from quern.storage import written

GROUP = ["method", "metric"]
ALPHA = 0.05
#: Spread, as a share of the largest value, up to which all differences count as equal.
NO_SPREAD = 1e-12
#: Differences that an exact test takes.
EXACT_MOST = 500


def difference_sums() -> list[Column]:
    """Aggregates of pairs that the t-test needs: n, mean_d, sd_d, and the largest value as ``size``."""
    d = F.col("base_value") - F.col("value")
    size = F.greatest(F.abs("base_value"), F.abs("value"))
    return [
        F.count(d).alias("n"), F.avg(d).alias("mean_d"), F.stddev_samp(d).alias("sd_d"),
        F.max(F.when(d.isNotNull(), size)).alias("size"),
    ]


def with_t(sums: DataFrame) -> DataFrame:
    """``sums`` with t and its p in place of ``size``."""
    spread = (F.col("n") >= 2) & (F.col("sd_d") > F.col("size") * NO_SPREAD)
    t = F.when(spread, F.col("mean_d") / (F.col("sd_d") / F.sqrt("n")))
    return sums.withColumn("t", t).drop("size").withColumn("p", two_sided_t(F.col("t"), F.col("n") - 1))


def paired_t_test(pairs: DataFrame) -> DataFrame:
    """(method, metric, n, mean_d, sd_d, t, p) with d = baseline - method.

    Without spread (beyond what rounding of the largest value can make), or with fewer than two
    pairs, t and p are null.
    """
    return with_t(pairs.groupBy(*GROUP).agg(*difference_sums()))


def signed(pairs: DataFrame, digits: int | None = METRIC_DIGITS) -> Column:
    """d = baseline - method, rounded to ``digits`` so that equal decimals tie; None keeps raw values."""
    d = F.col("base_value") - F.col("value")
    return d if digits is None else to_digits(d, digits)


def equal_sizes(pairs: DataFrame, digits: int | None = METRIC_DIGITS) -> DataFrame:
    """(method, metric, size, tied, plus): how often |d| occurs, and how often with d > 0."""
    return (
        pairs.select(*GROUP, signed(pairs, digits).alias("d"))
        .groupBy(*GROUP, F.abs("d").alias("size"))
        .agg(F.count(F.lit(1)).alias("tied"), F.count(F.when(F.col("d") > 0, True)).alias("plus"))
    )


def average_ranks(sizes: DataFrame) -> DataFrame:
    """``sizes`` without zeros and with ``rank``, the average rank of each size in its group.

    Two levels: sizes are dealt to ranges in their order, a range adds up its own counts, and what
    lies before it comes from the sums of the earlier ranges. Each row is looked at a fixed number of
    times and no task orders a whole group, however many different sizes it has.
    """
    within = Window.partitionBy(*GROUP, "part").orderBy("size")
    before = Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(
        sizes.where(F.col("size") > 0)
        .repartitionByRange(*GROUP, "size")
        .withColumn("part", F.spark_partition_id()),
        "ranges",
    )
    earlier = (
        placed.groupBy(*GROUP, "part")
        .agg(F.sum("tied").alias("inside"))
        .withColumn("earlier", F.coalesce(F.sum("inside").over(before), F.lit(0).cast("long")))
        .drop("inside")
    )
    upto = F.col("earlier") + F.sum("tied").over(within)
    return (
        placed.join(earlier, [*GROUP, "part"])
        .withColumn("rank", upto - (F.col("tied") - 1) / 2)
        .select(*GROUP, "size", "tied", "plus", "rank")
    )


def wilcoxon(
    pairs: DataFrame, digits: int | None = METRIC_DIGITS, method: str = "normal"
) -> DataFrame:
    """Signed-rank test: (method, metric, n, rank_sum_plus, rank_sum_minus, z, p).

    d = baseline - method, zeros dropped, ties at average rank. ``method`` says where p comes from:
    ``"normal"``, the approximation with tie correction, or ``"exact"``, the distribution of the rank sum
    over all signs, for samples of at most ``EXACT_MOST`` differences. Without any difference z and p
    are null.
    """
    if method not in ("normal", "exact"):
        raise ValueError(f"method must be 'normal' or 'exact', not {method!r}")
    sizes = written(equal_sizes(pairs, digits), "sizes")
    tied, plus, rank = F.col("tied").cast("double"), F.col("plus").cast("double"), F.col("rank")
    exact = []
    if method == "exact":
        twice = F.struct((2 * rank).cast("int").alias("step"), F.col("tied").cast("int").alias("times"))
        small = F.collect_list(F.when(rank <= EXACT_MOST, twice))  # a bounded list, whatever the sample
        too_many = F.raise_error(F.lit(f"exact p-values are for at most {EXACT_MOST} differences"))
        exact = [F.when(F.sum(tied) > EXACT_MOST, too_many.cast("array<struct<step:int,times:int>>")).otherwise(F.sort_array(small)).alias("steps")]
    sums = average_ranks(sizes).groupBy(*GROUP).agg(
        F.sum(tied).alias("n"),
        F.sum(plus * rank).alias("rank_sum_plus"),
        F.sum((tied - plus) * rank).alias("rank_sum_minus"),
        F.sum(tied * tied * tied - tied).alias("tie_sum"),
        *exact,
    )
    n, least = F.col("n"), F.least("rank_sum_plus", "rank_sum_minus")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_sum") / 48)
    tested = sums.withColumn("z", (least - n * (n + 1) / 4) / spread)
    p = exact_rank_sum(least, F.col("steps")) if exact else two_sided_normal(F.col("z"))
    tested = tested.select(*GROUP, n.cast("long").alias("n"), "rank_sum_plus", "rank_sum_minus", "z", p.alias("p"))
    # A pair of methods without any difference has no ranks, but keeps its row.
    return sizes.select(*GROUP).distinct().join(tested, GROUP, "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long"))
    )


def verdict(p: str, toward: str, alpha: float = ALPHA) -> Column:
    """What follows from a p-value at ``alpha``; ``toward`` is positive where the baseline is larger."""
    direction = F.when(F.col(toward) < 0, "better").when(F.col(toward) > 0, "worse")
    return F.coalesce(F.when(F.col(p) < alpha, direction), F.lit("no difference"))


def rank_verdicts(pairs: DataFrame, digits: int | None = METRIC_DIGITS) -> DataFrame:
    """(method, metric, p_wilcoxon, ranks), ranks being the difference of the rank sums."""
    ranks = (F.col("rank_sum_plus") - F.col("rank_sum_minus")).alias("ranks")
    return wilcoxon(pairs, digits).select(*GROUP, F.col("p").alias("p_wilcoxon"), ranks)


def verdicts(pairs: DataFrame, alpha: float = ALPHA, digits: int | None = METRIC_DIGITS) -> DataFrame:
    """Both p-values and what follows from them at ``alpha``: for t with the direction of the mean, for ranks
    with that of the rank sums.

    (method, metric, mean_difference, p_t, p_wilcoxon, verdict_t, verdict_wilcoxon)
    """
    t_test = paired_t_test(pairs).select(*GROUP, "mean_d", F.col("p").alias("p_t"))
    return t_test.join(rank_verdicts(pairs, digits), GROUP).select(
        *GROUP,
        (-F.col("mean_d")).alias("mean_difference"),
        "p_t",
        "p_wilcoxon",
        verdict("p_t", "mean_d", alpha).alias("verdict_t"),
        verdict("p_wilcoxon", "ranks", alpha).alias("verdict_wilcoxon"),
    )
