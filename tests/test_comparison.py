import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.probability import two_sided_normal, two_sided_t
from quern.operators import comparison, significance
from quern.plans.method_report import method_report

LONG = "method string, metric string, id_Q int, value double"


@pytest.fixture(scope="module")
def long(spark):
    """Out of order, id 3 missing, id 9 in one method only, tied gains and losses."""
    base = {1: 0.4, 2: 0.6, 4: 0.2, 5: 0.5, 9: 1.0}
    other = {5: 0.5, 4: 0.4, 2: 0.4, 1: 0.6, 8: 0.0}
    data = [("base", "map", i, v) for i, v in base.items()] + [("knn", "map", i, v) for i, v in other.items()]
    return spark.createDataFrame(data, LONG)


def test_combination_keeps_complete_ids(spark, rows):
    data = [("base", m, i, i / 10) for m, i in itertools.product(("map", "p_5", "ndcg_10"), (1, 2))]
    df = spark.createDataFrame([*data, ("base", "map", 3, 0.3)], LONG)
    table = comparison.combine_metrics(df)
    assert rows(table) == [(1, 0.1, 0.1, 0.1, "base"), (2, 0.2, 0.2, 0.2, "base")]
    assert rows(comparison.long_table(table)) == rows(df.where("id_Q < 3"))


def test_pairs_join_on_the_key(long, rows):
    found = rows(comparison.method_difference(comparison.paired(long)).drop("method", "metric"))
    assert found == [(1, 0.4, 0.6, 0.2), (2, 0.6, 0.4, -0.2), (4, 0.2, 0.4, 0.2), (5, 0.5, 0.5, 0.0)]


def test_extremes_return_keys_and_break_ties_by_id(long):
    row = comparison.difference_extremes(comparison.method_difference(comparison.paired(long))).first()
    assert (row.max_difference, row.max_id, row.max_base_value, row.max_value) == (0.2, 1, 0.4, 0.6)
    assert (row.min_difference, row.min_id, row.min_base_value, row.min_value) == (-0.2, 2, 0.6, 0.4)


def test_means_and_their_difference(long, rows):
    assert rows(comparison.mean_difference(long)) == [("knn", "map", round(0.38 - 0.54, 4))]


def test_column_difference_adds_a_suffix(spark, rows):
    base = spark.createDataFrame([(1, 0.5), (2, 0.1)], "id_Q int, map double")
    method = spark.createDataFrame([(1, 0.7)], "id_Q int, map double")
    found = comparison.column_difference(base, method, "map", "_knn")
    assert found.columns == ["id_Q", "map", "map_knn", "difference"]
    assert rows(found) == [(1, 0.5, 0.7, 0.2)]


def test_range_is_inclusive_and_preview_is_ordered(long, rows):
    assert rows(comparison.id_range(long, 2, 5, ["id_Q"])) == [(2,), (2,), (4,), (4,), (5,), (5,)]
    assert [r.id_Q for r in comparison.preview(long, 3).collect()] == [1, 1, 2]


# Distribution functions

def p_of_t(t, df):
    """By Simpson's rule over the angle."""
    theta = math.atan(abs(t) / math.sqrt(df))
    def area(low):
        x = np.linspace(low, math.pi / 2, 200001)
        y = np.cos(x) ** (df - 1)
        return (x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return area(theta) / area(0)


def test_normal_p_values(spark):
    z = [0.0, 0.3, 1.0, 1.959964, 3.0, 4.2, 4.3, 8.0, 20.0]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    found = [r[0] for r in df.select(two_sided_normal(F.col("z"))).collect()]
    assert found == pytest.approx([math.erfc(x / math.sqrt(2)) for x in z], rel=1e-11, abs=0)


def test_t_p_values(spark):
    cases = [(t, n) for t in (0.0, 0.5, 2.0, 5.0) for n in (1, 2, 3, 4, 5, 30, 98, 199, 200, 201, 1000, 100000)]
    df = spark.createDataFrame([(t, n) for t, n in cases], "t double, n long")
    found = [r[0] for r in df.select(two_sided_t(F.col("t"), F.col("n"))).collect()]
    assert found == pytest.approx([p_of_t(t, n) for t, n in cases], abs=1e-8)


# Tests of significance

def pairs_of(spark, made):
    return spark.createDataFrame(
        [("m", "map", i, float(b), float(v)) for i, (b, v) in enumerate(made)],
        "method string, metric string, id_Q int, base_value double, value double",
    )


def signed_rank(differences):
    d = differences[differences != 0]
    size = np.abs(d)
    ranks = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    plus, minus = ranks[d > 0].sum(), ranks[d < 0].sum()
    n = len(d)
    ties = sum(c**3 - c for c in np.unique(size, return_counts=True)[1])
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return n, plus, minus, math.erfc(abs(min(plus, minus) - n * (n + 1) / 4) / spread / math.sqrt(2))


@pytest.mark.parametrize("digits", [1, 4])
def test_ranks_equal_brute_force_with_and_without_ties(spark, digits):
    rng = np.random.default_rng(digits)
    base, value = np.round(rng.random(2000), digits), np.round(rng.random(2000) + 0.01, digits)
    row = significance.wilcoxon(pairs_of(spark, zip(base, value)), digits).first()
    n, plus, minus, p = signed_rank(np.round(base - value, digits))
    assert (row.n, row.rank_sum_plus, row.rank_sum_minus) == (n, plus, minus)
    assert row.p == pytest.approx(p, rel=1e-9)


def test_rounding_joins_decimals_that_differ_in_binary(spark):
    made = [(0.6, 0.4), (0.2, 0.4), (0.4, 0.2), (0.1, 0.2)]
    rounded, raw = (significance.wilcoxon(pairs_of(spark, made), d).first() for d in (4, None))
    assert (rounded.rank_sum_plus, rounded.rank_sum_minus) == (6.0, 4.0)
    assert raw.rank_sum_plus != rounded.rank_sum_plus


def test_no_difference_gives_no_p(spark):
    row = significance.verdicts(pairs_of(spark, [(0.5, 0.5)] * 4)).first()
    assert (row.p_t, row.p_wilcoxon) == (None, None)
    assert (row.verdict_t, row.verdict_wilcoxon) == ("no difference", "no difference")
    assert significance.wilcoxon(pairs_of(spark, [(0.5, 0.5)] * 4)).first().n == 0


def test_constant_difference_and_single_pair_have_no_t(spark):
    assert significance.paired_t_test(pairs_of(spark, [(0.5, 0.25)] * 3)).first().t is None
    assert significance.paired_t_test(pairs_of(spark, [(0.5, 0.25)])).first().t is None


def test_swapped_sides_flip_t_and_keep_p(spark):
    rng = np.random.default_rng(1)
    made = list(zip(rng.random(60), rng.random(60)))
    one = significance.paired_t_test(pairs_of(spark, made)).first()
    two = significance.paired_t_test(pairs_of(spark, [(v, b) for b, v in made])).first()
    assert (one.t, one.p) == pytest.approx((-two.t, two.p))


def test_verdict_names_the_direction(spark):
    rng = np.random.default_rng(2)
    made = [(b, b + 0.1 + 0.01 * rng.random()) for b in rng.random(30)]
    row = significance.verdicts(pairs_of(spark, made)).first()
    assert (row.verdict_t, row.verdict_wilcoxon) == ("better", "better")
    row = significance.verdicts(pairs_of(spark, [(v, b) for b, v in made])).first()
    assert (row.verdict_t, row.verdict_wilcoxon) == ("worse", "worse")


def test_report_has_one_row_per_method_and_metric(long):
    row = method_report(long).first()
    assert (row.method, row.metric, row.n, row.max_id, row.min_id) == ("knn", "map", 4, 1, 2)
    assert (row.base_mean, row.method_mean, row.mean_difference) == (0.425, 0.475, -0.16)


def test_one_formula_for_all_degrees_of_freedom(spark):
    rows = [(1.0, 1), (2.0, 2), (1.7, 4), (1.96, 10_000_000), (0.0, 5), (None, 3), (1.0, 0)]
    df = spark.createDataFrame(rows, "t double, n long")
    found = [r[0] for r in df.select(two_sided_t(F.col("t"), F.col("n"))).collect()]
    share = 4 / (4 + 1.7**2)
    wanted = [0.5, 1 - 2 / math.sqrt(6), 1 - math.sqrt(1 - share) * (1 + share / 2), math.erfc(1.96 / math.sqrt(2)), 1.0]
    assert found[:5] == pytest.approx(wanted, abs=1e-7) and found[5:] == [None, None]


def test_two_runs_of_one_metric_are_not_merged(spark):
    rows = [("a", "map", 1, 0.5), ("a", "map", 1, 0.6), ("a", "p_5", 1, 0.1), ("a", "ndcg_10", 1, 0.1)]
    long = spark.createDataFrame(rows, "method string, metric string, id_Q long, value double")
    with pytest.raises(Exception, match="two values of map for id 1"):
        comparison.combine_metrics(long).collect()


def test_extremes_of_text_ids(spark):
    rows = [("m", "map", "b", 0.1, 0.3, 0.2), ("m", "map", "a", 0.2, 0.4, 0.2), ("m", "map", "c", 0.4, 0.4, 0.0)]
    frame = spark.createDataFrame(rows, "method string, metric string, id_Q string, base_value double, value double, difference double")
    row = comparison.difference_extremes(frame).first()
    assert (row.max_id, row.max_difference, row.min_id, row.min_difference) == ("a", 0.2, "c", 0.0)


def all_signs(d):
    """Two-sided p of the signed-rank sum over every choice of signs."""
    d = np.array([x for x in d if x])
    size = np.abs(d)
    rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    plus = rank[d > 0].sum()
    sums = np.array([sum(r for r, up in zip(rank, signs) if up) for signs in itertools.product([0, 1], repeat=len(rank))])
    return min(1.0, 2 * min((sums <= plus).mean(), (sums >= plus).mean()))


@pytest.mark.parametrize("made", [
    [0.1, 0.2, -0.3, 0.4, 0.5, 0.6, 0.7], [0.1, 0.1, -0.1, 0.3, 0.3, -0.2, 0.0, 0.5], [0.2], [-0.1, -0.2, -0.3, -0.4, -0.5, -0.6],
])
def test_exact_rank_sums_equal_all_signs(spark, made):
    row = significance.wilcoxon(pairs_of(spark, [(0.5, 0.5 - d) for d in made]), method="exact").first()
    assert row.p == pytest.approx(all_signs(made), rel=1e-12)


def test_exact_and_normal_come_together_and_large_samples_are_refused(spark):
    rng = np.random.default_rng(7)
    made = list(zip(rng.random(120), rng.random(120) + 0.05))
    exact, normal = (significance.wilcoxon(pairs_of(spark, made), method=m).first() for m in ("exact", "normal"))
    assert exact.p == pytest.approx(normal.p, abs=0.01) and exact.z == normal.z
    with pytest.raises(ValueError):
        significance.wilcoxon(pairs_of(spark, made), method="guess")
    many = list(zip(rng.random(600), rng.random(600)))
    with pytest.raises(Exception, match="at most 500 differences"):
        significance.wilcoxon(pairs_of(spark, many), method="exact").collect()
    assert significance.wilcoxon(pairs_of(spark, [(0.5, 0.5)] * 3), method="exact").first().p is None


def test_ranks_over_many_ranges(spark):
    """Ranks stay exact however the sizes are dealt, and no expression lists cut points."""
    rng = np.random.default_rng(8)
    base, value = rng.random(3000), rng.random(3000)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        row = significance.wilcoxon(pairs_of(spark, zip(base, value)), None).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    n, plus, minus, p = signed_rank(base - value)
    assert (row.n, row.rank_sum_plus, row.rank_sum_minus) == (n, plus, minus)


def test_report_reads_its_samples_once(long):
    base = comparison.beside_base(long)
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
