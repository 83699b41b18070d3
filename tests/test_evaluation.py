import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation


@pytest.fixture(scope="module")
def judged(spark):
    """Query 1: five relevant documents, two of grade 2. Query 2: sixteen of grade 1.

    Query 3 has judgments without hits, query 4 hits without judgments, query 5 only grade 0.
    """
    qrels = [(1, 2, 1), (1, 4, 1), (1, 7, 2), (1, 101, 2), (1, 102, 1), (3, 1, 1), (5, 1, 0)]
    qrels += [(2, d, 1) for d in (1, 3, 9, 10, *range(201, 213))]
    run = [(q, r, 1.0 / r, r) for q in (1, 2, 4, 5) for r in range(1, 11)]
    return (
        spark.createDataFrame(run, "query_id long, doc_id long, score double, rank int"),
        spark.createDataFrame(qrels, "query_id long, doc_id long, grade int"),
    )


def test_known_values(judged):
    metrics = evaluation.query_metrics(*judged).collect()
    found = {r.query_id: (round(r.map, 4), r.p_5, round(r.ndcg_10, 4)) for r in metrics}
    assert found[1] == (0.2857, 0.4, 0.3774)
    assert found[2][:2] == (0.15, 0.4)


def test_only_queries_with_hits_and_judgments_count(judged):
    found = {r.query_id: r.map for r in evaluation.query_metrics(*judged).collect()}
    assert found.keys() == {1, 2, 5}
    assert found[5] == 0


def test_precision_divides_by_the_depth_even_for_short_lists(judged):
    run, qrels = judged
    short = run.where("rank <= 2")
    found = {r.query_id: r.p_5 for r in evaluation.query_metrics(short, qrels).collect()}
    assert found[1] == 1 / 5


def test_values_stay_between_zero_and_one(judged):
    for r in evaluation.query_metrics(*judged).collect():
        assert all(0 <= v <= 1 for v in (r.map, r.p_5, r.ndcg_10))
        assert (r.p_5 * 5).is_integer()


def test_all_row_is_the_mean(spark, rows):
    metrics = spark.createDataFrame(
        [("map", 1, 0.2), ("map", 2, 0.4), ("p_5", 1, 0.6)], "metric string, query_id int, value double"
    )
    assert rows(evaluation.with_all_row(metrics)) == [
        ("map", "1", 0.2), ("map", "2", 0.4), ("map", "all", 0.3), ("p_5", "1", 0.6), ("p_5", "all", 0.6),
    ]


def test_split_takes_first_for_training_and_last_for_test(spark):
    queries = spark.range(1, 11).select(F.col("id").alias("query_id"), F.lit("x").alias("text"))
    parts = {r.query_id: r.part for r in evaluation.split_queries(queries, 4, 3).collect()}
    assert [parts[i] for i in range(1, 11)] == ["train"] * 4 + ["unused"] * 3 + ["test"] * 3


def test_split_of_few_queries_prefers_training(spark):
    queries = spark.range(3).select(F.col("id").alias("query_id"))
    assert {r.part for r in evaluation.split_queries(queries).collect()} == {"train"}
