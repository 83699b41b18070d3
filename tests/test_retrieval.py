import math
import re
from collections import Counter

import pytest
from conftest import TEXTS

from quern.operators.retrieval import bm25_search, query_terms, run_rows, search, search_settings, weighted_clauses
from quern.params import Bm25

QUERIES = [(1, "red apples"), (2, "blue blue birds"), (3, "nothing here matches"), (4, "the")]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string")


def brute_force(clauses, k1=1.2, b=0.75):
    """Ranked (doc, score) of one query's [(term, boost)]."""
    words = {d: Counter(re.findall(r"\w+", t.lower())) for d, t in TEXTS.items()}
    n, average = len(words) + 1, sum(sum(w.values()) for w in words.values()) / (len(words) + 1)
    scores = {}
    for term, boost in clauses:
        df = sum(term in w for w in words.values())
        for doc, w in words.items():
            if term in w:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                norm = w[term] + k1 * (1 - b + b * sum(w.values()) / average)
                scores[doc] = scores.get(doc, 0) + boost * idf * w[term] * (k1 + 1) / norm
    return sorted(((d, round(s, 6)) for d, s in scores.items()), key=lambda x: (-x[1], x[0]))


def ranked(df, query_id):
    return [(r.doc_id, r.score) for r in df.where(f"query_id = {query_id}").orderBy("rank").collect()]


def test_bm25_equals_brute_force(index, queries):
    run = bm25_search(index, queries)
    assert ranked(run, 1) == brute_force([("red", 1), ("apples", 1)])
    assert ranked(run, 2) == brute_force([("blue", 2), ("birds", 1)])
    assert ranked(run, 3) == []


def test_size_cuts_the_list(index, queries):
    run = bm25_search(index, queries, 2)
    assert ranked(run, 1) == brute_force([("red", 1), ("apples", 1)])[:2]


def test_settings_from_columns_score_side_by_side(spark, index):
    clauses = spark.createDataFrame(
        [("x", 1, "red", 1.0, 0.5, 0.1), ("y", 1, "red", 1.0, 2.0, 0.9)],
        "method string, query_id long, term string, boost double, k1 double, b double",
    )
    run = search(index, clauses, key=["method", "query_id"], bm25=Bm25("k1", "b"))
    assert ranked(run.where("method = 'x'"), 1) == brute_force([("red", 1)], 0.5, 0.1)
    assert ranked(run.where("method = 'y'"), 1) == brute_force([("red", 1)], 2.0, 0.9)


def test_shuffled_clauses_give_the_same_run(spark, index, queries, rows):
    expected = rows(bm25_search(index, queries))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = bm25_search(index, queries)
        plan = run._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert rows(run) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_only_cut_lists_are_exchanged(index, queries):
    plan = bm25_search(index, queries)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")



def test_query_without_any_known_term_has_no_hits(index, queries):
    assert bm25_search(index, queries.where("query_id = 3")).count() == 0


def test_weighted_clauses_add_up(spark, index):
    original = spark.createDataFrame([(1, "red", 2.0)], "query_id long, term string, boost double")
    new = spark.createDataFrame([(1, "red", 1.0), (1, "birds", 0.5)], "query_id long, term string, boost double")
    run = search(index, weighted_clauses(original, new, 0.7))
    assert ranked(run, 1) == brute_force([("red", 1.7), ("birds", 0.15)])


def test_full_weight_on_the_original_keeps_the_plain_order(spark, index, queries):
    original = query_terms(queries)
    new = spark.createDataFrame([(1, "green", 1.0)], "query_id long, term string, boost double")
    run = search(index, weighted_clauses(original, new, 1.0))
    assert ranked(run, 1)[: len(ranked(bm25_search(index, queries), 1))] == ranked(
        bm25_search(index, queries), 1
    )


def test_order_of_rows_does_not_matter(index, queries, rows):
    assert rows(bm25_search(index, queries.orderBy("text"))) == rows(bm25_search(index, queries))


def test_run_layout(index, queries):
    row = run_rows(bm25_search(index, queries), "t").where("query_id = 4").first()
    assert row.asDict().keys() == {"query_id", "iteration", "doc_id", "rank", "score", "tag"}
    assert (row.iteration, row.doc_id, row["rank"], row.tag) == ("Q0", 3, 1, "t")


def test_settings_in_one_row_equal_settings_in_the_key(spark, index, queries, rows):
    settings = {"x": Bm25(0.5, 0.1), "y": Bm25(2.0, 0.9)}
    several = query_terms(queries).crossJoin(
        spark.createDataFrame([("x", 0.5, 0.1), ("y", 2.0, 0.9)], "method string, k1 double, b double")
    )
    for size in (1, 10):
        expected = search(index, several, size, ["method", "query_id"], Bm25("k1", "b"))
        assert rows(search_settings(index, query_terms(queries), settings, size)) == rows(expected)


def test_postings_stay_in_their_buckets_beside_clauses_over_the_threshold(spark, index, queries, rows):
    expected = rows(bm25_search(index, queries))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        run = bm25_search(index, queries)
        plan = run._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
        assert rows(run) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
