import random

import pytest
from pyspark.sql import functions as F

from quern.operators import bounded
from quern.operators.retrieval import query_terms, search
from quern.params import Bm25
from quern.sources.term_index import build_index

COMMON, RARE = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(400)]


@pytest.fixture(scope="module")
def large(spark):
    """Texts of common words with a few rare ones, of very different lengths, and copies that tie."""
    draw = random.Random(3)
    rows = []
    for k in range(600):
        words = draw.choices(COMMON, k=draw.choice([4, 20, 200])) + draw.choices(RARE, k=draw.choice([0, 1, 3]))
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, rows[5][1]) for k in range(30)] + [(2000, ""), (2001, None)]
    return build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), buckets=4)


@pytest.fixture(scope="module")
def clauses(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choices(COMMON, k=a) + draw.choices(RARE, k=b)) for a, b in [(1, 1), (2, 2), (6, 1), (0, 1), (3, 0), (10, 10)] * 3]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100, "absent"), (101, "")]
    return query_terms(spark.createDataFrame(rows, "query_id long, text string"))


@pytest.mark.parametrize("size", [1, 5, 10, 700])
@pytest.mark.parametrize("bm25", [Bm25(), Bm25(2.0, 0.0), Bm25(0.4, 1.0)])
def test_same_as_search(large, clauses, rows, size, bm25):
    assert rows(bounded.bounded_search(large, clauses, size, bm25=bm25)) == rows(search(large, clauses, size, bm25=bm25))


def test_settings_from_columns_and_any_boost(large, clauses, rows):
    settings = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(k1).alias("k1"), F.lit(b).alias("b")) for m, k1, b in [("x", 1.2, 0.75), ("y", 0.4, 1.0)]]))
    boost = F.when(F.col("term").startswith("c1"), -0.3).otherwise(F.col("boost"))
    several = clauses.withColumn("s", settings).select("s.*", "query_id", "term", boost.alias("boost"))
    key, bm25 = ["method", "query_id"], Bm25("k1", "b")
    assert rows(bounded.bounded_search(large, several, 5, key, bm25)) == rows(search(large, several, 5, key, bm25))


def test_few_documents_are_scored(large, clauses):
    plan = bounded.essential_terms(large, clauses, 10, ["query_id"], Bm25()).cache()
    every = large.postings.join(plan, "term").select("query_id", "doc_id").distinct().count()
    found = bounded.passing(large, plan)
    assert found.count() < 0.5 * every
    assert bounded.completed(large, plan, found).count() < 0.2 * every


def test_rows_stay_in_their_buckets(spark, large, clauses):
    """No exchange of postings: neither for the sums nor for the join of what passes with its other terms."""
    from quern.storage import written

    plan = written(bounded.essential_terms(large, clauses, 10, ["query_id"], Bm25()), "plan")
    scores = bounded.completed(large, plan, bounded.passing(large, plan))
    text = scores._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and text.count("ShuffledHashJoin") == 1


def test_no_exchange_of_pairs_under_sparks_own_settings(spark, large, clauses, rows, monkeypatch):
    """Without the setting of ``local_session`` the pairs of query and document must not be exchanged either."""
    key, plans = "spark.sql.requireAllClusterKeysForCoPartition", []
    completed = bounded.completed

    def seen(*args):
        scores = completed(*args)
        plans.append(scores._jdf.queryExecution().executedPlan().toString())
        return scores

    expected = rows(search(large, clauses, 5))
    monkeypatch.setattr(bounded, "completed", seen)
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        assert rows(bounded.bounded_search(large, clauses, 5)) == expected
        assert spark.conf.get(key) == "true"
    finally:
        spark.conf.set(key, before)
    assert "Exchange hashpartitioning" not in plans[0]
