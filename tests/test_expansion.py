import math
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import clusters, embeddings, feedback, lattice
from quern.operators.retrieval import bm25_search, query_terms, search
from quern.params import KnnParams, W2vParams
from quern.plans import expanded_search, parameter_grid
from quern.sources.term_index import build_index
from quern.storage import written

TWO_GROUPS = {
    1: "sun moon star",
    2: "sun moon comet",
    3: "sun moon orbit",
    4: "fish whale shrimp",
    5: "fish whale coral",
    6: "fish whale kelp",
}
# A third query meets documents that have little in common.
LOOSE = {7: "iron gold", 8: "iron lead", 9: "iron zinc"}


@pytest.fixture(scope="module")
def collection(spark):
    return spark.createDataFrame([*TWO_GROUPS.items(), *LOOSE.items()], "doc_id long, text string")


@pytest.fixture(scope="module")
def group_index(collection):
    return build_index(collection, buckets=2)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "sun fish"), (2, "iron")], "query_id long, text string")


@pytest.fixture(scope="module")
def hits(queries, group_index):
    return bm25_search(group_index, queries).cache()


@pytest.fixture(scope="module")
def weights(hits, group_index):
    return feedback.tfidf_l2(feedback.hit_terms(hits, group_index.documents)).cache()


def lists(df, query_id):
    found = {}
    for r in df.where(F.col("query_id") == query_id).orderBy("doc_id", "k").collect():
        found.setdefault(r.doc_id, []).append(r.nbr_id)
    return found


def test_weights_have_unit_length_and_smoothed_idf(weights):
    found = {r.term: r.weight for r in weights.where("query_id = 1 and doc_id = 1").collect()}
    common, rare = math.log(7 / 4) + 1, math.log(7 / 2) + 1
    length = math.sqrt(2 * common**2 + rare**2)
    assert found == pytest.approx({"sun": common / length, "moon": common / length, "star": rare / length})


def test_each_document_heads_its_list_and_groups_stay_apart(hits, weights):
    found = lists(feedback.nearest_hits(hits, weights, 3), 1)
    assert found == {
        1: [1, 2, 3], 2: [2, 1, 3], 3: [3, 1, 2], 4: [4, 5, 6], 5: [5, 4, 6], 6: [6, 4, 5],
    }


def test_unrelated_hits_fill_the_list_in_order_of_id(hits, weights):
    found = lists(feedback.nearest_hits(hits, weights, 5), 1)
    assert found[4] == [4, 5, 6, 1, 2]


def test_occurrences_add_up_to_all_list_places(hits, weights):
    for k in (2, 3, 50):
        near = feedback.nearest_hits(hits, weights, k)
        total = {
            r.query_id: r.n
            for r in feedback.dominant_hits(near, 0).groupBy("query_id").agg(F.sum("occurrences").alias("n")).collect()
        }
        assert total == {1: 6 * min(k, 6), 2: 3 * min(k, 3)}


def test_threshold_is_strict(hits, weights, rows):
    near = feedback.nearest_hits(hits, weights, 3)
    dominant = rows(feedback.dominant_hits(near, 2).where("query_id = 1"))
    assert dominant == [(1, d, 3) for d in TWO_GROUPS]
    assert rows(feedback.dominant_hits(near, 3)) == []


def test_similarities_equal_dense_cosines(spark):
    rng = np.random.default_rng(3)
    dense = rng.random((12, 20)) * (rng.random((12, 20)) < 0.3)
    dense /= np.linalg.norm(dense, axis=1, keepdims=True) + (dense.sum(axis=1, keepdims=True) == 0)
    weights = spark.createDataFrame(
        [(1, int(d), f"t{t}", float(dense[d, t])) for d, t in zip(*np.nonzero(dense))],
        "query_id long, doc_id long, term string, weight double",
    )
    hits = spark.createDataFrame([(1, d) for d in range(12)], "query_id long, doc_id long")
    found = lists(feedback.nearest_hits(hits, weights, 4), 1)
    cosines = np.round(dense @ dense.T, 9)
    np.fill_diagonal(cosines, 1)
    expected = {d: sorted(range(12), key=lambda o: (-cosines[d, o], o))[:4] for d in range(12)}
    assert found == expected


def test_cluster_text_follows_neighbour_order(hits, weights, collection):
    near = feedback.nearest_hits(hits, weights, 3)
    members = clusters.cluster_members(feedback.dominant_hits(near, 2), near)
    texts = {r.cluster_id: r.text for r in clusters.cluster_texts(members, collection).collect()}
    assert texts[5] == "fish whale coral fish whale shrimp fish whale kelp"


def test_cluster_counts_equal_those_of_the_text(hits, weights, group_index):
    near = feedback.nearest_hits(hits, weights, 3)
    members = clusters.cluster_members(feedback.dominant_hits(near, 2), near)
    terms = clusters.cluster_terms(members, feedback.hit_terms(hits, group_index.documents))
    row = terms.where("query_id = 1 and cluster_id = 5 and term = 'whale'").first()
    assert (row.tf, row.cluster_df) == (3, 3)
    lengths = clusters.cluster_lengths(members, feedback.hit_terms(hits, group_index.documents))
    row = lengths.where("query_id = 1 and cluster_id = 5").first()
    assert (row.dl, row.n_clusters, row.avg_length) == (9, 6, 9.0)


def test_best_cluster_has_the_terms_it_has_among_all(spark, hits, weights, group_index, rows):
    near = feedback.nearest_hits(hits, weights, 4)
    members = clusters.cluster_members(feedback.dominant_hits(near, 1), near)
    terms = feedback.hit_terms(hits, group_index.documents)
    best = spark.createDataFrame([(1, 5), (2, 8)], "query_id long, cluster_id long")
    found = clusters.best_cluster_terms(clusters.clusters_of_hits(members, best), terms)
    everything = clusters.cluster_terms(members, terms).join(best, ["query_id", "cluster_id"])
    assert rows(found) == rows(everything.select(*found.columns))


def test_term_score_formula(spark, group_index):
    terms = spark.createDataFrame(
        [(1, 1, "sun", 3, 10)], "query_id long, cluster_id long, term string, tf long, cluster_df long"
    )
    big = replace(group_index, n_docs=1000, avg_length=3.0)
    assert clusters.term_scores(terms, big).first().score == 6.0
    collection = clusters.term_scores(terms, big, "collection").first()
    assert (collection.df, collection.score) == (3, round(3 * math.log10(1000 / 3), 6))


def test_new_terms_leave_out_the_query_and_duplicates(spark, rows):
    candidates = spark.createDataFrame(
        [(1, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0), (2, "b", 4.0)], "query_id long, term string, score double"
    )
    query = spark.createDataFrame([(1, "b")], "query_id long, term string")
    assert rows(clusters.new_terms(candidates, query)) == [(1, "a", 2.0), (2, "b", 4.0)]


def test_query_without_dominant_hit_runs_unexpanded(group_index, queries, rows):
    params = KnnParams(n_neighbours=5, min_doc_c=4, top_n=5)
    run = expanded_search.knn_search(group_index, queries, params)
    plain = bm25_search(group_index, queries)
    assert rows(run.where("query_id = 2")) == rows(plain.where("query_id = 2"))
    assert rows(run.where("query_id = 1")) != rows(plain.where("query_id = 1"))


def test_document_ids_may_be_text(collection, group_index, queries, rows):
    named = collection.withColumn("doc_id", F.format_string("d%02d", "doc_id"))
    params = KnnParams(n_neighbours=3, min_doc_c=2, top_n=4)
    run = expanded_search.knn_search(build_index(named, buckets=2), queries, params)
    usual = expanded_search.knn_search(group_index, queries, params)
    assert rows(run) == rows(usual.withColumn("doc_id", F.format_string("d%02d", "doc_id")))


def step_by_step(index, queries, params):
    """The expanded search from its separate operators."""
    clauses = query_terms(queries)
    hits = expanded_search.feedback(index, clauses, params.first_ret)
    terms = feedback.hit_terms(hits, index.documents)
    members = expanded_search.knn_members(hits, terms, params)
    new = expanded_search.knn_expansion(clauses, members, terms, index, params.top_n, params.df_scope)
    return search(index, expanded_search.clauses_or_fallback(clauses, new, params.lam))


@pytest.mark.parametrize("scope", ["cluster", "collection"])
def test_search_equals_its_separate_operators(group_index, queries, rows, scope):
    for params in (KnnParams(10, 3, 2, 4, 0.6, scope), KnnParams(4, 2, 1, 3, 0.8, scope), KnnParams(10, 3, 50, 4, 0.6, scope)):
        assert rows(expanded_search.knn_search(group_index, queries, params)) == rows(step_by_step(group_index, queries, params))


def test_exchanges_of_a_grid_do_not_grow_with_its_settings(group_index, hits):
    lists = written(lattice.term_lists(hits, group_index.documents), "lists")

    def exchanges(grid):
        settings = lattice.setting_clusters(lattice.neighbour_orders(lists, [10]), grid, [10])
        return settings._jdf.queryExecution().executedPlan().toString().count("Exchange")

    grid = [KnnParams(10, k, c, 5) for k in (2, 3, 4) for c in (1, 2)]
    assert exchanges(grid) == exchanges(grid[:1])
    assert lattice.setting_clusters(lattice.neighbour_orders(lists, [10]), grid, [10]).count() <= 2


def test_grid_equals_single_searches(group_index, queries, rows):
    grid = [KnnParams(10, 3, 2, 4, 0.6), KnnParams(4, 2, 1, 3, 0.8), KnnParams(10, 3, 3, 4, 0.6)]
    runs = parameter_grid.knn_grid_runs(group_index, queries, grid).cache()
    for i, params in enumerate(grid, start=1):
        alone = expanded_search.knn_search(group_index, queries, params)
        assert rows(runs.where(f"config_id = {i}").drop("config_id")) == rows(alone)


def test_word_vector_grid_equals_single_searches(group_index, collection, queries, rows):
    grid = [
        W2vParams(vector_size=3, top_n=2, first_ret=4, lam=0.6, negative=1),
        W2vParams(vector_size=12, top_n=3, window=2, negative=2),
        W2vParams(window=1, min_count=2, negative=1),
    ]
    runs = parameter_grid.w2v_grid_runs(group_index, collection, queries, grid).cache()
    for i, params in enumerate(grid, start=1):
        alone = expanded_search.w2v_search(group_index, collection, queries, params)
        assert rows(runs.where(f"config_id = {i}").drop("config_id")) == rows(alone)


def test_best_setting_is_the_first_of_equals(spark, rows):
    means = spark.createDataFrame(
        [(1, "map", 0.5), (2, "map", 0.5), (1, "p_5", 0.1), (2, "p_5", 0.2)],
        "config_id int, metric string, mean double",
    )
    best = parameter_grid.best_settings(means, [KnnParams(), KnnParams(first_ret=50)])
    assert rows(best.select("metric", "config_id", "first_ret")) == [("map", 1, 10), ("p_5", 2, 50)]


def test_unknown_scope_is_refused():
    with pytest.raises(ValueError):
        KnnParams(df_scope="page")


# Word vectors

SMALL = W2vParams(vector_size=16, window=2, min_count=1, negative=1, top_n=3)


def plain_vectors(texts, params):
    """Components of each term by plain counting over token lists."""
    total = Counter(t for text in texts for t in text)
    counts = Counter()
    for text in texts:
        kept = [t for t in text if total[t] >= params.min_count]
        for i, term in enumerate(kept):
            for gap in range(1, params.window + 1):
                for j in (i - gap, i + gap):
                    if 0 <= j < len(kept):
                        counts[term, kept[j]] += params.window + 1 - gap
    of_term = Counter()
    for (term, _), n in counts.items():
        of_term[term] += n
    smooth = sum(n**0.75 for n in of_term.values())
    found = {}
    for (term, context), n in counts.items():
        weight = round(math.log(n * smooth / (of_term[term] * of_term[context] ** 0.75)) - math.log(max(params.negative, 1)), 6)
        if weight > 0:
            found.setdefault(term, {})[context] = weight
    return {t: dict(sorted(v.items(), key=lambda x: (-x[1], x[0]))[: params.vector_size]) for t, v in found.items()}


def token_lists(seed, n=60):
    """Animals share their contexts, metals share others."""
    rng = np.random.default_rng(seed)
    animals, metals = ["cat", "dog", "fox"], ["iron", "zinc", "lead"]
    return [["the", str(rng.choice(animals)), "eats", "food", "daily"] if k % 2 else ["melt", str(rng.choice(metals)), "in", "hot", "ovens"] for k in range(n)]


def frame_of(spark, texts_of):
    rows = [(q, k, t) for q, texts in texts_of.items() for k, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "query_id long, rank int, tokens array<string>").repartition(3)


@pytest.mark.parametrize("params", [SMALL, W2vParams(window=3, min_count=3, negative=2, vector_size=2), W2vParams(window=1, negative=0)])
def test_vectors_equal_plain_counting(spark, params):
    texts_of = {1: token_lists(1), 2: [["a", "b", "a", "b", "c"], [], ["c"], ["a", "c", "d", "e"]], 3: [["one"]]}
    found = {}
    for r in embeddings.local_vectors(frame_of(spark, texts_of), params).collect():
        found.setdefault(r.query_id, {}).setdefault(r.term, {})[r.context] = r.weight
    for query, texts in texts_of.items():
        wanted = plain_vectors(texts, params)
        assert found.get(query, {}).keys() == wanted.keys()
        for term, vector in wanted.items():
            assert found[query][term] == pytest.approx(vector, abs=2e-6)


def test_words_in_like_contexts_come_close(spark):
    tokens = frame_of(spark, {1: token_lists(2, 300)})
    probes = spark.createDataFrame([(1, "cat"), (1, "zinc"), (1, "xyz")], "query_id long, term string")
    near = embeddings.similar_terms(embeddings.local_vectors(tokens, SMALL), probes, 2).collect()
    assert {(r.q_term, r.term) for r in near} == {("cat", "dog"), ("cat", "fox"), ("zinc", "iron"), ("zinc", "lead")}
    assert min(r.score for r in near) > 0.8


def test_cosines_equal_plain_ones(spark):
    texts = token_lists(3)
    vectors = plain_vectors(texts, SMALL)
    probes = spark.createDataFrame([(1, "cat"), (1, "dog"), (1, "melt"), (2, "cat")], "query_id long, term string")
    found = embeddings.similar_terms(embeddings.local_vectors(frame_of(spark, {1: texts}), SMALL), probes, 50).collect()

    def cosine(a, b):
        length = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(c, 0) for c, x in a.items()) / length

    wanted = {
        (q, t): cosine(vectors[q], v) for q in ("cat", "dog", "melt") for t, v in vectors.items()
        if t not in ("cat", "dog", "melt") and set(v) & set(vectors[q])
    }
    assert {(r.q_term, r.term): r.score for r in found} == pytest.approx(wanted, abs=2e-6)


def test_each_query_has_its_own_vocabulary(hits, collection, group_index, rows):
    tokens = embeddings.hit_tokens(hits, collection)
    vectors = embeddings.local_vectors(tokens, SMALL)
    counts = embeddings.vocabulary(feedback.hit_terms(hits, group_index.documents), 1)
    assert rows(vectors.select("query_id", "term").distinct().exceptAll(counts.select("query_id", "term"))) == []
    assert rows(vectors) == rows(vectors)


def test_nearest_terms_are_new_and_ranked(hits, collection, queries):
    vectors = embeddings.local_vectors(embeddings.hit_tokens(hits, collection), SMALL)
    near = embeddings.similar_terms(vectors, query_terms(queries), 3).toPandas()
    assert len(near) and set(near.q_term) <= {"sun", "fish", "iron"}
    assert not set(near.term) & {"sun", "fish", "iron"}
    for _, part in near.groupby(["query_id", "q_term"]):
        assert list(part.sort_values("rank").score) == sorted(part.score, reverse=True)
        assert sorted(part["rank"]) == list(range(1, len(part) + 1)) and len(part) <= 3


def test_nearest_terms_without_known_query_term(hits, collection, spark):
    vectors = embeddings.local_vectors(embeddings.hit_tokens(hits, collection), SMALL)
    unknown = spark.createDataFrame([(1, "xyz"), (9, "sun")], "query_id long, term string")
    assert embeddings.similar_terms(vectors, unknown, 3).count() == 0


def test_balanced_terms_go_round(spark, rows):
    similar = spark.createDataFrame(
        [
            (1, "p", "a", 0.9, 1), (1, "p", "b", 0.8, 2), (1, "p", "c", 0.7, 3),
            (1, "q", "d", 0.5, 1), (1, "q", "b", 0.4, 2),
        ],
        "query_id long, q_term string, term string, score double, rank int",
    )
    found = rows(embeddings.balanced_terms(similar, 3))
    assert found == [(1, "a", 0.9, 1), (1, "b", 0.8, 3), (1, "d", 0.5, 2)]


def test_word_vector_search_repeats_and_keeps_plain_hits_at_full_weight(group_index, collection, queries, rows):
    run = expanded_search.w2v_search(group_index, collection, queries, SMALL)
    assert rows(run) == rows(expanded_search.w2v_search(group_index, collection, queries, SMALL))
    full = W2vParams(vector_size=16, min_count=1, lam=1.0)
    plain = bm25_search(group_index, queries)
    found = expanded_search.w2v_search(group_index, collection, queries, full)
    assert rows(found.where("score > 0")) == rows(plain)
