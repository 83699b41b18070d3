"""Registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles
from quern import KnnParams, W2vParams
from quern.functions.scoring import collection_weight
from quern.functions.text import arrow_words, tokenize, vectorised, whitespace_tokens
from quern.operators import bounded, clusters, comparison, embeddings, evaluation, feedback, retrieval, significance, vector_search
from quern.plans import expanded_search, parameter_grid
from quern.plans.experiment import METHODS, N_TEST, N_TRAIN, Experiment
from quern.plans.method_report import method_report
from quern.sources import evaluation_files, metric_source, segments, term_index
from quern.storage import fresh_folder, written

try:
    import quern.llm.queries as llm_queries
except ImportError:
    llm_queries = None

KNN = KnnParams(min_doc_c=4)
STRICT_KNN = KnnParams(n_neighbours=3, min_doc_c=6)
W2V = W2vParams(min_count=2)
GRID = [KnnParams(*setting) for setting in oracles.GRID]
METHOD_KEY = ["method", "query_id"]

_experiments: dict[tuple[str, str], Experiment] = {}


def experiment(spark: SparkSession, sf_dir: str) -> Experiment:
    """One experiment per session and folder, so that its queries share the written index."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _experiments:
        _experiments[key] = Experiment(spark, str(sf_dir))
    return _experiments[key]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: BM25 top ten of every query."""
    return bm25_topk(experiment(spark, "/root/testdata/sf0.001"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Index

def tokenize_documents(e: Experiment) -> DataFrame:
    tokens = e.documents.select("doc_id", tokenize(F.col("text")).alias("tokens"))
    return tokens.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("normalized")
    )


def tokenize_by_blanks(e: Experiment) -> DataFrame:
    """Term statistics of the tokens between blanks, through the tokenizer argument."""
    return term_index.term_statistics(term_index.postings(e.documents, whitespace_tokens))


def tokenize_vectorised(e: Experiment) -> DataFrame:
    """Term statistics by a tokenizer that works on Arrow arrays."""
    return term_index.term_statistics(term_index.postings(e.documents, vectorised(arrow_words)))


def postings_build(e: Experiment) -> DataFrame:
    return term_index.postings(e.documents)


def term_df(e: Experiment) -> DataFrame:
    return term_index.term_statistics(term_index.postings(e.documents))


def doc_length_stats(e: Experiment) -> DataFrame:
    return rounded(term_index.length_statistics(e.documents), 6, "avg_length")


# Retrieval

def bm25_topk(e: Experiment) -> DataFrame:
    return retrieval.bm25_search(e.index, e.queries)


def bounded_topk(e: Experiment) -> DataFrame:
    return bounded.bounded_search(e.index, e.clauses)


def bounded_short(e: Experiment) -> DataFrame:
    """Queries of four words, the sixth to the ninth of each passage."""
    words = F.array_join(F.slice(tokenize(F.col("text")), 6, 4), " ")
    return bounded.bounded_search(e.index, retrieval.query_terms(e.queries.withColumn("text", words)))


def feedback_docs(e: Experiment) -> DataFrame:
    return retrieval.bm25_search(e.index, e.queries, 20)


def run_export(e: Experiment) -> DataFrame:
    return retrieval.run_rows(bm25_topk(e), "base")


def run_file_round_trip(e: Experiment) -> DataFrame:
    folder = fresh_folder(e.spark, "run")
    evaluation_files.write_run(run_export(e), folder)
    return evaluation_files.read_run(e.spark, folder)


def weighted_search(e: Experiment) -> DataFrame:
    """Query terms at 0.7 and the ten strongest terms of the first hit at 0.3."""
    first = retrieval.search(e.index, e.clauses, 1)
    terms = feedback.hit_terms(written(first, "hits"), e.index.documents).join(
        e.index.statistics.select("term", "df"), "term"
    )
    score = collection_weight(F.col("tf"), F.lit(e.index.n_docs), F.col("df"))
    strongest = clusters.top_terms(terms.withColumn("score", score), 10)
    new = strongest.select("query_id", "term", F.lit(1.0).alias("boost"))
    return retrieval.search(e.index, retrieval.weighted_clauses(e.clauses, new, 0.7))


# An index that grows

def segment_search(e: Experiment) -> DataFrame:
    return segments.search_segments(e.grown_index, e.clauses)


def segment_terms(e: Experiment) -> DataFrame:
    return e.grown_index.terms.select("term", "df", "cf")


# Evaluation

def base_metrics(e: Experiment) -> DataFrame:
    return rounded(evaluation.query_metrics(bm25_topk(e), e.qrels), 6, *evaluation.METRICS)


def precision_at_5(e: Experiment) -> DataFrame:
    return base_metrics(e).select("query_id", "p_5")


def average_precision(e: Experiment) -> DataFrame:
    return base_metrics(e).select("query_id", F.col("map").alias("ap"))


def ndcg_at_10(e: Experiment) -> DataFrame:
    return base_metrics(e).select("query_id", "ndcg_10")


def mean_ap(e: Experiment) -> DataFrame:
    metrics = evaluation.query_metrics(e.method_runs(), e.qrels, METHOD_KEY)
    return metrics.groupBy("method").agg(F.round(F.avg("map"), 6).alias("map"))


def eval_with_all_row(e: Experiment) -> DataFrame:
    return evaluation.with_all_row(e.long_methods.withColumnRenamed("id_Q", "query_id"), ["method", "metric"])


# Files and method tables

def metric_files(e: Experiment) -> str:
    """Folder with a file for each method and metric, named by its configuration."""
    settings = F.create_map(*[F.lit(x) for m, s in METHODS.items() for x in (m, F.array(*map(F.lit, s)))])[F.col("method")]
    name = metric_source.file_name(F.col("method"), F.col("metric"), k1=settings[0], b=settings[1])
    folder = fresh_folder(e.spark, "metric-files")
    metric_source.write_named_files(eval_with_all_row(e).withColumn("file", name), folder)
    return folder


def metric_file_load(e: Experiment) -> DataFrame:
    """All metric files of all methods, with the parameters in their names."""
    rows = evaluation_files.without_summary(metric_source.read_metric_files(e.spark, metric_files(e)))
    return rows.select("method", "metric", "id_Q", "value", "configuration.k1", "configuration.b")


def metric_file_find(e: Experiment) -> DataFrame:
    """The one file of the baseline's folder whose name marks it as average precision."""
    folder = metric_files(e)
    rows = metric_source.read_metric_files(e.spark, f"{folder}/base", "map_map", single=True)
    return evaluation_files.without_summary(rows).select("id_Q", F.col("value").alias("map"))


def metric_files_combined(e: Experiment) -> DataFrame:
    """Method tables from the files of all metrics."""
    return comparison.combine_metrics(metric_source.metrics_of_files(e.spark, metric_files(e)))


def method_table_scan(e: Experiment) -> DataFrame:
    folder = fresh_folder(e.spark, "method-tables")
    evaluation_files.write_method_tables(e.method_table, folder)
    return evaluation_files.read_method_tables(e.spark, folder)


def metrics_combine(e: Experiment) -> DataFrame:
    return comparison.combine_metrics(e.long_methods)


def method_preview(e: Experiment) -> DataFrame:
    return comparison.preview(e.method_table)


def query_range_filter(e: Experiment) -> DataFrame:
    base = e.method_table.where(F.col("method") == "base")
    return comparison.id_range(base, 10, 29, ["id_Q", "map"])


def method_stack(e: Experiment) -> DataFrame:
    table = e.method_table
    return comparison.stack_methods(
        table.where(F.col("method") == "base"), table.where(F.col("method") == "flat")
    )


def method_diff(e: Experiment) -> DataFrame:
    return comparison.method_difference(comparison.paired(e.long_methods))


def method_means(e: Experiment) -> DataFrame:
    return comparison.method_means(e.method_table)


def mean_diff(e: Experiment) -> DataFrame:
    return comparison.mean_difference(e.samples)


def diff_extremes(e: Experiment) -> DataFrame:
    return comparison.difference_extremes(
        comparison.method_difference(comparison.paired(e.samples))
    )


# Significance

def paired_ttest(e: Experiment) -> DataFrame:
    tested = significance.paired_t_test(comparison.paired(e.samples))
    return rounded(tested, 6, "mean_d", "sd_d", "t", "p")


def wilcoxon(e: Experiment) -> DataFrame:
    return rounded(significance.wilcoxon(comparison.paired(e.samples)), 6, "z", "p")


def wilcoxon_exact(e: Experiment) -> DataFrame:
    """Exact p-values of the methods' metrics."""
    tested = significance.wilcoxon(comparison.paired(e.long_methods), method="exact")
    return rounded(tested, 6, "z", "p")


def significance_verdict(e: Experiment) -> DataFrame:
    verdicts = significance.verdicts(comparison.paired(e.samples))
    return rounded(verdicts, 6, "mean_difference", "p_t", "p_wilcoxon")


def full_report(e: Experiment) -> DataFrame:
    return rounded(method_report(e.samples), 6, "p_t", "p_wilcoxon")


# Expansion from neighbours

def knn_hits(e: Experiment) -> DataFrame:
    return expanded_search.feedback(e.index, e.clauses, KNN.first_ret)


def knn_terms(e: Experiment, hits: DataFrame) -> DataFrame:
    return written(feedback.hit_terms(hits, e.index.documents), "hit-terms")


def tfidf_l2(e: Experiment) -> DataFrame:
    return rounded(feedback.tfidf_l2(knn_terms(e, knn_hits(e))), 9, "weight")


def knn_neighbours(e: Experiment) -> DataFrame:
    hits = knn_hits(e)
    weights = feedback.tfidf_l2(knn_terms(e, hits))
    return feedback.nearest_hits(hits, weights, KNN.n_neighbours)


def knn_dominant_docs(e: Experiment) -> DataFrame:
    return feedback.dominant_hits(knn_neighbours(e), KNN.min_doc_c)


def knn_members(e: Experiment) -> tuple[DataFrame, DataFrame]:
    """Members of the clusters, and the postings of the hits."""
    hits = knn_hits(e)
    terms = knn_terms(e, hits)
    return expanded_search.knn_members(hits, terms, KNN), terms


def cluster_documents(e: Experiment) -> DataFrame:
    members, _ = knn_members(e)
    return clusters.cluster_texts(members, e.documents)


def best_cluster(e: Experiment) -> DataFrame:
    return clusters.best_clusters(e.clauses, *knn_members(e))


def cluster_term_scores(e: Experiment) -> DataFrame:
    """Scores with document frequency over the clusters, and over the collection."""
    terms = written(clusters.cluster_terms(*knn_members(e)), "cluster-terms")
    key = ["query_id", "cluster_id", "term"]
    over_collection = clusters.term_scores(terms, e.index, "collection").select(
        *key, F.col("df").alias("collection_df"), F.col("score").alias("collection_score")
    )
    return clusters.term_scores(terms, e.index).join(over_collection, key)


def cluster_top_terms(e: Experiment) -> DataFrame:
    return expanded_search.knn_expansion(e.clauses, *knn_members(e), e.index, KNN.top_n)


def qe_term_filter(e: Experiment) -> DataFrame:
    scores = clusters.term_scores(clusters.cluster_terms(*knn_members(e)), e.index)
    return clusters.new_terms(scores, e.clauses)


def knn_qe_search(e: Experiment) -> DataFrame:
    """Default clusters, and a threshold that leaves some queries to the unexpanded search."""
    runs = parameter_grid.knn_grid_runs(e.index, e.queries, [KNN, STRICT_KNN])
    part = F.when(F.col("config_id") == 1, "dominant").otherwise("strict")
    return runs.withColumn("part", part).drop("config_id")


def query_split(e: Experiment) -> DataFrame:
    return evaluation.split_queries(e.queries, N_TRAIN, N_TEST)


def param_grid(e: Experiment) -> DataFrame:
    train = query_split(e).where(F.col("part") == "train")
    runs = parameter_grid.knn_grid_runs(e.index, e.queries.join(train, "query_id"), GRID)
    best = parameter_grid.best_settings(parameter_grid.grid_means(runs, e.qrels), GRID)
    return best.drop("df_scope")


def grid_test_metrics(e: Experiment) -> DataFrame:
    """The setting that is best on the train part, for each metric, and its mean on the test part."""
    parts = query_split(e).where(F.col("part") != "unused")
    runs = written(parameter_grid.knn_grid_runs(e.index, e.queries.join(parts, "query_id"), GRID), "grid-runs")

    def means(part: str) -> DataFrame:
        return parameter_grid.grid_means(runs.join(parts.where(F.col("part") == part), "query_id").drop("part"), e.qrels)

    best = parameter_grid.best_settings(written(means("train"), "train-means"), GRID).select("metric", "config_id")
    return best.join(means("test"), ["metric", "config_id"]).withColumnRenamed("mean", "test_mean")


# Expansion from word vectors

def w2v_vocab(e: Experiment) -> DataFrame:
    hits = expanded_search.feedback(e.index, e.clauses, W2V.first_ret)
    return embeddings.vocabulary(feedback.hit_terms(hits, e.index.documents), W2V.min_count)


def w2v_local_vectors(e: Experiment) -> DataFrame:
    hits = expanded_search.feedback(e.index, e.clauses, W2V.first_ret)
    return embeddings.local_vectors(embeddings.hit_tokens(hits, e.documents), W2V)


def term_similarity(e: Experiment) -> DataFrame:
    """The ten nearest vectors of every hundredth vector among all."""
    vectors = e.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector_search.nearest_vectors(vectors, vectors.where(F.col("id") % 100 == 0))


def w2v_terms(e: Experiment) -> DataFrame:
    hits = expanded_search.feedback(e.index, e.clauses, W2V.first_ret)
    return expanded_search.w2v_expansion(hits, e.documents, e.clauses, W2V)


def w2v_qe_search(e: Experiment) -> DataFrame:
    return expanded_search.w2v_search(e.index, e.documents, e.queries, W2V)


QUERIES = {
    "tokenize": tokenize_documents,
    "method_report": full_report,
    **{
        f.__name__: f
        for f in (
            postings_build, term_df, doc_length_stats,
            tokenize_by_blanks, tokenize_vectorised, bm25_topk, bounded_topk, bounded_short, feedback_docs, run_export, run_file_round_trip, weighted_search,
            segment_search, segment_terms,
            precision_at_5, average_precision, ndcg_at_10, mean_ap, eval_with_all_row,
            metric_file_load, metric_file_find, metric_files_combined, method_table_scan, metrics_combine, method_preview,
            query_range_filter, method_stack, method_diff, method_means, mean_diff, diff_extremes,
            paired_ttest, wilcoxon, wilcoxon_exact, significance_verdict,
            tfidf_l2, knn_neighbours, knn_dominant_docs, cluster_documents, best_cluster,
            cluster_term_scores, cluster_top_terms, qe_term_filter, knn_qe_search,
            query_split, param_grid, grid_test_metrics,
            w2v_vocab, w2v_local_vectors, term_similarity, w2v_terms, w2v_qe_search,
        )
    },
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(build: Callable[[Experiment], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(experiment(spark, sf_dir))

    own = {name: run(build) for name, build in QUERIES.items()}
    return own | (llm_queries.QUERIES if llm_queries else {})


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | (llm_queries.ORACLES if llm_queries else {})
