"""An experiment over a folder of Parquet tables: its inputs, and the tables its queries share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scoring import to_digits
from quern.functions.text import tokenize
from quern.operators.comparison import long_table
from quern.operators.evaluation import METRIC_DIGITS, METRICS, query_metrics
from quern.operators.retrieval import query_terms, search_settings
from quern.params import Bm25
from quern.sources import segments
from quern.sources.term_index import TermIndex, build_index
from quern.storage import fresh_folder, written

# Runs under comparison: plain BM25 with different k1 and b.
METHODS = {"base": (1.2, 0.75), "flat": (1.2, 0.0), "sharp": (0.4, 1.0)}
METHOD_KEY = ["method", "query_id"]
# Parts of the queries: with the usual sizes the given ones would all be in the first.
N_TRAIN, N_TEST = 20, 12


class Experiment:
    """Documents, queries and judgments from the tables of ``folder``.

    The index, the judgments and the method table are written once per session, as the steps
    of an experiment leave files for the next one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text")

    @property
    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @cached_property
    def index(self) -> TermIndex:
        return build_index(self.documents)

    @cached_property
    def grown_index(self) -> segments.Segments:
        """An index built in parts: every third document is added in turn, every seventh deleted, the smaller
        segments merged, some of the deleted ones added again, and every eleventh deleted."""
        folder, ids = fresh_folder(self.spark, "segments"), F.col("doc_id")
        for part in range(3):
            segments.add_documents(folder, self.documents.where(ids % 3 == part))
        segments.delete_documents(folder, self.documents.where(ids % 7 == 0).select("doc_id"))
        second = sorted(segments.open_segments(self.spark, folder).sizes.values())[1]
        segments.merge_segments(self.spark, folder, second)
        segments.add_documents(folder, self.documents.where(ids % 21 == 0))
        segments.delete_documents(folder, self.documents.where(ids % 11 == 0).select("doc_id"))
        return segments.open_segments(self.spark, folder)

    @cached_property
    def clauses(self) -> DataFrame:
        return written(query_terms(self.queries), "clauses")

    @cached_property
    def qrels(self) -> DataFrame:
        """Documents that contain the query's passage verbatim; the grade is 1 and the label's quality.

        Unlabelled documents have grade 1. Candidates are the documents with the passage's rarest
        term, which the index gives; the text decides. First and last terms may run on in the
        document and are left out; the few passages without an inner term are looked for everywhere.
        """
        tokens = tokenize(F.col("text"))
        inner = F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))
        passages = self.queries.where(F.length("text") > 0).select(
            "query_id", F.col("text").alias("passage"), F.explode_outer(inner).alias("term")
        )
        ranked = passages.join(self.index.statistics.select("term", "df"), "term", "left")
        rarest = written(ranked.groupBy("query_id", "passage").agg(
            F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("rarest")
        ).select("query_id", "passage", "rarest.term"), "passages")
        known = self.index.postings.join(rarest.where("term is not null"), "term").select("query_id", "doc_id", "passage")
        candidates = known.join(self.documents, "doc_id").where("contains(text, passage)").select("query_id", "doc_id")
        short = rarest.where("term is null")
        everywhere = self.documents.join(F.broadcast(short), F.expr("contains(text, passage)")).select("query_id", "doc_id")
        found = candidates.union(everywhere) if short.take(1) else candidates
        labels = self.table("labels").select("doc_id", "quality")
        grade = (1 + F.coalesce("quality", F.lit(0))).cast("int").alias("grade")
        return written(found.join(labels, "doc_id", "left").select("query_id", "doc_id", grade), "qrels")

    def method_runs(self) -> DataFrame:
        """Runs under comparison, all from one scan of the postings: (method, query_id, doc_id, score, rank)."""
        return search_settings(self.index, self.clauses, {m: Bm25(k1, b) for m, (k1, b) in METHODS.items()})

    @cached_property
    def method_table(self) -> DataFrame:
        """(id_Q, map, p_5, ndcg_10, method) of the runs under comparison, four digits."""
        return written(
            query_metrics(self.method_runs(), self.qrels, METHOD_KEY).select(
                F.col("query_id").cast("bigint").alias("id_Q"),
                *[to_digits(F.col(m), METRIC_DIGITS).alias(m) for m in METRICS],
                "method",
            ),
            "methods",
        )

    @property
    def long_methods(self) -> DataFrame:
        """(method, metric, id_Q, value) of the method table."""
        return long_table(self.method_table)

    def user_totals(self) -> DataFrame:
        """Total event value per user and type as one more paired sample; ``view`` is the base."""
        method = F.when(F.col("event_type") == "view", "base").otherwise(F.col("event_type"))
        return (
            self.table("events")
            .groupBy(method.alias("method"), F.col("user_id").cast("bigint").alias("id_Q"))
            .agg(F.round(F.sum("value"), 2).alias("value"))
            .select("method", F.lit("total").alias("metric"), "id_Q", "value")
        )

    def customer_totals(self) -> DataFrame:
        """Total price per customer and order priority, a sample of many pairs; ``1-URGENT`` is the base."""
        method = F.when(F.col("o_orderpriority") == "1-URGENT", "base").otherwise(F.col("o_orderpriority"))
        return (
            self.table("orders")
            .groupBy(method.alias("method"), F.col("o_custkey").alias("id_Q"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
            .select("method", F.lit("spent").alias("metric"), "id_Q", "value")
        )

    @property
    def samples(self) -> DataFrame:
        """All paired samples: method metrics, user totals and customer totals."""
        return self.long_methods.unionByName(self.user_totals()).unionByName(self.customer_totals())


