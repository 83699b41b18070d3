"""Postings, forward index, term statistics and collection size of a table of documents."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.scoring import bm25_saturation
from quern.functions.text import Tokenizer, counted_terms, tokenize
from quern.params import Bm25
from quern.storage import fresh_folder, setting, written

#: Text of a bucket. A task holds its postings while it counts them, at some forty bytes for each of the text.
BYTES_PER_BUCKET = 12 << 20
#: Postings of a term that its statistics carry along, those of the largest saturation.
CHAMPIONS = 16


@dataclass(frozen=True)
class TermIndex:
    """Written index: one shard of whole documents per bucket.

    ``postings`` (doc_id, term, tf, dl) is bucketed by ``doc_id``, so scores of a document add
    up inside one task. ``documents`` (doc_id, dl, terms array of (term, tf)) is the forward index, in
    the same buckets. Both are in order of doc_id, a number that sorts without looking at terms. ``statistics`` holds (term, df, cf). ``terms`` has beside them (profile,
    champions): for each class of document lengths the shortest length and the largest tf, which bound what the term
    can add to a score there; and the term's best few postings. Only a bounded search needs these, and they cost more
    than the postings to put together, so they are written when first asked for.
    """

    postings: DataFrame
    documents: DataFrame
    statistics: DataFrame
    n_docs: int
    avg_length: float
    folder: str
    buckets: int

    @cached_property
    def terms(self) -> DataFrame:
        return written(term_table(self.postings, self.avg_length), "terms")


def length_class(dl: Column) -> Column:
    """Two classes for each doubling of a document's length."""
    return F.floor(2 * F.log2(dl)).cast("int")


def postings(
    documents: DataFrame, tokenizer: Tokenizer = tokenize, partitions: int | None = None
) -> DataFrame:
    """(doc_id, term, tf, dl) with ``dl`` the document's token count; one row per document in the input.

    The text is the only thing shuffled. Rows of a document then stay together, so counting
    by (doc_id, term) needs no second exchange. The outer explode keeps Spark from adding a
    tokenising filter below the shuffle. Without ``partitions`` their number follows the size of the
    documents, as a task holds all postings of its part.
    """
    return (
        documents.select("doc_id", "text")
        .repartition(partitions or bucket_count(documents), "doc_id")
        .select("doc_id", tokenizer(F.col("text")).alias("tokens"))
        .select("doc_id", F.size("tokens").cast("long").alias("dl"), "tokens")
        .select("doc_id", "dl", F.explode_outer("tokens").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("doc_id", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
        .select("doc_id", "term", "tf", "dl")
    )


def term_statistics(postings: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Document and collection frequency of each term, within ``scope`` columns if given."""
    return postings.groupBy(*(scope or []), "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )


def length_statistics(documents: DataFrame, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """One row: number of documents, tokens, and mean document length."""
    return (
        documents.select(F.size(tokenizer(F.col("text"))).alias("dl"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("n_tokens"))
        .withColumn("avg_length", F.col("n_tokens") / F.col("n_docs"))
    )


def forward_rows(
    documents: DataFrame, tokenizer: Tokenizer = tokenize, partitions: int | None = None
) -> DataFrame:
    """(doc_id, dl, terms): ``dl`` the document's token count, ``terms`` its (term, tf) in order of the terms.

    The text is the only thing shuffled; documents are counted where they lie. Rows of one id and length count as one
    document. Those without tokens are left out after the grouping, which keeps Spark from adding a tokenising filter
    below the shuffle. Without ``partitions`` their number follows the size of the documents, as a task groups its part.
    """
    tokens = (
        documents.select("doc_id", "text")
        .repartition(partitions or bucket_count(documents), "doc_id")
        .select("doc_id", tokenizer(F.col("text")).alias("tokens"))
        .select("doc_id", F.size("tokens").cast("long").alias("dl"), "tokens")
        .groupBy("doc_id", "dl")
        .agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
        .where(F.size("tokens") > 0)
    )
    return tokens.select("doc_id", "dl", counted_terms(F.col("tokens")).alias("terms"))


def posting_rows(documents: DataFrame) -> DataFrame:
    """The postings of rows of a forward index, with any further columns."""
    others = [c for c in documents.columns if c not in ("terms", "dl")]
    return documents.select(*others, "dl", F.explode("terms").alias("entry")).select(*others, "entry.term", "entry.tf", "dl")


def term_table(postings: DataFrame, avg_length: float) -> DataFrame:
    """(term, df, cf, profile, champions) of all terms; see ``TermIndex``.

    A profile has at most some 60 entries and there are at most ``CHAMPIONS`` champions, so no list grows
    with the collection. The best postings are cut down in every task before they meet.
    """
    by_class = postings.groupBy("term", length_class(F.col("dl")).alias("length_class")).agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.min("dl").alias("dl"), F.max("tf").alias("tf")
    )
    counts = by_class.groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf"),
        F.sort_array(F.collect_list(F.struct("length_class", "dl", "tf"))).alias("profile"),
    )
    impact = bm25_saturation(F.col("tf"), F.col("dl"), F.lit(avg_length or 1.0), Bm25())
    best = Window.partitionBy("term").orderBy(F.desc("impact"), "doc_id")
    champions = (
        postings.select("term", "doc_id", "tf", "dl", impact.alias("impact"))
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= CHAMPIONS)
        .groupBy("term")
        .agg(F.collect_list(F.struct("doc_id", "tf", "dl")).alias("champions"))
    )
    return counts.join(champions, "term")


def build_index(
    documents: DataFrame,
    folder: str | None = None,
    buckets: int | None = None,
    tokenizer: Tokenizer = tokenize,
    bytes_per_bucket: int = BYTES_PER_BUCKET,
) -> TermIndex:
    """Write the index of ``documents`` (doc_id, text) under ``folder``, or a fresh shared one."""
    spark = documents.sparkSession
    folder = folder or fresh_folder(spark, "index")
    buckets = buckets or bucket_count(documents, bytes_per_bucket)
    n_docs = documents.agg(F.count(F.lit(1))).first()[0]
    return write_index(forward_rows(documents, tokenizer, buckets), n_docs, folder, buckets)


def write_index(rows: DataFrame, n_docs: int, folder: str, buckets: int) -> TermIndex:
    """Write the index of a forward index (doc_id, dl, terms) of ``n_docs`` documents.

    The postings are read off the written documents, bucket by bucket and in their order, so that nothing is
    counted, grouped or moved for them.
    """
    spark = rows.sparkSession
    _write_bucketed(rows, f"{folder}/documents", buckets)
    with setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
        held = _bucketed(spark, f"{folder}/documents", buckets)
        _write_bucketed(posting_rows(held), f"{folder}/postings", buckets)
    term_statistics(_bucketed(spark, f"{folder}/postings", buckets)).write.parquet(f"{folder}/terms")
    n_tokens = spark.read.parquet(f"{folder}/terms").agg(F.sum("cf")).first()[0] or 0
    collection = spark.range(1).select(
        F.lit(n_docs).cast("long").alias("n_docs"), F.lit(n_tokens).cast("long").alias("n_tokens"), F.lit(buckets).alias("buckets")
    )
    collection.write.parquet(f"{folder}/collection")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> TermIndex:
    """Open a written index; its tables are declared with their buckets."""
    collection = spark.read.parquet(f"{folder}/collection").first()
    n_docs, n_tokens, buckets = collection["n_docs"], collection["n_tokens"], collection["buckets"]
    return TermIndex(
        postings=_bucketed(spark, f"{folder}/postings", buckets),
        documents=_bucketed(spark, f"{folder}/documents", buckets),
        statistics=spark.read.parquet(f"{folder}/terms"),
        n_docs=n_docs,
        avg_length=n_tokens / n_docs if n_docs else 0.0,
        folder=folder,
        buckets=buckets,
    )


def _write_bucketed(df: DataFrame, path: str, buckets: int) -> None:
    staging = f"quern_staging_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", path).saveAsTable(staging)
    df.sparkSession.sql(f"DROP TABLE {staging}")  # external: only the name goes, the files stay


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    table = f"quern_index_{uuid.uuid4().hex}"
    columns = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in spark.read.parquet(path).schema)
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet "
        f"CLUSTERED BY (doc_id) SORTED BY (doc_id) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def bucket_count(documents: DataFrame, bytes_per_bucket: int = BYTES_PER_BUCKET) -> int:
    """Buckets for the size of the texts of ``documents``, at least one per core.

    The texts themselves are measured: files may be compressed to any part of them, and a frame may hold a part of
    its files. Shards keep their size however large the collection is.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0]
    return max(documents.sparkSession.sparkContext.defaultParallelism, math.ceil((size or 0) / bytes_per_bucket))
