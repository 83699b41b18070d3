"""An index that grows: written segments, a log of what was added, deleted and merged, and searches over all.

Every addition writes its documents as an index of their own, a segment. Deleting writes, for each
segment, the ids and what their documents had added to the statistics; nothing is rewritten until
segments are merged. The log has one row for each step, written after its data, so that a step that
fails leaves nothing visible. There is one writer at a time; readers see the steps made before they open.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import Tokenizer, tokenize
from quern.operators.retrieval import QUERY, search, top_hits
from quern.params import Bm25
from quern.sources.term_index import TermIndex, build_index, open_index, posting_rows, write_index
from quern.storage import written

LOG = "version long, action string, name string, replaces array<string>"


@dataclass(frozen=True)
class Segments:
    """Live segments by name; ``parts`` are their live documents, ``sizes`` how many, those without a token included.

    ``terms``, ``n_docs`` and ``avg_length`` are those of all live documents. The terms are put together when
    something first asks for them: steps that only look at documents and sizes do without.
    """

    folder: str
    parts: dict[str, TermIndex]
    sizes: dict[str, int]
    n_docs: int
    avg_length: float
    deletions: list[str]

    @cached_property
    def terms(self) -> DataFrame:
        terms = [i.statistics for i in self.parts.values()]
        if self.deletions:
            less = _of_deletions(terms[0].sparkSession, self.folder, self.deletions, "terms", [*self.parts])
            terms.append(less.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
        sums = F.sum("df").alias("df"), F.sum("cf").alias("cf")
        return written(united(terms).groupBy("term").agg(*sums).where(F.col("df") > 0), "segment-terms")

    @cached_property
    def indexes(self) -> dict[str, TermIndex]:
        """Each segment as an index of its own live documents with the whole's statistics."""
        return {s: replace(i, statistics=self.terms, n_docs=self.n_docs, avg_length=self.avg_length) for s, i in self.parts.items()}

    @property
    def postings(self) -> DataFrame:
        return united([i.postings for i in self.parts.values()])


def united(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def add_documents(
    folder: str, documents: DataFrame, tokenizer: Tokenizer = tokenize, buckets: int | None = None
) -> str:
    """Write ``documents`` (doc_id, text) as a new segment and return its name.

    A document that is live already must be deleted first.
    """
    name = f"segment-{uuid.uuid4().hex}"
    documents.select("doc_id").write.parquet(f"{folder}/{name}/ids")
    build_index(documents, f"{folder}/{name}", buckets, tokenizer)
    _log(documents.sparkSession, folder, "add", name)
    return name


def delete_documents(folder: str, ids: DataFrame) -> str:
    """Delete the documents of ``ids`` (doc_id) that are live now; later additions of the same ids stay."""
    spark = ids.sparkSession
    name = f"delete-{uuid.uuid4().hex}"
    gone = written(ids.select("doc_id").where("doc_id is not null").distinct(), "deleted-ids")
    live = open_segments(spark, folder)

    def of(segment: str, rows: DataFrame) -> DataFrame:
        return rows.join(gone, "doc_id", "left_semi").withColumn("segment", F.lit(segment))

    held = united([of(s, _live_ids(spark, folder, s)) for s in live.parts])
    held.write.parquet(f"{folder}/{name}/ids")
    rows = written(united([of(s, i.documents) for s, i in live.parts.items()]), "deleted-documents")
    posting_rows(rows).groupBy("segment", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    ).write.parquet(f"{folder}/{name}/terms")
    lengths = rows.groupBy("segment").agg(F.sum("dl").alias("n_tokens"))
    counts = spark.read.parquet(f"{folder}/{name}/ids").groupBy("segment").agg(F.count(F.lit(1)).alias("n_docs"))
    counts.join(lengths, "segment", "left").select(
        "segment", "n_docs", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")
    ).write.parquet(f"{folder}/{name}/collection")
    _log(spark, folder, "delete", name)
    return name


def merge_segments(spark: SparkSession, folder: str, most_docs: int, buckets: int | None = None) -> str | None:
    """Write the segments of at most ``most_docs`` live documents as one, without what was deleted from them.

    Counted documents are taken over as they are; no text is read. Without ``buckets`` there are as many as the merged segments
    have, as far as documents are left for them. With fewer than two such segments nothing is done.
    """
    live = open_segments(spark, folder)
    chosen = [s for s, n in live.sizes.items() if n <= most_docs]
    if len(chosen) < 2:
        return None
    buckets = buckets or merged_buckets([(live.parts[s], live.sizes[s]) for s in chosen])
    name = f"segment-{uuid.uuid4().hex}"
    united([_live_ids(spark, folder, s) for s in chosen]).write.parquet(f"{folder}/{name}/ids")
    rows = united([live.parts[s].documents for s in chosen]).repartition(buckets, "doc_id")
    write_index(rows, sum(live.sizes[s] for s in chosen), f"{folder}/{name}", buckets)
    _log(spark, folder, "merge", name, chosen)
    return name


def open_segments(spark: SparkSession, folder: str) -> Segments:
    """Open the live segments with the statistics of all their live documents."""
    steps = _steps(spark, folder)
    names = _live_names(steps)
    if not names:
        raise ValueError(f"no documents were added to {folder}")
    opened = {s: open_index(spark, f"{folder}/{s}") for s in names}
    deletions = [s.name for s in steps if s.action == "delete"]
    sizes = {s: i.n_docs for s, i in opened.items()}
    n_tokens = sum(round(i.avg_length * i.n_docs) for i in opened.values())
    touched = set()
    if deletions:
        for row in _of_deletions(spark, folder, deletions, "collection", names).collect():  # one row a deletion and segment
            sizes[row.segment] -= row.n_docs
            n_tokens -= row.n_tokens
            touched.add(row.segment)
    n_docs = sum(sizes.values())
    parts = {s: _without(spark, folder, s, i, deletions if s in touched else []) for s, i in opened.items()}
    return Segments(folder, parts, sizes, n_docs, n_tokens / n_docs if n_docs else 0.0, deletions)


def merged_buckets(parts: Sequence[tuple[TermIndex, int]]) -> int:
    """Buckets for the live documents of several segments, each with their number, at the segments' own fill."""
    return max(1, math.ceil(sum(i.buckets * live / i.n_docs for i, live in parts if live)))


def search_segments(
    segments: Segments, clauses: DataFrame, size: int = 10, key: Sequence[str] = QUERY, bm25: Bm25 = Bm25()
) -> DataFrame:
    """Best ``size`` documents per key over all segments, as one index of all documents would rank them.

    Every segment returns its own best, so only these meet.
    """
    found = united([search(i, clauses, size, key, bm25) for i in segments.indexes.values()])
    return top_hits(found, size, key)


def _steps(spark: SparkSession, folder: str) -> list:
    """All steps in order; the log has one row for each."""
    try:
        return spark.read.schema(LOG).parquet(f"{folder}/log").orderBy("version").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def _log(spark: SparkSession, folder: str, action: str, name: str, replaces: Sequence[str] = ()) -> None:
    version = len(_steps(spark, folder)) + 1
    row = spark.createDataFrame([(version, action, name, [*replaces])], LOG)
    row.coalesce(1).write.mode("append").parquet(f"{folder}/log")


def _live_names(steps: list) -> list[str]:
    replaced = {name for s in steps for name in s.replaces}
    return [s.name for s in steps if s.action in ("add", "merge") and s.name not in replaced]


def _of_deletions(spark: SparkSession, folder: str, deletions: Sequence[str], table: str, segments: Sequence[str]) -> DataFrame:
    """What the deletions took off ``segments``, from one of their tables."""
    return spark.read.parquet(*[f"{folder}/{d}/{table}" for d in deletions]).where(F.col("segment").isin(*segments))


def _gone(spark: SparkSession, folder: str, segment: str, deletions: Sequence[str]) -> DataFrame:
    rows = spark.read.parquet(*[f"{folder}/{d}/ids" for d in deletions])
    return rows.where(F.col("segment") == segment).select("doc_id")


def _live_ids(spark: SparkSession, folder: str, segment: str) -> DataFrame:
    """Ids of the segment's live documents."""
    ids = spark.read.parquet(f"{folder}/{segment}/ids")
    deletions = [s.name for s in _steps(spark, folder) if s.action == "delete"]
    return ids.join(_gone(spark, folder, segment, deletions), "doc_id", "left_anti") if deletions else ids


def _without(spark: SparkSession, folder: str, segment: str, index: TermIndex, deletions: Sequence[str]) -> TermIndex:
    if not deletions:
        return index
    gone = _gone(spark, folder, segment, deletions)
    return replace(
        index,
        postings=index.postings.join(gone, "doc_id", "left_anti"),
        documents=index.documents.join(gone, "doc_id", "left_anti"),
    )
