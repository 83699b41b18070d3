import pytest
from pyspark.sql import functions as F

from quern.functions.text import counted_terms, tokenize, whitespace_tokens
from quern.sources import term_index


def tokens(spark, function, text):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(function(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Red apples, 2 of them!", ["red", "apples", "2", "of", "them"]),
        ("  Été-coûteux\n\tß ", ["été", "coûteux", "ß"]),
        ("...", []),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, text, expected):
    assert tokens(spark, tokenize, text) == expected


def test_whitespace_tokens_keep_case_and_marks(spark):
    assert tokens(spark, whitespace_tokens, " A-b  c. ") == ["A-b", "c."]


def test_postings_count_each_document(documents, rows):
    found = rows(term_index.postings(documents).where(F.col("doc_id").isin(1, 2)))
    assert (1, "apples", 2, 5) in found
    assert (2, "red", 2, 6) in found
    assert sum(tf for doc, _, tf, _ in found if doc == 2) == 6


def test_a_tokenizer_can_be_passed(documents, rows):
    found = rows(term_index.postings(documents, whitespace_tokens).where("doc_id = 2"))
    assert (2, "RED", 1, 6) in found


def test_statistics_count_empty_documents(documents, index):
    row = term_index.length_statistics(documents).first()
    assert (row.n_docs, row.n_tokens) == (7, 27)
    assert index.n_docs == 7
    assert index.avg_length == pytest.approx(27 / 7)


def test_term_statistics_by_scope(spark, rows):
    df = spark.createDataFrame(
        [(1, 1, "a", 2), (1, 2, "a", 1), (2, 1, "a", 5)], "query_id int, doc_id int, term string, tf long"
    )
    assert rows(term_index.term_statistics(df, ["query_id"])) == [(1, "a", 2, 3), (2, "a", 1, 5)]


def test_opened_index_equals_built_one(spark, index, rows):
    again = term_index.open_index(spark, index.folder)
    assert rows(again.postings) == rows(index.postings)
    assert (again.n_docs, again.avg_length) == (index.n_docs, index.avg_length)


def test_tokenising_happens_once_and_after_the_only_exchange(documents):
    plan = term_index.postings(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("split(") == 1


def test_index_of_a_derived_frame(spark, tmp_path):
    spark.createDataFrame([(1, "red pears"), (1, "blue"), (2, "red")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    frame = spark.read.parquet(f"{tmp_path}/d").groupBy("doc_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("text"))
    index = term_index.build_index(frame)
    assert index.n_docs == 2 and index.postings.count() == 4


def test_frames_without_files_are_measured(spark):
    frame = spark.createDataFrame([(k, "x" * 1000) for k in range(50)], "doc_id long, text string")
    cores = spark.sparkContext.defaultParallelism
    assert term_index.bucket_count(frame, 1000) == max(50, cores)
    assert term_index.bucket_count(frame.where("doc_id < 0"), 1000) == cores


def test_forward_rows_and_terms_with_their_bounds(index, rows):
    forward = {r.doc_id: r for r in index.documents.collect()}
    assert [tuple(t) for t in forward[2].terms] == [("cherries", 1), ("green", 1), ("pears", 1), ("plums", 1), ("red", 2)]
    assert rows(term_index.posting_rows(index.documents).select("doc_id", "term", "tf", "dl")) == rows(index.postings.select("doc_id", "term", "tf", "dl"))
    red = index.terms.where("term = 'red'").first()
    assert (red.df, red.cf) == (3, 4) and sorted(c.doc_id for c in red.champions) == [1, 2, 5]
    assert max(p.tf for p in red.profile) == 2


def test_parts_of_postings_follow_the_size_of_the_documents(spark, documents, monkeypatch):
    """A task counts the postings of its part in memory, so parts must not grow with the collection."""
    assert term_index.BYTES_PER_BUCKET <= 16 << 20
    monkeypatch.setattr(term_index, "bucket_count", lambda documents: 23)
    plan = term_index.postings(documents)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and ", 23), REPARTITION_BY_NUM" in plan


def test_bounds_are_written_only_when_asked_for(spark, documents, rows):
    index = term_index.build_index(documents, buckets=2)
    assert "terms" not in vars(index) and index.statistics.columns == ["term", "df", "cf"]
    assert rows(index.terms.select("term", "df", "cf")) == rows(index.statistics)
    assert "terms" in vars(index)


def test_parts_follow_the_text_and_not_its_files(spark, tmp_path):
    """A file of copies is far smaller than its texts, and a filtered frame holds a part of its files."""
    copies = spark.range(0, 400, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("red pears " * 1000).alias("text"))
    copies.write.parquet(f"{tmp_path}/copies")
    frame, cores = spark.read.parquet(f"{tmp_path}/copies"), spark.sparkContext.defaultParallelism
    assert term_index.bucket_count(frame, 10_000) == 400
    assert term_index.bucket_count(frame.where("doc_id % 4 = 0"), 10_000) == max(100, cores)


def test_written_postings_lie_in_order_of_documents(spark, tmp_path):
    """Sorting the postings of a part by their terms took about a third of the time of its writing."""
    texts = [(k, " ".join(f"w{(k * j) % 17}" for j in range(30))) for k in range(200)]
    index = term_index.build_index(spark.createDataFrame(texts, "doc_id long, text string"), buckets=3)
    files = spark.read.parquet(f"{index.folder}/postings").inputFiles()
    assert len(files) == 3
    for f in files:
        ids = [r.doc_id for r in spark.read.parquet(f).coalesce(1).collect()]
        assert ids == sorted(ids)


def test_documents_are_counted_without_a_row_for_each_token(spark, documents):
    """Hashing every token of a part took half a gigabyte in a task, and its postings were then grouped again."""
    rows = [(1, "b a b", 0), (1, "a c c", 0), (1, "b", 0), (None, "x x", 0), (2, "", 0), (3, None, 0), (4, "é z Z", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, other int").repartition(3)
    found = {(r.doc_id, r.dl): [tuple(t) for t in r.terms] for r in term_index.forward_rows(frame, partitions=2).collect()}
    assert found == {
        (1, 3): [("a", 2), ("b", 2), ("c", 2)], (1, 1): [("b", 1)], (None, 2): [("x", 2)], (4, 3): [("z", 2), ("é", 1)],
    }
    plan = term_index.forward_rows(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("split(") == 1
    assert "keys=[doc_id" in plan and "term" not in "".join(line for line in plan.splitlines() if "keys=" in line)


def test_null_tokens_and_empty_lists_have_no_terms(spark):
    frame = spark.createDataFrame([([],), (["b", None, "a", "b"],), ([None],)], "tokens array<string>").coalesce(1)
    counted = frame.select(counted_terms(F.col("tokens")).alias("terms")).collect()
    assert [[tuple(t) for t in r.terms] for r in counted] == [[], [("a", 1), ("b", 2)], []]


def test_postings_are_read_off_the_written_documents(spark, index, monkeypatch):
    """Every bucket by one task: its postings lie in one file, whatever a scan of the documents would split."""
    monkeypatch.setattr(term_index, "forward_rows", None)
    again = term_index.write_index(index.documents, index.n_docs, term_index.fresh_folder(spark, "again"), index.buckets)
    assert sorted(again.postings.collect()) == sorted(index.postings.collect())
    assert sorted(again.statistics.collect()) == sorted(index.statistics.collect())
    assert (again.n_docs, again.avg_length) == (index.n_docs, index.avg_length)
