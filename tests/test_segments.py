import pytest
from pyspark.sql import functions as F

from quern.operators.retrieval import query_terms, search
from quern.sources import segments
from quern.sources.term_index import build_index
from quern.storage import written

TEXTS = {
    1: "red apples and green apples", 2: "green pears red plums", 3: "the apples of the north", 4: "blue skies", 5: "blue birds and red birds",
    6: "", 7: None, 8: "red red red", 9: "birds of the north and apples", 10: "plums",
}


def frame(spark, texts):
    return spark.createDataFrame([*texts.items()], "doc_id long, text string")


@pytest.fixture(scope="module")
def clauses(spark):
    queries = spark.createDataFrame([(1, "red apples"), (2, "blue birds north"), (3, "plums"), (4, "absent")], "query_id long, text string")
    return query_terms(queries)


def same(rows, held, whole, clauses):
    assert (held.n_docs, held.avg_length) == (whole.n_docs, whole.avg_length)
    assert rows(held.terms.select("term", "df", "cf")) == rows(whole.terms.select("term", "df", "cf"))
    assert rows(held.postings) == rows(whole.postings)
    for size in (1, 3, 10):
        assert rows(segments.search_segments(held, clauses, size)) == rows(search(whole, clauses, size))


def test_parts_deletions_and_merges_equal_one_index(spark, tmp_path, rows, clauses):
    folder = str(tmp_path / "log")
    for part in ((1, 2, 3), (4, 5, 6, 7), (8, 9, 10)):
        segments.add_documents(folder, frame(spark, {k: TEXTS[k] for k in part}), buckets=2)
    same(rows, segments.open_segments(spark, folder), build_index(frame(spark, TEXTS), buckets=2), clauses)

    segments.delete_documents(folder, spark.createDataFrame([(1,), (6,), (8,), (99,), (None,)], "doc_id long"))
    left = {k: t for k, t in TEXTS.items() if k not in (1, 6, 8)}
    same(rows, segments.open_segments(spark, folder), build_index(frame(spark, left), buckets=2), clauses)

    # The same id again, with another text; deleting it twice takes it off once.
    segments.add_documents(folder, frame(spark, {1: "green birds", 11: "blue plums"}), buckets=1)
    left |= {1: "green birds", 11: "blue plums"}
    same(rows, segments.open_segments(spark, folder), build_index(frame(spark, left), buckets=2), clauses)

    before = segments.open_segments(spark, folder)
    assert segments.merge_segments(spark, folder, 3, 2)
    merged = segments.open_segments(spark, folder)
    assert (len(before.indexes), len(merged.indexes)) == (4, 1) and sum(merged.sizes.values()) == 9
    same(rows, merged, build_index(frame(spark, left), buckets=2), clauses)

    for _ in range(2):
        segments.delete_documents(folder, spark.createDataFrame([(1,), (9,)], "doc_id long"))
    left = {k: t for k, t in left.items() if k not in (1, 9)}
    same(rows, segments.open_segments(spark, folder), build_index(frame(spark, left), buckets=2), clauses)
    assert segments.merge_segments(spark, folder, 100, 2) is None


def test_nothing_added_and_everything_deleted(spark, tmp_path, clauses):
    with pytest.raises(ValueError):
        segments.open_segments(spark, str(tmp_path / "none"))
    folder = str(tmp_path / "all")
    segments.add_documents(folder, frame(spark, {1: "red", 2: "blue birds"}), buckets=1)
    segments.delete_documents(folder, spark.range(5).select(F.col("id").alias("doc_id")))
    held = segments.open_segments(spark, folder)
    assert (held.n_docs, held.avg_length, held.terms.count()) == (0, 0.0, 0)
    assert segments.search_segments(held, clauses).count() == 0


def test_steps_put_no_terms_together(spark, tmp_path, monkeypatch):
    """Only a reader that asks for the whole's terms pays for them."""
    folder, labels = str(tmp_path / "lazy"), []
    monkeypatch.setattr(segments, "written", lambda df, label: labels.append(label) or written(df, label))
    for part in ((1, 2, 3), (4, 5)):
        segments.add_documents(folder, frame(spark, {k: TEXTS[k] for k in part}), buckets=2)
    segments.delete_documents(folder, spark.createDataFrame([(1,)], "doc_id long"))
    assert segments.merge_segments(spark, folder, 10)
    held = segments.open_segments(spark, folder)
    assert "segment-terms" not in labels
    assert held.terms.where("term = 'red'").first().df == 2 and labels.count("segment-terms") == 1
    assert [i.buckets for i in held.indexes.values()] == [4]


def test_merging_moves_counted_documents(spark, tmp_path, monkeypatch):
    """A row for each document is exchanged, not one for each posting, which then had to be grouped again."""
    folder, moved = str(tmp_path / "moved"), []
    for part in ((1, 2, 3), (4, 5)):
        segments.add_documents(folder, frame(spark, {k: TEXTS[k] for k in part}), buckets=2)
    write = segments.write_index
    monkeypatch.setattr(segments, "write_index", lambda rows, *rest: moved.append(rows) or write(rows, *rest))
    assert segments.merge_segments(spark, folder, 10)
    assert moved[0].count() == 5 and moved[0].columns == ["doc_id", "dl", "terms"]
