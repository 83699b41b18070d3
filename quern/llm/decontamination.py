"""Benchmark passages in documents, found in one scan by an Aho-Corasick automaton.

Items and documents are normalised to words (A-Z in lower case; runs of digits, letters and
non-ASCII characters). The automaton reads word numbers, so a match begins and ends at words and
its place is known in words; places in the original text are looked up for documents with hits.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.llm.frames import fresh_name
from quern.storage import written

WINDOW = 10
#: Words of benchmark text in one automaton (about 1 GB at the most); more make another pass.
WORDS_PER_PASS = 2_000_000

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TO_WORDS = bytes(c if c in _WORD_BYTES else 32 for c in bytes(range(256)).lower())
_ORIGINAL_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
MARK = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN)),
])


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


class Matcher:
    """The automaton of all windows of the given (item id, text) pairs."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in normal_words(text)]
            if numbers:
                for k in range(max(1, len(numbers) - window + 1)):
                    ids = owners.setdefault(tuple(numbers[k : k + window]), set())
                    if item_id is not None:
                        ids.add(item_id)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for numbers, ids in owners.items():
            self.automaton.add_word(numbers, (len(numbers), ids))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, text: str | None) -> tuple[int, list[list[int]], set[str]]:
        """Words of the text, runs [first, end) of hit words in order, ids of the items found."""
        words = normal_words(text)
        runs: list[list[int]] = []
        ids: set[str] = set()
        if words and not self.empty:
            numbers = tuple(map(self.vocabulary.get, words, itertools.repeat(0)))
            for last, (length, owners) in self.automaton.iter(numbers):
                first, end = last - length + 1, last + 1
                while runs and runs[-1][1] >= first:
                    first = min(first, runs.pop()[0])
                runs.append([first, end])
                ids |= owners
        return len(words), runs, ids


def original_spans(text: str, runs: list[list[int]]) -> list[tuple[int, int]]:
    """Runs of words as character offsets [start, stop) in the text as it was given."""
    places = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    return [(places[first][0], places[end - 1][1]) for first, end in runs]


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(runs):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def item_parts(benchmark: DataFrame, words_per_pass: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in parts of at most so many words; an item is never cut."""
    part, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null")
    for item_id, text in rows.toLocalIterator():
        n = len(normal_words(text))
        if part and size + n > words_per_pass:
            yield part
            part, size = [], 0
        part.append((item_id, text))
        size += n
    yield part


def marked(
    docs: DataFrame, benchmark: DataFrame, name: str, keep: list[str] | None = None,
    window: int = WINDOW, words_per_pass: int = WORDS_PER_PASS,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``name``: n_words, n_hit, items, spans.

    items: ids of the items with a window in the text, as sorted strings; spans: hit runs of words
    as character offsets in the original text. Null text has no words. A null item id marks words
    but is not listed; rows with equal item ids count as one item; items without words match
    nothing. Repeated rows are marked each. A benchmark too large for one automaton is scanned
    for in several passes, whose marks are joined.
    """
    spark: SparkSession = docs.sparkSession
    parts = list(item_parts(benchmark, words_per_pass)) if words_per_pass else []
    result = docs.withColumn(name, F.lit(None).cast(MARK))
    for number, part in enumerate(parts, 1):
        last = number == len(parts)
        wanted = [*(keep if keep is not None and last else docs.columns), name]
        result = _pass(spark, result, part, name, wanted, window)
        if not last:
            result = written(result, "marked")
    return result


def _pass(spark: SparkSession, docs: DataFrame, part: list, name: str, wanted: list[str], window: int) -> DataFrame:
    items = spark.sparkContext.broadcast(part)  # bounded by words_per_pass
    text_at, mark_at = docs.columns.index("text"), docs.columns.index(name)
    places = [docs.columns.index(c) for c in wanted]
    schema = T.StructType([docs.schema.fields[p] for p in places])
    mark_type = to_arrow_schema(T.StructType([T.StructField(name, MARK)])).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items.value, window)
        for batch in batches:
            marks = []
            for text, old in zip(batch.column(text_at).to_pylist(), batch.column(mark_at).to_pylist()):
                n_words, runs, ids = matcher.scan(text)
                if old and old["spans"]:
                    earlier = {m.start(): k for k, m in enumerate(_ORIGINAL_WORD.finditer(text))}
                    stops = {m.end(): k + 1 for k, m in enumerate(_ORIGINAL_WORD.finditer(text))}
                    runs = _merged([*map(tuple, runs), *((earlier[s["start"]], stops[s["stop"]]) for s in old["spans"])])
                    ids = ids | set(old["items"])
                spans = original_spans(text, runs) if runs else []
                marks.append({
                    "n_words": n_words, "n_hit": sum(end - first for first, end in runs), "items": sorted(ids),
                    "spans": [{"start": start, "stop": stop} for start, stop in spans],
                })
            columns = [pa.array(marks, mark_type) if p == mark_at else batch.column(p) for p in places]
            yield pa.RecordBatch.from_arrays(columns, wanted)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans for every row of ``docs``.

    Null and empty texts have no words and are clean; see ``marked`` for items. Repeated rows, equal and
    null ids are judged each for itself. An empty table gives no rows, an empty benchmark contaminates
    nothing. Other columns are not read.
    """
    mark = marked(docs.select("doc_id", "text"), benchmark, "mark", ["doc_id"], **options)
    return mark.select(
        "doc_id", "mark.n_words", "mark.n_hit", F.size("mark.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("mark.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("mark.n_hit") > 0).alias("contaminated"), "mark.spans",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with the columns of ``docs``, whatever their names.

    Null and empty texts stay. Repeated rows, equal and null ids are judged each for itself. An empty table
    stays empty.
    """
    name = fresh_name(docs, "mark")
    return marked(docs, benchmark, name, **options).where(F.col(name)["n_hit"] == 0).select(*docs.columns)
