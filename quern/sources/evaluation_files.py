"""Per-query metric files, method tables and runs on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_SCHEMA = "metric string, id_q string, value double"
METHOD_SCHEMA = "id_Q bigint, map double, p_5 double, ndcg_10 double, method string"
ALL_ROW = "all"
NAME_WIDTH = 22

# Name of each metric in the files, the part of a file name that marks it, and
# the column it becomes.
METRIC_FILES = (
    ("map", "map_map", "map"),
    ("P_5", "P5_P5", "p_5"),
    ("ndcg_cut_10", "nDCG_nDCG", "ndcg_10"),
)


def metric_rows(spark: SparkSession, path: str, name_filter: str | None = None) -> DataFrame:
    """All rows of headerless tab-separated metric files below ``path``, names trimmed.

    (metric, id_q, value, method, file), ``method`` being the folder of the file.
    """
    reader = spark.read.schema(METRIC_SCHEMA).option("sep", "\t").option("recursiveFileLookup", True)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.csv(path).select(
        F.trim("metric").alias("metric"),
        "id_q",
        "value",
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("method"),
        F.col("_metadata.file_name").alias("file"),
    )


def without_summary(rows: DataFrame) -> DataFrame:
    """Query rows only, with the id as an integer ``id_Q``."""
    ids = F.col("id_q").cast("bigint").alias("id_Q")
    others = [c for c in rows.columns if c.lower() != "id_q"]
    return rows.where(F.col("id_q") != ALL_ROW).select(ids, *others)


def load_metric_file(spark: SparkSession, path: str, metric_name: str) -> DataFrame:
    """(id_Q, <metric_name>) of one metric file."""
    rows = without_summary(metric_rows(spark, path))
    return rows.select("id_Q", F.col("value").alias(metric_name))


def find_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """The one file of ``folder`` whose name contains ``pattern``."""
    found = spark.read.option("pathGlobFilter", f"*{pattern}*").text(folder).inputFiles()
    if not found:
        raise FileNotFoundError(f"no file matching {pattern!r} in {folder}")
    if len(found) > 1:
        raise ValueError(f"{len(found)} files match {pattern!r} in {folder}")
    return found[0]


def load_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Long metrics of every method folder below ``root`` in one scan: (method, metric, id_Q, value)."""
    column = F.create_map(*[F.lit(v) for name, _, col in METRIC_FILES for v in (name, col)])
    rows = without_summary(metric_rows(spark, root, "*.txt"))
    return rows.select("method", column[F.col("metric")].alias("metric"), "id_Q", "value")


def run_configuration(file: Column) -> Column:
    """Parameters that a metric file's name holds; those it lacks are null.

    ``ret`` is the short form of ``first_ret``; an underscore stands for the decimal point.
    """

    def number(name: str, form: str, digits: str, kind: str) -> Column:
        text = F.regexp_extract(file, rf"(?:^|_){form}({digits})(?=[_.]|$)", 1)
        plain = F.replace(F.nullif(text, F.lit("")), F.lit("_"), F.lit("."))
        return plain.cast(kind).alias(name)

    counts = (
        "n_neighbours", "min_doc_c", "vector_size", "window", "min_count", "negative",
        "epochs", "min_df", "top_n",
    )
    return F.struct(
        number("first_ret", "(?:first_)?ret", r"\d+", "int"),
        *[number(c, c, r"\d+", "int") for c in counts],
        *[number(c, c, r"\d+(?:_\d+)?", "double") for c in ("sample", "lambda", "k1", "b")],
    )


def read_method_tables(spark: SparkSession, root: str, name_filter: str = "*.csv") -> DataFrame:
    """All method tables below ``root`` in one scan, columns declared."""
    return (
        spark.read.schema(METHOD_SCHEMA)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name_filter)
        .csv(root)
    )


def write_method_tables(table: DataFrame, folder: str, form: str = "csv") -> None:
    """Method tables as CSV with header, or as Parquet with one folder per method."""
    if form == "csv":
        table.write.option("header", True).csv(folder)
    else:
        table.write.partitionBy("method").parquet(folder)


def write_metric_files(metrics: DataFrame, folder: str) -> None:
    """Long metrics (metric, id_q, value), with their ``all`` row, in the metric file layout."""
    names = F.create_map(*[F.lit(v) for name, _, col in METRIC_FILES for v in (col, name)])
    metrics.select(
        F.rpad(names[F.col("metric")], NAME_WIDTH, " ").alias("metric"),
        "id_q",
        F.format_string("%.4f", "value").alias("value"),
    ).write.option("sep", "\t").option("ignoreTrailingWhiteSpace", False).csv(folder)


def read_run(spark: SparkSession, folder: str) -> DataFrame:
    """A run as ``write_run`` leaves it."""
    columns = "query_id bigint, iteration string, doc_id bigint, rank int, score double, tag string"
    return spark.read.schema(columns).option("sep", " ").csv(folder)


def write_run(rows: DataFrame, folder: str) -> None:
    """A run for evaluation tools: blank-separated, no header."""
    columns = ["query_id", "iteration", "doc_id", "rank", "score", "tag"]
    rows.select(*columns).write.option("sep", " ").csv(folder)
