"""Per-query metric files as a Spark data source: one partition a file, names carry the configuration.

``register(spark)`` makes the format ``metric_files`` known. Reading lists the files below a folder
whose names contain a pattern, and gives each row its method (the folder) and file. Writing puts the
rows of each ``file`` into the file of that name in the folder of its ``method``, staged first and moved
into place when all tasks are done, so that a failed or repeated task leaves nothing behind.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from quern.sources.evaluation_files import ALL_ROW, METRIC_FILES, NAME_WIDTH, run_configuration

FORMAT = "metric_files"
SCHEMA = "metric string, id_q string, value double, method string, file string"
STAGING = "_staging"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass
class MetricFile(InputPartition):
    path: str

    def __post_init__(self) -> None:
        super().__init__(self.path)


@dataclass
class Staged(WriterCommitMessage):
    """Files of one task: where each lies and where it belongs, relative to the folder."""

    files: list[tuple[str, str]] = field(default_factory=list)


class MetricReader(DataSourceReader):
    def __init__(self, root: str, pattern: str, single: bool):
        self.root, self.pattern, self.single = root, pattern, single

    def partitions(self) -> list[MetricFile]:
        files, folder = opened(self.root)
        found = sorted(
            info.path for info in files.get_file_info(fs.FileSelector(folder, recursive=True))
            if info.is_file and info.base_name.endswith(".txt") and self.pattern in info.base_name and f"/{STAGING}/" not in info.path
        )
        if self.single and not found:
            raise FileNotFoundError(f"no file matching {self.pattern!r} in {self.root}")
        if self.single and len(found) > 1:
            raise ValueError(f"{len(found)} files match {self.pattern!r} in {self.root}")
        return [MetricFile(path) for path in found]

    def read(self, partition: MetricFile) -> Iterator[tuple]:
        files, _ = opened(self.root)
        method, name = partition.path.split("/")[-2:]
        with files.open_input_stream(partition.path) as stream:
            for line in stream.read().decode().splitlines():  # one row a query
                if line.strip():
                    metric, id_q, value = line.split("\t")
                    yield metric.strip(), id_q.strip(), float(value), method, name


class MetricWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, folder = opened(self.root)
        message, streams = Staged(), {}
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    place = f"{row['method']}/{row['file']}"
                    if place not in streams:
                        staged = f"{STAGING}/{self.job}/{uuid.uuid4().hex}/{row['file']}"
                        files.create_dir(posixpath.dirname(f"{folder}/{staged}"), recursive=True)
                        streams[place] = files.open_output_stream(f"{folder}/{staged}")
                        message.files.append((staged, place))
                    line = f"{row['metric']:<{NAME_WIDTH}}\t{row['id_q']}\t{row['value']:.4f}\n"
                    streams[place].write(line.encode())
        finally:
            for stream in streams.values():
                stream.close()
        return message

    def commit(self, messages: list[Staged | None]) -> None:
        files, folder = opened(self.root)
        moves = [move for message in messages if message for move in message.files]
        places = [place for _, place in moves]
        if len(set(places)) < len(places):
            raise ValueError("rows of one file came from several tasks: repartition by file first")
        for staged, place in moves:
            files.create_dir(posixpath.dirname(f"{folder}/{place}"), recursive=True)
            files.move(f"{folder}/{staged}", f"{folder}/{place}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, folder = opened(self.root)
        staging = f"{folder}/{STAGING}/{self.job}"
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


class MetricFiles(DataSource):
    """Options: ``path``; ``pattern``, part of the file names; ``single``, to demand exactly one match."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MetricReader:
        return MetricReader(self.options["path"], self.options.get("pattern", ""), self.options.get("single", "false") == "true")

    def writer(self, schema, overwrite: bool) -> MetricWriter:
        return MetricWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MetricFiles)


def read_metric_files(spark: SparkSession, folder: str, pattern: str = "", single: bool = False) -> DataFrame:
    """Rows of the files below ``folder`` with the configuration their names hold.

    (metric, id_q, value, method, file, configuration struct); metrics have their column names. With
    ``single`` no match or several are an error.
    """
    register(spark)
    reader = spark.read.format(FORMAT).option("pattern", pattern).option("single", str(single).lower())
    column = F.create_map(*[F.lit(v) for name, _, col in METRIC_FILES for v in (name, col)])
    return reader.load(folder).withColumns(
        {"metric": column[F.col("metric")], "configuration": run_configuration(F.col("file"))}
    )


def file_name(method: Column, metric: Column, **parameters: Column) -> Column:
    """Name of a metric file: method, the metric's mark, and each parameter with its value.

    An underscore stands for the decimal point.
    """
    mark = F.create_map(*[F.lit(v) for _, pattern, col in METRIC_FILES for v in (col, pattern)])
    values = [F.concat(F.lit(f"_{name}"), F.replace(value.cast("string"), F.lit("."), F.lit("_"))) for name, value in parameters.items()]
    return F.concat(F.lit("Eval_Q_QE_"), method, F.lit("_"), mark[metric], *values, F.lit(".txt"))


def write_named_files(rows: DataFrame, folder: str) -> None:
    """Rows (method, metric, id_q, value, file), ``all`` rows last, as one file for each method and file name."""
    names = F.create_map(*[F.lit(v) for name, _, col in METRIC_FILES for v in (col, name)])
    register(rows.sparkSession)
    number = F.expr("try_cast(id_q as bigint)")
    (
        rows.select(names[F.col("metric")].alias("metric"), "id_q", "value", "method", "file")
        .repartition("method", "file")
        .sortWithinPartitions("method", "file", F.col("id_q") == ALL_ROW, number)
        .write.format(FORMAT).mode("append").save(folder)
    )


def metrics_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """Long metrics of all methods below ``folder``: (method, metric, id_Q, value), without summary rows.

    One file is expected for each method and metric; a second one, say of another configuration, is an
    error rather than a choice.
    """
    rows = read_metric_files(spark, folder)
    only = F.min("file").alias("only"), F.count_distinct("file").alias("n_files")
    files = rows.groupBy("method", "metric").agg(*only)
    two = F.raise_error(F.concat_ws(" ", F.lit("several files of"), "metric", F.lit("for"), "method")).cast("string")
    checked = files.select("method", "metric", F.when(F.col("n_files") > 1, two).otherwise(F.col("only")).alias("file"))
    return (
        rows.where(F.col("id_q") != ALL_ROW)
        .join(checked, ["method", "metric", "file"])
        .select("method", "metric", F.col("id_q").cast("bigint").alias("id_Q"), "value")
    )
