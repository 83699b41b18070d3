"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The characters that end a word: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file, by default that of the 50k byte-level vocabulary; small, so it goes to executors by value."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def map_rows(
    df: DataFrame, columns: list[str], row_function: Callable[..., tuple], schema: str, setup: Callable[[], object] | None = None
) -> DataFrame:
    """One output row for each input row, in Arrow batches.

    ``row_function`` gets the values of ``columns`` (after the result of ``setup``, made once a
    task) and returns a tuple in the order of ``schema``.
    """
    types = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [setup()] if setup else []
        for batch in batches:
            rows = [row_function(*state, *values) for values in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, schema=types)

    return df.select(*columns).mapInArrow(run, schema)
