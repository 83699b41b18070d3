"""Near-duplicate groups by SimHash, with candidate keys from a Golay code.

A fingerprint has 64 bits, in segments of 22, 21 and 21. Two fingerprints that differ in at most
two bits agree in one segment entirely, and then differ in at most one bit in one of the other
two. The three key families below (exact segment, fuzzy segment) cover every such case.
A fuzzy segment is read as a word of the perfect Golay code [23, 12]: each of the 2**23 words has
exactly one codeword within three bits. Decoding a segment gives that codeword's index; a
segment one bit away has the index of one of the first segment's neighbours, of which there are
six different ones at most. So a fingerprint lists its own index once and its neighbours'
indices, and a pair meets where one's own index is in the other's list.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.components import connected_components
from quern.llm.frames import fresh_name, map_rows
from quern.storage import written

SEED = 42
#: Bit offset and width of each segment; padding up to 23 bits never differs.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: (exact segment, fuzzy segment) of each key family.
FAMILIES = ((0, 1), (1, 2), (2, 0))
#: Generator polynomial of the Golay code, of degree 11.
GENERATOR = 0b110001110101
#: A key that more fingerprints than this have as their own is not joined pair by pair.
PAIRED = 64

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word windows of a text as a signed 64-bit number; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        windows = iter([b" ".join(words)])
        n = 1
    else:
        windows = map(b" ".join, zip(*(words[k:] for k in range(width))))
        n = len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, windows, itertools.repeat(SEED)), np.uint64, n)
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    ones = np.stack([np.bincount(octets[:, k], minlength=256) for k in range(8)]) @ _BITS
    number = np.packbits(ones.reshape(64) * 2 > n, bitorder="little").view("<i8")[0]
    return int(number)


def _remainders(words: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ GENERATOR << (bit - 11), words)
    return words


class Golay:
    """Index of the codeword nearest to each 23-bit word."""

    def __init__(self) -> None:
        self._low, self._high = _remainders(np.arange(1 << 12)), _remainders(np.arange(1 << 11) << 12)
        self._error = np.zeros(1 << 11, np.int64)
        for weight in (1, 2, 3):
            errors = np.array([sum(1 << b for b in c) for c in itertools.combinations(range(23), weight)])
            self._error[_remainders(errors)] = errors

    def index(self, words: np.ndarray) -> np.ndarray:
        remainder = self._low[words & 0xFFF] ^ self._high[words >> 12]
        return (words ^ self._error[remainder]) >> 11


def key_rows(fingerprints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the position of the fingerprint of each, and whether the key is its own."""
    numbers = fingerprints.view(np.uint64)
    segment = [((numbers >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    keys, places, own = [], [], []
    for family, (exact, fuzzy) in enumerate(FAMILIES):
        flips = np.concatenate([[0], 1 << np.arange(SEGMENTS[fuzzy][1])])
        near = golay.index(segment[fuzzy][:, None] ^ flips)
        first = near[:, :1]
        rest = np.sort(near[:, 1:], axis=1)
        fresh = (rest != first) & np.concatenate([np.ones((len(rest), 1), bool), rest[:, 1:] != rest[:, :-1]], axis=1)
        base = (segment[exact] << 2 | family) << 12
        row, column = np.nonzero(fresh)
        keys += [base | first[:, 0], base[row] | rest[row, column]]
        places += [np.arange(len(numbers)), row]
        own += [np.ones(len(numbers), bool), np.zeros(len(row), bool)]
    return np.concatenate(keys), np.concatenate(places), np.concatenate(own)


def golay_keys(fingerprints: DataFrame) -> DataFrame:
    """key, fingerprint, own: three own keys and up to fifteen others for each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            if len(numbers):
                keys, places, own = key_rows(numbers, golay)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(numbers[places]), pa.array(own)], ["key", "fingerprint", "own"]
                )

    return fingerprints.select("fingerprint").mapInArrow(run, "key long, fingerprint long, own boolean")


def links(fingerprints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """a, b: links that join up every two different fingerprints at two bits or fewer.

    Fingerprints are compared pair by pair under keys of at most ``paired`` own members. Under
    larger keys (thousands of slightly different copies) each member lists all numbers one bit
    away from it in the two segments that may differ; members that list the same number are at
    two bits or fewer, and at most 44 can do so, whatever the size of the key.
    """
    keys = golay_keys(fingerprints)
    own = keys.where("own").select("key", F.col("fingerprint").alias("a"))
    hot = written(own.groupBy("key").count().where(F.col("count") > paired).select("key"), "hot-keys")
    pairs = (
        own.join(hot, "key", "left_anti").join(keys.select("key", F.col("fingerprint").alias("b")), "key")
        .where("a < b and bit_count(a ^ b) <= 2").select("a", "b")
    )
    members = keys.join(hot, "key", "left_semi").select("fingerprint", F.expr("(key >> 12) & 3").alias("family")).distinct()
    masks = [[1 << b for k, (at, w) in enumerate(SEGMENTS) if k != exact for b in range(at, at + w)] for exact, _ in FAMILIES]
    signed = [[m - (1 << 64) if m >> 63 else m for m in family] for family in masks]
    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(m).cast("long") for m in family)) for family in signed))
    near = members.select(
        "family", "fingerprint",
        F.explode(F.transform(F.get(flips, F.col("family").cast("int")), lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("number"),
    )
    stars = near.groupBy("family", "number").agg(F.collect_set("fingerprint").alias("all"), F.min("fingerprint").alias("a"))
    starred = stars.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a != b")
    return pairs.union(starred)


def fingerprints(docs: DataFrame) -> DataFrame:
    return map_rows(docs, ["doc_id", "text"], lambda doc_id, text: (doc_id, fingerprint(text)), "doc_id long, fingerprint long")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, fingerprint of each row; and fingerprint, component_id, chosen for each different one.

    ``chosen`` is the fingerprint of the group's document with the smallest id.
    """
    rows = written(fingerprints(docs), "fingerprints")
    different = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "different-fingerprints")
    roots = written(connected_components(links(different)), "components")
    placed = different.join(roots, different["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    placed = written(placed, "placed-fingerprints")
    smallest = F.struct(F.col("first").isNull().alias("none"), "first", "fingerprint")
    groups = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.min_by("fingerprint", smallest).alias("chosen"))
    return rows, placed.join(groups, "root").select("fingerprint", "component_id", "chosen")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Null and empty texts and texts of white space have fingerprint 0 and are linked like any
    other. Repeated rows keep one result each. A null id never is the component's id unless all
    its ids are null. An empty table gives no rows. Other columns are not read.
    """
    rows, groups = grouped(docs)
    return rows.join(groups, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, one row a group, all columns.

    Groups are those of ``near_duplicates``: null, empty and blank texts are one group with whatever is
    near fingerprint 0. Of repeated rows (equal id and fingerprint) one stays. A group whose ids are all
    null keeps one row. An empty table stays empty. Columns may have any names.
    """
    columns = docs.columns
    own, kept, first = (fresh_name(docs, name) for name in ("own_fingerprint", "kept_fingerprint", "kept_id"))
    _, groups = grouped(docs)
    chosen = groups.where("fingerprint = chosen").select(F.col("fingerprint").alias(kept), F.col("component_id").alias(first))

    # The fingerprint stands in for the id where ids are null.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [fingerprint(t) for t in batch.column(place).to_pylist()]
            yield batch.append_column(own, pa.array(numbers, pa.int64()))

    place = columns.index("text")
    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    found = marked.join(chosen, (F.col(own) == F.col(kept)) & F.col("doc_id").eqNullSafe(F.col(first)), "left_semi")
    return found.dropDuplicates(["doc_id", own]).select(*(F.col(f"`{c}`") for c in columns))
