"""Short codes of vectors: each part of a vector becomes the number of its nearest codebook entry.

Codebooks are trained over all rows by integer arithmetic: every round is one job that adds up, per
task, the parts nearest to each entry, so only sums (one row per task and entry component) are exchanged
and only the codebooks themselves reach the driver. Nearest entries are found with a GNAT over the
entries of each part: split points hold the range of their distances to every child, and what a
query's distance to a split point rules out is dropped with the whole subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.storage import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Split points of a node of the tree.
ARITY = 4
#: Relative slack of a distance, well above the error of a square root and a subtraction.
SLACK = 2.0**-50
FARTHEST = np.iinfo(np.int64).max


def below(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - SLACK)


def above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK)


def squared(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    gap = points - other
    return np.einsum("...d,...d->...", gap, gap)


@dataclass
class Node:
    """Split points (indices), the range of their distances to each child, and the children.

    ``low[i, j]`` and ``high[i, j]`` bound the distance of split point i to all of child j: its split
    point (unless i is j) and its subtree. A child without points cannot be reached.
    """

    splits: list[int]
    low: np.ndarray
    high: np.ndarray
    children: list[Node | None] = field(default_factory=list)


class Gnat:
    """Nearest of a few integer points; equal distances go to the lower index."""

    def __init__(self, points: np.ndarray, arity: int = ARITY):
        self.points, self.arity = points.astype(np.int64), arity
        self.computed = 0
        self.root = self._node(list(range(len(points)))) if len(points) else None

    def _node(self, members: list[int]) -> Node:
        splits, rest = self._spread(members)
        owner = [int(np.argmin([squared(self.points[m], self.points[s]) for s in splits])) for m in rest]
        subtrees = [[m for m, o in zip(rest, owner) if o == k] for k in range(len(splits))]
        low, high = np.full((2, len(splits), len(splits)), np.inf)
        for i, split in enumerate(splits):
            for j, subtree in enumerate(subtrees):
                inside = subtree + ([splits[j]] if i != j else [])
                if inside:
                    squares = squared(self.points[inside], self.points[split])
                    low[i, j], high[i, j] = below(squares).min(), above(squares).max()
        return Node(splits, low, high, [self._node(s) if s else None for s in subtrees])

    def _spread(self, members: list[int]) -> tuple[list[int], list[int]]:
        """Split points far from each other, each time that farthest from those before, and the others."""
        splits = members[:1]
        rest = members[1:]
        while rest and len(splits) < self.arity:
            gaps = [min(squared(self.points[m], self.points[s]) for s in splits) for m in rest]
            splits.append(rest.pop(int(np.argmax(gaps))))
        return splits, rest

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest point of each row of ``queries``."""
        index, best = np.zeros(len(queries), np.int64), np.full(len(queries), FARTHEST)
        open_nodes = [(self.root, np.arange(len(queries)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            reachable = np.ones((len(rows), len(node.splits)), bool)
            for i, split in enumerate(node.splits):
                at = np.flatnonzero(reachable[:, i])
                here = rows[at]
                squares = squared(queries[here], self.points[split])
                self.computed += len(here)
                closer = (squares < best[here]) | ((squares == best[here]) & (split < index[here]))
                best[here[closer]], index[here[closer]] = squares[closer], split
                reach = above(best[here])[:, None]
                near, far = below(squares)[:, None], above(squares)[:, None]
                # Strictly out of reach; what may tie stays and is settled by integers.
                reachable[at] &= (near - node.high[i] <= reach) & (node.low[i] - far <= reach)
                reachable[at, i] |= node.children[i] is None
            open_nodes += [(c, rows[reachable[:, j]]) for j, c in enumerate(node.children) if c and reachable[:, j].any()]
        return index, best


def is_whole(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & finite


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of an Arrow column, one row each; all must be equally long."""
    lengths = np.diff(column.offsets.to_numpy())
    size = width if width is not None else int(lengths[0]) if len(lengths) else 0
    if (lengths != size).any():
        raise ValueError(f"vectors of different lengths: {size} and {int(lengths[lengths != size][0])}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), size)


def integers(column: pa.Array, scale: int, width: int | None = None) -> np.ndarray:
    """floor(scale * x) of the vectors, small enough for squared distances in 64 bits."""
    floors = np.floor(matrix(column, width).astype(np.float64) * scale)
    if floors.shape[1] * (4 * np.abs(floors).max(initial=0)) ** 2 >= 2.0**62:
        raise OverflowError("squared distances beyond 64 bits")
    return floors.astype(np.int64)


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part, as an array (part, entry, position)."""

    entries: np.ndarray
    scale: int = SCALE

    def parts(self, column: pa.Array) -> np.ndarray:
        n, _, width = self.entries.shape
        return integers(column, self.scale, n * width).reshape(len(column), n, width)

    def encode(self, column: pa.Array, trees: list[Gnat]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Integer parts, entry numbers and squared distances."""
        parts = self.parts(column)
        found = [tree.nearest(parts[:, k]) for k, tree in enumerate(trees)]
        return parts, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def trees(self) -> list[Gnat]:
        return [Gnat(e) for e in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def first_codebooks(kept: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """Parts of the vectors with the smallest ids (null ids last, equal ids by their components)."""
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    if not rows:
        return None
    vectors = integers(pa.array([r.embedding for r in rows], pa.list_(pa.float64())), scale)
    if vectors.shape[1] % parts:
        raise ValueError(f"vectors of {vectors.shape[1]} components cannot be cut into {parts} equal parts")
    return Codebooks(vectors.reshape(len(rows), parts, vectors.shape[1] // parts).transpose(1, 0, 2).copy(), scale)


def moved_codebooks(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floored mean of the parts nearest to it; unused entries stay."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        totals, counts = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
        for batch in batches:
            parts, codes, _ = books.encode(batch.column(0), trees)
            for k in range(len(trees)):
                np.add.at(totals[k], codes[:, k], parts[:, k])
                counts[k] += np.bincount(codes[:, k], minlength=counts.shape[1])
        used = np.nonzero(counts)
        if len(used[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used[0]), pa.array(used[1]), pa.array(counts[used]), pa.array(list(totals[used]), pa.list_(pa.int64()))],
                ["part", "entry", "n", "total"],
            )

    sums = kept.select("embedding").mapInArrow(add_up, "part long, entry long, n long, total array<long>")
    added = (
        sums.select("part", "entry", "n", F.posexplode_outer("total").alias("position", "total"))
        .groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )
    entries = books.entries.copy()
    for row in added.where("position is not null").collect():  # at most one row for each number of the codebooks
        entries[row.part, row.entry, row.position] = row.total // row.n
    return Codebooks(entries, books.scale)


def trained_codebooks(
    kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks | None:
    books = first_codebooks(kept, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = moved_codebooks(kept, books)
    return books


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row of ``vectors`` (vec_id, label, embedding).

    ``code`` has two hex digits a part, ``error`` is the squared distance to the chosen entries, and
    ``label_error`` its sum over rows of the same label, null being one label. Rows whose vector is
    null or holds null or non-finite components drop out; an empty table gives no rows. Null ids are
    encoded like others and come last among the first entries. Repeated rows count each time and keep a
    result each; among equal distances the lower entry wins. Empty vectors are at distance 0 of entry
    0. Vectors of different lengths, or of a length that ``parts`` does not divide, or so large that
    squared distances leave 64 bits, end the job. Other columns are not read.
    """
    kept = vectors.select("vec_id", "label", "embedding").where(is_whole(F.col("embedding")))
    books = trained_codebooks(kept, parts, entries, rounds, scale)
    sha = books.sha256() if books else ""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees() if books else []
        for batch in batches:
            if batch.num_rows:
                _, codes, squares = books.encode(batch.column(2), trees)
                text = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), text, pa.array(squares.sum(1))], ["vec_id", "label", "code", "error"]
                )

    types = dict(kept.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    coded = written(kept.mapInArrow(encode, schema), "vector-codes")
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256")
    )
