"""Nearest vectors of a whole table by cosine: exactly in blocks, or through inverted cells.

Blocks of vectors meet batches of probes in cells of bounded size; a cell keeps the best of each
probe, so what is exchanged afterwards grows with probes times blocks and not with pairs. For
tables where that is too much, vectors are filed under the nearest of a few thousand centres and a probe
looks only into the cells of the nearest centres.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import written

SIMILARITY_DIGITS = 6
#: Vectors of a block and probes of a batch.
PER_BLOCK, PER_BATCH = 1 << 16, 1 << 12
#: Rows that the centres are fitted on, at most; and centres, at most.
SAMPLE, MOST_CELLS = 20_000, 4096

FOUND = "probe_id long, id long, score double"


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of an Arrow column at unit length; null vectors stay zero."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = len(array[0])
    rows = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), width)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def best_of_cell(ids: np.ndarray, rows: np.ndarray, probe_ids: np.ndarray, probes: np.ndarray, top_n: int) -> pa.Table:
    """The ``top_n`` rows with the largest cosine to each probe, ties to the smaller id; never the probe itself."""
    order = np.argsort(ids, kind="stable")  # a stable sort by score then leaves ties in order of id
    ids, rows = ids[order], rows[order]
    found = []
    for start in range(0, len(probes), 256):
        names = probe_ids[start : start + 256]
        score = np.round(probes[start : start + 256] @ rows.T, SIMILARITY_DIGITS) + 0.0
        score[names[:, None] == ids[None, :]] = -np.inf
        if top_n < len(ids):
            kth = -np.partition(-score, top_n - 1, axis=1)[:, top_n - 1]
        else:
            kth = np.full(len(names), -np.inf)
        at, row = np.nonzero((score >= kth[:, None]) & np.isfinite(score))
        values = score[at, row]
        ranked = np.lexsort((row, -values, at))
        place = np.arange(len(ranked)) - np.searchsorted(at[ranked], at[ranked], side="left")
        keep = ranked[place < top_n]
        found.append((names[at[keep]], ids[row[keep]], values[keep]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table([pa.array(c) for c in columns], ["probe_id", "id", "score"])


def _searched(blocks: DataFrame, batches: DataFrame, key: list[str], top_n: int) -> DataFrame:
    """Best of each probe over the cells in which blocks and batches of equal ``key`` meet."""

    def cell(inside: pa.Table, asked: pa.Table) -> pa.Table:
        if not inside.num_rows or not asked.num_rows:
            return best_of_cell(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), top_n)
        return best_of_cell(
            inside["id"].to_numpy(), unit_rows(inside["vector"]), asked["id"].to_numpy(), unit_rows(asked["vector"]), top_n
        )

    found = blocks.groupBy(*key).cogroup(batches.groupBy(*key)).applyInArrow(cell, FOUND)
    order = Window.partitionBy("probe_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select("probe_id", "id", "score", "rank")
    )


def nearest_vectors(
    vectors: DataFrame, probes: DataFrame, top_n: int = 10, per_block: int = PER_BLOCK, per_batch: int = PER_BATCH
) -> DataFrame:
    """Nearest rows of ``vectors`` to each probe, exactly: (probe_id, id, score, rank).

    Both hold (id, vector) with ids unique; rows with the probe's id are left out, null vectors take no
    part, zero vectors score 0. Every vector is sent to each batch of probes, every probe to each block.
    """
    kept = [df.select("id", "vector").where("id is not null and vector is not null") for df in (vectors, probes)]
    n_blocks, n_batches = (max(1, -(-df.count() // per)) for df, per in zip(kept, (per_block, per_batch)))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        number = F.pmod(F.xxhash64("id"), F.lit(n_own)).alias(own)
        every = F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))
        return df.select("id", "vector", number, F.explode(every).alias(other))

    blocks = dealt(kept[0], "block", n_blocks, "batch", n_batches)
    batches = dealt(kept[1], "batch", n_batches, "block", n_blocks)
    return _searched(blocks, batches, ["block", "batch"], top_n)


@dataclass(frozen=True)
class CellIndex:
    """Vectors filed under the nearest of ``centres``: ``filed`` (cell, part, id, vector).

    A cell is cut into parts of about ``per_block`` rows, so that a crowded cell is not one task;
    ``parts`` (cell, parts) says how many each has.
    """

    centres: np.ndarray
    filed: DataFrame
    parts: DataFrame


def fitted_centres(vectors: DataFrame, n_cells: int, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors by k-means on a sample of at most ``sample`` rows, those of the smallest id hashes."""
    total = max(vectors.count(), 1)
    small_hash = (F.abs(F.xxhash64("id") % (1 << 20)) < int((1 << 20) * min(1.0, 2 * sample / total)))
    rows = vectors.where(small_hash).orderBy(F.xxhash64("id")).limit(sample).select("vector").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 1))
    points = unit_rows(rows["vector"])
    centres = points[np.linspace(0, len(points) - 1, min(n_cells, len(points))).astype(int)].copy()
    for _ in range(rounds):
        owner = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _with_cells(df: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """(id, vector, cell): one row for each of the ``n`` nearest centres of a vector."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(unit_rows(batch.column(1)) @ centres.T), axis=1, kind="stable")[:, :n]
                row = np.repeat(np.arange(batch.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(near.ravel())], ["id", "vector", "cell"]
                )

    kind = dict(df.dtypes)["vector"]
    return df.select("id", "vector").where("id is not null and vector is not null").mapInArrow(run, f"id long, vector {kind}, cell long")


def build_cells(vectors: DataFrame, n_cells: int | None = None, sample: int = SAMPLE, per_block: int = PER_BLOCK) -> CellIndex:
    """File every row of ``vectors`` (id, vector) under one of ``n_cells`` centres, by default the square root of their number."""
    rows = vectors.select("id", "vector").where("id is not null and vector is not null")
    n_cells = min(MOST_CELLS, n_cells or max(1, int(rows.count() ** 0.5)))
    centres = fitted_centres(rows, n_cells, sample)
    placed = written(_with_cells(rows, centres, 1), "cell-vectors")
    parts = written(placed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / per_block).alias("parts")), "cell-parts")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")
    return CellIndex(centres, placed.join(F.broadcast(parts), "cell").select("cell", part, "id", "vector"), parts)  # at most MOST_CELLS rows


def near_vectors(index: CellIndex, probes: DataFrame, top_n: int = 10, n_probe: int = 8, per_batch: int = PER_BATCH) -> DataFrame:
    """Nearest filed rows of each probe among the cells of its ``n_probe`` nearest centres: (probe_id, id, score, rank).

    The probes of a cell are cut into batches; only cells that many probes look into are read more than once.
    """
    asked = written(_with_cells(probes, index.centres, n_probe), "cell-probes")
    batches = asked.groupBy("cell").count().select("cell", F.ceil(F.col("count") / per_batch).alias("batches"))
    cells = written(index.parts.join(batches, "cell"), "asked-cells")  # a row a cell, so at most MOST_CELLS
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    own_batch = F.pmod(F.xxhash64("id"), F.col("batches")).alias("batch")
    every_batch = F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)).alias("batch")
    wanted = asked.join(F.broadcast(cells), "cell").select("id", "vector", "cell", own_batch, every_part)
    inside = index.filed.join(F.broadcast(cells), "cell").select("id", "vector", "cell", "part", every_batch)
    return _searched(inside, wanted, ["cell", "part", "batch"], top_n)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact nearest rows that were found, over all probes."""
    hit = exact.join(found.select("probe_id", "id", F.lit(1).alias("hit")), ["probe_id", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
