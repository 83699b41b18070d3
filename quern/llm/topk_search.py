"""Exact largest inner products, block by block.

Vectors are documents whose terms are the components. They are put in an order that brings vectors
with the same leading components together and cut into blocks, ranges of that order. A block is a
forward index (its rows) with the largest and smallest value of every component. The sum of a
query's best products with these bounds every score in the block; a query takes the blocks in order of
their bounds and stops when the next bound is below its k-th score.

Ranges of blocks meet batches of queries in cells of bounded size, spread by one shuffle. Every query
starts from the k-th score within its own block, so blocks are skipped from the first one on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.vector_codes import is_whole, matrix
from quern.storage import written

SCALE, SIZE, EVERY = 1024, 10, 100
#: Rows of a block, rows of a range of blocks, and queries of a batch.
BLOCK, RANGE, BATCH = 256, 1 << 16, 1 << 13
#: Components that decide where a vector stands in the order.
LEADING = 3
#: Found rows that a cell holds before it cuts them to the best of each query.
HELD = 1 << 21

BLOCK_FIELDS = (
    "range int, block int, ids array<long>, rows array<long>, low array<long>, high array<long>, "
    "query_rows array<int>, floors array<long>"
)


def leading_components(vector: Column, n: int = LEADING) -> Column:
    """Numbers of the largest components by absolute value, negative ones below zero."""
    ranked = F.array_sort(F.transform(vector, lambda x, i: F.struct((-F.abs(x)).alias("size"), i.alias("at"), (x < 0).alias("minus"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: F.when(s["minus"], -1 - s["at"]).otherwise(s["at"]))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point only while every sum is exact there."""
    most = max(rows.shape[1], 1) * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if most < 2.0**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return queries @ rows.T
    raise OverflowError("inner products beyond 64 bits")


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest score that a row between ``low`` and ``high`` could have."""
    return products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)


def kth_largest(scores: np.ndarray, size: int) -> np.ndarray:
    return np.partition(scores, scores.shape[1] - size, axis=1)[:, scores.shape[1] - size]


#: Below every score; and what stands for a null id, after every other.
LEAST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def block_rows(batches: Iterator[pa.RecordBatch], size: int, every: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows in their order; queries among them with the k-th score of their block."""
    task, number = TaskContext.get().partitionId(), 0
    ids: list[pa.Array] = []
    held: list[np.ndarray] = []
    fields = ["range", "block", "ids", "rows", "low", "high", "query_rows", "floors"]

    def blocks(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal ids, held, number
        names, rows = pa.concat_arrays(ids), np.concatenate(held)
        end = len(rows) if whole else len(rows) - len(rows) % block
        for start in range(0, end, block):
            part, own = rows[start : min(start + block, end)], names.slice(start, min(block, end - start))
            places, floors = seeds(own, part)
            lists = [own.to_pylist(), part.ravel(), part.min(0), part.max(0), places, floors]
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([number], pa.int32())] + [pa.array([x], pa.list_(k)) for x, k in zip(lists, kinds)],
                fields,
            )
            number += 1
        ids, held = [names.slice(end)], [rows[end:]]

    def seeds(own: pa.Array, part: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        known = own.fill_null(1).to_numpy(zero_copy_only=False)
        places = np.flatnonzero(known % every == 0)
        scores = products(part[places], part)
        others = known[places][:, None] != known[None, :]
        scores[~others] = LEAST
        floors = kth_largest(scores, size).tolist() if len(part) >= size and len(places) else [LEAST] * len(places)
        return places.astype(np.int32), [None if f == LEAST else f for f in floors]

    for batch in batches:
        if batch.num_rows:
            ids.append(batch.column(0).cast(pa.int64()))
            held.append(matrix(batch.column(1), held[0].shape[1] if held else None))
            if sum(map(len, held)) >= 4 * block:
                yield from blocks(False)
    if held:
        yield from blocks(True)


def blocked(vectors: DataFrame, size: int = SIZE, every: int = EVERY, block: int = BLOCK, per_range: int = RANGE) -> DataFrame:
    """The blocks of ``vectors`` (vec_id, vector), written.

    Rows are dealt by ranges of their order. The number of the input row ends the key, so that even
    copies of one row can be cut between ranges.
    """
    ordered = vectors.select(
        "vec_id", "vector", leading_components(F.col("vector")).alias("leading"), F.monotonically_increasing_id().alias("nth")
    )
    ranges = max(1, -(-vectors.count() // per_range), vectors.sparkSession.sparkContext.defaultParallelism)
    placed = ordered.repartitionByRange(ranges, "leading", "vec_id", "nth").sortWithinPartitions("leading", "vec_id", "nth")
    rows = placed.select("vec_id", "vector").mapInArrow(lambda b: block_rows(b, size, every, block), BLOCK_FIELDS)
    return written(rows, "vector-blocks")


def queries_of(blocks: DataFrame) -> DataFrame:
    """query_id, twin, vector, floor: the different queries among the rows of ``blocks``.

    Different vectors under one id are told apart by ``twin``.
    """
    width = F.size("low")
    rows = blocks.select("ids", "rows", "low", F.explode(F.arrays_zip("query_rows", "floors")).alias("q"))
    at = F.col("q.query_rows")
    vector = F.slice("rows", at * width + 1, width)
    found = rows.select(F.get("ids", at).alias("query_id"), vector.alias("vector"), F.col("q.floors").alias("floor"))
    same_id = Window.partitionBy("query_id").orderBy("vector")
    return found.groupBy("query_id", "vector").agg(F.max("floor").alias("floor")).select(
        "query_id", (F.row_number().over(same_id) - 1).alias("twin"), "vector", "floor"
    )


def first_of_each(query: np.ndarray, score: np.ndarray, tie: np.ndarray, size: int) -> np.ndarray:
    """Positions of the ``size`` rows of each query with the largest scores, ties to the smaller ``tie``."""
    order = np.lexsort((tie, -score, query))
    sorted_query = query[order]
    start = np.flatnonzero(np.r_[True, sorted_query[1:] != sorted_query[:-1]])
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[place < size]


def search_blocks(
    ids: list[np.ndarray], rows: list[np.ndarray], low: np.ndarray, high: np.ndarray,
    query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, size: int = SIZE,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query position, id and score of the best rows over all blocks, and the number of (query, block) scored.

    ``floors`` are scores that each query's result reaches anyway. Scores equal to the k-th stay in play:
    a block is left out only if its bound is strictly below.
    """
    limit = bounds(queries, low, high)
    order = np.argsort(-limit, axis=1, kind="stable")
    best = np.full((len(queries), size), LEAST)
    kth = floors.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held, scored, everyone = 0, 0, np.arange(len(queries))
    for step in range(len(rows)):
        block_of = order[everyone, step]
        open_queries = limit[everyone, block_of] >= kth[everyone]
        everyone, block_of = everyone[open_queries], block_of[open_queries]
        if not len(everyone):
            break
        scored += len(everyone)
        for block in np.unique(block_of):
            here = everyone[block_of == block]
            scores = products(queries[here], rows[block])
            own = ids[block][None, :] == query_ids[here][:, None]
            scores[own] = LEAST
            best[here] = -np.partition(-np.maximum(np.concatenate([best[here], scores], 1), LEAST + 1), size - 1, axis=1)[:, :size]
            kth[here] = np.maximum(kth[here], best[here].min(1))
            at, row = np.nonzero((scores >= kth[here][:, None]) & ~own)
            new = here[at], scores[at, row], ids[block][row]
            keep = first_of_each(*new, size)
            found.append(tuple(x[keep] for x in new))
            held += len(keep)
        if held > HELD:
            found = [best_rows(found, kth, size)]
            held = len(found[0][0])
    query, score, names = best_rows(found, kth, size)
    return query, names, score, scored


def best_rows(found: list[tuple], kth: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not found:
        return (np.zeros(0, np.int64),) * 3
    query, score, names = (np.concatenate(x) for x in zip(*found))
    enough = score >= kth[query]
    query, score, names = query[enough], score[enough], names[enough]
    keep = first_of_each(query, score, names, size)
    return query[keep], score[keep], names[keep]


def largest_products(
    vectors: DataFrame, size: int = SIZE, every: int = EVERY, scale: int = SCALE,
    block: int = BLOCK, per_range: int = RANGE, batch: int = BATCH,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``size`` largest inner products of each query with the other rows.

    Components are floor(scale * x). Queries are the rows of ``vectors`` (vec_id, embedding) whose id
    ``every`` divides; the candidates are all rows with another id. Ties go to the smaller id. Vectors
    that are null or hold null or non-finite components take no part. Repeated rows are as many
    candidates but one query; different vectors under one id are queries of their own. A null id is no
    query; as a candidate its row comes after all ids among equal scores. With fewer candidates all
    are returned; an empty table, or one without queries, gives no rows. Vectors of
    different lengths, or with products beyond 64 bits, end the job. Other columns are not read.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(is_whole(F.col("embedding")))
    scaled = kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
    blocks = blocked(scaled, size, every, block, per_range)
    queries = written(queries_of(blocks), "queries")
    batches = -(-queries.count() // batch)
    last_range = blocks.agg(F.max("range")).first()[0] or 0
    every_batch = F.explode(F.sequence(F.lit(0), F.lit(max(batches - 1, 0)))).alias("batch")
    left = blocks.select("range", "ids", "rows", "low", "high", every_batch)
    own_batch = F.pmod(F.xxhash64("query_id", "twin"), F.lit(max(batches, 1))).cast("int").alias("batch")
    right = queries.select("query_id", "twin", "vector", "floor", own_batch, F.explode(F.sequence(F.lit(0), F.lit(last_range))).alias("range"))

    def cell(inside: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], fields)
        if not inside.num_rows or not asked.num_rows:
            return empty
        names = [pa.array(x, pa.int64()) for x in inside["ids"].to_pylist()]
        low, high, wanted = (matrix(t[c].combine_chunks()) for t, c in ((inside, "low"), (inside, "high"), (asked, "vector")))
        rows = [x.values.to_numpy(zero_copy_only=False).reshape(len(n), -1 if len(x) else 0) for x, n in zip(inside["rows"], names)]
        ids = [n.fill_null(NO_ID).to_numpy(zero_copy_only=False) for n in names]
        floors = asked["floor"].combine_chunks().fill_null(LEAST).to_numpy(zero_copy_only=False)
        query_ids = asked["query_id"].to_numpy()
        query, found, score, _ = search_blocks(ids, rows, low, high, query_ids, wanted, floors, size)
        twins = asked["twin"].to_numpy()
        return pa.table(
            [pa.array(query_ids[query]), pa.array(twins[query], pa.int32()), pa.array(found, mask=found == NO_ID), pa.array(score)], fields
        )

    fields = ["query_id", "twin", "vec_id", "score"]
    key = ["batch", "range"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, "query_id long, twin int, vec_id long, score long")
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("query_id", "rank", "vec_id", "score")
