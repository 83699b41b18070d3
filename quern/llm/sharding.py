"""Shards of near equal size by histogram sort.

Every row gets a 64-bit key: 40 bits from its text, so that equal texts lie together, and 24 bits
from its id, so that a very large group of equal texts can still be cut. The boundaries between
shards are found without sorting: the bytes under each of 2**11 key ranges are counted exactly,
and only the ranges that hold a boundary are probed again with finer ranges until every boundary
meets the tolerance. The rows are then exchanged once, to number them inside their shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.storage import written

TEXT_BITS, ID_BITS = 40, 24
#: Bits of the key that each round of probes adds.
ROUNDS = (11, 11, 11, 11, 10, 10)
#: Rows that one task numbers.
ROWS_PER_CELL = 250_000


@dataclass
class Probe:
    """Where one boundary may still lie: the range with this prefix, and the bytes before it."""

    prefix: int
    before: int


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key; the row number makes the keys of repeated rows differ."""
    text = F.coalesce(F.col("text"), F.lit(""))
    id_hash = F.xxhash64("doc_id", F.monotonically_increasing_id())
    key = F.shiftleft(F.shiftright(F.xxhash64(text), ID_BITS), ID_BITS).bitwiseOR(
        F.shiftrightunsigned(id_hash, TEXT_BITS)
    )
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
    )


def boundaries(keys: DataFrame, n_shards: int, tolerance: float) -> list[int]:
    """Lowest key of each shard but the first.

    A boundary is as good as wanted when the bytes before it are within ``tolerance`` of a
    shard's share. The driver gets a row for each probed range: at most 2**11 in the first
    round and ``n_shards - 1`` times that later.
    """
    found: dict[int, int] = {}
    open_probes = {j: Probe(0, 0) for j in range(1, n_shards)}
    total, used = None, 0
    for bits in ROUNDS:
        used += bits
        shift = 64 - used
        prefix = F.shiftright("key", shift)
        rows = keys
        if total is not None:
            parents = {p.prefix for p in open_probes.values()}
            rows = keys.where(F.shiftright("key", shift + bits).isin(sorted(parents)))
        counted = rows.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        sizes = sorted((r["prefix"], r["size"], r["n"]) for r in counted.collect())
        if total is None:
            total = sum(size for _, size, _ in sizes)
        if not total:
            return []
        for j, probe in list(open_probes.items()):
            target, before = j * total / n_shards, probe.before
            inside = [x for x in sizes if used == bits or x[0] >> bits == probe.prefix]
            for p, size, n in inside:
                if before + size >= target:
                    near = min(target - before, before + size - target) <= tolerance * total / n_shards
                    if near or n == 1 or shift == 0:
                        found[j] = (p if target - before <= before + size - target else p + 1) << shift
                        del open_probes[j]
                    else:
                        open_probes[j] = Probe(p, before)
                    break
                before += size
        if not open_probes:
            break
    return [found[j] for j in sorted(found)]


def shard_of(key: Column, lowest: list[int]) -> Column:
    top = 2**63 - 1
    return sum(((key >= F.lit(b)).cast("int") for b in lowest if b <= top), F.lit(0))


def shard_documents(docs: DataFrame, n_shards: int = 24, tolerance: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``.

    size: UTF-8 bytes of the text and 8 more; null text counts as empty. Shards differ in bytes
    by the tolerance (as a share of a shard) or by a row, whichever is more. Equal texts share a
    shard unless the boundary would then be out of tolerance; so a group that is larger than a
    shard is cut. Repeated rows, equal and null ids are rows like others. An empty table gives
    no rows; with fewer rows than shards some shards stay empty. Other columns are not read.
    """
    keys = written(keyed(docs), "shard-keys")
    lowest = boundaries(keys, n_shards, tolerance)
    per_cell = max(1, keys.count() // (n_shards * ROWS_PER_CELL))
    cells = 1 << (per_cell - 1).bit_length()
    placed = keys.withColumns({
        "shard": shard_of(F.col("key"), lowest),
        "cell": F.col("key").bitwiseAND(cells - 1),
    })
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")), "shard-starts")
    inside = Window.partitionBy("shard", "cell").orderBy("key", "doc_id")
    numbered = placed.withColumn("n", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
