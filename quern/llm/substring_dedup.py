"""Bytes of repeated strings removed from a corpus, by induced suffix sorting of shards.

A string of ``length`` bytes is repeated when it also starts at another place in the corpus. To
sort only what can hold one, and to bring equal strings into one shard, every window of ``length``
bytes is filed under the smallest hash of the ``GRAM``-byte strings inside it. Equal windows have
the same one, at the same place. Neighbouring windows that share it form a piece; a piece whose
key no other piece has holds no repeated window, and in a piece whose whole text occurs again
every window is repeated. What is left are the different texts under a key that several have: the
edges of repeated passages. They are narrowed further, in small blocks of windows, by whether the
bytes common to a block's windows occur again. Shards of what remains are suffix-sorted with common prefixes up to
``length``; neighbours that share all of it are repeated windows. Under a key with very many
different texts, windows are counted by their hashes instead, which needs no key's texts together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.induced_sort import common_prefixes, suffix_order
from quern.storage import written

LENGTH = 400
GRAM = 64
#: Bytes of text whose pieces are found at once, in some 90 times their memory; a longer text is taken in overlapping parts.
CHUNK = 1 << 20
#: Bytes of one suffix-sorted shard, which takes some 90 times its size; a key's texts are never in two.
SHARD = 1 << 20
#: Shards that one task sorts, one after the other.
SHARDS_PER_TASK = 4
#: Windows of a piece that are looked at together before sorting.
BLOCK_WINDOWS = 32
#: Different texts under one key beyond which its windows are counted by hash.
TEXTS_PER_KEY = 5_000
#: Bits of the map of texts that have something to remove; collisions cost only transfer.
MAP_BITS = 20

_BASE = 0x9E3779B97F4A7C15
PIECES = "key long, piece long, text_key long, start long, size int, gram int"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PieceFinder:
    """Pieces of texts: runs of windows with the same smallest gram."""

    def __init__(self, length: int, gram: int, chunk: int) -> None:
        self.length, self.gram, self.chunk = length, gram, max(chunk, 2 * length)
        room = self.chunk + 1
        self.powers = np.concatenate([[np.uint64(1)], np.full(room, _BASE, np.uint64)])
        np.multiply.accumulate(self.powers, out=self.powers)
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        self.inverses = np.concatenate([[np.uint64(1)], np.full(room, inverse, np.uint64)])
        np.multiply.accumulate(self.inverses, out=self.inverses)

    def _gram_hashes(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        return _mixed((sums[self.gram :] - sums[: -self.gram]) * self.inverses[: n - self.gram + 1])

    def pieces(self, data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, first window, last window and gram of each piece; ``owner`` is negative where no window starts."""
        hashes = self._gram_hashes(data)
        width = self.length - self.gram + 1
        places = np.uint64((1 << 24) - 1)
        values = (hashes & ~places) | np.arange(len(hashes), dtype=np.uint64)
        n_windows = len(data) - self.length + 1
        blocks = np.concatenate([values, np.full(-len(values) % width, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(behind[:n_windows], ahead[width - 1 : width - 1 + n_windows]) & places
        new = np.ones(n_windows, bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:n_windows] != owner[: n_windows - 1])
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, n_windows - 1)
        real = owner[first] >= 0
        first, last = first[real], last[real]
        grams = least[first].astype(np.int64)
        return hashes[grams].view(np.int64), first, last, grams

    def rows(self, texts: list[tuple[int, bytes]]) -> Iterator[tuple[list, ...]]:
        """Columns of ``PIECES`` for (text_key, text) pairs, a chunk of text at a time."""
        parts: list[tuple[int, int, bytes]] = []
        size = 0
        step = self.chunk - self.length + 1
        for text_key, text in texts:
            for at in range(0, max(len(text) - self.length + 1, 0), step):
                part = text[at : at + self.chunk]
                if size + len(part) > self.chunk:
                    yield self._chunk_rows(parts)
                    parts, size = [], 0
                parts.append((text_key, at, part))
                size += len(part)
        if parts:
            yield self._chunk_rows(parts)

    def _chunk_rows(self, parts: list[tuple[int, int, bytes]]) -> tuple[list, ...]:
        whole = b"".join(p[2] for p in parts)
        data = np.frombuffer(whole, np.uint8)
        owner = np.full(len(data), -1, np.int64)
        begins, at = [], 0
        for k, (_, _, part) in enumerate(parts):
            owner[at : at + len(part) - self.length + 1] = k
            begins.append(at)
            at += len(part)
        keys, first, last, grams = self.pieces(data, owner)
        stops = (last + self.length).tolist()
        digests = [xxhash.xxh64_intdigest(whole[x:y]) for x, y in zip(first.tolist(), stops)]
        own = owner[first]
        starts = first - np.array(begins)[own] + np.array([p[1] for p in parts], np.int64)[own]
        text_keys = np.array([p[0] for p in parts], np.int64)[own]
        return keys, np.array(digests, np.uint64).view(np.int64), text_keys, starts, (last - first + self.length).astype(np.int32), (grams - first).astype(np.int32)


def pieces(texts: DataFrame, length: int, gram: int, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = PieceFinder(length, gram, chunk)
        names = [f.split(" ")[0] for f in PIECES.split(", ")]
        for batch in batches:
            pairs = ((k, t.as_py().encode()) for k, t in zip(batch.column(0).to_pylist(), batch.column(1)))
            for columns in finder.rows(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return texts.select("text_key", "text").mapInArrow(run, PIECES)


def text_map(keys: DataFrame) -> np.ndarray:
    """Bit map, of fixed size, of the low bits of text keys."""
    low = F.col("text_key").bitwiseAND((1 << MAP_BITS) - 1)
    bits = keys.select(F.shiftright(low, 6).alias("word"), F.expr(f"shiftleft(1L, cast(text_key & 63 as int))").alias("bit"))
    table = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for word, bit in bits.groupBy("word").agg(F.bit_or("bit")).collect():  # at most 2 ** (MAP_BITS - 6) rows
        table[word] = bit
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def _only_mapped(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text key may be among ``keys``; no row that is gets lost."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(text_map(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            low = batch.column(place).to_numpy(zero_copy_only=False) & ((1 << MAP_BITS) - 1)
            yield batch.filter(pa.array(bits[low]))

    place = docs.columns.index("text_key")
    return docs.mapInArrow(run, docs.schema)


def _piece_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, piece, n, text_key, start, gram, text for the ``wanted`` pieces, cut from one copy of each text."""
    lists = wanted.groupBy("text_key").agg(F.collect_list(F.struct("key", "piece", "n", "start", "size", "gram")).alias("wanted"))
    texts = _only_mapped(docs.select("text_key", "text"), wanted)
    joined = texts.join(lists, "text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text_key, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                rows += [(p["key"], p["piece"], p["n"], text_key, p["start"], p["gram"], data[p["start"] : p["start"] + p["size"]]) for p in places]
            if rows:
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["key", "piece", "n", "text_key", "start", "gram", "text"]
                )

    cut = joined.select("text_key", "text", "wanted").mapInArrow(run, "key long, piece long, n long, text_key long, start long, gram int, text binary")
    return cut.dropDuplicates(["key", "piece"])


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, where a string of ``length`` bytes starts that also starts elsewhere in them."""
    whole = b"\x00".join(texts)  # overwritten below by a symbol of its own
    symbols = np.frombuffer(whole, np.uint8).astype(np.uint16) + 1
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols[begins[1:] - 1] = 0
    order = suffix_order(symbols, 257)
    shared = common_prefixes(symbols, order, length) >= length
    marked = np.zeros(len(symbols), bool)
    marked[order[shared]] = True
    marked[order[np.flatnonzero(shared) - 1]] = True
    found = []
    for begin, size in zip(begins.tolist(), sizes.tolist()):
        found.append(np.flatnonzero(marked[begin : begin + max(size - length + 1, 0)]))
    return found


def repeated_in_pieces(rows: list[tuple], length: int, step: int = 0) -> list[np.ndarray]:
    """For each (key, n, text_key, start, gram, text) row, sorted starts of its repeated windows.

    Windows are taken in blocks by their distance from the piece's gram, so that equal windows are
    in blocks of one number. All windows of a block share its core. A core that no other text has
    rules the block out, and a block whose whole text another has is repeated throughout; only
    blocks between the two are suffix-sorted.
    """
    step = step or min(BLOCK_WINDOWS, max(1, length // 8))
    cores: dict[tuple, int] = {}
    wholes: dict[tuple, int] = {}
    parts: list[tuple[int, int, tuple, tuple]] = []  # row, first window, core, whole
    for place, (key, n, _, _, gram, text) in enumerate(rows):
        last = len(text) - length
        for block in range((gram - last) // step, gram // step + 1):
            first, end = max(gram - block * step - step + 1, 0), min(gram - block * step, last) + 1
            top = gram - block * step
            core = (key, block, text[top : top - step + 1 + length])
            whole = (key, block, top - first, text[first : end - 1 + length])
            cores[core] = cores.get(core, 0) + n
            wholes[whole] = wholes.get(whole, 0) + n
            parts.append((place, first, core, whole))
    found: list[list[np.ndarray]] = [[] for _ in rows]
    open_cores = {core for place, _, core, whole in parts if rows[place][1] == 1 and cores[core] > 1 and wholes[whole] == 1}
    texts: dict[tuple, int] = {}
    for place, first, core, whole in parts:
        if core in open_cores:
            texts.setdefault(whole, len(texts))
        if wholes[whole] > 1:
            found[place].append(np.arange(first, first + len(whole[3]) - length + 1))
    if texts:
        starts = repeated_starts([whole[3] for whole in texts], length)
        for place, first, _, whole in parts:
            if whole in texts and wholes[whole] == 1:
                found[place].append(first + starts[texts[whole]])
    return [np.sort(np.concatenate(f)) if f else np.array([], np.int64) for f in found]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered bytes [first, end) of windows at sorted ``starts``, joined where they meet."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(part[0]), int(part[-1]) + length) for part in np.split(starts, cuts)]


SPANS = "text_key long, start long, stop long"


def sorted_spans(texts: DataFrame, length: int, shard: int) -> DataFrame:
    """Repeated bytes of the pieces that occur once, from suffix-sorted shards of whole keys."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        spans = [
            (text_key, start + first, start + end)
            for (_, n, text_key, start, _, _), starts in zip(rows, repeated_in_pieces(rows, length)) if n == 1
            for first, end in _runs(starts, length)
        ]
        columns = zip(*spans) if spans else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["text_key", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, before = [], 0, None
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != before and size >= shard:
                    yield sort(rows)
                    rows, size = [], 0
                rows.append((key, *row))
                size += len(row[-1])
                before = key
        if rows:
            yield sort(rows)

    dealt = texts.repartition(max(1, total // (SHARDS_PER_TASK * shard)), "key").sortWithinPartitions("key")
    return dealt.select("key", "n", "text_key", "start", "gram", "text").mapInArrow(run, SPANS)


def counted_spans(texts: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many texts: windows counted by 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, text_key, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                places = range(len(text) - length + 1)
                hashes = [xxhash.xxh3_128_digest(text[p : p + length]) for p in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), pa.array([n] * len(hashes)), pa.array([text_key] * len(hashes)), pa.array([start + p for p in places])],
                    ["window", "n", "text_key", "start"],
                )

    rows = texts.select("n", "text_key", "start", "text").mapInArrow(run, "window binary, n long, text_key long, start long")
    often = rows.groupBy("window").agg(F.count("*").alias("c")).where("c > 1").select("window")
    return rows.where("n = 1").join(often, "window").select("text_key", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, shard: int = SHARD, texts_per_key: int = TEXTS_PER_KEY
) -> DataFrame:
    """text_key, spans: covered bytes of each text, as a list of runs that may overlap."""
    texts = docs.select("text_key", "text").where(F.octet_length("text") >= length)
    found = pieces(texts, length, gram, chunk)
    placed = written(found.groupBy(*found.columns).agg(F.count("*").alias("n")), "pieces")
    different = written(placed.groupBy("key", "piece").agg(
        F.sum("n").alias("n"), F.max(F.struct("text_key", "start", "size", "gram")).alias("at")
    ), "different-pieces")
    keys = different.groupBy("key").agg(F.count("*").alias("texts"), F.min("n").alias("least"))
    shared = written(keys.where("texts > 1 and least = 1").select("key", "texts"), "shared-keys")
    wanted = different.join(shared, "key").select("key", "piece", "n", "texts", "at.*")
    wanted = written(wanted, "wanted-pieces")
    cut = written(_piece_texts(docs, wanted.drop("texts")), "piece-texts")
    hot = written(shared.where(F.col("texts") > texts_per_key).select("key"), "hot-keys")
    edges = sorted_spans(cut.join(hot, "key", "left_anti"), length, shard).union(
        counted_spans(cut.join(hot, "key", "left_semi"), length)
    )
    again = different.where("n > 1").select("key", "piece")
    whole = placed.join(again, ["key", "piece"]).select("text_key", "start", (F.col("start") + F.col("size")).alias("stop"))
    spans = edges.union(whole).groupBy("text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return written(spans, "repeated-spans")


def without(data: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """The bytes left, and the number of maximal removed runs."""
    kept, at, runs = [], 0, 0
    end = -1
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or []):
        if start > end:
            runs += 1
            kept.append(data[at:start])
        end = max(end, stop)
        at = end
    return b"".join([*kept, data[at:]]), runs


def with_text_key(docs: DataFrame) -> DataFrame:
    """Equal texts have equal results, so a hash of the text names them; the id is not needed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("text"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeated(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    Null text is empty. Texts shorter than ``length`` stay whole. Repeated rows are copies of each
    other: if long enough, all their bytes go. Null and equal ids do not matter. An empty table
    gives no rows. Other columns are not read.
    """
    keyed = with_text_key(docs)
    spans = repeated_spans(keyed, length, **options)

    # Texts with nothing to remove are done where they are read; only the others are exchanged.
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(text_map(spans)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            rows = []
            for doc_id, text, text_key in zip(*(c.to_pylist() for c in batch.columns)):
                may = bool(bits[text_key & ((1 << MAP_BITS) - 1)])
                data = text.encode()
                rows.append((doc_id, len(data), None if may else hashlib.sha256(data).hexdigest(), text if may else None, text_key))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "sha256", "text", "text_key"]
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                left, runs = without(text.encode(), places)
                rows.append((doc_id, n_bytes, n_bytes - len(left), runs, hashlib.sha256(left).hexdigest()))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    read = keyed.mapInArrow(run, "doc_id long, n_bytes long, sha256 string, text string, text_key long")
    zero = F.lit(0).cast("long")
    done = read.where("text is null").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha256").alias("kept_sha256"))
    changed = read.where("text is not null").join(spans, "text_key", "left").select("doc_id", "n_bytes", "text", "spans").mapInArrow(cut, RESULT)
    return done.unionByName(changed)
