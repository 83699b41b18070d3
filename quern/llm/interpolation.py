"""Scores of texts under a bigram model with deleted interpolation.

    p(w | v) = a(b) c(v, w) / c(v)  +  u(b) c(w) / N  +  z(b) / (V + 1)

b is the bucket of the context's frequency c(v) (its power of two; one bucket for contexts never
seen). The weights a, u, z of each bucket sum to one; expectation-maximisation learns them from
deleted counts: every training token is predicted from the counts without itself.

Counts cover the whole corpus, so no table of them fits a task. Documents are cut into batches of
some millions of tokens. A batch holds its distinct words (as 64-bit hashes, sorted) and its tokens
as places in that list. Its distinct words and word pairs go, once a batch however often they occur,
to buckets by hash; a bucket adds up the counts of all batches and sends each batch the totals for
its own list. Frequent words thus make no hot bucket. The tokens themselves stay in place: their
table is bucketed by batch, and only the lists of counts are exchanged.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import written

TOKENS_PER_BATCH = 1_500_000
#: Words or word pairs that one bucket adds up.
ENTRIES_PER_BUCKET = 1_000_000
TABLE_BUCKETS = 64
FOLDS, HELD_OUT = 5, 1
#: Neither can be a word.
END, START = b"\n", b"\n\n"
#: Bins for counts: so many to a power of two.
BINS = 2
MOST_BINS = 128

TOKENS = "batch long, doc_ids array<long>, lengths array<int>, n_words long, words binary, seen binary, tokens binary"
COUNTS = "batch long, bucket int, counts binary, distinct long, total long"
PAIRS = "bucket int, batch long, keys binary, seen binary, bins binary"
PAIR_COUNTS = "batch long, bucket int, counts binary, cells array<long>, weights array<double>"
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
             "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in names.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kinds[kind]) for values, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields]
    )


def token_batches(docs: DataFrame, tokens_per_batch: int) -> DataFrame:
    """One row a batch; words: sorted hashes; seen: each word's count in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        numbers = itertools.count(first)
        place, ids, lengths, parts, size = _empty()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().lower().split()
                words.append(END)
                parts.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
                ids.append(doc_id)
                lengths.append(len(words))
                size += len(words)
                if size >= tokens_per_batch:
                    yield _rows([_batch(next(numbers), place, ids, lengths, parts)], TOKENS)
                    place, ids, lengths, parts, size = _empty()
        if ids:
            yield _rows([_batch(next(numbers), place, ids, lengths, parts)], TOKENS)

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def _empty() -> tuple:
    return defaultdict(itertools.count().__next__), [], [], [], 0


def _batch(number: int, place: dict[bytes, int], ids: list, lengths: list[int], parts: list[np.ndarray]) -> tuple:
    hashes = np.fromiter(map(_hash, place), np.uint64, len(place))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    tokens = rank[np.concatenate(parts)]
    training = np.repeat([not held_out(i) for i in ids], lengths)
    seen = np.bincount(tokens[training], minlength=len(order)).astype(np.uint32)
    return number, ids, lengths, len(order), hashes[order].tobytes(), _pack(seen), _pack(tokens)


def _cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """bucket, first, end of the runs of sorted keys with the same leading bits."""
    if not bits:
        return [(0, 0, len(keys))]
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = [0, *edges.tolist(), len(keys)]
    return [(b, x, y) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]


def _bucket_bits(entries: int, per_bucket: int) -> int:
    return max(0, (entries - 1) // per_bucket).bit_length()


def word_counts(tokens: DataFrame, bits: int) -> DataFrame:
    """For each batch, the training counts of its words, in pieces by bucket."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words, seen in zip(*(c.to_pylist() for c in batch.columns)):
                keys, counts = np.frombuffer(words, np.uint64), _unpack(seen, "u4")
                yield _rows(
                    [(b, number, keys[x:y].tobytes(), _pack(counts[x:y])) for b, x, y in _cuts(keys, bits)],
                    "bucket int, batch long, keys binary, seen binary",
                )

    def add_up(group: pa.Table) -> pa.Table:
        bucket, batches, keys, seen = (group[c].to_pylist() for c in ("bucket", "batch", "keys", "seen"))
        names, total, sizes, place = _totals(keys, seen)
        rows, at = [], 0
        for batch, size in zip(batches, sizes):
            rows.append((batch, bucket[0], _pack(total[place[at : at + size]]), 0, 0))
            at += size
        rows.append((-1, bucket[0], b"", int((total > 0).sum()), int(total.sum())))
        return pa.Table.from_batches([_rows(rows, COUNTS)])

    parts = tokens.select("batch", "words", "seen").mapInArrow(split, "bucket int, batch long, keys binary, seen binary")
    return parts.groupBy("bucket").applyInArrow(add_up, COUNTS)


def _totals(keys: list[bytes], seen: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Distinct keys, the summed count of each, the number of keys of each piece, and their places."""
    pieces = [np.frombuffer(k, np.uint64) for k in keys]
    names, place = np.unique(np.concatenate(pieces), return_inverse=True)
    counts = np.concatenate([_unpack(s, "u4") for s in seen])
    total = np.bincount(place, counts, len(names)).astype(np.uint64)
    return names, total, [len(p) for p in pieces], place


def by_batch(counts: DataFrame, name: str) -> DataFrame:
    """The pieces of each batch as one list; a batch has one piece a bucket at the most."""
    return counts.where("batch >= 0").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias(name))


def _joined(pieces: list[dict]) -> np.ndarray:
    return np.concatenate([_unpack(p["counts"], "u8") for p in pieces])


def _pairs(words: np.ndarray, tokens: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of each token with the one before it, place of that one in ``words``, texts' first tokens.

    The place is ``len(words)`` for the start of a text.
    """
    first = np.cumsum([0, *lengths[:-1]])
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[first] = len(words)
    hashes = np.append(words, np.uint64(_hash(START)))
    key = hashes[before] * np.uint64(0x9E3779B97F4A7C15) ^ (hashes[before] >> np.uint64(29))
    key = (key + hashes[tokens]) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB), before, first


def _bins(counts: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + the bin of the count on a logarithmic scale."""
    return np.where(counts > 0, 1 + np.round(BINS * np.log2(np.maximum(counts, 1))), 0).astype(np.uint8)


def _from_bin(bins: np.ndarray) -> np.ndarray:
    return np.where(bins > 0, np.exp2((bins - 1.0) / BINS), 0.0)


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the whole binary logarithm of the count."""
    return np.where(counts >= 1, 1 + np.floor(np.log2(np.maximum(counts, 1))), 0).astype(np.int64)


def pair_counts(tokens: DataFrame, counts: DataFrame, n_texts: int, bits: int) -> DataFrame:
    """For each batch the training counts of its word pairs, and cells of deleted counts.

    A cell joins the pairs with the same bins of context count, pair count and word count; its
    weight is the number of their training tokens.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, totals = np.frombuffer(row["words"], np.uint64), _joined(row["counts"])
                indices = _unpack(row["tokens"], "u4")
                key, before, _ = _pairs(words, indices, row["lengths"])
                keys, some, place = np.unique(key, return_index=True, return_inverse=True)
                training = np.repeat([not held_out(i) for i in row["doc_ids"]], row["lengths"])
                seen = np.bincount(place[training], minlength=len(keys)).astype(np.uint32)
                contexts = np.append(totals, np.uint64(n_texts))
                bins = np.stack([_bins(contexts[before[some]]), _bins(totals[indices[some]])], axis=1)
                for b, x, y in _cuts(keys, bits):
                    yield _rows([(b, row["batch"], keys[x:y].tobytes(), _pack(seen[x:y]), _pack(bins[x:y]))], PAIRS)

    def add_up(group: pa.Table) -> pa.Table:
        bucket, batches, keys, seen = (group[c].to_pylist() for c in ("bucket", "batch", "keys", "seen"))
        names, total, sizes, place = _totals(keys, seen)
        bins = np.empty((len(names), 2), np.int64)
        bins[place] = np.concatenate([_unpack(b, "u1").reshape(-1, 2) for b in group["bins"].to_pylist()])
        rows, at = [], 0
        for batch, size in zip(batches, sizes):
            rows.append((batch, bucket[0], _pack(total[place[at : at + size]]), None, None))
            at += size
        cell = (bins[:, 0] * MOST_BINS + _bins(total)) * MOST_BINS + bins[:, 1]
        known = total > 0
        cells, where = np.unique(cell[known], return_inverse=True)
        weights = np.bincount(where, total[known].astype(float), len(cells))
        rows.append((-1, bucket[0], b"", cells.tolist(), weights.tolist()))
        return pa.Table.from_batches([_rows(rows, PAIR_COUNTS)])

    joined = tokens.join(by_batch(counts, "counts"), "batch").select("batch", "doc_ids", "lengths", "words", "tokens", "counts")
    return joined.mapInArrow(split, PAIRS).groupBy("bucket").applyInArrow(add_up, PAIR_COUNTS)


def learn_weights(cells: np.ndarray, weights: np.ndarray, n_tokens: int, n_words: int, rounds: int = 100) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each context bucket, by expectation-maximisation.

    Each cell stands for its training tokens, each predicted from the counts without itself.
    Every weight starts at a third and has one token's worth of prior mass.
    """
    context = _from_bin(cells // MOST_BINS**2)
    pair = _from_bin(cells // MOST_BINS % MOST_BINS)
    word = _from_bin(cells % MOST_BINS)
    left = np.maximum(context - 1, 0)
    chances = np.stack([
        np.where(left > 0, np.clip((pair - 1) / np.maximum(left, 1), 0, 1), 0),
        np.maximum(word - 1, 0) / max(n_tokens - 1, 1),
        np.full(len(cells), 1 / (n_words + 1)),
    ], axis=1)
    bucket = context_bucket(left)
    mix = np.full((66, 3), 1 / 3)
    for _ in range(rounds):
        share = mix[bucket] * chances
        share *= (weights / share.sum(axis=1))[:, None]
        mass = np.stack([np.bincount(bucket, share[:, k], 66) for k in range(3)], axis=1) + 1 / 3
        mix = mass / mass.sum(axis=1, keepdims=True)
    mix[0, 0] = 0.0  # an unseen context has no pairs
    return mix / mix.sum(axis=1, keepdims=True)


def scores(tokens: DataFrame, counts: DataFrame, pairs: DataFrame, n_texts: int, n_tokens: int, n_words: int, mix: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, lengths = np.frombuffer(row["words"], np.uint64), row["lengths"]
                indices = _unpack(row["tokens"], "u4")
                totals = _joined(row["counts"])
                key, before, first = _pairs(words, indices, lengths)
                keys, place = np.unique(key, return_inverse=True)
                pair = _joined(row["pairs"])[place].astype(float)
                word = totals[indices].astype(float)
                context = np.append(totals, np.uint64(n_texts))[before].astype(float)
                base = np.log10((word + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
                weight = mix[context_bucket(context)]
                chance = weight[:, 0] * pair / np.maximum(context, 1) + weight[:, 1] * word / max(n_tokens, 1) + weight[:, 2] / (n_words + 1)
                sums = [np.add.reduceat(x, first) for x in (base, np.log10(chance))]
                n = len(lengths)
                yield _rows(list(zip(
                    row["doc_ids"], map(held_out, row["doc_ids"]), lengths, np.add.reduceat((word > 0).astype(np.int64), first).tolist(),
                    [n_tokens] * n, sums[0].tolist(), sums[1].tolist(),
                )), SCORES)

    joined = tokens.join(by_batch(counts, "counts"), "batch").join(by_batch(pairs, "pairs"), "batch")
    return joined.select("doc_ids", "lengths", "words", "tokens", "counts", "pairs").mapInArrow(run, SCORES)


def score_documents(
    docs: DataFrame, tokens_per_batch: int = TOKENS_PER_BATCH, entries_per_bucket: int = ENTRIES_PER_BUCKET,
    table_buckets: int = TABLE_BUCKETS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Documents whose crc32(doc_id) leaves 1 modulo 5 are held out of all counts; a null id counts
    as an empty one (0: training). Null text is empty and has the end token alone. Repeated rows
    count as often as they occur. An empty table gives no rows; without training documents every
    token has the uniform chance of an empty vocabulary, 1. Other columns are not read.
    """
    spark = docs.sparkSession
    name = f"tokens_{uuid.uuid4().hex}"
    token_batches(docs, tokens_per_batch).write.bucketBy(table_buckets, "batch").sortBy("batch").saveAsTable(name)
    try:
        tokens = spark.table(name)
        texts = docs.select(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("crc"))
        n_texts = texts.where(F.col("crc") % FOLDS != HELD_OUT).count()
        sizes = tokens.select(F.sum("n_words"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()
        entries, n_all = sizes[0] or 0, sizes[1] or 0
        counts = written(word_counts(tokens, _bucket_bits(entries, entries_per_bucket)), "word-counts")
        n_words, n_tokens = (x or 0 for x in counts.where("batch < 0").agg(F.sum("distinct"), F.sum("total")).first())
        pairs = written(pair_counts(tokens, counts, n_texts, _bucket_bits(n_all, entries_per_bucket)), "pair-counts")
        cells = pairs.where("batch < 0").select(F.explode(F.arrays_zip("cells", "weights")).alias("x")).groupBy("x.cells").agg(F.sum("x.weights"))
        rows = cells.collect()  # at most MOST_BINS ** 3 whatever the corpus, some thousands in practice
        mix = learn_weights(
            np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), n_tokens, n_words
        )
        return written(scores(tokens, counts, pairs, n_texts, n_tokens, n_words, mix), "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
