"""Documents packed into sequences of a fixed number of tokens, by hierarchical best fit.

Pieces are packed best-fit decreasing inside each partition. Bins that are nearly full are done;
the pieces of the others meet again, bin by bin, in fewer partitions, where each underfull bin is
one item of its filled length. Rounds go on until one partition holds what is left or a round
joins hardly any bins. Pieces are rows throughout, so nothing but one partition's numbers is ever
held by a task.
"""

from __future__ import annotations

import itertools
import math
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import written

CAPACITY = 1024
END_ID = 2
#: Free tokens that a bin may have to count as nearly full.
NEARLY_FULL = 4
#: Pieces that one task packs.
PIECES_PER_TASK = 200_000
#: Chunks between blanks that a worker keeps with their ids, in arrays, twice over; some 40 bytes each.
KEPT_CHUNKS = 200_000
#: Words in chunks that it keeps as objects, twice over; some 150 bytes each.
KEPT_WORDS = 100_000
#: Characters of the texts that are cut into chunks together.
TOGETHER = 2 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, bin long, offset long, done boolean"

#: The split of byte-level BPE before merging.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space other than the space and the line end; and these two anywhere but alone between words.
_ODD_SPACE = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n][ \n]|^[ \n]|[ \n]$"


class Kept:
    """Values remembered by key. What was used since the last but one change of generations stays."""

    def __init__(self, compute: Callable[[str], bytes], most: int = KEPT_WORDS) -> None:
        self.compute, self.most = compute, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, key: str) -> bytes:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.compute(key)
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found


class KeptArrays:
    """Ids of strings, remembered in whole arrays, which take a fraction of what objects do.

    Beyond twice ``most`` strings, those that were used since the last time stay, the newest ``most`` of them.
    """

    def __init__(self, compute: Callable[[str], bytes], most: int = KEPT_CHUNKS) -> None:
        self.compute, self.most = compute, most
        self.names, self.used = pa.array([], pa.large_string()), np.zeros(0, bool)
        self.ids, self.begins = np.zeros(0, "<u4"), np.zeros(1, np.int64)  # one after the other, and where each begins

    def _cut(self) -> None:
        stay = np.flatnonzero(self.used)[-self.most :]
        sizes = np.diff(self.begins)
        kept = np.zeros(len(sizes), bool)
        kept[stay] = True
        self.ids = self.ids[np.repeat(kept, sizes)]
        self.begins = np.concatenate([[0], np.cumsum(sizes[stay])])
        self.names, self.used = self.names.take(pa.array(stay)), np.zeros(len(stay), bool)

    def places(self, names: pa.Array) -> np.ndarray:
        """The number of each of ``names``, all different, among the strings that are remembered."""
        if len(self.names) > 2 * self.most:
            self._cut()
        names = names.cast(pa.large_string())
        place = pc.index_in(names, self.names).fill_null(-1).to_numpy().astype(np.int64)
        new = place < 0
        if new.any():
            others = names.filter(pa.array(new))
            found = [self.compute(name) for name in others.to_pylist()]
            sizes = np.array([len(f) for f in found], np.int64) // 4
            place[new] = len(self.names) + np.arange(len(found))
            self.names = pa.concat_arrays([self.names, others])
            self.used = np.concatenate([self.used, np.zeros(len(found), bool)])
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
        self.used[place] = True
        return place


class Encoder:
    """Token ids of texts as little-endian bytes, with the ids of words remembered.

    Before merging, byte-level BPE cuts a text into words; a single space opens the next word and
    a single line end is a word. So texts whose white space is single spaces and line ends are cut
    into chunks, many texts at once, and put together from the ids of the different chunks; others, and
    those with the special token's name, are encoded whole.
    """

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.word, self.chunk = Kept(self._word), KeptArrays(self._chunk)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(_byte_letters(word))])

    def _chunk(self, chunk: str) -> bytes:
        # Beyond Latin letters, libraries may know different editions of the letter classes.
        if not chunk.isascii() and max(chunk) >= "\u0250":
            return self._encode(chunk)
        if chunk.removeprefix(" ").isalpha():
            return self._word(chunk)
        return b"".join(map(self.word, _SPLIT.findall(chunk)))

    def ids(self, text: str | None) -> bytes:
        return next(self.all_ids(pa.array([text or ""])))

    def all_ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order."""
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        whole = odd.to_numpy(zero_copy_only=False).astype(bool)
        ids, begins = self._put_together(texts.filter(pc.invert(odd)))
        number = 0
        for place, is_whole in enumerate(whole.tolist()):
            if is_whole:
                yield self._encode(texts[place].as_py())
            else:
                yield ids[begins[number] : begins[number + 1]].tobytes()
                number += 1

    def _put_together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts after each other, and where each begins."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        offsets = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        ends_line = np.append(pc.equal(words, "\n").to_numpy(zero_copy_only=False).astype(bool), False)[code]
        spaced = ~ends_line
        spaced[1:] &= ~ends_line[:-1]
        spaced[offsets[:-1]] = False
        chunk = code.astype(np.int64) * 2 + spaced
        used = np.zeros(2 * len(words), bool)
        used[chunk] = True
        different = np.flatnonzero(used)
        names = words.take(pa.array(different >> 1))
        after_space = pc.binary_join_element_wise(pa.scalar("", names.type), names, pa.scalar(" ", names.type))
        place = self.chunk.places(pc.if_else(pa.array((different & 1).astype(bool)), after_space, names))
        which = place[(np.cumsum(used) - 1)[chunk]]
        counts = np.diff(self.chunk.begins)[which]
        upto = np.concatenate([[0], np.cumsum(counts)])
        from_known = self.chunk.begins[which] - upto[:-1]
        return self.chunk.ids[np.repeat(from_known, counts) + np.arange(upto[-1])], upto[offsets]


def _byte_alphabet() -> dict[int, str]:
    """The letter that stands for each byte: itself where it is printable, else one above 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_alphabet()


def _byte_letters(word: str) -> str:
    return word.encode().decode("latin-1").translate(_LETTERS)


_encoders: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """One encoder a worker, so that later tasks find its words."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def encoded(own: Encoder, texts: pa.Array) -> Iterator[bytes]:
    """Ids of the texts, about ``TOGETHER`` characters at a time."""
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for start, stop in zip(cuts, cuts[1:]):
        if stop > start:
            yield from own.all_ids(texts.slice(start, stop - start))


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens; only a longer document's first piece may be shorter.

    Null text is empty and has the end token alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(own, pc.fill_null(batch.column(1), ""))):
                ids += end
                n = len(ids) // 4
                count = -(-n // capacity)
                stops = [n - capacity * k for k in range(count - 1, -1, -1)]
                start = 0
                for piece, stop in enumerate(stops):
                    crc = zlib.crc32(ids[4 * start : 4 * stop])
                    for values, value in zip(rows, (doc_id, piece, start, stop - start, crc)):
                        values.append(value)
                    start = stop
            if rows[0]:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(rows, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin number and offset of each item, taken in the order given: the tightest bin that fits.

    Bins are kept by free length; one bit of ``free`` tells which lengths have any.
    """
    bins_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, opened = 0, 0
    placed, offsets = [], []
    for length in lengths:
        fitting = free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = bins_with[room].pop()
            if not bins_with[room]:
                free ^= 1 << room
        else:
            room, number, opened = capacity, opened, opened + 1
        placed.append(number)
        offsets.append(capacity - room)
        if room > length:
            bins_with[room - length].append(number)
            free |= 1 << (room - length)
    return placed, offsets


def pack_round(rows: DataFrame, capacity: int, nearly_full: int) -> DataFrame:
    """Bins of each partition packed into fewer; ``done`` tells which are nearly full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [b for b in batches if b.num_rows]
        if not taken:
            return
        whole = pa.Table.from_batches(taken)
        length, offset, bins = (whole[c].to_numpy() for c in ("length", "offset", "bin"))
        names, item = np.unique(bins, return_inverse=True)
        filled = np.zeros(len(names), np.int64)
        np.maximum.at(filled, item, offset + length)
        order = np.lexsort((names, -filled))
        placed, moved = best_fit(filled[order].tolist(), capacity)
        number, shift = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        number[order], shift[order] = placed, moved
        total = np.zeros(number.max() + 1, np.int64)
        np.add.at(total, number, filled)
        first = np.full(len(total), np.iinfo(np.int64).max)
        np.minimum.at(first, number, names)  # a bin goes by the smallest of its members' names
        columns = {
            **{c: whole[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
            "bin": pa.array(first[number][item]),
            "offset": pa.array(offset + shift[item]),
            "done": pa.array((total >= capacity - nearly_full)[number][item]),
        }
        yield from pa.table(columns).to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, PACKED)


def pack(
    docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID,
    nearly_full: int = NEARLY_FULL, pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Null and empty texts are one piece with the end token alone. Repeated rows, equal and null ids are packed as documents of their own. An empty table
    gives no rows. Other columns are not read.
    """
    cut = written(pieces(docs, tokenizer_json, capacity, end_id).withColumns({
        "bin": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
        "done": F.col("length") >= capacity - nearly_full,
    }), "pieces")
    results = [cut.where("done")]
    left = cut.where("not done")
    before = None
    for number in itertools.count():
        n_rows, n_bins = left.agg(F.count("*"), F.countDistinct("bin")).first()
        if not n_rows or before is not None and (before[1] == 1 or n_bins > 0.99 * before[0]):
            break
        partitions = math.ceil(n_rows / pieces_per_task)
        spread = left.repartition(partitions, F.xxhash64("bin", F.lit(number)))
        packed = written(pack_round(spread, capacity, nearly_full), "packed")
        results.append(packed.where("done"))
        left = packed.where("not done")
        before = (n_bins, partitions)
    results.append(left)
    whole = results[0]
    for part in results[1:]:
        whole = whole.unionByName(part)
    return whole.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )
