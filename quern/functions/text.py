"""Text to tokens, on columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]

WORD_BREAK = r"[^\p{L}\p{N}]+"


def tokenize(text: Column) -> Column:
    """Lower-case words: runs of letters and digits. Null text has no tokens."""
    return split_tokens(F.lower(text), WORD_BREAK)


def whitespace_tokens(text: Column) -> Column:
    """Words between blanks, as they are."""
    return split_tokens(text, r"\s+")


def split_tokens(text: Column, pattern: str) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), pattern), "")


def vectorised(words: Callable[[pa.Array], pa.Array]) -> Tokenizer:
    """A tokenizer from a function of whole Arrow arrays, texts to lists of tokens.

    It runs as an Arrow UDF, batch by batch, wherever a tokenizer is accepted: for rules that column
    functions cannot express, without a Python call for each text. Null texts arrive as empty ones.
    """

    def batch(text: pa.Array) -> pa.Array:
        return words(text.fill_null(""))

    return F.arrow_udf(batch, "array<string>")


def arrow_words(text: pa.Array) -> pa.Array:
    """The tokens of ``tokenize``, for ``vectorised``."""
    lists = pc.split_pattern_regex(pc.utf8_lower(text), pattern=WORD_BREAK)
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.not_equal(flat, "")
    counts = np.bincount(owner.filter(full).to_numpy(), minlength=len(text))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), flat.filter(full))


def counted_terms(tokens: Column) -> Column:
    """Array of (term, tf) of each list of tokens, in order of the terms; null tokens do not count.

    Whole Arrow arrays are counted at once: a batch of documents is sorted by numbers of its terms, which costs
    less than a row for each token in a hash table.
    """
    return F.arrow_udf(_counts, "array<struct<term:string,tf:bigint>>")(tokens)


def _counts(lists: pa.Array) -> pa.Array:
    flat, owner = lists.flatten(), pc.list_parent_indices(lists)
    known = flat.is_valid()
    coded, owner = flat.filter(known).dictionary_encode(), owner.filter(known).to_numpy()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place, n_terms = np.empty(len(order), np.int64), max(len(order), 1)
    place[order] = np.arange(len(order))
    found, tf = np.unique(owner * n_terms + place[coded.indices.to_numpy()], return_counts=True)
    row, term = np.divmod(found, n_terms)
    entries = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(order[term])), pa.array(tf, pa.int64())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(lists) + 1)), pa.int32()), entries)
