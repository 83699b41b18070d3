"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word is read as the multiset of its letters, a binary vector with one place for each letter and
occurrence. One edit changes at most two places. The letters of the alphabet are dealt into eight
partitions; two vectors at Hamming distance at most two differ in at most two partitions, so they
agree on one of the 28 choices of six. A word's signatures are its letters in each choice, together
with the length of the longer word of a pair; words with equal signatures are joined and the edit
itself is verified.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.frames import lower_ascii
from quern.storage import written

#: Partitions of the letters, and how many of them one edit can touch.
PARTITIONS, TOUCHED = 8, 2
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many loses a code point.
DAMAGED = 97
#: Runs shorter than the shortest word cannot become one.
RUN = rf"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n of the words of all texts that occur often enough."""
    run = F.col("run")
    place = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
    at = F.pmod(place, F.char_length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"),
    )
    return (
        runs.select(F.when(place % DAMAGED == 0, cut).otherwise(run).alias("word"))
        .where(F.char_length("word") >= LEAST_LENGTH)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def letter_partitions(words: DataFrame, partitions: int = PARTITIONS) -> list[str]:
    """The letters of each partition, dealt in order of frequency so that all of them tell words apart.

    The alphabet has at most 90 letters, which is all that reaches the driver.
    """
    counts = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    letters = [r.letter for r in counts.orderBy(F.desc("count"), "letter").collect()]
    return ["".join(letters[k::partitions]) for k in range(partitions)]


def letters_inside(word: Column, groups: list[str]) -> Column:
    """The word's letters in each group, in order."""
    letters = F.array_join(F.sort_array(F.split(word, "")), "")
    return F.array(*[F.translate(letters, "".join(g for k, g in enumerate(groups) if k != own), "") for own in range(len(groups))])


def signatures(parts: Column, n: int, touched: int = TOUCHED) -> Column:
    """One number for the letters in each choice of all but ``touched`` of the ``n`` groups."""
    choices = itertools.combinations(range(n), n - touched)
    return F.array(*[F.xxhash64(F.lit(number), *[F.get(parts, k) for k in choice]) for number, choice in enumerate(choices)])


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: every two words one inserted, deleted or replaced code point apart, once."""
    groups = letter_partitions(words)
    # The groups' letters are a column of their own, so that they are taken once a word and not once a signature.
    cut = words.select("word", F.char_length("word").alias("size"), letters_inside(F.col("word"), groups).alias("parts"))
    signed = cut.select("word", "size", F.explode(signatures(F.col("parts"), len(groups))).alias("signature"))
    longer = signed.select(F.xxhash64("signature", "size").alias("key"), F.col("word").alias("a"))
    lengths = F.array(F.col("size"), F.col("size") + 1)
    other = signed.select("signature", F.col("word").alias("b"), F.explode(lengths).alias("longest")).select(
        F.xxhash64("signature", "longest").alias("key"), "b"
    )
    shorter_or_after = (F.char_length("b") < F.char_length("a")) | (F.col("a") < F.col("b"))
    verified = F.levenshtein("a", "b", 1) == 1
    # The rows are many more than the file of words suggests: never broadcast them.
    return longer.hint("merge").join(other, "key").where(shorter_or_after & verified).select("a", "b").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root for words with a form: where following the forms ends.

    Each round doubles the steps taken. A form occurs at least twice as often as its word, so a
    chain is no longer than the logarithm of the largest count.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "form-steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(
            steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "form-steps",
        )
        if not moved.where("moved").take(1):
            return moved.select("word", "root")
        steps = moved.select("word", "root")


def spelling_forms(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of ``docs`` (doc_id, text).

    Words are runs of letters in lower case, at least five code points long, that occur at least
    three times; one run in 97, chosen by its document and letters, has lost a code point. The form
    of a word is the near word (one edit apart) that occurs most often, the first in code-point order
    among equals, if it occurs at least twice as often as the word. Null texts have no words, a
    null id counts as an empty one, and repeated rows count each time. Empty and very long texts are
    like others; an empty table gives no rows. Other columns are not read.
    """
    words = written(counted_words(docs.select("doc_id", "text")), "words")
    pairs = written(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best")
    near = both.join(counts, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    usual = -F.col("best.minus") >= 2 * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(usual, F.col("best.form")).alias("form"), F.when(usual, -F.col("best.minus")).alias("form_n"),
    )
    found = written(found, "word-forms")
    roots = last_forms(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
