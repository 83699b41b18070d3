"""Quality rules combined by weak supervision.

Each rule looks at counts of a document and votes for a good text, for a bad one, or abstains.
The rules' accuracies are not given: expectation-maximisation estimates, from how often each
combination of votes occurs in the whole corpus, the share of good documents and how each rule
votes on good and on bad ones. A document is kept when the posterior probability that it is good
reaches a threshold. All of it is DataFrame functions; only the table of vote combinations (at
most ``3 ** number of rules`` rows, whatever the corpus) reaches the driver, for the estimation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.frames import SPACES, fresh_name
from quern.storage import written

GOOD, BAD, ABSTAIN = 1, 2, 0
SYMBOLS = "#*$%&|<>"
CAPITALS = "".join(map(chr, [*range(65, 91), *(c for c in range(192, 223) if c != 215)]))
#: Counts that the contract names; the rules also use the ones after them.
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE_COUNTS, "n_lines", "n_capitals", "n_exclamations", "n_function_words", "n_plain_words")


@dataclass(frozen=True)
class Rule:
    """Votes on the ratio of two counts: bad outside ``fine``, good inside ``good``, else abstains."""

    name: str
    count: str
    per: str
    fine: tuple[float, float]
    good: tuple[float, float] | None = None

    def vote(self, counts: Column) -> Column:
        ratio = counts[self.count] / F.greatest(counts[self.per], F.lit(1))
        vote = F.when(~ratio.between(*map(float, self.fine)), BAD)
        if self.good:
            vote = vote.when(ratio.between(*map(float, self.good)), GOOD)
        return vote.otherwise(ABSTAIN)


#: Symptoms of bad texts only vote for bad ones; the last two know both kinds.
RULES = (
    Rule("word length", "word_chars", "n_words", (2.0, 14.0)),
    Rule("symbols", "n_symbols", "n_words", (0.0, 0.2)),
    Rule("capitals", "n_capitals", "word_chars", (0.0, 0.4)),
    Rule("exclamations", "n_exclamations", "n_words", (0.0, 0.3)),
    Rule("repeated lines", "n_dup_lines", "n_lines", (0.0, 0.3)),
    Rule("repeated words", "n_repeat_words", "n_words", (0.0, 0.4)),
    Rule("function words", "n_function_words", "n_words", (0.04, 1.0), (0.1, 1.0)),
    Rule("plain words", "n_plain_words", "n_words", (0.6, 1.0), (0.85, 1.0)),
)

#: Common function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to a in is it that for on with as are was be by this at from or an he they which not "
    "de la le les et des en un une du que qui dans pour par sur est pas plus au ne "
    "der die das und von den mit ist im für dem nicht ein eine auf als auch zu sich "
    "el los las y se una con del por su al lo es para como"
).split()


def _characters(text: Column, which: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, which, ""))


def with_counts(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and a struct column ``name`` of the counts in ``COUNTS``; null text has no words.

    The repeated word windows of a text are found by sorting the hashes of its three-word
    windows inside the row, so that no text is shuffled.
    """
    text, words, sorted_windows, places = (f"{name}_{x}" for x in ("text", "words", "windows", "places"))
    clean = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(clean, F.lit(SPACES))
    df = docs.withColumns({
        text: clean,
        words: F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")),
    })
    # Both sides of the comparison come from one sorted array: equal windows are neighbours.
    df = df.withColumn(sorted_windows, F.expr(
        f"if(size({words}) < 4, array(), sort_array(transform(sequence(0, greatest(size({words}) - 3, 0)), "
        f"i -> struct(xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2)) as h, i as i))))"
    ))
    df = df.withColumn(places, F.expr(
        f"sort_array(array_distinct(flatten(zip_with({sorted_windows}, slice({sorted_windows}, 2, "
        f"greatest(size({sorted_windows}) - 1, 0)), (a, b) -> if(a.h = b.h, array(a.i, b.i), array())))))"
    ))
    covered = F.expr(
        f"aggregate(zip_with({places}, slice({places}, 2, greatest(size({places}) - 1, 0)), "
        "(a, b) -> least(coalesce(b - a, 3), 3)), 0L, (s, x) -> s + x)"
    )
    lines = f"filter(split({text}, '\\n'), x -> x rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]')"
    known = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    counts = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.translate(F.col(text), SPACES, "")),
        "n_symbols": _characters(F.col(text), SYMBOLS),
        "n_dup_lines": F.expr(f"size({lines}) - size(array_distinct({lines}))"),
        "n_repeat_words": covered,
        "n_lines": F.expr(f"size({lines})"),
        "n_capitals": _characters(F.col(text), CAPITALS),
        "n_exclamations": _characters(F.col(text), "!"),
        "n_function_words": F.expr(f"size(filter({words}, w -> lower(w) in ({known})))"),
        "n_plain_words": F.expr(f"size(filter({words}, w -> w rlike '^\\\\p{{L}}+[.,;:?]?$'))"),
    }
    struct = F.struct(*(value.cast("long").alias(key) for key, value in counts.items()))
    # Exploding one row keeps the optimiser from copying the counts into every later use of them.
    return df.withColumn(name, F.explode(F.array(struct))).drop(text, words, sorted_windows, places)


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def pattern(counts: Column, rules: Sequence[Rule]) -> Column:
    """All votes as one number, three digits to a rule."""
    return sum((rule.vote(counts) * 3**k for k, rule in enumerate(rules)), F.lit(0)).cast("int")


def estimate(frequencies: dict[int, int], n_rules: int, rounds: int = 200, tolerance: float = 1e-9) -> dict[int, float]:
    """Posterior probability of a good document for each combination of votes.

    Expectation-maximisation over two unknowns: the share of good documents, and each rule's
    accuracy, the chance that its vote is right where it votes. Abstaining says nothing. It starts
    from three good documents in four and an accuracy of 0.8, which also count as ten votes seen
    before, so that a rule that hardly votes keeps a usable accuracy.
    """
    prior_votes, first_good, first_accuracy = 10, 0.75, 0.8
    votes = {p: [p // 3**k % 3 for k in range(n_rules)] for p in frequencies}
    total = sum(frequencies.values())
    good, accuracy = first_good, [first_accuracy] * n_rules
    posterior: dict[int, float] = {}
    before = -math.inf
    for _ in range(rounds):
        likelihood = 0.0
        for p, vote in votes.items():
            a, b = math.log(good), math.log(1 - good)
            for right, v in zip(accuracy, vote):
                if v != ABSTAIN:
                    a += math.log(right if v == GOOD else 1 - right)
                    b += math.log(right if v == BAD else 1 - right)
            top = max(a, b)
            both = top + math.log(math.exp(a - top) + math.exp(b - top))
            likelihood += frequencies[p] * both
            posterior[p] = math.exp(a - both)
        if likelihood - before <= tolerance * abs(likelihood):
            break
        before = likelihood
        weight = sum(n * posterior[p] for p, n in frequencies.items())
        good = (weight + first_good * prior_votes) / (total + prior_votes)
        right, cast = [first_accuracy * prior_votes] * n_rules, [float(prior_votes)] * n_rules
        for p, vote in votes.items():
            for k, v in enumerate(vote):
                if v != ABSTAIN:
                    cast[k] += frequencies[p]
                    right[k] += frequencies[p] * (posterior[p] if v == GOOD else 1 - posterior[p])
        accuracy = [min(max(r / c, 0.5), 0.999) for r, c in zip(right, cast)]
    return posterior


def judged(counted: DataFrame, name: str, rules: Sequence[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """``counted`` (with its counts in ``name``) and, inside ``name``, base_failed, good and kept.

    ``counted`` is read twice: to count the combinations of votes, and for the result.
    """
    spark = counted.sparkSession
    code = fresh_name(counted, "vote_pattern")
    voted = counted.withColumn(code, pattern(F.col(name), rules))
    rows = voted.groupBy(code).count().collect()  # at most 3 ** len(rules)
    posterior = estimate({r[0]: r[1] for r in rows}, len(rules))
    chances = spark.createDataFrame([*posterior.items()], f"{code} int, {code}_good double")
    failed = base_failed(F.col(name))
    return (
        voted.join(F.broadcast(chances), code, "left")  # bounded as the collected rows are
        .withColumn(name, F.col(name).withField("base_failed", failed)
                    .withField("good", F.col(f"{code}_good"))
                    .withField("kept", ~failed & (F.col(f"{code}_good") >= threshold)))
        .drop(code, f"{code}_good")
    )


def quality_counts(docs: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the counts, base_failed, kept, and good (the posterior).

    Null or empty text has no words and fails the base rule. Repeated rows and equal ids are
    judged each for itself; a null id stays null. An empty table gives an empty result. Columns
    other than doc_id and text are not looked at. Texts are split whole, whatever their length.
    """
    counted = written(with_counts(docs.select("doc_id", "text"), "quality").drop("text"), "quality-counts")
    result = judged(counted, "quality", rules, threshold)
    names = [*BASE_COUNTS, "base_failed", "kept", "good"]
    return result.select("doc_id", *(F.col("quality")[n].alias(n) for n in names))


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs`` and no others.

    Null and empty texts fail the base rule and go. Ids are not looked at: repeated rows, equal and null
    ids are judged each for itself. An empty table stays empty. Columns may have any names. Counting is
    the dear part, so it runs once and the rows are written with their votes.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    counted = with_counts(docs.select(row, "text"), "quality")
    counts = F.col("quality")
    voted = written(counted.select("row", pattern(counts, rules).alias("votes"), base_failed(counts).alias("failed")), "quality-votes")
    frequencies = voted.groupBy("votes").count().collect()  # at most 3 ** len(rules)
    posterior = estimate({r[0]: r[1] for r in frequencies}, len(rules))
    good = [votes for votes, chance in posterior.items() if chance >= threshold]
    return voted.where(~F.col("failed") & F.col("votes").isin(good)).select("row.*")
