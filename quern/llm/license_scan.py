"""Licence wording in texts, found by conditional compression and confirmed word by word.

A candidate block is the text around words that licences use, whatever its length. Its words are
cut into windows that overlap by the longest template with its allowed differences. A window is
compressed by itself and with each template as a raw dictionary, under the same fixed parameters;
a template whose dictionary saves a good part of what it can save is tried, the largest saving
first. It is confirmed by laying the template's words along the window with the fewest
differences: they must be few, and none may touch a word that tells licences apart (a number,
``lesser``, ``nc`` and the like). Confirmed words are taken out of the block, so that a block can
hold several licences. Templates that allow no difference are too short for a saving to tell
anything and are looked up by their words.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quern.llm.license_templates import templates

#: Characters around a trigger that belong to its block.
RADIUS = 300
#: Share of its largest possible saving that a template must reach to be tried.
SAVING = 0.25
#: Differing words allowed, as a share of the template's.
DIFFERENCES = 0.1
#: Templates of at most this many words are names; shorter spellings of them are templates of their own.
NAME_WORDS = 12
#: Words of a window beyond its overlap with the next.
STEP = 200
#: The same for all data, with and without a dictionary, so that sizes compare.
PACKING = zstandard.ZstdCompressionParameters(
    window_log=17, hash_log=14, chain_log=14, search_log=4, min_match=3, target_length=16, strategy=zstandard.STRATEGY_LAZY2,
    write_content_size=0,
)

_STEMS = (
    "licen", "copyright", "spdx", "warrant", "permission", "redistribut", "creative commons", "cc by", "cc-by", "cc0", "gpl", "public domain",
    "bsd", "mpl 2", "mpl-2", "mpl2", "mpl v", "mplv", "mpl version", "epl 2", "epl-2", "epl2", "epl v", "eplv", "epl version", "attribution",
)
_TRIGGER = re.compile("|".join(map(re.escape, _STEMS)), re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
#: Words of no weight, and words that tell licences apart (besides those with a digit).
_WEIGHTLESS = frozenset({"the", "a"})
_DECIDING = frozenset(
    "mit apache gnu general lesser affero bsd clause mozilla isc boost eclipse cc by sa nc nd attribution sharealike noncommercial "
    "noderivatives not neither".split()
)
_LEAD = frozenset("this work software file program code document text is are licensed licenced released distributed published available provided made".split())

FOUND = "doc_id long, license string, start long, stop long, exact boolean, n_words int, n_differences int, differences string, saved_bytes int"


def _words(text: str) -> list[tuple[str, int, int]]:
    found = ((m[0].lower().replace("licence", "license"), m.start(), m.end()) for m in _WORD.finditer(text))
    return [w for w in found if w[0] not in _WEIGHTLESS]


class Template:
    def __init__(self, license_id: str, text: str) -> None:
        self.license_id, self.text = license_id, text
        self.words = [w for w, _, _ in _words(text)]
        self.allowed = int(DIFFERENCES * len(self.words)) if len(self.words) > NAME_WORDS else 0
        data = packable(self.words)
        dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._packer = zstandard.ZstdCompressor(compression_params=PACKING, dict_data=dictionary)
        self.most_saved = max(1, plain_size(data) - self.size(data))

    def size(self, data: bytes) -> int:
        return len(self._packer.compress(data))


def packable(words: list[str]) -> bytes:
    """Words as they are compressed: letter case, line breaks and comment marks cost nothing."""
    return " ".join(words).encode()


_PLAIN = zstandard.ZstdCompressor(compression_params=PACKING)


def plain_size(data: bytes) -> int:
    return len(_PLAIN.compress(data))


def fitted(template: np.ndarray, block: np.ndarray) -> tuple[int, int, int]:
    """Fewest word edits that turn ``template`` into a run of ``block``, and the run [first, end)."""

    def last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        places = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64)
        for word in a:
            below = row + 1
            below[1:] = np.minimum(below[1:], row[:-1] + (b != word))
            row = np.minimum.accumulate(below - places) + places
        return row

    ends = last_row(template, block)
    end = int(ends.argmin())
    starts = last_row(template[::-1], block[:end][::-1])
    least = int(ends[end])
    # of equally good runs that end here, the one with the template's length if there is one
    lengths = np.flatnonzero(starts == least)
    length = int(lengths[np.abs(lengths - len(template)).argmin()]) if len(lengths) else len(template)
    return least, end - length, end


def differences(template: list[str], found: list[str]) -> list[tuple[str, str]]:
    matcher = difflib.SequenceMatcher(None, template, found, autojunk=False)
    return [(" ".join(template[a:b]), " ".join(found[c:d])) for tag, a, b, c, d in matcher.get_opcodes() if tag != "equal"]


def _decides(words: str) -> bool:
    return any(w in _DECIDING or any(c.isdigit() for c in w) for w in words.split())


def blocks(text: str) -> list[tuple[int, int]]:
    """Runs of text with ``RADIUS`` characters around each trigger, grown to whole words."""
    found: list[list[int]] = []
    for match in _TRIGGER.finditer(text):
        start, stop = max(0, match.start() - RADIUS), min(len(text), match.end() + RADIUS)
        if found and start <= found[-1][1]:
            found[-1][1] = max(stop, found[-1][1])
        else:
            found.append([start, stop])
    return [(start, stop) for start, stop in found]


class Scanner:
    def __init__(self) -> None:
        self.templates = [Template(*t) for t in templates()]
        self.numbers: dict[str, int] = {}
        self.patterns = [np.array([self.numbers.setdefault(w, len(self.numbers)) for w in t.words]) for t in self.templates]
        self.overlap = max(len(t.words) + 3 * t.allowed for t in self.templates)
        self.loose = [k for k, t in enumerate(self.templates) if t.allowed]
        # Templates without allowed differences by their first word, the longest first.
        self.strict: dict[str, list[int]] = {}
        for k in sorted((k for k, t in enumerate(self.templates) if not t.allowed), key=lambda k: (-len(self.templates[k].words), k)):
            self.strict.setdefault(self.templates[k].words[0], []).append(k)

    def scan(self, text: str | None) -> list[tuple]:
        """Values of ``FOUND`` after doc_id, in the order of their places."""
        lowered = (text or "").lower()
        if not any(stem in lowered for stem in _STEMS):
            return []
        rows = [row for start, stop in blocks(text) for row in self._block(text, start, stop)]
        return sorted(rows, key=lambda row: (row[1], row[0]))

    def _block(self, text: str, start: int, stop: int) -> list[tuple]:
        words = [(w, start + a, start + b) for w, a, b in _words(text[start:stop])]
        numbers = np.array([self.numbers.get(w, -1) for w, _, _ in words], np.int64)
        rows = []
        for at in range(0, max(1, len(words) - self.overlap), STEP):
            rows += self._window(words, numbers, at, min(len(words), at + self.overlap + STEP))
        return rows + self._names(text, words, numbers)

    def _window(self, words: list[tuple[str, int, int]], numbers: np.ndarray, at: int, till: int) -> list[tuple]:
        """Templates with allowed differences in words [at, till). A run so near an edge that it
        could go on beyond it is left to the neighbouring window, which holds it whole."""
        data = packable([w for w, _, _ in words[at:till]])
        plain = plain_size(data)
        saved = {k: plain - self.templates[k].size(data) for k in self.loose}
        ranked = sorted((k for k in self.loose if saved[k] >= SAVING * self.templates[k].most_saved), key=lambda k: (-saved[k], k))
        rows = []
        for k in ranked:
            template, pattern, open_words = self.templates[k], self.patterns[k], numbers[at:till].copy()
            while len(open_words):
                edits, first, end = fitted(pattern, open_words)
                if edits > template.allowed:
                    break
                open_words[first:end] = -2  # taken; equal to nothing
                first, end = first + at, end + at
                if edits and ((at and first - edits < at) or (till < len(words) and end + edits > till)):
                    continue
                changes = differences(template.words, [w for w, _, _ in words[first:end]])
                if any(_decides(a) or _decides(b) for a, b in changes):
                    continue
                rows.append(_row(template, words, numbers, first, end, changes, edits, saved[k]))
                numbers[first:end] = -2
        return rows

    @staticmethod
    def _goes_on(text: str, words: list[tuple[str, int, int]], first: int, end: int) -> bool:
        """Whether a name is part of a longer one: a version with more digits, or a kind with a word in front."""
        after = words[end - 1][2]
        if words[end - 1][0][-1].isdigit() and text[after : after + 1] in (".", ",") and text[after + 1 : after + 2].isdigit():
            return True
        before = words[first - 1][0] if first else ""
        return words[first][0] == "general" and before in ("gnu", "lesser", "affero", "library") and (first < 2 or before != "gnu")

    def _names(self, text: str, words: list[tuple[str, int, int]], numbers: np.ndarray) -> list[tuple]:
        """Templates without allowed differences, wherever their words stand."""
        rows = []
        at = 0
        while at < len(words):
            for k in self.strict.get(words[at][0], ()):
                end = at + len(self.patterns[k])
                if np.array_equal(numbers[at:end], self.patterns[k]) and not self._goes_on(text, words, at, end):
                    near = packable([w for w, _, _ in words[max(0, at - STEP // 2) : end + STEP // 2]])
                    saved = plain_size(near) - self.templates[k].size(near)
                    rows.append(_row(self.templates[k], words, numbers, at, end, [], 0, saved))
                    numbers[at:end] = -2
                    at = end - 1
                    break
            at += 1
        return rows


def _row(template: Template, words: list, numbers: np.ndarray, first: int, end: int, changes: list, edits: int, saved: int) -> tuple:
    lead = first
    # "under (the terms of) the NAME"
    for phrase in (["under"], ["under", "terms", "of"]):
        if [w for w, _, _ in words[max(0, first - len(phrase)) : first]] == phrase and (numbers[first - len(phrase) : first] != -2).all():
            lead = first - len(phrase)
    while lead != first and lead and numbers[lead - 1] != -2 and words[lead - 1][0] in _LEAD:
        lead -= 1
    return (
        template.license_id, words[lead][1], words[end - 1][2], not changes, len(template.words), edits,
        "; ".join(f"{a or '-'} > {b or '-'}" for a, b in changes), saved,
    )


def find_licenses(docs: DataFrame) -> DataFrame:
    """A row for each licence wording found in ``docs``, with its place in code points.

    Null and empty texts have none. Repeated rows are scanned each; null ids stay null. An empty
    table gives no rows. Texts are scanned whole; other columns are not read.
    """
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
    names = [f.split(" ")[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [
                (doc_id, *row) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for row in scanner.scan(text)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)
