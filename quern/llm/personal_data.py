"""Personal data in texts: exact rules, and a character tagger that adds what they miss.

The rules find e-mail addresses, IPv4 addresses, card numbers and telephone numbers. The tagger is
a bidirectional LSTM over characters with CRF transitions, trained in numpy on spans labelled by
the rules in a bounded sample of the corpus and on written-out variants (grouped card numbers,
telephone numbers without a plus sign) that the rules do not know. Every such span has a digit or
an at sign, so windows are laid over all places that have one, in all texts; they overlap, and
each character is tagged by the window in which it lies deepest before spans are read off.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.frames import map_rows
from quern.storage import written

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")


# Rules. Each takes time in proportion to the text, also for very long runs of one character.

def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of each dotted chain, as a leftmost match takes them."""
    for chain in _NUMBERS.finditer(text):
        parts = chain[0].split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + length
            at += length + 1


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", match[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", match[0])) <= 15:
            yield match.span()


def rule_spans(text: str) -> list[Span]:
    """Spans by kind in the order of ``KINDS``, then by start; offsets in code points."""
    if not _TRIGGER.search(text):
        return []
    finders = zip(KINDS, (_emails, _ips, _cards, _phones))
    return [(kind, start, end) for kind, find in finders for start, end in find(text)]


# Windows.

WINDOW, STRIDE, MARGIN = 96, 48, 24


def windows(text: str) -> list[int]:
    """Starts of the windows over every digit and at sign with ``MARGIN`` characters around them."""
    starts: list[int] = []
    reach = 0
    for match in _TRIGGER.finditer(text):
        first = max(match.start() - MARGIN, 0)
        while reach < min(match.end() + MARGIN, len(text)):
            start = max(first, starts[-1] + STRIDE if starts and starts[-1] + WINDOW > first else first)
            starts.append(start)
            reach = start + WINDOW
    return starts


_CLASSES = "@.-+()_%/:=,;!?#$&*|<>[]{}'\"\n \t"
N_CLASSES = len(_CLASSES) + 5 + 26


def _class(c: str) -> int:
    if c in _CLASSES:
        return 1 + _CLASSES.index(c)
    if c.isascii() and c.isdigit():
        return len(_CLASSES) + 1
    if c.isascii() and c.isupper():
        return len(_CLASSES) + 2
    if c.isascii() and c.islower():
        return len(_CLASSES) + 5 + ord(c) - 97
    return len(_CLASSES) + (3 if c.isalpha() else 4)


_CLASS_OF = {c: _class(c) for c in map(chr, range(0x250))}


def encoded(text: str, start: int) -> list[int]:
    """Character classes of a window; 0 fills it up."""
    values = [_CLASS_OF.get(c) or _class(c) for c in text[start : start + WINDOW]]
    return values + [0] * (WINDOW - len(values))


def tags_of(spans: list[Span], start: int) -> list[int]:
    """0 outside spans; 2k + 1 where one of kind k begins, 2k + 2 inside. Cut spans are kept."""
    tags = [0] * WINDOW
    for kind, first, end in spans:
        k = KINDS.index(kind)
        for at in range(max(first, start), min(end, start + WINDOW)):
            tags[at - start] = 2 * k + (1 if at == first else 2)
    return tags


# The tagger.

N_TAGS = 2 * len(KINDS) + 1
HIDDEN = 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Weights are plain arrays by name, so that they can be broadcast."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {"out": draw.normal(0, 0.2, (2 * HIDDEN, N_TAGS)), "bias": np.zeros(N_TAGS), "move": np.zeros((N_TAGS, N_TAGS))}
        for side in "fb":
            self.w[f"x{side}"] = draw.normal(0, 0.2, (N_CLASSES + 1, 4 * HIDDEN))
            self.w[f"h{side}"] = draw.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.w[f"c{side}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # forget gate first
        self.w = {name: values.astype(np.float32) for name, values in self.w.items()}

    def _lstm(self, classes: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        order = range(classes.shape[1]) if side == "f" else range(classes.shape[1] - 1, -1, -1)
        hidden = cell = np.zeros((len(classes), HIDDEN), np.float32)
        out, trace = np.empty((*classes.shape, HIDDEN), np.float32), []
        for t in order:
            gates = self.w[f"x{side}"][classes[:, t]] + hidden @ self.w[f"h{side}"] + self.w[f"c{side}"]
            forget, enter, leave = np.split(_sigmoid(gates[:, : 3 * HIDDEN]), 3, axis=1)
            fresh = np.tanh(gates[:, 3 * HIDDEN :])
            before_hidden, before = hidden, cell
            cell = forget * before + enter * fresh
            squashed = np.tanh(cell)
            hidden = leave * squashed
            out[:, t] = hidden
            trace.append((t, before_hidden, before, forget, enter, leave, fresh, squashed))
        return out, trace

    def _lstm_back(self, classes: np.ndarray, side: str, trace: list, slope: np.ndarray, grads: dict) -> None:
        gh = np.zeros_like(self.w[f"h{side}"])
        all_gates = np.empty((*classes.shape, 4 * HIDDEN), np.float32)
        later_hidden = later_cell = np.zeros((len(classes), HIDDEN), np.float32)
        for t, before_hidden, before, forget, enter, leave, fresh, squashed in reversed(trace):
            dh = slope[:, t] + later_hidden
            dc = dh * leave * (1 - squashed**2) + later_cell
            gates = np.concatenate([
                dc * before * forget * (1 - forget), dc * fresh * enter * (1 - enter),
                dh * squashed * leave * (1 - leave), dc * enter * (1 - fresh**2),
            ], axis=1)
            all_gates[:, t] = gates
            gh += before_hidden.T @ gates
            later_hidden, later_cell = gates @ self.w[f"h{side}"].T, dc * forget
        flat = all_gates.reshape(-1, 4 * HIDDEN)
        one_hot = np.eye(N_CLASSES + 1, dtype=np.float32)[classes.reshape(-1)]
        grads |= {f"x{side}": one_hot.T @ flat, f"h{side}": gh, f"c{side}": flat.sum(axis=0)}

    def _scores(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        forward, first = self._lstm(classes, "f")
        backward, second = self._lstm(classes, "b")
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.w["out"] + self.w["bias"], both, [first, second]

    def _chains(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums of the tag paths up to, and after, each place."""
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, scores.shape[1]):
            ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + self.w["move"], 1) + scores[:, t]
        for t in range(scores.shape[1] - 2, -1, -1):
            behind[:, t] = _log_sum(self.w["move"] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        return ahead, behind

    def gradients(self, classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its slopes."""
        n = len(classes)
        scores, both, traces = self._scores(classes)
        ahead, behind = self._chains(scores)
        whole = _log_sum(ahead[:, -1], 1)
        right = np.take_along_axis(scores, tags[:, :, None], 2).sum(axis=(1, 2)) + self.w["move"][tags[:, :-1], tags[:, 1:]].sum(axis=1)
        slope = np.exp(ahead + behind - whole[:, None, None])
        np.put_along_axis(slope, tags[:, :, None], np.take_along_axis(slope, tags[:, :, None], 2) - 1, 2)
        steps = ahead[:, :-1, :, None] + self.w["move"] + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        move = np.exp(steps).sum(axis=(0, 1))
        np.add.at(move, (tags[:, :-1], tags[:, 1:]), -1.0)
        slope /= n
        grads = {
            "out": both.reshape(-1, 2 * HIDDEN).T @ slope.reshape(-1, N_TAGS),
            "bias": slope.sum(axis=(0, 1)), "move": move / n,
        }
        inward = slope @ self.w["out"].T
        self._lstm_back(classes, "f", traces[0], inward[:, :, :HIDDEN], grads)
        self._lstm_back(classes, "b", traces[1], inward[:, :, HIDDEN:], grads)
        return float((whole - right).mean()), grads

    def train(self, classes: np.ndarray, tags: np.ndarray, epochs: int = 12, size: int = 64, rate: float = 0.02, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(classes))
            for at in range(0, len(order), size):
                _, grads = self.gradients(classes[order[at : at + size]], tags[order[at : at + size]])
                step += 1
                norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-12))
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g**2
                    self.w[k] = self.w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)

    def decode(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag path of each window, and the posterior of each of its tags."""
        scores, _, _ = self._scores(classes)
        ahead, behind = self._chains(scores)
        posterior = np.exp(ahead + behind - _log_sum(ahead[:, -1], 1)[:, None, None])
        best, origin = scores[:, 0], []
        for t in range(1, scores.shape[1]):
            ways = best[:, :, None] + self.w["move"]
            origin.append(ways.argmax(axis=1))
            best = ways.max(axis=1) + scores[:, t]
        path = np.empty(classes.shape, np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(classes.shape[1] - 2, -1, -1):
            path[:, t] = np.take_along_axis(origin[t], path[:, t + 1, None], 1)[:, 0]
        return path, np.take_along_axis(posterior, path[:, :, None], 2)[:, :, 0]


# Training data.

#: Windows taken from the corpus and windows written out: the bound of the sample.
SAMPLE, VARIANTS = 700, 1800


def labelled_windows(docs: DataFrame, limit: int) -> list[tuple[str, list[int]]]:
    """Different windows of the corpus with the rules' tags: those with the smallest hashes, at most ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if text and _TRIGGER.search(text):
                    spans = rule_spans(text)
                    rows += [(text[s : s + WINDOW], tags_of(spans, s)) for s in windows(text)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["window", "tags"]
                )

    rows = docs.select("text").mapInArrow(run, "window string, tags array<int>")
    # Copies count once, so that the cut and the limit apply to different windows.
    found = written(rows.dropDuplicates(["window", "tags"]), "labelled-windows")
    # Hashes below the cut are some four times as many as wanted, so no task sends the driver more.
    cut = min(1.0, 4 * limit / max(found.count(), 1))
    hashes = F.xxhash64("window")
    low = found.where(hashes <= F.lit(int(-(2**63) + cut * (2**64 - 1025))))
    chosen = low.orderBy(hashes, "window", "tags").limit(limit)
    return [(r["window"], r["tags"]) for r in chosen.collect()]


def _digits(draw: random.Random, n: int) -> str:
    return "".join(draw.choice("0123456789") for _ in range(n))


def _card_number(draw: random.Random) -> str:
    start = draw.choice("345") + _digits(draw, 14)
    return next(start + d for d in "0123456789" if luhn(start + d))


def written_windows(n: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Invented words with private and harmless strings among them, several to a window and cut at its ends."""
    draw = random.Random(seed)

    def word() -> str:
        made = "".join(draw.choice("abcdefghiklmnoprstuvwz") for _ in range(draw.randint(2, 9)))
        return made.capitalize() if draw.random() < 0.15 else made

    def grouped(number: str, mark: str) -> str:
        return mark.join(number[k : k + 4] for k in range(0, len(number), 4))

    def name() -> str:
        return draw.choice([word().lower(), word().lower() + _digits(draw, draw.randint(1, 6))])

    private = (
        ("email", lambda: f"{name()}.{draw.randint(1, 9999)}@{name()}.{word().lower()}.{draw.choice(['com', 'org', 'net'])}"),
        ("email", lambda: f"{name()}{draw.choice('_.-+')}{name()}@{name()}.{draw.choice(['com', 'org', 'de', 'fr', 'es'])}"),
        ("ip", lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4))),
        ("card", lambda: grouped(_card_number(draw), draw.choice(["", " ", "-"]))),
        ("phone", lambda: f"+{draw.randint(1, 99)} ({_digits(draw, 3)}) {_digits(draw, 3)}-{_digits(draw, 4)}"),
        ("phone", lambda: f"({_digits(draw, 3)}) {_digits(draw, 3)}-{_digits(draw, 4)}"),
        ("phone", lambda: f"({_digits(draw, 3)}) {_digits(draw, 3)}-{_digits(draw, 4)}"),
        ("phone", lambda: draw.choice("--.").join((_digits(draw, 3), _digits(draw, 3), _digits(draw, 4)))),
        ("phone", lambda: draw.choice("--.").join((_digits(draw, 3), _digits(draw, 3), _digits(draw, 4)))),
        ("phone", lambda: f"+{draw.randint(1, 99)}{draw.choice([' ', '-'])}{_digits(draw, 3)}{draw.choice([' ', '-', '.'])}{_digits(draw, 7)}"),
    )
    harmless = (
        lambda: str(draw.randint(1, 9999)), lambda: str(draw.randint(1, 9999)), lambda: _digits(draw, draw.choice([5, 6, 9, 11, 12, 20, 24, 32])),
        lambda: f"{draw.randint(1900, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}",
        lambda: f"{draw.randint(1, 28)}.{draw.randint(1, 12)}.{draw.randint(1900, 2030)}", lambda: f"{draw.randint(0, 23)}:{draw.randint(0, 59):02}",
        lambda: f"{draw.randint(1, 999)}-{draw.randint(1, 9999)}", lambda: f"({draw.randint(1, 2030)})",
        lambda: f"{draw.randint(0, 9)}.{draw.randint(0, 20)}.{draw.randint(0, 20)}", lambda: f"{draw.randint(0, 999)}.{_digits(draw, 2)}",
        lambda: f"password={draw.getrandbits(72):x}", lambda: f'token = "{draw.getrandbits(160):x}"',
        lambda: "AKIA" + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
        lambda: f"@{word()}", lambda: f"ISBN 978-{_digits(draw, 10)}", lambda: f"{word()}/{word()}{draw.randint(1, 99)}",
    )
    rows = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < 2 * WINDOW:
            text += "".join(f"{word()}{draw.choice([' ', ' ', ' ', ', ', '. '])}" for _ in range(draw.choice([0, 1, 1, 2, 3, 6, 10])))
            kind, make = draw.choice(private) if draw.random() < 0.5 else ("", draw.choice(harmless))
            piece = make()
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += f"{piece}{draw.choice([' ', ' ', '. ', ', '])}"
        start = draw.randint(0, WINDOW)
        rows.append((text[start : start + WINDOW], tags_of(spans, start)))
    return rows


def trained(docs: DataFrame, sample: int = SAMPLE, variants: int = VARIANTS) -> Tagger:
    """The tagger, trained on the driver on at most ``sample + variants`` windows."""
    rows = labelled_windows(docs, sample) + written_windows(variants)
    tagger = Tagger()
    tagger.train(np.array([encoded(text, 0) for text, _ in rows]), np.array([tags for _, tags in rows]))
    return tagger


# Spans of whole texts.

CONFIDENCE = 0.95
DECODED_AT_ONCE = 512


def _plausible(kind: str, piece: str) -> bool:
    digits = len(_NOT_DIGIT.sub("", piece))
    if kind == "email":
        return "@" in piece[1:-1] and "." in piece and " " not in piece
    if kind == "ip":
        return piece.count(".") == 3 and digits + 3 == len(piece)
    low, high = (13, 19) if kind == "card" else (8, 15)
    if not low <= digits <= high or re.search(r"[^0-9 ().+-]", piece):
        return False
    return kind == "phone" or luhn(_NOT_DIGIT.sub("", piece))


def tagger_spans(tagger: Tagger, text: str) -> list[Span]:
    """Spans read off the tags of all windows of a text, with a mean posterior of ``CONFIDENCE``."""
    starts = windows(text)
    if not starts:
        return []
    chosen: dict[int, tuple[int, int, float]] = {}  # place: depth in its window, tag, posterior
    for at in range(0, len(starts), DECODED_AT_ONCE):
        some = starts[at : at + DECODED_AT_ONCE]
        tags, posteriors = tagger.decode(np.array([encoded(text, s) for s in some]))
        for start, row, chances in zip(some, tags.tolist(), posteriors.tolist()):
            length = min(WINDOW, len(text) - start)
            for k in range(length):
                left = k if start else WINDOW
                right = length - 1 - k if start + length < len(text) else WINDOW
                depth = min(left, right)
                if start + k not in chosen or depth > chosen[start + k][0]:
                    chosen[start + k] = (depth, row[k], chances[k])
    spans: list[Span] = []
    run: list[int] = []

    def close() -> None:
        if run:
            kind = KINDS[(chosen[run[0]][1] - 1) // 2]
            sure = sum(chosen[p][2] for p in run) / len(run)
            start, end = run[0], run[-1] + 1
            while start > 0 and text[start].isalnum() and text[start - 1].isalnum():  # words are not cut
                start -= 1
            while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
                end += 1
            if sure >= CONFIDENCE and _plausible(kind, text[start:end]):
                spans.append((kind, start, end))
            run.clear()

    for place in sorted(chosen):
        tag = chosen[place][1]
        goes_on = bool(run) and place == run[-1] + 1 and tag > 0 and tag % 2 == 0 and (tag - 1) // 2 == (chosen[run[-1]][1] - 1) // 2
        if not goes_on:
            close()
            if tag % 2 == 0:
                continue
        run.append(place)
    close()
    return spans


def all_spans(tagger: Tagger, text: str) -> tuple[list[Span], list[Span]]:
    """The rules' spans, and these with the tagger's that touch none of them, in one order."""
    base = rule_spans(text)
    added = [
        s for s in tagger_spans(tagger, text) if all(s[2] <= start or s[1] >= end for _, start, end in base)
    ]
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of ``docs``.

    Null text is empty. Counts and digest are those of the rules' spans; spans lists all. Repeated
    rows, equal and null ids are read each for itself. An empty table gives no rows. Texts are
    read whole; other columns are not read.
    """
    tagger = tagger or trained(docs)
    weights = docs.sparkSession.sparkContext.broadcast(tagger.w)  # some thousand numbers

    def setup() -> Tagger:
        own = Tagger()
        own.w = weights.value
        return own

    def row(own: Tagger, doc_id: int | None, text: str | None) -> tuple:
        base, spans = all_spans(own, text or "")
        counts = [sum(s[0] == kind for s in base) for kind in KINDS]
        return doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

    names = ", ".join(f"n_{kind} long" for kind in KINDS)
    return map_rows(docs, ["doc_id", "text"], row, f"doc_id long, {names}, base_sha256 string, spans string", setup)


def masked(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlaps become one.

    Null and empty texts stay as they are. Repeated rows, equal and null ids are masked each for itself.
    An empty table stays empty. Columns may have any names.
    """
    tagger = tagger or trained(docs)
    weights = docs.sparkSession.sparkContext.broadcast(tagger.w)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger()
        own.w = weights.value
        for batch in batches:
            texts = [text and mask(text, all_spans(own, text)[1]) for text in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def mask(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
