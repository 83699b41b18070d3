"""Plain Python versions of the operators' results, for small inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORDS = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = WORDS.findall(lower(text))
    windows = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in windows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints, most=2):
    """Smallest id reached by each id, over links of at most ``most`` bits."""
    parent = {i: i for i in fingerprints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    items = list(fingerprints.items())
    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if bin(a ^ b).count("1") <= most:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in fingerprints}


def repeated(texts, length):
    """Bytes left and maximal removed runs of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        out.append((bytes(b for b, g in zip(d, gone[1:]) if not g), int((gone[1:] & ~gone[:-1]).sum())))
    return out


def quality_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal(text):
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        check = sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])
        if 16 <= len(digits) <= 19 and check % 10 == 0:
            spans.append(("card", *m.span()))
    return spans + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def unigrams(texts):
    """Training tokens, and (held out, tokens, known, base score) of each id."""
    tokens = {i: [*WORDS.findall(lower(t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, different = sum(counts.values()), len(counts)
    score = {
        i: float(np.sum(np.log10([(counts[w] + 0.5) / (total + 0.5 * (different + 1)) for w in ws]))) for i, ws in tokens.items()
    }
    return total, {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), score[i]) for i, ws in tokens.items()}
