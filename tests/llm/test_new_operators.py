from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import prose

from quern.llm import spelling_variants, topk_search, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, score int"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], VECTORS).repartition(4)


def whole(vector):
    return vector is not None and all(x is not None and np.isfinite(x) for x in vector)


# Vector codes

def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes, errors and final entries by plain loops."""
    kept = sorted(((i, v, label) for i, v, label in rows if whole(v)), key=lambda r: (r[0] is None, r[0] or 0))
    floors = [[int(np.floor(np.float64(np.float32(x)) * scale)) for x in v] for _, v, _ in kept]
    width = len(floors[0]) // parts
    cut = [[v[k * width : (k + 1) * width] for k in range(parts)] for v in floors]
    books = [[cut[n][k] for n in range(min(entries, len(cut)))] for k in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for k, book in enumerate(books):
            chosen = [nearest(c[k], book)[1] for c in cut]
            for e in range(len(book)):
                members = [c[k] for c, number in zip(cut, chosen) if number == e]
                if members:
                    book[e] = [sum(x) // len(members) for x in zip(*members)]
    found = [[nearest(c[k], books[k]) for k in range(parts)] for c in cut]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = Counter()
    for (_, _, label), f in zip(kept, found):
        errors[label] += sum(d for d, _ in f)
    return sorted(
        ((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), errors[label], sha) for (i, _, label), f in zip(kept, found)), key=str
    )


def test_codes_against_plain_loops(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(0, 0.2, 16).tolist(), i % 3 if i % 4 else None) for i in range(150)]
    rows += [(200 + i, rows[5][1], 7) for i in range(40)]  # copies: equal distances everywhere
    rows += [(300, None, 1), (301, [1.0] * 15 + [None], 1), (302, [float("nan")] * 16, 2), (303, [float("-inf")] + [0.0] * 15, 2)]
    rows += [(None, draw.normal(0, 0.2, 16).tolist(), None), (400, [0.0] * 16, 9), (400, [0.0] * 16, 9), (-3, [-1e-9] * 16, 9)]
    got = vector_codes.vector_codes(vector_table(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(rows)


def test_codes_of_few_empty_and_no_vectors(spark):
    few = [(i, [0.5 * i] * 8, 1) for i in range(3)]
    assert sorted(map(tuple, vector_codes.vector_codes(vector_table(spark, few)).collect()), key=str) == plain_codes(few)
    empty = vector_codes.vector_codes(vector_table(spark, [(1, [], 1), (2, [], None)])).collect()
    assert {(r.vec_id, r.code, r.error) for r in empty} == {(1, "00" * 8, 0), (2, "00" * 8, 0)}
    assert vector_codes.vector_codes(vector_table(spark, [(1, None, 1)])).count() == 0
    with pytest.raises(Exception, match="equal parts"):
        vector_codes.vector_codes(vector_table(spark, [(1, [0.0] * 9, 1)])).collect()


@pytest.mark.parametrize("n, arity", [(1, 4), (3, 4), (16, 4), (16, 2), (200, 5)])
def test_tree_finds_the_first_nearest(n, arity):
    draw = np.random.default_rng(n)
    points = draw.integers(-40, 40, (n, 3))
    points[n // 2 :] = points[: n - n // 2]  # every point twice: ties go to the lower index
    queries = np.concatenate([draw.integers(-60, 60, (3000, 3)), points])
    tree = vector_codes.Gnat(points, arity)
    index, best = tree.nearest(queries)
    squares = ((queries[:, None] - points[None]) ** 2).sum(2)
    assert (index == squares.argmin(1)).all() and (best == squares.min(1)).all()


def test_tree_leaves_subtrees_out():
    draw = np.random.default_rng(2)
    centers = draw.integers(-(10**6), 10**6, (8, 4))
    points = (centers[:, None] + draw.integers(-50, 50, (8, 30, 4))).reshape(-1, 4)
    queries = points + draw.integers(-20, 20, points.shape)
    tree = vector_codes.Gnat(points)
    index, _ = tree.nearest(queries)
    assert (index == ((queries[:, None] - points[None]) ** 2).sum(2).argmin(1)).all()
    assert tree.computed < 0.6 * len(points) * len(queries)


# Spelling variants

def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in lowered + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[word] += len(word) >= 5
            run = ""
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words.get(form[w], 0)) for w in words)


def spelled(spark, rows):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, word string").repartition(4)
    found = spelling_variants.spelling_forms(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in found.collect())


def test_forms_against_all_pairs(spark):
    draw = random.Random(5)

    def edited(word):
        at, letter = draw.randrange(len(word)), draw.choice("abcdeéÉß÷")
        return draw.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :], word.upper()])

    base = list({"".join(draw.choice("abcdeéüß") for _ in range(draw.randint(5, 12))) for _ in range(150)})
    stock = base * 40 + [edited(w) for w in base for _ in range(6)] * 4 + [edited(edited(w)) for w in base for _ in range(3)] * 3
    draw.shuffle(stock)
    rows = [(k, " ".join(stock[k::60])) for k in range(60)]
    rows += [(k, " ".join(["listen silent enlist tinsel inlets"] * 3)) for k in range(200, 203)]  # equal letters, two edits apart
    rows += [(None, " ".join(base[:20])), (7, " ".join(base[:9])), (7, " ".join(base[:9])), (90, None), (91, ""), (92, prose(8, 9000))]
    assert len(plain_words(rows)) > 400
    assert spelled(spark, rows) == plain_forms(rows)


def test_chains_of_forms_ties_and_damage(spark):
    words = ["aaaaa"] * 64 + ["aaaab"] * 30 + ["aaabb"] * 14 + ["aabbb"] * 6 + ["abbbb"] * 3 + ["zaaaa"] * 64
    rows = [(k, w) for k, w in enumerate(words)]
    damaged = [i for i in range(5000) if zlib.crc32(f"{i}:damaged".encode()) % 97 == 0][:9]
    rows += [(i, "Damaged, DAMAGED") for i in damaged]
    found = spelled(spark, rows)
    assert found == plain_forms(rows)
    assert {r[2] for r in found if r[0] in ("abbbb", "aabbb", "aaabb", "aaaab")} == {"aaaaa"}
    assert not any(r[0] == "damaged" for r in found)
    assert spelled(spark, [(1, None)]) == [] and spelled(spark, [(1, "few words here"), (2, "")]) == []


# Exact top-k

def plain_products(rows, size=10, every=100):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in rows if whole(v)]
    found = []
    for i, q in {(i, tuple(v)) for i, v in kept if i is not None and i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for j, v in kept if j != i)
        found += [(i, k, None if none else j, -s) for k, (s, none, j) in enumerate(scored[:size], 1)]
    return sorted(found, key=str)


def searched(spark, rows, **options):
    found = topk_search.largest_products(vector_table(spark, [(i, v, 0) for i, v in rows]), **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"block": 7, "per_range": 40, "batch": 2}, {"block": 1, "per_range": 1000, "batch": 3}])
def test_largest_products_against_all_pairs(spark, options):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(0, 0.3, 6).tolist()) for i in range(-200, 400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # copies: many equal scores, ties by id
    rows += [(700, None), (701, [1.0, None] + [0.0] * 4), (800, [float("nan")] * 6), (None, rows[3][1])]
    rows += [(900, rows[9][1])] * 3 + [(900, rows[8][1]), (901, [0.0] * 6)]  # a repeated query, and another vector under its id
    assert searched(spark, rows, **options) == plain_products(rows)


def test_largest_products_of_few_and_no_rows(spark):
    few = [(0, [1.0, -2.0]), (5, [0.5, 0.5]), (6, [-1.0, 0.0])]
    assert searched(spark, few) == plain_products(few)
    assert searched(spark, [(0, [1.0, 2.0])]) == []
    assert searched(spark, [(3, [1.0, 2.0])]) == []
    assert searched(spark, [(0, None)]) == []
    assert searched(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]


def test_blocks_below_the_kth_score_are_left_out():
    draw = np.random.default_rng(4)
    centers = np.eye(20, 24) * 1000
    rows = [(c + draw.integers(0, 40, (50, 24))).astype(np.int64) for c in centers]
    ids = [np.arange(50) + 50 * k for k in range(20)]
    low, high = np.stack([r.min(0) for r in rows]), np.stack([r.max(0) for r in rows])
    queries = np.concatenate([r[:2] for r in rows])
    query_ids = np.concatenate([i[:2] for i in ids])
    floors = np.full(len(queries), topk_search.LEAST)
    query, found, score, scored = topk_search.search_blocks(ids, rows, low, high, query_ids, queries, floors, 10)
    products = queries @ np.concatenate(rows).T
    products[np.arange(len(queries)), query_ids] = topk_search.LEAST + 1
    wanted = np.argsort(-products, axis=1, kind="stable")[:, :10]
    assert (found.reshape(-1, 10) == wanted).all() and (query == np.repeat(np.arange(len(queries)), 10)).all()
    assert scored < 3 * len(queries)
