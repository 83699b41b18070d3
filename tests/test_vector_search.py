import numpy as np
import pytest

from quern.operators import vector_search


def table(spark, vectors, first=0):
    rows = [(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, vector array<float>").repartition(5)


def plain(ids, vectors, probe_ids, top_n):
    made = np.asarray(vectors, dtype=np.float32).astype(float)
    length = np.linalg.norm(made, axis=1, keepdims=True)
    unit = made / np.where(length > 0, length, 1)
    found = []
    for p in probe_ids:
        score = np.round(unit @ unit[ids.index(p)], 6) + 0.0
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != p][:top_n]
        found += [(p, ids[k], score[k], place) for place, k in enumerate(order, 1)]
    return sorted(found)


@pytest.mark.parametrize("sizes", [{}, {"per_block": 7, "per_batch": 2}, {"per_block": 1000, "per_batch": 1}])
def test_nearest_vectors_equal_all_pairs(spark, rows, sizes):
    rng = np.random.default_rng(1)
    vectors = [*rng.normal(size=(60, 5)), *[[1, 0, 0, 0, 0]] * 12, [0] * 5]  # ties by id, and a zero vector
    frame = table(spark, vectors)
    found = vector_search.nearest_vectors(frame, frame.where("id % 10 = 0"), 4, **sizes)
    assert rows(found) == plain(list(range(len(vectors))), vectors, range(0, len(vectors), 10), 4)


def test_null_vectors_take_no_part_and_few_rows_give_few(spark, rows):
    frame = table(spark, [[1, 0], None, [0, 1]])
    assert rows(vector_search.nearest_vectors(frame, frame, 10)) == [(0, 2, 0.0, 1), (2, 0, 0.0, 1)]
    assert vector_search.nearest_vectors(frame.where("id > 5"), frame.where("id > 5")).count() == 0


def test_cells_find_nearly_all_of_the_nearest(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    vectors = np.repeat(centres, 50, axis=0) + 0.35 * rng.normal(size=(2000, 16))
    frame = table(spark, vectors)
    probes = frame.where("id % 50 = 0")
    index = vector_search.build_cells(frame, n_cells=40, sample=800, per_block=30)
    assert index.filed.count() == 2000
    exact = vector_search.nearest_vectors(frame, probes, 10)
    found = vector_search.near_vectors(index, probes, 10, n_probe=8, per_batch=3)
    assert vector_search.recall(found, exact) >= 0.9
    every = vector_search.near_vectors(index, probes, 10, n_probe=40)
    assert vector_search.recall(every, exact) == 1.0 and every.count() == exact.count()


def test_cells_of_no_rows(spark):
    frame = table(spark, [[1, 0]]).where("id > 5")
    index = vector_search.build_cells(frame)
    assert vector_search.near_vectors(index, frame).count() == 0
