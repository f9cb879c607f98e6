"""Choices and searches by rounds of joins against ordered passes and dense solutions in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphweave.functions.geometry import gap_distance
from glyphweave.operators import constraints, layout, selection, vectors


def test_duplicate_boxes_as_the_ordered_pass(spark):
    rng = np.random.default_rng(2)
    found = {(int(d), int(i), int(j)) for d, i, j in zip(rng.integers(0, 12, 500), rng.integers(0, 14, 500), rng.integers(0, 14, 500)) if i != j}
    found |= {(90, k + 1, k) for k in range(9)} | {(91, k, k + 1) for k in range(9)}  # chains in both directions
    want = []
    for d in sorted({x[0] for x in found}):
        gone = set()
        for i in range(20):
            if any(j > i or j not in gone for e, a, j in found if (e, a) == (d, i)):
                gone.add(i)
        want += [(d, i) for i in sorted(gone)]
    frame = spark.createDataFrame(sorted(found), "doc_id long, i int, j int")
    assert sorted(map(tuple, layout.duplicate_boxes(frame).collect())) == want
    assert layout.duplicate_boxes(frame.limit(0)).count() == 0


def test_nearest_distances_as_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for d, n in ((1, 1), (2, 2), (3, 40), (4, 90)):
        boxes = np.round(rng.random((n, 4)) * [1, 1, 0.08, 0.04], 3)
        rows += [(d, k, *map(float, b)) for k, b in enumerate(boxes)]
    rows += [(5, k, 0.3, 0.3, 0.4, 0.4) for k in range(3)]  # boxes that nothing parts
    rows += [(6, 0, 0.0, 0.0, 1.0, 1.0), (6, 1, 0.2, 0.2, 0.1, 0.1), (6, 2, 0.9, 3.0, 0.1, 0.1), (6, 3, 50.0, 50.0, 0.0, 0.0)]  # one box over others, and one far away
    rows += [(7, k, k * 2.0**k, 0.0, 0.5, 0.5) for k in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, word_id int, l double, t double, w double, h double")
    want = layout.pairs(frame).filter("u_word_id <> v_word_id").groupBy("doc_id", F.col("u_word_id").alias("word_id")).agg(F.min(gap_distance("u_", "v_")).alias("nn"))
    want = {(r.doc_id, r.word_id): r.nn for r in want.collect()}
    for most in (0, 50, 10**6):
        got = {(r.doc_id, r.word_id): r.nn for r in layout.nearest_distances(frame, most=most).collect()}
        assert got == want and any(math.isinf(x) for x in got.values()) and len(got) == len(rows) - 1


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_capped_pairs_as_the_ordered_pass(spark, most):
    rng = np.random.default_rng(6)
    found = [(int(rng.integers(0, 3)), int(rng.integers(0, 2)), *map(int, rng.integers(0, 9, 2))) for _ in range(110)]
    want = []
    for d in range(3):
        used = {}
        for r, a, b in sorted((r, a, b) for e, r, a, b in found if e == d):
            if used.get(a, 0) <= 2 and used.get(b, 0) <= 2:
                want.append((d, a, b))
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    frame = spark.createDataFrame(found, "doc_id long, rank int, a int, b int")
    assert sorted(map(tuple, selection.capped_pairs(frame, 2, most).collect())) == sorted(want)


def test_components_by_power_iteration(spark):
    """All pages at once, against dense solutions: random vectors, fewer words than vectors, tables of low rank."""
    rng = np.random.default_rng(5)
    pages = {1: rng.normal(size=(40, 9)) * np.linspace(3, 0.3, 9), 2: rng.normal(size=(5, 4)), 3: np.outer(np.arange(12.0) ** 1.5 / 3, [1.0, 2.0]), 4: rng.normal(size=(25, 6)) * np.linspace(2, 0.2, 6)}
    words = spark.createDataFrame([(d, w, x.tolist()) for d, m in pages.items() for w, x in enumerate(m)], "doc_id long, word_id int, vec array<double>")
    for kernel, kw in (("linear", {}), ("rbf", {"gamma": 0.02})):
        table = vectors.gram(words, kernel, **kw)
        dense, found = ({(r.doc_id, r.word_id): r.vec for r in vectors.kernel_components(table, 2, most).collect()} for most in (1 << 20, 0))
        assert dense.keys() == found.keys() and len(dense) == sum(map(len, pages.values()))
        for key, vec in dense.items():
            assert np.allclose(vec, found[key], atol=1e-6), (kernel, key, vec, found[key])
    m = pages[1] - pages[1].mean(0)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    scores = u[:, :2] * s[:2]
    scores *= np.where(scores[np.abs(scores).argmax(0), [0, 1]] < 0, -1, 1)
    linear = {r.word_id: r.vec for r in vectors.kernel_components(vectors.gram(words), 2, 0).filter("doc_id = 1").collect()}
    assert np.allclose([linear[w] for w in range(40)], scores, atol=1e-6)


def test_tiles_as_whole_pages(spark):
    """Nearest, farthest and Gram tables with tiles of 16 words: ties, zero vectors, pages of a tile and of many."""
    rng = np.random.default_rng(12)
    rows = [(d, w, np.round(rng.normal(size=3) * (w % 11 > 0), 1).tolist()) for d, n in ((1, 9), (2, 16), (3, 90), (4, 41)) for w in range(n)]
    rows += [(3, 200 + w, rows[30][2]) for w in range(5)]  # one vector many times
    frame = spark.createDataFrame(rows, "doc_id long, word_id int, vec array<double>").repartition(4)
    for farthest in (False, True):
        whole, cut = (sorted(map(tuple, constraints.nearest(frame, 4, farthest, n).collect())) for n in (10**6, 16))
        assert whole == cut and len(whole) > 400
    for kernel in ("linear", "rbf", "poly", "cosine"):
        whole, cut = ({(r.doc_id, r.a, r.b): r.k for r in vectors.gram(frame, kernel, tile=n).collect()} for n in (10**6, 16))
        assert whole.keys() == cut.keys() and all(math.isclose(x, cut[key], abs_tol=1e-12) for key, x in whole.items())


def test_columns_as_rows(spark):
    """A word's others as columns are those of its rows, from packed vectors too: pages of one word and of fewer than k, ties, zero vectors."""
    rng = np.random.default_rng(13)
    rows = [(d, w, np.round(rng.normal(size=3) * (w % 7 > 0), 1).tolist()) for d, n in ((1, 1), (2, 2), (3, 4), (4, 50)) for w in range(n)]
    rows += [(4, 200 + w, rows[20][2]) for w in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, word_id int, vec array<float>").repartition(4)
    packed = spark.createDataFrame([(d, w, np.array(x, np.float32).tobytes()) for d, w, x in rows], "doc_id long, word_id int, vec binary").repartition(3)
    for farthest in (False, True):
        want: dict = {}
        for r in constraints.nearest(frame, 4, farthest).collect():
            want.setdefault((r.doc_id, r.word_id), [None] * 4)[r.rank - 2] = r.other
        for given in (frame, packed):
            assert {(r.doc_id, r.word_id): list(r[2:]) for r in constraints.nearest_columns(given, 4, farthest).collect()} == want
        assert sorted(map(tuple, constraints.nearest(packed, 4, farthest, 16).collect())) == sorted(map(tuple, constraints.nearest(frame, 4, farthest).collect()))
