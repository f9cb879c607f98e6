"""Vectors that are pooled, joined, projected and scored where the page is, or once for each row of `embeddings`."""

import numpy as np
import pytest

from glyphweave.operators import affinity
from glyphweave.plans import registry


def _plan(spark, sf, name):
    return registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["mean", "max", "min"])
def test_pooled_in_pages(spark, sf, how):
    assert "posexplode(vec" not in _plan(spark, sf, f"a8_pooled_{how}")  # no row is made of a component
    rng = np.random.default_rng(2)
    rows = [(d, w, int(rng.integers(0, 3)), w, rng.normal(size=5).tolist()) for d, n in ((1, 7), (2, 1), (3, 40)) for w in range(n)]
    rows += [(1, 90, 0, 90, None), (1, 91, None, 91, [1.0] * 5), (4, 1, 0, 1, [float("nan"), 1.0, 2.0, 3.0, 4.0]), (4, 2, 0, 2, [2.0, 1.0, 2.0, 3.0, 4.0])]
    members = spark.createDataFrame(rows, "doc_id long, word_id int, phrase_id int, pos int, vec array<double>")
    got = {(r.doc_id, r.phrase_id): r.vec for r in affinity.pooled(members, how).collect()}
    for key in {(r[0], r[2]) for r in rows if r[2] is not None and r[4]}:
        x = np.array([r[4] for r in rows if (r[0], r[2]) == key and r[4]])
        want = x.mean(0) if how == "mean" else x.max(0) if how == "max" else np.fmin.reduce(x)
        assert np.allclose(got.pop(key), want, equal_nan=True)
    assert not got


def _above_the_join(plan):
    """What is done to words' rows after their vectors were joined, up to the first join."""
    return plan.split("Join", 1)[0]


def test_vectors_are_scaled_once_each(spark, sf):
    plan = _plan(spark, sf, "v7_unit")
    assert "BroadcastHashJoin" in plan and "transform(" not in _above_the_join(plan)


def test_words_are_combined_in_one_reading(spark, sf):
    plan = _plan(spark, sf, "v2_combined")
    assert "SortMergeJoin" not in plan and "Sort " not in plan


def test_words_are_attached_in_one_reading(spark, sf):
    plan = _plan(spark, sf, "v1_attached")
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    above = plan.split("BroadcastHashJoin", 1)[0]
    assert "Sort" not in above and "Window" not in above  # no row with a vector is sorted


def test_vectors_are_ranked_once_each(spark, sf):
    plan = _plan(spark, sf, "a19_top_accuracy")
    assert "collect_list" not in _above_the_join(plan) and "posexplode(slice" not in _above_the_join(plan)


def test_head_on_counted_vectors(spark, sf):
    """A vector with its number is the same to the head as that many rows of it, but for the scale that MLlib takes from n - 1 or its like."""
    from pyspark.sql import functions as F

    from glyphweave.operators import vectors

    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), int(n), (rng.normal(size=6) + np.eye(6)[i % 3]).tolist()) for i, n in enumerate(rng.integers(1, 9, 120))]
    counted = spark.createDataFrame(rows, "at long, label int, n int, vec array<double>")
    repeated = counted.select("at", "label", "vec", F.explode(F.sequence(F.lit(1), "n")))
    one, two = (vectors.fit_head(x, weight=w) for x, w in ((counted, "n"), (repeated, None)))
    a, b = ({r["at"]: r.probability for r in vectors.head_scores(counted, m, keys=("at",)).collect()} for m in (one, two))
    assert a.keys() == b.keys() and all(np.allclose(x, b[k], atol=0.003) for k, x in a.items())
    assert "UDF" not in _above_the_join(_plan(spark, sf, "v14_head_scores"))


def test_mutual_in_pages_as_by_joins(spark):
    from glyphweave.operators import constraints

    rng = np.random.default_rng(9)
    rows = [(d, w, rng.integers(-2, 3, 3).astype(float).tolist()) for d, n in ((1, 1), (2, 2), (3, 40)) for w in range(n)]  # ties, equal and empty vectors
    words = spark.createDataFrame(rows, "doc_id long, word_id int, vec array<double>")
    for k in (1, 4):
        want = constraints.mutual_weights(constraints.nearest(words, k), words.select("doc_id", "word_id")).collect()
        got = {tuple(r)[:5]: r.weight for r in constraints.mutual_in_pages(words, k).collect()}
        assert got.keys() == {tuple(r)[:5] for r in want} and len(got) > 2
        assert all(np.isclose(got[tuple(r)[:5]], r.weight, atol=1e-12) for r in want)


def test_components_without_entries(spark, sf):
    from glyphweave.operators import vectors

    rng = np.random.default_rng(7)
    words = spark.createDataFrame([(d, w, rng.normal(size=5).tolist()) for d, n in ((1, 1), (2, 2), (3, 30)) for w in range(n)], "doc_id long, word_id int, vec array<double>")
    want = {(r.doc_id, r.word_id): r.vec for r in vectors.kernel_components(vectors.gram(words), 2).collect()}
    for most in (None, 100, 10):
        got = {(r.doc_id, r.word_id): r.vec for r in vectors.linear_components(words, 2, most).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], x, atol=1e-6) for k, x in want.items())
    plan = _plan(spark, sf, "v3_kernel_components")
    assert plan.count("MapInArrow") + plan.count("PythonMapInArrow") <= 4 and plan.count("Exchange hashpartitioning") == 1 and "glyphweave/" not in plan
