"""Furthest words and losses of small pages against those of large ones."""

import math

import numpy as np

from glyphweave.operators import losses, selection


def test_pages_as_joins(spark):
    rng = np.random.default_rng(3)
    rows = [(d, w, int(rng.integers(0, 3)), np.round(rng.normal(size=4), 1).tolist()) for d, n in ((1, 9), (2, 30), (3, 1)) for w in range(n)]
    rows += [(2, 90, 0, rows[12][3]), (2, 91, 0, [x + 1e-7 for x in rows[12][3]])]  # one vector twice, and one next to it
    words = spark.createDataFrame(rows, "doc_id long, word_id int, label int, vec array<double>")
    whole, cut = (sorted(map(tuple, selection.furthest_words(words, "label", 4, most=n).collect())) for n in (10**6, 0))
    assert whole == cut and len(whole) > 15
    whole, cut = ({r.doc_id: r.loss for r in losses.online_loss(words, most=n).collect()} for n in (10**6, 0))
    assert whole.keys() == cut.keys() == {1, 2} and all(math.isclose(x, cut[d], abs_tol=1e-12) for d, x in whole.items())


def test_rounded_as_the_twin(spark):
    """Doubles whose product with 1e9 falls on a half, beside what DuckDB rounds them to."""
    import duckdb
    from pyspark.sql import functions as F

    from glyphweave.functions.geometry import rounded

    rng = np.random.default_rng(1)
    near = (rng.integers(1, 10**9, 3000) + 0.5) / 1e9
    values = [float(x) for x in np.concatenate([near, np.nextafter(near, 0), np.nextafter(near, 1), -near, [0.0, 0.25, -1.5]])]
    frame = spark.createDataFrame([(x,) for x in values], "x double")
    got = {r.x: r.y for r in frame.select("x", rounded(F.col("x"), 9).alias("y")).collect()}
    con = duckdb.connect()
    con.register("given", frame.toArrow())
    assert all(got[x] == y for x, y in con.execute("select x, round(x, 9) from given").fetchall())
    plain = {r.x: r.y for r in frame.select("x", F.round("x", 9).alias("y")).collect()}
    assert plain != got


def _sided(spark):
    rng = np.random.default_rng(8)
    rows = [(d, w, int(rng.integers(0, 1 + n // 4)), rng.normal(size=4).tolist()) for d, n in ((1, 1), (2, 30), (3, 12), (4, 3)) for w in range(n)]
    rows += [(5, w, w, [0.0] * 4) for w in range(3)] + [(2, 95, None, [0.1] * 4), (2, 96, 0, None)]
    members = spark.createDataFrame(rows, "doc_id long, word_id int, phrase_id int, vec array<double>")
    sides = [(int(rng.integers(2, 5)), int(rng.integers(0, 3)), str(rng.choice(["A", "B"])), int(rng.integers(0, 14))) for _ in range(60)]
    sides += [(2, 0, "A", 3), (2, 0, "B", 3), (2, 0, "A", 95), (2, 1, "B", 96), (2, 1, "B", 700), (5, 7, "A", 0), (3, None, "A", 1)]
    return members, spark.createDataFrame(sides, "doc_id long, pair_id int, side string, word_id int")


def test_contrastive_as_by_joins(spark, sf, monkeypatch):
    from glyphweave.operators import affinity, constraints, linking
    from glyphweave.plans import registry

    members, cannot = _sided(spark)
    found = affinity.pair_distances(linking.phrase_pairs(members).unionByName(constraints.side_pairs(cannot)), members.filter("vec is not null"))
    want = {r.doc_id: r.loss for r in losses.contrastive_approx(found).collect()}
    got = {r.doc_id: r.loss for r in losses.contrastive_in_pages(losses.sided(members, cannot)).collect()}
    assert got.keys() == want.keys() and len(got) == 3 and all(math.isclose(got[d], x, abs_tol=1e-9) for d, x in want.items())
    plan = registry.queries()["a9_contrastive_approx"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_refined_in_pages(spark, sf, monkeypatch):
    """The matrix is that of pairs that are joined with their words, and no word is dealt again in an epoch."""
    from glyphweave.operators import constraints, linking, vectors
    from glyphweave.plans import registry

    members, cannot = _sided(spark)
    pairs = linking.phrase_pairs(members).unionByName(constraints.side_pairs(cannot))
    want, of = vectors.refine(pairs, members.filter("vec is not null"), out=3, epochs=3)
    got, losses_ = vectors.refine_in_pages(losses.sided(members, cannot), 4, out=3, epochs=3)
    assert np.allclose(got, want, atol=1e-9) and np.allclose(losses_, of) and len(of) == 3
    assert vectors.refine_in_pages(losses.sided(members, cannot).filter("doc_id = 1"), 4, out=3)[1] == []
    plans = []
    made = vectors._descended
    monkeypatch.setattr(vectors, "_descended", lambda epoch, *a: (plans.append(epoch(np.zeros((64, 16)))._jdf.queryExecution().executedPlan().toString()), made(epoch, *a))[1])
    for name in REFINED:
        registry.queries()[name](spark, sf)
    assert len(plans) == len(REFINED) and all("SortMergeJoin" not in p and "Union" not in p for p in plans)


REFINED = ["v8_refined", "v10_epoch_vectors"]


def test_furthest_words_in_one_reading(spark, sf):
    from glyphweave.plans import registry

    plan = registry.queries()["t7_furthest_words"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "left_anti" not in plan.lower().replace("leftanti", "left_anti")
