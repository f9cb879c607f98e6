"""Pairs that are sampled where they are made."""

import random

import numpy as np
from pyspark.sql import functions as F

from glyphweave.operators import constraints, linking, selection
from glyphweave.plans import registry


def test_sampled_pairs_are_not_sorted(spark, sf):
    plan = registry.queries()["t10_inspected_pairs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "md5" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_samples_of_a_large_page(spark):
    r = random.Random(3)
    rows = [(d, i - 5, r.choice([1.0, 1.4, 1.5, 2.0])) for d, n in ((1, 700), (2, 3), (3, 1)) for i in range(n)]
    words = spark.createDataFrame(rows, "doc_id long, word_id int, h double")
    want = selection.sampled_pairs(constraints.height_pairs(words), F.lit(10)).collect()
    assert sorted(map(tuple, selection.sampled_in_pages(words, "h", constraints.heights_differ, 10).collect())) == sorted(map(tuple, want))
    assert np.array(want).shape[0] >= 10


def test_sides_as_pairs(spark):
    """Phrases that hold both sides of a cannot-link are those that hold both words of one of its pairs."""
    rng = np.random.default_rng(5)
    members = spark.createDataFrame([(d, w, int(rng.integers(0, 5))) for d in range(12) for w in range(20)], "doc_id long, word_id int, phrase_id int")
    rows = {(d, int(rng.integers(0, 3)), "AB"[int(rng.integers(0, 2))], int(rng.integers(0, 22))) for d in range(10) for _ in range(5)} | {(1, 7, "A", 3), (1, 7, "B", 3)}
    cannot = spark.createDataFrame(sorted(rows), "doc_id long, pair_id int, side string, word_id int")
    one, two = (sorted(map(tuple, linking.drop_violating(members, c).collect())) for c in (cannot, constraints.side_pairs(cannot)))
    assert one == two and 0 < len(one) < members.count()
