"""Pairs of a page's words, summed by word, against the pairs themselves."""

import numpy as np

from glyphweave.operators import linking
from glyphweave.plans import registry
from glyphweave.plans.catalog import by_word


def test_push_sums(spark, sf):
    rng = np.random.default_rng(1)
    rows = [(d, int(w), None if w % 9 == 8 else int(rng.integers(0, 4))) for d, n in ((1, 1), (2, 20), (3, 50)) for w in rng.permutation(n) - 3]
    members = spark.createDataFrame(rows, "doc_id long, word_id int, phrase_id int")
    want = {tuple(r)[:6]: r.confidence_sum for r in by_word(linking.push_pairs(members), {"label": 0, "confidence": 6}).collect()}
    got = {tuple(r)[:6]: round(r.confidence_sum, 6) for r in linking.push_sums(members).collect()}
    assert got == want and len(got) == 68
    plan = registry.queries()["j19_push_pairs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
