"""Weights of pairs that are made where the page is."""

import numpy as np
import pytest

from glyphweave.operators import constraints, linking, losses
from glyphweave.plans import registry


def test_weighted_pairs_are_not_dealt_again(spark, sf):
    plan = registry.queries()["a13_pair_weights"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert all("REPARTITION_BY_NUM" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


@pytest.mark.parametrize("most", [1, 9, 1 << 20])
def test_weights_as_by_joins(spark, most):
    """Pages with words alone, with sides alone, with neither pair; words twice, in several pairs and on both sides."""
    rng = np.random.default_rng(most)
    rows = [(d, int(w), int(rng.integers(0, 4))) for d, n in ((1, 30), (2, 12), (3, 1), (4, 20)) for w in rng.integers(-3, 25, n)] + [(7, 1, 1), (7, 1, 1), (None, 1, 1), (None, 2, 1)]
    members = spark.createDataFrame(rows, "doc_id long, word_id int, phrase_id int")
    sides = [(d, int(rng.integers(0, 3)), "ABC"[rng.integers(0, 3)], int(rng.integers(-3, 12))) for d in (1, 2, 3, 5, 6) for _ in range(25)] + [(6, 9, "A", 5), (8, 0, "A", 3), (None, 0, "A", 1), (None, 0, "B", 1)]
    cannot = spark.createDataFrame(sides, "doc_id long, pair_id int, side string, word_id int")
    both = linking.phrase_pairs(members).unionByName(constraints.side_pairs(cannot))
    for epoch in (0, 1, 40):
        want = losses.pair_weights(both, epoch).collect()
        got = losses.page_pair_weights(members, cannot, epoch, most=most).collect()
        rounded = lambda found: sorted((r.doc_id, r.a, r.b, r.label, r.confidence, round(r.weight, 9)) for r in found)
        assert rounded(got) == rounded(want) and {r.doc_id for r in want} == {1, 2, 3, 4, 5, 6}
