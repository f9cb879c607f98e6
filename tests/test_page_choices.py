"""Pairs that are made and taken where the page is."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphweave.operators import constraints, linking, selection
from glyphweave.plans import registry
from glyphweave.plans.catalog import by_word


@pytest.mark.parametrize("name", ["t4_capped_ner_case_pairs", "t4_capped_height_pairs"])
def test_capped_pairs_are_not_written(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "glyphweave/" not in plan


@pytest.mark.parametrize("most", [1, 60, 1 << 18])
@pytest.mark.parametrize("cap", [0, 2, 20])
def test_capped_in_pages_as_the_ordered_pass(spark, cap, most):
    rng = np.random.default_rng(cap)
    rows = [(d, int(w) - 3, [None, "", "AB", "ABC", "word", "Word"][rng.integers(0, 6)], [None, -1, 0, 1, 2, 3][rng.integers(0, 6)], float(rng.choice([1.0, 1.2, 1.5, 2.0])))
            for d, n in ((1, 1), (2, 2), (3, 40), (4, 23), (5, 70), (6, 7)) for w in rng.permutation(2 * n)[:n]]
    words = linking.judged(spark.createDataFrame(rows, "doc_id long, word_id int, text string, ner_tag int, h double"))
    ner = linking.ner_pairs(words)
    both = ner.union(ner.select("doc_id", "b", "a")).withColumn("rank", F.lit(0)).unionByName(linking.case_pairs(words).withColumn("rank", F.lit(1)))
    heights = constraints.height_pairs(words).withColumn("rank", F.lit(0))
    for found, kinds in ((both, [linking.NER_KIND, linking.CASE_KIND]), (heights, [constraints.HEIGHT_KIND])):
        used, want = {}, []
        for d, _, a, b in sorted(map(tuple, found.select("doc_id", "rank", "a", "b").collect())):
            if used.get((d, a), 0) <= cap and used.get((d, b), 0) <= cap:
                want.append((d, a, b))
                used[d, a], used[d, b] = used.get((d, a), 0) + 1, used.get((d, b), 0) + 1
        got = selection.capped_in_pages(words, kinds, cap, most=most)
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20
        sums = selection.capped_in_pages(words, kinds, cap, summed=True, most=most)
        assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, by_word(got).collect()))
