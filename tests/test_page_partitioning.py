"""Queries over pages deal the pages' texts once and keep them so: no row of a word or a pair is shuffled."""

import pytest

from glyphweave.plans import registry

INSIDE = [
    "j4_horizontal_edges", "a8_stacked", "f14_allowed_must", "io5_result_rows", "f19_without_contradictions", "j23_drop_violating", "j10_box_gaps", "io11_cluster_listing",
    "j5_vertical_edges", "j6_symmetric_horizontal", "j6_symmetric_vertical", "j7_horizontal_v1", "j7_vertical_v1", "j8_horizontal_v2", "j8_vertical_v2", "t1_nearest_words", "t2_farthest_words",
    "j11_affinity_mean", "j11_affinity_mean_without_log", "j11_affinity_middle", "j11_affinity_middle_without_log", "j12_embedding_distance", "t3_mutual_neighbours",
]


@pytest.mark.parametrize("name", INSIDE)
def test_words_are_not_shuffled(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges), exchanges


@pytest.mark.parametrize("name", [n for n in INSIDE if n.startswith("j11")])
def test_words_are_made_once(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1  # words with their vectors
