"""Clusters that are made where the page is: no distance is dealt or written, and the rows are those of joins."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphweave.operators import affinity, graph, layout, linking
from glyphweave.plans import registry


@pytest.mark.parametrize("name", ["g6_entity_clusters", "g6_clusters_by_embedding", "g6_clusters_by_density", "g4_small_islands", "g3_dbscan"])
def test_clusters_are_made_in_pages(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert all("REPARTITION_BY_NUM" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "glyphweave/" not in plan  # no scratch table is read


def _members(spark):
    rng = np.random.default_rng(11)
    rows = []
    for d, n in ((1, 1), (2, 30), (3, 60), (4, 45), (5, 2)):
        phrase = np.sort(rng.integers(0, max(n // 2, 1), n))
        for w in range(n):
            text = [None, "", "ab", "word", "longer"][int(rng.choice(5, p=[0.05, 0.05, 0.3, 0.3, 0.3]))]
            box = (rng.integers(0, 900) / 1024, rng.integers(0, 900) / 1024, rng.integers(5, 60) / 1024, float(rng.choice([12, 14, 18])) / 1024)
            rows.append((d, w, text, *map(float, box), int(phrase[w]), w, rng.normal(int(phrase[w]) % 3 * 0.4, 0.2, 4).tolist()))
    members = spark.createDataFrame(rows, "doc_id long, word_id int, text string, l double, t double, w double, h double, phrase_id int, pos int, vec array<double>")
    must = [(int(rng.integers(1, 7)), int(g), int(rng.integers(0, 70))) for g in rng.integers(0, 9, 50)] + [(3, 1, 4), (3, 1, 4), (3, 2, 4), (3, 2, 50), (3, 1, 20), (3, None, 9), (3, None, 11)]
    return members, spark.createDataFrame(must, "doc_id long, group_id int, word_id int")


@pytest.mark.parametrize(("metric", "threshold", "attach", "largest"), [("neural_affinity", 0.15, 0.5, 1), ("neural_affinity", 0.1, 0.6, 3), ("embedding_distance", 0.4, 0.7, 1), ("neural_affinity", 0.2, 1.5, 1), ("embedding_distance", 0.3, 0.0, 1)])
def test_clusters_as_by_joins(spark, metric, threshold, attach, largest):
    members, must = _members(spark)
    boxes, up_to = linking.boxed_phrases(members), max(threshold, attach)
    distances = graph.phrase_distances(members, metric, up_to=up_to).withColumn("dist", F.round("dist", 9)).filter(F.col("dist") < up_to)
    found = graph.rooted(boxes, affinity.threshold_graph(distances, threshold).union(linking.group_phrase_pairs(must, members)), "phrase_id")
    before = found.select("doc_id", "phrase_id", "root").distinct().count()
    if attach > 0:
        mean = F.avg("nn").over(Window.partitionBy("doc_id")) * 2.0
        far = layout.nearest_distances(boxes, "phrase_id").withColumn("far", F.round("nn", 9) > F.round(mean, 9)).filter("far").select("doc_id", "phrase_id")
        found = graph.attach_islands(found, distances, far, attach) if largest == 1 else graph.attach_small(found, distances, far, attach, largest)
    want = sorted(map(tuple, members.join(found, ["doc_id", "phrase_id"]).select("doc_id", "word_id", "phrase_id", "root").collect()))
    got = graph.entity_clusters(members, must, threshold, attach, largest=largest, metric=metric).select("doc_id", "word_id", "phrase_id", "root")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 138 and before
    named = must.withColumn("group_id", F.concat(F.lit("g"), F.col("group_id").cast("string")))
    assert sorted(map(tuple, graph.entity_clusters(members, named, threshold, attach, largest=largest, metric=metric).select("doc_id", "word_id", "phrase_id", "root").collect())) == want


@pytest.mark.parametrize(("least", "up_to"), [(1, 1.0), (3, 1.0), (4, 1.2)])
def test_density_as_by_joins(spark, least, up_to):
    members, _ = _members(spark)
    near = graph.phrase_distances(members, reduce="mean", up_to=up_to).filter(F.round("dist", 9) <= 0.9)
    found = graph.dbscan(linking.boxed_phrases(members), near, least, "phrase_id")
    want = sorted(map(tuple, members.join(found, ["doc_id", "phrase_id"]).select("doc_id", "word_id", "phrase_id", "root").collect()))
    assert sorted(map(tuple, graph.density_clusters(members, 0.9, least, up_to=up_to).collect())) == want and want


@pytest.mark.parametrize(("least", "cells"), [(1, 1 << 18), (3, 1 << 18), (3, 64), (5, 64)])
def test_dense_boxes_as_by_joins(spark, monkeypatch, least, cells):
    """No neighbour is dealt, whatever the pieces they are found in; plain pages and lone words included."""
    rng = np.random.default_rng(6)
    rows = [(d, w, *map(float, (rng.integers(0, 900) / 1024, rng.integers(0, 40) / 1024, 20 / 1024, rng.choice([12, 18]) / 1024))) for d, n in ((1, 1), (2, 25), (3, 70)) for w in range(n)]
    words = spark.createDataFrame(rows, "doc_id long, word_id int, l double, t double, w double, h double")
    near = linking.edges(words, 0.06, symmetric=True).filter(F.round("dist", 9) <= 0.05)
    want = sorted(map(tuple, graph.dbscan(words, near, least).collect()))
    for module in (linking, layout):
        monkeypatch.setattr(module, "CELLS", cells)
    found = linking.dense_boxes(words, 0.05, least, 0.06)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == want and want


@pytest.mark.parametrize("name", ["g6_entity_clusters", "g6_clusters_by_embedding", "g4_small_islands"])
def test_words_are_read_once(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_groups_beside_words(spark):
    members, must = _members(spark)
    once = must.filter("group_id is not null").groupBy("doc_id", "word_id").agg(F.min("group_id").alias("group_id"))
    beside = members.join(once, ["doc_id", "word_id"], "left")
    for largest, metric in ((1, "neural_affinity"), (3, "embedding_distance"), (1, "geometric_distance")):
        want, got = (sorted(map(tuple, graph.entity_clusters(m, g, largest=largest, metric=metric).select("doc_id", "word_id", "phrase_id", "root").collect())) for m, g in ((members, once), (beside, None)))
        assert want == got and want
