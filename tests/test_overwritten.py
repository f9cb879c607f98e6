"""Pairs that later ones overwrite stay where they were made."""

from pyspark.sql import functions as F

from glyphweave.operators import selection
from glyphweave.plans import registry


def test_pairs_are_not_dealt_again(spark, sf):
    plan = registry.queries()["s2_last_written"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges), exchanges


def test_as_last_written(spark):
    kind = "doc_id long, a int, b int, label int, confidence double"
    old = spark.createDataFrame([(1, 1, 2, 1, 0.9), (1, 2, 3, 1, 0.9), (2, 1, 2, 1, 0.9)], kind)
    new = spark.createDataFrame([(1, 1, 2, 0, 1.5), (3, 4, 4, 0, 1.5)], kind)
    want = selection.last_written(old.withColumn("seq", F.lit(0)).union(new.withColumn("seq", F.lit(1))), "seq").drop("seq")
    assert sorted(selection.overwritten(old, new).collect()) == sorted(want.collect())
