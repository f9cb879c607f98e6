"""The stream of constraint changes: against the replay, over a restart, and by what it writes."""

import json
import random

from glyphweave.streaming.constraint_log import replay
from glyphweave.streaming.constraint_state import change_stream, current

SCHEMA = "seq long, doc_id long, action string, w1 int, w2 int, value string"


def run(spark, folder, events, batches):
    """Write each batch's file and run the stream on it, with a new query each time; the changes of all."""
    for k in range(batches):
        part = events[k * len(events) // batches : (k + 1) * len(events) // batches]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = change_stream(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")).writeStream.format("parquet").outputMode("append")
        stream.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def rows(df):
    return sorted((r.doc_id, json.dumps(json.loads(r.must_link)), json.dumps(json.loads(r.must_not_link))) for r in df.collect())


def test_changes_over_restarts(spark, tmp_path):
    rng = random.Random(4)
    actions = ["add_must", "add_must", "stage_cannot", "stage_cannot", "submit_cannot", "pop_must", "pop_cannot", "clear", "replace_must", "replace_cannot", "unknown"]
    weights = [4, 4, 4, 4, 4, 2, 2, 0.3, 0.3, 0.3, 0.2]
    events = [(k, rng.randrange(4), rng.choices(actions, weights)[0], rng.randrange(16), rng.randrange(11), f"[[[{k}], [4]]]" if k % 2 else None) for k in range(240)]
    changes = run(spark, str(tmp_path), events, 4)
    assert rows(current(changes)) == rows(replay(spark.createDataFrame(events, SCHEMA)))
    assert changes.filter("doc_id = 0").agg({"version": "max"}).first()[0] == 4


def test_an_event_costs_what_it_changes(spark, tmp_path):
    """After a long list, a push writes one place and the length, a pop the length alone."""
    events = [(k, 1, "add_must", k, k + 1, None) for k in range(300)] + [(300, 1, "add_must", 7, 8, None)] * 1
    run(spark, str(tmp_path), events[:300], 1)
    before = spark.read.parquet(f"{tmp_path}/out").count()
    for more, new in ((events[300:], 2), ([(301, 1, "pop_must", 0, 0, None)], 1), ([(302, 1, "unknown", 0, 0, None)], 0)):
        changes = run(spark, str(tmp_path), more, 1)
        assert changes.count() == before + new
        before += new
    assert json.loads(current(changes).first().must_link) == [[k, k + 1] for k in range(300)]
