"""Replay of a page's constraint events: add_must, stage_cannot, submit_cannot, pop_must, pop_cannot, clear, replace_must, replace_cannot.

An event has two words, w1 and w2; those that replace a list have the new one as JSON in `value`, a column that logs without them can lack."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Reduced:
    """Popping from nothing, and submitting fewer than two staged sides, changes nothing.

    What a stretch of a key's events does to the state before it: pairs popped from it and pairs pushed then, for each number of staged sides it
    may hold. Sides of the state before are the numbers 0 and 1 in `staged` and `cannot`; pops is None where all is cleared."""

    def __init__(self) -> None:
        self.must: dict = {"pops": 0, "pushed": []}
        self.cannot: list[dict] = [{"pops": 0, "pushed": [], "staged": list(range(n))} for n in range(3)]

    @staticmethod
    def _pop(held: dict) -> None:
        if held["pushed"]:
            held["pushed"].pop()
        elif held["pops"] is not None:
            held["pops"] += 1

    def add(self, action: str, w1: int, w2: int, value: str | None = None) -> None:
        if action == "replace_must":
            self.must = {"pops": None, "pushed": json.loads(value or "[]")}
        elif action == "replace_cannot":
            for held in self.cannot:
                held |= {"pops": None, "pushed": json.loads(value or "[]")}
        elif action == "add_must":
            self.must["pushed"].append([w1, w2])
        elif action == "pop_must":
            self._pop(self.must)
        elif action == "clear":
            self.must = {"pops": None, "pushed": []}
            self.cannot = [{"pops": None, "pushed": [], "staged": []} for _ in range(3)]
        else:
            for held in self.cannot:
                if action == "stage_cannot":
                    held["staged"] = (held["staged"] + [[w1, w2]])[-2:]
                elif action == "submit_cannot" and len(held["staged"]) == 2:
                    held["pushed"].append(held["staged"])
                    held["staged"] = []
                elif action == "pop_cannot":
                    self._pop(held)

    def packed(self) -> str:
        return json.dumps([self.must, self.cannot])


def _apply(packed: str, state: dict) -> None:
    """Change a state by a packed stretch."""
    must, by_staged = json.loads(packed)
    before = state["staged"]
    cannot = by_staged[len(before)]
    side = lambda x: before[x] if isinstance(x, int) else x
    for name, held in (("must", must), ("cannot", cannot)):
        kept = len(state[name])
        del state[name][0 if held["pops"] is None else max(0, kept - held["pops"]) :]
    state["must"] += must["pushed"]
    state["cannot"] += [[side(x) for x in pair] for pair in cannot["pushed"]]
    state["staged"] = [side(x) for x in cannot["staged"]]


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, first seq and packed stretch of each key of rows sorted by key and seq. Only the key at hand is held."""
    key, first, held = None, None, None
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([first], pa.int64()), pa.array([held.packed()])], ["doc_id", "first", "stretch"])
    for batch in batches:
        for doc, seq, *event in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "seq", "action", "w1", "w2", "value")), strict=True):
            if held is None or doc != key:
                if held is not None:
                    yield pack()
                key, first, held = doc, seq, Reduced()
            held.add(*event)
    if held is not None:
        yield pack()


def valued(events: DataFrame) -> DataFrame:
    return events if "value" in events.columns else events.withColumn("value", F.lit(None).cast("string"))


def replay(events: DataFrame) -> DataFrame:
    """(doc_id, must_link, must_not_link as JSON) after all events (seq, doc_id, action, w1, w2, value), by seq.

    Events are dealt by ranges of key and seq, so that a key with many of them is cut. Each range is reduced to the pairs that are left of
    it, and one task puts a key's few ranges together: it holds what the key's row holds, and pairs that later ranges pop."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {"must": [], "cannot": [], "staged": []}
        for packed in pdf.sort_values("first")["stretch"]:
            _apply(packed, state)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "must_link": [json.dumps(state["must"])], "must_not_link": [json.dumps(state["cannot"])]})

    order = [F.col("doc_id"), F.col("seq").asc_nulls_last()]
    whole = valued(events).select(*[F.col(c).cast("long") for c in ("doc_id", "seq", "w1", "w2")], "action", "value")
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reduced = whole.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_reduce, "doc_id long, first long, stretch string")
    return reduced.groupBy("doc_id").applyInPandas(run, "doc_id long, must_link string, must_not_link string")


def replay_stream(events: DataFrame) -> DataFrame:
    """The same of a stream of events: each batch gives the pages it changed as they are then. A page's state is its lists as JSON;
    events of one batch are ordered by seq, batches by arrival."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, batch = json.loads(state.get[0]) if state.exists else {"must": [], "cannot": [], "staged": []}, Reduced()
        for action, w1, w2, value in pd.concat(list(frames)).sort_values("seq")[["action", "w1", "w2", "value"]].itertuples(index=False):
            batch.add(action, int(w1), int(w2), value)
        _apply(batch.packed(), held)
        state.update((json.dumps(held),))
        yield pd.DataFrame({"doc_id": [key[0]], "must_link": [json.dumps(held["must"])], "must_not_link": [json.dumps(held["cannot"])]})

    grouped = valued(events).select("seq", "doc_id", "action", "w1", "w2", "value").groupBy("doc_id")
    return grouped.applyInPandasWithState(run, "doc_id long, must_link string, must_not_link string", "held string", "update", GroupStateTimeout.NoTimeout)
