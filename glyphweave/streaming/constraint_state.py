"""Constraint events as a stream whose state costs what an event changes.

A page's lists are map states from a place to its value, and a value state of their lengths and the staged sides. A batch of events is reduced first (see
constraint_log.Reduced) to how much the lists lose at their ends and what is put there; only those places are written, and only they are sent on.

The stream's rows are changes: (doc_id, version, kind, place, value). kind is `must` or `cannot` with a place and the value there as JSON, or
`must_length` or `cannot_length` with the list's length as place. A page's version counts its batches. `current` puts changes together."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .constraint_log import Reduced, valued

CHANGES = "doc_id long, version long, kind string, place long, value string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ConstraintLists(StatefulProcessor):
    """The lists of one page per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lists = {kind: handle.getMapState(kind, "place long", "value string") for kind in ("must", "cannot")}
        self.sizes = handle.getValueState("sizes", "version long, must long, cannot long, staged string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, *lengths, staged = self.sizes.get() if self.sizes.exists() else (0, 0, 0, "[]")
        sides, batch = json.loads(staged), Reduced()
        for action, w1, w2, value in pd.concat(list(rows)).sort_values("seq")[["action", "w1", "w2", "value"]].itertuples(index=False):
            batch.add(action, int(w1), int(w2), value)
        side = lambda x: sides[x] if isinstance(x, int) else x
        held = batch.cannot[len(sides)]
        put = {"must": (batch.must["pops"], batch.must["pushed"]), "cannot": (held["pops"], [[side(x) for x in pair] for pair in held["pushed"]])}
        changes: list[tuple] = []
        for k, kind in enumerate(("must", "cannot")):
            pops, pushed = put[kind]
            if pops is None:
                self.lists[kind].clear()
                keep = 0
            else:
                keep = max(0, lengths[k] - pops)
                for place in range(max(keep + len(pushed), keep), lengths[k]):
                    self.lists[kind].removeKey((place,))
            for place, value in enumerate(pushed, keep):
                self.lists[kind].updateValue((place,), (json.dumps(value),))
                changes.append((kind, place, json.dumps(value)))
            if keep + len(pushed) != lengths[k] or pops is None:
                changes.append((f"{kind}_length", keep + len(pushed), None))
            lengths[k] = keep + len(pushed)
        self.sizes.update((version + 1, *lengths, json.dumps([side(x) for x in held["staged"]])))
        yield pd.DataFrame([(key[0], version + 1, *change) for change in changes], columns=["doc_id", "version", "kind", "place", "value"]).astype({"place": "int64", "value": object})

    def close(self) -> None:
        pass


def change_stream(events: DataFrame) -> DataFrame:
    """The changes (see above) of a stream of events (seq, doc_id, action, w1, w2, value). Events of one batch are ordered by seq, batches by arrival.

    Map states need the session's state store to be the one that keeps single entries; the session is set so."""
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    grouped = valued(events).filter("doc_id is not null").select(*[F.col(c).cast("long").alias(c) for c in ("seq", "doc_id", "w1", "w2")], "action", "value").groupBy("doc_id")
    return grouped.transformWithStateInPandas(ConstraintLists(), CHANGES, "Append", "None")


def current(changes: DataFrame) -> DataFrame:
    """(doc_id, must_link, must_not_link as JSON) that changes add up to: each list's places below its last length, each place's last value."""
    length = lambda kind: F.coalesce(F.max_by(F.when(F.col("kind") == f"{kind}_length", F.col("place")), F.when(F.col("kind") == f"{kind}_length", F.col("version"))), F.lit(0)).alias(kind)
    sizes = changes.groupBy("doc_id").agg(length("must"), length("cannot"))
    last = changes.filter(F.col("kind").isin("must", "cannot")).groupBy("doc_id", "kind", "place").agg(F.max_by("value", "version").alias("value"))
    kept = last.join(sizes, "doc_id").filter(F.col("place") < F.when(F.col("kind") == "must", F.col("must")).otherwise(F.col("cannot")))
    listed = lambda kind: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "value")))), lambda x: x["value"]), ", "), F.lit("]"))
    found = kept.groupBy("doc_id").agg(listed("must").alias("must_link"), listed("cannot").alias("must_not_link"))
    return sizes.select("doc_id").join(found, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit("[]")).alias(c) for c in ("must_link", "must_not_link")])
