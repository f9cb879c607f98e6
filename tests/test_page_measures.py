"""Scores of clusterings that are made for a batch of pages at once, where the pages are."""

import math
from collections import Counter

import numpy as np
import pytest

from glyphweave.operators import measures
from glyphweave.plans import registry


def _labels(spark):
    rng = np.random.default_rng(4)
    rows = [(d, w, int(rng.integers(0, p)), int(rng.integers(-2, t))) for d, n, p, t in ((1, 40, 5, 3), (2, 1, 1, 1), (3, 30, 1, -1), (4, 25, 25, 25), (5, 300, 12, 2), (6, 9, 3, 9)) for w in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, word_id int, pred int, truth int")


def _ami(pairs):
    n, c, a, b = len(pairs), Counter(pairs), Counter(p for p, _ in pairs), Counter(t for _, t in pairs)
    if len(a) == len(b) == 1:
        return 1.0
    mi = sum(x / n * math.log(n * x / (a[p] * b[t])) for (p, t), x in c.items())
    emi = sum(x / n * math.log(n * x / (i * j)) * math.comb(i, x) * math.comb(n - i, j - x) / math.comb(n, j) for i in a.values() for j in b.values() for x in range(max(1, i + j - n), min(i, j) + 1))
    low = max(-sum(x / n * math.log(x / n) for x in side.values()) for side in (a, b)) - emi
    return 0.0 if abs(low) < 1e-9 else (mi - emi) / low


@pytest.mark.parametrize("name", ["a17_ami", "a18_matched_labels"])
def test_no_row_of_a_class_is_joined(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1 and "FlatMapGroupsInPandas" not in plan


def test_ami_of_pages(spark):
    rows, labels = _labels(spark)
    want = {d: _ami([r[2:] for r in rows if r[0] == d]) for d in range(1, 7)}
    for frame in (labels, measures.contingency(labels, "pred", "truth")):
        got = {r.doc_id: r.ami for r in measures.ami(frame).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[d], x, abs_tol=1e-9) for d, x in want.items())
    page, *classes = (np.array(c) for c in zip(*[(r[0] - 1, *r[2:]) for r in rows]))
    made = measures.Classes(page, *classes)
    assert np.allclose(made.expected(), made.expected(most=1))


def _one_by_one(gain):
    """The assignment of one table, row by row."""
    n = len(gain)
    u, v, held = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for row in range(n):
        held[n], col = row, n
        least, back, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while held[col] >= 0:
            done[col] = True
            cost = -gain[held[col]] - u[held[col]] - v[:n]
            better = ~done[:n] & (cost < least)
            least[better], back[better] = cost[better], col
            following = int(np.where(done[:n], np.inf, least).argmin())
            step = least[following]
            u[held[done]] += step
            v[done] -= step
            least[~done[:n]] -= step
            col = following
        while col != n:
            held[col], col = held[back[col]], back[col]
    out = np.empty(n, int)
    out[held[:n]] = np.arange(n)
    return out


def test_matches_of_pages(spark, monkeypatch):
    rows, labels = _labels(spark)
    want = []
    for d in range(1, 7):
        count = Counter(r[2:] for r in rows if r[0] == d)
        preds, truths = (sorted({p[k] for p in count}) for k in (0, 1))
        square = np.zeros((max(len(preds), len(truths)),) * 2)
        for (p, t), n in count.items():
            square[preds.index(p), truths.index(t)] = n
        to = _one_by_one(square)  # the same of equally good matches
        hits = [int(square[i, to[i]]) for i in range(len(preds))]
        want += [(d, p, truths[to[i]] if to[i] < len(truths) else -1, hits[i], sum(hits) / square.sum()) for i, p in enumerate(preds)]
    for frame in (labels, measures.contingency(labels, "pred", "truth")):
        assert sorted(map(tuple, measures.matched_labels(frame).collect())) == sorted(want)
    page, *classes = (np.array(c) for c in zip(*[(r[0] - 1, *r[2:]) for r in rows]))
    whole = measures.matches(measures.Classes(page, *classes))
    monkeypatch.setattr(measures, "MOST_ENTRIES", 1)
    assert all((a == b).all() for a, b in zip(whole, measures.matches(measures.Classes(page, *classes))))


def test_study_rows_of_pages(spark, sf):
    """Labels are listed and scored in one reading of the words; the scores are those of the operators."""
    from pyspark.sql import functions as F

    from glyphweave.sources import ocr

    plan = registry.queries()["io9_study_rows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "glyphweave/" not in plan and "FlatMapGroupsInPandas" not in plan  # no scratch table is read
    rows, labels = _labels(spark)
    must, cannot = spark.createDataFrame([(1, 0, 2)], "doc_id long, group_id int, word_id int"), spark.createDataFrame([], "doc_id long, pair_id int, side string, word_id int")
    got = {r.doc_id: r for r in ocr.study_rows(*[labels.select("doc_id", "word_id", F.col(c).alias("label")) for c in ("pred", "truth")], must, cannot).collect()}
    table = measures.contingency(labels, "pred", "truth")
    for name, frame in (("ami", measures.ami(table)), ("nmi", measures.nmi(table)), ("acc", measures.matched_labels(table).groupBy("doc_id").agg(F.max("accuracy").alias("acc")))):
        assert all(math.isclose(got[r.doc_id][name], r[name], abs_tol=1e-9) for r in frame.collect())
    for d in range(1, 7):
        assert (got[d].initial_clusters, got[d].user_clusters) == tuple([r[k] for r in rows if r[0] == d] for k in (2, 3))
    assert got[1].user_constraints.must_link == [[2]] and got[2].user_constraints is None
