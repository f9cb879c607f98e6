"""Edges and phrases are found where a page's words are: no join, no second deal, no written table; pages of any size against all pairs."""

import random

import pytest

from glyphweave.operators import layout, linking
from glyphweave.plans import registry

QUERIES = [
    "g2_components", "g5_phrases", "g5_two_pass", "j5_vertical_edges", "j6_symmetric_horizontal", "j6_symmetric_vertical", "j7_horizontal_v1", "j7_vertical_v1", "j8_horizontal_v2", "j8_vertical_v2",
]


@pytest.mark.parametrize("name", QUERIES)
def test_words_are_read_once(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1, plan


def boxes(n):
    r = random.Random(7)
    return [(1, i, r.random(), r.random() * 9, 0.01 + r.random() / 20, 0.02 + r.random() / 50) for i in range(n)]


@pytest.mark.parametrize("kw", [{}, {"version": "v1"}, {"version": "v1", "direction": "vertical"}, {"version": "v2", "direction": "vertical"}, {"symmetric": True}, {"symmetric": True, "direction": "vertical"}], ids=str)
def test_large_page(spark, kw):
    rows = boxes(700)
    frame = spark.createDataFrame(rows, "doc_id long, word_id int, l double, t double, w double, h double")
    flat, symmetric, version = kw.get("direction") != "vertical", kw.get("symmetric", False), kw.get("version", "v3")
    low_w, low_h = min(1.0, *(r[4] for r in rows)), min(1.0, *(r[5] for r in rows))
    want = {}
    for _, a, ul, ut, uw, uh in rows:
        for _, b, vl, vt, vw, vh in rows:
            if a == b:
                continue
            dx, dy = abs((ul + uw / 2) - (vl + vw / 2)), abs((ut + uh / 2) - (vt + vh / 2))
            near = dy <= low_h / 2 if flat else dx <= low_w / 2
            if symmetric or version == "v1":
                d, ahead = (dx if flat else dy), symmetric or (ul <= vl if flat else ut <= vt)
            else:
                d = max(vl - (ul + uw), 0.0) if flat else max(vt - (ut + uh), 0.0)
                d = d / (max(uh, vh) if flat else (uh + vh) / 2) if version == "v3" else d
                ahead = ul + uw / 2 <= vl + vw / 2 if flat else ut + uh / 2 <= vt + vh / 2
                near = near if flat else vl - (ul + uw) <= low_w / 2 and ul - (vl + vw) <= low_w / 2
            if near and ahead and d < 0.5:
                want[a, b] = d
    found = {(r.a, r.b): r.dist for r in linking.edges(frame, 0.5, **kw).collect()}
    assert want and found == pytest.approx(want)
    sums = {r.a: (r.n, r.b_sum, r.b_squares) for r in linking.edge_sums(frame, 0.5, **kw).collect()}
    assert sums == {a: (len(bs := [b for x, b in want if x == a]), sum(bs), sum(b * b for b in bs)) for a in {x for x, _ in want}}


def test_rows_of_a_large_page(spark):
    frame = spark.createDataFrame(boxes(900), "doc_id long, word_id int, l double, t double, w double, h double")
    root = {i: i for i in range(900)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in layout.horizontal_edges(frame, 20.0 / 30).collect():
        a, b = sorted((top(r.src), top(r.dst)))
        root[b] = a
    found = {r.word_id: r.root for r in layout.row_roots(frame, 20.0 / 30).collect()}
    assert len(set(found.values())) < len(found) and all(top(i) == found.get(i, i) for i in range(900))
