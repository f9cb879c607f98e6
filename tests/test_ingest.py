"""Page files through the stream: tables of both formats, batches run twice, the stream against the batch."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphweave.operators import graph, layout, linking
from glyphweave.streaming import ingest


def box(l, t, w, h, size=1000):  # noqa: E741
    return {"vertices": [{"x": round(x * size), "y": round(y * size)} for x, y in ((l, t), (l + w, t), (l + w, t + h), (l, t + h))]}


def objects_page():
    """Two lines; a word of low score, one without a text, one without a line, a box over another, a slim word."""
    words = [("Total", 0.9, 0.1, 0.1, 0.1, 0.03), ("due", 0.9, 0.21, 0.105, 0.06, 0.02), ("low", 0.05, 0.3, 0.1, 0.06, 0.03), ("", 0.9, 0.4, 0.1, 0.06, 0.03), ("stray", 0.9, 0.1, 0.6, 0.1, 0.03), ("Total", 0.9, 0.099, 0.1, 0.102, 0.03), ("42", 0.9, 0.1, 0.2, 0.05, 0.03), ("I", 0.9, 0.6, 0.2, 0.003, 0.03)]
    rows = [{"type": "Word", "score": s, "text": {"content": x}, "bbox": box(*at)} for x, s, *at in words]
    rows += [{"type": "Line", "score": 0.95, "bbox": box(0.05, 0.098, 0.6, 0.034)}, {"type": "Line", "score": 0.95, "bbox": box(0.05, 0.198, 0.7, 0.034)}, {"type": "Line", "score": 0.3, "bbox": box(0.05, 0.59, 0.6, 0.05)}]
    return {"objects": rows, "imageSize": {"width": 1000, "height": 1000}}


def list_page():
    polygon = [{"X": 0.1, "Y": 0.12}, {"X": 0.2, "Y": 0.1}, {"X": 0.2, "Y": 0.13}, {"X": 0.1, "Y": 0.15}]
    word = lambda text, left: {"DetectedText": text, "Geometry": {"BoundingBox": {"Left": left, "Top": 0.1, "Width": 0.1, "Height": 0.05}, "Polygon": polygon}}
    return [word("far", 0.7), word("one", 0.1), word("two", 0.21)]


def table(df):
    return sorted((json.dumps(r.asDict(True), sort_keys=True) for r in df.drop("batch").collect()))


def test_pages_of_both_formats(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for name, page in (("a", objects_page()), ("b", list_page()), ("c", {"objects": [], "imageSize": {"width": 9, "height": 9}})):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(page))
        ingest.ingest(spark, source, target, state)
    results = {r.doc_id: r for r in ingest.read_table(spark, target, "results").collect()}
    assert sorted(results) == ["a", "b"]
    a, b = results["a"], results["b"]
    # the larger of two boxes goes; words stand at their lines' heights
    assert [(w.DetectedText, w.PhraseId, w.ClusterId, w.Type) for w in a.Words] == [("Total", 0, -1, "WORD"), ("due", 0, -1, "WORD"), ("42", 1, -1, "WORD")]
    assert [(p.DetectedText, p.Type) for p in a.Phrases] == [("Total due", "PHRASE"), ("42", "PHRASE")]
    assert np.allclose([a.Words[0].Geometry.BoundingBox.Top, a.Words[0].Geometry.BoundingBox.Height], [0.098, 0.034])
    assert np.allclose([(p.X, p.Y) for p in a.Words[2].Geometry.Polygon], [(0.1, 0.198), (0.15, 0.198), (0.15, 0.232), (0.1, 0.232)])
    assert [p.DetectedText for p in b.Phrases] == ["far", "one two"] and b.Words[0].Geometry.Polygon[0].Y == 0.12
    assert b.Phrases[0].Geometry.Polygon[0].Y == 0.12 and b.Phrases[1].Geometry.Polygon[0].Y == 0.1
    # the stream's tables are those of one batch over all files
    whole = ingest.tables_of(ingest.file_rows(spark.read, source), source)
    for name in ingest.TABLES:
        assert table(ingest.read_table(spark, target, name)) == table(whole[name]), name


def test_a_batch_run_twice_and_one_that_broke_off(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(objects_page()))
    files = ingest.file_rows(spark.read, source)
    ingest.write_batch(files, 0, source, target)
    once = {n: table(ingest.read_table(spark, target, n)) for n in ingest.TABLES}
    ingest.write_batch(files, 0, source, target)
    assert once == {n: table(ingest.read_table(spark, target, n)) for n in ingest.TABLES}
    # words of a batch without its row in `batches` are not read
    ingest.read_table(spark, target, "words").drop("batch").write.parquet(f"{target}/words/batch=1")
    assert once["words"] == table(ingest.read_table(spark, target, "words"))


def by_union(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for d, a, b in edges:
        x, y = root((d, a)), root((d, b))
        up[max(x, y)] = min(x, y)
    return sorted((d, v, root((d, v))[1]) for d, v in list(up))


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_components(spark, most):
    """By page, by contraction and by both: chains, stars, loops and random graphs."""
    rng = np.random.default_rng(3)
    edges = [(1, k, k + 1) for k in range(60)] + [(2, 90, k) for k in range(50)] + [(3, 5, 5), (3, 6, 7)] + [(int(rng.integers(4, 9)), *map(int, rng.integers(0, 40, 2))) for _ in range(120)]
    frame = spark.createDataFrame(edges, "doc_id long, src int, dst int")
    assert sorted(map(tuple, graph.components(frame, most).collect())) == by_union(edges)
    assert graph.components(frame.limit(0), most).count() == 0


def test_thresholds_above_one(spark):
    """Pairs that do not stand in a row have the distance 1: a threshold above links them."""
    words = spark.createDataFrame([(1, 0, 0.1, 0.1, 0.1, 0.05), (1, 1, 0.21, 0.1, 0.1, 0.05), (1, 2, 0.5, 0.8, 0.1, 0.05), (2, 0, 0.1, 0.1, 0.1, 0.05)], "doc_id long, word_id int, l double, t double, w double, h double")
    near = {(r.src, r.dst): round(r.dist, 6) for r in layout.horizontal_edges(words, 0.55).collect()}
    assert near == {(0, 1): 0.2}
    every = {(r.src, r.dst): round(r.dist, 6) for r in layout.horizontal_edges(words, 2.0).collect()}
    assert every == {(0, 1): 0.2} | {(a, b): 1.0 for a in range(3) for b in range(3) if a != b and (a, b) != (0, 1)}
    for version, direction, symmetric in (("v1", "horizontal", False), ("v2", "vertical", False), ("v3", "vertical", False), ("v3", "horizontal", True)):
        assert linking.edges(words, 2.0, version, direction, symmetric).count() == 6
    assert graph.components(layout.horizontal_edges(words, 2.0)).agg(F.countDistinct("root")).first()[0] == 1
