"""Page files, constraint events and the label matching against plain Python."""

import itertools
import json
import os

import numpy as np

from pyspark.sql import functions as F

from glyphweave.operators import graph, linking, selection, vectors
from glyphweave.operators.measures import best_assignment
from glyphweave.plans import lineage
from glyphweave.sources import ocr
from glyphweave.streaming.constraint_log import Reduced, _apply, replay, replay_stream
from glyphweave.streaming.ingest import ingest, read_table


def test_objects_and_constraints(spark, tmp_path):
    box = {"vertices": [{"x": 10, "y": 20}, {"x": 30, "y": 20}, {"x": 30, "y": 40}, {"x": 10, "y": 40}]}
    (tmp_path / "page.json").write_text(json.dumps({"objects": [{"type": "Word", "score": 0.9, "text": {"content": "ab"}, "bbox": box}, {"type": "Line", "score": 0.5, "bbox": box}], "imageSize": {"width": 100, "height": 200}}))
    rows = ocr.read_objects(spark, str(tmp_path / "page.json")).orderBy("object_id").collect()
    assert [(r.doc_id, r.type, r.text) for r in rows] == [("page", "Word", "ab"), ("page", "Line", None)]
    assert np.allclose([rows[0].l, rows[0].t, rows[0].w, rows[0].h], [0.1, 0.1, 0.2, 0.1])
    (tmp_path / "links.json").write_text(json.dumps({"must_link": [[1, 2], [4, 5]], "must_not_link": [[[1], [3, 6]]]}))
    must, cannot = ocr.read_constraints(spark, str(tmp_path / "links.json"))
    (back,) = ocr.constraint_rows(must, cannot).collect()
    assert (back.doc_id, back.must_link, back.must_not_link) == ("links", [[1, 2], [4, 5]], [[[1], [3, 6]]])


def test_ingest(spark, tmp_path):
    box = {"vertices": [{"x": 10, "y": 20}, {"x": 50, "y": 40}]}
    source = tmp_path / "in"
    source.mkdir()
    words = [{"type": "Word", "score": s, "text": {"content": t}, "bbox": box} for s, t in ((0.9, "ab"), (0.05, "low"), (0.9, ""))]
    for name in ("p", "q"):
        (source / f"{name}.json").write_text(json.dumps({"objects": [*words, {"type": "Line", "score": 0.9, "bbox": box}], "imageSize": {"width": 100, "height": 100}}))
        ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.doc_id, r.text) for r in read_table(spark, str(tmp_path / "out"), "words").collect())
    assert got == [("p", "ab"), ("q", "ab")]


def test_replay(spark):
    events = [(1, "add_must", 1, 2), (2, "pop_must", 0, 0), (3, "pop_must", 0, 0), (4, "stage_cannot", 1, 1), (5, "submit_cannot", 0, 0), (6, "stage_cannot", 2, 3), (7, "submit_cannot", 0, 0), (8, "add_must", 5, 6)]
    (row,) = replay(spark.createDataFrame([(s, 7, a, x, y) for s, a, x, y in events], "seq int, doc_id long, action string, w1 int, w2 int")).collect()
    assert (json.loads(row.must_link), json.loads(row.must_not_link)) == ([[5, 6]], [[[1, 1], [2, 3]]])


def fold(state: dict, action: str, w1: int, w2: int, value: str | None = None) -> dict:
    """A page's state after an event, in plain Python. Popping from nothing, and submitting fewer than two staged sides, changes nothing."""
    must, cannot, staged = list(state.get("must", [])), list(state.get("cannot", [])), list(state.get("staged", []))
    if action == "add_must":
        must.append([w1, w2])
    elif action == "stage_cannot":
        staged = (staged + [[w1, w2]])[-2:]
    elif action == "submit_cannot" and len(staged) == 2:
        cannot, staged = [*cannot, staged], []
    elif action == "pop_must":
        must = must[:-1]
    elif action == "pop_cannot":
        cannot = cannot[:-1]
    elif action == "clear":
        must, cannot, staged = [], [], []
    elif action == "replace_must":
        must = json.loads(value or "[]")
    elif action == "replace_cannot":
        cannot = json.loads(value or "[]")
    return {"must": must, "cannot": cannot, "staged": staged}


def test_replay_of_one_large_key(spark):
    """One key over all ranges and small ones beside it, as the plain fold gives them; no task reads all of the large key's events."""
    rng = np.random.default_rng(5)
    names = ["add_must", "stage_cannot", "submit_cannot", "pop_must", "pop_cannot", "clear", "unknown", "replace_must", "replace_cannot"]
    share = [0.3, 0.28, 0.15, 0.16, 0.1, 0.002, 0.004, 0.002, 0.002]
    events = [(i, 7 if rng.random() < 0.9 else int(rng.integers(0, 12)), str(rng.choice(names, p=share)), int(rng.integers(0, 16)), int(rng.integers(0, 11)), f"[[[{i}], [1]], [[2], [3, 4]]]" if i % 2 else None) for i in range(3000)]
    want = {}
    for _, doc, *event in events:
        want[doc] = fold(want.get(doc, {}), *event)
    frame = spark.createDataFrame([events[i] for i in rng.permutation(len(events)).tolist()], "seq int, doc_id long, action string, w1 int, w2 int, value string")
    got = {r.doc_id: (json.loads(r.must_link), json.loads(r.must_not_link)) for r in replay(frame).collect()}
    assert got == {doc: (state["must"], state["cannot"]) for doc, state in want.items()}
    plan = replay(frame)._jdf.queryExecution().toString()
    assert "rangepartitioning(doc_id" in plan and "stretch" in plan
    for cuts in range(40):
        at, state = sorted(rng.integers(0, 60, 3).tolist()), {"must": [], "cannot": [], "staged": []}
        some = [(str(rng.choice(names)), i, i) for i in range(60)]
        plain = {}
        for a, b in itertools.pairwise([0, *at, 60]):
            part = Reduced()
            for event in some[a:b]:
                part.add(*event)
                plain = fold(plain, *event)
            _apply(part.packed(), state)
            assert state == {"must": [], "cannot": [], "staged": []} | plain


def test_assignment():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5):
        for _ in range(20):
            gain = rng.integers(0, 6, (n, n)).astype(float)
            got = best_assignment(gain)
            assert sorted(got) == list(range(n))
            assert gain[np.arange(n), got].sum() == max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_replay_stream(spark, tmp_path):
    schema, source = "seq int, doc_id long, action string, w1 int, w2 int", str(tmp_path / "in")
    batches = [[(1, 7, "add_must", 1, 2), (2, 7, "stage_cannot", 1, 1), (3, 8, "add_must", 3, 4)], [(5, 7, "submit_cannot", 0, 0), (4, 7, "stage_cannot", 2, 3), (6, 8, "pop_must", 0, 0), (7, 8, "pop_must", 0, 0)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        stream = replay_stream(spark.readStream.schema(schema).parquet(source))
        save = lambda rows, k: rows.write.mode("overwrite").parquet(str(tmp_path / f"out-{k}"))
        stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out-1")).collect()))
    assert rows == sorted(map(tuple, replay(spark.createDataFrame(sum(batches, []), schema)).collect())) == [(7, "[[1, 2]]", "[[[1, 1], [2, 3]]]"), (8, "[]", "[]")]


def ordered_pass(root, dist, isolated, least, largest):
    """Islands attached edge by edge in order, in plain Python."""
    root = dict(root)
    size = lambda r: sum(x == r for x in root.values())
    island = {n for n in root if size(root[n]) <= largest and n not in isolated}
    for _, a, b in sorted((d, a, b) for (a, b), d in dist.items() if d < least and a in island and b not in island):
        if size(root[a]) <= largest and root[a] != root[b]:
            was, to = root[a], root[b]
            root = {n: to if r == was else r for n, r in root.items()}
    return {frozenset(n for n in root if root[n] == r) for r in root.values()}


def test_islands_of_several(spark):
    rng, nodes, dists, far, want = np.random.default_rng(3), [], [], [], {}
    for doc in range(24):
        root = {n: int(min(n, rng.integers(0, 9))) for n in range(12)}
        root = {n: min(m for m in root if root[m] == r) for n, r in root.items()}
        dist = {(a, b): float(rng.integers(0, 20)) / 20 for a in root for b in root if a != b}
        alone = [n for n in root if rng.random() < 0.3]
        nodes += [(doc, n, r) for n, r in root.items()]
        dists += [(doc, a, b, d) for (a, b), d in dist.items()]
        far += [(doc, n) for n in alone]
        want[doc] = {k: ordered_pass(root, dist, alone, 0.4, k) for k in (1, 3)}
    clusters, distances = spark.createDataFrame(nodes, "doc_id long, phrase_id int, root int"), spark.createDataFrame(dists, "doc_id long, a int, b int, dist double")
    isolated = spark.createDataFrame(far, "doc_id long, phrase_id int")
    for k, found in ((1, graph.attach_islands(clusters, distances, isolated, 0.4)), (1, graph.attach_small(clusters, distances, isolated, 0.4, 1)), (3, graph.attach_small(clusters, distances, isolated, 0.4, 3))):
        groups: dict = {}
        for r in found.collect():
            groups.setdefault(r.doc_id, {}).setdefault(r.root, set()).add(r.phrase_id)
        assert {d: {frozenset(x) for x in g.values()} for d, g in groups.items()} == {d: w[k] for d, w in want.items()}


def test_refinement_goes_on_from_a_saved_state(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = spark.createDataFrame([(1, i, rng.normal(i % 2, 0.3, 4).tolist()) for i in range(12)], "doc_id long, word_id int, vec array<double>")
    pairs = spark.createDataFrame([(1, a, b, int(a % 2 == b % 2), 1.0) for a in range(12) for b in range(a)], "doc_id long, a int, b int, label int, confidence double")
    history: list = []
    w, losses = vectors.refine(pairs, words, out=2, epochs=3, history=history)
    vectors.save_matrix(spark, w, str(tmp_path / "state"))
    back = vectors.load_matrix(spark, str(tmp_path / "state"))
    assert np.array_equal(back, w) and np.array_equal(history[-1], w)
    assert vectors.refine(pairs, words, out=2, epochs=2, start=back)[1][0] <= losses[-1]
    rows = vectors.epoch_vectors(words, history).filter("word_id = 5").orderBy("epoch").collect()
    x = np.array(words.filter("word_id = 5").first().vec)
    assert [r.epoch for r in rows] == list(range(1, len(history) + 1))
    assert all(np.allclose(r.raw, x @ m) and np.isclose(np.linalg.norm(r.vec), 1) for r, m in zip(rows, history, strict=True))


def test_word_lists_and_names(spark, tmp_path):
    """Two files of one name in two folders, and names with dots, are pages of their own."""
    word = lambda t: {"DetectedText": t, "Geometry": {"BoundingBox": {"Width": 0.2, "Top": 0.1, "Height": 0.05, "Left": 0.3}}}
    for name in ("a/scan.1.json", "a/scan.2.json", "b/scan.1.json", "b/with space+.json"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(json.dumps([word("one"), word("two")]))
    rows = ocr.read_word_lists(spark, str(tmp_path / "in" / "*")).collect()
    assert sorted((r.doc_id, r.object_id, r.text, r.l) for r in rows) == [(d, k, t, 0.3) for d in ("a/scan.1", "a/scan.2", "b/scan.1", "b/with space+") for k, t in enumerate(("one", "two"))]
    (tmp_path / "img" / "a").mkdir(parents=True)
    for name in ("a/scan.1.PNG", "a/scan.2.txt", "scan.1.png"):
        (tmp_path / "img" / name).write_bytes(b"x")
    pages = spark.createDataFrame([("a/scan.1",), ("a/scan.2",)], "doc_id string")
    (pair,) = ocr.paired_images(spark, str(tmp_path / "img"), pages).collect()
    assert pair.doc_id == "a/scan.1" and pair.path.endswith("a/scan.1.PNG")


def test_labelled_images(spark, tmp_path):
    for name in ("train/b/1.png", "train/a/2.png", "train/a/3.png", "val/b/4.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = sorted((r.phase, r["class"], r.label, r.path[-5:]) for r in ocr.labelled_images(spark, str(tmp_path)).collect())
    assert got == [("train", "a", 0, "2.png"), ("train", "a", 0, "3.png"), ("train", "b", 1, "1.png"), ("val", "b", 0, "4.png")]


def test_capped_pairs_and_furthest_words(spark):
    rng = np.random.default_rng(8)
    found = [(d, int(a), int(b), int(r)) for d in range(30) for a, b, r in rng.integers(0, 9, (int(rng.integers(1, 60)), 3))]
    want = []
    for d in range(30):
        used: dict = {}
        for _, a, b in sorted((r, a, b) for e, a, b, r in found if e == d):
            if used.get(a, 0) <= 2 and used.get(b, 0) <= 2:
                want.append((d, a, b))
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    got = selection.capped_pairs(spark.createDataFrame(found, "doc_id long, a int, b int, rank int"), 2)
    assert sorted(map(tuple, got.collect())) == sorted(want)

    words = [(d, int(rng.integers(0, 3)), w, rng.normal(size=4).tolist()) for d in range(8) for w in range(12)]
    want = []
    for d, c in sorted({w[:2] for w in words}):
        group = sorted((w, np.array(x)) for e, k, w, x in words if (e, k) == (d, c))
        picked = [0]
        while len(picked) < min(3, len(group)):
            far = [-1.0 if i in picked else round(sum(float(np.linalg.norm(x - group[j][1])) for j in picked), 9) for i, (_, x) in enumerate(group)]
            picked.append(far.index(max(far)))
        want += [(d, c, group[i][0], k + 1) for k, i in enumerate(picked)]
    got = selection.furthest_words(spark.createDataFrame(words, "doc_id long, label int, word_id int, vec array<double>"), "label", 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_study_rows(spark):
    words = [(1, w, w // 4, [5, 5, 5, 5, 2, 2, 2, 9][w]) for w in range(8)]
    frame = lambda k: spark.createDataFrame([(d, w, x[k]) for d, w, *x in words], "doc_id long, word_id int, label int")
    must = spark.createDataFrame([(1, 0, 3), (1, 0, 4)], "doc_id long, group_id int, word_id int")
    cannot = spark.createDataFrame([(1, 0, "A", 1), (1, 0, "B", 7)], "doc_id long, pair_id int, side string, word_id int")
    (row,) = ocr.study_rows(frame(0), frame(1), must, cannot).collect()
    assert (row.initial_clusters, row.user_clusters) == ([0, 0, 0, 0, 1, 1, 1, 1], [5, 5, 5, 5, 2, 2, 2, 9])
    assert row.acc == 7 / 8 and 0 < row.ami < row.nmi < 1
    assert row.user_constraints.asDict(True) == {"must_link": [[3, 4]], "must_not_link": [[[1], [7]]]}


def test_two_passes_and_attached(spark):
    lines = [(1, 0, "a", 0.1, 0.1, 0.1, 0.05), (1, 1, "b", 0.21, 0.1, 0.1, 0.05), (1, 2, "c", 0.1, 0.17, 0.2, 0.05), (1, 3, "d", 0.7, 0.9, 0.1, 0.05)]
    words = spark.createDataFrame(lines, "doc_id long, word_id int, text string, l double, t double, w double, h double")
    assert sorted(r.text for r in linking.two_pass_phrases(words, 0.55, 0.5).collect()) == ["a b c", "d"]
    assert sorted(r.text for r in linking.two_pass_phrases(words, 0.55, 0.0).collect()) == ["a b", "c", "d"]
    phrases = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 2)], "doc_id long, word_id int, phrase_id int")
    sources = {
        ("geometry", "phrase"): lambda w, p: p.groupBy("doc_id", "phrase_id").agg(F.array(F.count("*").cast("double")).alias("vec")),
        ("font", "word"): lambda w, p: w.select("doc_id", "word_id", F.array("l", "t").alias("vec")),
        ("nlp", "word"): lambda w, p: w.select("doc_id", "word_id", F.array("h").alias("vec")),
    }
    found, descriptor = vectors.attached(words, phrases, sources)
    assert descriptor == [("nlp_word", 1), ("font_word", 2), ("geometry_phrase", 1)]
    assert {r.word_id: r.vec for r in found.collect()} == {0: [0.05, 0.1, 0.1, 2.0], 1: [0.05, 0.21, 0.1, 2.0], 2: [0.05, 0.1, 0.17, 1.0]}
    assert vectors.attached(words, phrases, {})[1] == []


def test_scratch_tables_are_deleted(spark):
    table = lineage.written(spark.range(3).toDF("x"), "numbers")
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    lineage.clear_scratch(spark)
    assert not os.path.exists(path)
