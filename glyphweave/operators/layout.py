"""Operators on the word and line boxes of pages. doc_id is the page; all joins stay inside it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, bottom, centre_x, centre_y, gap_distance, overlap, right
from ..plans.lineage import written
from .graph import lowest
from .paged import by_size, over_pages


def prefixed(df: DataFrame, p: str) -> DataFrame:
    """All columns but doc_id with a prefix."""
    return df.select("doc_id", *[F.col(c).alias(p + c) for c in df.columns if c != "doc_id"])


def pairs(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Pairs inside a page, columns prefixed u_ and v_."""
    return prefixed(a, "u_").join(prefixed(a if b is None else b, "v_"), "doc_id")


def keep_scored(df: DataFrame, least: float) -> DataFrame:
    return df.filter(F.col("score") >= least)


def keep_worded(words: DataFrame) -> DataFrame:
    return words.filter(F.col("text").isNotNull() & (F.length("text") > 0))


def area_p20(words: DataFrame) -> DataFrame:
    """Per page: exact 20th percentile of the word areas."""
    return words.groupBy("doc_id").agg(F.round(F.percentile(area(), 0.2), 12).alias("p20"))


def drop_slim(words: DataFrame, large: float = 2.0, small: float = 5.0) -> DataFrame:
    """Drop words higher than wide: by a factor of `large` above the page's p20 area, of `small` at or below it."""
    factor = F.when(F.round(area(), 12) > F.col("p20"), large).otherwise(small)
    sized = words.withColumn("p20", F.round(F.percentile(area(), 0.2).over(Window.partitionBy("doc_id")), 12))
    return sized.filter(~(factor * F.col("w") < F.col("h"))).select(*words.columns)


def assign_lines(words: DataFrame, lines: DataFrame, least: float = 0.7) -> DataFrame:
    """Each word's line of largest overlap above `least`, the first line on ties; words without one are left out."""
    found = prefixed(words, "u_").join(prefixed(lines, "v_"), "doc_id").withColumn("overlap", overlap("u_", "v_")).filter(F.col("overlap") > least)
    best = Window.partitionBy("doc_id", "u_word_id").orderBy(F.desc("overlap"), "v_line_id")
    return found.withColumn("k", F.row_number().over(best)).filter("k = 1").select("doc_id", F.col("u_word_id").alias("word_id"), F.col("v_line_id").alias("line_id"), "overlap", F.col("u_l").alias("l"), F.col("v_t").alias("t"), F.col("u_w").alias("w"), F.col("v_h").alias("h"))


def overlap_candidates(words: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, i, j): words whose boxes overlap above `least` (0 or more), i not smaller than j.

    Boxes that overlap share a row of the page's largest height: a box is in the rows of its top and its bottom, and a pair meets in the first
    row that both are in."""
    tall = F.greatest(F.max("h").over(Window.partitionBy("doc_id")), F.lit(1e-9))
    rowed = words.withColumn("tall", tall).withColumns({"row_a": F.floor(F.col("t") / F.col("tall")), "row_b": F.floor(bottom() / F.col("tall"))}).drop("tall")
    u, v = (prefixed(rowed, p).withColumn("cell", F.explode(F.sequence(f"{p}row_a", f"{p}row_b"))) for p in ("u_", "v_"))
    both = u.join(v, ["doc_id", "cell"]).filter(F.col("cell") == F.greatest("u_row_a", "v_row_a"))
    return both.filter((F.col("u_word_id") != F.col("v_word_id")) & (area("u_") >= area("v_")) & (overlap("u_", "v_") > least)).select("doc_id", F.col("u_word_id").alias("i"), F.col("v_word_id").alias("j"))


def duplicate_boxes(found: DataFrame) -> DataFrame:
    """(doc_id, word_id) of the words that go, of candidates (doc_id, i, j): i goes if it has a j that stands after it, or one before it that stays.

    Whether a word goes depends on words before it alone, so it is decided in rounds of joins: at once where a j stands after it or is no candidate itself, else when
    its last open j is. A round's tables are written; rounds are as many as the longest chain of words that wait for one another."""
    found = written(found, "candidates")
    state = written(found.groupBy("doc_id", "i").agg((F.max("j") > F.col("i")).alias("gone")).withColumn("open", ~F.col("gone")), "boxes")
    open_ = written(found.join(state.filter("open").select("doc_id", "i"), ["doc_id", "i"], "left_semi"), "open-boxes")
    gone = state.filter("gone").select("doc_id", "i")
    while open_.limit(1).count():
        of = state.select("doc_id", F.col("i").alias("j"), F.col("gone").alias("j_gone"), F.col("open").alias("j_open"))
        known = open_.join(of, ["doc_id", "j"], "left").select("doc_id", "i", "j", F.coalesce("j_gone", F.lit(False)).alias("j_gone"), F.coalesce("j_open", F.lit(False)).alias("j_open"))
        known = written(known, "judged")
        seen = known.groupBy("doc_id", "i").agg(F.max(~F.col("j_gone") & ~F.col("j_open")).alias("gone"), F.max("j_open").alias("waits"))
        state = written(seen.select("doc_id", "i", "gone", (~F.col("gone") & F.col("waits")).alias("open")), "boxes")
        gone = gone.union(state.filter("gone").select("doc_id", "i"))
        open_ = written(known.filter("j_open").join(state.filter("open").select("doc_id", "i"), ["doc_id", "i"], "left_semi").select("doc_id", "i", "j"), "open-boxes")
    return gone.withColumnRenamed("i", "word_id")


def drop_duplicate_boxes(words: DataFrame, least: float = 0.7) -> DataFrame:
    """Drop a word that overlaps a word not larger than it, unless that one stands before it and is dropped itself."""
    return words.join(duplicate_boxes(overlap_candidates(words, least)), ["doc_id", "word_id"], "left_anti")


def min_sizes(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id").agg(F.least(F.lit(1.0), F.min("w")).alias("min_w"), F.least(F.lit(1.0), F.min("h")).alias("min_h"))


#: Pairs of boxes of a page that a task looks at together.
CELLS = 1 << 18


def meeting(
    ids: np.ndarray, left: np.ndarray, top: np.ndarray, w: np.ndarray, h: np.ndarray, threshold: float, version: str = "v3", direction: str = "horizontal", symmetric: bool = False, aspect: float = 1.0
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of a, places of b, distances) of the ordered pairs of a page's boxes that linking.edges links, some boxes a at a time, whose pairs stand together.

    Boxes of one row or column are looked for among those whose centres are near enough, so a page's square is made only where most of its boxes are in one of them."""
    flat, n = direction == "horizontal", len(ids)
    least = lambda size: min(1.0, np.fmin.reduce(size, initial=np.inf))
    half = least(h if flat else w) / 2
    right, mid_x, mid_y = left + w, left + w / 2, top + h / 2
    along, across, low, end = (mid_x, mid_y, left, right) if flat else (mid_y, mid_x, top, top + h)
    centred = flat or symmetric or version == "v1"
    pruned = centred and threshold <= 1 and n * n > CELLS
    order = np.argsort(across, kind="stable") if pruned else np.arange(n)
    sorted_across = across[order]
    step = max(1, CELLS // max(n, 1))
    for start in range(0, n, step):
        u, v = order[start : start + step], order
        if pruned:
            v = order[np.searchsorted(sorted_across, sorted_across[start] - half - 1e-9) : np.searchsorted(sorted_across, across[u[-1]] + half + 1e-9, "right")]
        if centred:
            met = np.abs(across[u][:, None] - across[v]) <= half
        else:
            met = (left[v] - right[u][:, None] <= half) & (left[u][:, None] - right[v] <= half)
        if version == "v1" and not symmetric:
            met &= low[u][:, None] <= low[v]
        elif not symmetric:
            met &= along[u][:, None] <= along[v]
        near = met
        if threshold > 1:
            met = np.ones_like(near)
        met = met & (ids[u][:, None] != ids[v])
        i, j = np.nonzero(met)
        a, b = u[i], v[j]
        if symmetric or version == "v1":
            dist = np.abs(along[a] - along[b])
        else:
            dist = np.maximum(low[b] - end[a], 0.0)
            if version == "v3":
                with np.errstate(divide="ignore", invalid="ignore"):
                    dist = dist * aspect / np.maximum(h[a], h[b]) if flat else dist / ((h[a] + h[b]) / 2)
        if threshold > 1:
            dist = np.where(near[i, j], dist, 1.0)
        ok = dist < threshold
        yield a[ok], b[ok], dist[ok]


def joined_boxes(ids: np.ndarray, *box: np.ndarray, **how) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a page's boxes, in order, the smallest that each reaches over the pairs of `meeting`, and whether it is in a pair. Pairs are let go as they are used."""
    names, at = np.unique(ids, return_inverse=True)
    root, tied = np.arange(len(names)), np.zeros(len(names), bool)
    for a, b, _ in meeting(ids, *box, **how):
        if len(a):
            a, b = at[a], at[b]
            tied[a] = tied[b] = True
            own = np.arange(len(names))
            root = lowest(len(names), np.concatenate([own, a]), np.concatenate([root, b]))
    return names, names[root], tied


def horizontal_edges(words: DataFrame, threshold: float = 0.55, id_col: str = "word_id") -> DataFrame:
    """(doc_id, src, dst, dist): v stands right of u in the same row, its gap over the larger height below the threshold.

    Other pairs have the distance 1, and above that threshold all pairs of a page meet. A task has a page at a time and looks for pairs as `meeting` does."""
    kind = words.schema[id_col].dataType.simpleString()

    def found(ids: np.ndarray, *box: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for a, b, dist in meeting(ids, *box, threshold=threshold):
            yield ids[a], ids[b], dist

    return over_pages(words.filter(F.col(id_col).isNotNull()), [id_col, *"ltwh"], [], found, {"src": kind, "dst": kind, "dist": "double"})


def row_roots(words: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(doc_id, word_id, root) of the words that horizontal_edges join: root is the smallest word of theirs. Rows are joined where the page's words are, and no edge is kept."""
    kind = words.schema["word_id"].dataType.simpleString()

    def found(ids: np.ndarray, *box: np.ndarray) -> tuple[np.ndarray, ...]:
        names, root, tied = joined_boxes(ids, *box, threshold=threshold)
        return names[tied], root[tied]

    return over_pages(words.filter("word_id is not null"), ["word_id", *"ltwh"], [], found, {"word_id": kind, "root": kind})


def union_boxes(members: DataFrame, by: str) -> DataFrame:
    """Per group: the box around its words, their text in reading order, their number."""
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(centre_x().alias("x"), F.col("word_id").alias("i"), F.col("text").alias("s")))), lambda x: x["s"]), " ")
    return members.groupBy("doc_id", by).agg(
        F.min("l").alias("l"), F.min("t").alias("t"), (F.max(right()) - F.min("l")).alias("w"), (F.max(bottom()) - F.min("t")).alias("h"), spelled.alias("text"), F.count("*").alias("n_words")
    )


def page_phrases(ids: np.ndarray, left: np.ndarray, top: np.ndarray, w: np.ndarray, h: np.ndarray, horizontal: float, vertical: float) -> tuple[np.ndarray, ...]:
    """Of a page's words, their places in reading order, and of each word in that order its row, its phrase and its place in the phrase (see linking.phrase_members)."""
    names, root, _ = joined_boxes(ids, left, top, w, h, threshold=horizontal)
    row = root[np.searchsorted(names, ids)]
    rows, at = np.unique(row, return_inverse=True)
    phrase, y = row, np.zeros(len(ids))
    if vertical > 0:
        by = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[by], np.arange(len(rows)))
        x0, y0, x1, y1 = (f.reduceat(c[by], cuts) for f, c in ((np.minimum, left), (np.minimum, top), (np.maximum, left + w), (np.maximum, top + h)))
        names, root, _ = joined_boxes(rows, x0, y0, x1 - x0, y1 - y0, threshold=vertical, direction="vertical")
        phrase, y = root[at], (y0 + (y1 - y0) / 2)[at]
    order = np.lexsort((ids, left + w / 2, row, y, phrase))
    phrase = phrase[order]
    first = np.concatenate([[True], phrase[1:] != phrase[:-1]])
    place = np.arange(len(ids)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return order, row[order], phrase, place


def phrases(words: DataFrame, threshold: float = 0.55, vertical: float = 0.0) -> DataFrame:
    """(doc_id, phrase_id, box, text, n_words): words joined by horizontal edges; the smallest word id names a phrase.

    The horizontal pass alone: a vertical one of threshold 0 joins nothing (its test is strict); one above 0 joins rows to phrases (see linking.phrase_members). A page's phrases are
    made where its words are, so nothing of a word's or an edge's size is dealt again or written."""
    kind = words.schema["word_id"].dataType.simpleString()

    def found(ids: np.ndarray, left: np.ndarray, top: np.ndarray, w: np.ndarray, h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
        order, _, phrase, place = page_phrases(ids, left, top, w, h, threshold, vertical)
        cuts = np.flatnonzero(place == 0)
        x0, y0, x1, y1 = (f.reduceat(c[order], cuts) for f, c in ((np.minimum, left), (np.minimum, top), (np.maximum, left + w), (np.maximum, top + h)))
        spelled = text[order].tolist()
        ends = [*cuts[1:].tolist(), len(order)]
        texts = np.array([" ".join(s for s in spelled[a:b] if s is not None) for a, b in zip(cuts.tolist(), ends, strict=True)], object)
        return phrase[cuts], x0, y0, x1 - x0, y1 - y0, texts, np.diff([*cuts, len(order)]).astype(np.int64)

    return over_pages(words.filter("word_id is not null"), ["word_id", *"ltwh", "text"], [], found, {"phrase_id": kind, "l": "double", "t": "double", "w": "double", "h": "double", "text": "string", "n_words": "long"})


#: Boxes of a page that a task may compare with one another.
PAGE_BOXES = 1024


def nearest_distances(boxes: DataFrame, id_col: str = "word_id", most: int = PAGE_BOXES) -> DataFrame:
    """(doc_id, id_col, nn): the distance of each box to the nearest other of its page; infinite where none is parted from it, and no row for a page's only box.

    Pages of up to `most` boxes are compared whole, many to a batch; those of more by a grid (see distances_by_grid)."""

    def compare(ids: np.ndarray, left: np.ndarray, top: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        apart = lambda low, size: np.maximum(np.maximum(low[None, :] - (low + size)[:, None], low[:, None] - (low + size)[None, :]), 0.0)
        dx, dy = apart(left, w), apart(top, h)
        d = np.where((dx == 0) & (dy == 0), np.inf, np.sqrt(dx * dx + dy * dy))
        np.fill_diagonal(d, np.inf)
        return (ids, d.min(1)) if len(ids) > 1 else (ids[:0], d[:0, 0])

    small, large = by_size(boxes.select("doc_id", id_col, *"ltwh"), most)
    found = over_pages(small, [id_col, *"ltwh"], [id_col], compare, {id_col: boxes.schema[id_col].dataType.simpleString(), "nn": "double"})
    return found if large is None else found.unionByName(distances_by_grid(large, id_col))


def distances_by_grid(boxes: DataFrame, id_col: str = "word_id") -> DataFrame:
    """As nearest_distances, without a page's square in any task.

    A page has a grid of about as many cells as boxes. A box looks one cell's width around itself; what it finds within that is the nearest. Boxes that find nothing
    so near go on with cells twice as wide, until a cell is as wide as the page; those are few, so the work grows with the boxes, not with their square."""
    kept = boxes.select("doc_id", F.col(id_col).alias("id"), *"ltwh")
    page = kept.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("l").alias("x0"), F.min("t").alias("y0"), F.greatest(F.max(right()) - F.min("l"), F.max(bottom()) - F.min("t")).alias("extent"), F.avg(F.greatest("w", "h")).alias("side")
    )
    cell = F.greatest(F.col("extent") / F.ceil(F.sqrt("n")), F.col("side"), F.lit(1e-9))
    kept = written(kept.join(page.filter("n > 1").select("doc_id", "x0", "y0", "extent", cell.alias("cell")), "doc_id"), "boxes")
    open_, found, level = kept, None, 0
    while True:
        size = F.col("cell") * F.lit(float(2**level))

        def cells(rows: DataFrame, p: str, around: float, size: Column = size) -> DataFrame:
            span = lambda low, high, zero: F.explode(F.sequence(F.floor((F.col(low) - around * size - F.col(zero)) / size), F.floor((high + around * size - F.col(zero)) / size)))
            wide = rows.withColumn("cx", span("l", right(), "x0")).withColumn("cy", span("t", bottom(), "y0"))
            return wide.select("doc_id", "cx", "cy", *[F.col(c).alias(p + c) for c in ("id", *"ltwh")])

        others = kept if level == 0 else kept.join(open_.select("doc_id").distinct(), "doc_id", "left_semi")
        both = cells(open_, "u_", 1.0).join(cells(others, "v_", 0.0), ["doc_id", "cx", "cy"]).filter("u_id <> v_id")
        seen = both.groupBy("doc_id", F.col("u_id").alias("id")).agg(F.min(gap_distance("u_", "v_")).alias("nn"))
        judged = open_.join(seen, ["doc_id", "id"], "left").withColumn("done", F.coalesce(F.col("nn") <= size, F.lit(False)) | (size >= F.col("extent")))
        judged = written(judged, "near")
        near = judged.filter("done").select("doc_id", F.col("id").alias(id_col), "nn")
        found = near if found is None else found.union(near)
        open_ = judged.filter("not done").drop("nn", "done")
        if open_.limit(1).count() == 0:
            return found
        level += 1


def nearest_gaps(words: DataFrame, ratio: float = 2.0) -> DataFrame:
    """(doc_id, word_id, nn, isolated): distance to the nearest other box; isolated above the page's mean times the ratio."""
    return nearest_distances(words).withColumn("isolated", F.round("nn", 9) > F.round(F.avg("nn").over(Window.partitionBy("doc_id")) * ratio, 9))
