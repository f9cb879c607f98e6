"""Connected components inside pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written
from .paged import by_size, over_pages

#: Edges of a page that a task may hold; larger pages are solved by rounds over their edges.
PAGE_EDGES = 500_000


def components(edges: DataFrame, most: int = PAGE_EDGES) -> DataFrame:
    """(doc_id, word_id, root) of each vertex of an edge (doc_id, src, dst): root is the smallest vertex that it reaches.

    Pages of up to `most` edges are solved many to a batch, after one shuffle; those of more by contraction (see `contracted`)."""
    kind = edges.schema["src"].dataType.simpleString()
    kept = edges.select("doc_id", F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
    large = kept.groupBy("doc_id").count().filter(F.col("count") > most).select("doc_id")
    if large.limit(1).count() == 0:
        return _by_page(kept, kind)
    large = written(large, "large-pages")
    return _by_page(kept.join(large, "doc_id", "left_anti"), kind).unionByName(contracted(kept.join(large, "doc_id")))


#: Numpy types of ids.
KINDS = {"int": np.int32, "bigint": np.int64}


def _keyed(page: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vertices of a batch's edges: their pages, their ids, and the places of both ends among them."""
    low, span = min(int(a.min()), int(b.min())), max(int(a.max()), int(b.max())) - min(int(a.min()), int(b.min())) + 1
    keys, at = np.unique(np.concatenate([page, page]) * span + (np.concatenate([a, b]).astype(np.int64) - low), return_inverse=True)
    return keys // span, keys % span + low, at[: len(a)], at[len(a) :]


def lowest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest vertex that each of n reaches over edges (u, v): minimum labels with pointer jumping."""
    root = np.arange(n)
    while True:
        near = root.copy()
        np.minimum.at(near, root[u], root[v])
        np.minimum.at(near, root[v], root[u])
        near = near[near]
        if (near == root).all():
            return root
        root = near[near]


def _by_page(edges: DataFrame, kind: str) -> DataFrame:
    def solve(page: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        pages, ids, u, v = _keyed(page, a, b)
        return pages, ids.astype(KINDS[kind]), ids[lowest(len(ids), u, v)].astype(KINDS[kind])

    return over_pages(edges, ["a", "b"], [], solve, {"word_id": kind, "root": kind}, together=True)


def contracted(edges: DataFrame) -> DataFrame:
    """(doc_id, word_id, root) of edges (doc_id, a, b) by large and small stars in turn: each vertex's larger neighbours are tied to its smallest one,
    then its smaller ones and itself. Edges only fall away, and what is left in the end are stars about the smallest vertices. A round's
    table is written, so a lost executor costs one round."""

    def tied(table: DataFrame) -> DataFrame:
        """(doc_id, a, b): b to the smallest of a's neighbours and itself."""
        low = table.groupBy("doc_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        return table.join(low, ["doc_id", "a"])

    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "a", "b").cast("decimal(20, 0)"))).first())

    table = written(edges.filter("a <> b").select("doc_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    loops = edges.filter("a = b").select("doc_id", F.col("a").alias("word_id")).distinct()
    before = state(table)
    while True:
        both = table.union(table.select("doc_id", F.col("b").alias("a"), F.col("a").alias("b")))
        large = written(tied(both).filter("b > a").select("doc_id", F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct(), "large-stars")
        small = tied(large)
        small = small.select("doc_id", F.col("b").alias("a"), F.col("low").alias("b")).union(small.select("doc_id", "a", "low")).filter("a <> b").distinct()
        table = written(small, "stars")
        now = state(table)
        if now == before:
            break
        before = now
    named = table.select("doc_id", F.col("a").alias("word_id"), F.col("b").alias("root"))
    roots = table.select("doc_id", F.col("b").alias("word_id")).distinct().withColumn("root", F.col("word_id"))
    alone = loops.join(named.union(roots).select("doc_id", "word_id"), ["doc_id", "word_id"], "left_anti").withColumn("root", F.col("word_id"))
    return named.union(roots).union(alone)


def rooted(nodes: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """(doc_id, id_col, root) of all nodes, lone ones included; edges are (doc_id, a, b)."""
    found = components(edges.select("doc_id", F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("word_id", id_col)
    return nodes.select("doc_id", id_col).join(found, ["doc_id", id_col], "left").withColumn("root", F.coalesce("root", id_col))


def dbscan(nodes: DataFrame, near: DataFrame, least: int, id_col: str = "word_id", most: int = PAGE_EDGES) -> DataFrame:
    """(doc_id, id_col, root): density clusters from neighbours (doc_id, a, b), a's at b; noise is left out.

    A node with `least` neighbours, itself included, is a core; cores that are neighbours share a cluster, and another neighbour of cores
    joins the cluster of smallest root. Pages of up to `most` neighbours are solved many to a batch, those of more by joins; so are all where
    a node alone is a core."""
    near = near.select("doc_id", "a", "b").distinct()
    small, large = (None, near) if least <= 1 else by_size(near, most)
    found = None if small is None else _dense_by_page(small, least, id_col)
    if large is None:
        return found
    joined = _dense_by_joins(nodes if least <= 1 else nodes.join(large.select("doc_id").distinct(), "doc_id", "left_semi"), large, least, id_col)
    return joined if found is None else found.unionByName(joined)


def _dense_by_page(near: DataFrame, least: int, id_col: str) -> DataFrame:
    kind = near.schema["a"].dataType.simpleString()

    def solve(page: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        pages, ids, u, v = _keyed(page, a, b)
        core = np.bincount(u, minlength=len(ids)) + 1 >= least
        both, border = core[u] & core[v], ~core[u] & core[v]
        root = lowest(len(ids), u[both], v[both])
        nearest = np.where(core, root, len(ids))
        np.minimum.at(nearest, u[border], root[v[border]])
        kept = nearest < len(ids)
        return pages[kept], ids[kept].astype(KINDS[kind]), ids[nearest[kept]].astype(KINDS[kind])

    return over_pages(near, ["a", "b"], [], solve, {id_col: kind, "root": kind}, together=True)


def _dense_by_joins(nodes: DataFrame, near: DataFrame, least: int, id_col: str) -> DataFrame:
    near = written(near, "near")
    degree = near.groupBy("doc_id", F.col("a").alias(id_col)).count()
    cores = written(nodes.select("doc_id", id_col).join(degree, ["doc_id", id_col], "left").filter(F.coalesce("count", F.lit(0)) + 1 >= least).select("doc_id", id_col), "cores")
    side = lambda c: cores.withColumnRenamed(id_col, c)
    found = written(rooted(cores, near.join(side("a"), ["doc_id", "a"]).join(side("b"), ["doc_id", "b"]), id_col), "roots")
    border = near.join(cores.withColumnRenamed(id_col, "a"), ["doc_id", "a"], "left_anti").join(found.withColumnRenamed(id_col, "b"), ["doc_id", "b"])
    return found.unionByName(border.groupBy("doc_id", F.col("a").alias(id_col)).agg(F.min("root").alias("root")))


def attach_islands(clusters: DataFrame, distances: DataFrame, isolated: DataFrame, least: float, id_col: str = "phrase_id") -> DataFrame:
    """Clusters (doc_id, id_col, root) after each node alone in its cluster, but the isolated ones (doc_id, id_col), joined the nearest
    node that is no such island, if that is nearer than `least`. Distances (doc_id, a, b, dist) run from the island a."""
    clusters = written(clusters, "clusters")
    alone = clusters.groupBy("doc_id", "root").count().filter("count = 1").select("doc_id", F.col("root").alias(id_col))
    islands = written(alone.join(isolated, ["doc_id", id_col], "left_anti"), "islands")
    others = clusters.join(islands, ["doc_id", id_col], "left_anti").select("doc_id", F.col(id_col).alias("b"), F.col("root").alias("to"))
    reach = distances.filter(F.col("dist") < least).join(islands.withColumnRenamed(id_col, "a"), ["doc_id", "a"]).join(others, ["doc_id", "b"])
    best = reach.groupBy("doc_id", F.col("a").alias(id_col)).agg(F.min_by("to", F.struct("dist", "b")).alias("to"))
    return clusters.join(best, ["doc_id", id_col], "left").select("doc_id", id_col, F.coalesce("to", "root").alias("root"))


def attach_small(clusters: DataFrame, distances: DataFrame, isolated: DataFrame, least: float, largest: int, id_col: str = "phrase_id") -> DataFrame:
    """As attach_islands, where islands are the nodes of clusters of up to `largest` nodes.

    Edges from islands to other nodes count in order of (dist, a, b); one is used while a's cluster has `largest` nodes or fewer. A round
    uses each edge that is the first of both clusters it touches (larger clusters take all that come): no other edge of the round
    can change whether it is used, so rounds give what one ordered pass gives."""
    state = written(clusters.select("doc_id", id_col, "root"), "clusters")
    sized = lambda t: t.join(t.groupBy("doc_id", "root").agg(F.count("*").alias("n")), ["doc_id", "root"])
    islands = written(sized(state).filter(F.col("n") <= largest).select("doc_id", id_col).join(isolated, ["doc_id", id_col], "left_anti"), "islands")
    others = state.select("doc_id", id_col).join(islands, ["doc_id", id_col], "left_anti")
    edges = distances.filter(F.col("dist") < least).join(islands.withColumnRenamed(id_col, "a"), ["doc_id", "a"]).join(others.withColumnRenamed(id_col, "b"), ["doc_id", "b"])
    edges = edges.select("doc_id", "a", "b", F.struct("dist", "a", "b").alias("key"))
    while True:
        side = lambda c, t=sized(state): t.select("doc_id", F.col(id_col).alias(c), F.col("root").alias(f"{c}_root"), F.col("n").alias(f"{c}_n"))
        edges = written(edges.select("doc_id", "a", "b", "key").join(side("a"), ["doc_id", "a"]).join(side("b"), ["doc_id", "b"]).filter(F.col("a_root") != F.col("b_root")).filter(F.col("a_n") <= largest), "edges")
        touched = edges.select("doc_id", F.col("a_root").alias("root"), "key").union(edges.filter(F.col("b_n") <= largest).select("doc_id", "b_root", "key"))
        first = touched.groupBy("doc_id", "root").agg(F.min("key").alias("first"))
        of = lambda c: first.select("doc_id", F.col("root").alias(f"{c}_root"), F.col("first").alias(f"{c}_first"))
        used = edges.join(of("a"), ["doc_id", "a_root"]).filter("key = a_first").join(of("b"), ["doc_id", "b_root"], "left").filter((F.col("b_n") > largest) | (F.col("key") == F.col("b_first")))
        moved = written(used.select("doc_id", F.col("a_root").alias("root"), F.col("b_root").alias("to")), "moved")
        if moved.limit(1).count() == 0:
            return state
        state = written(state.join(moved, ["doc_id", "root"], "left").select("doc_id", id_col, F.coalesce("to", "root").alias("root")), "clusters")


def phrase_distances(members: DataFrame, metric: str = "neural_affinity", reduce: str = "mean_without_log", cutoff: float = 0.25, up_to: float = 1.0) -> DataFrame:
    """(doc_id, a, b, dist) of ordered pairs of a page's phrases. neural_affinity: the reduced score of their words' vectors; embedding_distance: see there; both are 1 where mean
    heights are more unlike than the cutoff, and such pairs are there only where distances up_to more than 1 count. geometric_distance: of their boxes."""
    from .affinity import embedding_distance, neural_affinity
    from .layout import pairs
    from .linking import boxed_phrases, geometric_distance

    if metric == "geometric_distance":
        one = geometric_distance(boxed_phrases(members), "phrase_id")
        return one.union(one.select("doc_id", "b", "a", "dist"))
    if metric not in ("neural_affinity", "embedding_distance"):
        raise ValueError(f"no such metric: {metric}")
    found = (neural_affinity(members, reduce, cutoff) if metric == "neural_affinity" else embedding_distance(members, cutoff)).select("doc_id", "a", "b", "dist")
    if up_to <= 1:
        return found
    found, ids = written(found, "close"), members.select("doc_id", "phrase_id").distinct()
    every = pairs(ids).filter("u_phrase_id <> v_phrase_id").select("doc_id", F.col("u_phrase_id").alias("a"), F.col("v_phrase_id").alias("b"))
    return found.unionByName(every.join(found, ["doc_id", "a", "b"], "left_anti").withColumn("dist", F.lit(1.0)))


def entity_clusters(
    members: DataFrame, must: DataFrame | None, threshold: float = 0.15, attach: float = 0.5, isolation: float = 2.0, largest: int = 1, metric: str = "neural_affinity", reduce: str = "mean_without_log", cutoff: float = 0.25, algorithm: str = "graph", least: int = 5
) -> DataFrame:
    """(doc_id, word_id, phrase_id, root): the words of phrases that are clustered by a distance (see phrase_distances).

    graph: phrases are joined below the threshold in either direction, or by must-link groups. dbscan: density clusters of phrases that have `least` others at the threshold
    or nearer, themselves included; noise is left out, and must-link groups do not count. Where attach is above 0, islands of up to `largest` phrases are tied to the nearest
    cluster below it; they are islands of the graph, which with dbscan has the must-link groups' edges alone. By vectors, all is done where the page is, whose square of words
    a task holds for the distances; geometric_distance goes by joins. members: one row per word. must: (doc_id, word_id, group_id); None, where each member has its group_id, null for
    none, beside it, so that words are not joined."""
    from .affinity import threshold_graph
    from .layout import nearest_distances
    from .linking import boxed_phrases, group_phrase_pairs

    if algorithm not in ("graph", "dbscan"):
        raise ValueError(f"no such algorithm: {algorithm}")
    if must is None and metric not in ("neural_affinity", "embedding_distance"):
        must = members.filter("group_id is not null").select("doc_id", "word_id", "group_id")
    if metric in ("neural_affinity", "embedding_distance"):
        if algorithm == "dbscan" and attach <= 0:
            return density_clusters(members, threshold, least, metric, reduce, cutoff, threshold)
        return _clusters_by_page(members, must, threshold if algorithm == "graph" else -np.inf, attach, isolation, largest, metric, reduce, cutoff, max(threshold, attach))
    near = F.col("dist") < max(threshold, attach) if algorithm == "graph" else (F.col("dist") <= threshold) | (F.col("dist") < attach)
    distances = written(phrase_distances(members, metric, reduce, cutoff, max(threshold, attach)).withColumn("dist", F.round("dist", 9)).filter(near), "distances")
    boxes = boxed_phrases(members)
    named = members.select("doc_id", "word_id", "phrase_id")
    if algorithm == "dbscan" and attach <= 0:
        return named.join(dbscan(boxes, distances.filter(F.col("dist") <= threshold), least, "phrase_id"), ["doc_id", "phrase_id"])
    links = group_phrase_pairs(must, members)
    clusters = rooted(boxes, threshold_graph(distances, threshold).union(links) if algorithm == "graph" else links, "phrase_id")
    if attach > 0:
        gaps = nearest_distances(boxes, "phrase_id")
        mean = F.avg("nn").over(Window.partitionBy("doc_id")) * isolation
        far = gaps.withColumn("far", F.round("nn", 9) > F.round(mean, 9)).filter("far").select("doc_id", "phrase_id")
        clusters = attach_islands(clusters, distances, far, attach) if largest == 1 else attach_small(clusters, distances, far, attach, largest)
    return named.join(clusters, ["doc_id", "phrase_id"])


def _page_distances(phrase: np.ndarray, x: np.ndarray, h: np.ndarray, n_chars: np.ndarray, metric: str, reduce: str, cutoff: float, up_to: float) -> tuple[np.ndarray, np.ndarray]:
    """A page's phrases, and phrase_distances of them as a table, to nine places; infinite where there is no such row. The words stand by phrase."""
    from .affinity import CONTENT, page_scores
    from .paged import rounded

    name = reduce if metric == "neural_affinity" else "l2_mean"
    some, met, made = page_scores(phrase, x, [name], cutoff, CONTENT, h, n_chars)
    ids = phrase[np.concatenate([[True], phrase[1:] != phrase[:-1]])]
    table = np.full((len(ids), len(ids)), 1.0 if up_to > 1 else np.inf)
    if len(some):
        dist = rounded(made[name]() if metric == "neural_affinity" else 1 - made[name]() / 2, 9)
        at = np.searchsorted(ids, some)
        table[at[:, None], at] = np.where(met, dist, table[0, 0])
    np.fill_diagonal(table, np.inf)
    return ids, table


def _isolated(cuts: np.ndarray, left: np.ndarray, top: np.ndarray, w: np.ndarray, h: np.ndarray, isolation: float) -> np.ndarray:
    """Which phrases, whose words begin at the cuts, have their nearest other farther off than the page's mean times isolation."""
    from .paged import rounded

    if len(cuts) < 2:
        return np.zeros(len(cuts), bool)
    x0, y0 = np.minimum.reduceat(left, cuts), np.minimum.reduceat(top, cuts)
    x1, y1 = x0 + (np.maximum.reduceat(left + w, cuts) - x0), y0 + (np.maximum.reduceat(top + h, cuts) - y0)
    apart = lambda low, end: np.maximum(np.maximum(low[None, :] - end[:, None], low[:, None] - end[None, :]), 0.0)
    gap = np.sqrt(apart(x0, x1) ** 2 + apart(y0, y1) ** 2)
    gap[gap == 0] = np.inf
    np.fill_diagonal(gap, np.inf)
    nearest = gap.min(1)
    return rounded(nearest, 9) > rounded(nearest.mean() * isolation, 9)


def _words_for_distances(members: DataFrame, *more: str | Column) -> DataFrame:
    return members.select("doc_id", "word_id", "phrase_id", "pos", "vec", "h", F.coalesce(F.length("text"), F.lit(-1)).alias("n_chars"), *more)


#: What _words_for_distances hands over, in the order of the functions of a page.
_GIVEN = ["word_id", "phrase_id", "pos", "vec", "h", "n_chars"]


def density_clusters(members: DataFrame, threshold: float, least: int, metric: str = "neural_affinity", reduce: str = "mean", cutoff: float = 0.25, up_to: float = 1.0) -> DataFrame:
    """(doc_id, word_id, phrase_id, root): the words of phrases in density clusters (see dbscan) of phrases at the threshold or nearer; noise is left out. A page's distances are made
    and used in its task, so none is dealt."""

    def solve(word: np.ndarray, phrase: np.ndarray, pos: np.ndarray, x: np.ndarray, h: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, table = _page_distances(phrase, x, h, n_chars, metric, reduce, cutoff, up_to)
        near = table <= threshold
        core = near.sum(1) + 1 >= least
        root = np.full(len(ids), len(ids))
        if core.any():
            a, b = np.nonzero(near & core[:, None] & core)
            root[core] = lowest(len(ids), a, b)[core]
            beside = np.where(near & core, root, len(ids)).min(1)
            root = np.where(core, root, beside)
        of = root[np.searchsorted(ids, phrase)]
        kept = of < len(ids)
        return word[kept], phrase[kept], ids[of[kept]]

    kinds = {c: members.schema[c].dataType.simpleString() for c in ("word_id", "phrase_id")}
    return over_pages(_words_for_distances(members), _GIVEN, ["phrase_id", "pos", "word_id"], solve, kinds | {"root": kinds["phrase_id"]})


def _clusters_by_page(members: DataFrame, must: DataFrame | None, threshold: float, attach: float, isolation: float, largest: int, metric: str, reduce: str, cutoff: float, up_to: float) -> DataFrame:
    """entity_clusters of the graph, in the page's task: distances, must-link groups, components, isolation and islands. A word stands once for each of its groups."""

    def solve(word: np.ndarray, phrase: np.ndarray, pos: np.ndarray, x: np.ndarray, h: np.ndarray, n_chars: np.ndarray, left: np.ndarray, top: np.ndarray, w: np.ndarray, group: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
        linked = phrase[held], group[held]
        order = np.lexsort((word, pos, phrase))
        order = order[np.concatenate([[True], word[order][1:] != word[order][:-1]])]
        word, phrase, x, h, n_chars, left, top, w = (c[order] for c in (word, phrase, x, h, n_chars, left, top, w))
        ids, table = _page_distances(phrase, x, h, n_chars, metric, reduce, cutoff, up_to)
        a, b = np.nonzero(table < threshold)
        if len(linked[0]):
            _, first, of = np.unique(linked[1], return_index=True, return_inverse=True)
            held_at = np.searchsorted(ids, linked[0])
            a, b = np.concatenate([a, held_at]), np.concatenate([b, held_at[first][of]])
        root = lowest(len(ids), a, b) if len(a) else np.arange(len(ids))
        if attach > 0:
            size = np.bincount(root, minlength=len(ids))
            island = size[root] <= largest
            if island.any():
                island &= ~_isolated(np.searchsorted(phrase, ids), left, top, w, h, isolation)
                i, j = np.flatnonzero(island), np.flatnonzero(~island)
                reach = table[i[:, None], j]
                if reach.size and largest == 1:
                    best = reach.argmin(1)
                    near = reach[np.arange(len(i)), best] < attach
                    root[i[near]] = root[j[best[near]]]
                elif reach.size:
                    p, q = np.nonzero(reach < attach)
                    for k in np.lexsort((q, p, reach[p, q])):
                        u, v = root[i[p[k]]], root[j[q[k]]]
                        if u != v and size[u] <= largest:
                            size[v] += size[u]
                            root[root == u] = v
        return word, phrase, ids[root[np.searchsorted(ids, phrase)]]

    kinds = {c: members.schema[c].dataType.simpleString() for c in ("word_id", "phrase_id")}
    groups = members if must is None else must
    whole = groups.schema["group_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    group = (F.col("group_id").cast("long") if whole else F.col("group_id").cast("string")).alias("group")
    words = _words_for_distances(members, "l", "t", "w", *([group] if must is None else []))
    if must is not None:
        words = words.join(must.select("doc_id", "word_id", group), ["doc_id", "word_id"], "left")
    words = words.withColumns({"held": F.col("group").isNotNull(), "group": F.coalesce("group", F.lit(0).cast("long") if whole else F.lit(""))})
    return over_pages(words, [*_GIVEN, "l", "t", "w", "group", "held"], ["word_id"], solve, kinds | {"root": kinds["phrase_id"]})
