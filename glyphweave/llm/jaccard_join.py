"""N-gram Jaccard join by set-relation skipping: links between texts whose shingle sets are similar, exactly and without all pairs.

1. Equal sets are one set (its signature); one set's answers are the answers of all its copies.
2. Shingles are in the order of a hash. A set's prefix is longer than what two linked sets may differ in by e shingles, so two
   linked sets share more than e prefix shingles. Prefix postings, with the shingle's place in the set, are exchanged once; shingles of one set
   alone are dropped, and so is every set whose prefix shares too few.
3. Sets that share one of their first shared shingles get one label (minimum labels over a few rounds). A label's sets are dealt into blocks by
   size class, and blocks whose sizes cannot link are not compared.
4. In a pair of blocks, sets that are highly similar to one leader have their differences to it computed. The distances to the leader decide most
   pairs by the triangle inequality; the rest of a set's answers is derived from the leader's by the differences alone. A task emits a link
   count per set and a spanning forest, not the pairs.
5. Pairs with different labels come from the shared prefix shingles, rarest first and without each set's most frequent ones. A shingle's list
   is in the order of its places, and only the block of it is read whose places are near enough for a link; sets of the list's most frequent
   label do not look for partners in it. What is left is verified on whole sets.
6. Components are minimum labels over the forests' edges.

Null, empty and blank texts have an empty set, are linked with nothing and are their own component. Fewer words than a shingle's are one
shingle. Ids are integers; others are an error. Rows with a null id take no part: their component is null and they have no links. Repeated rows are copies of one another.
An empty table gives no rows. Only the id and the text are read, so other columns cannot clash; an id named like a
result raises an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import buckets_for, integer_ids, materialise, no_clash, partitions
from ._exchange import bucket_borders, pack, pack_sorted, unpack, unpack_sorted
from ._words import U64, Texts, blocks, windows

SHINGLE, PERCENT = 5, 80
#: Shared prefix shingles that two linked sets have beyond one, per cent of the set's size.
EXTRA = 15
#: Most sets of a label that one task compares whole, most sets of a block of a larger label, and bytes of either.
SMALL, BLOCK, BLOCK_BYTES = 256, 512, 4 << 20
#: Leaders of a block at most, and their sets' least similarity to them, per cent. Sets without a leader are compared on their own shingles.
LEADERS, SIMILAR = 8, 60
#: Shingles per set and rounds of the labels; more of either give fewer and larger labels, with the same links.
KEYS, ROUNDS, SALTS = 4, 3, 8


def missing(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n may have and a linked one not."""
    return n - -(-n * PERCENT // 100)


def sets_of(column: pa.Array) -> list[np.ndarray]:
    t = Texts(column)
    h, of = windows(t.hashes(), t.first, SHINGLE, short=True)
    return [np.unique(h[a:b]) for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]


def signature(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        sets = sets_of(block.column("text"))
        yield pa.RecordBatch.from_arrays([block.column("id"), block.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64())], ["id", "key", "n", "sig"])


def _postings(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            once = {signature(s): s for s in sets_of(block.column("text")) if len(s)}
            if not once:
                continue
            sizes = np.array([len(s) for s in once.values()])
            low = missing(sizes) + 1 + sizes * EXTRA // 100
            token = np.concatenate([s[:k] for s, k in zip(once.values(), low.tolist(), strict=True)])
            token = token << U64(32) | token >> U64(32)  # prefixes hold low hashes; their low halves are even
            place = np.arange(len(token)) - np.repeat(np.cumsum(low) - low, low)
            order = np.argsort(token)
            token, sig, place = token[order], np.repeat(np.array(list(once), np.int64), low)[order], place[order].astype(np.uint32)
            at = bucket_borders(token, buckets)
            full = np.flatnonzero(np.diff(at))
            cut = lambda f, x: pa.array([f(x[at[k] : at[k + 1]]) for k in full], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), cut(pack_sorted, token), cut(bytes, sig), cut(pack, place)], ["bucket", "tokens", "sigs", "places"])

    return rows


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """The postings of one bucket whose shingle is in two different sets or more, with that number of sets."""
    token = np.concatenate([unpack_sorted(x) for x in pdf["tokens"]])
    sig = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["sigs"]])
    place = np.concatenate([unpack(x, np.uint32) for x in pdf["places"]])
    order = np.lexsort((sig, token))
    token, sig, place = token[order], sig[order], place[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
    token, sig, place = token[new], sig[new], place[new]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
    df = np.diff(np.append(first, len(token)))
    df = np.repeat(df, df)
    keep = df > 1
    return pd.DataFrame({"token": token[keep].view(np.int64), "sig": sig[keep], "pos": place[keep].astype(np.int32), "df": df[keep]})


def _extra(n: Column) -> Column:
    """Least number of shared prefix shingles of a set of n and any set linked with it."""
    return F.floor(F.ceil(n * PERCENT / 100) * EXTRA / 100) + 1


def _cross(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, b): pairs of sets with different labels that may link, of the tokens of one bucket.

    A token's list is in the order of the token's place in the sets. Two linked sets of x and y shingles that share the token at the places i and
    j share min(i, j) shingles before it at most and min(x - i, y - j) from it on, so |i - j| is at most a quarter of either size: of
    each list, only the block within that distance is read, and of a list's most frequent label only the other labels' sets look for partners."""
    pdf = pdf.sort_values(["token", "pos"], ignore_index=True)
    token, n, sig, label, pos = (pdf[c].to_numpy().astype(np.int64) for c in ("token", "n", "sig", "label", "pos"))
    if not len(token):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    of = np.cumsum(np.append(False, token[1:] != token[:-1]))
    by = np.lexsort((label, of))
    runs = np.flatnonzero(np.append(True, (of[by][1:] != of[by][:-1]) | (label[by][1:] != label[by][:-1])))
    size = np.diff(np.append(runs, len(by)))
    last = np.lexsort((size, of[by][runs]))  # by list, the most frequent label last
    last = last[np.append(np.flatnonzero(np.diff(of[by][runs][last])), len(last) - 1)]
    main = label[by][runs][last]
    seek = np.flatnonzero(label != main[of])
    slack = n // 4 + 1
    width = int(pos.max() + 2 * slack.max() + 2)
    line = of * width + pos + int(slack.max())
    low, high = np.searchsorted(line, line[seek] - slack[seek], "left"), np.searchsorted(line, line[seek] + slack[seek], "right")
    ends = np.cumsum(high - low)
    found, at = np.zeros((0, 2), np.int64), 0
    while at < len(seek):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
        each = (high - low)[at:to]
        i = np.repeat(seek[at:to], each)
        j = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low[at:to], each)
        total = n[i] + n[j]
        may = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
        may &= (100 + PERCENT) * (np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])) >= PERCENT * total
        x, y = sig[i[may]], sig[j[may]]
        found = np.unique(np.concatenate([found, np.stack([np.minimum(x, y), np.maximum(x, y)], 1)]), axis=0)
        at = to
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def _differences(sets: list[np.ndarray], leader: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle): what each set has beyond the leader, or lacks of it."""
    flat, row = np.concatenate([*sets, leader[:0]]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(leader):
        return row, flat
    k = np.minimum(np.searchsorted(leader, flat), len(leader) - 1)
    both = leader[k] == flat
    have = np.zeros((len(sets), len(leader)), bool)
    have[row[both], k[both]] = True
    lacking = np.nonzero(~have)
    return np.concatenate([row[~both], lacking[0]]), np.concatenate([flat[~both], leader[lacking[1]]])


def _overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: int, cols: int, step: int = 4096) -> np.ndarray:
    """How many shingles each left and each right row have in common."""
    out = np.zeros((rows, cols), np.float32)
    both = np.intersect1d(left[1], right[1])
    if not len(both):
        return out

    def placed(row: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(both, shingle), len(both) - 1)
        known = both[k] == shingle
        row, k = row[known], k[known]
        order = np.argsort(k, kind="stable")
        return row[order], k[order]

    (ra, ka), (rb, kb) = placed(*left), placed(*right)
    for c in range(0, len(both), step):
        x, y = np.zeros((rows, step), np.float32), np.zeros((cols, step), np.float32)
        i, j = slice(*np.searchsorted(ka, [c, c + step])), slice(*np.searchsorted(kb, [c, c + step]))
        x[ra[i], ka[i] - c] = 1
        y[rb[j], kb[j] - c] = 1
        out += x @ y.T
    return out


def _led(sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(leader, numbers of the sets that are highly similar to it); at the end the empty leader and the rest."""
    rest, out = np.arange(len(sets)), []
    sizes = np.array([len(s) for s in sets])
    while len(rest) > 1 and len(out) < LEADERS:
        least, n = np.unique([sets[i][0] for i in rest], return_counts=True)
        leader = next(sets[i] for i in rest if sets[i][0] == least[n.argmax()])
        d = np.bincount(_differences([sets[i] for i in rest], leader)[0], minlength=len(rest))
        near = (100 + SIMILAR) * d <= (100 - SIMILAR) * (sizes[rest] + len(leader))
        out.append((leader, rest[near]))
        rest = rest[~near]
    return [*out, (np.zeros(0, U64), rest)] if len(rest) else out


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether each left and each right set link.

    Each left set has a leader that it is highly similar to. All distances to the leader are computed once; by the triangle inequality they
    answer for most pairs. What a set's answers differ in is derived from its difference to the leader alone: two sets' distance is that of
    their differences, |x - l| + |y - l| - 2 |x - l and y - l|."""
    nl, nr = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    out = np.zeros((len(left), len(right)), bool)
    for leader, rows in _led(left):
        cols = np.flatnonzero((100 * nr >= PERCENT * nl[rows].min()) & (PERCENT * nr <= 100 * nl[rows].max()))
        if not len(cols):
            continue
        one, two = _differences([left[i] for i in rows], leader), _differences([right[j] for j in cols], leader)
        dl, dr = np.bincount(one[0], minlength=len(rows)), np.bincount(two[0], minlength=len(cols))
        total = nl[rows][:, None] + nr[cols][None, :]
        # a difference of d links when (100 + PERCENT) d <= (100 - PERCENT) total
        links = (100 + PERCENT) * (dl[:, None] + dr[None, :]) <= (100 - PERCENT) * total
        open_ = ~links & ((100 + PERCENT) * np.abs(dl[:, None] - dr[None, :]) <= (100 - PERCENT) * total)
        i, j = open_.any(1), open_.any(0)
        if i.any():
            some = lambda d, keep: ((np.cumsum(keep) - 1)[d[0][keep[d[0]]]], d[1][keep[d[0]]])
            shared = _overlaps(some(one, i), some(two, j), int(i.sum()), int(j.sum())).astype(np.int64)
            cell = np.ix_(i, j)
            links[cell] |= open_[cell] & ((100 + PERCENT) * (dl[i][:, None] + dr[j][None, :] - 2 * shared) <= (100 - PERCENT) * total[cell])
        out[np.ix_(rows, cols)] = links
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """One task: whole small labels (side 2), or one pair of blocks (sides 0 and 1). Rows: (sig, null, links) and edges (a, b, 0)."""
    counts: dict[int, int] = {}
    edges: list[tuple[int, int]] = []
    for _, g in pdf.groupby("label", sort=False):
        sets = [np.frombuffer(x, U64) for x in g["set"]]
        sig, copies, side = g["sig"].to_numpy(), g["copies"].to_numpy(), g["side"].to_numpy()
        l, r = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(l) or not len(r):
            continue
        both = (side == 2).all()
        for strip in np.split(l, range(SMALL, len(l), SMALL)):
            yes = linked_pairs([sets[i] for i in strip], [sets[i] for i in r])
            yes &= sig[strip][:, None] != sig[r][None, :]
            for k, v in zip(sig[strip].tolist(), (yes @ copies[r]).tolist(), strict=True):
                counts[k] = counts.get(k, 0) + v
            if not both:
                for k, v in zip(sig[r].tolist(), (copies[strip] @ yes).tolist(), strict=True):
                    counts[k] = counts.get(k, 0) + v
            i, j = np.nonzero(yes)
            edges += _forest(sig[strip][i], sig[r][j])
    counts = {k: v for k, v in counts.items() if v}
    return pd.DataFrame({"a": pd.array([*counts, *(x for x, _ in edges)], "Int64"), "b": pd.array([*([None] * len(counts)), *(y for _, y in edges)], "Int64"), "links": pd.array([*counts.values(), *([0] * len(edges))], "Int64")})


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of an edge can reach. Minimum labels with jumps, a written table per round."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "v"), "labels")
    while True:
        seen = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        step = labels.join(seen, "v").select("v", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        jump = step.select(F.col("v").alias("to"), F.col("to").alias("further"))
        new = materialise(step.join(jump, "to", "left").select("v", F.least("to", F.coalesce("further", "to")).alias("root"), "was"), "labels")
        if new.filter("root <> was").limit(1).count() == 0:
            return new.select("v", "root")
        labels = new.select("v", "root")


def _key(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(text, F.length(text))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, n_links (rows that link with it directly, its copies included). The ids are integers."""
    no_clash(id_col, ["n_shingles", "component_id", "n_links"])
    out = _rows(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, key (of its text), n (its set's size), component_id, n_links, root (a set that stands for its set's component)."""
    integer_ids(docs, id_col)
    p = partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _key(F.col(text_col)).alias("key"))
    rows = materialise(base.mapInArrow(_profiles, "id long, key long, n long, sig long"), "profiles")
    known = base.filter(F.col("id").isNotNull())
    groups = rows.filter("id is not null and n > 0").groupBy("sig", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))

    posted = (rows.agg(F.sum("n")).first()[0] or 0) * (100 - PERCENT + EXTRA) // 100
    shared = known.mapInArrow(_postings(buckets_for(posted * 20, p)), "bucket int, tokens binary, sigs binary, places binary")
    shared = materialise(shared.groupBy("bucket").applyInPandas(_shared, "token long, sig long, pos int, df long"), "shared")
    enough = shared.groupBy("sig").agg(F.count("*").alias("c")).join(groups, "sig").filter(F.col("c") >= _extra(F.col("n")))
    able = materialise(enough.select("sig", "n", "c", "rep", "copies"), "able")
    tokens = materialise(shared.join(able.select("sig", "n", "c"), "sig"), "tokens")

    # labels: the smallest signature seen over the first shared shingles, in a few rounds; a shingle's answer is salted, as its sets may be many
    keys = tokens.withColumn("k", F.row_number().over(Window.partitionBy("sig").orderBy("token"))).filter(F.col("k") <= KEYS)
    keys = materialise(keys.select("sig", "token", F.pmod(F.xxhash64("sig"), F.lit(SALTS)).alias("salt")), "keys")
    labels = able.select("sig", F.col("sig").alias("label"))
    for _ in range(ROUNDS):
        low = keys.join(labels, "sig").groupBy("token").agg(F.min("label").alias("low"))
        low = low.select("token", "low", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])).alias("salt"))
        labels = materialise(keys.join(low, ["token", "salt"]).groupBy("sig").agg(F.min("low").alias("label")), "labels")
    members = able.join(labels, "sig").withColumn("cls", F.floor(F.log(F.col("n")) / math.log(100 / 90)).cast("int"))

    # whole sets, of one text of each able set
    wanted = members.select("sig", "rep", "n", "copies", "label", "cls")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            made = sets_of(block.column("text"))
            at = [i for i, (s, want) in enumerate(zip(made, block.column("sig").to_pylist(), strict=True)) if signature(s) == want]
            yield pa.RecordBatch.from_arrays([*(block.column(c).take(pa.array(at, pa.int64())) for c in ("sig", "n", "copies", "label", "cls")), pa.array([made[i].tobytes() for i in at], pa.binary())], ["sig", "n", "copies", "label", "cls", "set"])

    full = known.join(wanted.withColumnRenamed("rep", "id"), "id").select("text", "sig", "n", "copies", "label", "cls").mapInArrow(sets, "sig long, n long, copies long, label long, cls int, set binary")
    full = materialise(full.dropDuplicates(["sig"]), "sets")

    # inside labels: small ones whole, many to a task; large ones in pairs of blocks
    sizes = materialise(members.groupBy("label").agg(F.count("*").alias("members"), (8 * F.sum("n")).alias("bytes")).filter("members > 1"), "label-sizes")
    is_small = (F.col("members") <= SMALL) & (F.col("bytes") <= 4 * BLOCK_BYTES)
    tasks = buckets_for(sizes.filter(is_small).agg(F.sum("bytes")).first()[0] or 0, 4 * p)
    small = full.join(sizes.filter(is_small), "label").select(F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.lit(tasks))).alias("task"), F.lit(2).alias("side"), "label", "sig", "copies", "set")
    subs = F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("n") / BLOCK_BYTES)).cast("int")
    large = materialise(members.join(sizes.filter(~is_small), "label").groupBy("label", "cls").agg(subs.alias("subs")), "blocks")
    cells = large.select("label", "cls", "subs", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    other = cells.select("label", F.col("cls").alias("cls2"), F.col("sub").alias("sub2"))
    pairs = cells.drop("subs").join(other, "label").filter("cls2 between cls and cls + 3 and (cls2 > cls or sub2 >= sub)")
    pairs = pairs.withColumn("task", F.concat_ws(":", F.lit("l"), "label", "cls", "sub", "cls2", "sub2"))
    blocked = full.join(large, ["label", "cls"]).withColumn("sub", F.pmod(F.xxhash64("sig"), "subs").cast("int"))
    one = blocked.join(pairs, ["label", "cls", "sub"]).select("task", F.when(F.expr("cls = cls2 and sub = sub2"), 2).otherwise(0).alias("side"), "label", "sig", "copies", "set")
    two = blocked.join(pairs.filter("not (cls = cls2 and sub = sub2)").drop("cls", "sub").withColumnsRenamed({"cls2": "cls", "sub2": "sub"}), ["label", "cls", "sub"]).select("task", F.lit(1).alias("side"), "label", "sig", "copies", "set")
    inside = materialise(small.union(one).union(two).groupBy("task").applyInPandas(_compare, "a long, b long, links long"), "inside")

    # between labels: two linked sets share so many of these shingles that they share one even without a set's most frequent ones
    order = tokens.withColumn("rank", F.row_number().over(Window.partitionBy("sig").orderBy("df", "token")))
    labelled = order.filter(F.col("rank") <= F.col("c") - _extra(F.col("n")) + 1).join(labels, "sig").withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(4 * p)))
    near = materialise(labelled.select("bucket", "token", "sig", "n", "label", "pos").groupBy("bucket").applyInPandas(_cross, "a long, b long").distinct(), "near")
    of = full.select("sig", "n", "copies", "set")
    sided = near.select("a", "b").join(of.select(F.col("sig").alias("a"), F.col("copies").alias("ca"), F.col("set").alias("sa")), "a").join(of.select(F.col("sig").alias("b"), F.col("copies").alias("cb"), F.col("set").alias("sb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield batch.select(["a", "b", "ca", "cb"]).filter(pa.array(ok, pa.bool_()))

    between = materialise(sided.mapInArrow(verify, "a long, b long, ca long, cb long"), "between")

    edges = inside.filter("b is not null").select("a", "b").union(between.select("a", "b"))
    roots = components(edges)
    links = inside.filter("b is null").select("a", "links").union(between.select("a", "cb")).union(between.select("b", "ca")).groupBy(F.col("a").alias("sig")).agg(F.sum("links").alias("links"))
    smallest = roots.join(able.select(F.col("sig").alias("v"), "rep"), "v").groupBy("root").agg(F.min("rep").alias("component"))
    found = roots.join(smallest, "root").select(F.col("v").alias("sig"), "component", F.col("root").alias("top"))
    answers = groups.join(found, "sig", "left").join(links, "sig", "left")
    answers = answers.select(F.col("sig").alias("s"), F.col("n").alias("m"), F.coalesce("component", "rep").alias("component"), F.coalesce("top", "sig").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.join(answers, F.expr("sig = s and n = m"), "left")
    known = F.col("id").isNotNull()
    return out.select("id", "key", "n", F.when(known, F.coalesce("component", "id")).alias("component_id"), F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(known, F.col("top")).alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns: of the rows with its smallest id the one of a set that the text's key decides. Texts that are linked with nothing
    all stay, whatever their ids, and equal rows of such once. Rows with a null id stay."""
    found = materialise(_rows(docs, id_col, text_col).filter("id is not null"), "judged").withColumn("own", F.struct((F.col("component_id") != F.col("id")).alias("other"), "id", "key"))
    # a component's row is that of its smallest id, by its text's key; a text without words is a component of its own
    group = F.coalesce(F.col("root"), F.xxhash64("id", "key")), F.col("root").isNull()
    stay = found.groupBy(*[c.alias(k) for c, k in zip(group, ("g", "wordless"), strict=True)]).agg(F.min("own").alias("own")).select(F.col("own.id").alias("id"), F.col("own.key").alias("key"))
    times = found.groupBy("id", "key").agg(F.count("*").alias("times"))
    stay = materialise(stay.distinct().join(times, ["id", "key"]).select(F.col("id").alias("s_id"), F.col("key").alias("s_key"), "times"), "stay")
    here = lambda which: docs.join(stay.filter(which), (docs[f"`{id_col}`"].cast("long") == F.col("s_id")) & (_key(docs[f"`{text_col}`"]) == F.col("s_key")), "left_semi")
    several = here("times > 1").dropDuplicates([id_col, text_col])
    return here("times = 1").unionByName(several).unionByName(docs.filter(F.col(f"`{id_col}`").isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])
