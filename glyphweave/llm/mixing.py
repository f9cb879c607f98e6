"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Each source's rows are dealt by a hash into blocks; block sizes are summed in one aggregation
(sources times blocks_per_source rows at most, whatever the input). A source's target words are met by whole
passes over all its blocks and then by blocks drawn once more in a permuted order while they fit. What is left then is less than
the smallest block that may be drawn: of that one, rows are drawn in the order of a hash, up to the one that brings the sum nearest; sums by ranges
of that hash leave one range to be put in order row by row. The draws of
all sources are one population of coloured balls: a binary tree over the output shards splits it, each node
giving its left half an exact number of draws of each source by a multivariate hypergeometric draw. At the leaves
every shard has exact quotas and takes the next, disjoint, permuted blocks of each source. The tree has two levels: groups of SOURCES_A_TASK
sources, neighbours in order, are split among the shards first, and a group's sources are split by what the group gives each shard.
Rows are then joined to their block's draws and ordered inside a shard by a hash.

A null source is a source of its own, last in order. Rows without words have size 0 and are taken as often as
their block. Repeated rows share a block and are each counted. A text of any length is one row's work. All columns are kept inside `row`, so names cannot
clash. An empty table gives no rows. All draws depend on
the seed and on the rows alone, so reruns agree. Up to driver_sources sources are drawn on the driver, one number per source and
block, and the block table is broadcast; of more, groups are drawn in tasks by the same rule, with the same rows, one number per group goes to the driver, and
the block table is joined by shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, partitions, space_words

BLOCK_TABLE = "b_src string, b_block int, source_size long, target double, shards array<int>, part_words double, part_shard int"
#: Sources of a group, which one task draws and splits: so many times blocks_per_source rows at most.
SOURCES_A_TASK = 256
#: Ranges of the hash that orders a block drawn in part: 2 to this.
SUB_BITS = 12


def targets(sizes: dict, weights: tuple[float, ...], most_times: float, total: float) -> dict:
    """Words per source: `total` in proportion to the weights, which repeat over the sources in code point order, null last;
    a source stops at most_times its size and the excess is shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict = {}
    rest = total
    open_ = [s for s in order if sizes[s] > 0]
    out.update({s: 0.0 for s in order if sizes[s] <= 0})
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share > most_times * sizes[s]]
        if not full:
            out.update({s: weight[s] * share for s in open_})
            break
        for s in full:
            out[s] = float(most_times * sizes[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def draw_blocks(sizes: np.ndarray, target: float, most_times: int, rng: np.random.Generator) -> tuple[list[int], float]:
    """Draws of blocks of one source, and the words to draw of the last of them, 0 for all: whole passes, each in its own permuted order,
    then the blocks that still fit, in further rounds while a block may be drawn again, then the smallest that may be in part."""
    total, draws, n = float(sizes.sum()), [], len(sizes)
    if total <= 0 or n == 0:
        return draws, 0.0
    passes = int((target + 1e-6) // total)
    for _ in range(passes):
        draws += rng.permutation(n).tolist()
    left = target - passes * total
    for _ in range(passes, most_times):
        for b in rng.permutation(n).tolist():
            if 0 < sizes[b] <= left + 1e-6:
                draws.append(b)
                left -= sizes[b]
    may = np.flatnonzero((sizes > 0) & (np.bincount(draws, minlength=n) < most_times))
    if left < 0.5 or not len(may):
        return draws, 0.0
    return [*draws, int(may[sizes[may].argmin()])], float(left)


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator, sizes: np.ndarray | None = None) -> np.ndarray:
    """Exact quotas of each source (column) for each shard (row). Halving the shards, the left half gets its share of the
    draws by one multivariate hypergeometric draw; sizes: how many draws each shard gets, by default equal numbers but for one draw."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        a, b, q = todo.pop()
        if b - a == 1:
            out[a] = q
            continue
        mid = (a + b) // 2
        share = int(q.sum()) * (mid - a) // (b - a) if sizes is None else int(sizes[a:mid].sum())
        left = rng.multivariate_hypergeometric(q, share, method="marginals")
        todo += [(a, mid, left), (mid, b, q - left)]
    return out


def draw_group(blocks: list[list[tuple[int, int]]], goals: list[float], most_times: int, seed: int, group: int) -> list[tuple[list[int], float]]:
    """The draws of a group's sources (see draw_blocks), from their blocks (number, words)."""
    rng = np.random.default_rng([seed, group, 0])
    return [draw_blocks(np.array([w for _, w in of], float), goal, most_times, rng) for of, goal in zip(blocks, goals, strict=True)]


def deal_group(blocks: list[list[tuple[int, int]]], drawn: list[tuple[list[int], float]], sizes: np.ndarray, seed: int, group: int) -> list[list[tuple]]:
    """Per source and block: the shards of the block's draws, and of a draw in part its words and shard, else nulls. sizes: each shard's draws."""
    rng = np.random.default_rng([seed, group, 1])
    quotas = split_quotas(np.array([len(d) for d, _ in drawn], np.int64), len(sizes), rng, sizes)
    out = []
    for j, of in enumerate(blocks):
        into: list[tuple] = [([], None, None) for _ in of]
        draws, left = drawn[j]
        to = np.repeat(np.arange(len(sizes)), quotas[:, j])
        to = rng.permutation(to).tolist() if left else to.tolist()  # else a draw in part, the last, would always go to the last shard
        for i, shard in zip(draws[: len(draws) - bool(left)], to, strict=False):
            into[i][0].append(shard)
        if left:
            into[draws[-1]] = (into[draws[-1]][0], left, to[-1])
        out.append(into)
    return out


def split_groups(totals: list[int], shards: int, seed: int) -> np.ndarray:
    """How many draws of each group (column) each shard (row) gets."""
    return split_quotas(np.array(totals, np.int64), shards, np.random.default_rng([seed]))


def _many_targets(sums: DataFrame, weights: tuple[float, ...], most_times: int) -> DataFrame:
    """src, source_size, rank, target as `targets` has them, of any number of sources: only sums per weight go to the driver.

    A source stops where the share of a unit of weight is above most_times * size / weight, and shares only grow from round to round."""
    spark, by_name = sums.sparkSession, F.col("src").asc_nulls_last()
    sizes = sums.groupBy("src").agg(F.sum("words").alias("source_size"))
    sizes = materialise(sizes.repartitionByRange(partitions(spark), by_name).withColumn("part", F.spark_partition_id()), "sources")
    offsets, n = {}, 0
    for r in sizes.groupBy("part").count().orderBy("part").collect():
        offsets[r["part"]], n = n, n + r["count"]
    offset = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(by_name)) - 1 + F.element_at(offset, F.col("part")).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = materialise(ranked.select("src", "source_size", "rank", weight.alias("weight")), "ranks")
    share = 0.0
    total = ranked.agg(F.sum("source_size")).first()[0]
    full = lambda share: F.col("weight") * F.lit(share) > most_times * F.col("source_size")
    while True:
        sums_of = ranked.filter("source_size > 0").groupBy("weight", full(share).alias("full")).agg(F.sum("source_size").alias("words"), F.count("*").alias("n")).collect()
        open_ = sum(r["n"] * r["weight"] for r in sorted(sums_of, key=lambda r: r["weight"]) if not r["full"])
        if not open_:
            break
        further = (total - most_times * sum(r["words"] for r in sums_of if r["full"])) / open_
        if further <= share:
            break
        share = further
    target = F.when(F.col("source_size") <= 0, F.lit(0.0)).when(full(share), (most_times * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(share))
    return ranked.select("src", "source_size", "rank", target.alias("target"))


def _many_draws(sums: DataFrame, weights: tuple[float, ...], most_times: int, shards: int, seed: int) -> DataFrame:
    """The block table of any number of sources, a task for each group. One number per group goes to the driver and `shards` numbers come back."""
    spark = sums.sparkSession

    def held(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[list[tuple[int, int]]], list[tuple[list[int], float]]]:
        pdf = pdf.sort_values(["rank", "b_block"], ignore_index=True)
        rank = pdf["rank"].to_numpy()
        cuts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])).tolist()
        pairs = list(zip(pdf["b_block"].tolist(), pdf["words"].tolist(), strict=True))
        blocks = [pairs[a:b] for a, b in zip(cuts, [*cuts[1:], len(pairs)], strict=True)]
        return pdf, blocks, draw_group(blocks, pdf["target"].iloc[cuts].tolist(), most_times, seed, int(pdf["task"].iloc[0]))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, drawn = held(pdf)
        return pd.DataFrame({"task": pdf["task"].iloc[:1], "draws": [sum(len(d) for d, _ in drawn)]})

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, blocks, drawn = held(pdf)
        dealt = deal_group(blocks, drawn, np.array(pdf["sizes"].iloc[0], np.int64), seed, int(pdf["task"].iloc[0]))
        every = [block for source in dealt for block in source]
        pdf["shards"] = [to for to, _, _ in every]
        pdf["part_words"] = pd.array([w for _, w, _ in every], "Float64")
        pdf["part_shard"] = pd.array([k for _, _, k in every], "Int32")
        return pdf[["b_src", "b_block", "source_size", "target", "shards", "part_words", "part_shard"]]

    goals = _many_targets(sums, weights, most_times).withColumnRenamed("src", "b_src")
    blocks = sums.join(goals, F.col("src").eqNullSafe(F.col("b_src"))).select("b_src", F.col("block").alias("b_block"), "words", "source_size", "target", "rank", F.floor(F.col("rank") / SOURCES_A_TASK).alias("task"))
    blocks = materialise(blocks, "goals")
    totals = [(r["task"], r["draws"]) for r in blocks.groupBy("task").applyInPandas(count, "task long, draws long").orderBy("task").collect()]
    quotas = split_groups([n for _, n in totals], shards, seed)
    sizes = spark.createDataFrame([(task, quotas[:, k].tolist()) for k, (task, _) in enumerate(totals)], "task long, sizes array<long>")
    return blocks.join(sizes, "task").groupBy("task").applyInPandas(deal, BLOCK_TABLE)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most_times: int = 3, shards: int = 16, blocks_per_source: int = 2048, seed: int = 20, most_sources: int | None = None, driver_sources: int = 64
) -> DataFrame:
    """Struct `row` of the input's columns, size, source_size, target, taken, and shards: the shard of each time the row is taken.

    More than driver_sources sources are drawn in tasks; more than most_sources, where given, raise an error."""
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    sized = lambda rows: rows.withColumn("size", F.size(space_words(F.col("row")[text_col])).cast("long"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("src"), F.pmod(key, F.lit(blocks_per_source)).cast("int").alias("block"), key.alias("key"))
    sums = sized(base).groupBy("src", "block").agg(F.sum("size").alias("words"))
    most = driver_sources if most_sources is None else max(most_sources, driver_sources)
    per_source = {r["src"]: r["words"] for r in sums.groupBy("src").agg(F.sum("words").alias("words")).limit(most + 1).collect()}
    if most_sources is not None and len(per_source) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    on = F.col("src").eqNullSafe(F.col("b_src")) & (F.col("block") == F.col("b_block"))
    few = len(per_source) <= driver_sources
    if not few:
        table = materialise(_many_draws(materialise(sums, "sums"), weights, most_times, shards, seed), "draws")
    else:
        blocks: dict = {s: [] for s in per_source}
        for r in sums.toLocalIterator():
            blocks[r["src"]].append((r["block"], r["words"]))
        goal = targets(per_source, weights, most_times, float(sum(per_source.values())))
        order = sorted((s for s in blocks if s is not None), key=lambda s: s.encode()) + [s for s in blocks if s is None]
        held = [sorted(blocks[s]) for s in order]
        groups = [(held[i : i + SOURCES_A_TASK], [goal[s] for s in order[i : i + SOURCES_A_TASK]]) for i in range(0, len(order), SOURCES_A_TASK)]
        drawn = [draw_group(of, goals, most_times, seed, g) for g, (of, goals) in enumerate(groups)]
        quotas = split_groups([sum(len(d) for d, _ in x) for x in drawn], shards, seed)
        dealt = [source for g, (of, _) in enumerate(groups) for source in deal_group(of, drawn[g], quotas[:, g], seed, g)]
        # driver_sources times blocks_per_source rows at most
        table = spark.createDataFrame([(s, block, per_source[s], goal[s], *into) for s, of, each in zip(order, held, dealt, strict=True) for (block, _), into in zip(of, each, strict=True)], BLOCK_TABLE)
    sent = lambda which: F.broadcast(table.filter(which)) if few else table.filter(which)
    whole = sized(base.join(sent("part_words is null"), on)).select("row", "size", "source_size", "target", "shards")
    # one block of a source at most is drawn in part; its rows go by ranges of a second hash, and those of one range alone are put in order
    again = F.xxhash64(F.lit(~seed), "key")
    part = materialise(sized(base.join(sent("part_words is not null"), on)).withColumns({"again": again, "sub": F.shiftrightunsigned(again, 64 - SUB_BITS)}), "parts")
    by_sub = part.groupBy("src", "sub").agg(F.sum("size").alias("words"))
    below = by_sub.select(F.col("src").alias("s_src"), F.col("sub").alias("s_sub"), (F.sum("words").over(Window.partitionBy("src").orderBy("sub")) - F.col("words")).alias("below"))
    part = part.join(below, F.col("src").eqNullSafe(F.col("s_src")) & (F.col("sub") == F.col("s_sub")))
    within = Window.partitionBy("src", "sub").orderBy("again", F.col("row")[id_col], F.col("row")[text_col], F.to_json("row")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("below") + F.coalesce(F.sum("size").over(within), F.lit(0))
    more = (F.col("size") > 0) & (before + F.col("size") / 2 <= F.col("part_words"))
    part = part.withColumn("more", more).select("row", "size", "source_size", "target", F.when(F.col("more"), F.array_append("shards", F.col("part_shard"))).otherwise(F.col("shards")).alias("shards"))
    return whole.unionByName(part).select("row", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", seed: int = 20, **kw) -> DataFrame:
    """The input's columns, each row as often as it is taken, dealt to the output shards and shuffled inside each.

    A shard is dealt in ranges of its shuffle's hash, so that a task's share is that of the session's parts, whatever the shards' number."""
    n = kw.get("shards", 16)
    pieces = max(1, -(-2 * partitions(docs.sparkSession) // n))
    out = mix(docs, id_col=id_col, seed=seed, **kw).select("row", F.posexplode("shards").alias("k", "shard"))
    out = out.withColumn("place", F.xxhash64(F.lit(seed), F.col("row")[id_col].cast("string"), F.col("row")[kw.get("text_col", "text")], "k"))
    out = out.withColumn("piece", F.floor((F.shiftrightunsigned("place", 32) * pieces) / (1 << 32)).cast("int"))
    out = out.repartition(n * pieces, "shard", "piece").sortWithinPartitions("shard", F.shiftrightunsigned("place", 1))
    return out.select("row.*")
