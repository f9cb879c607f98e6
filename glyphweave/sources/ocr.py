"""Page files in and out: recognised words and lines, constraints, results and labelled image listings."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import normalised_box
from ..operators import measures
from ..operators.graph import rooted
from ..operators.paged import over_pages

# The files' fields.
OBJECTS = "objects array<struct<type string, score double, text struct<content string, score double>, bbox struct<vertices array<struct<x double, y double>>>>>, imageSize struct<width int, height int>"
WORDS = "DetectedText string, Geometry struct<BoundingBox struct<Width double, Top double, Height double, Left double>, Polygon array<struct<X double, Y double>>>"
CONSTRAINTS = "must_link array<array<int>>, must_not_link array<array<array<int>>>"
IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "bmp"]


def page_name(path: Column, root: str, suffixes: list[str]) -> Column:
    """A page's name: its file's path below the root folder (up to a pattern's first sign, where the root is one) without its last suffix, then
    without a listed one. A root that is a file gives the file's own name."""
    folder = re.split(r"[*?\[{]", root)[0]
    folder = root.rstrip("/") + "/" if folder == root else folder[: folder.rfind("/") + 1]
    folder = re.sub(r"^[a-z0-9+.-]+:/*", "", folder, flags=re.IGNORECASE).lstrip("/")
    decoded = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    below = F.regexp_replace(decoded, r"^[a-z0-9+.-]+:/*([^/]*/)??\Q" + folder + r"\E", "")
    own = F.when(decoded.endswith("/" + folder.rstrip("/")), F.regexp_extract(decoded, r"([^/]*)$", 1)).otherwise(below)
    name = F.regexp_replace(own, r"\.[^./]*$", "")
    return F.regexp_replace(name, rf"(?i)\.({'|'.join(suffixes)})$", "") if suffixes else name


def page_of(root: str) -> Column:
    """The column doc_id of rows of files that were read from root."""
    return page_name(F.col("_metadata.file_path"), root, IMAGE_SUFFIXES).alias("doc_id")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, type, object_id, text, score, l, t, w, h) of pages that hold `objects`; ids are places in the file."""
    return laid_out(spark.read.schema(OBJECTS).json(path, multiLine=True).select("*", page_of(path)))


def laid_out(files: DataFrame) -> DataFrame:
    """The columns of read_objects from rows of files (doc_id, objects, imageSize)."""
    pages = files.select("doc_id", F.posexplode("objects").alias("object_id", "o"), "imageSize")
    xs, ys = F.transform("o.bbox.vertices", lambda v: v["x"]), F.transform("o.bbox.vertices", lambda v: v["y"])
    return pages.select("doc_id", F.col("o.type").alias("type"), "object_id", F.col("o.text.content").alias("text"), F.col("o.score").alias("score"), *normalised_box(xs, ys, F.col("imageSize.width"), F.col("imageSize.height")))


def read_word_lists(spark: SparkSession, path: str, polygons: bool = False) -> DataFrame:
    """The same columns of pages that are a list of words in page units; with their polygons, array<struct<X, Y>>, if asked for."""
    rows = spark.read.schema(WORDS).json(path, multiLine=True)
    return listed(rows.select(page_of(path), "DetectedText", "Geometry", F.monotonically_increasing_id().alias("at")), polygons)


def listed(rows: DataFrame, polygons: bool = False) -> DataFrame:
    """The columns of read_word_lists from words' rows (doc_id, DetectedText, Geometry, at), a page's in the order of `at`."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    more = [F.col("Geometry.Polygon").alias("polygon")] if polygons else []
    return rows.select("doc_id", F.lit("Word").alias("type"), place.alias("object_id"), F.col("DetectedText").alias("text"), F.lit(1.0).alias("score"), *[F.col(f"Geometry.BoundingBox.{a}").alias(b) for a, b in (("Left", "l"), ("Top", "t"), ("Width", "w"), ("Height", "h"))], *more)


def read_constraints(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """must (doc_id, group_id, word_id) and cannot (doc_id, pair_id, side, word_id)."""
    rows = spark.read.schema(CONSTRAINTS).json(path, multiLine=True).select(page_of(path), "must_link", "must_not_link")
    must = rows.select("doc_id", F.posexplode("must_link").alias("group_id", "g")).select("doc_id", "group_id", F.explode("g").alias("word_id"))
    cannot = rows.select("doc_id", F.posexplode("must_not_link").alias("pair_id", "p")).select("doc_id", "pair_id", F.posexplode("p").alias("i", "s"))
    return must, cannot.select("doc_id", "pair_id", F.when(F.col("i") == 0, "A").otherwise("B").alias("side"), F.explode("s").alias("word_id"))


def constraint_rows(must: DataFrame, cannot: DataFrame) -> DataFrame:
    """(doc_id, must_link, must_not_link), in the files' form; write it with `write.json`."""
    words = F.array_sort(F.collect_list("word_id"))
    groups = must.groupBy("doc_id", "group_id").agg(words.alias("ws")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "ws"))), lambda x: x["ws"]).alias("must_link"))
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("word_id"))))
    sides = cannot.groupBy("doc_id", "pair_id").agg(F.array(side("A"), side("B")).alias("ws"))
    pairs = sides.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pair_id", "ws"))), lambda x: x["ws"]).alias("must_not_link"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return groups.join(pairs, "doc_id", "full").select("doc_id", empty("must_link", "array<array<int>>"), empty("must_not_link", "array<array<array<int>>>"))


def corners(l: Column, t: Column, w: Column, h: Column) -> Column:  # noqa: E741
    """The polygon of a box: its corners from the left upper one on, clockwise."""
    point = lambda x, y: F.struct(x.cast("double").alias("X"), y.cast("double").alias("Y"))
    return F.array(point(l, t), point(l + w, t), point(l + w, t + h), point(l, t + h))


def result_rows(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """(doc_id, Words, Phrases): boxes, polygons, texts, and ids by first appearance. Words without a cluster share one id where a page has
    clusters, and have -1 where it has none; likewise phrases. clusters: (doc_id, word_id, cluster). A word's polygon is that of the members' column
    `polygon`, where there is one, else its box's corners; a phrase of one word has that word's."""
    shape = F.coalesce(F.col("polygon"), corners(*map(F.col, "ltwh"))) if "polygon" in members.columns else corners(*map(F.col, "ltwh"))
    laid = members.withColumn("polygon", shape).join(clusters.select("doc_id", "word_id", "cluster"), ["doc_id", "word_id"], "left")
    page = Window.partitionBy("doc_id")
    first = laid.withColumns({"p0": F.min("word_id").over(Window.partitionBy("doc_id", "phrase_id")), "c0": F.min("word_id").over(Window.partitionBy("doc_id", "cluster")), "any": F.max("cluster").over(page), "phrased": F.max("phrase_id").over(page)})
    number = lambda known, by: F.when(F.col(known).isNull(), -1).otherwise(F.dense_rank().over(page.orderBy(by)) - 1)
    ids = first.withColumns({"PhraseId": number("phrased", "p0"), "ClusterId": number("any", "c0")})
    geometry = lambda l, t, w, h, polygon: F.struct(F.struct(w.alias("Width"), t.alias("Top"), h.alias("Height"), l.alias("Left")).alias("BoundingBox"), polygon.alias("Polygon")).alias("Geometry")  # noqa: E731, E741
    ordered = lambda k, s: F.transform(F.array_sort(F.collect_list(F.struct(k, s.alias("s")))), lambda x: x["s"])
    word = F.struct(geometry(*map(F.col, "ltwh"), F.col("polygon")), F.col("text").alias("DetectedText"), F.lit("WORD").alias("Type"), "PhraseId", "ClusterId")
    words = ids.groupBy("doc_id").agg(ordered(F.col("word_id"), word).alias("Words"))
    grouped = ids.filter("phrase_id is not null").groupBy("doc_id", "PhraseId").agg(
        F.min("l").alias("l"), F.min("t").alias("t"), (F.max(F.col("l") + F.col("w")) - F.min("l")).alias("w"), (F.max(F.col("t") + F.col("h")) - F.min("t")).alias("h"),
        F.array_join(ordered(F.col("pos"), F.col("text")), " ").alias("text"), F.count("*").alias("n"), F.first("polygon").alias("own"),
    )
    around = F.when(F.col("n") == 1, F.col("own")).otherwise(corners(*map(F.col, "ltwh")))
    phrase = F.struct(geometry(*map(F.col, "ltwh"), around), F.col("text").alias("DetectedText"), F.lit("PHRASE").alias("Type"))
    found = words.join(grouped.groupBy("doc_id").agg(ordered(F.col("PhraseId"), phrase).alias("Phrases")), "doc_id", "left")
    return found.withColumn("Phrases", F.coalesce("Phrases", F.array().cast(found.schema["Phrases"].dataType)))


def paired_images(spark: SparkSession, images: str, pages: DataFrame) -> DataFrame:
    """Pages with the path of the image of their name, whatever its suffix."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(images).select("path")
    named = found.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(IMAGE_SUFFIXES)).select(page_name(F.col("path"), images, []).alias("doc_id"), "path")
    return pages.join(named, "doc_id")


def label_table(words: DataFrame, must: DataFrame) -> DataFrame:
    """(doc_id, word_id, label): words that must groups (doc_id, group_id, word_id) join share a label; a page's labels count from 0 in the order
    of their first words. Write it with `write.parquet`."""
    first = F.min("word_id").over(Window.partitionBy("doc_id", "group_id"))
    rooted_ = rooted(words, must.select("doc_id", F.col("word_id").alias("b"), first.alias("a")).filter("a <> b"), "word_id")
    return rooted_.select("doc_id", "word_id", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("root")) - 1).alias("label"))


def study_rows(initial: DataFrame, user: DataFrame, must: DataFrame, cannot: DataFrame) -> DataFrame:
    """Per page: initial_clusters and user_clusters (labels in word order), ami, nmi, acc, user_constraints; write it with `write.json`.

    initial, user: (doc_id, word_id, label) of the same words."""
    both = initial.select("doc_id", "word_id", F.col("label").alias("pred")).join(user.select("doc_id", "word_id", F.col("label").alias("truth")), ["doc_id", "word_id"])
    return studied(both, must, cannot)


def studied(both: DataFrame, must: DataFrame, cannot: DataFrame) -> DataFrame:
    """study_rows of words that have both labels (doc_id, word_id, pred, truth); a batch of pages is listed and scored at once, in its task."""

    def score(page: np.ndarray, word: np.ndarray, pred: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray | pa.Array, ...]:
        classes = measures.Classes(page, pred, truth)
        cuts = pa.array(np.searchsorted(page, np.arange(classes.pages + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(c)) for c in (pred, truth)]
        return np.arange(classes.pages), *lists, classes.ami(), classes.nmi(), measures.matches(classes)[2]

    kinds = {name: f"array<{both.schema[c].dataType.simpleString()}>" for name, c in (("initial_clusters", "pred"), ("user_clusters", "truth"))}
    known = both.filter("pred is not null and truth is not null")
    scored = over_pages(known, ["word_id", "pred", "truth"], ["word_id"], score, kinds | dict.fromkeys(("ami", "nmi", "acc"), "double"), together=True)
    links = constraint_rows(must, cannot).select("doc_id", F.struct("must_link", "must_not_link").alias("user_constraints"))
    return scored.join(links, "doc_id", "left").select("doc_id", "initial_clusters", "user_clusters", "ami", F.round("nmi", 6).alias("nmi"), "acc", "user_constraints")


def labelled_images(spark: SparkSession, root: str) -> DataFrame:
    """(phase, class, label, path) of root/phase/class/file; labels number the sorted class names from 0, few per phase."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = found.select("path", F.regexp_extract("path", r"([^/]*)/[^/]*/[^/]*$", 1).alias("phase"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("class"))
    names = parts.select("phase", "class").distinct().withColumn("label", F.row_number().over(Window.partitionBy("phase").orderBy("class")) - 1)
    return parts.join(names, ["phase", "class"]).select("phase", "class", "label", "path")
