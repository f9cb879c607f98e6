"""Pages taken in as their files arrive: cleaned, cut into phrases and written as tables, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, linking
from ..plans.lineage import written
from ..sources.ocr import OBJECTS, WORDS, laid_out, listed, page_of, result_rows

#: The tables that a batch writes, beside `batches`, which names the batches that are whole.
TABLES = ["words", "phrases", "results"]


def clean_words(objects: DataFrame, least: float = 0.1) -> DataFrame:
    """The words of pages that pass the score, text and shape filters, with word_id."""
    words = objects.filter(F.col("type") == "Word").withColumnRenamed("object_id", "word_id").drop("type")
    return layout.drop_slim(layout.keep_worded(layout.keep_scored(words, least)))


def snapped_words(objects: DataFrame, least: float = 0.1, line_least: float = 0.8) -> DataFrame:
    """Scored words with a text at the height of their lines; words without a line are left out. objects: as read_objects gives them."""
    words = objects.filter(F.col("type") == "Word").withColumnRenamed("object_id", "word_id").drop("type")
    lines = objects.filter(F.col("type") == "Line").withColumnRenamed("object_id", "line_id")
    kept = layout.keep_worded(layout.keep_scored(words, least))
    laid = layout.assign_lines(kept, layout.keep_scored(lines, line_least).select("doc_id", "line_id", "score", *"ltwh"))
    return kept.drop(*"ltwh").join(laid.select("doc_id", "word_id", *"ltwh"), ["doc_id", "word_id"])


def page_tables(objects: DataFrame, lists: DataFrame, horizontal: float = 0.55, vertical: float = 0.0) -> dict[str, DataFrame]:
    """The tables of pages of both formats: clean words with their phrases, phrases, and result rows, without clusters.

    objects: words and lines (see read_objects); words take their lines' heights. lists: words alone (see read_word_lists), with polygons. Then words that are
    too slim for their page go, then those that repeat a box. A page without a word that stays has no rows."""
    shape = "array<struct<X: double, Y: double>>"
    columns = ["doc_id", "word_id", "text", "score", *"ltwh", "polygon"]
    words = snapped_words(objects).withColumn("polygon", F.lit(None).cast(shape)).select(*columns)
    words = words.unionByName(lists.withColumnRenamed("object_id", "word_id").select(*columns))
    kept = layout.keep_worded(layout.drop_slim(written(words, "page-words")))
    members = written(linking.phrase_members(layout.drop_duplicate_boxes(written(kept, "kept-words")), horizontal, vertical), "members")
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    phrases = members.groupBy("doc_id", "phrase_id").agg(
        F.min("l").alias("l"), F.min("t").alias("t"), (F.max(F.col("l") + F.col("w")) - F.min("l")).alias("w"), (F.max(F.col("t") + F.col("h")) - F.min("t")).alias("h"), spelled.alias("text"), F.count("*").alias("n_words")
    )
    return {"words": members.drop("row_id"), "phrases": phrases, "results": result_rows(members, members.select("doc_id", "word_id", F.lit(None).cast("int").alias("cluster")))}


def tables_of(files: DataFrame, root: str, **kw) -> dict[str, DataFrame]:
    """page_tables of files' rows of both formats, as `file_rows` reads them; root is where they were read from."""
    rows = written(files.select("objects", "imageSize", "DetectedText", "Geometry", page_of(root), F.monotonically_increasing_id().alias("at")), "files")
    objects = laid_out(rows.filter("objects is not null"))
    lists = listed(rows.filter("objects is null and Geometry is not null"), polygons=True)
    return page_tables(objects, lists, **kw)


def file_rows(reader, root: str) -> DataFrame:
    """Page files of both formats: a row for each file that holds `objects`, one for each word of a list. reader: of a session or a stream."""
    return reader.schema(f"{OBJECTS}, {WORDS}").option("multiLine", True).json(root).select("*", "_metadata")


def write_batch(files: DataFrame, k: int, root: str, target: str, **kw) -> None:
    """Write a batch's tables, each in a folder of its own, and then its row in `batches`. A batch that is run again overwrites its folders, so a
    run that broke off between two tables leaves nothing that readers see."""
    counts = []
    for name, table in tables_of(files, root, **kw).items():
        path = f"{target}/{name}/batch={k}"
        table.write.mode("overwrite").parquet(path)
        counts.append(files.sparkSession.read.schema(table.schema).parquet(path).count())
    files.sparkSession.createDataFrame([tuple(counts)], ", ".join(f"{n} long" for n in TABLES)).coalesce(1).write.mode("overwrite").parquet(f"{target}/batches/batch={k}")


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, **kw) -> None:
    """Take in all files that are new under path, and stop when none is left. A page is one file and so stands in one batch."""
    files = file_rows(spark.readStream, path)
    stream = files.writeStream.foreachBatch(lambda batch, k: write_batch(batch, k, path, target, **kw))
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_table(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A table of all batches that are whole, with the column `batch`."""
    whole = spark.read.parquet(f"{target}/batches").select("batch")
    return spark.read.parquet(f"{target}/{name}").join(F.broadcast(whole), "batch", "left_semi")
