"""Markdown guidelines cut at their headings into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefmill.functions.ids import chunk_id
from briefmill.functions.text import NEWLINES, token_count

#: Chunks of no more words than this are left out.
FEW_WORDS = 5


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text) of the files *.md in a folder, source being the name without its ending."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return files.select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.md$", "").alias("source"), F.col("value").alias("text"))


def chunks(documents: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(id, source, heading, text, ord): a chunk from each heading line to the next, and what stands before the first.

    Lines are counted into islands within each document, so documents spread over tasks; one document is one window.
    """
    line = documents.select(F.col(source).alias("source"), F.posexplode(F.split(text, NEWLINES)).alias("pos", "line"))
    head = F.col("line").rlike(r"^\s*#")
    in_order = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = line.withColumn("ord", F.sum(F.when(head, 1).otherwise(0)).over(in_order)).groupBy("source", "ord")
    made = parts.agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    first = F.col("lines")[0]["line"]
    is_head = first.rlike(r"^\s*#")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    title = F.when(is_head, strip(first)).otherwise("")
    body = strip(F.array_join(F.transform(F.when(is_head, F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(F.col("lines")), lambda x: x["line"]), "\n"))
    content = strip(F.concat(title, F.lit("\n"), body))
    out = made.select("source", "ord", strip(F.regexp_replace(title, "^[# ]+", "")).alias("heading"), content.alias("text"))
    out = out.filter((F.col("text") != "") & (token_count(F.col("text")) > FEW_WORDS))
    return out.select(chunk_id(F.col("source"), F.col("text")).alias("id"), "source", "heading", "text", "ord")
