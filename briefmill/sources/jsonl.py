"""JSON lines: scans that keep file and line order and skip what is no JSON, and sinks that keep nulls and all characters.

A line that is blank or no JSON is left out without a word; a path that does not exist raises. The order of records is a
column, the line's number in its file, and never that of tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from briefmill.runtime import small
from briefmill.sources import files


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_file, line_no, value) of text files, which are split as any other.

    A line's number is its place in its split, behind the lines of the file's splits before it; these are counted first.
    """
    own = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    splits = own.groupBy("source_file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_file").orderBy("block")) - F.col("n")
    starts = small(splits.select("source_file", "block", "first", before.alias("before")))
    return own.join(starts, ["source_file", "block"]).select("source_file", (F.col("at") - F.col("first") + F.col("before")).alias("line_no"), "value")


def strict_json(value: str) -> str | None:
    try:
        return json.dumps(json.loads(value), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """(source_file, line_no, record or the schema's columns) of the lines that are JSON.

    Without a schema the record stays JSON text, whatever kind of value it is; with one it is typed, absent fields null.
    """

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = pdf.value.map(lambda v: strict_json(v.strip()) if v and v.strip() else None)
            yield pdf.assign(record=made)[made.notna()][["source_file", "line_no", "record"]]

    out = lines(spark, path).mapInPandas(keep, "source_file string, line_no bigint, record string")
    if schema is None:
        return out
    return out.withColumn("r", F.from_json("record", schema)).select("source_file", "line_no", "r.*")


def public(record: Any) -> Any:
    """A record without the keys that begin with an underscore, at any depth."""
    if isinstance(record, dict):
        return {k: public(v) for k, v in record.items() if not str(k).startswith("_")}
    return [public(v) for v in record] if isinstance(record, list) else record


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, null fields kept, columns that begin with an underscore left out."""
    shown = df.select(*[c for c in df.columns if not c.startswith("_")])
    shown.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def read_document(path: str) -> object:
    """A single JSON document."""
    return json.loads(files.read_text(path))


def write_document(value: object, path: str) -> None:
    """A JSON document, two spaces of indent, characters as they are, private keys left out, anything else as text."""
    files.write_text(json.dumps(public(value), ensure_ascii=False, indent=2, default=str), path)


def read_settings(path: str) -> dict:
    """A YAML document; an empty one is an empty dict."""
    import yaml

    return yaml.safe_load(files.read_text(path)) or {}


def write_settings(value: dict, path: str) -> None:
    import yaml

    files.write_text(yaml.safe_dump(value, sort_keys=False, allow_unicode=True), path)
