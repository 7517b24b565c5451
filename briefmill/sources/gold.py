"""Gold items, ratings, runs and other collections of files, as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.functions import ids
from briefmill.functions.jsonout import PARTIAL, obeys
from briefmill.operators.relational import pool
from briefmill.operators.report import key_values
from briefmill.sources import files
from briefmill.sources.jsonl import read_jsonl

RATING = "rater_id string, unit_id string, item_id string, method string, scores map<string,int>, comment string, timestamp string"
GOLD = "item_id string, split string, brief string, recommendation string"


def gold_items(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """(source_file, line_no, item_id, split, brief, recommendation) with missing ids and splits filled in.

    brief and recommendation stay JSON text. With ``strict`` a recommendation that breaks the contract raises when it is read.
    """

    def fields(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for name, line, text in zip(pdf.source_file, pdf.line_no, pdf.record, strict=True):
                made = json.loads(text)
                if not isinstance(made, dict):
                    if strict:
                        raise ValueError(f"{name}, line {line}: no object")
                    continue
                wanted = made.get("recommendation", {})
                if strict and not obeys(wanted, PARTIAL):
                    raise ValueError(f"{name}, line {line}: the recommendation breaks the output contract")
                rows.append((name, line, made.get("item_id") or (made.get("brief") or {}).get("item_id") or None, made.get("split"), json.dumps(made.get("brief", {}), ensure_ascii=False), json.dumps(wanted, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["source_file", "line_no", "item_id", "split", "brief", "recommendation"])

    out = read_jsonl(spark, path).mapInPandas(fields, f"source_file string, line_no bigint, {GOLD}")
    out = out.withColumn("item_id", F.coalesce("item_id", ids.content_id("brief")))
    return out.withColumn("split", F.coalesce("split", ids.split_of(F.col("item_id"))))


def existing(paths: list[str]) -> list[str]:
    return [p for p in paths if files.exists(p)]


def gold_pool(spark: SparkSession, paths: list[str], strict: bool = True) -> DataFrame:
    """Several files in order, those that do not exist skipped, the first row of each item_id kept."""
    there = existing(paths)
    if not there:
        return spark.createDataFrame([], f"source_file string, line_no bigint, {GOLD}")
    return pool([gold_items(spark, p, strict) for p in there], "item_id", "line_no")


def gold_or_legacy(spark: SparkSession, folder: str, legacy: list[str]) -> DataFrame:
    """``gold.jsonl`` of a folder if it is there, else the pool of the legacy files."""
    first = f"{folder}/gold.jsonl"
    return gold_pool(spark, [first] if files.exists(first) else [f"{folder}/{x}" for x in legacy])


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """All ratings of a folder, in order of files and lines; none if it does not exist."""
    found = files.matching(f"{folder}/*.jsonl")
    return read_jsonl(spark, found, RATING) if found else spark.createDataFrame([], f"source_file string, line_no bigint, {RATING}")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, name, value) of every run folder's metrics, with its configuration's leaves where the metrics don't name them."""
    done = files.matching(f"{root}/*/metrics_auto.json")
    if not done:
        return spark.createDataFrame([], "run string, name string, value string")
    path = F.split(F.col("_metadata.file_path"), "/")
    texts = spark.read.text([*done, *files.matching(f"{root}/*/config.json")], wholetext=True)
    named = texts.select(F.struct(F.element_at(path, -2).alias("run"), (F.element_at(path, -1) == "metrics_auto.json").alias("measured")).alias("of"), "value")
    leaves = key_values(named, "of", "value").select("of.*", "name", "value")
    own = leaves.groupBy("run", "name").agg(F.max_by("value", "measured").alias("value"), F.max("measured").alias("any"))
    finished = leaves.filter("measured").select("run").distinct()
    return own.join(finished, "run", "left_semi").select("run", "name", "value")


def aligned(original: DataFrame, perturbed: DataFrame, order: str) -> DataFrame:
    """Rows of a perturbed file keyed by those of the original at the same place, by their content where that has none."""
    keys = original.select(F.col(order).alias("__at"), F.col("item_id").alias("__id"))
    out = perturbed.join(keys, perturbed[order] == keys["__at"], "left")
    return out.withColumn("item_id", F.coalesce("__id", ids.content_id("brief"))).drop("__at", "__id")


def eval_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(items, assignment) of a human evaluation that was built in a folder; raises if either is missing."""
    return spark.read.parquet(f"{folder}/items"), spark.read.parquet(f"{folder}/assignment")
