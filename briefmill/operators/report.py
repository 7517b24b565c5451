"""Run reports: flattened metrics, pooled seeds, tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flattened(value: Any, prefix: str = "") -> Iterator[tuple[str, Any]]:
    """(dotted key, leaf) of nested objects; anything that is no object is a leaf."""
    for k, v in value.items():
        name = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict):
            yield from flattened(v, name)
        else:
            yield name, v


def key_values(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, name, value): the leaves of each row's JSON object; text that is no object gives no rows."""
    kind = dict(df.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for k, text in zip(pdf.k, pdf.d, strict=True):
                try:
                    made = json.loads(text) if text is not None else None
                except (ValueError, TypeError):
                    made = None
                if isinstance(made, dict):
                    rows += [(k, name, v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for name, v in flattened(made)]
            yield pd.DataFrame(rows, columns=["k", "name", "value"])

    return df.select(F.col(key).alias("k"), F.col(document).alias("d")).mapInPandas(run, f"k {kind}, name string, value string").withColumnRenamed("k", key)


def pooled(long: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """Mean, sample deviation and count over runs; values that are no numbers don't count, rows without a group neither."""
    own = long.withColumn("__x", F.col(value).try_cast("double"))
    for c in by:
        own = own.filter(F.col(c).isNotNull())
    own = own.withColumn("__x", F.when(~F.isnan("__x"), F.col("__x")))
    return own.groupBy(*by, name).agg(F.avg("__x").alias("mean"), F.stddev_samp("__x").alias("std"), F.count("__x").alias("count"))


def select_metric(names: list[str], needle: str) -> str | None:
    """The column that a report shows for ``needle``: the one that ends with it as a whole part, else the first that contains it."""
    whole = [n for n in names if n == needle or n.endswith(f".{needle}")]
    return whole[0] if whole else next((n for n in names if needle in n), None)


def as_number(value: Any) -> Any:
    """The number that a text holds, else the value itself."""
    try:
        return float(value)
    except (TypeError, ValueError):
        return value


def number(value: Any) -> str:
    """Three decimals without trailing zeros, nothing for None or NaN."""
    if value is None or value != value:
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return f"{value:.3f}".rstrip("0").rstrip(".")


def markdown_table(rows: list[dict[str, Any]], columns: list[str]) -> str:
    """A pipe table of a small report."""
    out = ["| " + " | ".join(columns) + " |", "|" + "|".join("---" for _ in columns) + "|"]
    return "\n".join(out + ["| " + " | ".join(number(r.get(c)) for c in columns) + " |" for r in rows])


def differences(long: DataFrame, by: list[str], side: str, base: str, other: str, value: str) -> DataFrame:
    """other less base for each group; null if either is missing."""
    pick = lambda which: F.max(F.when(F.col(side) == which, F.col(value)))
    out = long.filter(F.col(side).isin(base, other)).groupBy(*by).agg(pick(base).alias("base"), pick(other).alias("other"))
    return out.withColumn("delta", F.col("other") - F.col("base"))
