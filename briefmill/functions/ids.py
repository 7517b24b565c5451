"""Identities: hash splits, content ids, configuration hashes."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPLITS = ((8000, "train"), (9000, "val"))


def split_bucket(key: Column) -> Column:
    """The key's md5 as a whole number modulo 10,000, from its two halves (2**64 mod 10,000 is 1,616)."""
    digest = F.md5(key)
    half = lambda start: F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)") % 10_000
    return ((half(1) * 1616 + half(17)) % 10_000).cast("int")


def split_of(key: Column) -> Column:
    """train, val or test by the key alone, so growth moves no key; null for a null key."""
    bucket = split_bucket(key)
    return F.when(bucket < SPLITS[0][0], "train").when(bucket < SPLITS[1][0], "val").when(bucket.isNotNull(), "test")


def chunk_id(source: Column, content: Column) -> Column:
    return F.concat(source, F.lit("_"), F.substring(F.md5(content), 1, 8))


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


@F.pandas_udf(StringType())
def content_id(texts: pd.Series) -> pd.Series:
    """item_ and 8 hex digits of the md5 of a JSON text in canonical form (keys sorted, nulls kept); null for no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else "item_" + hashlib.md5(canonical(json.loads(text)).encode()).hexdigest()[:8]
        except ValueError:
            return None

    return texts.map(one)


def config_hash(config: dict[str, Any]) -> str:
    """12 hex digits of the sha256 of a configuration, without a hash that it may already hold."""
    plain = {k: v for k, v in config.items() if k != "config_hash"}
    return hashlib.sha256(canonical(plain).encode()).hexdigest()[:12]
