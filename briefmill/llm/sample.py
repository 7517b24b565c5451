"""A reproducible sample by key that stays stable as data grows.

A key belongs for good to one of many fine buckets: md5 of seed and key. The buckets have a fixed permutation
(multiplication by an odd constant modulo a power of two), and the sample holds the keys of the first so many buckets of
it. A larger fraction appends buckets to that list and takes none away, so samples are nested; a key's place depends on
nothing but the seed and the key, so neither reruns, partitionings nor later rows move it.

Defined cases: all rows of a drawn key are kept, however often they were sent; rows without a key (null) are never
drawn; fraction 0 draws nothing, fraction 1 all keys; equal rows stay apart; an empty table gives an empty sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.runtime import hash_bucket

#: Fine buckets; a power of two.
BUCKETS = 65_536
#: Odd, so that it permutes the buckets.
STEP = 40_503


def place(key: Column, seed: int) -> Column:
    """The place of the key's bucket in the permutation, 0 .. BUCKETS-1; null without a key."""
    return (hash_bucket(key.cast("string"), seed, BUCKETS) * F.lit(STEP)) % BUCKETS


def chosen(fraction: float) -> int:
    """How many buckets of the list a fraction takes."""
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction is between 0 and 1")
    return round(fraction * BUCKETS)


def stable_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """All rows of the drawn keys. A filter on the scan: nothing is shuffled, nothing counted beforehand."""
    return df.filter(place(F.col(key), seed) < chosen(fraction))


def fraction_for(df: DataFrame, key: str, keys: int, already: float = 0.0, seed: int = 42) -> float:
    """The least fraction, at least ``already``, whose sample holds ``keys`` distinct keys or more (1.0 if there are fewer).

    Counts keys for each bucket, which are fixed in number; with ``already`` the list of an earlier sample is only appended to.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(place(F.col(key), seed).alias("place"), key).agg(F.lit(1)).groupBy("place").count()
    total, at = 0, BUCKETS
    for row in counts.orderBy("place").toLocalIterator():
        total += row["count"]
        if total >= keys:
            at = row["place"] + 1
            break
    return max(already, at / BUCKETS)
