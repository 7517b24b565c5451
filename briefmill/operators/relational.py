"""Dedup, resume, matching and alignment as joins and windows with an explicit order of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefmill.runtime import lookup_join, small


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``; null keys are a key of their own.

    Kept as an aggregate over structs, which is combined before the shuffle, so a key that a third of all rows hold costs
    one row for each input split.
    """
    return _extreme(df, keys, order, F.min)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order``."""
    return _extreme(df, keys, order, F.max)


def _extreme(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:  # noqa: ANN001
    by = F.max_by if pick is F.max else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns])
    made = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(by(row, F.struct(*order)).alias("__row"))
    return made.select("__row.*")


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` whose keys are not in ``done``; null keys count as empty text."""
    same = reduce(lambda a, b: a & b, [F.coalesce(todo[k].cast("string"), F.lit("")) == F.coalesce(F.col(f"__done.{k}").cast("string"), F.lit("")) for k in keys])
    return todo.join(done.select(*keys).distinct().alias("__done"), same, "left_anti")


def in_all(df: DataFrame, item: str, group: str, groups: int) -> DataFrame:
    """Items that occur in every one of ``groups`` groups: one shuffle however many groups there are."""
    pairs = df.filter(F.col(item).isNotNull()).select(item, group).distinct()
    return pairs.groupBy(item).agg(F.count("*").alias("__n")).filter(F.col("__n") == groups).select(item)


def pool(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Several sources in order, the first row of each key wins."""
    numbered = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return first_wins(both, [key], ["__source", order]).drop("__source")


def zipped(a: Column, b: Column) -> Column:
    """Pairs (a, b) by position, as many as the shorter has."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n >= 1, F.arrays_zip(F.slice(a, 1, F.greatest(n, F.lit(1))).alias("a"), F.slice(b, 1, F.greatest(n, F.lit(1))).alias("b"))).otherwise(F.arrays_zip(F.slice(a, 1, 0).alias("a"), F.slice(b, 1, 0).alias("b")))


def average_rank(value: str, within: list[str]) -> Column:
    """Ranks from 1 with ties averaged, within the columns ``within``."""
    ordered = Window.partitionBy(*within).orderBy(value)
    tied = Window.partitionBy(*within, value)
    return F.rank().over(ordered) + (F.count("*").over(tied) - 1) / F.lit(2.0)


def value_range(value: Column) -> Column:
    """A whole number that grows with the value: steps of a thousandth of its size, so ranges of values are many but bounded in number."""
    return (F.signum(value) * F.floor(F.log1p(F.least(F.abs(value), F.lit(1e300))) * 1024)).cast("bigint")


def with_below(counted: DataFrame, within: list[str], value: str, n: str, below: str = "below") -> DataFrame:
    """``counted`` (a row for each distinct value, ``n`` its rows) with the number of rows of smaller values in its group.

    Values are summed by range, ranges are numbered, and only values of one range are ever sorted together.
    """
    own = counted.withColumn("__range", value_range(F.col(value)))
    sums = own.groupBy(*within, "__range").agg(F.sum(n).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    starts = sums.select(*[F.col(c).alias(f"__{c}") for c in within], F.col("__range").alias("__r"), before.alias("__before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in within], F.col("__range") == F.col("__r"))
    inside = Window.partitionBy(*within, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = own.join(small(starts, 200_000), same).withColumn(below, F.col("__before") + F.sum(n).over(inside) - F.col(n))
    return out.select(*counted.columns, below)


def ranked(df: DataFrame, within: list[str], value: str, rank: str = "rank") -> DataFrame:
    """``df`` with ranks from 1, ties averaged, within large groups: values are counted and ranked by ranges, then looked up by the
    rows. Rows without a value or a group are left out."""
    own = df.dropna(subset=[*within, value])
    counted = own.groupBy(*within, value).agg(F.count("*").alias("__k"))
    placed = with_below(counted, within, value, "__k", "__below")
    return lookup_join(own, placed.select(*within, value, (F.col("__below") + (F.col("__k") + 1) / F.lit(2.0)).alias(rank)), [*within, value])


def pairs_of(df: DataFrame, item: str, group: str, value: str, order: dict[str, int]) -> DataFrame:
    """(a, b, item, x, y): each item's values in two groups, a before b in ``order``.

    Groups are few and given, so each item is one row of values, not a join of the table with itself.
    """
    names = sorted(order, key=order.__getitem__)
    wide = df.filter(F.col(group).isin(names)).groupBy(item).agg(*[F.max(F.when(F.col(group) == g, F.col(value))).alias(f"v{i}") for i, g in enumerate(names)])
    made = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"v{i}").cast("double").alias("x"), F.col(f"v{j}").cast("double").alias("y")) for i in range(len(names)) for j in range(i + 1, len(names))]
    out = wide.select(item, F.explode(F.array(*made)).alias("p")).select("p.a", "p.b", item, "p.x", "p.y")
    return out.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
