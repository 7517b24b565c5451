"""Percentiles of very large columns from mergeable quantile digests with a deterministic error bound.

Values are quantized to 2**LEVELS leaves, even on a logarithmic scale that ends with the largest finite number, so none is out of
range, and counted for each group and piece (map-side, so a hot group is no more than a count for each leaf). A digest keeps counts
on the nodes of the dyadic tree over the leaves. It is compressed from the root down: a node takes up the counts of all nodes
below it if these, and what its own ancestors hold, are together at most ``error`` * n; it is then moved down to the smallest node
that covers what it took. Digests of pieces are merged by adding the counts of equal nodes and compressing again.

Bounds, for n values of a group however they were cut into pieces: a count on an inner node may belong to any leaf below it, so
the rank of the value given for q is off by at most what the inner nodes above one leaf hold. Compression keeps that at most
``error`` * n, adding nodes keeps it (the bounds of pieces add up to ``error`` times their sizes), and compressing again does too, as it
counts ancestors. The value itself is off by at most ``VALUE_ERROR`` of it (``UNIT`` if that is more) from quantization. The
nodes of one compressed piece that are no parent of another number at most 2 * LEVELS / error + 1, usually about 2 / error.

Defined cases: null, NaN, infinite and negative values are no durations and are counted apart; 0 is one; null group keys
are a group; a group without any valid value has a row with n 0 and null percentiles; ties count as often as they occur;
an empty table gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 20
LEAVES = 1 << LEVELS
#: Smallest step of the scale, which ends with the largest finite number.
UNIT = 0.001
SCALE = (LEAVES - 1) / (math.log(sys.float_info.max) - math.log(UNIT))
VALUE_ERROR = math.expm1(1 / SCALE)


def leaf(value: Column) -> Column:
    """The leaf of a valid value."""
    place = (F.log(value + UNIT) - F.log(F.lit(UNIT))) * SCALE
    return F.greatest(F.lit(0), F.least(F.lit(LEAVES - 1), F.floor(place))).cast("int")


def valid(value: Column) -> Column:
    """False for null, NaN, infinite and negative values."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf")), F.lit(False))


def value_of(leaves: np.ndarray) -> np.ndarray:
    """The middle of each leaf on the logarithmic scale."""
    return np.exp((leaves + 0.5) / SCALE + math.log(UNIT)) - UNIT


def spans(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The depth of each node (root 1, children 2 i and 2 i + 1) and the first leaf below it."""
    depth = np.frexp(nodes.astype(np.float64))[1].astype(np.int64) - 1
    return depth, (nodes << (LEVELS - depth)) - LEAVES


def compressed(nodes: np.ndarray, counts: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes and counts of the compressed digest. Only nodes with counts are looked at, a few numpy steps for each level."""
    nodes, counts = nodes.astype(np.int64), counts.astype(np.int64)
    most = error * counts.sum()
    depth, first = spans(nodes)
    order = np.lexsort((depth, first))  # a node before those below it
    nodes, counts, depth, first = nodes[order], counts[order], depth[order], first[order]
    above = np.zeros(len(nodes))  # what the ancestors of each node hold
    into = np.full(len(nodes), -1)  # the run of nodes that each is taken up with
    for level in range(LEVELS):
        at = np.where(depth >= level, (first + LEAVES) >> (LEVELS - level), -1)
        rest = (into < 0) & (at >= 0)
        if not rest.any():
            continue
        place = np.flatnonzero(rest)
        starts = np.flatnonzero(np.concatenate([[True], at[place][1:] != at[place][:-1]]))
        size = np.diff(np.append(starts, len(place)))
        held = np.add.reduceat(counts[place], starts)
        take = (size > 1) & (above[place[starts]] + held <= most)
        into[place[np.repeat(take, size)]] = np.repeat(place[starts[take]], size[take])
        # A node that stays is an ancestor of those below it.
        own = depth[place[starts]] == level
        above[place] += np.repeat(np.where(own & ~take, counts[place[starts]], 0), size)
    kept = into < 0
    runs = np.flatnonzero(~kept)
    if len(runs):
        starts = runs[np.concatenate([[True], into[runs][1:] != into[runs][:-1]])]
        bounds = np.searchsorted(into[runs], into[starts], "left")
        last = first + (1 << (LEVELS - depth)) - 1
        low, high = np.minimum.reduceat(first[runs], bounds) + LEAVES, np.maximum.reduceat(last[runs], bounds) + LEAVES
        shift = np.frexp((low ^ high).astype(np.float64))[1]  # levels up to the smallest node over both
        nodes = np.concatenate([nodes[kept], low >> shift])
        counts = np.concatenate([counts[kept], np.add.reduceat(counts[runs], bounds)])
    order = np.argsort(nodes)
    nodes, counts = nodes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]])) if len(nodes) else np.zeros(0, int)
    return (nodes[starts], np.add.reduceat(counts, starts)) if len(nodes) else (nodes, counts)


def rank_error(nodes: np.ndarray, counts: np.ndarray) -> int:
    """The most that inner nodes above one leaf hold: a bound on the error of any rank, in values."""
    depth, first = spans(nodes.astype(np.int64))
    inner = depth < LEVELS
    if not inner.any():
        return 0
    begin, end = first[inner], first[inner] + (1 << (LEVELS - depth[inner]))
    at = np.concatenate([begin, end])
    change = np.concatenate([counts[inner], -counts[inner]])
    order = np.lexsort((change, at))
    return int(np.cumsum(change[order]).max())


def quantiles(nodes: np.ndarray, counts: np.ndarray, qs: list[float]) -> list[float]:
    """Values for ``qs`` of a digest that isn't empty."""
    depth, first = spans(nodes.astype(np.int64))
    last = first + (1 << (LEVELS - depth)) - 1
    order = np.lexsort((-depth, last))
    run = np.cumsum(counts[order])
    at = np.searchsorted(run, np.maximum(1, np.ceil(np.array(qs) * run[-1])))
    return value_of(last[order][np.minimum(at, len(run) - 1)]).tolist()


def kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def digests(df: DataFrame, value: str, groups: list[str], piece: Column, error: float = 0.005) -> DataFrame:
    """A digest for each group and piece: (groups, piece, node, n). Node 0 counts nulls, node -1 values that are no durations."""
    v = F.col(value)
    node = F.when(valid(v), leaf(v) + LEAVES).when(v.isNull(), 0).otherwise(-1)
    counts = df.select(*groups, piece.alias("piece"), node.alias("node")).groupBy(*groups, "piece", "node").agg(F.count("*").alias("n"))
    return compress(counts, [*groups, "piece"], error)


def compress(counts: DataFrame, keys: list[str], error: float) -> DataFrame:
    """Node counts (keys, node, n), compressed for each key. At most 2**(LEVELS+1) rows come together in one group.

    A digest in which no two values may be taken together, being fewer than 2 / error, stays in the JVM.
    """
    total = F.sum(F.when(F.col("node") >= 1, F.col("n"))).over(Window.partitionBy(*keys))
    sized = counts.withColumn("__large", F.coalesce(total * error >= 2, F.lit(False)))
    columns = [*keys, "node", "n"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        aside = pdf[pdf.node < 1]
        own = pdf[pdf.node >= 1]
        nodes, n = compressed(own.node.to_numpy(), own.n.to_numpy(), error)
        made = pd.DataFrame({"node": np.concatenate([aside.node, nodes]), "n": np.concatenate([aside.n, n])})
        for k in keys:
            made[k] = pdf[k].iloc[0]
        return made[columns]

    large = sized.filter("__large").select(*columns).groupBy(*keys).applyInPandas(run, f"{kinds(counts, keys)}, node int, n bigint")
    return sized.filter("NOT __large").select(*columns).unionByName(large)


def merged(parts: DataFrame, groups: list[str], error: float = 0.005) -> DataFrame:
    """The digests of all pieces of a group put together: (groups, node, n)."""
    return compress(parts.groupBy(*groups, "node").agg(F.sum("n").alias("n")), groups, error)


def percentiles(digest: DataFrame, groups: list[str], qs: list[float]) -> DataFrame:
    """A row for each group: n, n_null, n_invalid, max_rank_error (in values, as the digest shows it) and p50, p95 and so on for ``qs``."""
    names = [f"p{100 * q:g}".replace(".", "_") for q in qs]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.node >= 1]
        n = int(own.n.sum())
        row = {g: pdf[g].iloc[0] for g in groups}
        row |= {"n": n, "n_null": int(pdf.n[pdf.node == 0].sum()), "n_invalid": int(pdf.n[pdf.node == -1].sum()), "max_rank_error": float(rank_error(own.node.to_numpy(), own.n.to_numpy()))}
        row |= dict(zip(names, quantiles(own.node.to_numpy(), own.n.to_numpy(), qs) if n else [None] * len(qs), strict=True))
        return pd.DataFrame([row])

    schema = f"{kinds(digest, groups)}, n bigint, n_null bigint, n_invalid bigint, max_rank_error double, " + ", ".join(f"{x} double" for x in names)
    return digest.groupBy(*groups).applyInPandas(run, schema)
