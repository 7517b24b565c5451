"""Statistics of paired designs: sufficient statistics are aggregated in the JVM, tails of distributions come from small functions.

Inputs are long: (item, method, value). Methods are few and given in the order that fixes the sign of differences.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from briefmill.functions.text import cliff_magnitude
from briefmill.operators.relational import average_rank, with_below

PAIR = ["a", "b"]


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) of the chi-squared distribution with whole degrees of freedom: a finite sum, and erfc if they are odd."""
    if x <= 0 or df < 1:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return min(1.0, math.exp(-half) * total)
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) * 2 / math.sqrt(math.pi)
    for i in range(df // 2):
        total += term
        term *= half / (i + 1.5)
    return min(1.0, total)


def binomial_two_sided(low: int, n: int) -> float:
    """min(1, 2 P(X <= low)) with p = 1/2; exact in whole numbers up to 1,000, by logarithms beyond."""
    if n == 0:
        return 1.0
    if n <= 1000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(low + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(x - top) for x in logs))


def signed_rank_p(w: float, n: int, ties: float, exact_to: int = 50) -> float:
    """Two-sided p of the signed-rank statistic: exact without ties up to ``exact_to``, else normal with tie correction."""
    if n == 0:
        return 1.0
    if n <= exact_to and ties == 0 and float(w).is_integer():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for i in range(1, n + 1):
            ways[i:] += ways[:-i].copy()
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w - mean) / math.sqrt(2 * var)) if var > 0 else 1.0


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(float(a), int(b)) if pd.notna(a) else None for a, b in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided(int(min(x, y)), int(x + y)) for x, y in zip(b, c, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def wilcoxon_p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(float(a), int(b), float(c)) for a, b, c in zip(w, n, ties, strict=True)], dtype="float64")


def holm(df: DataFrame, p: str, order: list[str], within: list[str], alpha: float = 0.05) -> DataFrame:
    """``df`` with p_holm and reject_h0; comparisons are few, one row each."""
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    by_p = group.orderBy(p, *order)
    step = (F.count("*").over(group) - F.row_number().over(by_p) + 1) * F.col(p)
    out = df.withColumn("__step", step)
    out = out.withColumn("p_holm", F.least(F.lit(1.0), F.max("__step").over(by_p.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return out.drop("__step").withColumn("reject_h0", F.col("p_holm") < alpha)


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """(a, b, n, w_plus, w_minus, ties) of pairs (a, b, item, x, y): differences of 0 dropped, ranks averaged.

    Sizes of differences are counted before they are ranked, and ranked by ranges, so no task sorts the sizes of a whole pair.
    """
    own = pairs.withColumn("d", F.round(F.col("x") - F.col("y"), 12)).filter("d <> 0")
    sizes = own.groupBy(*PAIR, F.abs("d").alias("size")).agg(F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("plus"), F.count("*").alias("k"))
    ranked = with_below(sizes, PAIR, "size", "k").withColumn("rank", F.col("below") + (F.col("k") + 1) / F.lit(2.0))
    return ranked.groupBy(*PAIR).agg(
        F.sum("k").alias("n"),
        F.sum(F.col("rank") * F.col("plus")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("k") - F.col("plus"))).alias("w_minus"),
        F.sum(F.pow("k", F.lit(3)) - F.col("k")).alias("ties"),
    )


def effects(pairs: DataFrame) -> DataFrame:
    """(a, b, n_pairs, rank_biserial, cohen_dz); 0 where all pairs are tied or the deviation is 0."""
    d = pairs.withColumn("d", F.round(F.col("x") - F.col("y"), 12)).groupBy(*PAIR).agg(F.count("*").alias("n_pairs"), F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"))
    ranks = signed_ranks(pairs)
    out = d.join(ranks, PAIR, "left")
    biserial = (F.col("w_plus") - F.col("w_minus")) / F.nullif(F.col("w_plus") + F.col("w_minus"), F.lit(0.0))
    return out.select(*PAIR, "n_pairs", F.round(F.coalesce(biserial, F.lit(0.0)), 4).alias("rank_biserial"), F.round(F.coalesce(F.col("m") / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(0.0)), 4).alias("cohen_dz"))


def wilcoxon(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(a, b, n, statistic, p_value, p_holm, reject_h0); without a difference the statistic is 0 and p is 1."""
    every = pairs.select(*PAIR).distinct()
    ranks = every.join(signed_ranks(pairs), PAIR, "left").fillna(0, ["n", "w_plus", "w_minus", "ties"])
    out = ranks.withColumn("statistic", F.least("w_plus", "w_minus"))
    out = out.withColumn("p_value", wilcoxon_p("statistic", "n", "ties"))
    return holm(out.select(*PAIR, "n", "statistic", "p_value"), "p_value", PAIR, [], alpha)


def mcnemar(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(a, b, n_b, n_c, p_value, p_holm, reject_h0) of 0/1 outcomes."""
    counts = pairs.groupBy(*PAIR).agg(F.sum(F.when((F.col("x") == 1) & (F.col("y") == 0), 1).otherwise(0)).alias("n_b"), F.sum(F.when((F.col("x") == 0) & (F.col("y") == 1), 1).otherwise(0)).alias("n_c"))
    return holm(counts.withColumn("p_value", mcnemar_p("n_b", "n_c")), "p_value", PAIR, [], alpha)


def complete(df: DataFrame, item: str, method: str, value: str, methods: list[str]) -> DataFrame:
    """Rows of the items that have a value of every method."""
    full = df.filter(F.col(value).isNotNull() & F.col(method).isin(methods)).groupBy(item).agg(F.collect_list(F.struct(F.col(method).alias("method"), F.col(value).cast("double").alias("value"))).alias("r"), F.countDistinct(method).alias("k"))
    return full.filter(F.col("k") == len(methods)).select(item, F.explode("r").alias("r")).select(item, "r.method", "r.value")


def cochran_q(outcomes: DataFrame, item: str, methods: list[str]) -> DataFrame:
    """One row (applicable, q, df, p_value, n) of (item, method, value) with 0/1 values of complete items."""
    k = len(methods)
    rows = outcomes.groupBy(item).agg(F.sum("value").alias("r")).agg(F.sum("r").alias("total"), F.sum(F.col("r") * F.col("r")).alias("squares"), F.count("*").alias("n"))
    columns = outcomes.groupBy("method").agg(F.sum("value").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("c2"))
    both = rows.crossJoin(columns)
    below = k * F.col("total") - F.col("squares")
    q = F.when(below == 0, 0.0).otherwise((k - 1) * (k * F.col("c2") - F.col("total") * F.col("total")) / below)
    out = both.select(F.lit(k >= 3).alias("applicable"), F.when(F.lit(k >= 3), q).alias("q"), F.lit(k - 1).alias("df"), "n")
    return out.withColumn("p_value", F.when(F.col("q").isNotNull(), chi2_p("q", "df")))


def friedman(scores: DataFrame, item: str, methods: list[str]) -> DataFrame:
    """One row (applicable, chi2, df, p_value, n), ranks averaged within an item and corrected for ties."""
    k = len(methods)
    ranked = scores.withColumn("rank", average_rank("value", [item]))
    tied = ranked.groupBy(item, "value").agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = ranked.groupBy("method").agg(F.sum("rank").alias("r"), F.count("*").alias("n")).agg(F.sum(F.col("r") * F.col("r")).alias("r2"), F.max("n").alias("n"))
    both = sums.crossJoin(tied)
    n = F.col("n")
    raw = F.lit(12.0) / (n * k * (k + 1)) * F.col("r2") - 3.0 * n * (k + 1)
    correction = 1 - F.col("ties") / (n * F.lit(float(k * (k * k - 1))))
    chi2 = F.when(correction > 0, raw / correction).otherwise(0.0)
    out = both.select(F.lit(k >= 3).alias("applicable"), F.when(F.lit(k >= 3), chi2).alias("chi2"), F.lit(k - 1).alias("df"), "n")
    return out.withColumn("p_value", F.when(F.col("chi2").isNotNull(), chi2_p("chi2", "df")))


def cliffs_delta(pairs: DataFrame) -> DataFrame:
    """(a, b, delta, magnitude) of two independent samples, from ranks: no value is compared with another.

    Values are counted first, and ranked by ranges, so no task sorts the values of a whole pair.
    """
    long = pairs.select(*PAIR, F.explode(F.array(F.struct(F.lit(1).alias("of_a"), F.col("x").alias("v")), F.struct(F.lit(0).alias("of_a"), F.col("y").alias("v")))).alias("s")).select(*PAIR, "s.of_a", "s.v")
    counted = long.filter(F.col("v").isNotNull()).groupBy(*PAIR, "v").agg(F.sum("of_a").alias("k_a"), F.count("*").alias("k"))
    sums = with_below(counted, PAIR, "v", "k").withColumn("rank", F.col("below") + (F.col("k") + 1) / F.lit(2.0)).groupBy(*PAIR).agg(F.sum(F.col("rank") * F.col("k_a")).alias("r"), F.sum("k_a").alias("n_a"), F.sum(F.col("k") - F.col("k_a")).alias("n_b"))
    u = F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / F.lit(2.0)
    delta = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), 0.0).otherwise(2.0 * u / (F.col("n_a") * F.col("n_b")) - 1)
    return sums.select(*PAIR, F.round(delta, 4).alias("delta"), cliff_magnitude(delta).alias("magnitude"))


def bootstrap_ci(values: np.ndarray, statistic: Callable[[np.ndarray], np.ndarray] | None = None, n_boot: int = 10_000, ci: float = 0.95, seed: int = 42) -> tuple[float | None, float | None, float | None]:
    """(point, low, high) by percentiles of resampled statistics; ``statistic`` works along the last axis, mean by default."""
    x = np.asarray(values, float)
    if x.size == 0:
        return None, None, None
    f = statistic or (lambda a: a.mean(axis=-1))
    rng = np.random.default_rng(seed)
    rows = max(1, min(n_boot, 4_000_000 // x.size))
    made = []
    for at in range(0, n_boot, rows):
        made.append(f(x[rng.integers(0, x.size, (min(rows, n_boot - at), x.size))]))
    low, high = np.percentile(np.concatenate(made), [50 * (1 - ci), 50 * (1 + ci)])
    return float(f(x)), float(low), float(high)


#: Blocks of items that a bootstrap over a DataFrame resamples.
BLOCKS = 8192


def bootstrap_means(df: DataFrame, by: list[str], item: str, value: str, n_boot: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """(by, n, point, ci_low, ci_high): intervals of means for groups of any size, from ``n_boot`` resamples.

    Items are dealt by hash into BLOCKS blocks and summed there, combined before the shuffle. A resample takes each block
    as often as a Poisson draw says, which block and seed fix. Up to some thousands of items nearly every block is one item;
    beyond, blocks are random groups of equal expected size, whose resampled means vary as those of items do.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    block = F.pmod(F.xxhash64(F.lit(seed), item), F.lit(BLOCKS)).cast("int").alias("block")
    slim = df.filter(F.col(value).isNotNull()).select(*by, block, F.col(value).cast("double").alias("v"))
    blocks = slim.groupBy(*by, "block").agg(F.sum("v").alias("s"), F.count("*").alias("n"))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        s, n = pdf.s.to_numpy(float), pdf.n.to_numpy(float)
        sums, sizes = np.zeros(n_boot), np.zeros(n_boot)
        for at in range(0, len(pdf), 256):
            times = np.stack([np.random.default_rng([seed, int(b)]).poisson(1.0, n_boot) for b in pdf.block.iloc[at : at + 256]])
            sums += times.T @ s[at : at + 256]
            sizes += times.T @ n[at : at + 256]
        low, high = np.percentile(sums[sizes > 0] / sizes[sizes > 0], [50 * (1 - ci), 50 * (1 + ci)])
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "n": int(n.sum()), "point": s.sum() / n.sum(), "ci_low": low, "ci_high": high}])

    return blocks.groupBy(*by).applyInPandas(finish, f"{kinds}, n bigint, point double, ci_low double, ci_high double")


def bootstrap_difference(pairs: DataFrame, item: str, n_boot: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """(a, b, n, point, ci_low, ci_high) of the mean difference of pairs."""
    return bootstrap_means(pairs.withColumn("d", F.col("x") - F.col("y")), PAIR, item, "d", n_boot, ci, seed)


def krippendorff(ratings: DataFrame, by: list[str], unit: str, value: str, level: str = "ordinal") -> DataFrame:
    """(by, alpha, n_units, n_values): nominal, ordinal or interval, from counts of each value in each unit.

    Pairs within a unit are products of counts, so a unit costs a row for each distinct value however many raters it has.
    """
    counts = ratings.filter(F.col(value).isNotNull()).groupBy(*by, unit, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("k"))
    # Distinct values of a rating scale are few; a unit's counts are one array.
    packed = counts.groupBy(*by, unit).agg(F.collect_list(F.struct("v", "k")).alias("c"), F.sum("k").alias("m")).filter("m >= 2")
    one = packed.select(*by, "m", F.explode("c").alias("x"), "c")
    cells = one.select(*by, F.col("x.v").alias("c"), F.explode("c").alias("y"), F.col("x.k").alias("kx"), "m")
    pair = F.when(F.col("c") == F.col("y.v"), F.col("kx") * (F.col("kx") - 1)).otherwise(F.col("kx") * F.col("y.k")) / (F.col("m") - 1)
    o = cells.select(*by, "c", F.col("y.v").alias("k"), pair.alias("o")).groupBy(*by, "c", "k").agg(F.sum("o").alias("o"))
    keys = by or ["__all"]
    if not by:
        o, packed = o.withColumn("__all", F.lit(0)), packed.withColumn("__all", F.lit(0))
    margin = o.groupBy(*keys, "c").agg(F.sum("o").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy(*keys).orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    margin = margin.withColumn("cum", so_far)
    lo, hi = margin.alias("lo"), margin.alias("hi")
    same = [F.col(f"lo.{k}").eqNullSafe(F.col(f"hi.{k}")) for k in keys]
    grid = lo.join(hi, same, "inner").select(*[F.col(f"lo.{k}").alias(k) for k in keys], F.col("lo.c").alias("c"), F.col("hi.c").alias("k"), F.col("lo.n").alias("nc"), F.col("hi.n").alias("nk"), F.col("lo.cum").alias("cum_c"), F.col("hi.cum").alias("cum_k"))
    if level == "nominal":
        distance = F.when(F.col("c") == F.col("k"), 0.0).otherwise(1.0)
    elif level == "interval":
        distance = F.pow(F.col("c") - F.col("k"), F.lit(2))
    else:
        first = F.when(F.col("c") <= F.col("k"), F.col("cum_c") - F.col("nc")).otherwise(F.col("cum_k") - F.col("nk"))
        last = F.greatest("cum_c", "cum_k")
        distance = F.when(F.col("c") == F.col("k"), 0.0).otherwise(F.pow(last - first - (F.col("nc") + F.col("nk")) / 2, F.lit(2)))
    grid = grid.withColumn("d", distance)
    seen = [grid[k].eqNullSafe(o[k]) for k in keys] + [grid["c"] == o["c"], grid["k"] == o["k"]]
    joined = grid.join(o, seen, "left").select(*[grid[k] for k in keys], grid["c"], grid["k"], "nc", "nk", "d", F.coalesce("o", F.lit(0.0)).alias("o"))
    sums = joined.groupBy(*keys).agg(F.sum(F.col("o") * F.col("d")).alias("do"), F.sum(F.col("nc") * F.col("nk") * F.col("d")).alias("de"), F.sum("o").alias("n"), F.countDistinct("c").alias("n_values"))
    units = packed.groupBy(*keys).agg(F.count("*").alias("n_units"))
    out = sums.join(units, keys)
    alpha = F.when((F.col("n_values") < 2) | (F.col("de") == 0), 1.0).otherwise(F.round(1 - (F.col("do") / F.col("n")) / (F.col("de") / (F.col("n") * (F.col("n") - 1))), 4))
    return out.select(*by, alpha.alias("alpha"), "n_units", "n_values")


def low_reliability(alpha: Column, limit: float) -> Column:
    return F.when(alpha < limit, True).when(alpha.isNotNull(), False)
