"""Consensus of annotators who disagree: triplet moments, log-odds votes, and a measure of agreement.

Only a rater's latest rating of a unit counts. What the average rater is like comes from triplets: how often three different
raters of a unit give the scores (a, b, c) is a sum over the true scores of products of three equal rows, the chances of
giving each score. The table of these rates has 5 x 5 x 5 numbers, is summed from each unit's histogram of scores, so that no
triplets or pairs of raters are made however many rate one unit, and is taken apart on the driver: whitened by the table of pairs,
it has orthogonal factors. Each rater is then solved from pairs: the rates at which a rater's score s meets the score b of
other raters of the same unit are the rater's own accuracies times the rows of the average rater; the share that agrees by
chance is part of both sides and so falls out. Solved for numbers that are not negative, with ``PRIOR_VOTES`` votes of the average
rater added, they are the rater's accuracies: how probable each given score is for each true one, which also tells a rater who
always gives the same score or one too many. Votes are combined with the log-odds of these accuracies. Nothing is iterated over
the data: two aggregates, two joins.

Defined cases: ratings without a rater (null or blank) don't count; raters are told apart without regard to case and outer
blanks; scores that are null or outside 1 to 5 don't count; a unit and dimension with fewer than ``least`` raters has no
consensus but helps to judge raters; timestamps are ISO with T or blank, dd.mm.yyyy, or seconds since 1970, in UTC where
they don't say otherwise, others count as earliest; ties in time go to the later received, then to the higher id; of equally likely
scores the lower one is taken; a rater who shares no unit with others has the average rater's weights; without triplets the
average rater is solved from pairs alone, with one accuracy for all scores; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.runtime import cut, skew_join, small

SCORES = 5
UNIT = ["unit_id", "dimension"]
#: Votes of the average rater that are added to each rater's row for each true score.
PRIOR_VOTES = 32.0
#: Triplets and pairs of the one-accuracy model that are added before the table of triplets is taken apart.
PRIOR_TRIPLETS = 20.0
#: No chance is taken for smaller than this.
LEAST = 1e-3
#: Score combinations that stand for their permutations.
TRIPLES = list(itertools.combinations_with_replacement(range(SCORES), 3))


def moment(text: Column) -> Column:
    """Microseconds since 1970 of the time that a text in one of the known formats names; UTC whatever the session's zone is."""
    t = F.trim(text)
    iso = F.regexp_replace(t, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})", "$3-$2-$1")
    day = F.when(iso.rlike(r"^\d+-\d+-\d+$"), F.concat(iso, F.lit("T00:00:00"))).otherwise(iso)
    zoned = F.when(day.rlike(r"(Z|[+-]\d{1,2}:?\d{2}|UTC|GMT)$") & day.contains(":"), day).otherwise(F.concat(day, F.lit("Z")))
    return F.when(t.rlike(r"^\d{9,11}$"), t.try_cast("bigint") * 1_000_000).otherwise(F.unix_micros(zoned.try_cast("timestamp")))


def latest(df: DataFrame) -> DataFrame:
    """(rater, unit_id, scores): of each rater and unit the latest rating."""
    rater = F.lower(F.regexp_replace("rater_id", r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""))
    order = F.struct(moment(F.col("timestamp")).alias("t"), F.col("received_at").alias("r"), F.col("rating_id").alias("i"))
    own = df.select(rater.alias("rater"), "unit_id", "scores", order.alias("o")).filter("rater <> '' AND unit_id IS NOT NULL")
    return own.groupBy("rater", "unit_id").agg(F.max_by("scores", "o").alias("scores"))


def votes(df: DataFrame) -> DataFrame:
    """(unit_id, dimension, rater, s): the valid scores of the latest ratings."""
    long = latest(df).select("unit_id", "rater", F.explode("scores").alias("dimension", "s"))
    return cut(long.filter(F.col("s").between(1, SCORES)))


def histograms(own: DataFrame) -> DataFrame:
    """(unit_id, dimension, n, h): how many raters of each unit and dimension gave each score."""
    sums = [F.sum(F.when(F.col("s") == i, 1).otherwise(0)).alias(f"h{i}") for i in range(1, SCORES + 1)]
    return own.groupBy(*UNIT).agg(F.count("*").alias("n"), *sums).select(*UNIT, "n", F.array(*[F.col(f"h{i}").cast("double") for i in range(1, SCORES + 1)]).alias("h"))


def tables(unit: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often three, and two, different raters of a unit give each combination of scores; a rater counts once in each.

    A unit of n raters has n (n - 1) (n - 2) triplets, which together weigh n, so a unit that very many rate does not outweigh all others.
    """

    def ways(scores: tuple[int, ...]) -> Column:
        """The ordered choices of different raters with these scores."""
        out = F.lit(1.0)
        for i, s in enumerate(scores):
            out = out * (F.col("h")[s] - sum(x == s for x in scores[:i]))
        return out

    n = F.col("n").cast("double")
    sums = [F.sum(F.when(n > 2, ways(t) / ((n - 1) * (n - 2)))).alias(f"t{i}") for i, t in enumerate(TRIPLES)]
    doubles = list(itertools.combinations_with_replacement(range(SCORES), 2))
    sums += [F.sum(F.when(n > 1, ways(t) / (n - 1))).alias(f"p{i}") for i, t in enumerate(doubles)]
    row = unit.agg(*sums).first()
    three, two = np.zeros((SCORES,) * 3), np.zeros((SCORES,) * 2)
    for i, t in enumerate(TRIPLES):
        for at in itertools.permutations(t):
            three[at] = row[f"t{i}"] or 0.0
    for i, t in enumerate(doubles):
        two[t] = two[t[::-1]] = row[f"p{i}"] or 0.0
    return three, two


def one_accuracy(two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, rows) if the average rater is right at one rate and else guesses: its square is the agreement of pairs corrected for chance."""
    shares = np.maximum(two.sum(1) / two.sum() if two.sum() else np.full(SCORES, 1 / SCORES), LEAST)
    shares /= shares.sum()
    agree, chance = (np.trace(two) / two.sum() if two.sum() else 0.0), float((shares**2).sum())
    right = np.sqrt(np.clip((agree - chance) / (1 - chance), 0.04, 0.98)) if chance < 1 else 0.98
    return shares, right * np.eye(SCORES) + (1 - right) * shares


def average_rater(three: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares of the true scores, rows: chance of each given score for each true one) from the tables of triplets and pairs."""
    plain_shares, plain = one_accuracy(two)
    whole = three.sum() + PRIOR_TRIPLETS
    joint = (three + PRIOR_TRIPLETS * np.einsum("y,ya,yb,yc->abc", plain_shares, plain, plain, plain)) / whole
    size, axes = np.linalg.eigh(joint.sum(2))
    if size.min() <= 1e-9:
        return plain_shares, plain
    white = axes / np.sqrt(size)
    left = np.einsum("abc,ai,bj,ck->ijk", joint, white, white, white)
    starts = np.random.default_rng(0).normal(size=(SCORES, 60, SCORES))
    shares, rows = np.zeros(SCORES), np.zeros((SCORES, SCORES))
    for k in range(SCORES):
        x = starts[k] / np.linalg.norm(starts[k], axis=1, keepdims=True)
        for _ in range(200):  # power steps, which converge quadratically
            x = np.einsum("ijk,rj,rk->ri", left, x, x)
            x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-300
        value = np.einsum("ijk,ri,rj,rk->r", left, x, x, x)
        best, factor = value.max(), x[value.argmax()]
        if best <= 0:
            return plain_shares, plain
        shares[k], rows[k] = best**-2, best * (np.linalg.inv(white.T) @ factor)
        left = left - best * np.einsum("i,j,k->ijk", factor, factor, factor)
    rows = np.maximum(rows, LEAST)
    rows /= rows.sum(1, keepdims=True)
    # A factor is the true score that its raters give most; the order that makes all of them so at once.
    order = list(max(itertools.permutations(range(SCORES)), key=lambda p: sum(np.log(rows[p[t], t]) for t in range(SCORES))))
    shares, rows = shares[order] / shares.sum(), rows[order]
    told_apart = all(rows[t, t] > np.delete(rows[:, t], t).max() for t in range(SCORES))
    return (shares, rows) if told_apart and np.isfinite(rows).all() else (plain_shares, plain)


def solved(met: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The numbers k >= 0 (rater, given, true) for which k @ rows is nearest to ``met`` (rater, given, met score)."""
    start = met.sum(2, keepdims=True) * 0.05 / SCORES + 1e-6
    k = np.maximum(met @ np.linalg.inv(rows), start)
    aim, square = met @ rows.T, rows @ rows.T
    for _ in range(5000):
        step = k * aim / np.maximum(k @ square, 1e-12)
        near = np.abs(step - k).max(initial=0.0) <= 1e-4
        k = step
        if near:
            break
    return k


def accuracies(own: DataFrame, unit: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(rater, n, reliability, rates) and the shares of the true scores; rates has for each true score the chances of the given ones, 25 numbers."""
    shares, rows = average_rater(*tables(unit))
    joined = skew_join(own, unit, UNIT, unit.select(*UNIT, "n"))
    # For each rater and given score the share of the other raters who gave each score, summed over units.
    meets = [F.sum(F.when(F.col("n") > 1, (F.col("h")[b] - F.when(F.col("s") == b + 1, 1.0).otherwise(0.0)) / (F.col("n") - 1)).otherwise(0.0)).alias(f"m{b}") for b in range(SCORES)]
    each = joined.groupBy("rater", "s").agg(F.count("*").alias("n"), *meets)
    cells = [F.sum(F.when(F.col("s") == s + 1, F.col(f"m{b}")).otherwise(0.0)).alias(f"m{s}{b}") for s in range(SCORES) for b in range(SCORES)]
    packed = F.array(*[F.col(f"m{s}{b}") for s in range(SCORES) for b in range(SCORES)])
    met = each.groupBy("rater").agg(F.sum("n").alias("n"), *cells).select("rater", "n", packed.alias("met"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if pdf.empty:
                continue
            k = solved(np.stack(pdf.met.to_numpy()).reshape(-1, SCORES, SCORES), rows).transpose(0, 2, 1)
            rates = np.maximum((k + PRIOR_VOTES * rows) / (k.sum(2, keepdims=True) + PRIOR_VOTES), LEAST)
            yield pd.DataFrame({"rater": pdf.rater, "n": pdf.n, "reliability": reliability(k), "rates": list((rates / rates.sum(2, keepdims=True)).reshape(-1, SCORES * SCORES))})

    return cut(met.mapInPandas(run, "rater string, n bigint, reliability double, rates array<double>")), shares


def reliability(k: np.ndarray) -> np.ndarray:
    """One number for each rater's table (rater, true, given): how often both are equal, corrected for chance; 0 for guessing, for one
    score always and without other raters."""
    whole = k.sum((1, 2))
    joint = k / np.maximum(whole, 1e-12)[:, None, None]
    right, chance = np.einsum("rtt->r", joint), np.einsum("rt,rt->r", joint.sum(2), joint.sum(1))
    return np.where((whole > 0.5) & (chance < 1 - 1e-9), (right - chance) / np.maximum(1 - chance, 1e-9), 0.0)


def consensus(own: DataFrame, raters: DataFrame, shares: np.ndarray) -> DataFrame:
    """(unit_id, dimension, p): how probable each score is, by the log-odds of the votes' accuracies."""
    odds = raters.select("rater", F.transform("rates", lambda x: F.log(x)).alias("odds"))
    weighed = small(odds)
    voted = own.join(weighed, "rater") if weighed is not odds else skew_join(own, odds, ["rater"], raters.select("rater", "n"))
    summed = voted.groupBy(*UNIT).agg(*[(F.sum(F.col("odds")[F.lit(t * SCORES) + F.col("s") - 1]) + float(np.log(shares[t]))).alias(f"l{t}") for t in range(SCORES)])
    top = F.greatest(*[F.col(f"l{t}") for t in range(SCORES)])
    p = [F.exp(F.col(f"l{t}") - top) for t in range(SCORES)]
    whole = sum(p[1:], p[0])
    return summed.select(*UNIT, F.array(*[x / whole for x in p]).alias("p"))


def judged(df: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Units (unit_id, dimension, score, confidence, agreement, n_raters) and raters (rater, n, reliability, accuracy).

    Units are those with at least ``least`` raters; the agreement of a single rater is null."""
    own = votes(df)
    unit = cut(histograms(own))
    rated, shares = accuracies(own, unit)
    p = consensus(own, rated, shares)
    best = F.array_max("p")
    pairs = F.aggregate("h", F.lit(0.0), lambda a, x: a + x * (x - 1))
    units = p.join(unit, UNIT).select(*UNIT, F.array_position("p", best).cast("int").alias("score"), best.alias("confidence"), F.when(F.col("n") > 1, pairs / (F.col("n") * (F.col("n") - 1))).alias("agreement"), F.col("n").alias("n_raters"))
    right = skew_join(own, units.select(*UNIT, "score"), UNIT, unit.select(*UNIT, "n")).groupBy("rater").agg(F.avg((F.col("s") == F.col("score")).cast("double")).alias("accuracy"))
    return units.filter(F.col("n_raters") >= least), rated.select("rater", "n", "reliability").join(right, "rater")


def agreement(own: DataFrame) -> DataFrame:
    """(dimension, observed, n_units, expected, kappa) of ``votes``: agreement of pairs of raters and what is left of it after chance."""
    unit = histograms(own).filter("n > 1")  # a single rater makes no pair
    pairs = F.aggregate("h", F.lit(0.0), lambda a, x: a + x * (x - 1)) / (F.col("n") - 1)
    seen = unit.groupBy("dimension").agg((F.sum(pairs) / F.sum("n")).alias("observed"), F.count("*").alias("n_units"))
    share = own.groupBy("dimension", "s").agg(F.count("*").alias("k"))
    chance = share.groupBy("dimension").agg((F.sum(F.col("k").cast("double") * F.col("k")) / F.pow(F.sum("k"), F.lit(2))).alias("expected"))
    return seen.join(chance, "dimension").withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))
