import numpy as np
import pytest
from briefmill.llm import digest, sample
from pyspark.sql import functions as F


def drawn(df, fraction, seed=42):
    return {(r.k, r.n) for r in sample.stable_sample(df, "k", fraction, seed).collect()}


def test_sample_is_stable(spark):
    df = spark.range(3000).select(F.concat(F.lit("item_"), F.col("id") % 1000).alias("k"), F.col("id").alias("n"), F.lit(1).alias("place"))
    first = drawn(df, 0.2)
    assert first == drawn(df.repartition(7), 0.2)  # however the rows are spread
    assert first <= drawn(df, 0.5)  # larger samples hold smaller ones
    grown = df.unionByName(df.selectExpr("k", "n + 100000 AS n", "place"))
    assert first <= drawn(grown, 0.2) and {k for k, _ in first} == {k for k, _ in drawn(grown, 0.2)}
    assert all(sum(x == k for x, _ in first) == 3 for k in {k for k, _ in first})  # all rows of a drawn item
    assert 0.15 < len(first) / 3000 < 0.25
    assert drawn(df, 0) == set() and len(drawn(df, 1)) == 3000
    assert drawn(df, 0.2, 1) != first


def test_sample_edges(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("x" * 100_000, 3), ("a", 4), ("a", 4)], "k string, n int")
    assert {r.n for r in sample.stable_sample(df, "k", 1).collect()} == {2, 3, 4} and sample.stable_sample(df, "k", 1).count() == 4
    assert sample.stable_sample(df.limit(0), "k", 0.5).count() == 0
    with pytest.raises(ValueError):
        sample.stable_sample(df, "k", 2)


def test_fraction_for_a_wanted_size(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("n"))
    f = sample.fraction_for(df, "k", 100)
    assert 100 <= len(drawn(df, f)) <= 110
    assert sample.fraction_for(df, "k", 50, already=f) == f and sample.fraction_for(df, "k", 10**6) == 1.0


def test_buckets_are_permuted():
    places = {(b * sample.STEP) % sample.BUCKETS for b in range(sample.BUCKETS)}
    assert len(places) == sample.BUCKETS


def frame(spark, values, g="g"):
    return spark.createDataFrame([(g, i % 5, v) for i, v in enumerate(values)], "g string, day int, v double")


def test_percentiles_keep_their_bounds(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(6, 1.5, 20_000), np.full(5000, 2500.0), rng.uniform(0, 5, 2000), [1e12, 1e300, 1.7e308]])
    parts = digest.digests(frame(spark, values.tolist()), "v", ["g"], F.col("day"), 0.01)
    assert parts.groupBy("piece").count().agg(F.max("count")).first()[0] <= 2 * digest.LEVELS / 0.01 + 1
    row = digest.percentiles(digest.merged(parts, ["g"], 0.01), ["g"], [0.01, 0.5, 0.9, 0.999]).first()
    x = np.sort(values)
    assert row.n == len(x) and 0 < row.max_rank_error <= 0.01 * len(x)
    for q, name in ((0.01, "p1"), (0.5, "p50"), (0.9, "p90"), (0.999, "p99_9")):
        slack = row[name] * digest.VALUE_ERROR + digest.UNIT
        low, high = np.searchsorted(x, row[name] - slack, "left"), np.searchsorted(x, row[name] + slack, "right")
        assert low - row.max_rank_error <= q * len(x) <= high + row.max_rank_error


def test_merging_pieces_equals_one_digest_within_bounds(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, rng.lognormal(5, 1, 20_000).tolist())
    one = digest.percentiles(digest.merged(digest.digests(df, "v", ["g"], F.lit(0), 0.01), ["g"], 0.01), ["g"], [0.5]).first().p50
    many = digest.percentiles(digest.merged(digest.digests(df, "v", ["g"], F.col("day"), 0.01), ["g"], 0.01), ["g"], [0.5]).first().p50
    assert many == pytest.approx(one, rel=0.05)


def test_compression_keeps_counts():
    rng = np.random.default_rng(2)
    nodes = digest.LEAVES + rng.integers(0, digest.LEAVES, 5000)
    kept, counts = digest.compressed(nodes, np.ones(5000, np.int64), 0.05)
    assert counts.sum() == 5000 and len(kept) < 200
    assert 0 < digest.rank_error(kept, counts) <= 0.05 * 5000
    again, more = digest.compressed(np.concatenate([kept, nodes]), np.concatenate([counts, np.ones(5000, np.int64)]), 0.05)
    assert more.sum() == 10_000 and digest.rank_error(again, more) <= 0.05 * 10_000


def test_values_without_a_top(spark):
    """Nothing is clipped: percentiles of values beyond any range that durations have are right as well."""
    values = [10.0**k for k in range(1, 301, 3)]
    row = digest.percentiles(digest.merged(digest.digests(frame(spark, values), "v", ["g"], F.col("day"), 0.001), ["g"], 0.001), ["g"], [0.5, 1.0]).first()
    assert row.p50 == pytest.approx(values[49], rel=digest.VALUE_ERROR) and row.p100 == pytest.approx(values[-1], rel=digest.VALUE_ERROR)


def test_digests_of_the_query_are_compressed(spark):
    """Months of predictions put together keep the bound against exact ranks, and are held by inner nodes."""
    from briefmill.llm import queries

    made = queries.p3_digests(spark, "/root/testdata/sf0.1").toPandas()
    assert ((made.node > 0) & (made.node < digest.LEAVES)).any() and (made.node > 0).sum() < 0.95 * made.n[made.node > 0].sum()
    data = spark.read.parquet("/root/testdata/sf0.1/predictions.parquet").select(*queries.LATENCY_GROUPS, "latency_ms").toPandas()
    ok = data[data.latency_ms.notna() & (data.latency_ms >= 0) & np.isfinite(data.latency_ms)]
    for r in queries.p3_percentiles(spark, "/root/testdata/sf0.1").collect():
        own = ok[(ok.method_name == r.method_name) & ((ok.model_name == r.model_name) | (ok.model_name.isna() & (r.model_name is None)))].latency_ms.sort_values().to_numpy()
        assert r.n == len(own) and r.max_rank_error <= queries.LATENCY_ERROR * r.n
        for q, v in ((0.5, r.p50), (0.95, r.p95)):
            slack = v * digest.VALUE_ERROR + digest.UNIT
            low, high = np.searchsorted(own, v - slack, "left"), np.searchsorted(own, v + slack, "right")
            assert low - r.max_rank_error <= np.ceil(q * r.n) <= high + r.max_rank_error + 1


def test_digest_edges(spark):
    df = frame(spark, [1.0, None, float("nan"), -1.0, float("inf"), 0.0, 7.0]).unionByName(frame(spark, [None, -5.0], None))
    rows = {r.g: r for r in digest.percentiles(digest.merged(digest.digests(df, "v", ["g"], F.col("day")), ["g"]), ["g"], [0.5]).collect()}
    assert (rows["g"].n, rows["g"].n_null, rows["g"].n_invalid) == (3, 1, 3) and rows["g"].p50 == pytest.approx(1, rel=1e-3)
    assert (rows[None].n, rows[None].p50) == (0, None)
    assert digest.digests(df.limit(0), "v", ["g"], F.col("day")).count() == 0
