from briefmill import runtime
from pyspark.sql import functions as F


def test_hot_keys_are_spread_and_joins_are_whole(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    other = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3), (None, 4)], "k string, v int")
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, big.join(other, "k").select("k", "id", "v").collect()))
    assert sorted(map(tuple, runtime.skew_join(big, other, ["k"], counts, limit=500, salts=4).select("k", "id", "v").collect())) == want
    assert sorted(map(tuple, runtime.salted_join(big, other, ["k"], salts=4).select("k", "id", "v").collect())) == want
    left = runtime.salted_join(big, other, ["k"], "left", 4)
    assert left.count() == 3000 and left.filter("v IS NULL").count() == 3000 - len(want)
    # The salt comes from the row, so it is the same however the rows are spread.
    salt = lambda df: sorted((r.id, r.s) for r in df.withColumn("s", runtime.salt_of(df, 8)).select("id", "s").collect())
    assert salt(big) == salt(big.repartition(7)) and len({s for _, s in salt(big)}) == 8


def test_small_is_checked(spark):
    assert runtime.small(spark.range(10), 20).count() == 10
    assert runtime.small(spark.range(30), 20).count() == 30


def test_spread_leaves_shuffled_plans_alone(spark, tiny):
    df = spark.read.parquet(f"{tiny}/briefs.parquet")
    assert runtime.spread(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    grouped = df.groupBy("source").count()
    assert runtime.spread(grouped) is grouped


def test_hash_bucket_and_checkpoint(spark):
    import hashlib

    row = spark.createDataFrame([("a",)], "k string").select(runtime.hash_bucket(F.col("k"), 42, 1000).alias("b")).first()
    assert row.b == int(hashlib.md5(b"42:a").hexdigest()[:8], 16) % 1000
    assert runtime.cut(spark.range(5)).count() == 5 and runtime.shared_dir(spark)


def test_lookup_join_is_whole_either_way(spark, monkeypatch):
    big = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    other = spark.createDataFrame([(n, n * n) for n in range(5)], "k bigint, v bigint")
    few = sorted(map(tuple, runtime.lookup_join(big, other, ["k"], "left").select("k", "id", "v").collect()), key=str)
    monkeypatch.setattr(runtime, "small", lambda df, *_: df)
    assert few == sorted(map(tuple, runtime.lookup_join(big, other, ["k"], "left").select("k", "id", "v").collect()), key=str)


def test_a_name_is_no_step(spark):
    df = spark.range(3).select(F.col("id").alias("Join Sort Window"))
    assert not runtime.steps(df) & runtime.SHUFFLING and runtime.steps(df.groupBy("Join Sort Window").count()) & runtime.SHUFFLING


def test_hot_keys_beyond_the_list_are_joined_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 2)
    big = spark.range(200).select((F.col("id") % 8).alias("k"), "id")
    other = spark.range(8).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = runtime.skew_join(big, other, ["k"], big.groupBy("k").agg(F.count("*").alias("n")), limit=3, salts=4)
    assert got.count() == 200 and got.filter("v <> 2 * k").count() == 0
