"""What every operator needs from the session: tables, shared checkpoints, parallelism, checked broadcasts, salts."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its row count, known beforehand or counted, is at most this.
BROADCAST_ROWS = 20_000


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each context; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_briefmill_shipped", False):
        return
    package = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="briefmill-package-")) / "briefmill_package.zip"
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    sc.addPyFile(str(bundle))
    sc._briefmill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one is set only where none is and Spark runs locally."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="briefmill-checkpoint-")
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the shared checkpoint folder, its lineage cut; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(spark: SparkSession) -> None:
    """Have Spark remove the files of shuffles that no plan refers to any more, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Steps of a plan behind which its partitions are no longer those of a scan.
SHUFFLING = {"Join", "Aggregate", "Sort", "Window", "Repartition", "RepartitionByExpression", "Union", "Distinct"}


def steps(df: DataFrame) -> set[str]:
    """The names of the steps of a plan."""
    found, todo = set(), [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        step = todo.pop()
        found.add(step.nodeName())
        below = step.children()
        todo += [below.apply(i) for i in range(below.size())]
    return found


def spread(df: DataFrame) -> DataFrame:
    """``df`` for costly work per row: a scan of fewer splits than cores is dealt out over all cores.

    On large inputs the scan has more splits than there are cores and nothing is shuffled. A plan that is more than a scan
    has partitions of its own already and stays as it is.
    """
    if steps(df) & SHUFFLING:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salt_of(df: DataFrame, salts: int) -> Column:
    """A salt from the row's own values, so a task that runs again deals its rows out as before. Equal rows share it."""
    return F.pmod(F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]), F.lit(salts)).cast("int")


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join in which each key of ``big`` is spread over ``salts`` tasks; ``other`` is repeated ``salts`` times.

    For a ``big`` of which one key may hold a third of all rows. ``other`` must be unique in ``keys`` or small per key.
    ``how`` is inner, left, left_semi or left_anti. Null keys never match, as in any equi-join.
    """
    salt = "__salt"
    left = big.withColumn(salt, salt_of(big, salts))
    right = other.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, salt], how).drop(salt)


def hash_bucket(column: Column, seed: int, buckets: int) -> Column:
    """Bucket 0 .. buckets-1 of a string: the first 8 hex digits of md5(seed ':' value), modulo; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), column)), 1, 8), 16, 10).cast("bigint") % buckets


def skew_join(big: DataFrame, other: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner", limit: int = 200_000, salts: int = 32) -> DataFrame:
    """Equi-join in which the keys of ``big`` with more than ``limit`` rows are spread over ``salts`` tasks.

    ``counts`` has keys and n, the rows of ``big`` for each key. The list of hot keys is broadcast: those with most rows,
    BROADCAST_ROWS at most, so its size is bounded however large ``big`` is; a key beyond them has less than
    1 / BROADCAST_ROWS of all rows and is joined as it is. ``other`` is repeated for the keys of the list only.
    """
    most = counts.filter(F.col("n") > limit).orderBy(F.desc("n"), *keys).limit(BROADCAST_ROWS)
    hot = F.broadcast(most.select(*keys, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), salt_of(big, salts)).otherwise(0)
    left = big.join(hot, keys, "left").withColumn("__salt", salt).drop("__hot")
    spread_out = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    right = other.join(hot, keys, "left").withColumn("__salt", spread_out).drop("__hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def lookup_join(big: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join of many rows with a table that has few of each key: broadcast if it is counted to have at most ``rows``, so ``big`` is
    not shuffled; else hot keys of ``big`` are salted."""
    few = small(other, rows)
    if few is not other:
        return big.join(few, keys, how)
    return skew_join(big, other, keys, big.groupBy(*keys).agg(F.count("*").alias("n")), how)


def among(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in that of ``values``, and some others, without a shuffle of ``df``.

    A bitmap of the hashes of ``values``, 16 bits for each and 32 MB at most, goes to the executors; a join with ``values`` must follow.
    """
    bits = 1 << min(28, max(16, (16 * values.count()).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    chunks = values.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    table = np.zeros(bits // 8, np.uint8)
    for n, chunk in chunks:
        table[(n - 1) * 4096 : n * 4096] = np.frombuffer(chunk, np.uint8)
    sent = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(batch.num_columns - 1).to_numpy() - 1
            keep = sent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep.astype(bool)))

    return df.withColumn("__at", at).mapInArrow(run, df.schema)
