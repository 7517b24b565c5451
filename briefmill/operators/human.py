"""Human evaluation: units, balanced assignment, work queues, rating aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briefmill.operators.relational import in_all, last_wins
from briefmill.runtime import cut, small


def unit_id(item: str = "item_id", method: str = "method"):  # noqa: ANN201
    return F.concat(F.col(item), F.lit("__"), F.col(method))


def units(items: DataFrame, methods: list[str], item: str = "item_id") -> DataFrame:
    """Each item under each method."""
    return items.select(item, F.explode(F.array(*[F.lit(m) for m in methods])).alias("method")).withColumn("unit_id", unit_id(item))


def sampled_items(items: DataFrame, n: int, item: str = "item_id", seed: int = 42) -> DataFrame:
    """The n items of lowest seeded hash: the same in every run and partitioning."""
    return items.filter(F.col(item).isNotNull()).select(item).distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(item))), item).limit(n)


def assignment(unit_rows: DataFrame, raters: list[str], per_unit: int, seed: int = 42) -> DataFrame:
    """(rater, task_order, unit_id, item_id, method): each unit to ``per_unit`` different raters, loads within one of each other.

    Units are numbered in seeded hash order and unit u goes to raters (u k + j) mod R. The number is made of counts of hash
    ranges and a number within the range, so no single task orders all units, nor all units of a rater.
    """
    r = len(raters)
    if per_unit > r:
        raise ValueError(f"{per_unit} ratings per unit need at least as many raters; there are {r}")
    own = unit_rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("unit_id")))).withColumn("range", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    sizes = own.groupBy("range").agg(F.count("*").alias("n"))
    start = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))  # at most 4,096 rows
    numbered = own.join(F.broadcast(start), "range").withColumn("u", F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("h", "unit_id")) - 1)
    names = F.array(*[F.lit(x) for x in raters])
    dealt = numbered.select("u", "unit_id", "item_id", "method", F.explode(F.sequence(F.lit(0), F.lit(per_unit - 1))).alias("j"))
    dealt = dealt.withColumn("rater", F.element_at(names, (F.pmod(F.col("u") * per_unit + F.col("j"), F.lit(r)) + 1).cast("int")))
    # Tasks of a rater are numbered the same way, in the order of hashes of their own.
    mine = dealt.select("rater", "unit_id", "item_id", "method", F.md5(F.concat_ws(":", F.lit(str(seed)), "rater", "unit_id")).alias("h"))
    mine = mine.withColumn("range", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    sizes = mine.groupBy("rater", "range").agg(F.count("*").alias("n"))
    start = sizes.select("rater", "range", (F.sum("n").over(Window.partitionBy("rater").orderBy("range")) - F.col("n")).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("rater", "range").orderBy("h", "unit_id"))
    return mine.join(small(start, 200_000), ["rater", "range"]).withColumn("task_order", place.cast("int")).select("rater", "task_order", "unit_id", "item_id", "method")


def loads(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("rater").agg(F.count("*").alias("n_units"))


def next_tasks(assigned: DataFrame, ratings: DataFrame) -> DataFrame:
    """(rater, unit_id, task_order, n_done, n_total) of each rater's first unit without a rating; none if all are done."""
    done = ratings.select(F.col("rater_id").alias("rater"), "unit_id").distinct().withColumn("done", F.lit(1))
    marked = assigned.join(done, ["rater", "unit_id"], "left")
    first = F.min(F.when(F.col("done").isNull(), F.struct("task_order", "unit_id")))
    out = marked.groupBy("rater").agg(first.alias("t"), F.count("done").alias("n_done"), F.count("*").alias("n_total"))
    return out.filter("t IS NOT NULL").select("rater", "t.unit_id", "t.task_order", "n_done", "n_total")


def eval_items(predictions: DataFrame, references: DataFrame, methods: list[str], n: int | None = None, order: str = "prediction_id", seed: int = 42) -> DataFrame:
    """(item_id, outputs): items that every method and the references have, with each method's last output in a map."""
    own = predictions.filter(F.col("method_name").isin(methods) & F.col("item_id").isNotNull())
    both = in_all(own, "item_id", "method_name", len(methods)).join(references.select("item_id").distinct(), "item_id", "left_semi")
    kept = cut(sampled_items(both, n, seed=seed) if n else both)
    last = last_wins(own.select("item_id", "method_name", "raw_text", order).join(kept, "item_id", "left_semi"), ["item_id", "method_name"], [order])
    return last.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method_name", "raw_text")))).alias("outputs"))


def long_scores(ratings: DataFrame) -> DataFrame:
    """A row for each rating and dimension."""
    return ratings.select("rater_id", "unit_id", "item_id", "method", F.explode("scores").alias("dimension", "s"))


def item_method_scores(ratings: DataFrame) -> DataFrame:
    """(item_id, method, score): the mean of each rating's mean over dimensions."""
    values = F.map_values("scores")
    filled = F.filter(values, lambda v: v.isNotNull())
    each = F.aggregate(filled, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(filled), F.lit(0))
    return ratings.withColumn("__m", each).groupBy("item_id", "method").agg(F.avg("__m").alias("score"))
