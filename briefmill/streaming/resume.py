"""Append and resume as streams: briefs that arrive are answered once, ratings are read as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from briefmill.operators.inference import Generate, run_inference
from briefmill.operators.relational import first_wins
from briefmill.sources import files
from briefmill.sources.gold import RATING
from briefmill.sources.sinks import split_errors


def answer_stream(arriving: DataFrame, method: Callable[[], Generate], keys: list[str], out: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Generates for each micro-batch what ``out`` does not hold yet and appends it; errors go to ``out``_errors.

    A batch that is replayed after a failure finds its rows done, so nothing is generated or written twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        # Only a place that is not there yet means that nothing is done; what can't be read raises.
        done = spark.read.schema(schema).parquet(out).select(*keys) if files.exists(out) else None
        once = first_wins(df, keys, keys)
        made = run_inference(once, done, method, keys)
        split_errors(made.select(*keys, "raw_text", "latency_ms", "parse_error", "error"), out, f"{out}_errors", keys)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ratings_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings from JSON lines files as they arrive, malformed lines dropped."""
    return spark.readStream.schema(RATING).option("mode", "DROPMALFORMED").json(folder)


def progress(stream: DataFrame) -> DataFrame:
    """Ratings and scored dimensions of each rater so far."""
    return stream.groupBy("rater_id").agg(F.count("*").alias("n_ratings"), F.sum(F.size("scores")).alias("n_scores"))
