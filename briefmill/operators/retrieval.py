"""Passages for queries, by TF-IDF or by vectors; the k best of each query.

TF-IDF is a join on terms: a passage that shares no term never comes up, which is the filter on positive scores. Dense
search multiplies blocks of queries with blocks of the corpus in Arrow batches and keeps the k best of each block, so no
pair is ever a row; what makes texts vectors is plugged in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briefmill.functions.text import words
from briefmill.functions.vocab import STOP_WORDS
from briefmill.operators.registry import EMBEDDERS, RETRIEVERS
from briefmill.runtime import cut, lookup_join, small

#: Vectors that are multiplied at once, and numbers that are broadcast at most.
BLOCK, FLOATS = 4096, 16_000_000


def term_counts(df: DataFrame, key: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """(key, term, tf) without stop words."""
    out = df.select(key, F.explode(words(F.col(text))).alias("term"))
    return out.filter(~F.col("term").isin(STOP_WORDS if stop is None else stop)).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf_index(corpus: DataFrame, key: str, text: str, stop: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, term, w) with unit length for each passage, and (term, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    counts = cut(term_counts(corpus, key, text, stop))
    n = corpus.select(F.count("*").alias("n"))
    idf = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    return unit_weights(counts, idf, key), idf


def unit_weights(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    weighed = counts.join(small(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return weighed.join(length, key).select(key, "term", (F.col("w") / F.col("length")).alias("w"))


def tfidf_topk(queries: DataFrame, corpus: DataFrame, query: str, query_text: str, key: str, text: str, k: int = 3, stop: list[str] | None = None) -> DataFrame:
    """(query, key, score, rank): cosine, ties to the later key."""
    index, idf = tfidf_index(corpus, key, text, stop)
    asked = unit_weights(term_counts(queries, query, query_text, stop), idf, query).withColumnRenamed("w", "qw")
    scored = lookup_join(asked, index, ["term"], rows=200_000).groupBy(query, key).agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
    return best(scored.withColumn("score", F.round("score", 9)), query, key, k)


def bm25_topk(queries: DataFrame, corpus: DataFrame, query: str, query_text: str, key: str, text: str, k: int = 3, k1: float = 1.5, b: float = 0.75, stop: list[str] | None = None) -> DataFrame:
    """As ``tfidf_topk`` with BM25 weights."""
    counts = cut(term_counts(corpus, key, text, stop))
    length = counts.groupBy(key).agg(F.sum("tf").alias("len"))
    whole = length.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    w = counts.join(length, key).join(df, "term").crossJoin(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = w.select(key, "term", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))).alias("w"))
    scored = lookup_join(term_counts(queries, query, query_text, stop), w, ["term"], rows=200_000).groupBy(query, key).agg(F.sum("w").alias("score"))
    return best(scored.withColumn("score", F.round("score", 9)), query, key, k)


def best(scored: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The k best of each query; scores that aren't positive are left out after that."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.desc(key))))
    return ranked.filter((F.col("rank") <= k) & (F.col("score") > 0)).select(query, key, "score", "rank")


def fused(ranked: list[DataFrame], query: str, key: str, k: int, constant: int = 60) -> DataFrame:
    """Several rankings in one: the sum of 1 / (rank + constant)."""
    parts = None
    for r in ranked:
        one = r.select(query, key, (1.0 / (F.col("rank") + constant)).alias("s"))
        parts = one if parts is None else parts.unionByName(one)
    return best(parts.groupBy(query, key).agg(F.round(F.sum("s"), 9).alias("score")), query, key, k)


def unit(vector: Column) -> Column:
    """The vector at length 1; a vector of zeros stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(vector, lambda x: x / F.when(length > 0, length).otherwise(1.0))


def normed(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def dense_topk(queries: DataFrame, corpus: DataFrame, query: str, key: str, vector: str, k: int = 3, not_itself: bool = False) -> DataFrame:
    """(query, key, score, rank) by dot product of unit vectors; exact, every query against every vector, ties to the later key.

    A corpus of at most FLOATS numbers, which is counted, is broadcast, and each task finds the k best of its queries: nothing is
    shuffled. A larger one is scanned for each block of queries of that size; a task hands on the k best of each query, so what
    is shuffled is k rows for each query, block and task.
    """
    spark = queries.sparkSession
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query).alias("q"), F.col(vector).alias("v"))
    slim = corpus.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    about = slim.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    name = key if key != query else f"{key}_found"
    kinds = f"q {dict(queries.dtypes)[query]}, k {dict(corpus.dtypes)[key]}, score double"
    if about.n * (about.d or 0) <= FLOATS:
        rows = slim.orderBy(F.desc("k")).toPandas()
        if rows.empty:
            return spark.createDataFrame([], f"{kinds}, rank int").toDF(query, name, "score", "rank")
        shared = spark.sparkContext.broadcast((rows.k.to_numpy(), normed(np.stack(rows.v.to_numpy()).astype(np.float32))))

        def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, matrix = shared.value
            for pdf in parts:
                for at in range(0, len(pdf), BLOCK):
                    part = pdf.iloc[at : at + BLOCK]
                    score = np.round((normed(np.stack(part.v.to_numpy()).astype(np.float32)) @ matrix.T).astype(np.float64), 6)
                    if not_itself:
                        score[part.q.to_numpy()[:, None] == keys[None, :]] = -2
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    best_score = np.take_along_axis(score, top, 1)
                    a, b = np.nonzero(best_score > 0)
                    yield pd.DataFrame({"q": part.q.to_numpy()[a], "k": keys[top[a, b]], "score": best_score[a, b], "rank": (b + 1).astype(np.int32)})

        return asked.mapInPandas(whole, f"{kinds}, rank int").toDF(query, name, "score", "rank")
    blocks = max(1, -(-asked.count() * about.d // FLOATS))
    numbered = asked.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    out = spark.createDataFrame([], kinds)
    for i in range(blocks):
        rows = numbered.filter(F.col("b") == i).select("q", "v").toPandas()
        if rows.empty:
            continue
        matrix = spark.sparkContext.broadcast((rows.q.to_numpy(), normed(np.stack(rows.v.to_numpy()).astype(np.float32))))

        def run(parts: Iterator[pd.DataFrame], matrix=matrix) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ids, mine = matrix.value
            for pdf in parts:
                for at in range(0, len(pdf), BLOCK):
                    part = pdf.iloc[at : at + BLOCK]
                    score = np.round((mine @ normed(np.stack(part.v.to_numpy()).astype(np.float32)).T).astype(np.float64), 6)
                    keys = part.k.to_numpy()
                    if not_itself:
                        score[ids[:, None] == keys[None, :]] = -2
                    m = min(k, len(part))
                    # Ties at the edge are all kept, the ranking decides.
                    edge = -np.partition(-score, m - 1, axis=1)[:, m - 1 : m]
                    a, b = np.nonzero(score >= edge)
                    yield pd.DataFrame({"q": ids[a], "k": keys[b], "score": score[a, b]})

        out = out.unionByName(slim.mapInPandas(run, kinds))
    return best(out.toDF(query, name, "score"), query, name, k)


def hashed_embedding(text: Column, size: int = 256) -> Column:
    """A stand-in for a model: how often words fall on each of ``size`` places. In the JVM."""
    places = F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("float"))


EMBEDDERS.register("hashed")(hashed_embedding)


def embedded(df: DataFrame, key: str, text: str, embed: str | Callable[[Column], Column] = "hashed") -> DataFrame:
    """(key, vector): the dense index of texts. ``embed`` makes a text column a column of vectors, or names one in EMBEDDERS."""
    make = EMBEDDERS.get(embed) if isinstance(embed, str) else embed
    return cut(df.select(key, make(F.coalesce(F.col(text), F.lit(""))).alias("vector")))


def embedded_topk(queries: DataFrame, corpus: DataFrame, query: str, query_text: str, key: str, text: str, k: int = 3, embed: str | Callable[[Column], Column] = "hashed") -> DataFrame:
    """As ``tfidf_topk`` by the vectors of queries and passages."""
    return dense_topk(embedded(queries, query, query_text, embed), embedded(corpus, key, text, embed), query, key, "vector", k)


# Every retriever takes (queries, corpus, query, query_text, key, text, k) and options of its own, and gives (query, key, score, rank).
for _name, _retriever in (("tfidf", tfidf_topk), ("bm25", bm25_topk), ("dense", embedded_topk)):
    RETRIEVERS.register(_name)(_retriever)
