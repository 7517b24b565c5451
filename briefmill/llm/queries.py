"""The pN_ queries, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.llm import canonical, consensus, digest, language, mixture, overlap, sample, tokens, truncation
from briefmill.runtime import cut, table

#: Problem 1: share of the items drawn from briefs.
FRACTION = 0.1
#: Problem 3: the groups, the percentiles and the bound on the error of their ranks.
LATENCY_GROUPS, LATENCY_QS, LATENCY_ERROR = ["method_name", "model_name"], [0.25, 0.5, 0.75, 0.9, 0.95, 0.99], 0.005


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the drawn items."""
    return sample.stable_sample(table(spark, sf_dir, "briefs"), "item_id", FRACTION).select("record_id", "item_id", "split", "source", "batch_no")


def p1_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn rows and items of each arrival batch."""
    drawn = p1_sample(spark, sf_dir)
    return drawn.groupBy("batch_no").agg(F.count("*").alias("n_rows"), F.countDistinct("item_id").alias("n_items"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = canonical.occurrences(table(spark, sf_dir, "mappings"), "mapping_id", {"task_type": "task_type", "chart_type": "chart_type"}, {"alternatives": "chart_type"})
    return canonical.map_to_list(own, table(spark, sf_dir, "vocab"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry that each freely written value means, or unmatched."""
    return _mapped(spark, sf_dir).select("mapping_id", "field", "pos", "canonical")


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that belong to no entry, how often and in which fields they occur."""
    return _mapped(spark, sf_dir).filter("canonical = 'unmatched'").groupBy("field", "value").agg(F.count("*").alias("n"), F.max("score").alias("best_score"))


def p3_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable form: a digest for each method, model and month. Node 0 counts nulls, -1 values that are no durations.

    A group has some dozens of values a day in these data, too few to take any together within the bound, so the month is the piece.
    """
    month = F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM")
    return digest.digests(table(spark, sf_dir, "predictions"), "latency_ms", LATENCY_GROUPS, month, LATENCY_ERROR).withColumnRenamed("piece", "month")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each method and model from the digests of its months."""
    months = p3_digests(spark, sf_dir)
    return digest.percentiles(digest.merged(months, LATENCY_GROUPS, LATENCY_ERROR), LATENCY_GROUPS, LATENCY_QS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score that each unit and dimension with at least three raters most probably deserves."""
    units, _ = consensus.judged(table(spark, sf_dir, "human_ratings"), least=3)
    return units.select("unit_id", "dimension", "score")


def p4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of every unit and dimension that has a valid score, with its probability, the share of agreeing pairs of raters, and the number of raters."""
    return consensus.judged(table(spark, sf_dir, "human_ratings"), least=1)[0]


def p4_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each rater from triplet moments, and the share of ratings that equal the consensus."""
    return consensus.judged(table(spark, sf_dir, "human_ratings"))[1]


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of pairs of raters for each dimension, and what is left of it after chance."""
    out = consensus.agreement(consensus.votes(table(spark, sf_dir, "human_ratings")))
    return out.select("dimension", "n_units", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(table(spark, sf_dir, "briefs"), "record_id", "split", "users", ("goals", "kpis"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows, one of train and the other of val or test, that are the same brief."""
    a, b = F.col("train_key"), F.col("eval_key")
    return p5_pairs(spark, sf_dir).select(F.least(a, b).alias("record_id_a"), F.greatest(a, b).alias("record_id_b"))


def p5_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows and those found in train, for each split and source."""
    rows = table(spark, sf_dir, "briefs").filter("split IN ('val', 'test')").select("record_id", "split", "source")
    pairs = overlap.overlap_counts(table(spark, sf_dir, "briefs"), "record_id", "split", "users", ("goals", "kpis"))
    joined = rows.join(pairs, "record_id", "left")
    out = joined.groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("n").alias("n_found"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
    return out.withColumn("share_found", F.col("n_found") / F.col("n_rows"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions whose raw_text lost its end."""
    states = truncation.judged(table(spark, sf_dir, "predictions"), "prediction_id", "raw_text", "source")
    return truncation.truncated(states).select(F.col("of").alias("prediction_id"))


def p6_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its texts."""
    return truncation.by_source(truncation.judged(table(spark, sf_dir, "predictions"), "prediction_id", "raw_text", "source"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document with the branch of the tree that it belongs to: its type, the language that its label names, its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_type").alias("domain"), language.label_of(F.col("lang")).alias("language"), "text")
    return cut(tokens.token_counts(docs, ["doc_id", "source", "domain", "language"], "text"))


def _mixed(spark: SparkSession, sf_dir: str, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    counted = _counted(spark, sf_dir)
    total = float(counted.agg(F.sum("n_tokens")).first()[0] or 0) if everything else None
    return mixture.mixture(counted, table(spark, sf_dir, "mix_targets"), ["domain", "language", "source"], total=total)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each epoch in which they are taken."""
    return _mixed(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target weight, budget, tokens taken and share reached of each source."""
    return _mixed(spark, sf_dir)[1]


def p9_full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a mix of as many tokens as there are in all: some sources run short, and others make up for them."""
    return _mixed(spark, sf_dir, everything=True)[1]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of prose in another language than the document's label names, or of a document whose label names none."""
    lines = _lines(spark, sf_dir).filter(F.col("line_lang").isNotNull() & ~F.coalesce(F.col("line_lang") == F.col("label"), F.lit(False)))
    return lines.select("doc_id", "line_no", F.col("line_lang").alias("lang"))


def p10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its language and confidence; null where it is no prose or none is likely enough."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.col("line_lang").alias("lang"), "confidence")


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a language, with its confidence, whether it is mixed, and what its label names."""
    return language.documents(_lines(spark, sf_dir), "doc_id")


QUERIES = {f.__name__: f for f in (p1_sample, p1_by_batch, p2_found, p2_unmatched, p3_digests, p3_percentiles, p4_found, p4_units, p4_raters, p4_agreement, p5_found, p5_by_source, p6_found, p6_by_source, p8_ids, p9_mix, p9_report, p9_full_report, p10_found, p10_lines, p10_documents)}

_DRAWN = f"((CAST('0x' || substr(md5('42:' || item_id), 1, 8) AS BIGINT) % {sample.BUCKETS}) * {sample.STEP}) % {sample.BUCKETS} < {sample.chosen(FRACTION)}"
_MOMENT = r"CASE WHEN regexp_full_match(trim(timestamp), '\d{9,11}') THEN CAST(trim(timestamp) AS BIGINT) * 1000000 WHEN regexp_matches(timestamp, '^\s*\d+\.\d+\.\d{4}') THEN epoch_us(try_strptime(trim(timestamp), '%d.%m.%Y %H:%M:%S')) ELSE epoch_us(TRY_CAST(trim(timestamp) AS TIMESTAMP)) END"
_VOTES = (
    rf"t AS (SELECT *, lower(regexp_replace(rater_id, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')) AS rater, {_MOMENT} AS t FROM human_ratings WHERE unit_id IS NOT NULL), "
    "l AS (SELECT * FROM t WHERE rater <> '' QUALIFY row_number() OVER (PARTITION BY rater, unit_id ORDER BY t DESC NULLS LAST, received_at DESC NULLS LAST, rating_id DESC) = 1), "
    "v AS (SELECT * FROM (SELECT unit_id, rater, unnest(map_keys(scores)) AS dimension, unnest(map_values(scores)) AS s FROM l) WHERE s BETWEEN 1 AND 5)"
)
ORACLE = {
    "p4_agreement": f"WITH {_VOTES}, c AS (SELECT dimension, unit_id, s, count(*) AS k FROM v GROUP BY ALL), u AS (SELECT dimension, unit_id, sum(k) AS n, sum(k * (k - 1)) AS a FROM c GROUP BY ALL HAVING sum(k) > 1), "
    "o AS (SELECT dimension, sum(a / (n - 1)) / sum(n) AS observed, count(*) AS n_units FROM u GROUP BY dimension), e AS (SELECT dimension, sum(CAST(k AS DOUBLE) * k) / power(sum(k), 2) AS expected FROM (SELECT dimension, s, count(*) AS k FROM v GROUP BY ALL) GROUP BY dimension) "
    "SELECT dimension, n_units, CAST(round(observed, 9) AS DOUBLE) AS observed, CAST(round(expected, 9) AS DOUBLE) AS expected, CAST(round(CASE WHEN expected < 1 THEN (observed - expected) / (1 - expected) END, 9) AS DOUBLE) AS kappa FROM o JOIN e USING (dimension)",
    "p1_sample": f"SELECT record_id, item_id, split, source, batch_no FROM briefs WHERE {_DRAWN}",
    "p1_by_batch": f"SELECT batch_no, count(*) AS n_rows, count(DISTINCT item_id) AS n_items FROM briefs WHERE {_DRAWN} GROUP BY batch_no",
}
