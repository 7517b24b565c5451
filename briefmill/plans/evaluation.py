"""Queries of metrics, retrieval, statistics and human evaluation over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.functions import jsonout, text, vocab
from briefmill.operators import human, metrics, relational, report, retrieval, stats
from briefmill.runtime import cut, table

QUERIES = {}
ORACLE = {}
METHODS = ["prompt_only", "rag", "ft", "ft_rag"]
KINDS = ["view", "click", "purchase", "signup", "error"]


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Original predictions with the reference of their item."""
    own = predictions(spark, d).filter("variant = 'original'").select("prediction_id", "item_id", "method_name", "parsed")
    return metrics.with_reference(own, table(spark, d, "design_outputs"), "item_id", "output_id")


MAPPING = "parsed.kpi_chart_mapping"
PARSED = "parsed IS NOT NULL"
_CHARTS = "list_transform(list_filter(coalesce({m}, []), lambda m: m IS NOT NULL AND m.chart_type IS NOT NULL), lambda m: trim(lower(m.chart_type), ' '))"
_GOLD = f"gold AS (SELECT item_id, {_CHARTS.format(m='kpi_chart_mapping')} AS gold FROM (SELECT * FROM design_outputs WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY output_id DESC) = 1) WHERE len({_CHARTS.format(m='kpi_chart_mapping')}) > 0)"
_SCORED = (
    f"WITH {_GOLD}, s AS (SELECT method_name, parsed IS NOT NULL AS ok, gold, CASE WHEN parsed IS NULL THEN [] ELSE {_CHARTS.format(m='parsed.kpi_chart_mapping')} END AS charts, "
    "CASE WHEN parsed IS NULL THEN [] ELSE list_transform(list_filter(coalesce(parsed.kpi_chart_mapping[1].alternatives, []), lambda a: a IS NOT NULL), lambda a: trim(lower(a), ' ')) END AS others "
    "FROM predictions JOIN gold USING (item_id) WHERE variant = 'original')"
)


@query(
    _SCORED + ", f AS (SELECT method_name, ok, coalesce(gold[1] = charts[1], false) AS hit1, len(others) > 0 AS others, coalesce(gold[1] = charts[1], false) OR list_contains(others, gold[1]) AS hit3, "
    "len(list_filter(range(least(len(gold), len(charts))), lambda i: gold[i + 1] = charts[i + 1])) AS kh, least(len(gold), len(charts)) AS kn FROM s) "
    "SELECT method_name, count(*) AS n, round(100.0 * count(*) FILTER (hit1) / count(*), 2) AS top_1_accuracy, count(*) FILTER (others) / count(*) >= 0.5 AS top_3_valid, "
    "CASE WHEN count(*) FILTER (others) / count(*) >= 0.5 THEN round(100.0 * count(*) FILTER (hit3) / count(*), 2) END AS top_3_accuracy, "
    "round(100.0 * count(*) FILTER (hit3 AND others) / nullif(count(*) FILTER (others), 0), 2) AS top_3_accuracy_supported, round(100.0 * sum(kh) / greatest(sum(kn), 1), 2) AS per_kpi_accuracy, "
    "count(*) FILTER (ok) AS n_predicted, count(*) FILTER (NOT ok) AS n_parse_failures, count(*) FILTER (others) AS n_with_alternatives FROM f GROUP BY method_name"
)
def agg5_topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.topk_accuracy(scored(spark, d), ["method_name"], F.col(MAPPING), F.expr(PARSED))


_F1 = (
    _SCORED + ", c AS (SELECT method_name, gold[1] AS t, coalesce(charts[1], '') AS p FROM s), k AS (SELECT method_name, c, sum(tp) AS tp, sum(pr) AS pr, sum(ac) AS ac FROM "
    "(SELECT method_name, t AS c, CASE WHEN t = p THEN 1 ELSE 0 END AS tp, 0 AS pr, 1 AS ac FROM c UNION ALL SELECT method_name, p, 0, 1, 0 FROM c) GROUP BY 1, 2{w}) "
    "SELECT method_name, round(avg(2.0 * tp / (pr + ac)), 4) AS macro_f1, count(*) AS n_classes, CAST(sum(ac) AS BIGINT) AS n FROM k GROUP BY method_name"
)


@query(_F1.replace("{w}", ""))
def agg6_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_f1(scored(spark, d), ["method_name"], F.col(MAPPING), F.expr(PARSED))


@query(_F1.replace("{w}", " HAVING sum(ac) > 0"))
def agg6_macro_f1_gold(spark: SparkSession, d: str) -> DataFrame:
    """Macro-F1 over the classes of the references only."""
    return metrics.macro_f1(scored(spark, d), ["method_name"], F.col(MAPPING), F.expr(PARSED), labels="gold")


@query(
    "SELECT method_name, model_name, count(*) AS n, round(avg(latency_ms), 1) AS avg_latency_ms, round(avg(latency_ms) / 1000, 3) AS avg_latency_s, round(quantile_cont(latency_ms, 0.5), 1) AS p50_latency_ms, "
    "round(quantile_cont(latency_ms, 0.95), 1) AS p95_latency_ms FROM predictions WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) GROUP BY ALL"
)
def agg7_latency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency(predictions(spark, d), ["method_name", "model_name"])


_FENCED = "regexp_extract(raw_text, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1)"
_SPAN = "regexp_extract(raw_text, '(?s)\\{.*\\}')"
# DuckDB's JSON lets commas stand before closing brackets, which JSON does not.
_STRICT = lambda x: f"json_valid({x}) AND NOT regexp_matches(regexp_replace({x}, '\"(?:[^\"\\\\]|\\\\.)*\"', '0', 'g'), ',\\s*[}}\\]]')"
_OBJECT = f"CASE WHEN {_FENCED} <> '' AND {_STRICT(_FENCED)} THEN {_FENCED} WHEN {_SPAN} <> '' AND {_STRICT(_SPAN)} THEN {_SPAN} END"
_IS = lambda x, key, kind, absent: f"coalesce(json_type({x}, '$.{key}'), '{absent}') = '{kind}'"
_ONE_OF = lambda x, key, values: f"{_IS(x, key, 'VARCHAR', '')} AND json_extract_string({x}, '$.{key}') IN ({', '.join(repr(v) for v in values)})"
_ENTRY = f"json_type(m) = 'OBJECT' AND {_ONE_OF('m', 'task_type', vocab.TASKS)} AND {_ONE_OF('m', 'chart_type', vocab.CHARTS)} AND {_IS('m', 'kpi', 'VARCHAR', 'VARCHAR')} AND {_IS('m', 'alternatives', 'ARRAY', 'ARRAY')} AND {_IS('m', 'encoding', 'OBJECT', 'OBJECT')}"
_REASON = f"json_type(m) = 'OBJECT' AND {_IS('m', 'claim', 'VARCHAR', 'VARCHAR')} AND {_IS('m', 'principle', 'VARCHAR', 'VARCHAR')}"
_EVERY = lambda key, test: f"len(list_filter(json_extract(o, '$.{key}[*]'), lambda m: NOT ({test}))) = 0"
_VALID = " AND ".join(
    [_IS("o", k, "OBJECT", "") for k in ("context_summary", "layout", "styling")] + [_IS("o", k, "ARRAY", "") for k in ("kpi_chart_mapping", "interactions", "rationales")] + [_EVERY("kpi_chart_mapping", _ENTRY), _EVERY("rationales", _REASON)]
)
_FILLED = " + ".join(f"CASE WHEN coalesce(CAST(json_extract(o, '$.{k}') AS VARCHAR), 'null') NOT IN ('null', '[]', '{{}}', '\"\"') THEN 1 ELSE 0 END" for k in vocab.REQUIRED_KEYS)
_ALL_KEYS = " AND ".join(f"json_exists(o, '$.{k}')" for k in vocab.REQUIRED_KEYS)
_COVERED = ", ".join(f"round(100.0 * count(*) FILTER (json_exists(o, '$.{k}')) / count(*), 2) AS coverage_{k}" for k in vocab.REQUIRED_KEYS)


@query(
    f"SELECT method_name, count(*) AS n, round(100.0 * count(o) / count(*), 2) AS json_parse_rate, round(100.0 * count(*) FILTER ({_ALL_KEYS}) / count(*), 2) AS required_keys_rate, "
    f"round(100.0 * count(*) FILTER ({_VALID}) / count(*), 2) AS schema_validity_rate, round(sum({_FILLED}) / (6 * count(*)), 4) AS completeness_score, {_COVERED} FROM (SELECT method_name, {_OBJECT} AS o FROM predictions) GROUP BY method_name"
)
def agg4_schema_compliance(spark: SparkSession, d: str) -> DataFrame:
    return metrics.schema_compliance(predictions(spark, d), ["method_name"])


_WORDS = "list_distinct(regexp_extract_all(lower({t}), '[a-z]{{4,}}'))"


@query(
    "WITH p AS (SELECT method_name, list_distinct(flatten(list_transform(list_filter(retrieved_docs, lambda d: d IS NOT NULL), lambda d: " + _WORDS.format(t="coalesce(d.text, '')") + "))) AS ctx, "
    "list_filter(list_transform(list_filter(coalesce(parsed.rationales, []), lambda r: r IS NOT NULL), lambda r: " + _WORDS.format(t="concat_ws(' ', nullif(r.claim, ''), nullif(r.principle, ''))") + "), lambda c: len(c) > 0) AS claims FROM predictions WHERE len(retrieved_docs) > 0), "
    "s AS (SELECT method_name, len(claims) AS k, len(list_filter(claims, lambda c: len(list_intersect(c, ctx)) / len(c) < 0.2)) / len(claims) AS u FROM p WHERE len(claims) > 0) "
    "SELECT method_name, round(100 * avg(u), 2) AS unsupported_claim_rate, round(100 * (1 - avg(u)), 2) AS supported_claim_rate, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_claims, 'lexical_proxy' AS mode FROM s GROUP BY method_name"
)
def agg8_grounding(spark: SparkSession, d: str) -> DataFrame:
    return metrics.grounding(predictions(spark, d), ["method_name"], F.col("retrieved_docs"), F.col("parsed.rationales"))


@query(
    f"WITH {_GOLD}, l AS (SELECT method_name, item_id, variant, CASE WHEN parsed IS NULL THEN NULL ELSE ({_CHARTS.format(m='parsed.kpi_chart_mapping')})[1] END AS c FROM predictions WHERE variant IN ('original', 'paraphrased') AND item_id IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY method_name, item_id, variant ORDER BY prediction_id DESC) = 1), w AS (SELECT method_name, item_id, max(CASE WHEN variant = 'original' THEN coalesce(c, '') END) AS o, max(CASE WHEN variant = 'paraphrased' THEN coalesce(c, '') END) AS p "
    "FROM l GROUP BY 1, 2), j AS (SELECT w.*, gold[1] AS g FROM w LEFT JOIN gold USING (item_id) WHERE o IS NOT NULL AND p IS NOT NULL) "
    "SELECT method_name, count(*) AS n_shared, count(g) AS n_gold, round(100.0 * count(*) FILTER (o = p AND o <> '') / count(*), 2) AS paraphrase_consistency, round(100.0 * count(*) FILTER (p = g) / nullif(count(g), 0), 2) AS paraphrase_accuracy, "
    "round(100.0 * count(*) FILTER (p = g) / nullif(count(g), 0) - 100.0 * count(*) FILTER (o = g) / nullif(count(g), 0), 2) AS paraphrase_accuracy_delta FROM j GROUP BY method_name"
)
def agg9_robustness(spark: SparkSession, d: str) -> DataFrame:
    gold = metrics.with_reference(predictions(spark, d).filter("item_id IS NOT NULL").select("item_id").distinct(), table(spark, d, "design_outputs"), "item_id", "output_id")
    own = predictions(spark, d).filter("item_id IS NOT NULL")
    return metrics.robustness(own, gold, ["method_name"], "item_id", "variant", "prediction_id", F.col(MAPPING), F.expr(PARSED), ("original", "paraphrased"))


@query(
    f"SELECT method_name, count(*) AS n, round(100.0 * count(*) FILTER (regexp_matches(coalesce(raw_text, ''), '(?i){vocab.CLARIFY.replace(chr(39), chr(39) * 2)}')) / count(*), 2) AS missing_info_clarification_rate, "
    f"round(100.0 * count(*) FILTER ({_ALL_KEYS}) / count(*), 2) AS missing_info_schema_rate FROM (SELECT method_name, raw_text, {_OBJECT} AS o FROM predictions WHERE variant = 'missing_info') GROUP BY method_name"
)
def agg9_missing_info(spark: SparkSession, d: str) -> DataFrame:
    return metrics.missing_info(predictions(spark, d).filter("variant = 'missing_info'"), ["method_name"])


@query(f"SELECT method_name, variant, count(*) AS n, round(100.0 * count(*) FILTER (regexp_matches(coalesce(raw_text, ''), '(?i){vocab.CLARIFY.replace(chr(39), chr(39) * 2)}')) / count(*), 2) AS clarification_rate FROM predictions GROUP BY ALL")
def agg9_clarification(spark: SparkSession, d: str) -> DataFrame:
    """How often the outputs of each variant ask back."""
    own = predictions(spark, d).groupBy("method_name", "variant").agg(F.count("*").alias("n"), metrics.count_of(text.asks_to_clarify(F.col("raw_text"))).alias("asks"))
    return own.select("method_name", "variant", "n", metrics.percent(F.col("asks"), F.col("n")).alias("clarification_rate"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """What all metrics need of each prediction, from one scan in which each text is parsed once."""
    slim = F.transform(MAPPING, lambda m: F.when(m.isNotNull(), F.struct(m["chart_type"].alias("chart_type"), m["alternatives"].alias("alternatives"))))
    read = jsonout.parsed_output("raw_text")
    own = predictions(spark, d).select(
        "prediction_id", "item_id", "method_name", "variant", "latency_ms",
        F.expr(PARSED).alias("ok"),
        slim.alias("mapping"),
        text.asks_to_clarify(F.col("raw_text")).alias("asks"),
        metrics.supported(F.col("retrieved_docs"), F.col("parsed.rationales")).alias("support"),
        F.struct(*[read[c].alias(c) for c in ("object", "keys", "filled_keys", "valid")]).alias("read"),
    )
    # Whether there is an object is all that metrics ask of it.
    return cut(own.withColumn("read", F.struct(F.when(F.col("read.object").isNotNull(), "").alias("object"), *[F.col(f"read.{c}") for c in ("keys", "filled_keys", "valid")])))


@query()
def flagship_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of every method in one row: compliance, accuracy, macro-F1, latency, grounding, robustness."""
    by, own = ["method_name"], facts(spark, d)
    mapping, ok = F.col("mapping"), F.col("ok")
    joined = cut(metrics.with_reference(own.filter("variant = 'original'").select("item_id", *by, "ok", "mapping"), table(spark, d, "design_outputs"), "item_id", "output_id"))
    answered = own.filter("item_id IS NOT NULL").select("prediction_id", "item_id", *by, "variant", "ok", "mapping")
    gold = metrics.with_reference(answered.select("item_id").distinct(), table(spark, d, "design_outputs"), "item_id", "output_id")
    parts = [
        metrics.topk_accuracy(joined, by, mapping, ok),
        metrics.macro_f1(joined, by, mapping, ok),
        metrics.unsupported_rates(own, by, "lexical_proxy"),
        metrics.robustness(answered, gold, by, "item_id", "variant", "prediction_id", mapping, ok, ("original", "paraphrased")),
        metrics.missing_info(own.filter("variant = 'missing_info'"), by, parsed="read"),
        metrics.latency(own, by).drop("n"),
    ]
    out = metrics.schema_compliance(own, by, parsed="read")
    for more in parts:
        out = out.join(F.broadcast(more.select(*by, *[c for c in more.columns if c not in out.columns])), by, "left")  # a row for each method
    return out


@query(
    "WITH r AS (SELECT model_name, method_name, seed, avg(latency_ms) AS v FROM predictions WHERE latency_ms >= 0 AND NOT isnan(latency_ms) GROUP BY ALL) "
    "SELECT model_name, method_name, 'avg_latency_ms' AS name, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, count(v) AS count FROM r WHERE model_name IS NOT NULL AND method_name IS NOT NULL GROUP BY model_name, method_name"
)
def agg11_seed_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Mean latency of each run pooled over seeds."""
    valid = predictions(spark, d).filter("latency_ms >= 0 AND NOT isnan(latency_ms)")
    each = valid.groupBy("model_name", "method_name", "seed").agg(F.avg("latency_ms").alias("v")).withColumn("name", F.lit("avg_latency_ms"))
    out = report.pooled(each, ["model_name", "method_name"], "name", "v")
    return out.select("model_name", "method_name", "name", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "count")


_LONG = "(SELECT rater_id, unit_id, item_id, method, unnest(map_keys(scores)) AS dimension, unnest(map_values(scores)) AS s FROM human_ratings)"


@query(f"SELECT method, CASE WHEN grouping(dimension) = 1 THEN 'overall' ELSE dimension END AS dimension, round(avg(s), 3) AS mean, count(s) AS n FROM {_LONG} GROUP BY GROUPING SETS ((method, dimension), (method))")
def agg13_system_means(spark: SparkSession, d: str) -> DataFrame:
    return metrics.means_by_dimension(human.long_scores(table(spark, d, "human_ratings")), ["method"])


@query("SELECT item_id, method, round(avg(m), 4) AS score FROM (SELECT item_id, method, list_avg(list_filter(map_values(scores), lambda v: v IS NOT NULL)) AS m FROM human_ratings) GROUP BY item_id, method")
def agg14_item_method_scores(spark: SparkSession, d: str) -> DataFrame:
    return human.item_method_scores(table(spark, d, "human_ratings")).select("item_id", "method", F.round("score", 4).alias("score"))


@query("SELECT rater_id, count(*) AS n_ratings, count(DISTINCT unit_id) AS n_units FROM human_ratings GROUP BY rater_id")
def agg3_ratings_by_rater(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "human_ratings").groupBy("rater_id").agg(F.count("*").alias("n_ratings"), F.countDistinct("unit_id").alias("n_units"))


@query("SELECT chart_type, count(*) AS n, (SELECT count(*) FROM mappings) AS total FROM mappings GROUP BY chart_type ORDER BY n DESC, chart_type LIMIT 20")
def agg17_frequent_charts(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most frequent chart values."""
    own = table(spark, d, "mappings")
    total = own.agg(F.count("*").alias("t"))
    return own.groupBy("chart_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("chart_type", "n", F.col("t").alias("total")).orderBy(F.desc("n"), F.asc_nulls_last("chart_type")).limit(20)


@query("SELECT source, min(w) AS shortest, max(w) AS longest, round(avg(w), 4) AS mean, median(w) AS median, round(stddev_samp(w), 4) AS std FROM (SELECT source, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::INTEGER AS w FROM documents WHERE text IS NOT NULL) GROUP BY source")
def agg17_word_counts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").filter("text IS NOT NULL").select("source", F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0))).alias("w"))
    counted = own.groupBy("source", "w").agg(F.count("*").alias("k"))
    n, s, q = F.sum("k"), F.sum(F.col("w") * F.col("k")), F.sum(F.col("w").cast("double") * F.col("w") * F.col("k"))
    return counted.groupBy("source").agg(F.min("w").alias("shortest"), F.max("w").alias("longest"), F.round(s / n, 4).alias("mean"), F.percentile("w", F.lit(0.5), F.col("k")).alias("median"), F.round(F.sqrt((q - s.cast("double") * s / n) / F.nullif(n - 1, F.lit(0))), 4).alias("std"))


@query("WITH r AS (SELECT method_name, variant, round(avg(latency_ms), 2) AS v FROM predictions WHERE latency_ms >= 0 AND NOT isnan(latency_ms) AND variant IN ('original', 'paraphrased') GROUP BY ALL) SELECT method_name, max(CASE WHEN variant = 'original' THEN v END) AS base, max(CASE WHEN variant = 'paraphrased' THEN v END) AS other, round(max(CASE WHEN variant = 'paraphrased' THEN v END) - max(CASE WHEN variant = 'original' THEN v END), 2) AS delta FROM r GROUP BY method_name")
def agg18_differences(spark: SparkSession, d: str) -> DataFrame:
    own = predictions(spark, d).filter("latency_ms >= 0 AND NOT isnan(latency_ms)").groupBy("method_name", "variant").agg(F.round(F.avg("latency_ms"), 2).alias("v"))
    return report.differences(own, ["method_name"], "variant", "original", "paraphrased", "v").withColumn("delta", F.round("delta", 2))


@query("SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events")
def win2_average_ranks(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select("event_id", "event_type", "value")
    return relational.ranked(own, ["event_type"], "value").select("event_id", "rank")


def user_scores(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, method, value): users as items, kinds of events as methods, of users who have them all."""
    means = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    return stats.complete(means, "user_id", "event_type", "v", KINDS)


def user_pairs(spark: SparkSession, d: str, binary: bool = False) -> DataFrame:
    own = user_scores(spark, d)
    if binary:
        own = own.withColumn("value", (F.col("value") > 50).cast("double"))
    return relational.pairs_of(own, "user_id", "method", "value", {k: i for i, k in enumerate(KINDS)})


_KINDS = ", ".join(f"'{k}'" for k in KINDS)
_U = f"m AS (SELECT user_id, event_type AS method, round(avg(value), 6) AS value FROM events WHERE event_type IN ({_KINDS}) GROUP BY ALL), c AS (SELECT user_id FROM m GROUP BY user_id HAVING count(*) = {len(KINDS)}), s AS (SELECT m.* FROM m JOIN c USING (user_id))"
_ORDER = "k(method, o) AS (VALUES " + ", ".join(f"('{k}', {i})" for i, k in enumerate(KINDS)) + ")"
_PAIRS = f"{_U}, {_ORDER}, q AS (SELECT x.method AS a, y.method AS b, x.user_id, {{x}} AS x, {{y}} AS y FROM s x JOIN s y USING (user_id) JOIN k kx ON kx.method = x.method JOIN k ky ON ky.method = y.method WHERE kx.o < ky.o)"
_SCORES, _BINARY = _PAIRS.format(x="x.value", y="y.value"), _PAIRS.format(x="CASE WHEN x.value > 50 THEN 1 ELSE 0 END", y="CASE WHEN y.value > 50 THEN 1 ELSE 0 END")


@query(f"WITH {_BINARY} SELECT a, b, CAST(count(*) FILTER (x = 1 AND y = 0) AS BIGINT) AS n_b, CAST(count(*) FILTER (x = 0 AND y = 1) AS BIGINT) AS n_c FROM q GROUP BY a, b")
def st5_mcnemar_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.mcnemar(user_pairs(spark, d, True)).select("a", "b", "n_b", "n_c")


_MCNEMAR = (
    f"WITH {_BINARY}, mc AS (SELECT a, b, CAST(count(*) FILTER (x = 1 AND y = 0) AS BIGINT) AS n_b, CAST(count(*) FILTER (x = 0 AND y = 1) AS BIGINT) AS n_c FROM q GROUP BY a, b), "
    "mt AS (SELECT *, n_b + n_c AS n, unnest(range(0, least(n_b, n_c) + 1)) AS i FROM mc), "
    "mp AS (SELECT a, b, n_b, n_c, least(1.0, 2 * sum(CASE WHEN n = 0 THEN 1 ELSE exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) END)) AS p FROM mt GROUP BY a, b, n_b, n_c), "
    "mr AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS rn, count(*) OVER () AS m FROM mp), mh AS (SELECT *, least(1.0, max((m - rn + 1) * p) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING)) AS h FROM mr) "
)


def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    own = stats.mcnemar(user_pairs(spark, d, True))
    return own.withColumns({"p_value": F.round("p_value", 6), "p_holm": F.round("p_holm", 6)})


@query(_MCNEMAR + "SELECT a, b, n_b, n_c, CAST(round(p, 6) AS DOUBLE) AS p_value, CAST(round(h, 6) AS DOUBLE) AS p_holm, h < 0.05 AS reject_h0 FROM mh")
def st6_pairwise_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    return mcnemar(spark, d)


@query(_MCNEMAR + "SELECT a, b, CAST(round(h, 6) AS DOUBLE) AS p_holm, h < 0.05 AS reject_h0 FROM mh")
def st12_holm(spark: SparkSession, d: str) -> DataFrame:
    """p-values of the paired outcomes of all pairs, corrected for their number."""
    return mcnemar(spark, d).select("a", "b", "p_holm", "reject_h0")


_RANKED = f"WITH {_SCORES}, d AS (SELECT a, b, round(x - y, 12) AS d FROM q WHERE round(x - y, 12) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS r FROM d), w AS (SELECT a, b, count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS DOUBLE) AS wp, CAST(sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS DOUBLE) AS wm FROM r GROUP BY a, b)"


@query(_RANKED + " SELECT a, b, n, least(wp, wm) AS statistic FROM w")
def st11_wilcoxon_statistic(spark: SparkSession, d: str) -> DataFrame:
    return stats.wilcoxon(user_pairs(spark, d)).select("a", "b", "n", "statistic")


@query()
def st11_pairwise_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return stats.wilcoxon(user_pairs(spark, d))


@query(_RANKED + ", z AS (SELECT a, b, count(*) AS n_pairs, avg(x - y) / nullif(stddev_samp(x - y), 0) AS dz FROM q GROUP BY a, b) SELECT a, b, n_pairs, round(coalesce((wp - wm) / nullif(wp + wm, 0), 0), 4) AS rank_biserial, round(coalesce(dz, 0), 4) AS cohen_dz FROM z LEFT JOIN w USING (a, b)")
def st9_paired_effects(spark: SparkSession, d: str) -> DataFrame:
    return stats.effects(user_pairs(spark, d))


@query(f"WITH {_SCORES}, v AS (SELECT p.a, p.b, avg(CASE WHEN p.x > o.y THEN 1.0 WHEN p.x < o.y THEN -1.0 ELSE 0.0 END) AS e FROM q p JOIN q o ON p.a = o.a AND p.b = o.b GROUP BY ALL) SELECT a, b, round(e, 4) AS delta, CASE WHEN abs(e) < 0.147 THEN 'negligible' WHEN abs(e) < 0.33 THEN 'small' WHEN abs(e) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM v")
def st3_cliffs_delta(spark: SparkSession, d: str) -> DataFrame:
    return stats.cliffs_delta(user_pairs(spark, d))


_CHI = "round(exp(-{x} / 2) * (1 + {x} / 2), 6)"


@query(
    f"WITH {_U}, r AS (SELECT user_id, method, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS r FROM s), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM s GROUP BY user_id, value)), "
    "g AS (SELECT method, sum(r) AS r, count(*) AS n FROM r GROUP BY method), x AS (SELECT (12.0 / (max(n) * 30) * sum(r * r) - 18.0 * max(n)) / (1 - (SELECT ties FROM t) / (max(n) * 120.0)) AS chi2, max(n) AS n FROM g) "
    f"SELECT true AS applicable, CAST(round(chi2, 6) AS DOUBLE) AS chi2, 4 AS df, n, CAST({_CHI.format(x='chi2')} AS DOUBLE) AS p_value FROM x"
)
def st10_friedman(spark: SparkSession, d: str) -> DataFrame:
    return stats.friedman(user_scores(spark, d), "user_id", KINDS).withColumns({"chi2": F.round("chi2", 6), "p_value": F.round("p_value", 6)})


@query(
    f"WITH {_U}, o AS (SELECT user_id, method, CASE WHEN value > 50 THEN 1 ELSE 0 END AS v FROM s), r AS (SELECT user_id, sum(v) AS r FROM o GROUP BY user_id), cc AS (SELECT method, sum(v) AS c FROM o GROUP BY method), "
    "x AS (SELECT CASE WHEN 5 * (SELECT sum(r) FROM r) - (SELECT sum(r * r) FROM r) = 0 THEN 0 ELSE 4 * (5 * (SELECT sum(c * c) FROM cc) - power((SELECT sum(r) FROM r), 2)) / (5 * (SELECT sum(r) FROM r) - (SELECT sum(r * r) FROM r)) END AS q, (SELECT count(*) FROM r) AS n) "
    f"SELECT true AS applicable, CAST(round(q, 6) AS DOUBLE) AS q, 4 AS df, n, CAST({_CHI.format(x='q')} AS DOUBLE) AS p_value FROM x"
)
def st4_cochran_q(spark: SparkSession, d: str) -> DataFrame:
    own = user_scores(spark, d).withColumn("value", (F.col("value") > 50).cast("double"))
    return stats.cochran_q(own, "user_id", KINDS).withColumns({"q": F.round("q", 6), "p_value": F.round("p_value", 6)})


@query()
def st2_bootstrap_differences(spark: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap_difference(user_pairs(spark, d), "user_id")


@query()
def st1_bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    return stats.bootstrap_means(user_scores(spark, d), ["method"], "user_id", "value")


_ALPHA = (
    f"WITH c AS (SELECT dimension, unit_id, s AS v, count(*) AS k FROM {_LONG} WHERE s BETWEEN 1 AND 5 GROUP BY ALL), u AS (SELECT dimension, unit_id, sum(k) AS m FROM c GROUP BY ALL HAVING sum(k) >= 2), "
    "o AS (SELECT x.dimension, x.v AS c, y.v AS k, sum(CASE WHEN x.v = y.v THEN x.k * (x.k - 1) ELSE x.k * y.k END / (m - 1)) AS o FROM c x JOIN c y USING (dimension, unit_id) JOIN u USING (dimension, unit_id) GROUP BY ALL), "
    "n AS (SELECT dimension, c, sum(o) AS n FROM o GROUP BY ALL), g AS (SELECT a.dimension, a.c AS c, b.c AS k, a.n AS nc, b.n AS nk FROM n a JOIN n b USING (dimension)), "
    "d AS (SELECT g.*, {dist} AS d FROM g), "
    "t AS (SELECT d.dimension, sum(coalesce(o.o, 0) * d.d) AS dn, sum(d.nc * d.nk * d.d) AS de, sum(coalesce(o.o, 0)) AS n, count(DISTINCT d.c) AS n_values FROM d LEFT JOIN o ON o.dimension = d.dimension AND o.c = d.c AND o.k = d.k GROUP BY d.dimension) "
    "SELECT dimension, round(1 - (dn / n) / (de / (n * (n - 1))), 4) AS alpha, (SELECT count(*) FROM u WHERE u.dimension = t.dimension) AS n_units, n_values FROM t"
)
_ORDINAL = "CASE WHEN c = k THEN 0.0 ELSE power((SELECT sum(n.n) FROM n WHERE n.dimension = g.dimension AND n.c BETWEEN least(g.c, g.k) AND greatest(g.c, g.k)) - (nc + nk) / 2, 2) END"


def valid_scores(spark: SparkSession, d: str) -> DataFrame:
    return human.long_scores(table(spark, d, "human_ratings")).filter("s BETWEEN 1 AND 5")


@query(_ALPHA.replace("{dist}", _ORDINAL))
def st13_krippendorff(spark: SparkSession, d: str) -> DataFrame:
    return stats.krippendorff(valid_scores(spark, d), ["dimension"], "unit_id", "s")


@query(_ALPHA.replace("{dist}", "CASE WHEN c = k THEN 0.0 ELSE 1.0 END"))
def st13_krippendorff_nominal(spark: SparkSession, d: str) -> DataFrame:
    return stats.krippendorff(valid_scores(spark, d), ["dimension"], "unit_id", "s", "nominal")


@query(_ALPHA.replace("{dist}", "power(c - k, 2)"))
def st13_krippendorff_interval(spark: SparkSession, d: str) -> DataFrame:
    return stats.krippendorff(valid_scores(spark, d), ["dimension"], "unit_id", "s", "interval")


@query(_ALPHA.replace("{dist}", _ORDINAL).replace("SELECT dimension, round(", "SELECT dimension, round(", 1).replace("AS alpha, (SELECT count(*) FROM u WHERE u.dimension = t.dimension) AS n_units, n_values FROM t", f"< {vocab.LOW_ALPHA} AS low_reliability FROM t"))
def prj16_low_reliability(spark: SparkSession, d: str) -> DataFrame:
    return st13_krippendorff(spark, d).select("dimension", stats.low_reliability(F.col("alpha"), vocab.LOW_ALPHA).alias("low_reliability"))


def terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from briefmill.functions.text import query_text

    briefs = table(spark, d, "briefs").select("record_id", query_text(F.col("users"), F.col("goals"), F.col("kpis")).alias("query"))
    return briefs, table(spark, d, "chunks")


_STOP = ", ".join(f"'{w}'" for w in vocab.STOP_WORDS)
_TOKENS = "unnest(list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}'), lambda w: NOT list_contains([" + _STOP + "], w)))"
_QUERY = "trim(concat_ws(' ', nullif(users, ''), nullif(array_to_string(list_filter(goals, lambda g: g IS NOT NULL), ' '), ''), nullif(array_to_string(list_filter(kpis, lambda g: g IS NOT NULL), ' '), '')))"


@query(
    "WITH t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, " + _TOKENS.format(t="text") + " AS term FROM chunks) GROUP BY ALL), i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM chunks)) / (1.0 + count(*))) + 1.0 AS idf FROM t GROUP BY term), "
    "w AS (SELECT id, term, tf * idf AS w FROM t JOIN i USING (term)), n AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY id), "
    "qt AS (SELECT record_id, term, count(*) AS tf FROM (SELECT record_id, " + _TOKENS.format(t=_QUERY) + " AS term FROM briefs) GROUP BY ALL), qw AS (SELECT record_id, term, tf * idf AS w FROM qt JOIN i USING (term)), qn AS (SELECT record_id, sqrt(sum(w * w)) AS l FROM qw GROUP BY record_id), "
    "s AS (SELECT record_id, id, round(sum(qw.w / qn.l * w.w / n.l), 9) AS score FROM qw JOIN qn USING (record_id) JOIN w USING (term) JOIN n USING (id) GROUP BY record_id, id) "
    "SELECT record_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, id DESC) AS rank FROM s) WHERE rank <= 3 AND score > 0"
)
def ret2_tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three best guideline chunks of every brief."""
    briefs, chunks = terms(spark, d)
    return retrieval.tfidf_topk(briefs, chunks, "record_id", "query", "id", "text").drop("score")


_BM25 = (
    "WITH t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, " + _TOKENS.format(t="text") + " AS term FROM chunks) GROUP BY ALL), l AS (SELECT id, sum(tf) AS len FROM t GROUP BY id), g AS (SELECT count(*) AS n, avg(len) AS mean FROM l), df AS (SELECT term, count(*) AS df FROM t GROUP BY term), "
    "w AS (SELECT id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean)) AS w FROM t JOIN l USING (id) JOIN df USING (term), g), "
    "q AS (SELECT DISTINCT record_id, term FROM (SELECT record_id, " + _TOKENS.format(t=_QUERY) + " AS term FROM briefs)), s AS (SELECT record_id, id, round(sum(w), 9) AS score FROM q JOIN w USING (term) GROUP BY record_id, id), "
    "bm AS (SELECT record_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, id DESC) AS rank FROM s) WHERE rank <= 3 AND score > 0)"
)


@query(_BM25 + " SELECT * FROM bm")
def ret_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Beyond the usual retrievers: BM25."""
    briefs, chunks = terms(spark, d)
    return retrieval.bm25_topk(briefs, chunks, "record_id", "query", "id", "text").drop("score")


@query(
    _BM25 + ", tt AS (SELECT term, ln((1.0 + (SELECT count(*) FROM chunks)) / (1.0 + count(*))) + 1.0 AS idf FROM t GROUP BY term), tw AS (SELECT id, term, tf * idf AS w FROM t JOIN tt USING (term)), tn AS (SELECT id, sqrt(sum(w * w)) AS l FROM tw GROUP BY id), "
    "qt AS (SELECT record_id, term, count(*) AS tf FROM (SELECT record_id, " + _TOKENS.format(t=_QUERY) + " AS term FROM briefs) GROUP BY ALL), qw AS (SELECT record_id, term, tf * idf AS w FROM qt JOIN tt USING (term)), qn AS (SELECT record_id, sqrt(sum(w * w)) AS l FROM qw GROUP BY record_id), "
    "ts AS (SELECT record_id, id, round(sum(qw.w / qn.l * tw.w / tn.l), 9) AS score FROM qw JOIN qn USING (record_id) JOIN tw USING (term) JOIN tn USING (id) GROUP BY record_id, id), "
    "tf AS (SELECT record_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, id DESC) AS rank FROM ts) WHERE rank <= 3 AND score > 0), "
    "f AS (SELECT record_id, id, round(sum(1.0 / (rank + 60)), 9) AS score FROM (SELECT record_id, id, rank FROM bm UNION ALL SELECT record_id, id, rank FROM tf) GROUP BY ALL) "
    "SELECT record_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, id DESC) AS rank FROM f) WHERE rank <= 3"
)
def ret_fused_topk(spark: SparkSession, d: str) -> DataFrame:
    """Beyond the usual retrievers: the rankings of TF-IDF and BM25 in one."""
    return retrieval.fused([ret2_tfidf_topk(spark, d), ret_bm25_topk(spark, d)], "record_id", "id", 3).drop("score")


@query(
    "WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))), 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS rank FROM s) SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3 AND score > 0"
)
def ret4_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors of each twentieth, against all."""
    own = table(spark, d, "embeddings")
    asked = own.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_topk(asked, own, "query_id", "vec_id", "embedding", 3, not_itself=True).drop("score")


_DOC = "'[' || i || '] ' || regexp_replace(coalesce(x.source, '') || ' — ' || coalesce(x.heading, ''), '^[ —]+|[ —]+$', '', 'g') || chr(10) || coalesce(x.text, '')"


@query(f"SELECT prediction_id, array_to_string(list_transform(list_filter(retrieved_docs, lambda x: x IS NOT NULL), lambda x, i: {_DOC}), chr(10) || chr(10)) AS block FROM predictions WHERE len(retrieved_docs) > 0")
def ret6_passages(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved passages as a numbered block."""
    from briefmill.functions.text import passages_block

    own = predictions(spark, d).filter(F.size("retrieved_docs") > 0)
    return own.select("prediction_id", passages_block(F.filter("retrieved_docs", lambda x: x.isNotNull())).alias("block"))


#: Six of the raters of human_ratings.
RATERS = [f"rater_{i:05d}" for i in range(6)]
_UNITS = f"u AS (SELECT item_id, method, item_id || '__' || method AS unit_id FROM (SELECT DISTINCT item_id FROM briefs WHERE split = 'test' AND item_id IS NOT NULL), (SELECT unnest([{', '.join(repr(m) for m in METHODS)}]) AS method))"
_ASSIGNED = (
    f"WITH {_UNITS}, n AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || unit_id), unit_id) - 1 AS u FROM u), d AS (SELECT [{', '.join(repr(r) for r in RATERS)}][(u * 3 + j) % 6 + 1] AS rater, unit_id, item_id, method FROM n, range(3) t(j)), "
    "a AS (SELECT rater, CAST(row_number() OVER (PARTITION BY rater ORDER BY md5('42:' || rater || ':' || unit_id), unit_id) AS INTEGER) AS task_order, unit_id, item_id, method FROM d)"
)


@query("WITH u AS (SELECT count(*) AS n FROM (SELECT DISTINCT item_id FROM briefs WHERE split = 'test' AND item_id IS NOT NULL)) SELECT 'rater_0000' || i AS rater, CAST(n * 4 * 3 // 6 + CASE WHEN i < (n * 4 * 3) % 6 THEN 1 ELSE 0 END AS BIGINT) AS n_units FROM u, range(6) t(i)")
def asg1_assignment_loads(spark: SparkSession, d: str) -> DataFrame:
    """Units of the test items dealt to six raters, three for each unit: how many each has."""
    return human.loads(asg1_assignment(spark, d))


@query(_ASSIGNED + " SELECT * FROM a")
def asg1_assignment(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "briefs").filter("split = 'test' AND item_id IS NOT NULL").select("item_id").distinct()
    return human.assignment(human.units(items, METHODS), RATERS, 3)


@query(
    "WITH i AS (SELECT item_id FROM predictions WHERE item_id IS NOT NULL GROUP BY item_id HAVING count(DISTINCT method_name) = 4), r AS (SELECT DISTINCT item_id FROM design_outputs), p AS (SELECT item_id, method_name, raw_text FROM predictions QUALIFY row_number() OVER (PARTITION BY item_id, method_name ORDER BY prediction_id DESC) = 1) "
    "SELECT item_id, count(*) AS n_outputs, CAST(sum(length(raw_text)) AS BIGINT) AS n_chars FROM p WHERE item_id IN (SELECT item_id FROM i) AND item_id IN (SELECT item_id FROM r) GROUP BY item_id"
)
def asg2_eval_items(spark: SparkSession, d: str) -> DataFrame:
    """Items for human evaluation with each method's last output."""
    out = human.eval_items(predictions(spark, d), table(spark, d, "design_outputs").filter("item_id IS NOT NULL"), METHODS)
    return out.select("item_id", F.explode("outputs").alias("method", "raw")).groupBy("item_id").agg(F.count("*").alias("n_outputs"), F.sum(F.length("raw")).alias("n_chars"))


@query(
    _ASSIGNED + ", m AS (SELECT a.*, r.unit_id IS NOT NULL AS done FROM a LEFT JOIN (SELECT DISTINCT rater_id, unit_id FROM human_ratings) r ON a.rater = r.rater_id AND a.unit_id = r.unit_id) "
    "SELECT rater, arg_min(unit_id, task_order) FILTER (NOT done) AS unit_id, min(task_order) FILTER (NOT done) AS task_order, count(*) FILTER (done) AS n_done, count(*) AS n_total FROM m GROUP BY rater HAVING count(*) FILTER (NOT done) > 0"
)
def prj15_next_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Each rater's first unit that human_ratings has no rating of, and how many are done."""
    return human.next_tasks(asg1_assignment(spark, d), table(spark, d, "human_ratings").select("rater_id", "unit_id"))


_LATENCY = "SELECT method_name, round(avg(latency_ms), 1) AS avg_latency_ms, round(avg(latency_ms) / 1000, 3) AS avg_latency_s, round(quantile_cont(latency_ms, 0.5), 1) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 1) AS p95_latency_ms FROM predictions WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) GROUP BY method_name"
_PARTS = {"agg5_topk_accuracy": "method_name, n", "agg6_macro_f1": "method_name, n", "agg8_grounding": "method_name, n", "agg9_robustness": "method_name", "agg9_missing_info": "method_name, n"}
ORACLE["flagship_run_metrics"] = (
    "SELECT a.*, " + ", ".join(f"{name}.* EXCLUDE ({drop})" for name, drop in _PARTS.items()) + f", l.* EXCLUDE (method_name) FROM ({ORACLE['agg4_schema_compliance']}) a "
    + " ".join(f"LEFT JOIN ({ORACLE[name]}) {name} ON a.method_name = {name}.method_name" for name in _PARTS) + f" LEFT JOIN ({_LATENCY}) l ON a.method_name = l.method_name"
)
