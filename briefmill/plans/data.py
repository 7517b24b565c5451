"""Queries of scans, identities, projections, joins and text over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from briefmill.functions import ids, jsonout, text, vocab
from briefmill.operators import human, relational, report
from briefmill.operators.inference import echo, run_inference, training_texts
from briefmill.runtime import lookup_join, small, table
from briefmill.sources import markdown, synthetic

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query under its name, with the SQL that gives the same rows if there is any."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


BUCKET_SQL = "CAST(((CAST(concat('0x', substr(md5({k}), 1, 16)) AS UBIGINT) % 10000) * 1616 + CAST(concat('0x', substr(md5({k}), 17, 16)) AS UBIGINT) % 10000) % 10000 AS INTEGER)"
SPLIT_SQL = "CASE WHEN {b} < 8000 THEN 'train' WHEN {b} < 9000 THEN 'val' ELSE 'test' END"
_B = BUCKET_SQL.format(k="item_id")


@query(f"SELECT record_id, {_B} AS bucket, {SPLIT_SQL.format(b=_B)} AS split_made FROM briefs WHERE item_id IS NOT NULL")
def sc1_hash_split(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "briefs").filter("item_id IS NOT NULL")
    return own.select("record_id", ids.split_bucket(F.col("item_id")).alias("bucket"), ids.split_of(F.col("item_id")).alias("split_made"))


@query(f"SELECT {SPLIT_SQL.format(b=_B)} AS split_made, count(*) AS n, count(DISTINCT item_id) AS n_items FROM briefs WHERE item_id IS NOT NULL GROUP BY 1")
def agg3_split_counts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "briefs").filter("item_id IS NOT NULL").withColumn("split_made", ids.split_of(F.col("item_id")))
    return own.groupBy("split_made").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))


_TEXT = "CASE WHEN {x} IS NULL THEN 'null' ELSE CAST(to_json({x}) AS VARCHAR) END"
_TEXTS = "CASE WHEN {c} IS NULL THEN 'null' ELSE '[' || array_to_string(list_transform({c}, lambda x: " + _TEXT.format(x="x") + "), ', ') || ']' END"
_MAP = "CASE WHEN c IS NULL THEN 'null' ELSE '{' || array_to_string(list_transform(list_sort(map_keys(c)), lambda k: CAST(to_json(k) AS VARCHAR) || ': ' || " + _TEXT.format(x="c[k]") + "), ', ') || '}' END"
_MAPS = "CASE WHEN columns IS NULL THEN 'null' ELSE '[' || array_to_string(list_transform(columns, lambda c: " + _MAP + "), ', ') || ']' END"
_BRIEF = (
    "'{\"columns\": ' || " + _MAPS + " || ', \"constraints\": ' || " + _TEXT.format(x="constraints") + " || ', \"goals\": ' || " + _TEXTS.format(c="goals")
    + " || ', \"kpis\": ' || " + _TEXTS.format(c="kpis") + " || ', \"users\": ' || " + _TEXT.format(x="users") + " || '}'"
)


@query(f"SELECT record_id, 'item_' || substr(md5({_BRIEF}), 1, 8) AS content_id FROM briefs")
def sc2_content_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids from the content of briefs, in canonical JSON."""
    brief = F.to_json(F.struct("users", "goals", "kpis", "columns", "constraints"), {"ignoreNullFields": "false"})
    return table(spark, d, "briefs").select("record_id", ids.content_id(brief).alias("content_id"))


@query("SELECT id, source || '_' || substr(md5(heading || chr(10) || text), 1, 8) AS made FROM chunks")
def sc4_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", ids.chunk_id(F.col("source"), F.concat("heading", F.lit("\n"), "text")).alias("made"))


@query("SELECT item_id, record_id, source FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY record_id) AS rn FROM briefs) WHERE rn = 1")
def src5_pool_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return relational.pool([table(spark, d, "briefs")], "item_id", "record_id").select("item_id", "record_id", "source")


@query(
    "WITH p AS (SELECT item_id, record_id, CASE source WHEN 'gold_main' THEN 0 WHEN 'legacy_a' THEN 1 ELSE 2 END AS s FROM briefs WHERE source IN ('gold_main', 'legacy_a', 'legacy_b')) "
    "SELECT item_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s, record_id) AS rn FROM p) WHERE rn = 1"
)
def set1_union_of_sources(spark: SparkSession, d: str) -> DataFrame:
    """Three sources put together in order, the first row of an id kept."""
    own = table(spark, d, "briefs").select("item_id", "record_id", "source")
    return relational.pool([own.filter(F.col("source") == s) for s in ("gold_main", "legacy_a", "legacy_b")], "item_id", "record_id").select("item_id", "record_id")


@query("SELECT item_id, method_name, prediction_id, CASE WHEN NOT isnan(latency_ms) THEN latency_ms END AS latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY item_id, method_name ORDER BY prediction_id DESC) AS rn FROM predictions) WHERE rn = 1")
def agg2_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last prediction of each item and method; a latency that is no number is null."""
    own = table(spark, d, "predictions").select("item_id", "method_name", "prediction_id", F.when(~F.isnan("latency_ms"), F.col("latency_ms")).alias("latency_ms"))
    return relational.last_wins(own, ["item_id", "method_name"], ["prediction_id"])


@query("SELECT record_id, item_id, source FROM briefs WHERE split = 'test'")
def prj1_split_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "briefs").filter("split = 'test'").select("record_id", "item_id", "source")


@query("SELECT record_id, item_id FROM briefs WHERE split = 'test' ORDER BY record_id LIMIT 10")
def prj2_first_n(spark: SparkSession, d: str) -> DataFrame:
    """The first ten test briefs in order, for a dry run."""
    return table(spark, d, "briefs").filter("split = 'test'").orderBy("record_id").limit(10).select("record_id", "item_id")


@query("SELECT record_id, CAST(NULL AS VARCHAR) AS constraints, CASE WHEN len(kpis) > 1 THEN kpis[:-2] ELSE kpis END AS kpis, len(CASE WHEN len(columns) > 1 THEN columns[:-2] ELSE columns END)::INTEGER AS n_columns FROM briefs")
def prj6_drop_info(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "briefs")
    return own.select("record_id", F.lit(None).cast("string").alias("constraints"), text.all_but_last(F.col("kpis")).alias("kpis"), F.size(text.all_but_last(F.col("columns"))).alias("n_columns"))


_SWAP = "list_aggregate(list_transform(regexp_extract_all({t}, '([A-Za-z]+|[^A-Za-z]+)'), lambda w: CASE " + "".join(
    f"WHEN lower(w) = '{a}' THEN CASE WHEN regexp_full_match(w, '[A-Z][a-z]*') THEN '{b.title()}' WHEN regexp_full_match(w, '[A-Z]+') THEN '{b.upper()}' ELSE '{b}' END " for a, b in vocab.SYNONYMS.items()
) + "ELSE w END), 'string_agg', '')"


@query(f"SELECT record_id, CASE WHEN users = '' THEN users ELSE {_SWAP.format(t='users')} END AS users, CASE WHEN constraints = '' THEN constraints ELSE {_SWAP.format(t='constraints')} END AS constraints, list_transform(goals, lambda g: {_SWAP.format(t='g')}) AS goals FROM briefs")
def prj7_paraphrase(spark: SparkSession, d: str) -> DataFrame:
    """Briefs reworded by swapping synonyms."""
    return table(spark, d, "briefs").select("record_id", text.paraphrased(F.col("users")).alias("users"), text.paraphrased(F.col("constraints")).alias("constraints"), F.transform("goals", lambda g: text.paraphrased(g)).alias("goals"))


@query("SELECT output_id, k AS name, CASE json_type(context_summary, '$.' || k) WHEN 'VARCHAR' THEN json_extract_string(context_summary, '$.' || k) END AS value FROM (SELECT output_id, context_summary, unnest(json_keys(context_summary)) AS k FROM design_outputs WHERE json_valid(context_summary) AND json_type(CASE WHEN json_valid(context_summary) THEN context_summary ELSE 'null' END) = 'OBJECT')")
def prj9_flatten(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of each context summary by dotted name."""
    return report.key_values(table(spark, d, "design_outputs"), "output_id", "context_summary")


@query("SELECT method_name, count(*) AS n, count(*) FILTER (len(retrieved_docs) > 0) AS n_with_docs FROM predictions GROUP BY method_name")
def prj11_with_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").groupBy("method_name").agg(F.count("*").alias("n"), F.sum(F.when(F.size("retrieved_docs") > 0, 1).otherwise(0)).alias("n_with_docs"))


@query("SELECT id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> ''))::INTEGER AS n_words FROM chunks WHERE len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) > 5")
def prj14_long_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", text.token_count(F.col("text")).alias("n_words")).filter("n_words > 5")


@query("SELECT b.record_id, b.item_id FROM briefs b WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE coalesce(p.item_id, '') = coalesce(b.item_id, '') AND p.method_name = 'rag')")
def jn2_resume(spark: SparkSession, d: str) -> DataFrame:
    """Briefs that the method rag has no prediction for."""
    done = table(spark, d, "predictions").filter("method_name = 'rag'")
    return relational.resume(table(spark, d, "briefs").select("record_id", "item_id"), done, ["item_id"])


@query("SELECT p.prediction_id, coalesce(b.users, '(brief unavailable)') AS users FROM predictions p LEFT JOIN (SELECT item_id, arg_max(users, record_id) FILTER (true) AS users FROM (SELECT * FROM briefs QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY record_id DESC) = 1) GROUP BY item_id) b ON p.item_id = b.item_id")
def jn3_brief_text(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with their brief's users, the last brief winning, or a stand-in."""
    briefs = relational.last_wins(table(spark, d, "briefs").select("item_id", "users", "record_id"), ["item_id"], ["record_id"])
    own = table(spark, d, "predictions").select("prediction_id", "item_id")
    return lookup_join(own, briefs.filter("item_id IS NOT NULL"), ["item_id"], "left").select("prediction_id", F.coalesce("users", F.lit("(brief unavailable)")).alias("users"))


_METHODS = ["prompt_only", "rag", "ft", "ft_rag"]


@query("SELECT item_id FROM predictions WHERE item_id IS NOT NULL GROUP BY item_id HAVING count(DISTINCT method_name) = 4")
def jn6_matched_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that every method has answered."""
    return relational.in_all(table(spark, d, "predictions"), "item_id", "method_name", len(_METHODS))


@query("SELECT item_id FROM (SELECT item_id FROM predictions WHERE method_name = 'ft' INTERSECT SELECT item_id FROM design_outputs) WHERE item_id IS NOT NULL")
def set2_intersection(spark: SparkSession, d: str) -> DataFrame:
    answered = table(spark, d, "predictions").filter("method_name = 'ft' AND item_id IS NOT NULL").select("item_id")
    return answered.intersect(table(spark, d, "design_outputs").select("item_id"))


@query(f"SELECT DISTINCT b.item_id, m.method, b.item_id || '__' || m.method AS unit_id FROM briefs b, (SELECT unnest([{quoted(_METHODS)}]) AS method) m WHERE b.item_id IS NOT NULL AND b.split = 'test'")
def jn7_units(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "briefs").filter("split = 'test' AND item_id IS NOT NULL").select("item_id").distinct()
    return human.units(items, _METHODS)


@query("SELECT output_id, CAST(len(list_filter(range(least(len(kpi_chart_mapping), len(interactions))), lambda i: kpi_chart_mapping[i + 1] IS NOT NULL AND interactions[i + 1] IS NOT NULL)) AS INTEGER) AS n_pairs FROM design_outputs WHERE kpi_chart_mapping IS NOT NULL AND interactions IS NOT NULL")
def jn10_positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Mappings and interactions side by side, as far as both go."""
    own = table(spark, d, "design_outputs").filter("kpi_chart_mapping IS NOT NULL AND interactions IS NOT NULL")
    pairs = relational.zipped(F.col("kpi_chart_mapping"), F.col("interactions"))
    return own.select("output_id", F.size(F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())).alias("n_pairs"))


@query("SELECT a.record_id, coalesce(b.item_id, 'none') AS item_id FROM (SELECT record_id, row_number() OVER (ORDER BY record_id) AS pos FROM briefs WHERE split = 'test') a LEFT JOIN (SELECT item_id, row_number() OVER (ORDER BY record_id) AS pos FROM briefs WHERE split = 'val') b USING (pos)")
def jn11_positional_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one split keyed by those of another at the same place; places are numbered by ranges, not in one task."""
    own = table(spark, d, "briefs")
    ends = own.agg(F.min("record_id").alias("low"), F.max("record_id").alias("high")).first()
    # Ten thousand ranges of ids at most, however many ids there are.
    width = max(10_000, ((ends.high or 0) - (ends.low or 0)) // 10_000 + 1)

    def numbered(split: str) -> DataFrame:
        df = own.filter(F.col("split") == split).select("record_id", "item_id").withColumn("range", F.floor(F.col("record_id") / width))
        sizes = df.groupBy("range").agg(F.count("*").alias("n"))
        start = sizes.select("range", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("n")).alias("start"))
        return df.join(small(start), "range").select("record_id", "item_id", (F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("record_id"))).alias("at"))

    a, b = numbered("test").select("record_id", "at"), numbered("val").select("item_id", "at")
    return a.join(b, "at", "left").select("record_id", F.coalesce("item_id", F.lit("none")).alias("item_id"))


@query(
    "WITH n AS (SELECT source, heading, text, row_number() OVER (PARTITION BY source ORDER BY '# ' || heading || chr(10) || text) AS ord FROM chunks), c AS (SELECT *, '# ' || trim(heading) || chr(10) || trim(text, chr(10) || ' ') AS body FROM n) "
    "SELECT source || '_' || substr(md5(body), 1, 8) AS id, source, trim(heading) AS heading, body AS text, ord FROM c WHERE len(list_filter(regexp_split_to_array(trim(body), '\\s+'), lambda x: x <> '')) > 5"
)
def win1_chunking(spark: SparkSession, d: str) -> DataFrame:
    """Guideline chunks written as Markdown and cut again at their headings."""
    one = F.concat(F.lit("# "), "heading", F.lit("\n"), "text")
    pages = table(spark, d, "chunks").groupBy("source").agg(F.array_join(F.sort_array(F.collect_list(one)), "\n\n").alias("text"))
    return markdown.chunks(pages)


@query("SELECT record_id, trim(concat_ws(' ', nullif(users, ''), nullif(array_to_string(list_filter(goals, lambda g: g IS NOT NULL), ' '), ''), nullif(array_to_string(list_filter(kpis, lambda g: g IS NOT NULL), ' '), ''))) AS query FROM briefs")
def ret5_query_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "briefs").select("record_id", text.query_text(F.col("users"), F.col("goals"), F.col("kpis")).alias("query"))


_MESSAGE = (
    "'" + vocab.USER_OPENING + "' || chr(10) || chr(10) || '**Users:** ' || coalesce(users, 'N/A') || chr(10) || '**Goals:** ' || CASE WHEN goals IS NULL OR len(goals) = 0 THEN 'N/A' ELSE array_to_string(list_filter(goals, lambda g: g IS NOT NULL), ', ') END"
    " || chr(10) || '**KPIs:** ' || CASE WHEN kpis IS NULL OR len(kpis) = 0 THEN 'N/A' ELSE array_to_string(list_filter(kpis, lambda g: g IS NOT NULL), ', ') END"
    " || chr(10) || '**Data columns:** ' || CASE WHEN columns IS NULL OR len(columns) = 0 THEN 'N/A' ELSE array_to_string(list_transform(columns, lambda c: coalesce(c['name'], '?') || ' (' || coalesce(c['dtype'], '?') || ')'), ', ') END"
    " || chr(10) || '**Constraints:** ' || coalesce(nullif(constraints, ''), 'None') || chr(10) || chr(10) || '" + vocab.USER_KEYS + "' || chr(10) || '" + "' || chr(10) || '".join(f"  {i}. {k}" for i, k in enumerate(vocab.REQUIRED_KEYS, 1))
    + "' || chr(10) || chr(10) || '" + vocab.USER_MAPPING + f"' || chr(10) || 'Allowed task_type values: {', '.join(vocab.TASKS)}.' || chr(10) || 'Allowed chart_type values: {', '.join(vocab.CHARTS)}.' || chr(10) || '{vocab.USER_RATIONALES}'"
)


@query(f"SELECT record_id, md5({_MESSAGE}) AS message_md5, length({_MESSAGE}) AS n_chars FROM briefs")
def sc5_user_message(spark: SparkSession, d: str) -> DataFrame:
    """The user's turn of the prompt for each brief."""
    own = table(spark, d, "briefs")
    message = text.user_message(*[F.col(c) for c in ("users", "goals", "kpis", "columns", "constraints")])
    return own.select("record_id", F.md5(message).alias("message_md5"), F.length(message).cast("bigint").alias("n_chars"))


@query()
def sc7_training_text(spark: SparkSession, d: str) -> DataFrame:
    """Training examples: prompt of a brief and the output of its item as answer."""
    briefs = relational.last_wins(table(spark, d, "briefs").filter("item_id IS NOT NULL"), ["item_id"], ["record_id"])
    gold = relational.last_wins(table(spark, d, "design_outputs").filter("item_id IS NOT NULL"), ["item_id"], ["output_id"])
    answer = F.to_json(F.struct("context_summary", "kpi_chart_mapping", "layout", "styling", "interactions", "rationales"), {"ignoreNullFields": "false", "pretty": "true"})
    return training_texts(briefs, gold, "item_id", answer, ["split"])


@query("SELECT prediction_id, regexp_matches(coalesce(raw_text, ''), '(?i)" + vocab.CLARIFY.replace("'", "''") + "') AS asks FROM predictions")
def sc16_clarify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("prediction_id", text.asks_to_clarify(F.col("raw_text")).alias("asks"))


def _enum_sql(column: str, valid: list[str], aliases: dict[str, str]) -> str:
    s = f"lower(trim({column}, ' '))"
    cases = "".join(f"WHEN {s} = '{v}' THEN '{v}' " for v in valid) + "".join(f"WHEN {s} = '{a}' THEN '{v}' " for a, v in aliases.items())
    cases += "".join(f"WHEN starts_with({s}, '{v}') OR starts_with('{v}', {s}) THEN '{v}' " for v in valid)
    return f"CASE WHEN {column} IS NULL THEN NULL {cases}END"


@query(f"SELECT mapping_id, {_enum_sql('task_type', vocab.TASKS, vocab.TASK_ALIASES)} AS task, {_enum_sql('chart_type', vocab.CHARTS, vocab.CHART_ALIASES)} AS chart FROM mappings")
def sc22_normalised_values(spark: SparkSession, d: str) -> DataFrame:
    """Tasks and charts repaired by alias and prefix."""
    return table(spark, d, "mappings").select("mapping_id", text.normal_enum(F.col("task_type"), vocab.TASKS, vocab.TASK_ALIASES).alias("task"), text.normal_enum(F.col("chart_type"), vocab.CHARTS, vocab.CHART_ALIASES).alias("chart"))


_KEYWORDS = "CASE " + "".join(f"WHEN {' OR '.join(f'contains(lower(kpi), {chr(39)}{k}{chr(39)})' for k in keys)} THEN '{task}' " for keys, task in vocab.KEYWORD_TASK) + "END"


@query(f"SELECT mapping_id, {_KEYWORDS} AS task FROM mappings")
def sc26_keyword_task(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mappings").select("mapping_id", text.keyword_task(F.col("kpi")).alias("task"))


@query()
def sc21_parsed_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Raw texts parsed again: keys found, validity, charts and error."""
    p = jsonout.parsed_output(F.col("raw_text"))
    own = table(spark, d, "predictions").select("prediction_id", p.alias("p"))
    return own.select("prediction_id", F.col("p.error").alias("error"), F.size("p.keys").alias("n_keys"), F.size("p.filled_keys").alias("n_filled"), F.col("p.valid").alias("valid"), F.col("p.mapping.chart_type").alias("charts"))


_LAST = "(SELECT * FROM briefs WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY record_id DESC) = 1)"
_JOINED = "coalesce(array_to_string(list_filter({c}, lambda g: g IS NOT NULL), ', '), '')"
_LINE = f"'Users: ' || coalesce(users, '') || chr(10) || 'Goals: ' || {_JOINED.format(c='goals')} || chr(10) || 'KPIs: ' || {_JOINED.format(c='kpis')} || chr(10) || 'Constraints: ' || coalesce(constraints, 'None')"
_HEADS = [f"'{p}'".replace(chr(10), "' || chr(10) || '") for p in (vocab.JUDGE_OPENING, *vocab.JUDGE_PARTS)]
_DIMENSIONS = " || chr(10) || ".join(f"'- {d}'" for d in vocab.RUBRIC)


@query(f"SELECT p.prediction_id, {_HEADS[0]} || {_HEADS[1]} || {_DIMENSIONS} || {_HEADS[2]} || coalesce(b.brief, '(brief unavailable)') || {_HEADS[3]} || coalesce(p.raw_text, '') || {_HEADS[4]} AS prompt FROM predictions p LEFT JOIN (SELECT item_id, {_LINE} AS brief FROM {_LAST}) b ON p.item_id = b.item_id")
def sc17_judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a judge is asked about each prediction; an item that many predictions answer is salted."""
    briefs = relational.last_wins(table(spark, d, "briefs").filter("item_id IS NOT NULL"), ["item_id"], ["record_id"])
    line = briefs.select("item_id", text.brief_line(*[F.col(c) for c in ("users", "goals", "kpis", "constraints")]).alias("brief"))
    own = table(spark, d, "predictions").select("prediction_id", "item_id", "raw_text")
    return lookup_join(own, line, ["item_id"], "left").select("prediction_id", text.judge_prompt(F.col("brief"), F.col("raw_text"), list(vocab.RUBRIC)).alias("prompt"))


@query()
def sc25_rendered_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Outputs as raters see them."""
    own = table(spark, d, "predictions").select("prediction_id", "raw_text", jsonout.parsed_output("raw_text").alias("parsed"))
    return own.select("prediction_id", jsonout.rendered(F.col("parsed"), F.col("raw_text")).alias("markdown"))


@query()
def src12_synthetic_gold(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic gold items with their ids and splits."""
    made = synthetic.generate(spark, 600)
    return made.select("index", ids.content_id("brief").alias("item_id"), "brief", "recommendation").withColumn("split", ids.split_of(F.col("item_id")))


@query()
def inf1_inference(spark: SparkSession, d: str) -> DataFrame:
    """Test briefs without a prediction, answered by the stand-in method and parsed."""
    briefs = relational.first_wins(table(spark, d, "briefs").filter("split = 'test' AND item_id IS NOT NULL"), ["item_id"], ["record_id"])
    made = run_inference(briefs, table(spark, d, "predictions").filter("method_name = 'rag'").select("item_id").distinct(), echo(), ["item_id"])
    return made.select("item_id", "raw_text", "parse_error", F.col("parsed.valid").alias("valid"), F.size("parsed.mapping").alias("n_charts"))
