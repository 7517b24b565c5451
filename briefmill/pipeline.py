"""Stages from raw files to reports: data, knowledge base, perturbations, inference, evaluation, statistics, human evaluation."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefmill.config import GROUPS, get
from briefmill.functions import text, vocab
from briefmill.operators import human, metrics, report, stats
from briefmill.operators.evaluation import Run, evaluated, judged
from briefmill.operators.inference import Generate, generated, latest_results, prompts, reparsed, training_texts, with_passages
from briefmill.operators.registry import METHODS, RETRIEVERS
from briefmill.operators.relational import pairs_of, resume
from briefmill.runtime import cut
from briefmill.sources import files, gold, jsonl, markdown, sinks, synthetic

LEGACY = ["train.jsonl", "val.jsonl", "test.jsonl"]
KEYS = ["item_id", "variant", "config_hash"]
BRIEF = "users string, goals array<string>, kpis array<string>, columns array<map<string,string>>, constraints string"
WISH = "context_summary string, kpi_chart_mapping array<struct<kpi:string,task_type:string,chart_type:string,alternatives:array<string>,encoding:string>>, layout string, styling string, interactions array<string>, rationales array<struct<claim:string,principle:string>>"
#: What the report shows of each run, by the end of the metric's name.
REPORTED = ["json_parse_rate", "schema_validity_rate", "completeness_score", "top_1_accuracy", "top_3_accuracy", "macro_f1", "unsupported_claim_rate", "paraphrase_consistency", "avg_latency_s", "overall"]
RESULT = "item_id string, variant string, config_hash string, method_name string, model_name string, seed int, raw_text string, latency_ms double, retrieved_docs array<struct<rank:int,id:string,source:string,heading:string,text:string,score:double>>, written_at timestamp"


def generate_dataset(spark: SparkSession, out: str, n: int = 600, seed: int = 42) -> None:
    line = F.concat(F.lit('{"brief": '), "brief", F.lit(', "recommendation": '), "recommendation", F.lit("}"))
    synthetic.generate(spark, n, seed).select(line.alias("value")).write.mode("overwrite").text(out)


def canonical_records(items: DataFrame) -> DataFrame:
    """Gold items as typed records: file, line, item_id, split, brief and recommendation."""
    return items.select("source_file", "line_no", "item_id", "split", F.from_json("brief", BRIEF).alias("brief"), F.from_json("recommendation", WISH).alias("recommendation"))


def build_data(spark: SparkSession, raw: str, out: str) -> dict[str, int]:
    """Gold items of a folder, deduplicated and dealt into splits; rows of each split."""
    canonical_records(gold.gold_or_legacy(spark, raw, LEGACY)).write.mode("overwrite").partitionBy("split").parquet(out)
    return {r.split: r["count"] for r in spark.read.parquet(out).groupBy("split").count().collect()}


def build_training(spark: SparkSession, items: DataFrame, out: str, end: str = "\n") -> dict[str, int]:
    """Supervised examples of the train and val splits, as JSON lines for a trainer; rows of each split."""
    answer = F.to_json("recommendation", {"ignoreNullFields": "false", "pretty": "true"})
    briefs = items.filter("split IN ('train', 'val')").select("item_id", "split", "brief.*")
    jsonl.write_jsonl(training_texts(briefs, items, "item_id", answer, ["split"], end=end), out)
    return {r.split: r["count"] for r in spark.read.schema("split string").json(out).groupBy("split").count().collect()}


def build_kb(spark: SparkSession, guidelines: str, out: str) -> int:
    """Chunks of the guidelines; raises if there are none."""
    markdown.chunks(markdown.read_markdown(spark, guidelines)).write.mode("overwrite").parquet(out)
    n = spark.read.parquet(out).count()
    if not n:
        raise ValueError(f"no chunks in {guidelines}")
    return n


def perturbed(items: DataFrame, how: str) -> DataFrame:
    """Items with reworded or reduced briefs, under their own item_id."""
    b = F.col("brief")
    if how == "paraphrased":
        swap = lambda x: text.paraphrased(x)
        made = b.withField("users", swap(b["users"])).withField("constraints", swap(b["constraints"])).withField("goals", F.transform(b["goals"], swap)).withField("kpis", F.transform(b["kpis"], swap))
    elif how == "missing_info":
        made = b.withField("constraints", F.lit(None).cast("string")).withField("kpis", text.all_but_last(b["kpis"])).withField("columns", text.all_but_last(b["columns"]))
    else:
        made = b
    return items.withColumn("brief", made).withColumn("variant", F.lit(how))


def test_briefs(items: DataFrame, config: dict[str, Any], variants: list[str]) -> DataFrame:
    """The test briefs in every variant, the first ``max_samples`` items by id if that is set."""
    test = items.filter("split = 'test'")
    if most := get(config, "data.max_samples"):
        test = test.join(test.select("item_id").orderBy("item_id").limit(most), "item_id", "left_semi")
    out = None
    for v in variants:
        part = perturbed(test, v).select("item_id", "variant", F.lit(config["config_hash"]).alias("config_hash"), "brief.*")
        out = part if out is None else out.unionByName(part)
    return out


def infer(spark: SparkSession, items: DataFrame, chunks: DataFrame | None, config: dict[str, Any], generate: Callable[[], Generate], out: str, variants: list[str] | None = None) -> int:
    """Answers what ``out`` does not hold yet and appends it, errors beside it; the number of new rows."""
    method = METHODS.get(get(config, "method.name"))(generate, adapter_path=get(config, "method.adapter_path"))
    briefs = test_briefs(items, config, variants or ["original", "paraphrased", "missing_info"])
    done = spark.read.schema(RESULT).parquet(out).select(*KEYS) if files.exists(out) else None
    todo = cut(resume(briefs, done, KEYS) if done is not None else briefs)
    asked = prompts(todo, KEYS)
    if method.passages and chunks is None:
        raise ValueError(f"the method {get(config, 'method.name')} needs chunks")
    if method.passages:
        name = get(config, "method.retriever") or "tfidf"
        options = get(config, "retriever", {}) if get(config, "retriever_name") == name else {}
        key = F.concat_ws("|", *KEYS)
        queries = todo.select(key.alias("q"), text.query_text(F.col("users"), F.col("goals"), F.col("kpis")).alias("t"))
        hits = RETRIEVERS.get(name)(queries, chunks, "q", "t", "id", "text", get(config, "method.top_k", 3), **options)
        asked = with_passages(asked.withColumn("q", key), hits, chunks, "q").drop("q")
    else:
        asked = asked.withColumn("retrieved_docs", F.lit(None).cast("array<struct<rank:int,id:string,source:string,heading:string,text:string,score:double>>"))
    made = cut(generated(asked, method, KEYS))
    named = made.join(asked.select(*KEYS, "retrieved_docs"), KEYS).withColumns({"method_name": F.lit(get(config, "method.name")), "model_name": F.lit(config["model"]), "seed": F.lit(config["seed"]), "written_at": F.current_timestamp()})
    sinks.split_errors(named.select(*[x.split()[0] for x in RESULT.split(", ")], "error"), out, f"{out}_errors", KEYS)
    return made.count()


def evaluate(spark: SparkSession, items: DataFrame, results: str, config: dict[str, Any] | None = None, judge_setup: Callable[[], Generate] | None = None) -> DataFrame:
    """(method_name, model_name, seed, name, value): the metrics that the configuration names, in long form; all but those of a judge
    without one. Of results written again the last written counts. Raises if there are no predictions."""
    if not files.exists(results):
        raise FileNotFoundError(f"no predictions in {results}")
    by = ["method_name", "model_name", "seed"]
    rows = latest_results(spark.read.schema(RESULT).parquet(results), [*by, "item_id", "variant"], ["written_at", "config_hash", "latency_ms", "raw_text"])
    names = get(config or {}, "eval.metrics") or GROUPS["eval"]["full"]["metrics"]
    return evaluated(Run(cut(reparsed(rows)), items, by, judge_setup), names)


def aggregate(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Metrics of all runs as a table of runs and pooled over seeds, as CSV and Markdown; raises if there are no runs."""
    long = gold.runs(spark, root)
    if long.isEmpty():
        raise ValueError(f"no runs in {root}")
    named = long.groupBy("run").agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in ("model", "method")])
    measured = cut(long.filter("name LIKE 'metrics.%'").join(named, "run"))
    pooled = report.pooled(measured, ["model", "method"], "name", "value")
    rows = [r.asDict() for r in pooled.orderBy("model", "method", "name").collect()]
    columns = ["model", "method", "name", "mean", "std", "count"]
    sinks.write_csv_file(rows, columns, f"{out}/aggregate_seeds.csv")
    # Runs side by side: a row for each run, a column for each metric; the report shows one column for each thing that is asked for.
    runs: dict[str, dict[str, Any]] = {}
    for r in measured.orderBy("run", "name").collect():
        runs.setdefault(r.run, {"run": r.run, "model": r.model, "method": r.method})[r.name] = r.value
    names = sorted({k for row in runs.values() for k in row} - {"run", "model", "method"})
    sinks.write_csv_file(list(runs.values()), ["run", "model", "method", *names], f"{out}/comparison.csv")
    shown = {needle: name for needle in REPORTED if (name := report.select_metric(names, needle))}
    table = [{**{k: row[k] for k in ("run", "model", "method")}, **{n: report.as_number(row.get(c)) for n, c in shown.items()}} for row in runs.values()]
    sections = {"Runs": (table, ["run", "model", "method", *shown]), "Pooled over seeds": (rows, columns)}
    sinks.write_report("Results", sections, f"{out}/report.md")
    return pooled


def compare(scores: DataFrame, methods: list[str], item: str = "item_id") -> dict[str, DataFrame]:
    """Paired statistics of (item, method, value) on the items that every method has; raises if there are none."""
    own = cut(stats.complete(scores, item, "method", "value", methods))
    if own.isEmpty():
        raise ValueError("no item has a value of every method")
    pairs = cut(pairs_of(own, item, "method", "value", {m: i for i, m in enumerate(methods)}))
    return {"friedman": stats.friedman(own, item, methods), "wilcoxon": stats.wilcoxon(pairs), "effects": stats.effects(pairs), "cliffs_delta": stats.cliffs_delta(pairs), "bootstrap": stats.bootstrap_difference(pairs, item)}


def compare_outcomes(outcomes: DataFrame, methods: list[str], item: str = "item_id") -> dict[str, DataFrame]:
    """As ``compare`` for 0/1 outcomes."""
    own = cut(stats.complete(outcomes, item, "method", "value", methods))
    if own.isEmpty():
        raise ValueError("no item has an outcome of every method")
    pairs = pairs_of(own, item, "method", "value", {m: i for i, m in enumerate(methods)})
    return {"cochran_q": stats.cochran_q(own, item, methods), "mcnemar": stats.mcnemar(pairs)}


def experiment_stats(results: DataFrame, references: DataFrame, methods: list[str]) -> dict[str, DataFrame]:
    """Top-1 outcomes and completeness of several experiments on matched items."""
    own = cut(reparsed(results.filter("variant = 'original'")))
    joined = metrics.with_reference(own, references, "item_id", "o")
    first = F.try_element_at(metrics.charts(F.col("parsed.mapping")), F.lit(1))
    hit = joined.select("item_id", F.col("method_name").alias("method"), F.coalesce((first == F.col("gold")[0]).cast("int"), F.lit(0)).alias("value"))
    filled = own.select("item_id", F.col("method_name").alias("method"), (F.size("parsed.filled_keys") / len(vocab.REQUIRED_KEYS)).alias("value"))
    one = lambda df: df.groupBy("item_id", "method").agg(F.max("value").alias("value"))
    return compare_outcomes(one(hit), methods) | compare(one(filled), methods)


def human_stats(ratings: DataFrame) -> dict[str, DataFrame]:
    """Reliability for each dimension, system means, and paired statistics where at least two items have all methods."""
    if ratings.isEmpty():
        raise ValueError("no ratings")
    long = human.long_scores(ratings).filter(F.col("s").between(*vocab.LIKERT))
    out = {"alpha": stats.krippendorff(long, ["dimension"], "unit_id", "s"), "means": metrics.means_by_dimension(long, ["method"])}
    out["alpha"] = out["alpha"].withColumn("low_reliability", stats.low_reliability(F.col("alpha"), vocab.LOW_ALPHA))
    methods = [r.method for r in ratings.select("method").distinct().orderBy("method").collect()]
    scores = human.item_method_scores(ratings).withColumnRenamed("score", "value")
    if len(methods) >= 2 and stats.complete(scores, "item_id", "method", "value", methods).select("item_id").distinct().count() >= 2:
        out |= compare(scores, methods)
    return out


def human_eval(predictions: DataFrame, references: DataFrame, methods: list[str], out: str, n_items: int = 60, raters: list[str] | None = None, per_unit: int = 3, seed: int = 42) -> None:
    """Items and assignment of a human evaluation, as Parquet."""
    items = human.eval_items(predictions, references, methods, n_items, seed=seed)
    items.write.mode("overwrite").parquet(f"{out}/items")
    kept = items.sparkSession.read.parquet(f"{out}/items")
    human.assignment(human.units(kept, methods), raters or [f"rater_{i}" for i in range(1, 7)], per_unit, seed).write.mode("overwrite").parquet(f"{out}/assignment")


def judge(predictions: DataFrame, briefs: DataFrame, ask: Callable[[], Generate] | None, by: list[str]) -> DataFrame | None:
    """Mean scores of a judge, which answers prompts in batches; None if there is no judge."""
    return None if ask is None else judged(predictions, briefs, ask, by)


def write_metrics(long: DataFrame, folder: str, config: dict[str, Any]) -> None:
    """The metrics of one run as the document that ``aggregate`` reads, with its manifest."""
    tree: dict[str, dict[str, Any]] = {}
    for r in long.filter((F.col("method_name") == get(config, "method.name")) & (F.col("seed") == config["seed"])).collect():
        metric, key = r.name.split(".", 1)
        value = r.value
        try:
            value = json.loads(r.value) if r.value is not None else None
        except ValueError:
            pass
        tree.setdefault(metric, {})[key] = value
    sinks.write_manifest(folder, config)
    jsonl.write_document({"experiment_id": f"{config['experiment_name']}_{config['seed']}", "method": get(config, "method.name"), "model": config["model"], "seed": config["seed"], "metrics": tree}, f"{folder}/metrics_auto.json")
