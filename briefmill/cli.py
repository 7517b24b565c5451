"""Command line: python -m briefmill.cli COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import SparkSession

from briefmill import pipeline
from briefmill.config import compose
from briefmill.operators import human
from briefmill.runtime import ship
from briefmill.sources import gold, sinks
from briefmill.sources.jsonl import write_document


#: What answers prompts unless another factory is named as module:function.
ECHO = "briefmill.operators.inference:echo"


def plugged(name: str) -> Callable[[], Any]:
    """What the factory module:function makes; called without arguments, it gives what sets up generation in a task."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


def session() -> SparkSession:
    spark = SparkSession.builder.appName("briefmill").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    ship(spark)
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="briefmill")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, **options: object) -> None:
        p = sub.add_parser(name)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if isinstance(default, list):
                p.add_argument(flag, nargs="+", default=default)
            elif default is None:
                p.add_argument(flag, required=True)
            else:
                p.add_argument(flag, type=type(default), default=default)

    command("generate-dataset", n=600, seed=42, out="data/gold.jsonl")
    command("build-data", raw_dir="data", out_dir="data/processed")
    command("build-kb", guidelines_dir="data/guidelines", out="data/chunks")
    command("build-perturbations", processed_dir="data/processed", out_dir="data/perturbed")
    for name in ("infer", "eval-auto", "run-experiment"):
        command(name, experiment="run", method="prompt_only", override=[], processed_dir="data/processed", chunks="", outputs_root="outputs", generator=ECHO, judge="")
    command("run-all", methods=["prompt_only", "rag"], seeds=["42", "43", "44"], override=[], processed_dir="data/processed", chunks="", outputs_root="outputs", generator=ECHO, judge="")
    command("build-training", processed_dir="data/processed", out="data/training")
    command("eval-stats", results=None, processed_dir="data/processed", methods=["prompt_only", "rag"], out_dir="outputs/stats")
    command("aggregate-results", outputs_root="outputs", out_dir="outputs/report")
    command("build-human-eval", predictions=None, references=None, methods=["prompt_only", "rag", "ft", "ft_rag"], n_items=60, n_raters=6, ratings_per_output=3, seed=42, out_dir="outputs/human")
    command("next-tasks", eval_dir=None, ratings_dir=None)
    command("compute-irr", ratings_dir=None, out_dir="outputs/irr")
    command("package", folders=[], out="outputs.zip")
    return top


def experiment(spark: SparkSession, a: argparse.Namespace, infer: bool, evaluate: bool) -> None:
    config = compose({"experiment_name": a.experiment, "method": a.method}, a.override)
    items = spark.read.parquet(a.processed_dir)
    folder = sinks.run_folder(a.outputs_root, config["experiment_name"], config["seed"])
    timings = sinks.Timings()
    if infer:
        chunks = spark.read.parquet(a.chunks) if a.chunks else None
        with timings.stage("infer"):
            print(pipeline.infer(spark, items, chunks, config, plugged(a.generator), f"{folder}/predictions"), "new predictions")
    if evaluate:
        with timings.stage("evaluate"):
            judge = plugged(a.judge) if a.judge else None
            pipeline.write_metrics(pipeline.evaluate(spark, items, f"{folder}/predictions", config, judge), folder, config)
        print("metrics in", folder)
    write_document(timings.rows(), f"{folder}/timings.json")


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    name = a.command
    if name == "generate-dataset":
        pipeline.generate_dataset(spark, a.out, a.n, a.seed)
    elif name == "build-data":
        print(pipeline.build_data(spark, a.raw_dir, a.out_dir))
    elif name == "build-kb":
        print(pipeline.build_kb(spark, a.guidelines_dir, a.out), "chunks")
    elif name == "build-perturbations":
        test = spark.read.parquet(a.processed_dir).filter("split = 'test'")
        if test.isEmpty():
            raise ValueError("no test split")
        for how in ("paraphrased", "missing_info"):
            pipeline.perturbed(test, how).write.mode("overwrite").parquet(f"{a.out_dir}/{how}")
    elif name == "build-training":
        print(pipeline.build_training(spark, spark.read.parquet(a.processed_dir), a.out))
    elif name in ("infer", "eval-auto", "run-experiment"):
        experiment(spark, a, name != "eval-auto", name != "infer")
    elif name == "run-all":
        failed = []
        for method in a.methods:
            for seed in a.seeds:
                one = argparse.Namespace(experiment=f"run_{method}", method=method, override=[f"seed={seed}", *a.override], processed_dir=a.processed_dir, chunks=a.chunks, outputs_root=a.outputs_root, generator=a.generator, judge=a.judge)
                try:
                    experiment(spark, one, True, True)
                except Exception as error:  # noqa: BLE001  # one run that fails leaves the others alone
                    failed.append(f"{method}, seed {seed}: {error}")
        if failed:
            raise RuntimeError("; ".join(failed))
    elif name == "eval-stats":
        items = spark.read.parquet(a.processed_dir).selectExpr("item_id", "struct(source_file, line_no) AS o", "recommendation.kpi_chart_mapping")
        for part, df in pipeline.experiment_stats(spark.read.schema(pipeline.RESULT).parquet(*a.results.split(",")), items, a.methods).items():
            sinks.write_csv(df, f"{a.out_dir}/{part}")
    elif name == "aggregate-results":
        pipeline.aggregate(spark, a.outputs_root, a.out_dir)
    elif name == "build-human-eval":
        raters = [f"rater_{i}" for i in range(1, a.n_raters + 1)]
        pipeline.human_eval(spark.read.parquet(a.predictions), spark.read.parquet(a.references), a.methods, a.out_dir, a.n_items, raters, a.ratings_per_output, a.seed)
    elif name == "next-tasks":
        _, assigned = gold.eval_set(spark, a.eval_dir)
        for r in human.next_tasks(assigned, gold.ratings(spark, a.ratings_dir)).orderBy("rater").collect():
            print(r.rater, r.unit_id, f"{r.n_done} of {r.n_total} done")
    elif name == "package":
        print(sinks.package(a.folders, a.out), "files")
    elif name == "compute-irr":
        for part, df in pipeline.human_stats(gold.ratings(spark, a.ratings_dir)).items():
            sinks.write_csv(df, f"{a.out_dir}/{part}")


def main(args: Sequence[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        run(session(), a)
    except (ValueError, FileNotFoundError, RuntimeError, KeyError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
