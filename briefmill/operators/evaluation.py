"""The metrics of a run by name: each takes a ``Run`` and gives a row for each group of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.functions import jsonout, text, vocab
from briefmill.operators import metrics
from briefmill.operators.inference import Generate, generated
from briefmill.operators.registry import METRICS


@dataclass
class Run:
    """Predictions of all variants with what was parsed of them (``reparsed``), and items with brief and recommendation.

    ``judge`` sets up what answers a judge's prompts; without it there are no judge's scores."""

    predictions: DataFrame
    items: DataFrame
    by: list[str]
    judge: Callable[[], Generate] | None = None

    @cached_property
    def original(self) -> DataFrame:
        return self.predictions.filter("variant = 'original'")

    @property
    def references(self) -> DataFrame:
        """The charts of each item, the last of its rows in order of file and line."""
        place = [c for c in ("source_file", "line_no") if c in self.items.columns]
        order = F.struct(*place) if place else F.lit(0)
        return self.items.select("item_id", order.alias("o"), "recommendation.kpi_chart_mapping")

    @cached_property
    def joined(self) -> DataFrame:
        return metrics.with_reference(self.original, self.references, "item_id", "o")

    @property
    def mapping(self) -> Column:
        return F.col("parsed.mapping")

    @property
    def ok(self) -> Column:
        return F.col("parsed.error").isNull()


@METRICS.register("schema_compliance")
def schema_compliance(run: Run) -> DataFrame:
    return metrics.schema_compliance(run.original, run.by, parsed="parsed")


@METRICS.register("topk_accuracy")
def topk_accuracy(run: Run) -> DataFrame:
    return metrics.topk_accuracy(run.joined, run.by, run.mapping, run.ok)


@METRICS.register("macro_f1")
def macro_f1(run: Run) -> DataFrame:
    return metrics.macro_f1(run.joined, run.by, run.mapping, run.ok)


@METRICS.register("latency")
def latency(run: Run) -> DataFrame:
    return metrics.latency(run.original, run.by)


@METRICS.register("grounding")
def grounding(run: Run) -> DataFrame:
    return metrics.grounding(run.original, run.by, F.col("retrieved_docs"), F.col("parsed.rationales"))


@METRICS.register("robustness")
def robustness(run: Run) -> DataFrame:
    gold = metrics.with_reference(run.items.select("item_id").distinct(), run.references, "item_id", "o")
    return metrics.robustness(run.predictions, gold, run.by, "item_id", "variant", "latency_ms", run.mapping, run.ok, ("original", "paraphrased"))


@METRICS.register("missing_info")
def missing_info(run: Run) -> DataFrame:
    return metrics.missing_info(run.predictions.filter("variant = 'missing_info'"), run.by, parsed="parsed")


def judged(predictions: DataFrame, briefs: DataFrame, ask: Callable[[], Generate], by: list[str]) -> DataFrame:
    """Mean scores of a judge, which answers prompts in batches, for each dimension and over all."""
    line = briefs.select("item_id", text.brief_line(*[F.col(c) for c in ("users", "goals", "kpis", "constraints")]).alias("brief"))
    asked = predictions.join(line, "item_id", "left").select(*by, "item_id", text.judge_prompt(F.col("brief"), F.col("raw_text"), list(vocab.RUBRIC)).alias("prompt"))
    answers = generated(asked, ask, [*by, "item_id"])
    return metrics.judge_means(answers.withColumn("scores", jsonout.judge_scores(F.col("raw_text"), list(vocab.RUBRIC))), by, "scores")


@METRICS.register("g_eval")
def g_eval(run: Run) -> DataFrame | None:
    """A judge's mean scores, a column for each dimension; none without a judge."""
    if run.judge is None:
        return None
    means = judged(run.original, run.items.select("item_id", "brief.*"), run.judge, run.by)
    names = [*vocab.RUBRIC, "overall"]
    return means.groupBy(*run.by).agg(*[F.max(F.when(F.col("dimension") == d, F.col("mean"))).alias(d) for d in names])


def evaluated(run: Run, names: list[str]) -> DataFrame:
    """(by, name, value): the metrics of these names in long form."""
    out = None
    for name in names:
        df = METRICS.get(name)(run)
        if df is None:
            continue
        cells = F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("name"), F.col(c).cast("string").alias("value")) for c in df.columns if c not in run.by]))
        long = df.select(*run.by, cells.alias("x")).select(*run.by, "x.*")
        out = long if out is None else out.unionByName(long)
    return out
