"""The inference seam: resume, prompts, batched generation with errors set aside, parsing.

A method is a factory that is called once in each task and gives a function from a batch of prompts to raw texts. No
model ships with the library: a factory is plugged in by name, and ``echo`` is a stand-in that answers by rule.
"""

from __future__ import annotations

import inspect
import json
import time
import traceback
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefmill.functions import jsonout, text, vocab
from briefmill.operators.registry import METHODS
from briefmill.operators.relational import last_wins, resume
from briefmill.runtime import cut, small

Generate = Callable[[list[str]], list[str]]
ERROR = "struct<error_type:string,error:string,traceback:string>"

def echo(answer: str = "line") -> Callable[[], Generate]:
    """A method without a model: a valid output that gives every KPI of the prompt the same chart."""

    def setup() -> Generate:
        def one(prompt: str) -> str:
            kpis = next((x.removeprefix("**KPIs:** ").split(", ") for x in prompt.split("\n") if x.startswith("**KPIs:** ")), [])
            mapping = [{"kpi": k, "task_type": "trend", "chart_type": answer, "alternatives": [], "encoding": {}} for k in kpis]
            return json.dumps({k: mapping if k == "kpi_chart_mapping" else [] if k in ("interactions", "rationales") else {} for k in vocab.REQUIRED_KEYS})

        return lambda prompts: [one(p) for p in prompts]

    return setup


@dataclass(frozen=True)
class Method:
    """How prompts are answered: what sets up generation in a task, and whether prompts get passages first."""

    setup: Callable[[], Generate]
    passages: bool = False
    adapter_path: str | None = None

    def __call__(self) -> Generate:
        """A generator for one task; a factory that takes an adapter_path is given it."""
        takes = "adapter_path" in inspect.signature(self.setup).parameters
        return self.setup(adapter_path=self.adapter_path) if takes else self.setup()


def _method(passages: bool, tuned: bool) -> Callable[..., Method]:
    def make(generate: Callable[[], Generate], adapter_path: str | None = None, **_: object) -> Method:
        if tuned and not adapter_path:
            raise ValueError("a fine-tuned method needs an adapter_path")
        return Method(generate, passages, adapter_path if tuned else None)

    return make


for _name, _passages, _tuned in (("prompt_only", False, False), ("rag", True, False), ("ft", False, True), ("ft_rag", True, True)):
    METHODS.register(_name)(_method(_passages, _tuned))


def http_judge(url: str, model: str, key: str | None = None, timeout: float = 60.0) -> Callable[[], Generate]:
    """A judge behind an HTTP service of the usual chat form; a call that fails sets aside its row only."""

    def setup() -> Generate:
        def one(prompt: str) -> str:
            body = json.dumps({"model": model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}).encode()
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
            with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"]

        return lambda asked: [one(p) for p in asked]

    return setup


def training_texts(briefs: DataFrame, answers: DataFrame, key: str, answer: Column, keep: list[str], template: Callable[[Column], Column] | None = None, end: str = "\n") -> DataFrame:
    """(key, keep, text): supervised examples, the prompt of a brief and the answer of its item. ``template`` makes the user's turn a
    prompt up to the assistant's; ``end`` is what the model's end of text is. Items without an answer are left out."""
    user = text.user_message(*[F.col(c) for c in ("users", "goals", "kpis", "columns", "constraints")])
    asked = briefs.select(key, *keep, (template or text.prompt)(user).alias("prompt"))
    return asked.join(answers.select(key, answer.alias("answer")), key).select(key, *keep, F.concat("prompt", "answer", F.lit(end)).alias("text"))


def prompts(briefs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, prompt) of briefs."""
    user = text.user_message(*[F.col(c) for c in ("users", "goals", "kpis", "columns", "constraints")])
    return briefs.select(*keep, text.prompt(user).alias("prompt"))


def with_passages(prompted: DataFrame, hits: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Prompts with the passages of each brief, best first, put before them; those without passages stay as they are."""
    named = hits.join(small(chunks.select("id", "source", "heading", "text")), "id")
    block = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "source", "heading", "text", "score"))).alias("retrieved_docs"))
    out = prompted.join(block, key, "left")
    lead = F.concat(F.lit("Relevant design guidelines:\n\n"), text.passages_block(F.col("retrieved_docs")), F.lit("\n\n"))
    return out.withColumn("prompt", F.when(F.size("retrieved_docs") > 0, F.concat(lead, "prompt")).otherwise(F.col("prompt")))


def generated(prompted: DataFrame, method: Callable[[], Generate], keys: list[str], batch: int = 16) -> DataFrame:
    """(keys, raw_text, latency_ms, error): a batch that fails is tried again row by row, so an error costs one row."""
    kinds = ", ".join(f"`{c}` {prompted.schema[c].dataType.simpleString()}" for c in keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate: Generate | None = None
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                piece = pdf.iloc[at : at + batch].reset_index(drop=True)
                generate = generate or method()
                texts: list[str | None] = [None] * len(piece)
                errors: list[dict | None] = [None] * len(piece)
                took = [0.0] * len(piece)
                begun = time.perf_counter()
                try:
                    texts = list(generate(piece.prompt.tolist()))
                    took = [1000 * (time.perf_counter() - begun) / len(piece)] * len(piece)
                except Exception:  # noqa: BLE001
                    for i, prompt in enumerate(piece.prompt):
                        begun = time.perf_counter()
                        try:
                            texts[i] = generate([prompt])[0]
                        except Exception as error:  # noqa: BLE001
                            errors[i] = {"error_type": type(error).__name__, "error": str(error), "traceback": traceback.format_exc()}
                        took[i] = 1000 * (time.perf_counter() - begun)
                yield piece[keys].assign(raw_text=texts, latency_ms=took, error=errors)

    return prompted.select(*keys, "prompt").mapInPandas(run, f"{kinds}, raw_text string, latency_ms double, error {ERROR}")


def run_inference(briefs: DataFrame, done: DataFrame | None, method: Callable[[], Generate], keys: list[str]) -> DataFrame:
    """Results of the briefs that have none yet, parsed; computed once, so writing results and errors does not generate twice."""
    todo = resume(briefs, done, keys) if done is not None else briefs
    raw = cut(generated(prompts(todo, keys), method, keys))
    return reparsed(raw)


def reparsed(predictions: DataFrame) -> DataFrame:
    """Predictions with parse and parse error made from raw_text now, whatever was stored."""
    out = predictions.drop("parsed", "parse_error").withColumn("parsed", jsonout.parsed_output("raw_text"))
    return out.withColumn("parse_error", F.col("parsed.error"))


def latest_results(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Readers of appended results: a row that a retried task wrote twice counts once."""
    return last_wins(results, keys, order)
