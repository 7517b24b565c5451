import json

import pytest
from briefmill import cli, pipeline
from briefmill.config import compose, get
from briefmill.operators.evaluation import METRICS
from briefmill.operators.inference import echo, http_judge
from briefmill.operators.registry import RETRIEVERS
from briefmill.sources import jsonl
from pyspark.sql import functions as F


def test_compose():
    c = compose({"experiment_name": "e", "method": "rag"}, ["method.top_k=5", "eval=quick", "data.max_samples=null", "seed=7"])
    assert get(c, "method.top_k") == 5 and get(c, "eval.metrics") == ["schema_compliance", "topk_accuracy"] and c["seed"] == 7
    assert get(c, "no.such", 3) == 3 and c["config_hash"] != compose({"method": "rag"})["config_hash"]
    with pytest.raises(KeyError):
        compose({"method": "none"})


def test_from_generation_to_report(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    at = lambda x: str(tmp_path / x)
    guides = tmp_path / "guides"
    guides.mkdir()
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "a.txt").write_text("# no guideline")
    (guides / "g.md").write_text("# Trends\nuse a line chart for passenger volume and water usage over time\n")
    assert cli.main(["generate-dataset", "--n", "60", "--out", at("raw/gold.jsonl")]) == 0
    assert cli.main(["build-data", "--raw-dir", at("raw"), "--out-dir", at("data")]) == 0
    items = spark.read.parquet(at("data"))
    assert items.count() == items.select("item_id").distinct().count() == 60
    assert cli.main(["build-kb", "--guidelines-dir", str(guides), "--out", at("kb")]) == 0
    assert cli.main(["build-kb", "--guidelines-dir", str(empty), "--out", at("kb2")]) == 1
    assert cli.main(["build-perturbations", "--processed-dir", at("data"), "--out-dir", at("p")]) == 0
    assert spark.read.parquet(at("p/missing_info")).filter("brief.constraints IS NOT NULL").count() == 0
    assert cli.main(["eval-auto", "--processed-dir", at("data"), "--outputs-root", at("out")]) == 1  # nothing to evaluate yet
    more = ["--processed-dir", at("data"), "--chunks", at("kb"), "--outputs-root", at("out")]
    assert cli.main(["run-all", "--methods", "prompt_only", "rag", "--seeds", "1", "2", *more]) == 0
    before = spark.read.parquet(at("out/run_rag_1/predictions")).count()
    assert cli.main(["infer", "--experiment", "run_rag", "--method", "rag", "--override", "seed=1", *more]) == 0
    assert spark.read.parquet(at("out/run_rag_1/predictions")).count() == before == 3 * items.filter("split = 'test'").count()
    assert spark.read.parquet(at("out/run_rag_1/predictions")).filter("size(retrieved_docs) > 0").count() > 0
    metrics = json.loads((tmp_path / "out/run_rag_1/metrics_auto.json").read_text())["metrics"]
    assert metrics["schema_compliance"]["schema_validity_rate"] == 100.0 and metrics["robustness"]["paraphrase_consistency"] == 100.0
    assert cli.main(["aggregate-results", "--outputs-root", at("out"), "--out-dir", at("report")]) == 0
    assert "| echo | rag | metrics.schema_compliance.json_parse_rate | 100 | 0 | 2 |" in (tmp_path / "report/report.md").read_text()
    assert (tmp_path / "report/comparison.csv").read_text().count("\n") == 5 and "| run_rag_2 | echo | rag | 100 |" in (tmp_path / "report/report.md").read_text()
    assert [r["stage"] for r in json.loads((tmp_path / "out/run_rag_1/timings.json").read_text())] == ["infer", "total"]
    assert cli.main(["build-training", "--processed-dir", at("data"), "--out", at("training")]) == 0
    assert cli.main(["aggregate-results", "--outputs-root", at("none"), "--out-dir", at("r2")]) == 1
    results = ",".join(at(f"out/run_{m}_1/predictions") for m in ("prompt_only", "rag"))
    assert cli.main(["eval-stats", "--results", results, "--processed-dir", at("data"), "--out-dir", at("stats")]) == 0
    assert spark.read.option("header", True).csv(at("stats/wilcoxon")).first().p_value == "1.0"
    spark.read.parquet(*results.split(",")).withColumn("prediction_id", F.monotonically_increasing_id()).write.parquet(at("preds"))
    assert cli.main(["build-human-eval", "--predictions", at("preds"), "--references", at("data"), "--methods", "prompt_only", "rag", "--n-items", "3", "--out-dir", at("human")]) == 0
    assert spark.read.parquet(at("human/assignment")).count() == 3 * 2 * 3
    assert cli.main(["next-tasks", "--eval-dir", at("human"), "--ratings-dir", at("none")]) == 0
    assert cli.main(["package", "--folders", at("report"), "--out", at("all.zip")]) == 0


def test_human_stats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    rows = [{"rater_id": f"r{r}", "unit_id": f"i{i}__{m}", "item_id": f"i{i}", "method": m, "scores": {"d": 1 + (i + r + len(m)) % 5, "e": 3}} for i in range(4) for m in ("a", "bb") for r in range(3)]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert cli.main(["compute-irr", "--ratings-dir", str(tmp_path), "--out-dir", str(tmp_path / "irr")]) == 0
    got = {r.dimension: r for r in spark.read.option("header", True).csv(str(tmp_path / "irr/alpha")).collect()}
    assert got["e"].alpha == "1.0" and got["d"].low_reliability == "true" and (tmp_path / "irr/friedman").exists()
    assert cli.main(["compute-irr", "--ratings-dir", str(tmp_path / "none"), "--out-dir", str(tmp_path / "z")]) == 1


def test_judge(spark):
    preds = spark.createDataFrame([("a", "m", "x"), ("b", "m", "y")], "item_id string, method_name string, raw_text string")
    briefs = spark.createDataFrame([("a", "u", ["g"], None, None)], "item_id string, users string, goals array<string>, kpis array<string>, constraints string")
    answer = lambda: lambda prompts: ['{"layout_quality": 4, "overall_usefulness": 4}' if "(brief unavailable)" not in p else "none" for p in prompts]
    got = {r.dimension: (r["mean"], r.n) for r in pipeline.judge(preds, briefs, answer, ["method_name"]).collect()}
    assert got == {"layout_quality": (4.0, 1), "overall_usefulness": (4.0, 1), "overall": (4.0, 2)}
    assert pipeline.judge(preds, briefs, None, ["method_name"]) is None


def test_private_keys_are_dropped():
    assert jsonl.public({"a": [{"_x": 1, "b": 2}], "_c": 3}) == {"a": [{"b": 2}]}


ITEMS = "item_id string, split string, line_no bigint, brief struct<users:string,goals:array<string>,kpis:array<string>,columns:array<map<string,string>>,constraints:string>, recommendation struct<kpi_chart_mapping:array<struct<kpi:string,task_type:string,chart_type:string,alternatives:array<string>>>>"


def items_of(spark, n=3):
    rows = [(f"i{k}", "test", k, ("team", ["g"], ["Trend of Sales", "Share"], [], None), ([("Trend of Sales", "trend", "line", ["area"])],)) for k in range(n)]
    return spark.createDataFrame(rows, ITEMS)


CHUNKS = [("c1", "s", "h1", "show sales over time as a line"), ("c2", "s", "h2", "share of the whole as a donut"), ("c3", "s", "h3", "nothing alike")]


@pytest.mark.parametrize("retriever", RETRIEVERS.keys())
def test_every_retriever_in_the_pipeline(spark, tmp_path, retriever):
    chunks = spark.createDataFrame(CHUNKS, "id string, source string, heading string, text string")
    config = compose({"method": "rag"}, [f"method.retriever={retriever}", "method.top_k=2"])
    assert pipeline.infer(spark, items_of(spark), chunks, config, echo(), str(tmp_path / "p"), ["original"]) == 3
    rows = spark.read.parquet(str(tmp_path / "p")).collect()
    assert all({d.id for d in r.retrieved_docs} == {"c1", "c2"} and r.retrieved_docs[0].rank == 1 for r in rows)
    with pytest.raises(ValueError, match="needs chunks"):
        pipeline.infer(spark, items_of(spark), None, config, echo(), str(tmp_path / "q"))


def scores():
    return lambda: lambda asked: ['{"layout_quality": 4, "overall_usefulness": 2}' for _ in asked]


@pytest.mark.parametrize("name", METRICS.keys())
def test_every_metric_by_name(spark, tmp_path, name):
    config = compose({"eval": "with_judge"})
    config["eval"]["metrics"] = [name]
    pipeline.infer(spark, items_of(spark), None, config, echo(), str(tmp_path / "p"))
    rows = pipeline.evaluate(spark, items_of(spark), str(tmp_path / "p"), config, scores()).collect()
    got = {r["name"]: r.value for r in rows}
    if name == "grounding":
        assert got == {}  # nothing was retrieved
    else:
        assert got and all(k.startswith(f"{name}.") for k in got)
    want = {"topk_accuracy": ("top_1_accuracy", "100.0"), "schema_compliance": ("n", "3"), "g_eval": ("overall", "3.0"), "macro_f1": ("macro_f1", "1.0"), "robustness": ("paraphrase_consistency", "100.0"), "missing_info": ("n", "3"), "latency": ("n", "3")}
    if name in want:
        assert got[f"{name}.{want[name][0]}"] == want[name][1]


def test_eval_group_is_honoured(spark, tmp_path):
    config = compose(None, ["eval=quick"])
    pipeline.infer(spark, items_of(spark), None, config, echo(), str(tmp_path / "p"))
    names = {r["name"].split(".")[0] for r in pipeline.evaluate(spark, items_of(spark), str(tmp_path / "p"), config).collect()}
    assert names == {"schema_compliance", "topk_accuracy"}


def test_last_written_result_counts(spark, tmp_path):
    config = compose()
    at = str(tmp_path / "p")
    pipeline.infer(spark, items_of(spark), None, config, echo("bar"), at, ["original"])
    pipeline.infer(spark, items_of(spark), None, config | {"config_hash": "0"}, echo("line"), at, ["original"])
    got = {r["name"]: r.value for r in pipeline.evaluate(spark, items_of(spark), at).collect()}
    assert got["topk_accuracy.n"] == "3" and got["topk_accuracy.top_1_accuracy"] == "100.0"


def test_training_texts(spark, tmp_path):
    rows = items_of(spark).withColumn("split", F.when(F.col("item_id") == "i0", "val").otherwise("train"))
    assert pipeline.build_training(spark, rows, str(tmp_path / "t"), end="<eos>") == {"train": 2, "val": 1}
    made = spark.read.json(str(tmp_path / "t")).first().text
    assert made.startswith("### System:") and made.endswith("}<eos>") and '"chart_type" : "line"' in made


def test_http_judge():
    import http.server
    import threading

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"choices": [{"message": {"content": f"{asked['model']} {self.headers['Authorization']} {asked['messages'][0]['content']}"}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = http_judge(f"http://127.0.0.1:{server.server_port}/", "m", "k", 5)()
    assert ask(["a", "b"]) == ["m Bearer k a", "m Bearer k b"]
    server.shutdown()


def test_echo_is_valid():
    assert json.loads(echo("bar")()(["x\n**KPIs:** A, B\n"])[0])["kpi_chart_mapping"][1]["chart_type"] == "bar"
