import json

import pytest
from briefmill.operators.inference import echo, generated, prompts, reparsed, run_inference
from briefmill.operators.registry import METHODS, Registry
from briefmill.operators.retrieval import RETRIEVERS
from briefmill.sources import files, gold, jsonl, markdown, sinks, synthetic
from briefmill.streaming import resume
from pyspark.sql import functions as F


def test_jsonl_keeps_order_and_skips_what_is_no_json(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n  \nbroken {\n[1, 2]\n{"a": "ü\\n"}\n{"a": 3} x\n', encoding="utf-8")
    got = [(r.line_no, json.loads(r.record)) for r in jsonl.read_jsonl(spark, str(p)).orderBy("line_no").collect()]
    assert got == [(0, {"a": 1}), (4, [1, 2]), (5, {"a": "ü\n"})]
    with pytest.raises(Exception, match="(?i)path"):
        jsonl.read_jsonl(spark, str(tmp_path / "none.jsonl")).collect()


def test_line_numbers_of_split_files(spark, tmp_path):
    p = tmp_path / "b.jsonl"
    p.write_text("".join(f'{{"n": {i}}}\n' for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = jsonl.read_jsonl(spark, str(p), "n int").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line_no, r.n) for r in rows) == [(i, i) for i in range(5000)]


def test_jsonl_round_trip_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "a string, b int")
    jsonl.write_jsonl(df, str(tmp_path / "o"))
    jsonl.append_jsonl(df, str(tmp_path / "o"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o").glob("*.json"))
    assert text == '{"a":"é","b":null}\n' * 2


def test_documents_and_settings(tmp_path):
    jsonl.write_document({"ä": [1]}, tmp_path / "x/d.json")
    assert jsonl.read_document(tmp_path / "x/d.json") == {"ä": [1]}
    jsonl.write_settings({"b": 1, "a": {"c": 2}}, tmp_path / "s.yaml")
    assert list(jsonl.read_settings(tmp_path / "s.yaml")) == ["b", "a"]
    (tmp_path / "e.yaml").write_text("")
    assert jsonl.read_settings(tmp_path / "e.yaml") == {}


def test_gold(spark, tmp_path):
    ok = {"brief": {"users": "u"}, "recommendation": {}}
    (tmp_path / "gold.jsonl").write_text(json.dumps(ok) + "\n" + json.dumps(ok | {"item_id": "x", "split": "val"}) + "\n" + json.dumps(ok | {"item_id": "x", "split": "test"}) + "\n")
    rows = gold.gold_or_legacy(spark, str(tmp_path), ["old.jsonl"]).collect()
    assert {(r.item_id[:5], r.split) for r in rows if r.item_id == "x"} == {("x", "val")} and len(rows) == 2
    assert all(r.split in ("train", "val", "test") and r.item_id for r in rows)
    assert gold.gold_pool(spark, [str(tmp_path / "none.jsonl")]).count() == 0
    (tmp_path / "bad.jsonl").write_text(json.dumps({"brief": {}, "recommendation": {"layout": 3}}) + "\n")
    with pytest.raises(Exception, match="contract"):
        gold.gold_items(spark, str(tmp_path / "bad.jsonl")).collect()


def test_ratings_and_runs(spark, tmp_path):
    assert gold.ratings(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "r.jsonl").write_text('{"rater_id": "a", "scores": {"x": 3}}\nbad\n')
    assert gold.ratings(spark, str(tmp_path)).first().scores == {"x": 3}
    run = tmp_path / "runs/one"
    run.mkdir(parents=True)
    (run / "config.json").write_text('{"seed": 1, "method": {"name": "rag"}}')
    (run / "metrics_auto.json").write_text('{"seed": null, "metrics": {"a": {"b": 0.5}}}')
    (tmp_path / "runs/empty").mkdir()
    assert {(r.name, r.value) for r in gold.runs(spark, str(tmp_path / "runs")).collect()} == {("seed", None), ("method.name", "rag"), ("metrics.a.b", "0.5")}


def test_markdown_chunks(spark, tmp_path):
    (tmp_path / "demo.md").write_text("# Title\n\n## Section A\nuse a line chart for trends over time\r\n  ## Section B\nkeep the contrast high for all readers\n", encoding="utf-8")
    (tmp_path / "x.txt").write_text("# no")
    rows = markdown.chunks(markdown.read_markdown(spark, str(tmp_path))).orderBy("ord").collect()
    assert [r.heading for r in rows] == ["Section A", "Section B"] and all(r.id.startswith("demo_") for r in rows)
    assert rows[0].text == "## Section A\nuse a line chart for trends over time"


def test_synthetic_items_do_not_change_as_the_set_grows(spark):
    few = synthetic.generate(spark, 10).orderBy("index").collect()
    assert few == synthetic.generate(spark, 50).orderBy("index").limit(10).collect()
    from briefmill.functions.jsonout import CONTRACT, obeys
    from briefmill.functions.vocab import TASK_CHART

    for r in few:
        wish = json.loads(r.recommendation)
        assert obeys(wish, CONTRACT) and all(TASK_CHART[m["task_type"]][0] == m["chart_type"] for m in wish["kpi_chart_mapping"])
        assert len(json.loads(r.brief)["kpis"]) >= 3


def test_sinks(spark, tmp_path):
    made = sinks.write_manifest(sinks.run_folder(tmp_path, "e", 7), {"experiment_name": "e", "seed": 7})
    assert made["experiment_id"] == "e_7" and (tmp_path / "e_7/manifest.json").exists()
    sinks.write_csv_file([{"a": 1, "z": 2}], ["a"], tmp_path / "r.csv")
    sinks.write_report("T", {"S": ([{"a": 0.5}], ["a"])}, tmp_path / "r.md")
    assert (tmp_path / "r.md").read_text().startswith("# T\n\n## S\n\n| a |") and sinks.package([tmp_path / "e_7"], tmp_path / "o.zip") == 5
    for name in ("config.json", "config.yaml", "config_hash.txt", "env.txt", "manifest.json"):
        assert (tmp_path / "e_7" / name).stat().st_size > 0
    timings = sinks.Timings()
    for _ in range(2):
        with timings.stage("infer"):
            pass
    assert [r["stage"] for r in timings.rows()] == ["infer", "total"] and sinks.package([tmp_path / "e_7"], tmp_path / "o.zip", timings) == 6


def test_files_of_any_store(spark, tmp_path):
    place = f"file://{tmp_path}/a/b"
    assert not files.exists(place) and files.matching(f"{place}/*.txt") == []
    files.write_text("ä\n", f"{place}/one.txt")
    assert files.exists(place) and files.read_text(f"{place}/one.txt") == "ä\n" and len(files.matching(f"{place}/*.txt")) == 1
    with pytest.raises(Exception, match="No FileSystem"):
        files.exists("nowhere://x/y")


def test_registry():
    r = Registry("thing")
    r.register("a")(1)
    with pytest.raises(ValueError):
        r.register("a")(2)
    with pytest.raises(KeyError):
        r.get("b")
    assert "a" in r and METHODS.keys() == ["ft", "ft_rag", "prompt_only", "rag"] and "tfidf" in RETRIEVERS
    with pytest.raises(ValueError):
        METHODS.get("ft")(echo())
    assert METHODS.get("ft_rag")(echo(), adapter_path="x")


BRIEF = "item_id string, users string, goals array<string>, kpis array<string>, columns array<map<string,string>>, constraints string"


def briefs(spark, n):
    return spark.createDataFrame([(f"i{k}", "u", [], ["A", "B"], [], None) for k in range(n)], BRIEF)


def test_inference_resumes_and_sets_errors_aside(spark):
    done = spark.createDataFrame([("i0",)], "item_id string")
    rows = run_inference(briefs(spark, 4), done, echo("bar"), ["item_id"]).collect()
    assert {r.item_id for r in rows} == {"i1", "i2", "i3"} and all(r.parsed.valid and r.parsed.mapping[0].chart_type == "bar" for r in rows)

    def fragile():
        def run(texts):
            if len(texts) > 1:
                raise RuntimeError("batch")
            return ["{}"]

        return run

    rows = generated(prompts(briefs(spark, 3), ["item_id"]), fragile, ["item_id"]).collect()
    assert all(r.raw_text == "{}" and r.error is None for r in rows)
    again = reparsed(spark.createDataFrame([("no", "old")], "raw_text string, parse_error string")).first()
    assert again.parse_error == "no_json_found"


def test_stream_answers_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    briefs(spark, 3).write.mode("append").parquet(str(src))
    for n in (3, 5):
        stream = spark.readStream.schema(BRIEF).parquet(str(src))
        resume.answer_stream(stream, echo(), ["item_id"], out, str(tmp_path / "cp"), "item_id string").awaitTermination(60)
        assert spark.read.parquet(out).count() == spark.read.parquet(out).select("item_id").distinct().count() == n
        briefs(spark, 5).write.mode("append").parquet(str(src))


def test_ratings_stream(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"rater_id": "a", "unit_id": "u", "scores": {"x": 3, "y": 4}}\n')
    q = resume.progress(resume.ratings_stream(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("SELECT * FROM progress").collect()] == [("a", 1, 2)]
    assert spark.range(1).select(F.lit(1)).count() == 1
