import json

import pytest
from briefmill.functions import ids, jsonout, text, vocab
from pyspark.sql import functions as F


def one(spark, column, ddl, *row):
    return spark.createDataFrame([row], ddl).select(column.alias("x")).first().x


def test_splits_are_stable_and_proportioned(spark):
    df = spark.range(2000).select(F.concat(F.lit("item_"), "id").alias("k")).withColumn("s", ids.split_of(F.col("k")))
    n = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert set(n) == {"train", "val", "test"} and n["train"] > n["val"] and n["train"] > n["test"]
    few = {r.k: r.s for r in df.limit(100).collect()}
    assert few == {r.k: r.s for r in df.collect() if r.k in few}


def test_split_bucket_is_md5_modulo(spark):
    import hashlib

    for k in ("item_1", "", "ü"):
        assert one(spark, ids.split_bucket(F.col("k")), "k string", k) == int(hashlib.md5(k.encode()).hexdigest(), 16) % 10_000
    assert one(spark, ids.split_of(F.col("k")), "k string", None) is None


def test_content_id_is_canonical(spark):
    a = one(spark, ids.content_id("k"), "k string", '{"b": 1, "a": null}')
    assert a == one(spark, ids.content_id("k"), "k string", '{"a":null,"b":1}') and a.startswith("item_") and len(a) == 13
    assert one(spark, ids.content_id("k"), "k string", "no json") is None


def test_config_hash_ignores_itself():
    assert ids.config_hash({"a": 1}) == ids.config_hash({"a": 1, "config_hash": "x"}) != ids.config_hash({"a": 2})


@pytest.mark.parametrize(("given", "made"), [("Show key metrics to managers", "Display main measures to managers"), ("SHOW it", "DISPLAY it"), ("shows", "shows"), ("", ""), (None, None), ("display / Show", "show / Display")])
def test_paraphrase(spark, given, made):
    assert one(spark, text.paraphrased(F.col("t")), "t string", given) == made


def test_drop_info(spark):
    assert one(spark, text.all_but_last(F.col("k")), "k array<string>", ["a", "b"]) == ["a"]
    assert one(spark, text.all_but_last(F.col("k")), "k array<string>", ["only"]) == ["only"]
    assert one(spark, text.all_but_last(F.col("k")), "k array<string>", None) is None


@pytest.mark.parametrize(("given", "task", "chart"), [("comp", "comparison", None), ("", "trend", "line"), ("bar chart", None, "bar"), ("grouped", None, "grouped_bar"), (" Time Series ", "trend", None), (None, None, None), ("funnel", None, "sankey")])
def test_normal_enum(spark, given, task, chart):
    a = one(spark, text.normal_enum(F.col("v"), vocab.TASKS, vocab.TASK_ALIASES), "v string", given)
    b = one(spark, text.normal_enum(F.col("v"), vocab.CHARTS, vocab.CHART_ALIASES), "v string", given)
    assert (a, b) == (task, chart)


@pytest.mark.parametrize(
    ("given", "made"),
    [('{"a":1} xyz', {"a": 1}), ('{"a":1,"a":2}', {"a": 2}), ('{"a":"x\ny"}', {"a": "x\ny"}), ("[1]", None), ('{"a":1,}', None), ("{'a':1}", None), ("", None), (None, None), ('{"a":1}{"b":2}', None), ('{"a":01}', None), ('[{"a":1}]', {"a": 1}), ('```json\n{"a": 1}\n``` {"b"', {"a": 1}), ('```\n{"a": "}"}\n```', {"a": "}"}), ('{"a": {"b": 1}} }', None), ('x { y {"a":1}', None), ("[" * 100_000, None), ('{"a":' * 100_000, None)],
)
def test_find_object(given, made):
    assert jsonout.find_object(given) == made


def parsed(spark, value):
    return one(spark, jsonout.parsed_output("t"), "t string", value if value is None or isinstance(value, str) else json.dumps(value))


FULL = {k: [] if k in ("kpi_chart_mapping", "interactions", "rationales") else {} for k in vocab.REQUIRED_KEYS}


def test_parse_output(spark):
    ok = parsed(spark, FULL)
    assert ok["valid"] and ok["error"] is None and ok["filled_keys"] == [] and len(ok["keys"]) == 6
    bad = parsed(spark, FULL | {"kpi_chart_mapping": [{"task_type": "trend", "chart_type": "column chart"}], "rationales": ["why", 3], "interactions": {"type": "x"}})
    assert not bad["valid"] and bad["mapping"][0]["chart_type"] == "bar" and [r.asDict() for r in bad["rationales"]] == [{"claim": "why", "principle": ""}] and bad["interactions"] == ['{"type": "x"}']
    assert parsed(spark, "none")["error"] == "no_json_found"
    assert parsed(spark, '{"layout": 3}')["error"] == "schema_error"


def test_repair_of_entries(spark):
    entry = {"kpi": "a", "task_type": " Trend-based", "chart_type": "Line Graph", "alternatives": ["column", 3, None, "zzz", " Pie "], "encoding": {"x": "d"}}
    out = parsed(spark, FULL | {"kpi_chart_mapping": [entry, {"task_type": "zzz", "chart_type": "bar", "kpi": 3}, "no entry", None]})
    assert out["error"] is None and [m.asDict() for m in out["mapping"]] == [{"kpi": "a", "task_type": "trend", "chart_type": "line", "alternatives": ["bar", "pie"], "encoding": '{"x": "d"}'}]
    assert parsed(spark, FULL | {"kpi_chart_mapping": [entry | {"kpi": 3}]})["error"] == "schema_error"
    assert parsed(spark, FULL | {"kpi_chart_mapping": [entry | {"encoding": "x"}]})["error"] == "schema_error"
    assert parsed(spark, FULL | {"kpi_chart_mapping": {}})["error"] == parsed(spark, FULL | {"rationales": [{"claim": 3}]})["error"] == "schema_error"
    none = parsed(spark, None)
    assert (none["error"], none["mapping"], none["keys"], none["valid"]) == ("no_json_found", None, [], False)


def test_contract_is_a_schema():
    good = FULL | {"kpi_chart_mapping": [{"task_type": "trend", "chart_type": "line"}]}
    assert jsonout.obeys(good, jsonout.CONTRACT) and jsonout.obeys({}, jsonout.PARTIAL) and not jsonout.obeys({}, jsonout.CONTRACT)
    for wrong in ({"layout": []}, {"kpi_chart_mapping": [{"task_type": "trend"}]}, {"kpi_chart_mapping": [{"task_type": "trend", "chart_type": "column"}]}, {"rationales": ["x"]}, {"interactions": {}}):
        assert not jsonout.obeys(good | wrong, jsonout.CONTRACT)


def test_judge_scores(spark):
    scores = lambda t: one(spark, jsonout.judge_scores(F.col("t"), list(vocab.RUBRIC)), "t string", t)
    assert scores('reasoning... {"chart_appropriateness": 5, "overall_usefulness": "3", "layout_quality": "x", "styling_accessibility": 9}') == {"chart_appropriateness": 5, "overall_usefulness": 3, "styling_accessibility": 5}
    assert scores("no") is None and scores("{}") is None and scores(None) is None and scores('{"layout_quality": NaN}') is None
    assert scores('{"layout_quality": 2.5, "overall_usefulness": 3.5}') == {"layout_quality": 2, "overall_usefulness": 4}


def test_rendered_outputs(spark):
    show = lambda t: one(spark, jsonout.rendered(jsonout.parsed_output("t"), F.col("t")), "t string", t)
    assert show("x" * 5000) == vocab.RAW_LEAD + "x" * 4000 + "\n```" and vocab.NO_OUTPUT in show(None) and vocab.NO_OUTPUT in show("")
    full = {"context_summary": {"audience": "all", "n": 3}, "kpi_chart_mapping": [{"kpi": "a", "task_type": "trend", "chart_type": "line", "alternatives": ["bar", "pie"]}], "layout": {}, "interactions": ["drill"], "rationales": [{"claim": "c", "principle": "p"}]}
    assert show(json.dumps(full)) == (
        "**Context summary**\n- audience: all\n- n: 3\n\n**KPI → chart mapping**\n\n| KPI | Task | Chart | Alternatives |\n|---|---|---|---|\n| a | trend | line | bar, pie |\n\n"
        "**Interactions**\n- drill\n\n**Rationales**\n- c — _p_\n"
    )


def test_prompts_and_rendering(spark):
    ddl = "u string, g array<string>, k array<string>, c array<map<string,string>>, r string"
    cols = [F.col(x) for x in "ugkcr"]
    made = one(spark, text.user_message(*cols), ddl, "Team", [], ["A", "B"], [{"name": "d", "dtype": "datetime"}, {}], "")
    assert "**Goals:** N/A" in made and "**KPIs:** A, B" in made and "d (datetime), ? (?)" in made and "**Constraints:** None" in made and "  6. rationales" in made
    assert one(spark, text.prompt(text.user_message(*cols)), ddl, None, None, None, None, None).startswith("### System:")
    assert one(spark, F.size(text.messages(F.col("u"))), ddl, "x", None, None, None, None) == 2
    assert one(spark, text.query_text(F.col("u"), F.col("g"), F.col("k")), ddl, "", ["a"], [], None, None) == "a"
    block = one(spark, text.passages_block(F.col("p")), "p array<struct<source:string,heading:string,text:string>>", [("s", "h", "t"), ("s", None, "t2")])
    assert block == "[1] s — h\nt\n\n[2] s\nt2"
    assert one(spark, text.asks_to_clarify(F.col("u")), "u string", "I need more information about the KPIs.") is True
    assert one(spark, text.keyword_task(F.col("u")), "u string", "Sales by Region") == "part_to_whole"
    assert one(spark, text.keyword_task(F.col("u")), "u string", "zzz") is None
