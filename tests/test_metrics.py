import json

import pytest
from briefmill.functions import vocab
from briefmill.operators import metrics, relational, retrieval
from pyspark.sql import functions as F

PRED = "item_id string, parsed struct<kpi_chart_mapping:array<struct<chart_type:string,alternatives:array<string>>>>, run string, pid int, variant string"
REF = "item_id string, ref int, kpi_chart_mapping array<struct<chart_type:string,alternatives:array<string>>>"


def joined(spark, preds, refs):
    p = spark.createDataFrame([(i, None if m is None else (m,), "r", n, "original") for n, (i, m) in enumerate(preds)], PRED)
    r = spark.createDataFrame([(i, n, m) for n, (i, m) in enumerate(refs)], REF)
    return metrics.with_reference(p, r, "item_id", "ref")


def topk(spark, preds, refs):
    return metrics.topk_accuracy(joined(spark, preds, refs), ["run"], F.col("parsed.kpi_chart_mapping"), F.col("parsed").isNotNull()).first().asDict()


LINE = [("line", None)]


def test_topk(spark):
    r = topk(spark, [("a", LINE), ("b", [(" Bar", ["Line"])])], [("a", LINE), ("b", LINE)])
    assert (r["n"], r["top_1_accuracy"], r["top_3_valid"], r["top_3_accuracy"], r["top_3_accuracy_supported"], r["n_with_alternatives"]) == (2, 50.0, True, 100.0, 100.0, 1)
    r = topk(spark, [("a", LINE), ("b", None)], [("a", LINE), ("b", [("bar", None)])])
    assert (r["n"], r["n_parse_failures"], r["top_1_accuracy"]) == (2, 1, 50.0)
    r = topk(spark, [("a", LINE), ("b", LINE)], [("a", LINE), ("b", LINE)])
    assert (r["n_with_alternatives"], r["top_3_valid"], r["top_3_accuracy"], r["top_3_accuracy_supported"]) == (0, False, None, None)


def test_topk_keeps_repeated_rows_and_last_reference(spark):
    r = topk(spark, [("a", LINE), ("a", LINE), ("z", LINE)], [("a", [("bar", None)]), ("a", LINE), ("b", []), (None, LINE)])
    assert (r["n"], r["top_1_accuracy"], r["per_kpi_accuracy"]) == (2, 100.0, 100.0)


def test_macro_f1(spark):
    j = joined(spark, [("a", LINE), ("b", LINE), ("c", None)], [("a", LINE), ("b", [("bar", None)]), ("c", [("bar", None)])])
    args = (j, ["run"], F.col("parsed.kpi_chart_mapping"), F.col("parsed").isNotNull())
    assert metrics.macro_f1(*args).first().macro_f1 == pytest.approx((2 / 3 + 0 + 0) / 3, abs=1e-4)
    assert metrics.macro_f1(*args, labels="gold").first().macro_f1 == pytest.approx((2 / 3) / 2, abs=1e-4)


def compliance(spark, texts):
    df = spark.createDataFrame([(t, 1) for t in texts], "raw_text string, run int")
    return metrics.schema_compliance(df, ["run"]).first()


def test_schema_compliance(spark):
    full = {k: [] if k in ("kpi_chart_mapping", "interactions", "rationales") else {} for k in vocab.REQUIRED_KEYS}
    chart = lambda c: json.dumps(full | {"kpi_chart_mapping": [{"task_type": "trend", "chart_type": c}]})
    r = compliance(spark, [chart("column chart"), chart("line")])
    assert (r.required_keys_rate, r.schema_validity_rate) == (100.0, 50.0)
    filled = {k: ["x"] if isinstance(v, list) else {"x": 0} for k, v in full.items()}
    r = compliance(spark, [json.dumps(full), json.dumps(filled)])
    assert (r.required_keys_rate, r.completeness_score) == (100.0, 0.5)
    r = compliance(spark, [None, "", "no json"])
    assert (r.n, r.json_parse_rate, r.completeness_score) == (3, 0.0, 0.0)


def test_robustness(spark):
    rows = [("a", LINE, "original"), ("b", LINE, "original"), ("a", LINE, "para"), ("b", [("bar", None)], "para"), ("c", LINE, "original")]
    p = spark.createDataFrame([(i, (m,), "r", n, v) for n, (i, m, v) in enumerate(rows)], PRED)
    gold = spark.createDataFrame([("a", ["line"]), ("b", ["line"])], "item_id string, gold array<string>")
    r = metrics.robustness(p, gold, ["run"], "item_id", "variant", "pid", F.col("parsed.kpi_chart_mapping"), F.col("parsed").isNotNull(), ("original", "para")).first()
    assert (r.n_shared, r.paraphrase_consistency, r.paraphrase_accuracy, r.paraphrase_accuracy_delta) == (2, 50.0, 50.0, -50.0)


def test_missing_info(spark):
    keys = json.dumps({k: {} for k in vocab.REQUIRED_KEYS})
    df = spark.createDataFrame([("I need more information about the KPIs to recommend a chart.", 1), (keys, 1)], "raw_text string, run int")
    r = metrics.missing_info(df, ["run"]).first()
    assert (r.missing_info_clarification_rate, r.missing_info_schema_rate) == (50.0, 50.0)


def test_grounding(spark):
    ddl = "run int, docs array<struct<text:string>>, rationales array<struct<claim:string,principle:string>>"
    rows = [(1, [("lines show trends over time",)], [("trends over time", ""), ("zebra giraffe elephants", None)]), (1, [], [("x", "y")]), (1, None, None), (1, [(None,)], [("a b", "c")])]
    r = metrics.grounding(spark.createDataFrame(rows, ddl), ["run"], F.col("docs"), F.col("rationales")).first()
    assert (r.unsupported_claim_rate, r.n, r.n_claims) == (50.0, 1, 2)


def test_grounding_by_an_encoder(spark):
    @F.udf("array<array<double>>")
    def encoder(texts):
        return [[1.0, 0.0] if "line" in t or "trend" in t else [0.0, float(t != "")] for t in texts]

    ddl = "run int, docs array<struct<text:string>>, rationales array<struct<claim:string,principle:string>>"
    rows = [(1, [("lines over time",), (None,)], [("a trend", ""), ("zebra", None)]), (1, [], [("x", "y")]), (1, [(None,)], [("a b", "c")])]
    df = spark.createDataFrame(rows, ddl)
    r = metrics.grounding(df, ["run"], F.col("docs"), F.col("rationales"), encoder).first()
    assert (r.unsupported_claim_rate, r.supported_claim_rate, r.n, r.n_claims, r["mode"]) == (75.0, 25.0, 2, 3, "semantic")
    assert metrics.grounding(df, ["run"], F.col("docs"), F.col("rationales")).first()["mode"] == "lexical_proxy"


def test_latency_skips_nulls(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 4.0, None, float("nan"))], "run int, latency_ms double")
    r = metrics.latency(df, ["run"]).first()
    assert (r.n, r.avg_latency_ms, r.p50_latency_ms) == (4, 2.5, 2.5) and abs(r.p95_latency_ms - 3.85) < 0.06


def test_judge_means(spark):
    df = spark.createDataFrame([("r", {"a": 4, "b": 4}), ("r", {"a": 2}), ("r", None)], "run string, s map<string,int>")
    got = {x.dimension: x["mean"] for x in metrics.judge_means(df, ["run"], "s").collect()}
    assert got == {"a": 3.0, "b": 4.0, "overall": pytest.approx(3.333)}


def test_tfidf_and_dense(spark):
    chunks = spark.createDataFrame([("a", "use a line chart for trends over time"), ("b", "ensure sufficient contrast ratio for accessibility")], "id string, text string")
    asked = spark.createDataFrame([(1, "line chart trend over time"), (2, "zzz"), (3, None)], "q int, t string")
    hits = retrieval.tfidf_topk(asked, chunks, "q", "t", "id", "text", 2).collect()
    assert [(h.q, h.id, h["rank"]) for h in hits] == [(1, "a", 1)]
    assert retrieval.bm25_topk(asked, chunks, "q", "t", "id", "text", 2).first().id == "a"
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", None), ("d", [3.0, 0.0])], "id string, v array<double>")
    hits = retrieval.dense_topk(spark.createDataFrame([(1, [5.0, 0.1])], "q int, v array<double>"), corpus, "q", "id", "v", 2).collect()
    assert [h.id for h in sorted(hits, key=lambda h: h["rank"])] == ["d", "a"]  # equal scores: the later id first


def test_dense_equals_brute_force(spark, tiny):
    import numpy as np

    own = spark.read.parquet(f"{tiny}/embeddings.parquet")
    rows = own.collect()
    m = np.array([r.embedding for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {}
    for i, r in enumerate(rows):
        if r.vec_id % 20 == 0:
            s = np.round(m @ m[i], 6)
            s[i] = -9
            want[r.vec_id] = sorted(range(len(rows)), key=lambda j: (-s[j], -rows[j].vec_id))[:3]
    got = retrieval.dense_topk(own.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding"), own, "q", "vec_id", "embedding", 3, True).collect()
    found = {}
    for h in sorted(got, key=lambda h: h["rank"]):
        found.setdefault(h.q, []).append(h.vec_id)
    same = sum(len({rows[j].vec_id for j in v} & set(found[k])) for k, v in want.items())
    assert same >= 0.99 * 3 * len(want)


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 3, "z"), (None, 4, "y")], "k string, o int, v string")
    assert sorted([tuple(r) for r in relational.first_wins(df, ["k"], ["o"]).collect()], key=str) == [("a", 1, "x"), (None, 3, "z")]
    assert sorted([tuple(r) for r in relational.last_wins(df, ["k"], ["o"]).collect()], key=str) == [("a", 2, None), (None, 4, "y")]
    todo = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r.k for r in relational.resume(todo, df, ["k"]).collect()] == ["b"]
    z = spark.createDataFrame([([1, 2, 3], [9])], "a array<int>, b array<int>").select(relational.zipped(F.col("a"), F.col("b")).alias("z")).first().z
    assert [tuple(x) for x in z] == [(1, 9)]
    assert relational.pool([df.limit(0), df], "k", "o").count() == 2


def test_latency_percentiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    groups = {"a": rng.lognormal(6, 2, 3001).tolist(), "b": [5.0] * 100, None: [-3.0, 0.0, 1e12, 2.5], "c": rng.integers(0, 9, 777).astype(float).tolist(), "one": [7.25]}
    rows = [(g, v, "clash") for g, values in groups.items() for v in values] + [("a", None, "x"), ("a", float("nan"), "x"), ("none", None, "x")]
    got = {r.g: r for r in metrics.latency(spark.createDataFrame(rows, "g string, latency_ms double, r string"), ["g"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values) and got[g].avg_latency_ms == pytest.approx(np.mean(values), abs=0.051, rel=1e-9)
        for q, name in ((0.5, "p50_latency_ms"), (0.95, "p95_latency_ms")):
            assert got[g][name] == pytest.approx(np.quantile(values, q), abs=0.051, rel=1e-9)


def test_rows_of_smaller_values(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    values = np.unique(np.concatenate([rng.normal(0, 50, 400).round(3), [0.0, -1e9, 1e250, 0.0004, -0.0004]]))
    rows = [(g, float(v), int(k)) for g in ("a", None) for v, k in zip(values, rng.integers(1, 5, len(values)), strict=True)]
    got = relational.with_below(spark.createDataFrame(rows, "g string, v double, k bigint"), ["g"], "v", "k").collect()
    assert len(got) == len(rows) and all(r.below == sum(k for g, v, k in rows if g == r.g and v < r.v) for r in got)


def test_dense_in_blocks_equals_dense_at_once(spark, tiny, monkeypatch):
    own = spark.read.parquet(f"{tiny}/embeddings.parquet")
    asked = own.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    run = lambda: sorted(map(tuple, retrieval.dense_topk(asked, own, "q", "vec_id", "embedding", 3, True).select("q", "vec_id", "rank").collect()))
    whole = run()
    monkeypatch.setattr(retrieval, "FLOATS", 600)
    assert run() == whole and len(whole) > 0


def test_dense_with_an_embedder(spark):
    chunks = spark.createDataFrame([("a", "use a line chart for trends"), ("b", "contrast ratio"), ("c", None)], "id string, text string")
    asked = spark.createDataFrame([(1, "line chart"), (2, "zzz"), (3, None)], "q int, t string")
    hits = retrieval.RETRIEVERS.get("dense")(asked, chunks, "q", "t", "id", "text", 2).collect()
    assert [(h.q, h.id, h["rank"]) for h in hits] == [(1, "a", 1)]
    own = lambda text: F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))
    assert retrieval.embedded_topk(asked, chunks, "q", "t", "id", "text", 1, own).count() == 3
    with pytest.raises(KeyError):
        retrieval.embedded_topk(asked, chunks, "q", "t", "id", "text", 1, "none")


def test_ranks_of_large_groups_equal_ranks_in_windows(spark):
    rows = [(g, n, float(n * 7 % 23)) for g in ("a", "b") for n in range(60)] + [("a", 99, None)]
    df = spark.createDataFrame(rows, "g string, n int, v double")
    want = {(r.g, r.n): r.r for r in df.dropna().select("g", "n", relational.average_rank("v", ["g"]).alias("r")).collect()}
    assert want == {(r.g, r.n): r["rank"] for r in relational.ranked(df, ["g"], "v").collect()}
