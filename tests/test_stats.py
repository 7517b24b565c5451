import itertools
import math

import numpy as np
import pytest
from briefmill.operators import human, report, stats
from briefmill.operators.relational import pairs_of
from pyspark.sql import functions as F


def pairs(spark, x, y):
    return spark.createDataFrame([("A", "B", f"i{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "a string, b string, item string, x double, y double")


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "ord int, p double")
    assert [round(r.p_holm, 9) for r in stats.holm(df, "p", ["ord"], []).orderBy("ord").collect()] == [0.03, 0.06, 0.06]


def test_cliffs_delta(spark):
    r = stats.cliffs_delta(pairs(spark, [5, 6, 7], [1, 2, 3])).first()
    assert (r.delta, r.magnitude) == (1.0, "large")
    assert stats.cliffs_delta(pairs(spark, [1, 1, 1], [1, 1, 1])).first().delta == 0.0


def test_cliffs_delta_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
    want = np.sign(x[:, None] - y[None, :]).mean()
    assert stats.cliffs_delta(pairs(spark, x, y)).first().delta == pytest.approx(want, abs=1e-4)


def test_wilcoxon(spark):
    r = stats.wilcoxon(pairs(spark, [3, 4, 5, 4, 5, 4], [1, 2, 2, 1, 2, 1])).first()
    assert r.statistic == 0 and 0 < r.p_value < 0.05 and r.p_holm == r.p_value and r.reject_h0
    r = stats.wilcoxon(pairs(spark, [1, 1], [1, 1])).first()
    assert (r.statistic, r.p_value) == (0.0, 1.0)


def test_signed_rank_p_equals_enumeration():
    for n in (1, 4, 7):
        sums = [sum(i + 1 for i in range(n) if s[i]) for s in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert stats.signed_rank_p(w, n, 0) == pytest.approx(min(1.0, 2 * sum(x <= w for x in sums) / 2**n))


def test_chi2_tail():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(0, 4) == 1.0


def test_mcnemar(spark):
    r = stats.mcnemar(pairs(spark, [1, 1, 0, 1], [0, 1, 0, 0])).first()
    assert (r.n_b, r.n_c, r.p_value) == (2, 0, 0.5)
    assert stats.mcnemar(pairs(spark, [1], [1])).first().p_value == 1.0
    assert stats.binomial_two_sided(480, 1001) == pytest.approx(stats.binomial_two_sided(480, 1000), abs=0.02)


def test_effects(spark):
    r = stats.effects(pairs(spark, [2, 4, 4, 6], [1, 2, 3, 4])).first()
    assert r.rank_biserial == 1.0 and r.cohen_dz > 0
    r = stats.effects(pairs(spark, [1, 1], [1, 1])).first()
    assert (r.rank_biserial, r.cohen_dz) == (0.0, 0.0)


def scores(spark, columns):
    rows = [(f"i{i}", m, float(v)) for m, vs in columns.items() for i, v in enumerate(vs)]
    return stats.complete(spark.createDataFrame(rows, "item string, method string, value double"), "item", "method", "value", list(columns))


def test_friedman_and_cochran(spark):
    s = scores(spark, {"a": [1, 2, 3, 4], "b": [2, 3, 4, 5], "c": [3, 4, 5, 6]})
    r = stats.friedman(s, "item", ["a", "b", "c"]).first()
    assert r.chi2 == pytest.approx(8.0) and r.p_value == pytest.approx(math.exp(-4))
    two = scores(spark, {"a": [1, 0], "b": [1, 1]})
    assert not stats.cochran_q(two, "item", ["a", "b"]).first().applicable
    same = scores(spark, {"a": [1, 0], "b": [1, 0], "c": [1, 0]})
    q = stats.cochran_q(same, "item", ["a", "b", "c"]).first()
    assert (q.q, q.p_value) == (0.0, 1.0)


def test_bootstrap(spark):
    point, low, high = stats.bootstrap_ci(np.array([1, 2, 3, 4, 5.0]), n_boot=500)
    assert low <= point == 3.0 <= high and stats.bootstrap_ci(np.array([])) == (None, None, None)
    df = spark.createDataFrame([("g", str(i), float(i % 7)) for i in range(300)], "g string, i string, v double")
    r = stats.bootstrap_means(df, ["g"], "i", "v", 300).first()
    assert r.n == 300 and r.ci_low < r.point < r.ci_high and r.ci_high - r.ci_low < 1
    again = stats.bootstrap_means(df.repartition(5), ["g"], "i", "v", 300).first()
    assert r.ci_low == pytest.approx(again.ci_low)


def alpha(spark, units, level="ordinal"):
    rows = [(f"u{i}", float(v)) for i, u in enumerate(units) for v in u]
    got = stats.krippendorff(spark.createDataFrame(rows, "unit string, v double"), [], "unit", "v", level).first()
    return got.alpha if got else None


def test_krippendorff(spark):
    assert alpha(spark, [[3, 3], [5, 5], [2, 2]]) == 1.0
    assert alpha(spark, [[1, 5]] * 4) < 0
    assert alpha(spark, [[3]]) is None
    assert 0 < alpha(spark, [[4, 4, 5], [3, 3, 2], [5, 5, 5], [2, 3, 2]]) <= 1
    assert alpha(spark, [[2, 2], [2, 2]]) == 1.0


def test_krippendorff_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    units = [list(rng.integers(1, 6, rng.integers(2, 5))) for _ in range(20)]
    n = sum(map(len, units))
    seen = sum(abs(int(a) - int(b)) ** 2 / (len(u) - 1) for u in units for i, a in enumerate(u) for j, b in enumerate(u) if i != j) / n
    flat = [int(v) for u in units for v in u]
    chance = sum((a - b) ** 2 for i, a in enumerate(flat) for j, b in enumerate(flat) if i != j) / (n * (n - 1))
    assert alpha(spark, units, "interval") == pytest.approx(1 - seen / chance, abs=1e-4)


def test_pairs_keep_the_order_given(spark):
    df = spark.createDataFrame([("i", "z", 2.0), ("i", "a", 1.0), ("j", "z", 1.0)], "item string, m string, v double")
    r = pairs_of(df, "item", "m", "v", {"z": 0, "a": 1}).collect()
    assert [(x.a, x.b, x.x, x.y) for x in r] == [("z", "a", 2.0, 1.0)]


def test_assignment(spark):
    items = spark.createDataFrame([(f"i{k}",) for k in range(10)], "item_id string")
    units = human.units(items, ["a", "b", "c", "d"])
    raters = [f"r{i}" for i in range(6)]
    rows = human.assignment(units, raters, 3).collect()
    by_unit = {}
    for r in rows:
        by_unit.setdefault(r.unit_id, set()).add(r.rater)
    loads = [sum(r.rater == x for r in rows) for x in raters]
    assert len(by_unit) == 40 and all(len(v) == 3 for v in by_unit.values()) and max(loads) - min(loads) <= 1
    with pytest.raises(ValueError):
        human.assignment(units, ["r1", "r2"], 3)
    done = spark.createDataFrame([(r.rater, r.unit_id) for r in rows if r.task_order <= 2 and r.rater == "r0"], "rater_id string, unit_id string")
    nxt = {r.rater: r for r in human.next_tasks(human.assignment(units, raters, 3), done).collect()}
    assert nxt["r0"].task_order == 3 and nxt["r0"].n_done == 2 and nxt["r1"].task_order == 1


def test_eval_items(spark):
    ddl = "item_id string, method_name string, raw_text string, prediction_id int"
    p = spark.createDataFrame([("a", "prompt_only", "1", 1), ("b", "prompt_only", "2", 2), ("a", "ft", "3", 3), ("c", "ft", "4", 4), ("a", "ft", "5", 5)], ddl)
    refs = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    got = human.eval_items(p, refs, ["prompt_only", "ft"]).collect()
    assert [(r.item_id, r.outputs) for r in got] == [("a", {"ft": "5", "prompt_only": "1"})]


def test_reports(spark):
    assert dict(report.flattened({"a": {"b": 1, "c": [1]}, "d": None})) == {"a.b": 1, "a.c": [1], "d": None}
    assert report.number(0.5) == "0.5" and report.number(None) == "" and report.number(3.0) == "3" and report.number("x") == "x"
    assert report.markdown_table([{"a": 1.23456}], ["a", "b"]) == "| a | b |\n|---|---|\n| 1.235 |  |"
    assert report.select_metric(["x.avg_latency_ms", "x.avg_latency_s"], "avg_latency_s") == "x.avg_latency_s"
    df = spark.createDataFrame([("m", "k", "1"), ("m", "k", "3"), ("m", "k", "x"), (None, "k", "5")], "g string, name string, v string")
    r = report.pooled(df, ["g"], "name", "v").collect()
    assert len(r) == 1 and (r[0]["mean"], r[0]["count"]) == (2.0, 2) and r[0]["std"] == pytest.approx(math.sqrt(2))


def test_ten_thousand_resamples_by_default(spark):
    df = spark.createDataFrame([("g", f"i{i}", float(i * i % 17)) for i in range(40)], "g string, i string, v double")
    ends = lambda *n: tuple(stats.bootstrap_means(df, ["g"], "i", "v", *n).select("ci_low", "ci_high").first())
    assert ends() == ends(10_000) != ends(1000)
