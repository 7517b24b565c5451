import pytest
from briefmill.llm import mixture as mi
from pyspark.sql import functions as F


def docs(spark, sizes):
    rows = [(n * 10_000 + i, s, t) for n, (s, (count, t)) in enumerate(sizes.items()) for i in range(count)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("bucket", F.lit("clash"))


def targets(spark, rows):
    return spark.createDataFrame([(d, "all", s, w, m) for d, s, w, m in rows], "domain string, language string, source string, target_weight double, max_repeats int")


LEVELS = ["domain", "language", "source"]


def run(spark, sizes, rows, total=None, seed=42):
    mix, report = mi.mixture(docs(spark, sizes), targets(spark, rows), LEVELS, total=total, seed=seed)
    return [(r.doc_id, r.source, r.epoch) for r in mix.collect()], {r.source: r for r in report.collect()}


def test_shares_are_met(spark):
    mix, report = run(spark, {"a": (400, 10), "b": (1000, 7), "c": (50, 5), "none": (10, 5), None: (3, 9)}, [("x", "a", 0.5, 1), ("x", "b", 0.3, 2), ("y", "c", 0.1, 4), ("y", "gone", 0.1, 3)])
    taken = sum(r.tokens_taken for r in report.values())
    assert report["a"].share_reached == pytest.approx(0.5, abs=0.01) and report["b"].share_reached == pytest.approx(0.3, abs=0.01)
    assert report["c"].share_reached == pytest.approx(0.2, abs=0.01)  # its sibling has no documents
    assert report["gone"].tokens_taken == 0 and taken > 0 and len(mix) == len(set(mix))
    assert {s for _, s, _ in mix} == {"a", "b", "c"}
    for s, limit in (("a", 1), ("b", 2), ("c", 4)):
        assert max(e for _, x, e in mix if x == s) <= limit
    assert all(r.tokens_taken <= r.budget + 1e-6 for r in report.values())


def test_reproducible_and_seeded(spark):
    args = ({"a": (300, 3), "b": (300, 5)}, [("x", "a", 0.5, 1), ("y", "b", 0.5, 1)], 900)
    one, two = run(spark, *args), run(spark, *args)
    assert sorted(one[0]) == sorted(two[0]) and sorted(one[0]) != sorted(run(spark, *args, seed=1)[0])


def test_shortage_goes_to_siblings_first():
    leaves = [(("x", "a"), 0.25, 10.0), (("x", "b"), 0.25, 1000.0), (("y", "c"), 0.5, 1000.0)]
    assert mi.budgets(mi.tree_of(leaves), 100) == {("x", "a"): 10.0, ("x", "b"): 40.0, ("y", "c"): 50.0}
    leaves[1] = (("x", "b"), 0.25, 20.0)
    assert mi.budgets(mi.tree_of(leaves), 100) == {("x", "a"): 10.0, ("x", "b"): 20.0, ("y", "c"): 70.0}
    assert sum(mi.budgets(mi.tree_of(leaves), 1e9).values()) == 1030


def test_edges(spark):
    mix, report = run(spark, {"a": (5, 0), None: (2, 3)}, [("x", "a", 1.0, 3)])
    assert mix == [] and report["a"].share_reached == 0
    mix, _ = run(spark, {"a": (3, 100)}, [("x", "a", 1.0, 2)], total=450)
    assert len(mix) == 4 and max(e for *_, e in mix) == 2
    assert run(spark, {"a": (3, 100)}, [])[0] == []
    with pytest.raises(ValueError, match="more than one target"):
        run(spark, {"a": (3, 1)}, [("x", "a", 0.5, 1), ("y", "a", 0.5, 1)])


def test_one_document_larger_than_its_budget(spark):
    mix, report = run(spark, {"a": (1, 1000), "b": (100, 1)}, [("x", "a", 0.5, 1), ("y", "b", 0.5, 1)], total=100)
    assert report["a"].tokens_taken == 0 and report["b"].tokens_taken == 50


def test_levels_of_the_documents(spark):
    """Domain and language are columns of the documents; a source that runs short is made up for by those of its own branch first."""
    rows = [(n, s, d, la, 10) for n, (s, d, la) in enumerate([("a", "x", "en")] * 20 + [("b", "x", "en")] * 300 + [("b", "y", None)] * 300 + [("c", "y", "de")] * 300)]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, domain string, language string, n_tokens bigint")
    wanted = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 1), ("c", 0.25, 1), ("gone", 0.05, 2)], "source string, target_weight double, max_repeats int")
    mix, report = mi.mixture(counted, wanted, LEVELS, total=2000)
    by_branch = {(r.source, r.domain): r.t for r in mix.join(counted.select("doc_id", "domain"), "doc_id").groupBy("source", "domain").agg(F.sum("n_tokens").alias("t")).collect()}
    assert by_branch["a", "x"] == 200  # all that it has, of a budget of 800
    assert by_branch["b", "x"] > 900 and by_branch["b", "y"] < 400  # the branch of a takes what a falls short by
    got = {r.source: r for r in report.collect()}
    assert sum(r.tokens_taken for r in got.values()) >= 2000 - 4 * 10 and got["gone"].tokens_taken == 0
    assert all(0 <= r.budget - r.tokens_taken < 10.001 for r in got.values())


def test_branches_of_a_source_fall_short_together_by_less_than_a_document(spark):
    rows = [(n, "a", f"d{n % 7}", f"l{n % 5}", 3 + n % 11) for n in range(2000)] + [(5000 + n, "b", "d0", "l0", 7) for n in range(2000)]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, domain string, language string, n_tokens bigint")
    wanted = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_weight double, max_repeats int")
    _, report = mi.mixture(counted, wanted, LEVELS, total=9999)
    assert all(0 <= r.budget - r.tokens_taken <= 14 for r in report.collect())


def test_a_source_that_runs_short(spark, tiny):
    from briefmill.llm import queries

    rows = queries.p9_full_report(spark, tiny).collect()
    short = [r for r in rows if r.docs_there and r.budget < 0.99 * r.target_weight * sum(x.budget for x in rows)]
    assert short and all(r.tokens_taken <= r.budget + 1e-6 for r in rows)
    assert abs(sum(r.share_reached for r in rows) - 1) < 1e-9
