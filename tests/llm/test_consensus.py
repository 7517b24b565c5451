import numpy as np
from briefmill.llm import consensus as co
from briefmill.llm import queries
from pyspark.sql import functions as F

DDL = "rating_id bigint, rater_id string, unit_id string, scores map<string,int>, timestamp string, received_at timestamp, rater string, s string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL.replace("received_at timestamp", "received_at string")).withColumn("received_at", F.to_timestamp("received_at"))


def simulated(n_units=600, seed=0):
    """Raters of known care; some always say 5, some say one more than they mean, some guess."""
    rng = np.random.default_rng(seed)
    care = {**{f"good{i}": 0.9 for i in range(6)}, **{f"poor{i}": 0.55 for i in range(6)}, **{f"guess{i}": None for i in range(4)}, **{f"five{i}": 5 for i in range(3)}}
    truth, rows, n = {}, [], 0
    for u in range(n_units):
        t = truth[f"u{u}"] = int(rng.choice(5, p=[0.08, 0.17, 0.3, 0.3, 0.15])) + 1
        for r in rng.choice(sorted(care), 5, replace=False):
            c = care[r]
            if c is None:
                s = int(rng.integers(1, 6))
            elif c == 5:
                s = 5
            else:
                s = t if rng.random() < c else int(np.clip(t + rng.choice([-1, 1]), 1, 5))
            rows.append((n, r if n % 3 else f" {r.upper()} ", f"u{u}", {"d": s}, "2026-01-01T00:00:00", "2026-01-01 00:00:00", None, None))
            n += 1
    return rows, truth


def test_recovers_truth_and_care(spark):
    rows, truth = simulated()
    units, raters = co.judged(frame(spark, rows))
    got = {r.unit_id: r.score for r in units.collect()}
    right = np.mean([got[u] == t for u, t in truth.items()])
    votes = {}
    for _, _, u, s, *_ in rows:
        votes.setdefault(u, []).append(s["d"])
    majority = np.mean([max(set(v), key=lambda x: (v.count(x), -x)) == truth[u] for u, v in votes.items()])
    assert right > 0.8 and right > majority + 0.03
    care = {r.rater: r.reliability for r in raters.collect()}
    kinds = {k: np.mean([v for r, v in care.items() if r.startswith(k)]) for k in ("good", "poor", "guess", "five")}
    assert kinds["good"] > kinds["poor"] > max(kinds["guess"], kinds["five"]) + 0.2
    assert abs(kinds["guess"]) < 0.15


def test_only_the_latest_rating_counts(spark):
    base = [(100 + i, f"r{i}", "u", {"d": 4}, "2026-01-01 10:00:00", "2026-01-01 10:00:00", None, None) for i in range(2)]
    mine = [
        (1, "r9", "u", {"d": 1, "e": 2}, "2026-01-01T09:00:00", "2026-01-05 00:00:00", None, None),
        (2, " R9 ", "u", {"d": 2}, "1767265200", "2026-01-01 00:00:00", None, None),  # 11:00
        (3, "r9", "u", {"d": 4}, "01.01.2026 12:00:00", "2026-01-01 00:00:00", None, None),
        (4, "r9", "u", {"d": 3}, "garbage", "2026-01-09 00:00:00", None, None),
        (5, None, "u", {"d": 1}, "2027-01-01T09:00:00", "2026-01-05 00:00:00", None, None),
        (6, "  ", "u", {"d": 1}, "2027-01-01T09:00:00", "2026-01-05 00:00:00", None, None),
    ]
    got = {(r.rater, r.dimension): r.s for r in co.votes(frame(spark, base + mine)).collect()}
    assert got == {("r0", "d"): 4, ("r1", "d"): 4, ("r9", "d"): 4}
    units, _ = co.judged(frame(spark, base + mine))
    assert [(r.unit_id, r.dimension, r.score, r.n_raters) for r in units.collect()] == [("u", "d", 4, 3)]


def test_invalid_scores_and_few_raters(spark):
    rows = [(i, f"r{i}", "u", {"d": s}, "2026-01-01 10:00:00", "2026-01-01 10:00:00", None, None) for i, s in enumerate([0, 6, None, 55, 3, 3])]
    rows += [(9, "r9", "v", None, None, None, None, None), (10, "r9", "w", {}, None, None, None, None)]
    assert co.judged(frame(spark, rows))[0].count() == 0
    empty, raters = co.judged(frame(spark, []))
    assert empty.count() == 0 and raters.count() == 0


def test_hot_unit_without_pairs(spark):
    """A unit that thousands rate is a histogram; its consensus is what most say."""
    rows = [(i, f"r{i}", "hot", {"d": 4 if i % 3 else 2}, "2026-01-01 10:00:00", "2026-01-01 10:00:00", None, None) for i in range(3000)]
    units, _ = co.judged(frame(spark, rows))
    r = units.first()
    assert (r.score, r.n_raters) == (4, 3000) and abs(r.agreement - 5 / 9) < 0.01


def test_units_of_one_and_two_raters(spark, tmp_path):
    """p4_units has every unit with a valid score, p4_found only those of three raters; pairs of two-rater units count as observed."""
    scores = {"one": [4], "two": [3, 3], "split": [1, 5], "three": [2, 2, 2]}
    rows = [(10 * k + i, f"r{i}", u, {"d": s}, "2026-01-01 10:00:00", "2026-01-01 10:00:00", None, None) for k, (u, given) in enumerate(scores.items()) for i, s in enumerate(given)]
    frame(spark, rows).write.parquet(f"{tmp_path}/human_ratings.parquet")
    units = {r.unit_id: (r.n_raters, r.agreement) for r in queries.p4_units(spark, str(tmp_path)).collect()}
    assert units == {"one": (1, None), "two": (2, 1.0), "split": (2, 0.0), "three": (3, 1.0)}
    assert [r.unit_id for r in queries.p4_found(spark, str(tmp_path)).collect()] == ["three"]
    r = queries.p4_agreement(spark, str(tmp_path)).first()
    assert (r.n_units, round(r.observed, 6)) == (3, round(5 / 7, 6))


def test_times_do_not_depend_on_the_session_zone(spark):
    given = ["2026-01-01T11:00:00", "2026-01-01 11:00:00", "01.01.2026 11:00:00", "1767265200", "2026-01-01T12:00:00+01:00", "2026-01-01", "garbage", None]
    want = [1767265200_000000] * 5 + [1767225600_000000, None, None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
            assert [r.m for r in df.select("i", co.moment(F.col("t")).alias("m")).orderBy("i").collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_triplets_give_the_average_rater():
    """Tables of exact rates are taken apart into the shares and rows that they were made of."""
    rng = np.random.default_rng(5)
    rows = 0.6 * np.eye(5) + 0.4 * rng.dirichlet(np.ones(5), 5)
    shares = rng.dirichlet(np.full(5, 4.0))
    three = 1e9 * np.einsum("y,ya,yb,yc->abc", shares, rows, rows, rows)
    got_shares, got_rows = co.average_rater(three, three.sum(2))
    assert np.allclose(got_shares, shares, atol=1e-4) and np.allclose(got_rows, rows, atol=1e-4)
    met = np.einsum("rst,tb->rsb", 100 * rng.random((3, 5, 5)), rows)
    assert np.allclose(co.solved(met, rows) @ rows, met, rtol=0.02)


def test_no_triplets_still_tell_a_consensus(spark):
    """Pairs alone: one accuracy for all raters."""
    rows = [(2 * u + k, f"r{(u + k) % 5}", f"u{u}", {"d": 4 if u % 2 else 2}, "2026-01-01 10:00:00", "2026-01-01 10:00:00", None, None) for u in range(40) for k in range(2)]
    units, _ = co.judged(frame(spark, rows), least=2)
    assert {(r.unit_id, r.score) for r in units.collect()} == {(f"u{u}", 4 if u % 2 else 2) for u in range(40)}
