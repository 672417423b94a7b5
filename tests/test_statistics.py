import math
import time

import numpy as np
import pytest

from gaugeworks.operators import integrity, neighbours, splits, statistics, studies


def test_holm(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "k string, p double")
    got = {r.k: (round(r.p_holm, 6), r.rejected) for r in statistics.holm(p, "p", "k").collect()}
    assert got == {"d": (0.02, True), "a": (0.03, True), "c": (0.06, False), "b": (0.06, False)}
    assert statistics.holm(p.limit(0), "p", "k").count() == 0


def test_exact_tails():
    assert math.isnan(statistics.binomial_upper_bound(0, 0)) and statistics.binomial_upper_bound(3, 3) == 1.0
    assert statistics.binomial_upper_bound(0, 20) == pytest.approx(1 - 0.05 ** (1 / 20))
    assert statistics.sign_test(5, 5) == pytest.approx(1 / 32) and statistics.sign_test(0, 0) == 1.0 and statistics.sign_test(4, 5) == pytest.approx(6 / 32)
    assert statistics.exceedance_p(0, 10, 10, 1) == 1.0
    # one calibration score, one test score: either is the larger with chance 1/2
    assert statistics.exceedance_p(1, 1, 1, 1) == pytest.approx(0.5)


def test_tails_of_many_rows():
    """Sums of millions of terms would take hours; the values are those of exact arithmetic."""
    n, wins = 4000, 2100
    assert statistics.sign_test(wins, n) == pytest.approx(sum(math.comb(n, i) for i in range(wins, n + 1)) / 2**n, rel=1e-11)
    for k, n, p in ((3, 50, 0.2), (30, 50, 0.2), (49, 50, 0.9), (0, 9, 0.5), (8, 9, 0.01)):
        assert statistics.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-11)
    assert statistics.exceedance_p(3, 7, 9, 2) == pytest.approx(sum(math.comb(7, i) * math.comb(9, 4 - i) for i in (3, 4)) / math.comb(16, 4))
    start = time.perf_counter()
    assert statistics.sign_test(10**7 // 2, 10**7) == pytest.approx(0.5 + 0.5 / math.sqrt(math.pi * 10**7 / 2), rel=1e-9)
    bound = statistics.binomial_upper_bound(190_000, 19_000_000)
    assert bound == pytest.approx(0.01 + 1.6449 * math.sqrt(0.01 * 0.99 / 19e6), rel=1e-4)
    assert statistics.exceedance_p(190_000, 19_000_000, 100, 1) == pytest.approx(0.99**100, rel=1e-3)
    assert time.perf_counter() - start < 20


def test_exceedance_is_calibrated():
    rng = np.random.default_rng(0)
    ps = []
    for _ in range(600):
        x = rng.random(60)
        t = np.sort(x[:30])[-2]
        ps.append(statistics.exceedance_p(int((x[30:] > t).sum()), 30, 30, 2))
    assert np.mean(np.array(ps) <= 0.1) <= 0.13


def test_wilcoxon(spark):
    d = spark.createDataFrame([(float(i), 0.0) for i in (1, 2, 3, 4, 5, 6, -7)], "a double, b double")
    r = statistics.wilcoxon(d, "a", "b")
    assert (r["n"], r["statistic"]) == (7, 7.0)
    ways = sum(1 for m in range(128) if sum(k + 1 for k in range(7) if m >> k & 1) <= 7)
    assert r["p_value"] == pytest.approx(2 * ways / 128)
    assert statistics.wilcoxon(d.limit(3), "a", "b")["p_value"] == 1.0


def test_identical_arms(spark):
    d = spark.createDataFrame([(i, i % 2, float(i * 7 % 11)) for i in range(40)], "i int, y int, s double").withColumn("t", __import__("pyspark").sql.functions.col("s"))
    r = statistics.paired_bootstrap(d, "i", "y", "s", "t", 30).first()
    assert r.difference == 0 and r.p_value == 1.0


def test_resample_weights(spark):
    w = statistics.resample_weights(spark.range(50), "id", 8, 1)
    assert {r["sum(weight)"] for r in w.groupBy("resample").sum("weight").collect()} == {50}


def test_splits(spark):
    d = spark.range(101).withColumnRenamed("id", "i")
    c = splits.carve(d, "i", 0.2, 1)
    assert c.where("split = 'validation'").count() == 20 and c.count() == 101
    small, large = ({r.i for r in splits.first_of(d, "i", n, 3).collect()} for n in (10, 40))
    assert small < large
    sizes = [r["count"] for r in splits.folds(d, "i", 4, 2).groupBy("fold").count().collect()]
    assert sorted(sizes) == [25, 25, 25, 26]
    both = splits.ensure_validation(d.withColumn("split", __import__("pyspark").sql.functions.lit("train")), "i", "split", 0.1, 0)
    assert both.where("split = 'validation'").count() == 10
    bad = d.withColumn("y", __import__("pyspark").sql.functions.lit(1))
    with pytest.raises(Exception, match="anomalous"):
        splits.carve(bad, "i", 0.2, 1, label="y").collect()


def test_hamming_bands_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 6)
    rows = [(i, int(np.int64(base[i % 6]) ^ np.int64(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False))))) for i in range(60)] + [(60, int(base[0])), (61, int(base[0]))]
    d = spark.createDataFrame(rows, "i int, h long")
    want = {(a, b, bin((x ^ y) & (2**64 - 1)).count("1")) for a, x in rows for b, y in rows if a < b and bin((x ^ y) & (2**64 - 1)).count("1") <= 4}
    assert {tuple(r) for r in integrity.hamming_pairs(d, "i", "h", 4).collect()} == want and want


def test_knn_in_blocks_equals_whole(spark):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(80)], "i long, v array<double>")
    whole = neighbours.knn_join(d, d, 3, "i", "v", exclude_self=True).collect()
    parts = neighbours.knn_join(d, d, 3, "i", "v", exclude_self=True, limit=600).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) == 240
    assert neighbours.knn_join(d.limit(5), d.limit(2), 9, "i", "v").groupBy("i").count().first()["count"] == 2


def test_moments_and_shrinkage(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5)) * np.arange(1, 6)
    d = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(3)
    n, mean, cov = neighbours.moments(d, "v")
    assert n == 200 and mean == pytest.approx(x.mean(0)) and cov == pytest.approx(np.cov(x.T, bias=True))
    _, shrunk, s = neighbours.ledoit_wolf(d, "v")
    assert 0 <= s <= 1 and np.trace(shrunk) == pytest.approx(np.trace(cov))
    m, comps, held = neighbours.pca_fit(d, "v", 5)
    assert held == pytest.approx(1.0)
    assert max(r.score for r in neighbours.pca_residual(d, "v", m, comps).collect()) < 1e-9


def test_guards_and_upsert(spark):
    d = spark.createDataFrame([(1, 0.1), (2, 0.5)], "i int, m double")
    limits = studies.guard_limits(d, ("m",))
    got = studies.guard_check(spark.createDataFrame([(3, 0.3), (4, 0.9)], "i int, m double"), limits, ("m",)).orderBy("i").collect()
    assert [(r.ok, r.reasons) for r in got] == [(True, []), (False, ["m"])] and limits.first().false_flag_bound == pytest.approx(2 / 3)
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, v int, x int")
    assert sorted((r.k, r.x) for r in studies.latest(rows, ("k",), "v").collect()) == [("a", 6), ("b", 7)]
