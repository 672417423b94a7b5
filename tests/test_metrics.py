import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import pooled, ranking, rasters, thresholds


def table(spark, labels, scores):
    return spark.createDataFrame([(int(y), float(s)) for y, s in zip(labels, scores, strict=True)], "y int, s double")


def brute_auroc(y, s):
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    return np.mean([(p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)])


def test_auroc_against_pairs(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 60), rng.integers(0, 12, 60)
    assert ranking.roc_auc(table(spark, y, s), "y", "s").first().auroc == pytest.approx(brute_auroc(y, s))


@pytest.mark.parametrize("s, want", [([1, 1, 1, 1], 0.5), ([0, 1, 2, 3], 1.0), ([3, 2, 1, 0], 0.0)])
def test_auroc_edges(spark, s, want):
    assert ranking.roc_auc(table(spark, [0, 0, 1, 1], s), "y", "s").first().auroc == want


def test_missing_class_and_bad_values(spark):
    assert ranking.roc_auc(table(spark, [1, 1], [1, 2]), "y", "s").first().auroc is None
    assert ranking.average_precision(table(spark, [0, 0], [1, 2]), "y", "s").first().average_precision == 0.0
    for y, s in (([0, 1], [1.0, float("nan")]), ([0, 1], [1.0, float("inf")]), ([0, 2], [1.0, 2.0])):
        with pytest.raises(Exception, match="non-finite|label"):
            ranking.roc_auc(table(spark, y, s), "y", "s").collect()


def test_average_precision_counts_ties_once(spark):
    # the tie at 2 ends with 2 of 3 flagged positive, then 3 of 4
    got = ranking.average_precision(table(spark, [1, 0, 1, 1], [3, 2, 2, 1]), "y", "s").first().average_precision
    assert got == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)


def test_f1_threshold_lies_midway_or_below(spark):
    r = ranking.f1_max(table(spark, [0, 0, 1, 1], [1, 2, 4, 5]), "y", "s").first()
    assert (r.f1, r.threshold) == (1.0, 3.0)
    r = ranking.f1_max(table(spark, [1, 1], [4, 5]), "y", "s").first()
    assert (r.f1, r.threshold) == (1.0, 3.0)


def test_conformal_rank_and_policies(spark):
    v = table(spark, [0] * 136, range(136))
    r = thresholds.ranked_threshold(v, "s", 0.01).first()
    assert (r.k, r.threshold, r.met) == (1, 135.0, True) and r.effective == pytest.approx(1 / 137)
    few = table(spark, [0] * 81, range(81))
    r = thresholds.ranked_threshold(few, "s", 0.01).first()
    assert (r.k, r.threshold, r.met) == (0, 80.0, False)
    assert thresholds.ranked_threshold(few, "s", 0.01, policy="always_accept").first().threshold == float("inf")
    with pytest.raises(Exception, match="too few"):
        thresholds.ranked_threshold(few, "s", 0.01, policy="reject").collect()
    with pytest.raises(Exception, match="fewer than"):
        thresholds.ranked_threshold(table(spark, [0] * 3, range(3)), "s", 0.5).collect()


def test_ties_at_the_threshold_are_no_alarms(spark):
    at = thresholds.ranked_threshold(table(spark, [0] * 50, [7] * 50), "s", 0.1)
    assert thresholds.operating_point(table(spark, [0] * 9, [7] * 9), "y", "s", at).first().fp == 0


def test_threshold_provenance():
    for bad in ({"value": float("nan")}, {"value": float("inf")}, {"source_split": "test"}):
        with pytest.raises(ValueError):
            thresholds.Threshold(**{"value": 1.0, "method": "validation_fpr", "source_split": "validation"} | bad)
    thresholds.Threshold(1.0, "test_f1_max", "test", oracle=True)


def test_normalizer_refuses(spark):
    v = table(spark, [0, 0], [1, 3])
    with pytest.raises(ValueError):
        thresholds.ScoreNormalizer().fit(v, "s", "test_public")
    n = thresholds.ScoreNormalizer().fit(v, "s", "train")
    with pytest.raises(ValueError):
        n.fit(v, "s", "train")
    assert [r.scaled for r in n.transform(table(spark, [0], [5]), "s").collect()] == [2.0]


def maps_of(spark, images):
    return spark.createDataFrame([(i, m.astype(float).ravel().tolist(), t.ravel().tolist()) for i, (m, t) in enumerate(images)], "id int, map array<double>, mask array<boolean>")


def pro(spark, images, limits, side):
    m = maps_of(spark, images)
    cells = pooled.pixels(m, "id", "map", F.lit(False)).drop("truth")
    return [r.au_pro for r in rasters.au_pro(cells, rasters.regions(m, "id", "mask", side, side), "id", limits).orderBy("fpr_limit").collect()]


def test_au_pro_perfect_and_inverted(spark):
    t = np.zeros((12, 12), bool)
    t[2:4, 2:6] = t[8:9, 8:10] = True
    images = [(t.astype(float), t), (np.zeros((12, 12)), np.zeros((12, 12), bool))]
    assert pro(spark, images, (0.05, 0.3), 12) == pytest.approx([1.0, 1.0])
    inverted = [(-m, t) for m, t in images]
    assert pro(spark, inverted, (0.3,), 12)[0] < 0.2


def test_au_pro_against_thresholds(spark):
    rng = np.random.default_rng(3)
    images = [(rng.normal(size=(10, 10)), rng.random((10, 10)) < 0.1) for _ in range(3)]
    from gaugeworks.functions.kernels import components

    regions = [m[lab == k] for m, t in images for lab in [components(t)] for k in np.unique(lab[lab >= 0])]
    negatives = np.concatenate([m[~t] for m, t in images])
    ts = np.sort(np.concatenate([m.ravel() for m, _ in images]))[::-1]
    x = np.array([0] + [(negatives >= c).mean() for c in ts])
    y = np.array([0] + [np.mean([(r >= c).mean() for r in regions]) for c in ts])
    fine = np.linspace(0, 0.3, 30001)
    # the best overlap at each rate, joined by straight lines
    best_x = np.unique(x)
    best_y = np.array([y[x == v].max() for v in best_x])
    best_y[0] = y[x == 0].max()
    curve = np.interp(fine, best_x, best_y)
    assert pro(spark, images, (0.3,), 10)[0] == pytest.approx(np.trapezoid(curve, fine) / 0.3, abs=0.02)
