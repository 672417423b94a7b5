"""Regions of interest, overlap states, component trees, nearest hashes and cross-fitting against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import kernels as K
from gaugeworks.operators import component_tree, crossfit, focus, integrity, overlap, rasters, statistics
from gaugeworks.plans import catalog, catalog_regions
from gaugeworks.plans import tables as T
from gaugeworks.plans.catalog_models import found

DATA = "/root/testdata/sf0.001"
OWN = [n for n, f in catalog.QUERIES.items() if f.__module__ == catalog_regions.__name__]


@pytest.mark.parametrize("name", OWN)
def test_twin(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE[name])


def test_distances_give_every_dilation():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (5, 9), (12, 7)):
        for p in (0.02, 0.2, 1.0):
            m = rng.random(shape) < p
            if not m.any():
                continue
            d = K.squared_distance(m)
            cells = np.argwhere(m)
            want = [[min((i - a) ** 2 + (j - b) ** 2 for a, b in cells) for j in range(shape[1])] for i in range(shape[0])]
            assert (d == np.array(want)).all()
            for r in (1, 2, 4):
                assert ((d <= r * r) == K.dilate(m, K.ellipse(r))).all()


def test_region_scores_equal_masks_one_by_one(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=100).tolist(), (rng.random(100) < p).tolist()) for i, p in enumerate((0.0, 0.03, 0.5))]
    df = spark.createDataFrame(rows, "id int, map array<double>, fore array<boolean>")
    margins = (0.05, 0.1, 0.3)
    ring = focus.rings(margins)(F.transform("fore", lambda x: x.cast("double")), F.lit(10), F.lit(10))
    got = {(r.id, r.margin): r for r in focus.margin_scores(df.withColumn("ring", ring), "id", "map", "ring", margins).collect()}
    for i, v, fore in rows:
        for m, radius in zip(margins, focus.radii(margins, 10, 10), strict=True):
            mask = np.array(fore).reshape(10, 10)
            mask = K.dilate(mask, K.ellipse(radius)) if mask.any() else ~mask
            own = np.sort(np.array(v)[mask.ravel()])[::-1]
            r = got[i, m]
            assert r.cells == len(own) and r.high == own[0] and r.top == pytest.approx(own[: max(1, round(0.05 * len(own)))].mean())


def test_states_merge_in_any_order_and_are_exact_with_all_negatives(spark):
    cells, regions = T.cells(spark, DATA), found(spark, DATA)
    parts = [(cells.where(f"vec_id % 3 = {k}"), regions.where(f"vec_id % 3 = {k}")) for k in range(3)]
    whole = overlap.state(cells, regions, "vec_id", size=1500, seed=1)
    states = [overlap.state(c, r, "vec_id", size=1500, seed=1) for c, r in parts]
    a = overlap.merged([states[0], overlap.merged([states[1], states[2]], 1500)], 1500)
    b = overlap.merged(states[::-1], 1500)
    rows = lambda s: sorted(map(repr, s.where("kind <> 'region'").collect()))
    assert rows(a) == rows(b) == rows(whole) and a.where("kind = 'negative'").count() == 1500
    exact = rasters.au_pro(cells, regions, "vec_id", (0.05, 0.3)).orderBy("fpr_limit").collect()
    full = overlap.areas(overlap.merged([overlap.state(c, r, "vec_id") for c, r in parts]), (0.05, 0.3)).orderBy("fpr_limit").collect()
    assert [r.au_pro for r in full] == pytest.approx([r.au_pro for r in exact]) and all(r.fpr_error == 0 for r in full)
    near = overlap.areas(a, (0.05, 0.3)).orderBy("fpr_limit").collect()
    for r, e in zip(near, exact, strict=True):
        assert 0 < r.fpr_error < 0.02 and abs(r.au_pro - e.au_pro) < 0.1
    with pytest.raises(ValueError, match="regions"):
        overlap.areas(overlap.state(cells.where("label = 0"), regions.where("false"), "vec_id"), (0.3,))


def test_bounded_sample_takes_the_least(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(1 << 60), float(k)) for k in range(5000)]
    df = spark.createDataFrame(rows, "priority long, value double").repartition(5)
    for k in (1, 7, 900, 4999, 6000):
        assert sorted(r.priority for r in overlap.least(df, "priority", k).collect()) == sorted(p for p, _ in rows)[:k]


def test_bootstrap_equals_areas_of_copied_maps(spark):
    keep = "vec_id < 60"
    cells, regions = T.cells(spark, DATA).where(keep), found(spark, DATA).where(keep)
    grid = sorted({r.value for r in cells.select("value").distinct().collect()})
    weights = statistics.resample_weights(T.maps(spark, DATA).where(keep).select("vec_id"), "vec_id", 3, 5)
    table = overlap.tabulated(cells, regions, "vec_id", grid)
    for block in (7, 256):
        got = {r.resample: r.au_pro for r in overlap.bootstrap(table, weights, "vec_id", len(grid), 3, (0.3,), block).collect()}
        for b in range(3):
            own = weights.where(f"resample = {b}").select("vec_id", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))).alias("copy"))
            name = F.concat_ws(":", "vec_id", "copy").alias("key")
            c, r = cells.join(own, "vec_id").select(name, "pos", "value"), regions.join(own, "vec_id").select(name, "region", "area", "cells")
            assert got[b] == pytest.approx(rasters.au_pro(c, r, "key", (0.3,)).first().au_pro)


def test_tree_gives_every_rule():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (1, 9), (9, 1), (12, 15)):
        for image in (rng.normal(size=shape), rng.integers(0, 4, shape).astype(float), np.zeros(shape)):
            tree = component_tree.Tree(image)
            for low in (-1.0, 0.0, 0.4, 1.0):
                for high in (None, 0.5, 1.5):
                    for least in (1, 4):
                        want = image > low if high is None else K.hysteresis(image, low, high)
                        want = K.remove_small(want, least)
                        assert (tree.mask(component_tree.Rule(low, high, least)) == want.ravel()).all()
    marked = component_tree.Tree(np.array([[0.2, 0.8], [0.1, 0.0]]))
    assert marked.mask(component_tree.Rule(1.0, mark=0.7)).tolist() == [False, True, False, False]
    assert not marked.mask(component_tree.Rule(1.0, mark=0.9)).any()


def test_nearest_hashes_equal_brute_force(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(700)]
    hashes = base + [b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(30))) for b in base] + base[:300] + base[:3] + [0, -1 & (1 << 64) - 1] * 10
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame([(i, h, i % 2) for i, h in enumerate(signed)] + [(9999, None, 0)], "id int, bits long, g int")
    bank = df.where("id % 3 <> 0")
    a = np.array(signed, np.int64)
    d = np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64)).astype(int)
    for by, own in (((), False), ((), True), (("g",), True)):
        want = {}
        for i in range(len(a)):
            near = [(d[i, j], j) for j in range(len(a)) if j % 3 and (not own or j != i) and (not by or j % 2 == i % 2)]
            want[i] = min(near)[::-1]
        got = {r.id: (r.neighbour, r.distance) for r in integrity.hamming_nearest(df, bank, "id", "bits", by, own).collect()}
        assert got == want
    assert integrity.hamming_nearest(df.limit(1), df.limit(1), "id", "bits", exclude_self=True).count() == 0
    assert integrity.hamming_nearest(df, df.limit(0), "id", "bits").count() == 0


def test_folds_are_fitted_without_themselves(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 4))
    rows = [(i, i % 3, p, float(x[i, p])) for i in range(30) for p in range(4)]
    df = spark.createDataFrame(rows, "id int, fold int, pos int, value double")
    got = {r.id: r.score for r in crossfit.out_of_fold_scores(df, "id", "fold").collect()}
    for i in range(30):
        rest = x[[j for j in range(30) if j % 3 != i % 3]]
        assert got[i] == pytest.approx(((x[i] - rest.mean(0)) / rest.std(0)).max())
    test = spark.createDataFrame([(0, s) for s in (0.1, 0.5, 3.0, 4.0)] + [(1, 9.0), (1, 0.0)], "label int, score double")
    pool = spark.createDataFrame([(float(k),) for k in (0, 1, 2, 2)], "score double")
    r = crossfit.thresholds_of_pools({"a": pool}, test, "label", "score", 0.01).first()
    assert (r.n, r.k, r.threshold, r.fp, r.fpr, r.recall) == (4, 1, 2.0, 2, 0.5, 0.5)
    # of all orders of 4 pool and 4 test scores, those in which two or more test scores beat the largest of the pool
    beats = sum(math.comb(4, m) * math.factorial(m) * 4 * math.factorial(7 - m) for m in range(2, 5))
    assert r.tail_p == pytest.approx(beats / math.factorial(8))
