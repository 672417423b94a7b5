import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import kernels as K
from gaugeworks.operators import calibration, neighbours, photometric, predictions, ranking, rasters, statistics


def test_tile_windows(spark):
    plan = lambda n, tile, overlap: [tuple(w) for w in spark.range(1).select(rasters.tile_windows(F.lit(n), tile, overlap).alias("w")).first().w]
    assert plan(50, 40, 8) == [(0, 50, 0, 50)]
    assert plan(100, 40, 8) == [(0, 40, 0, 30), (20, 60, 30, 50), (40, 80, 50, 70), (60, 100, 70, 100)]
    rows = spark.range(1, 400).select("id", rasters.tile_windows(F.col("id").cast("int"), 40, 8).alias("w")).collect()
    for n, windows in rows:
        own = [tuple(w) for w in windows]
        assert own[0][0] == own[0][2] == 0 and own[-1][1] == own[-1][3] == n
        for (a, b, _, mine), (c, _, yours, _) in zip(own, own[1:], strict=False):
            assert mine == yours == (b + c) // 2 and b - c >= 16 and b - a == 40
    with pytest.raises(ValueError, match="longer"):
        rasters.tile_windows(F.lit(100), 16, 8)


def test_oriented_closing_bridges_thin_slanted_gaps():
    mask = np.zeros((40, 40), bool)
    for t in range(30):
        if not 12 <= t < 16:
            mask[5 + t, 5 + int(round(t * 0.55))] = True
    closed = K.oriented_closing(mask, 5, 8)
    assert (closed & mask == mask).all() and len(np.unique(K.components(closed))) == 2  # background and one region
    assert not K.oriented_closing(np.zeros((9, 9), bool), 3, 4).any()
    apart = np.zeros((20, 60), bool)
    apart[10, 5], apart[10, 50] = True, True
    assert len(np.unique(K.components(K.oriented_closing(apart, 5, 8)))) == 3


def test_density_subsample(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 3)) * 0.01, rng.normal(size=(50, 3)) * 5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    one = {r.id: r.crowding for r in neighbours.density_subsample(df, "id", "v", 0.25, k=10).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, axis=1)[:, :10]
    crowd = (near < near.mean()).sum(1)
    assert len(one) == 50 and all(crowd[i] == c for i, c in one.items()) and sum(one.values()) == np.sort(crowd)[:50].sum()
    many = neighbours.density_subsample(df, "id", "v", 0.255, k=10, subset=60)
    assert many.count() == 51 and many.select("id").distinct().count() == 51
    assert neighbours.density_subsample(df.limit(0), "id", "v", 0.5).count() == 0


def test_running_over_many_buckets(spark):
    rng = np.random.default_rng(2)
    x, y = np.sort(rng.random(400).round(3)), rng.random(400).round(3)
    df = spark.createDataFrame([(float(a), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, g int")
    by = {g: 0.0 for g in range(3)}
    for g in by:
        rows = sorted((a, b) for i, (a, b) in enumerate(zip(x, y, strict=True)) if i % 3 == g)
        by[g] = sum((c - a) * (b + d) / 2 for (a, b), (c, d) in zip(rows, rows[1:], strict=False))
    assert {r.g: r.area for r in ranking.trapezoid(df, "x", "y", ("g",)).collect()} == pytest.approx(by)
    small = ranking.with_previous(df.select("x", "y"), "x", "y", rows=20)
    assert small.select("x", "y", "_x0", "_y0").where("_x0 IS NULL").count() == 1
    rows = sorted(zip(x.tolist(), y.tolist(), strict=True))
    got = {(r.x, r.y): (r._x0, r._y0) for r in small.collect()}
    assert all(got[b] in (a, b) for a, b in zip(rows, rows[1:], strict=False))
    total = ranking.running(df.groupBy("x").agg(F.count("*").alias("c")), "x", ["c"], rows=20)
    assert {r.x: r.cum_c for r in total.collect()} == {v: int((x <= v).sum()) for v in set(x.tolist())}


def test_points_at_many_cuts(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 40, 300) / 4.0, rng.integers(0, 2, 300)
    test = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "score double, label int")
    cuts = [-1.0, 0.0, 3.3, 5.0, 99.0, None]
    got = {r.cut: (r.fpr, r.recall) for r in ranking.at_cuts(test, "label", "score", spark.createDataFrame([(c,) for c in cuts], "cut double"), "cut").collect()}
    for c in cuts[:-1]:
        assert got[c] == pytest.approx(((s[y == 0] > c).mean(), (s[y == 1] > c).mean()))
    assert got[None] == (None, None)


def test_normal_shift_has_a_p_value(spark):
    a = spark.createDataFrame([(float(i),) for i in range(20)], "s double")
    b = spark.createDataFrame([(float(i) + 30,) for i in range(20)], "s double")
    far, none = statistics.normal_shift(a, b, "s").first(), statistics.normal_shift(a, a, "s").first()
    assert far.p_value < 1e-6 and far.auroc == 1.0 and far.n_a == far.n_b == 20 and none.p_value == pytest.approx(1.0)


def test_scorer_contract(spark):
    maps = spark.createDataFrame([(i, 0, [0.1 * i, 0.2, 0.3, 0.4]) for i in range(10)] + [(99, 1, [9.0] * 4)], "id long, label int, map array<double>")
    with pytest.raises(ValueError):
        predictions.build("none such")
    for name in ("mean_intensity", "histogram", "random", "pixel_pca"):
        options = {"id": "id"} if name == "random" else {"components": 2} if name == "pixel_pca" else {}
        scorer = predictions.build(name, "map", **options)
        with pytest.raises(ValueError):
            scorer.transform(maps)
        with pytest.raises(ValueError):
            scorer.fit(maps.where("label = 0"), "test")
        out = scorer.fit(maps.where("label = 0"), "train").transform(maps)
        assert out.columns == [*maps.columns, "score"] and out.where("score IS NULL").count() == 0
        with pytest.raises(ValueError):
            scorer.fit(maps.where("label = 0"), "train")
    with pytest.raises(Exception, match="anomalous row"):
        predictions.build("mean_intensity", "map").fit(maps, "train").transform(maps).collect()
    predictions.register("flat", lambda *a, **k: predictions.Random("map", id="id"))
    with pytest.raises(ValueError):
        predictions.register("flat", predictions.Random)


def test_prediction_tables(spark):
    df = spark.createDataFrame([(i, 1.0 * i) for i in (5, 3, 9, 7)], "id long, score double")
    at = spark.createDataFrame([(0,), (2,), (2,), (9,)], "position long")
    assert sorted(r.id for r in predictions.subset(df, "id", at).collect()) == [3, 7, 7]
    with pytest.raises(Exception, match="differ"):
        predictions.with_scores(df, df.where("id <> 3"), "id").collect()
    with pytest.raises(Exception, match="differ"):
        predictions.with_scores(df.where("id <> 3"), df, "id").collect()
    a, b = (predictions.prediction_digest(x.withColumn("label", F.lit(0)), "id", "label", "score").first() for x in (df, df.repartition(3).withColumn("score", F.col("score") + 1e-13)))
    assert a == b


def test_study_errors_and_differences(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, s, [float(x) for x in rng.normal(size=4) + 0.4 * (i % 2)]) for i in range(80) for s in range(2)]
    runs = spark.createDataFrame(rows, "id long, label int, seed int, map array<double>")
    rules = {"max": F.array_max("map"), "min": F.array_min("map")}
    out = calibration.aggregation_differences(runs, rules, "max", "id", "seed", "label", 30, 1).collect()

    def auroc(f):
        out = []
        for s in range(2):
            p, n = ([f(v) for _, y, k, v in rows if k == s and y == c] for c in (1, 0))
            out.append(np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n]))
        return np.mean(out)

    assert len(out) == 1 and out[0].difference == pytest.approx(auroc(min) - auroc(max)) and out[0].low <= out[0].high
    own = calibration.long_scores(runs.where("seed = 0"), rules, ("id", "label")).withColumn("kind", F.lit("a"))
    got = calibration.method_comparisons(own, "kind", "rule", "id", "label", "score", "max", 20, 1).collect()
    assert len(got) == 1 and got[0].p_holm == got[0].p_value and got[0].rule == "min"
    with pytest.raises(Exception, match="different images"):
        calibration.method_comparisons(own.where("rule = 'max' OR id > 3"), "kind", "rule", "id", "label", "score", "max", 5, 1).collect()


def test_light_and_background(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3)) @ np.array([[1, 0.3, 0], [0, 1, 0.2], [0, 0, 0.5]])
    mean, inverse, cut = photometric.background(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"), ("a", "b", "c"))
    inv0 = np.linalg.inv(np.cov(x.T) + 1e-3 * np.eye(3))
    d0 = np.einsum("ij,jk,ik->i", x - x.mean(0), inv0, x - x.mean(0))
    kept = x[d0 <= np.quantile(d0, 0.95)]
    inv1 = np.linalg.inv(np.cov(kept.T) + 1e-3 * np.eye(3))
    d1 = np.einsum("ij,jk,ik->i", x - kept.mean(0), inv1, x - kept.mean(0))
    assert np.allclose(mean, kept.mean(0)) and np.allclose(inverse, inv1) and cut == pytest.approx(np.quantile(d1, 0.995))
    f = np.zeros((12, 12))
    f[3:9, 3:9], f[5, 5], f[0, 0] = 1, 0, 1
    one = spark.createDataFrame([(f.ravel().tolist(),), ([0.0] * 144,)], "f array<double>")
    got = [np.array(r.m).reshape(12, 12) for r in one.select(photometric.object_mask(margin=0)("f", F.lit(12), F.lit(12)).alias("m")).collect()]
    assert got[0][5, 5] and not got[0][0, 0] and got[0].sum() <= 36 and got[1].all()
    with pytest.raises(ValueError):
        photometric.normalized(F.col("f"), "flatfield")
