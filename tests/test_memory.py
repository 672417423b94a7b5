"""Patch memories, profiles, fusion and the image-level branch against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import kernels as K
from gaugeworks.operators import fusion, global_branch, patch_memory
from gaugeworks.plans import catalog, catalog_memory

OWN = [n for n, f in catalog.QUERIES.items() if f.__module__ == catalog_memory.__name__ and n in catalog.ORACLE]


@pytest.mark.parametrize("name", OWN)
def test_twin(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(40, 64)) * 0.2, np.arange(40) % 10
    d = str(tmp_path_factory.mktemp("memory"))
    spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(40)], "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return d, x, label


def test_k_centre_of_one_part_is_greedy_and_of_many_within_its_bound(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(900, 3)), 2)
    x[100:160] = x[0]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(900)] + [(5000, None)], "id int, v array<double>").repartition(4)
    one = patch_memory.k_centre(df, ("id",), "v", 12, seed=2).orderBy("pick").collect()
    names = {r.id: r.s for r in df.select("id", F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256).alias("s")).collect()}
    order = sorted(range(900), key=lambda i: names[i])
    assert [r.id for r in one] == [order[k] for k in patch_memory.greedy(x[order], 12)]
    radius = lambda rows: max(min(((p - np.array(r.v)) ** 2).sum() ** 0.5 for r in rows) for p in x)
    many = patch_memory.k_centre(df, ("id",), "v", 12, part=100, seed=2)
    assert many.count() == 12 and many.select("id").distinct().count() == 12
    # the least radius is half of the plain greedy one or more, rounds of parts add twice it each
    assert radius(many.collect()) <= 2 * 3 * radius(one)
    assert patch_memory.k_centre(df.where("id BETWEEN 100 AND 159"), ("id",), "v", 12).count() == 1
    assert patch_memory.k_centre(df.limit(0), ("id",), "v", 12).count() == 0


def test_patch_scores_by_hand(spark, small):
    d, x, label = small
    bank = patch_memory.k_centre(patch_memory.patches(catalog_memory.T.maps(spark, d).where("label = 0"), "vec_id", "map", 8, 8), ("vec_id", "patch"), "v", 100, seed=1)
    memory = np.array([r.v for r in bank.collect()])
    got = {r.vec_id: r for r in catalog.QUERIES["patch_memory_scores"](spark, d).collect()}
    for i in range(40):
        p = np.pad(x[i].reshape(8, 8), 1, mode="edge")
        v = np.array([p[a : a + 3, b : b + 3].ravel() for a in range(8) for b in range(8)])
        far = np.sqrt(((v[:, None] - memory[None]) ** 2).sum(-1)).min(1)
        assert got[i].score == pytest.approx(far.max(), abs=1e-6) and far[got[i].patch] == pytest.approx(far.max(), abs=1e-9)


def test_grey_opening_by_hand():
    rng = np.random.default_rng(5)
    a = rng.random((6, 9))
    e = K.ellipse(2)
    inside = lambda f, g: np.array([[f(g[i, j] for i in range(6) for j in range(9) if abs(i - r) <= 2 and abs(j - c) <= 2 and e[i - r + 2, j - c + 2]) for c in range(9)] for r in range(6)])
    assert np.allclose(K.grey_opening(a, e), inside(max, inside(min, a)))
    assert (K.grey_opening(a, e) <= a).all() and (K.grey_opening(np.ones((3, 3)), e) == 1).all()


def test_fusion_stops_on_a_missing_map_and_levels(spark):
    parts = spark.createDataFrame([(1, "a", [1.0, 3.0, 2.0, 8.0]), (1, "b", [4.0, 0.0, 2.0, 4.0]), (2, "a", [1.0, 1.0, 1.0, 1.0])], "id int, c string, v array<double>")
    factors = spark.createDataFrame([("a", 0.0, 2.0), ("b", 2.0, 1.0)], "c string, offset double, scale double")
    one = parts.where("id = 1")
    get = lambda **k: fusion.fused(one, "id", "c", "v", factors, components=2, **k).first().map
    assert get() == [2.0, 1.5, 1.0, 4.0] and get(mode="mean") == [1.25, -0.25, 0.5, 3.0]
    assert get(level="sub-median") == [0.25, -0.25, -0.75, 2.25] and get(level="div-median") == pytest.approx([x / 1.75 for x in (2.0, 1.5, 1.0, 4.0)]) and get(level="sub-q75") == [-0.5, -1.0, -1.5, 1.5]
    spots = spark.createDataFrame([(1, [True, False, False, True])], "id int, spots array<boolean>")
    assert get(spots=spots, share=0.5) == [1.0, 1.5, 1.0, 2.0]
    with pytest.raises(Exception, match="did not score every image"):
        fusion.fused(parts, "id", "c", "v", factors, components=2).collect()
    with pytest.raises(ValueError, match="scale"):
        fusion.scales(factors, "c", "iqr")


def test_image_level_branch_by_hand(spark, small):
    d, x, label = small
    train = [i for i in range(40) if label[i] < 5 and i % 3]
    val = [i for i in range(40) if label[i] < 5 and i % 3 == 0]
    parts = [x[:, :24], x[:, 24:]]

    def distance(p):
        t = p[train]
        mean, c, n, k = t.mean(0), t - t.mean(0), len(train), p.shape[1]
        s = c.T @ c / n
        mu = np.trace(s) / k
        delta = ((s - mu * np.eye(k)) ** 2).sum() / k
        beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n**2 / k
        a = min(beta, delta) / delta
        inv = np.linalg.inv(a * mu * np.eye(k) + (1 - a) * s)
        return np.array([np.sqrt((r - mean) @ inv @ (r - mean)) for r in p])

    g = sum(map(distance, parts))
    u = np.concatenate([p / np.linalg.norm(p, axis=1, keepdims=True) for p in parts], axis=1)
    n = np.array([np.mean(sorted(np.linalg.norm(u[i] - u[j]) for j in train if j != i)[:5]) for i in range(40)])
    got = {r.vec_id: r for r in catalog.QUERIES["global_branch_scores"](spark, d).collect()}
    for i in range(40):
        assert got[i].gaussian == pytest.approx((g[i] - g[val].mean()) / g[val].std(), abs=2e-5)
        assert got[i].neighbours == pytest.approx((n[i] - n[val].mean()) / n[val].std(), abs=2e-5)
    zero = spark.createDataFrame([(1, [0.0], [1.0])], "vec_id int, l1 array<double>, l2 array<double>")
    assert zero.select(global_branch.joined_units(("l1", "l2")).alias("u")).first().u is None
