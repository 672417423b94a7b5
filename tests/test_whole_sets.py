"""Queries over whole sets, against brute force on a small table: copies lie across parities and categories."""

import hashlib

import numpy as np
import pytest

from gaugeworks.operators import integrity, neighbours
from gaugeworks.plans import tables as T
from gaugeworks.plans import catalog, catalog_models

N = 60


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """(folder, ids, categories, vectors): rows 1 and 7, 11 and 33, 12 and 18, 3 and 9 are exact copies."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(N, 64)) * 0.2
    for a, b in ((1, 7), (11, 33), (12, 18), (3, 9)):
        x[b] = x[a]
    x[41] += 3.0  # an odd normal far from the others
    label = np.array([(7 * i) % 10 for i in range(N)])
    label[41] = 2
    d = str(tmp_path_factory.mktemp("small"))
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(N)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return d, np.arange(N), label, x


def distances(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


def test_guard_limit_takes_all_normals(spark, small):
    d, _, label, x = small
    v = x[label < 5]
    own = distances(v, v)
    np.fill_diagonal(own, np.inf)
    assert catalog.QUERIES["shading_guard_limit_all"](spark, d).first().guard_limit == pytest.approx(own.min(1).max(), abs=1e-6)


def brute_neighbours(small, k):
    _, ids, label, x = small
    bank = ids[label < 5]
    d = distances(x, x[bank])
    for i in ids:
        own = sorted((round(d[i, j], 9), b) for j, b in enumerate(bank) if b != i)[:k]
        yield from ((i, r + 1, b, round(v, 6)) for r, (v, b) in enumerate(own))


def test_neighbours_among_all_normals(spark, small):
    got = sorted(map(tuple, catalog.QUERIES["knn_join_all"](spark, small[0]).collect()))
    want = sorted(brute_neighbours(small, 3))
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
    assert any(w[2] % 5 and w[3] == 0 for w in want)


def test_proximity_to_all_normals(spark, small):
    label = small[2]
    s = {w[0]: w[3] for w in brute_neighbours(small, 1)}
    pos, neg = ([s[i] for i in range(N) if (label[i] >= 5) == y] for y in (True, False))
    row = catalog.QUERIES["train_proximity_all"](spark, small[0]).first()
    assert row.auroc == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]), abs=1e-6)
    assert (row.n_pos, row.n_neg) == (len(pos), len(neg))


def brute_coreset(rows, n):
    """Plain k-centre greedy over (id, vector) in seeded order."""
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[0]))
    chosen, least = [0], np.full(len(rows), np.inf)
    while True:
        least = np.minimum(least, [((v - rows[chosen[-1]][1]) ** 2).sum() for _, v in rows])
        least[chosen] = -1.0
        if len(chosen) == min(n, len(rows)):
            return [rows[i][0] for i in chosen]
        chosen.append(int(np.argmax(least)))


@pytest.mark.parametrize("candidates", [4, 17, 20_000])
def test_coreset_looks_at_all_rows(spark, small, candidates):
    _, ids, _, x = small
    d = spark.createDataFrame([(int(i), x[i].tolist()) for i in ids], "vec_id long, map array<double>").repartition(3)
    for n in (12, N + 5):
        if n == 12 or candidates > 4:
            got = neighbours.coreset(d, "vec_id", "map", n, candidates, seed=1).orderBy("pick").collect()
            assert [r.vec_id for r in got] == brute_coreset(list(zip(ids, x)), n)


def test_memory_bank_fits_on_all_normals(spark, small):
    d, ids, label, x = small
    bank = brute_coreset([(i, x[i]) for i in ids if label[i] < 5], 50)
    got = {r.vec_id: (r.score, r.nearest_normal) for r in catalog.QUERIES["memory_bank_scorer"](spark, d).collect()}
    assert any(b % 2 for b in bank) and set(got) == set(ids)
    for i in ids:
        s, b = min((round(float(np.sqrt(((x[i] - x[b]) ** 2).sum())), 9), b) for b in bank if b != i)
        assert got[i] == (pytest.approx(s, abs=1e-8), b)


def test_every_image_has_a_reweighted_score(spark, small):
    d, ids, label, x = small
    bank = [(8 * i + k, x[i, 8 * k : 8 * k + 8]) for i in ids if label[i] < 5 for k in range(8)]
    near = lambda v, i, k: sorted((round(float(np.sqrt(((v - w) ** 2).sum())), 9), b) for b, w in bank if b // 8 != i)[:k]
    got = {r.vec_id: r for r in catalog.QUERIES["reweighted_scores"](spark, d).collect()}
    assert set(got) == set(ids)
    whole = dict(bank)
    for i in ids:
        s, minus, b = max((near(p, i, 1)[0][0], -k, near(p, i, 1)[0][1]) for k, p in enumerate(x[i].reshape(8, 8)))
        own = x[i].reshape(8, 8)[-minus]
        gaps = [np.exp(np.sqrt(((own - whole[m]) ** 2).sum())) for _, m in near(whole[b], i, 3)]
        r = got[i]
        assert (r.patch, r.neighbour) == (-minus, b) and r.score == pytest.approx(s * (1 - np.exp(s) / sum(gaps)), abs=1e-7)


def test_thresholds_of_all_categories(spark, small):
    rows = T.hashes(spark, small[0]).collect()
    want = {}
    for c in range(10):
        h = [r.bits for r in rows if r.category == c]
        d = [bin((a ^ b) & (2**64 - 1)).count("1") for k, a in enumerate(h) for b in h[:k]]
        want[c] = (len(d), min(d), pytest.approx(np.percentile(d, 1), abs=1e-6))
    got = {r.category: (r.pairs, r.least, r.threshold) for r in catalog.QUERIES["phash_threshold_all"](spark, small[0]).collect()}
    assert got == want
    copies = spark.createDataFrame([(0, 5), (0, 5), (0, 5), (0, 4), (0, -1), (1, 3)], "category int, bits long")
    for chunk in (1, 2, 4096):
        assert [(r.category, r.pairs, r.least) for r in integrity.distance_percentile_by(copies, "category", "bits", 1.0, chunk).collect()] == [(0, 10, 0)]
        got = integrity.distance_percentile_by(T.hashes(spark, small[0]), "category", "bits", 1.0, chunk).collect()
        assert {r.category: (r.pairs, r.least, r.threshold) for r in got} == want
