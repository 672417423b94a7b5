"""Hard negatives by distance keys against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import negatives
from gaugeworks.llm.queries import ORACLE, op13_hard_negatives


def brute(rows, positives=5, n_negatives=3):
    held = [(i, g, [math.floor(256 * x) for x in v]) for i, g, v in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, g, q in held:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, w, strict=True)), j, h) for j, h, w in held if len(w) == len(q)]
        for s, p, _ in sorted(x for x in scored if x[2] == g and x[1] != i)[:positives]:
            near = sorted(x for x in scored if x[2] != g and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(i, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(near[:n_negatives])]
    return sorted(out)


def grouped(n, seed, dim=6, spread=0.15):
    """Rows around a few centres, of some labels each."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [(k, int(rng.integers(4)), (centres[k % 8] + spread * rng.normal(size=dim)).tolist()) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "vec_id long, label int, embedding array<double>, `group` string, block int").repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "group": 3}])
def test_odd_rows(spark, sizes):
    rows = grouped(400, 1)
    rows += [(None, 1, rows[3][2]), (1000, None, rows[3][2]), (1001, 1, None), (1002, 1, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1003, 1, [float("nan")] * 6), (1004, 2, [float("inf")] * 6)]
    rows += [(1050, 1, [0.0] * 6), (1100, 2, [0.5]), (1101, 2, [0.25]), (1102, 3, [0.2]), (1150, 3, []), (1151, 3, []), (1152, 1, [])]
    rows += [rows[50], rows[100], (100, 3, rows[7][2]), *[(2000 + k, 2, rows[50][2]) for k in range(9)], *[(3000 + k, 3, [x * 0.8 for x in rows[100][2]]) for k in range(9)]]
    rows += [(-50, 1, [-x for x in rows[0][2]]), (-51, 1, rows[0][2])]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, **sizes)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert negatives.mine(frame(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(frame(spark, rows[:10]), F.lit(False)).count() == 0


def test_lengths_without_bound_are_an_error(spark):
    with pytest.raises(ValueError, match="53"):
        negatives.mine(frame(spark, [(0, 1, [1e9])]), F.lit(True))


def test_bounds_leave_out_blocks_and_lose_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (12, 8))
    rows = np.vstack([c + rng.integers(-40, 40, (300, 8)) for c in centres])
    most = float((rows.astype(float) ** 2).sum(axis=1).max())
    points = negatives.pivots(rows[::7], most, 12)
    away = negatives._distances(negatives.augmented(rows, most), points)
    pivot, key = away.argmin(axis=1), away.min(axis=1)
    anchors = rows[:5]
    ids = np.arange(len(rows))
    scan = negatives.Scan(anchors, ids[:5], np.full((5, 1), -np.inf), np.full((5, 1), np.inf), 4, most, points, True)
    blocks = []
    for p in range(12):
        own = np.flatnonzero(pivot == p)
        own = own[np.argsort(key[own])]
        blocks += [(p, b) for b in np.array_split(own, 6) if len(b)]
    gap = [max(0, key[b].min() - scan.away[:, p].max(), scan.away[:, p].min() - key[b].max()) for p, b in blocks]
    for k in np.argsort(gap):
        p, b = blocks[k]
        scan.meet(p, key[b].min(), key[b].max(), ids[b], rows[b])
    for a in range(5):
        score = rows @ anchors[a]
        score[a] = -(1 << 60)
        want = np.lexsort((ids, -score))[:4]
        assert scan.id[a, 0].tolist() == want.tolist() and scan.score[a, 0].tolist() == score[want].tolist()
    assert scan.met < 0.6 * 5 * len(blocks)


def test_query_equals_sql(same):
    same(op13_hard_negatives, ORACLE["op13_hard_negatives"])
