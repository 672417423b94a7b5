"""Nearest neighbours of short vectors in large banks, against distances to the whole bank."""

import numpy as np
import pandas as pd
import pytest

from gaugeworks.operators import neighbours as N


def rows_of(frames):
    return pd.concat(list(frames)).sort_values(["i", "near", "neighbour"]).reset_index(drop=True)


@pytest.mark.parametrize(("k", "per", "copies"), [(1, 8, False), (3, 8, True), (3, None, True), (1, None, False)])
def test_boxes_find_what_the_whole_bank_has(k, per, copies):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(9_000, 8))
    if copies:  # many equal distances, so that ids decide
        x = np.round(x, 1)
        x[rng.integers(0, len(x), 500)] = x[5]
    q = np.concatenate([x[:600], rng.normal(size=(300, 8)), np.full((1, 8), np.nan)])
    own = np.concatenate([np.arange(600), 10**6 + np.arange(301)])
    ids = np.arange(len(x))
    assert rows_of(N._Boxes(x, ids, per).met(q, own, k)).equals(rows_of(N._met(q, own, x, ids, k, per)))


def test_far_boxes_are_not_met():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(8_192, 8)), rng.normal(size=(8_192, 8)) + 100.0])
    boxes = N._Boxes(x, np.arange(len(x)), None)
    far = boxes.vectors[:, 0] > 50
    boxes.lifted[-1, far] = -1e9  # whoever met these would find them nearest
    got = rows_of(boxes.met(x[:500] + 0.01, np.arange(500), 1))
    assert got["neighbour"].max() < 8_192 and len(got) == 500


def test_join_by_boxes_whole_and_in_blocks(spark):
    x = np.round(np.random.default_rng(8).normal(size=(30_000, 4)), 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, v array<double>").repartition(3)
    asked = df.where("key < 400")
    want = rows_of(N._met(x[:400], np.arange(400), x, np.arange(len(x)), 2, 4))
    for limit in (N.BANK_BYTES, 30_000 * 4 * 8 // 2):
        got = N.knn_join(asked, df, 2, "key", "v", exclude_self=True, limit=limit, per=4).orderBy("key", "rank").collect()
        assert [(r.key, r.neighbour) for r in got] == list(zip(want["i"], want["neighbour"], strict=True))
        assert [r.distance for r in got] == want["distance"].tolist()
