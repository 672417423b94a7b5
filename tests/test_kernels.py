import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import kernels as K
from gaugeworks.operators.neighbours import greedy_coreset, squared_distances
from gaugeworks.operators.rasters import tile_windows


def test_diagonal_cells_are_one_region():
    m = np.zeros((5, 5), bool)
    m[1, 1] = m[2, 2] = m[4, 4] = True
    lab = K.components(m)
    assert lab[1, 1] == lab[2, 2] == 6 and lab[4, 4] == 24 and (lab == -1).sum() == 22


def test_components_against_flood_fill():
    rng = np.random.default_rng(0)
    for _ in range(20):
        m = rng.random((9, 11)) < 0.45
        want, seen = np.full(m.shape, -1), np.zeros(m.shape, bool)
        for a, b in zip(*np.nonzero(m)):
            if not seen[a, b]:
                stack, name = [(a, b)], a * 11 + b
                seen[a, b] = True
                while stack:
                    i, j = stack.pop()
                    want[i, j] = name
                    for p in range(max(0, i - 1), min(9, i + 2)):
                        for q in range(max(0, j - 1), min(11, j + 2)):
                            if m[p, q] and not seen[p, q]:
                                seen[p, q] = True
                                stack.append((p, q))
        assert (K.components(m) == want).all()


def test_morphology():
    ring = np.ones((5, 5), bool)
    ring[0] = ring[-1] = ring[:, 0] = ring[:, -1] = False
    ring[2, 2] = False
    assert K.fill_holes(ring)[2, 2] and not K.fill_holes(ring)[0, 0]
    block = np.zeros((7, 7), bool)
    block[1:6, 1:6] = True
    assert K.erode(block, K.ellipse(1)).sum() == 9
    assert K.erode(np.ones((5, 5), bool), K.ellipse(1)).all()  # what lies outside the image does not erode it
    gap = np.zeros((5, 9), bool)
    gap[2, [1, 2, 4, 5]] = True
    assert K.oriented_closing(gap, 2, 4)[2, 3]
    assert K.remove_small(gap, 3).sum() == 0
    heat = np.array([[0.2, 0.9, 0.0, 0.3]])
    assert K.hysteresis(heat, 0.1, 0.5).tolist() == [[True, True, False, False]]


def test_resizing_and_blur_keep_constants():
    c = np.full((6, 7), 3.0)
    for out in (K.gaussian(c, 1.5), K.bilinear(c, 11, 5), K.area_mean(c, 3, 2), K.nearest(c, 4, 4)):
        assert out == pytest.approx(3.0)
    assert K.ssim(c, c) == pytest.approx(1.0)


@pytest.mark.parametrize("name", K.PERTURBATIONS)
def test_perturbations(name):
    image = np.zeros((16, 16))
    image[4:12, 6:16] = 1.0  # edges: on noise a wider blur need not lie farther off
    rng = lambda: np.random.default_rng(2)
    assert (K.perturb(image, name, 0, rng()) == image).all()
    assert (K.perturb(image, name, 3, rng()) == K.perturb(image, name, 3, rng())).all()
    far = [np.abs(K.perturb(image, name, s, rng()) - image).mean() for s in (1, 5)]
    assert far[1] >= far[0] > 0


def test_dct_hash_ignores_brightness():
    image = np.random.default_rng(1).random((40, 40))
    assert K.dct_hash(image) == K.dct_hash(image + 2.0) != K.dct_hash(image.T)


def test_coreset_covers():
    x = np.repeat(np.eye(4), 5, axis=0)
    picks = greedy_coreset(x, 4)
    assert sorted((picks // 5).tolist()) == [0, 1, 2, 3]
    assert squared_distances(x, x).min() >= 0


@pytest.mark.parametrize("n, tile, overlap", [(100, 30, 5), (64, 64, 8), (101, 20, 0), (37, 10, 3)])
def test_tiles_own_every_cell_once(spark, n, tile, overlap):
    windows = spark.range(1).select(tile_windows(F.lit(n), tile, overlap).alias("w")).first().w
    assert [i for _, _, c, d in windows for i in range(c, d)] == list(range(n)) and all(a <= c and d <= b for a, b, c, d in windows)
