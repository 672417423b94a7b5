"""Numpy kernels on small 2-D arrays, used inside Arrow functions."""

from __future__ import annotations

import math

import numpy as np


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected regions: each cell gets the least flat position of its region, -1 outside."""
    h, w = mask.shape
    big = h * w
    lab = np.where(mask, np.arange(big).reshape(h, w), big)
    while True:
        pad = np.pad(lab, 1, constant_values=big)
        near = np.min([pad[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        new = np.where(mask, near, big)
        flat = np.append(new.ravel(), big)
        new = np.where(mask, np.minimum(new, flat[new]), big)  # follow the label's own label
        if (new == lab).all():
            return np.where(mask, lab, -1)
        lab = new


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur, kernel 2 round(3 sigma) + 1, edges mirrored."""
    if sigma <= 0:
        return image.astype(np.float64)
    r = max(1, int(math.floor(3 * sigma + 0.5)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        p = np.pad(out, pad, mode="symmetric" if r > out.shape[axis] - 1 else "reflect")
        n = out.shape[axis]
        out = sum(c * np.take(p, np.arange(i, i + n), axis=axis) for i, c in enumerate(k))
    return out


def half_away(x: np.ndarray, places: int) -> np.ndarray:
    """``x`` to ``places`` decimals as C and DuckDB round: halves away from zero, and a negative value that comes to nothing is -0."""
    scale = 10.0**places
    y = np.abs(x) * scale
    whole = np.floor(y)
    return np.copysign((whole + (y - whole >= 0.5)) / scale, x)


def bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize with half-pixel centres, edges held."""
    h, w = image.shape
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = image[np.ix_(y0, x0)] * (1 - fx) + image[np.ix_(y0, x1)] * fx
    low = image[np.ix_(y1, x0)] * (1 - fx) + image[np.ix_(y1, x1)] * fx
    return top * (1 - fy) + low * fy


def area_mean(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize down by averaging the covered area."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        lo, hi = edges[:-1, None], edges[1:, None]
        cell = np.arange(n)[None, :]
        return np.clip(np.minimum(hi, cell + 1) - np.maximum(lo, cell), 0, None) * m / n

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = image.shape
    return image[np.ix_((np.arange(height) * h) // height, (np.arange(width) * w) // width)]


def dilate(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    h, w = mask.shape
    a, b = element.shape[0] // 2, element.shape[1] // 2
    p = np.pad(mask, ((a, a), (b, b)))
    out = np.zeros_like(mask)
    for i, j in zip(*np.nonzero(element), strict=True):
        out |= p[i : i + h, j : j + w]
    return out


def erode(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    return ~dilate(~mask, element[::-1, ::-1])


def grey_opening(image: np.ndarray, element: np.ndarray) -> np.ndarray:
    """Least values under the element, then the largest of these; cells beyond the map count for neither."""
    out, a, b = image.astype(np.float64), element.shape[0] // 2, element.shape[1] // 2
    for pick, beyond in ((np.minimum, np.inf), (np.maximum, -np.inf)):
        p = np.pad(out, ((a, a), (b, b)), constant_values=beyond)
        shifted = [p[i : i + out.shape[0], j : j + out.shape[1]] for i, j in zip(*np.nonzero(element), strict=True)]
        out = pick.reduce(shifted)
        element = element[::-1, ::-1]
    return out


def ellipse(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return x * x + y * y <= radius * radius + 0.25


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Squared distance of each cell to the nearest one of the mask, row by row from the distances along columns."""
    h, w = mask.shape
    at = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, at, -2 * (h + w)), axis=0)
    below = np.minimum.accumulate(np.where(mask, at, 2 * h + w + h + w)[::-1], axis=0)[::-1]
    near = np.minimum(at - above, below - at).astype(np.int64) ** 2
    across = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    return np.array([(near[i][None, :] + across).min(axis=1) for i in range(h)]).reshape(h, w)


def line(radius: int, degrees: float, thick: bool = False) -> np.ndarray:
    """A line of 2 radius + 1 cells at an angle; a thick one holds all cells within about one of it."""
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    a = math.radians(degrees)
    out = np.zeros(x.shape, bool)
    t = np.linspace(-radius, radius, 4 * radius + 1)
    out[np.rint(radius - t * math.sin(a)).astype(int), np.rint(radius + t * math.cos(a)).astype(int)] = True
    return out | (np.abs(x * math.sin(a) + y * math.cos(a)) <= 1.0 + 1e-9) if thick else out


def oriented_closing(mask: np.ndarray, radius: int, angles: int) -> np.ndarray:
    """Union of the mask and its closings by lines at evenly spaced angles: dilated by a thick line, eroded by a
    thin one, so that a thin defect at an angle between two lines is bridged as well."""
    if radius < 1 or angles < 1:
        return mask.copy()
    p = np.pad(mask, radius + 1)
    out = p.copy()
    for k in range(angles):
        degrees = 180.0 * k / angles
        out |= erode(dilate(p, line(radius, degrees, thick=True)), line(radius, degrees))
    return out[radius + 1 : -radius - 1, radius + 1 : -radius - 1]


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that no 4-neighbour path joins to the border becomes foreground."""
    p = np.pad(~mask, 1, constant_values=True)
    reach = np.zeros_like(p)
    reach[0, :] = reach[-1, :] = reach[:, 0] = reach[:, -1] = True
    while True:
        q = np.pad(reach, 1)
        new = p & (q[1:-1, 1:-1] | q[:-2, 1:-1] | q[2:, 1:-1] | q[1:-1, :-2] | q[1:-1, 2:])
        if (new == reach).all():
            return mask | ~reach[1:-1, 1:-1]
        reach = new


def remove_small(mask: np.ndarray, least: int) -> np.ndarray:
    lab = components(mask)
    names, sizes = np.unique(lab[lab >= 0], return_counts=True)
    return mask & np.isin(lab, names[sizes >= least])


def hysteresis(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Regions over ``low`` that hold a cell over ``high``."""
    lab = components(image > low)
    return np.isin(lab, np.unique(lab[(image > high) & (lab >= 0)])) & (lab >= 0)


def laplacian_variance(image: np.ndarray) -> float:
    p = np.pad(image.astype(np.float64), 1, mode="reflect" if min(image.shape) > 1 else "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def dct_hash(image: np.ndarray, size: int = 8, side: int = 32) -> int:
    """Low cosine frequencies against their median, the constant one excluded, as a signed 64-bit number."""
    g = area_mean(image, side, side) if min(image.shape) >= side else bilinear(image, side, side)
    k, n = np.arange(side)[:, None], np.arange(side)[None, :]
    c = np.cos(math.pi * k * (2 * n + 1) / (2 * side))
    low = (c @ g @ c.T)[:size, :size].ravel()
    bits = low > np.median(low[1:])
    value = sum(1 << i for i, b in enumerate(bits) if b)
    return value - (1 << 64) if value >> 63 else value


def ssim(a: np.ndarray, b: np.ndarray, sigma: float = 1.5, c1: float = 1e-4, c2: float = 9e-4) -> np.ndarray:
    ma, mb = gaussian(a, sigma), gaussian(b, sigma)
    va, vb, vab = gaussian(a * a, sigma) - ma * ma, gaussian(b * b, sigma) - mb * mb, gaussian(a * b, sigma) - ma * mb
    return ((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def shading_flattened(image: np.ndarray, sigma_fraction: float = 0.25) -> np.ndarray:
    """The image divided by its blurred field, mean kept."""
    field = gaussian(image, sigma_fraction * max(image.shape))
    return image / np.maximum(field, 1e-6) * field.mean()


#: Perturbations by name; severity 0 is the identity, 5 the strongest.
def perturb(image: np.ndarray, name: str, severity: int, rng: np.random.Generator) -> np.ndarray:
    if not 0 <= severity <= 5:
        raise ValueError("severity is 0 to 5")
    if severity == 0:
        return image.astype(np.float64).copy()
    s = severity / 5
    h, w = image.shape
    if name == "gaussian_blur":
        return gaussian(image, 2.0 * s)
    if name == "defocus_blur":
        e = ellipse(max(1, round(2 * s))).astype(float)
        e /= e.sum()
        r = e.shape[0] // 2
        p = np.pad(image.astype(float), r, mode="edge")
        return sum(e[i, j] * p[i : i + h, j : j + w] for i in range(e.shape[0]) for j in range(e.shape[1]))
    if name == "exposure_up":
        return image * (1 + 0.6 * s)
    if name == "exposure_down":
        return image * (1 - 0.6 * s)
    if name == "spatial_light":
        return image * (1 + s * (np.linspace(-0.5, 0.5, w)[None, :] + np.linspace(-0.5, 0.5, h)[:, None]))
    if name == "resize_roundtrip":
        f = 1 - 0.75 * s
        return bilinear(area_mean(image, max(1, round(h * f)), max(1, round(w * f))), h, w)
    if name == "noise":
        return image + rng.normal(0, 0.1 * s, image.shape)
    if name == "translate":
        k = max(1, round(0.1 * s * w))
        return np.pad(image.astype(float), ((0, 0), (k, 0)), mode="edge")[:, :w]
    raise ValueError(f"unknown perturbation {name}")


PERTURBATIONS = ("gaussian_blur", "defocus_blur", "exposure_up", "exposure_down", "spatial_light", "resize_roundtrip", "noise", "translate")


def value_noise(h: int, w: int, rng: np.random.Generator, octaves: int = 3) -> np.ndarray:
    out = sum(bilinear(rng.normal(size=(min(h, 2 ** (o + 1)), min(w, 2 ** (o + 1)))), h, w) / 2**o for o in range(octaves))
    return (out - out.min()) / max(np.ptp(out), 1e-9)


def synthetic_defect(h: int, w: int, rng: np.random.Generator) -> np.ndarray:
    """The mask of a blob or a stroke, never empty."""
    y, x = np.mgrid[:h, :w]
    cy, cx = rng.uniform(0.2, 0.8) * h, rng.uniform(0.2, 0.8) * w
    if rng.random() < 0.5:
        r = rng.uniform(0.08, 0.25) * min(h, w)
        mask = np.hypot(y - cy, x - cx) < r * (0.6 + 0.8 * value_noise(h, w, rng))
    else:
        a, n = rng.uniform(0, math.pi), rng.uniform(0.2, 0.5) * max(h, w)
        t = np.clip((y - cy) * math.sin(a) + (x - cx) * math.cos(a), -n / 2, n / 2)
        mask = np.hypot(y - cy - t * math.sin(a), x - cx - t * math.cos(a)) < 1.0
    if not mask.any():
        mask[int(cy), int(cx)] = True
    return mask
