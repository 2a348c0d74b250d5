"""Image kernels on arrays: resize, colour spaces, region segmentation, region features."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Side of the working image, fineness and least region share of the segmentation (fixed values).
SIDE, FINENESS, SIZE_FACTOR = 128, 125.0, 0.005
#: Weights of the 14 features (fixed values): HSV means, deviations, skews; aspect, fill, size, centroid.
FEATURE_WEIGHTS = np.array([6, 3, 1.5, 4, 2, 1, 4, 2, 1, 0.2, 0.4, 0.04, 0.007, 0.007])
_GRAY = 256
#: Fewest images that are segmented side by side, and their most pixels.
FEW, PIXELS = 48, 1 << 19


def lanczos(x: np.ndarray, a: int = 3) -> np.ndarray:
    return np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)


@lru_cache(maxsize=256)
def resize_matrix(n: int, m: int) -> np.ndarray:
    """(m x n) weights that take n samples to m by a Lanczos-3 kernel, widened when shrinking; rows sum to 1."""
    scale = n / m
    width = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale - 0.5
    w = lanczos((np.arange(n)[None, :] - centre[:, None]) / width)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """(side x side x 3) bytes: two matrix products, one for each direction."""
    h, w = image.shape[:2]
    rows = np.einsum("ah,hwc->awc", resize_matrix(h, side), image.astype(float))
    return np.clip(np.rint(np.einsum("bw,awc->abc", resize_matrix(w, side), rows)), 0, 255).astype(np.uint8)


def rgb_to_hsv(rgb: np.ndarray) -> np.ndarray:
    """HSV bytes: the hue circle as 0..255, cut to integers."""
    c = rgb.astype(np.int64)
    top, low = c.max(axis=-1), c.min(axis=-1)
    delta = top - low
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    d = np.maximum(delta, 1)
    sixth = np.where(top == r, (g - b) / d, np.where(top == g, 2 + (b - r) / d, 4 + (r - g) / d))
    hue = np.where(delta == 0, 0.0, (sixth % 6) * 255 / 6)
    sat = np.where(top == 0, 0, delta * 255 // np.maximum(top, 1))
    return np.stack((np.floor(hue + 1e-9), sat, top), axis=-1).astype(np.uint8)


def hsv_to_rgb(hsv: np.ndarray) -> np.ndarray:
    h, s, v = (hsv[..., i].astype(float) for i in range(3))
    sector = h * 6 / 255
    i = np.floor(sector).astype(int) % 6
    f = sector - np.floor(sector)
    s = s / 255
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    table = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    return np.rint(np.stack([np.choose(i, [x[k] for x in table]) for k in range(3)], axis=-1)).astype(np.uint8)


def segment(rgb: np.ndarray, fineness: float = FINENESS, size_factor: float = SIZE_FACTOR) -> tuple[np.ndarray, int]:
    """(labels, number) by statistical region merging.

    Neighbouring pixels are merged in the order of their largest channel difference if the means of their regions
    differ by less than a bound that falls with size, in every channel; then regions below the least size join their
    left neighbour. Labels count from 0 in scan order.
    """
    rows, cols = rgb.shape[:2]
    n = rows * cols
    flat = rgb.reshape(n, 3).astype(np.int64)
    index = np.arange(n).reshape(rows, cols)
    a = np.concatenate((index[:, :-1].ravel(), index[:-1].ravel()))
    b = np.concatenate((index[:, 1:].ravel(), index[1:].ravel()))
    order = np.argsort(np.abs(flat[a] - flat[b]).max(axis=1), kind="stable")
    parent, size = list(range(n)), [1] * n
    mean = flat.astype(float).tolist()
    log_delta = 2 * math.log(6 * n)
    factor = _GRAY * _GRAY / (2 * fineness)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(x: int, y: int) -> None:
        if size[x] < size[y]:
            x, y = y, x
        total = size[x] + size[y]
        mean[x] = [(size[x] * p + size[y] * q) / total for p, q in zip(mean[x], mean[y], strict=True)]
        parent[y], size[x] = x, total

    bounds: dict[int, float] = {}

    def bound(s: int) -> float:
        if s not in bounds:
            bounds[s] = (min(_GRAY, s) * math.log(1 + s) + log_delta) / s
        return bounds[s]

    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            t = math.sqrt(factor * (bound(size[x]) + bound(size[y])))
            if all(abs(p - q) < t for p, q in zip(mean[x], mean[y], strict=True)):
                union(x, y)
    least = size_factor * n
    for r in range(rows):
        for c in range(1, cols):
            x, y = find(r * cols + c), find(r * cols + c - 1)
            if x != y and (size[x] < least or size[y] < least):
                union(x, y)
    roots = np.array([find(i) for i in range(n)])
    _, first, back = np.unique(roots, return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[back].reshape(rows, cols), len(first)


@lru_cache(maxsize=4)
def _bounds(n: int) -> np.ndarray:
    """The bound's share of a region of each size up to n, of an image of n pixels."""
    log_delta = 2 * math.log(6 * n)
    return np.array([math.inf] + [(min(_GRAY, s) * math.log(1 + s) + log_delta) / s for s in range(1, n + 1)])


def segment_many(rgb: np.ndarray, fineness: float = FINENESS, size_factor: float = SIZE_FACTOR) -> tuple[np.ndarray, np.ndarray]:
    """segment() of images (count x side x side x 3) side by side: (labels, numbers). Each step takes the next pair of neighbours of every image, so that a step is a few operations on arrays."""
    count, rows, cols = rgb.shape[:3]
    n = rows * cols
    flat = rgb.reshape(count, n, 3).astype(np.int16)
    index = np.arange(n, dtype=np.int32).reshape(rows, cols)
    a = np.concatenate((index[:, :-1].ravel(), index[:-1].ravel()))
    b = np.concatenate((index[:, 1:].ravel(), index[1:].ravel()))
    order = np.argsort(np.abs(flat[:, a] - flat[:, b]).max(axis=2).astype(np.uint8), axis=1, kind="stable").T
    begins = np.arange(count) * n
    parent, size = np.arange(count * n), np.ones(count * n, np.int64)
    means = [np.ascontiguousarray(flat[:, :, c], float).ravel() for c in range(3)]
    factor, bounds = _GRAY * _GRAY / (2 * fineness), _bounds(n)

    def roots(at: np.ndarray) -> np.ndarray:
        up = parent.take(at)
        while True:
            above = parent.take(up)
            if (above == up).all():
                parent[at] = up
                return up
            up = above

    def union(x: np.ndarray, y: np.ndarray) -> None:
        less = size.take(x) < size.take(y)
        x, y = np.where(less, y, x), np.where(less, x, y)
        sx, sy = size.take(x), size.take(y)
        total = sx + sy
        for mean in means:
            mean[x] = (sx * mean.take(x) + sy * mean.take(y)) / total
        parent[y], size[x] = x, total

    def pairs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = roots(np.concatenate((begins + i, begins + j)))
        x, y = both[:count], both[count:]
        apart = np.flatnonzero(x != y)
        return x[apart], y[apart]

    for e in order:
        x, y = pairs(a[e], b[e])
        if len(x):
            t = np.sqrt(factor * (bounds.take(size.take(x)) + bounds.take(size.take(y))))
            near = np.flatnonzero(np.logical_and.reduce([np.abs(mean.take(x) - mean.take(y)) < t for mean in means]))
            if len(near):
                union(x[near], y[near])
    least = size_factor * n
    for r in range(rows):
        for c in range(1, cols):
            x, y = pairs(r * cols + c, r * cols + c - 1)
            small = np.flatnonzero((size[x] < least) | (size[y] < least))
            if len(small):
                union(x[small], y[small])
    _, first, back = np.unique(roots(np.arange(count * n)), return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    numbers = np.bincount(first // n, minlength=count)
    labels = rank[back].reshape(count, n) - (np.cumsum(numbers) - numbers)[:, None]
    return labels.reshape(count, rows, cols), numbers


def region_box(xs: list[int], ys: list[int], fill: float = 0.15) -> tuple[float, float, float, int, int]:
    """Log aspect, fill ratio, log box size and integer centroid of a region's pixels in scan order.

    A box grows while it is filled by more than ``fill``; a pixel that finds it emptier closes it, and closed boxes are
    united. The result is the open box if the closed ones have under a tenth of the pixels, else the union of all.
    """
    x1, y1, x2, y2, inside = xs[0], ys[0], xs[0] + 1, ys[0] + 1, 1
    union: tuple[int, int, int, int] | None = None
    closed = 0

    def merged(u: tuple[int, int, int, int] | None) -> tuple[int, int, int, int]:
        return (x1, y1, x2, y2) if u is None else (min(u[0], x1), min(u[1], y1), max(u[2], x2), max(u[3], y2))

    for x, y in zip(xs[1:], ys[1:], strict=True):
        if inside / ((x2 - x1) * (y2 - y1)) > fill:
            x1, x2, y1, y2 = min(x1, x), max(x2, x + 1), min(y1, y), max(y2, y + 1)
            inside += 1
        else:
            union, closed = merged(union), closed + inside
            x1, y1, x2, y2, inside = x, y, x + 1, y + 1, 1
    total = inside + closed
    if closed / total < 0.1:
        w, h, n = x2 - x1, y2 - y1, inside
    else:
        u = merged(union)
        w, h, n = u[2] - u[0], u[3] - u[1], total
    return math.log(h / w), n / (w * h), math.log(w * h), sum(xs) // total, sum(ys) // total


def region_features(hsv: np.ndarray, labels: np.ndarray, n: int, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(weights, features n x 14): colour moments by region and box features; a region's weight is its share of the square roots of sizes."""
    flat, region = hsv.reshape(-1, 3).astype(float), labels.ravel()
    size = np.bincount(region, minlength=n)
    out = np.zeros((n, 14))
    for c in range(3):
        mean = np.bincount(region, flat[:, c], n) / size
        d = flat[:, c] - mean[region]
        out[:, c] = mean / 255
        out[:, 3 + c] = np.sqrt(np.bincount(region, d * d, n) / size) / 255
        out[:, 6 + c] = np.cbrt(np.bincount(region, d**3, n) / size) / 255
    ys, xs = np.divmod(np.arange(len(region)), labels.shape[1])
    order = np.argsort(region, kind="stable")
    for r, at in enumerate(np.split(order, np.cumsum(size)[:-1])):
        out[r, 9:] = region_box(xs[at].tolist(), ys[at].tolist())
    root = np.sqrt(size)
    return root / root.sum(), out * FEATURE_WEIGHTS if weighted else out


def region_boxes(xs: np.ndarray, ys: np.ndarray, size: np.ndarray, fill: float = 0.15) -> np.ndarray:
    """region_box() of regions whose pixels follow one another, as rows: the next pixel of every region at each step."""
    by_size = np.argsort(-size, kind="stable")
    begins, total = (np.cumsum(size) - size)[by_size], size[by_size]
    x1, y1 = xs[begins], ys[begins]
    x2, y2, inside, closed = x1 + 1, y1 + 1, np.ones_like(total), np.zeros_like(total)
    far = np.iinfo(np.int64).max
    union = [np.full(len(total), v) for v in (far, far, -far, -far)]
    active = len(total) - np.searchsorted(total[::-1], np.arange(total[0] if len(total) else 1), "right")
    for k in range(1, len(active)):
        m = active[k]
        x, y = xs[begins[:m] + k], ys[begins[:m] + k]
        shut = np.flatnonzero(~(inside[:m] / ((x2[:m] - x1[:m]) * (y2[:m] - y1[:m])) > fill))
        if len(shut):
            for u, box, widest in zip(union, (x1, y1, x2, y2), (np.minimum, np.minimum, np.maximum, np.maximum), strict=True):
                u[shut] = widest(u[shut], box[shut])
            closed[shut] += inside[shut]
            x1[shut], y1[shut], x2[shut], y2[shut], inside[shut] = x[shut], y[shut], x[shut] + 1, y[shut] + 1, 0
        np.minimum(x1[:m], x, out=x1[:m])
        np.minimum(y1[:m], y, out=y1[:m])
        np.maximum(x2[:m], x + 1, out=x2[:m])
        np.maximum(y2[:m], y + 1, out=y2[:m])
        inside[:m] += 1
    whole = ~(closed / total < 0.1)
    w = np.where(whole, np.maximum(union[2], x2) - np.minimum(union[0], x1), x2 - x1)
    h = np.where(whole, np.maximum(union[3], y2) - np.minimum(union[1], y1), y2 - y1)
    filled = np.where(whole, total, inside) / (w * h)
    ends = np.cumsum(size) - size
    centre = [np.add.reduceat(v, ends) // size if len(size) else v for v in (xs, ys)]
    out = np.empty((len(total), 5))
    out[by_size, 0] = [math.log(v) for v in (h / w).tolist()]
    out[by_size, 1] = filled
    out[by_size, 2] = [math.log(v) for v in (w * h).tolist()]
    out[:, 3], out[:, 4] = centre
    return out


def region_features_many(hsv: np.ndarray, labels: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """region_features() of images side by side: weights and features of all regions, image after image."""
    count, rows, cols = labels.shape
    ends = np.cumsum(numbers)
    flat, region = hsv.reshape(-1, 3).astype(float), (labels.reshape(count, -1) + (ends - numbers)[:, None]).ravel()
    n = int(ends[-1])
    size = np.bincount(region, minlength=n)
    out = np.zeros((n, 14))
    for c in range(3):
        mean = np.bincount(region, flat[:, c], n) / size
        d = flat[:, c] - mean[region]
        out[:, c] = mean / 255
        out[:, 3 + c] = np.sqrt(np.bincount(region, d * d, n) / size) / 255
        out[:, 6 + c] = np.cbrt(np.bincount(region, d**3, n) / size) / 255
    at = np.argsort(region, kind="stable") % (rows * cols)
    out[:, 9:] = region_boxes(at % cols, at // cols, size)
    root = np.sqrt(size)
    return np.concatenate([r / r.sum() for r in np.split(root, ends[:-1])]), out * FEATURE_WEIGHTS


def edge_overlay(rgb: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The image with pixels at region borders inverted."""
    edge = np.zeros(labels.shape, bool)
    edge[:, 1:] |= labels[:, 1:] != labels[:, :-1]
    edge[1:] |= labels[1:] != labels[:-1]
    out = rgb.copy()
    out[edge] = 255 - out[edge]
    return out
