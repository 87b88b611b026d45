"""Numeric kernels in NumPy: local features, matching, robust homographies, warping and blending.

Frames are (height, width, 3) uint8 arrays, BGR. The detector takes corners by the smaller eigenvalue of the structure
tensor; descriptors are 4 x 4 x 8 gradient-orientation histograms of an upright 16 x 16 patch. They are not those of any
vision library; what is recovered from them is geometry.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from contextlib import nullcontext

import numpy as np

MOST_FEATURES = 8000
RATIO, LEAST_MATCHES, LEAST_INLIERS, REPROJECTION, MOST_TIMES = 0.7, 4, 15, 5.0, 4
BORDER = 9


def to_gray(image: np.ndarray) -> np.ndarray:
    b, g, r = (image[..., c].astype(np.int64) for c in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(float)


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()
    for axis in (0, 1):
        padded = np.pad(x, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = x.shape[axis]
        x = sum(w * np.take(padded, range(k, k + n), axis) for k, w in enumerate(weight))
    return x


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned; half size of even sides is the rounded mean of 2 x 2 pixels."""
    y = np.clip((np.arange(height) + 0.5) * image.shape[0] / height - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * image.shape[1] / width - 0.5, 0, image.shape[1] - 1)
    return np.floor(bilinear(image, *np.meshgrid(x, y)) + 0.5).astype(np.uint8)


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at real coordinates, zero outside."""
    h, w = image.shape[:2]
    inside = (x > -1) & (x < w) & (y > -1) & (y < h)
    x0, y0 = np.floor(np.where(inside, x, 0)).astype(int), np.floor(np.where(inside, y, 0)).astype(int)
    padded = np.zeros((h + 2, w + 2, image.shape[2]))
    padded[1:-1, 1:-1] = image
    fx, fy = (np.where(inside, x, 0) - x0)[..., None], (np.where(inside, y, 0) - y0)[..., None]
    at = lambda dy, dx: padded[np.clip(y0 + 1 + dy, 0, h + 1), np.clip(x0 + 1 + dx, 0, w + 1)]
    out = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    return np.where(inside[..., None], out, 0)


def features(image: np.ndarray, most: int = MOST_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Keypoints (n, 3: x, y, response), strongest first, and float32 descriptors (n, 128)."""
    plane = smooth(to_gray(image), 1.0)
    none = np.zeros((0, 3), np.float32), np.zeros((0, 128), np.float32)
    if min(plane.shape) <= 2 * BORDER + 2:
        return none
    gy, gx = np.gradient(plane)
    a, b, c = (smooth(v, 1.5) for v in (gx * gx, gx * gy, gy * gy))
    response = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    inner = np.zeros_like(response, bool)
    inner[BORDER:-BORDER, BORDER:-BORDER] = True
    around = np.pad(response, 1, constant_values=-1)
    h, w = response.shape
    top = np.ones_like(inner)
    for dy in (0, 1, 2):
        for dx in (0, 1, 2):
            if (dy, dx) != (1, 1):
                top &= response >= around[dy : dy + h, dx : dx + w]
    ys, xs = np.nonzero(top & inner & (response > max(1e-3, 0.005 * response.max())))
    order = np.lexsort((xs, ys, -response[ys, xs]))[:most]
    ys, xs = ys[order], xs[order]
    if len(xs) == 0:
        return none
    size, angle = np.hypot(gx, gy), np.arctan2(gy, gx)
    span = np.arange(-8, 8)
    py, px = ys[:, None, None] + span[None, :, None], xs[:, None, None] + span[None, None, :]
    fall = np.exp(-((span[:, None] + 0.5) ** 2 + (span[None] + 0.5) ** 2) / 128)
    weight = size[py, px] * fall
    turn = (angle[py, px] / (2 * np.pi) % 1) * 8
    low = np.floor(turn).astype(int)
    part = turn - low
    cell = (np.arange(16) // 4)[:, None] * 4 + (np.arange(16) // 4)[None]
    base = np.arange(len(xs))[:, None, None] * 128 + cell * 8
    out = np.bincount((base + low % 8).ravel(), (weight * (1 - part)).ravel(), len(xs) * 128) + np.bincount((base + (low + 1) % 8).ravel(), (weight * part).ravel(), len(xs) * 128)
    out = out.reshape(-1, 128)
    out /= np.linalg.norm(out, axis=1, keepdims=True) + 1e-9
    out = np.minimum(out, 0.2)
    out /= np.linalg.norm(out, axis=1, keepdims=True) + 1e-9
    return np.stack([xs, ys, response[ys, xs]], 1).astype(np.float32), out.astype(np.float32)


def matches(base: np.ndarray, new: np.ndarray, ratio: float = RATIO, block: int = 2048) -> np.ndarray:
    """(k, 2) indices into base and new: the nearest is clearly nearer than the second. None with fewer than two."""
    if len(base) < 2 or len(new) < 2:
        return np.zeros((0, 2), int)
    out = []
    for k in range(0, len(base), block):
        d = np.maximum(0, 2 - 2 * base[k : k + block].astype(float) @ new.T.astype(float))
        at = np.argpartition(d, 1, axis=1)[:, :2]
        two = np.take_along_axis(d, at, 1)
        first = two.argmin(1)
        near, second = np.sqrt(two.min(1)), np.sqrt(two.max(1))
        own = np.flatnonzero(near < ratio * second)
        out.append(np.stack([own + k, at[own, first[own]]], 1))
    return np.concatenate(out)


def homographies(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Exact matrices (m, 3, 3) of m samples of four points; nan where a sample is degenerate."""
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], 1)
    right = np.concatenate([u, v], 1)
    ok = np.abs(np.linalg.det(rows)) > 1e-6
    out = np.full((len(src), 9), np.nan)
    if ok.any():
        out[ok, :8] = np.linalg.solve(rows[ok], right[ok][..., None])[..., 0]
        out[ok, 8] = 1
    return out.reshape(-1, 3, 3)


def fitted(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least squares on all points, in normalised coordinates."""

    def scale(p: np.ndarray) -> np.ndarray:
        m, s = p.mean(0), max(1e-9, p.std())
        return np.array([[1 / s, 0, -m[0] / s], [0, 1 / s, -m[1] / s], [0, 0, 1]])

    ts, td = scale(src), scale(dst)
    (x, y), (u, v) = (src @ ts[:2, :2].T + ts[:2, 2]).T, (dst @ td[:2, :2].T + td[:2, 2]).T
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 1)])
    h = np.linalg.inv(td) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ts
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 and np.isfinite(h).all() else None


def applied(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.concatenate([p, np.ones((len(p), 1))], 1) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[:, :2] / q[:, 2:]


def robust(base: np.ndarray, new: np.ndarray, seed: int, trials: int = 600) -> tuple[np.ndarray | None, int]:
    """(homography from new to base, inliers) by random samples; None without a valid one. The same for the same seed."""
    if len(base) < LEAST_MATCHES:
        return None, 0
    rng = np.random.default_rng(seed)
    picks = rng.random((trials, len(base))).argpartition(3, axis=1)[:, :4]
    tried = homographies(new[picks], base[picks])
    points = np.concatenate([new, np.ones((len(new), 1))], 1)
    with np.errstate(all="ignore"):
        moved = np.einsum("mij,nj->mni", tried, points)
        error = np.linalg.norm(moved[..., :2] / moved[..., 2:] - base[None], axis=2)
    good = np.nan_to_num(error, nan=np.inf) <= REPROJECTION
    best = int(good.sum(1).argmax())
    inside = good[best]
    if inside.sum() < LEAST_MATCHES:
        return None, int(inside.sum())
    h = tried[best]
    for _ in range(2):
        better = fitted(new[inside], base[inside])
        if better is None:
            break
        now = np.nan_to_num(np.linalg.norm(applied(better, new) - base, axis=1), nan=np.inf) <= REPROJECTION
        if now.sum() < inside.sum():
            break
        h, inside = better, now
    return h, int(inside.sum())


def canvas(shape1: tuple[int, int], shape2: tuple[int, int], h: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x_min, y_min, x_max, y_max), or None where the canvas is empty, too large or not finite."""
    (h1, w1), (h2, w2) = shape1, shape2
    corners = np.concatenate([[[0, 0], [0, h1], [w1, h1], [w1, 0]], applied(h, np.array([[0, 0], [0, h2], [w2, h2], [w2, 0]], float))])
    if not np.isfinite(corners).all() or np.abs(corners).max() > 1e9:
        return None
    lo, hi = np.trunc(corners.min(0) - 0.5).astype(int).tolist(), np.trunc(corners.max(0) + 0.5).astype(int).tolist()
    w, t = hi[0] - lo[0], hi[1] - lo[1]
    return (*lo, *hi) if w > 0 and t > 0 and w * t <= MOST_TIMES * (h1 * w1 + h2 * w2) else None


def blended(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap: mean, cut to an integer; elsewhere whichever frame has a pixel that isn't black."""
    has_a, has_b = a.any(2)[..., None], b.any(2)[..., None]
    mean = ((a.astype(np.uint16) + b) // 2).astype(np.uint8)
    return np.where(has_a & has_b, mean, np.where(has_a, a, np.where(has_b, b, 0))).astype(np.uint8)


def warped(image1: np.ndarray, image2: np.ndarray, h: np.ndarray, strips: int = 1) -> np.ndarray | None:
    """Both frames on one canvas, frame 2 moved by ``h``; in so many horizontal strips, which doesn't change the result."""
    box = canvas(image1.shape[:2], image2.shape[:2], h)
    if box is None:
        return None
    x0, y0, x1, y1 = box
    back = np.linalg.inv(h)
    height, width = y1 - y0, x1 - x0
    step = -(-height // strips)
    out = []
    for top in range(0, height, step):
        rows = min(step, height - top)
        xs, ys = np.meshgrid(np.arange(width) + x0, np.arange(rows) + y0 + top)
        at = applied(back, np.stack([xs.ravel(), ys.ravel()], 1).astype(float))
        at = np.where(np.isfinite(at), at, -10)
        new = np.floor(bilinear(image2, at[:, 0].reshape(rows, width), at[:, 1].reshape(rows, width)) + 0.5).astype(np.uint8)
        old = np.zeros((rows, width, 3), np.uint8)
        y, x = np.arange(rows) + y0 + top, np.arange(width) + x0
        iny, inx = (y >= 0) & (y < image1.shape[0]), (x >= 0) & (x < image1.shape[1])
        old[np.ix_(iny, inx)] = image1[np.ix_(y[iny], x[inx])]
        out.append(blended(old, new))
    return np.concatenate(out)


def untimed(phase: str) -> nullcontext:
    return nullcontext()


def merged(base: np.ndarray, base_f: tuple, new: np.ndarray, new_f: tuple, seed: int, strips: int = 1, clock: Callable = untimed) -> tuple[np.ndarray | None, str | None]:
    """(canvas, None), or (None, why the pair can't be merged). ``clock`` gives a context for each phase."""
    with clock("match"):
        pairs = matches(base_f[1], new_f[1])
    if len(pairs) < LEAST_MATCHES:
        return None, "too few matches"
    with clock("homo"):
        h, inliers = robust(base_f[0][pairs[:, 0], :2].astype(float), new_f[0][pairs[:, 1], :2].astype(float), seed)
    if h is None or inliers < LEAST_INLIERS:
        return None, "too few inliers"
    with clock("warp"):
        out = warped(base, new, h, strips)
    return (out, None) if out is not None else (None, "canvas refused")


def seeded(*parts: int) -> int:
    return zlib.crc32(",".join(map(str, parts)).encode())
