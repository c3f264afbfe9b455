"""Array helpers for one frame. Linear filters are small per-axis matrices: any kernel length
and any border rule become two matrix products."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EPS = 1e-8


def as_unit(img: np.ndarray) -> np.ndarray:
    return img.astype(np.float32) / 255.0 if img.dtype == np.uint8 else img.astype(np.float32)


def as_bytes(img: np.ndarray) -> np.ndarray:
    return img if img.dtype == np.uint8 else np.clip(img * 255.0 + 0.5, 0, 255).astype(np.uint8)


def border_index(i: np.ndarray, n: int, rule: str) -> np.ndarray:
    """Source index of out-of-range positions: edge, mirror (edge repeated), mirror101."""
    if rule == "edge" or n == 1:
        return np.clip(i, 0, n - 1)
    period = 2 * n if rule == "mirror" else 2 * n - 2
    j = np.mod(i, period)
    return np.where(j < n, j, period - j - (1 if rule == "mirror" else 0))


SHORT = 128  # axes up to this length have one matrix each; longer ones share a strip per filter
STRIP = 64


@lru_cache(maxsize=2048)
def axis_filter(n: int, taps: tuple[float, ...], rule: str) -> np.ndarray:
    """Matrix that correlates an axis of length n with centred taps under a border rule."""
    shift, weight = np.arange(len(taps)) - len(taps) // 2, np.array(taps)
    period = 0 if rule == "edge" or n == 1 else 2 * n if rule == "mirror" else 2 * n - 2
    if period and len(taps) > period:  # mirrored positions repeat, so long kernels fold
        weight = np.bincount(shift % period, weights=weight, minlength=period)
        shift = np.arange(period)
    rows = np.arange(n)[:, None]
    cells = rows * n + border_index(rows + shift, n, rule)
    w = np.broadcast_to(weight, cells.shape)
    return np.bincount(cells.ravel(), weights=w.ravel(), minlength=n * n).reshape(n, n)


@lru_cache(maxsize=64)
def strip_filter(taps: tuple[float, ...]) -> np.ndarray:
    """Matrix from STRIP + len(taps) - 1 neighbours to STRIP filtered values: the same for axes of any length."""
    m = np.zeros((STRIP, STRIP + len(taps) - 1))
    for i in range(STRIP):
        m[i, i:i + len(taps)] = taps
    return m


def filter_rows(x: np.ndarray, taps: tuple[float, ...], rule: str) -> np.ndarray:
    """Filter the first axis. Memory for a long axis grows with its length, not with the square."""
    n = len(x)
    if n <= SHORT:
        return axis_filter(n, taps, rule) @ x
    lead = len(taps) // 2
    near = x[border_index(np.arange(-lead, n + len(taps) - 1 - lead), n, rule)]
    m = strip_filter(taps)
    return np.concatenate([m[:min(STRIP, n - i), :min(STRIP, n - i) + len(taps) - 1] @ near[i:min(i + STRIP, n) + len(taps) - 1]
                           for i in range(0, n, STRIP)])


@lru_cache(maxsize=64)
def gaussian_taps(sigma: float, size: int = 0) -> tuple[float, ...]:
    size = size or int(round(sigma * 8 + 1)) | 1
    x = np.arange(size) - (size - 1) / 2.0
    k = np.exp(-(x * x) / (2.0 * sigma * sigma))
    return tuple(k / k.sum())


def separable(x: np.ndarray, taps: tuple[float, ...], rule: str = "mirror101") -> np.ndarray:
    """Filter both image axes of an HxW or HxWxC array."""
    flat = filter_rows(x.reshape(x.shape[0], -1), taps, rule).reshape(x.shape)
    turned = np.moveaxis(flat, 1, 0)
    turned = filter_rows(turned.reshape(turned.shape[0], -1), taps, rule).reshape(turned.shape)
    return np.ascontiguousarray(np.moveaxis(turned, 0, 1))


def box_blur(x: np.ndarray, size: int) -> np.ndarray:
    return separable(x, (1.0 / size,) * size)


def gaussian_blur(x: np.ndarray, sigma: float) -> np.ndarray:
    return separable(x, gaussian_taps(float(sigma)))


def cubic_axis(n_out: int, n_in: int) -> np.ndarray:
    """Matrix of cubic interpolation from n_in to n_out samples, edges repeated; those of short axes are kept."""
    return _cubic_axis(n_out, n_in) if n_out <= SHORT else _cubic_axis.__wrapped__(n_out, n_in)


@lru_cache(maxsize=2048)
def _cubic_axis(n_out: int, n_in: int, a: float = -0.75) -> np.ndarray:
    pos = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    base = np.floor(pos).astype(int)
    m = np.zeros((n_out, n_in))
    for k in range(-1, 3):
        d = np.abs(pos - (base + k))
        w = np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1,
                     ((a * d - 5 * a) * d + 8 * a) * d - 4 * a)
        np.add.at(m, (np.arange(n_out), np.clip(base + k, 0, n_in - 1)), w)
    return m


def local_min(x: np.ndarray, radius: int) -> np.ndarray:
    """Minimum over a square window that ignores positions outside the image; windows double until they are wide enough."""
    size = 2 * radius + 1
    for axis in (0, 1):
        n = x.shape[axis]
        p = np.full((n + 2 * radius, *x.shape[1 - axis:2 - axis], *x.shape[2:]), np.inf, np.result_type(x.dtype, np.float32))
        p[radius:radius + n] = np.moveaxis(x, axis, 0)
        width = 1
        while 2 * width <= size:
            p = np.minimum(p[:-width], p[width:])
            width *= 2
        if width < size:
            p = np.minimum(p[:len(p) - (size - width)], p[size - width:])
        x = np.moveaxis(p, 0, axis)
    return np.ascontiguousarray(x)


def luminance(img: np.ndarray) -> np.ndarray:
    """8-bit luminance of an 8-bit RGB frame, in exact integer arithmetic."""
    r, g, b = (img[..., k].astype(np.int64) for k in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(np.float64)


def percentiles(rows: np.ndarray, *of: float) -> np.ndarray:
    """``np.percentile`` of each column of a float array, without its overhead on small frames."""
    place = (len(rows) - 1) * (np.array(of) / 100)
    below = np.clip(np.floor(place), 0, len(rows) - 1).astype(np.intp)
    above = np.minimum(below + 1, len(rows) - 1)
    s = np.sort(rows.T, axis=1)
    a, b, t = s[:, below].T, s[:, above].T, (place - np.floor(place))[:, None]
    return np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t)


def stretch(x: np.ndarray, lo: float = 1.0, hi: float = 99.0) -> np.ndarray:
    """Per-channel percentile stretch to [0, 1]."""
    a, b = percentiles(x.reshape(-1, x.shape[-1]), lo, hi)
    return np.clip((x - a) / (b - a + EPS), 0.0, 1.0)
