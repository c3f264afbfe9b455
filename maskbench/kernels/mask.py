"""Binary masks as stacks (n, h, w): packed bits in, counts and scores out."""

from __future__ import annotations

import math

import numpy as np


def unpack(bits: list[bytes], h: int, w: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
    return np.unpackbits(raw, axis=1)[:, : h * w].reshape(len(bits), h, w).astype(bool)


def pack(masks: np.ndarray) -> list[bytes]:
    flat = np.packbits(masks.reshape(len(masks), -1), axis=1)
    return [row.tobytes() for row in flat]


def _window(m: np.ndarray, r: int, fill: bool, every: bool) -> np.ndarray:
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        v = np.lib.stride_tricks.sliding_window_view(
            np.pad(m, pad, constant_values=fill), 2 * r + 1, axis=axis)
        m = v.all(-1) if every else v.any(-1)
    return m


def erode(m: np.ndarray) -> np.ndarray:
    return _window(m, 1, True, True)


def dilate(m: np.ndarray, r: int) -> np.ndarray:
    return _window(m, r, False, False) if r else m


def rim(m: np.ndarray) -> np.ndarray:
    """Inner boundary pixels: those lost to a 3x3 erosion."""
    return m & ~erode(m)


def count(m: np.ndarray) -> np.ndarray:
    return m.reshape(len(m), -1).sum(1).astype(np.int64)


def ratio(num, den, empty: float) -> np.ndarray:
    return np.divide(num, den, out=np.full(len(num), empty), where=den > 0)


def region(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    return ratio(count(p & g).astype(float), count(p | g), 1.0)


def f_score(prec: np.ndarray, rec: np.ndarray) -> np.ndarray:
    return ratio(2.0 * prec * rec, prec + rec, 0.0)


def boundary(p: np.ndarray, g: np.ndarray, tol: int = 2) -> np.ndarray:
    """F-measure of two dilated rims; both empty 1, one empty 0."""
    bp, bg = dilate(rim(p), tol), dilate(rim(g), tol)
    both, np_, ng = count(bp & bg).astype(float), count(bp), count(bg)
    f = f_score(ratio(both, np_, 0.0), ratio(both, ng, 0.0))
    return np.where((np_ == 0) & (ng == 0), 1.0, f)


def edge_map(m: np.ndarray) -> np.ndarray:
    """One-pixel boundary: pixels that differ from their right, lower or diagonal neighbour.
    Beyond the last row and column the neighbour is the pixel itself."""
    p = np.pad(m, ((0, 0), (0, 1), (0, 1)), mode="edge")
    here = p[:, :-1, :-1]
    return (here != p[:, :-1, 1:]) | (here != p[:, 1:, :-1]) | (here != p[:, 1:, 1:])


def disc_dilate(m: np.ndarray, radius: int) -> np.ndarray:
    out = np.zeros_like(m)
    h, w = m.shape[1:]
    p = np.pad(m, ((0, 0), (radius, radius), (radius, radius)))
    for dy in range(-radius, radius + 1):
        reach = math.isqrt(radius * radius - dy * dy)
        for dx in range(-reach, reach + 1):
            out |= p[:, radius + dy:radius + dy + h, radius + dx:radius + dx + w]
    return out


def released_scores(p: np.ndarray, g: np.ndarray, share: float = 0.008):
    """J and F of the released evaluator: an empty pair scores 1, matching on a disc."""
    h, w = p.shape[1:]
    r = math.ceil(share * math.hypot(h, w))
    bp, bg = edge_map(p), edge_map(g)
    n_p, n_g = count(bp), count(bg)
    prec = ratio(count(bp & disc_dilate(bg, r)).astype(float), n_p, 1.0)
    rec = ratio(count(bg & disc_dilate(bp, r)).astype(float), n_g, 1.0)
    prec = np.where((n_p > 0) & (n_g == 0), 0.0, prec)
    rec = np.where((n_p == 0) & (n_g > 0), 0.0, rec)
    return region(p, g), f_score(prec, rec)


def boxes(m: np.ndarray, pad: float = 0.0) -> np.ndarray:
    """x0, y0, x1, y1 of each mask, padded by a share of its size and clamped; empty: all."""
    n, h, w = m.shape
    out = np.empty((n, 4))
    for axis, size, lo, hi in ((1, w, 0, 2), (2, h, 1, 3)):
        hit = m.any(axis=axis)
        some = hit.any(axis=1)
        a = np.where(some, hit.argmax(1), 0).astype(float)
        b = np.where(some, size - 1 - hit[:, ::-1].argmax(1), size - 1).astype(float)
        grow = np.where(some, pad * (b - a), 0.0)
        out[:, lo] = np.maximum(0.0, a - grow)
        out[:, hi] = np.minimum(size - 1.0, b + grow)
    return out


def components(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (8-connected, 0 outside) of one mask and the area of each label.

    Row runs are united with the touching runs of the row above.
    """
    h, w = m.shape
    step = np.diff(np.pad(m.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, x0 = np.nonzero(step == 1)
    x1 = np.nonzero(step == -1)[1]
    parent = np.arange(len(ys))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ys, np.arange(h + 1))
    for y in range(1, h):
        a, b = first[y - 1], first[y]
        for i in range(first[y], first[y + 1]):
            while a < b and x1[a] < x0[i]:
                a += 1
            k = a
            while k < b and x0[k] <= x1[i]:
                r, q = root(i), root(k)
                parent[max(r, q)] = min(r, q)
                k += 1
    roots = np.array([root(i) for i in range(len(ys))], dtype=int)
    _, ids = np.unique(roots, return_inverse=True) if len(roots) else (None, roots)
    labels = np.zeros((h, w), np.int32)
    for y, a, b, k in zip(ys, x0, x1, ids):
        labels[y, a:b] = k + 1
    return labels, np.bincount(labels.ravel())


def fill_small_holes(m: np.ndarray, max_area: int = 8) -> np.ndarray:
    """Add background components of at most ``max_area`` pixels to the mask."""
    labels, areas = components(~m)
    small = areas <= max_area
    small[0] = False
    return m | small[labels]


def colour_histogram(rgb: np.ndarray, m: np.ndarray, bins: int = 8) -> np.ndarray:
    """Masked per-channel histograms of an 8-bit frame, concatenated and L2-normalised."""
    px = rgb[m].astype(np.float64) / 255.0
    if not len(px):
        return np.zeros(3 * bins)
    idx = np.minimum((px * bins).astype(int), bins - 1) + bins * np.arange(3)
    v = np.bincount(idx.ravel(), minlength=3 * bins) / (len(px) + 1e-8)
    return v / (np.linalg.norm(v) + 1e-8)
