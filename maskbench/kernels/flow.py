"""Warps along a supplied flow: flow(x) is the forward displacement of pixel x, so the next
frame gathers from x - flow(x)."""

from __future__ import annotations

import numpy as np


def grid(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    ys, xs = np.mgrid[0:h, 0:w]
    return ys.astype(np.float64), xs.astype(np.float64)


def nearest(src: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    h, w = src.shape
    return src[np.clip(np.rint(ys).astype(int), 0, h - 1), np.clip(np.rint(xs).astype(int), 0, w - 1)]


def linear(src: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    h, w = src.shape
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    fy, fx = ys - y0, xs - x0
    at = lambda y, x: src[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]
    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return top * (1 - fy) + low * fy


def warp(src: np.ndarray, flow: np.ndarray, soft: bool = False) -> np.ndarray:
    ys, xs = grid(*src.shape)
    pick = linear if soft else nearest
    return pick(src, ys - flow[..., 1], xs - flow[..., 0])


def warp_inside(src: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """Nearest warp that loses whatever would come from outside the frame."""
    ys, xs = grid(*src.shape)
    my, mx = ys - flow[..., 1], xs - flow[..., 0]
    ok = (mx >= 0) & (mx <= src.shape[1] - 1) & (my >= 0) & (my <= src.shape[0] - 1)
    return nearest(src, my, mx) & ok


def cycle_error(fwd: np.ndarray, bwd: np.ndarray) -> float:
    """Mean length of forward flow plus the backward flow at its end point."""
    h, w = fwd.shape[:2]
    ys, xs = grid(h, w)
    my, mx = np.clip(ys + fwd[..., 1], 0, h - 1), np.clip(xs + fwd[..., 0], 0, w - 1)
    ex = fwd[..., 0] + linear(bwd[..., 0].astype(float), my, mx)
    ey = fwd[..., 1] + linear(bwd[..., 1].astype(float), my, mx)
    return float(np.sqrt(ex * ex + ey * ey).mean())
