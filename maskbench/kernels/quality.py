"""Image-quality statistics of one 8-bit RGB frame."""

from __future__ import annotations

import numpy as np

from .image import EPS, border_index, gaussian_taps, local_min, luminance, separable


def _shifted(g: np.ndarray):
    """Access to the neighbours of every pixel, mirrored at the border."""
    h, w = g.shape
    iy, ix = (border_index(np.arange(-1, n + 1), n, "mirror101") for n in (h, w))
    p = g[np.ix_(iy, ix)]
    return lambda dy, dx: p[1 + dy:1 + dy + h, 1 + dx:1 + dx + w]


def no_reference(img: np.ndarray) -> dict[str, float]:
    g = luminance(img)
    at = _shifted(g)
    lap = at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) - 4 * g
    gx = sum(k * (at(d, 1) - at(d, -1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (at(1, d) - at(-1, d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    p = np.bincount(g.astype(int).ravel(), minlength=256) / (g.size + EPS)
    p = p[p > 0]
    hi, lo = img.max(axis=2).astype(np.float64), img.min(axis=2).astype(np.float64)
    sat = np.floor(np.divide((hi - lo) * 255.0, hi, out=np.zeros_like(hi), where=hi > 0) + 0.5)
    return {
        "iqa_laplacian_var": float(lap.var()),
        "iqa_dark_channel": float(local_min(lo / 255.0, 7).mean()),
        "iqa_contrast": float(g.std()),
        "iqa_entropy": float(-(p * np.log2(p)).sum()),
        "iqa_tenengrad": float((gx * gx + gy * gy).mean()),
        "iqa_saturation": float(sat.mean() / 255.0),
    }


def psnr(ref: np.ndarray, img: np.ndarray) -> float:
    mse = float(np.mean((ref.astype(np.float64) - img.astype(np.float64)) ** 2))
    return 99.0 if mse <= 0 else float(10.0 * np.log10(255.0 ** 2 / mse))


def ssim(ref: np.ndarray, img: np.ndarray, sigma: float = 1.5) -> float:
    """Mean structural similarity over the channels, 11-tap Gaussian window."""
    k = gaussian_taps(sigma, 11)
    c1, c2 = (0.01 * 255.0) ** 2, (0.03 * 255.0) ** 2
    x, y = ref.astype(np.float64), img.astype(np.float64)
    mx, my, xx, yy, xy = (separable(v, k, "mirror") for v in (x, y, x * x, y * y, x * y))
    vx, vy, cxy = xx - mx * mx, yy - my * my, xy - mx * my
    s = ((2 * mx * my + c1) * (2 * cxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2) + EPS)
    return float(s.mean())


def panel(img: np.ndarray, ref: np.ndarray | None) -> dict[str, float]:
    out = no_reference(img)
    out["iqa_psnr"] = psnr(ref, img) if ref is not None else float("nan")
    out["iqa_ssim"] = ssim(ref, img) if ref is not None else float("nan")
    return out
