"""Classical restoration filters: RGB frames in [0, 1] to RGB frames in [0, 1]."""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np

from .image import EPS, as_bytes, as_unit, border_index, box_blur, gaussian_blur, local_min, stretch

# Linear RGB to XYZ for the D65 white point.
TO_XYZ = np.array([[0.412453, 0.357580, 0.180423],
                   [0.212671, 0.715160, 0.072169],
                   [0.019334, 0.119193, 0.950227]])
WHITE = TO_XYZ.sum(axis=1)


def power(x, exponent):
    return np.clip(x, 0.0, 1.0) ** exponent


def to_lab(x: np.ndarray) -> np.ndarray:
    return _linear_to_lab(_linear(x))


def _linear(x: np.ndarray) -> np.ndarray:
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)


LINEAR_BYTES = _linear(as_unit(np.arange(256, dtype=np.uint8)))


def _linear_to_lab(lin: np.ndarray) -> np.ndarray:
    t = lin @ TO_XYZ.T / WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16.0 / 116.0)
    return np.stack([116.0 * f[..., 1] - 16.0, 500.0 * (f[..., 0] - f[..., 1]),
                     200.0 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16.0) / 116.0
    f = np.stack([fy + lab[..., 1] / 500.0, fy, fy - lab[..., 2] / 200.0], axis=-1)
    t = np.where(f > 0.206893, f ** 3, (f - 16.0 / 116.0) / 7.787)
    lin = np.clip((t * WHITE) @ np.linalg.inv(TO_XYZ).T, 0.0, 1.0)
    return np.where(lin <= 0.0031308, lin * 12.92, 1.055 * lin ** (1 / 2.4) - 0.055)


def _spare_below() -> np.ndarray:
    """For 0 to 255 spare counts, dealt to evenly spaced bins, how many lie in each bin and below."""
    spare, bins = np.arange(256)[:, None], np.arange(256)
    step = np.maximum(256 // np.maximum(spare, 1), 1)
    return np.cumsum((bins % step == 0) & (bins // step < spare), -1, dtype=np.int32)


BINS, SPARE_BELOW = np.arange(1, 257, dtype=np.int32), _spare_below()


def equalise_tiles(plane: np.ndarray, limit: float, tiles: int) -> np.ndarray:
    """Contrast-limited equalisation of an 8-bit plane with bilinear blending of tile curves."""
    h, w = plane.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    iy, ix = (border_index(np.arange(n * tiles), m, "mirror101") for n, m in ((th, h), (tw, w)))
    big = plane[np.ix_(iy, ix)].reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3)
    area = th * tw
    cap = max(1, int(limit * area / 256))
    cells = np.arange(tiles * tiles)[:, None] * 256 + big.reshape(tiles * tiles, area)
    hist = np.bincount(cells.ravel(), minlength=tiles * tiles * 256).astype(np.int32).reshape(tiles, tiles, 256)
    kept = np.minimum(hist, cap)
    excess = area - kept.sum(-1, dtype=np.int32)
    below = np.cumsum(kept, -1, dtype=np.int32) + (excess // 256)[..., None] * BINS + SPARE_BELOW[excess % 256]
    scaled = lambda n: np.clip(np.rint(n * (255.0 / area)), 0, 255)
    few = 4 * h * w < below.size          # of a small frame only the values in use are scaled
    curve = below if few else scaled(below)

    def blend(n, size):
        p = np.arange(n) / size - 0.5
        k = np.floor(p).astype(int)
        return np.clip(k, 0, tiles - 1), np.clip(k + 1, 0, tiles - 1), p - k

    y0, y1, fy = blend(h, th)
    x0, x1, fx = blend(w, tw)
    used = lambda a, b: curve[a[:, None], b[None, :], plane]
    at = (lambda a, b: scaled(used(a, b))) if few else used
    top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
    low = at(y1, x0) * (1 - fx) + at(y1, x1) * fx
    return np.rint(top * (1 - fy)[:, None] + low * fy[:, None])


def clahe(x, limit=2.0, tiles=8):
    lab = _linear_to_lab(LINEAR_BYTES[as_bytes(x)])
    plane = np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(np.uint8)
    lab[..., 0] = equalise_tiles(plane, limit, tiles) / 2.55
    return from_lab(lab)


def airlight(x, haze, share=0.001):
    """Mean colour of the haziest pixels: the brightest thousandth of the dark channel."""
    cut = np.partition(haze.ravel(), k := int(np.ceil((haze.size - 1) * (1.0 - share))))[k]
    return np.maximum(x[haze >= cut].mean(axis=0), 0.40)


def dehaze(x, omega=0.85, floor=0.15, radius=7):
    """Inversion of I = J t + A (1 - t), with t from the dark channel of the frame."""
    haze = local_min(x.min(axis=-1), radius)
    air = airlight(x, haze)
    passed = np.maximum(box_blur(1.0 - omega * haze, max(3, radius)), floor)
    return air - (air - x) / passed[:, :, None]


def retinex(x, sigmas=(15.0, 80.0, 250.0)):
    logs = [np.log(np.clip(gaussian_blur(x, s), EPS, 1.0)) for s in sigmas]
    return stretch(np.log(np.clip(x, EPS, 1.0)) - sum(logs) / len(logs))


def gray_world(x):
    """Scale each channel so that all have one mean, then the frame so that its largest value is 1."""
    gain = 1.0 / (np.mean(x, axis=(0, 1)) + EPS)
    return x * (gain / max((np.amax(x, axis=(0, 1)) * gain).max(), EPS))


def unsharp(x, strength=0.8, sigma=1.2):
    return x + strength * (x - gaussian_blur(x, sigma))


@lru_cache(maxsize=16)
def bilateral_weights(r: int, colour: float, space: float) -> list[tuple[int, int, np.ndarray]]:
    """Places of a disc, each with the weights of all sums of three whole differences."""
    gaps = np.arange(3 * 255 + 1.0) ** 2 / (2 * colour ** 2)
    return [(dy, dx, np.exp(-(dy * dy + dx * dx) / (2 * space ** 2) - gaps))
            for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def bilateral(x, size=7, colour=40.0, space=40.0):
    u = as_bytes(x).astype(np.int16)
    r, (h, w) = size // 2, u.shape[:2]
    iy, ix = (border_index(np.arange(-r, n + r), n, "mirror101") for n in (h, w))
    p = u[np.ix_(iy, ix)]
    wide = p.astype(float)
    acc, total = np.zeros(u.shape), np.zeros((h, w, 1))
    for dy, dx, weight in bilateral_weights(r, colour, space):
        off = np.abs(p[r + dy:r + dy + h, r + dx:r + dx + w] - u)
        k = weight.take(off[..., 0] + off[..., 1] + off[..., 2])[..., None]
        acc += k * wide[r + dy:r + dy + h, r + dx:r + dx + w]
        total += k
    return np.rint(acc / total) / 255.0


# The bank in its order, with filter parameters and target family.
BANK = (
    ("id", "identity", lambda x: x),
    ("gamma_lo", "lowlight", partial(power, exponent=0.60)),
    ("gamma_hi", "fog", partial(power, exponent=1.60)),
    ("gamma_xhi", "fog", partial(power, exponent=2.20)),
    ("clahe", "lowlight", clahe),
    ("hist", "generic", stretch),
    ("dcp", "fog", dehaze),
    ("dcp_strong", "fog", partial(dehaze, omega=0.95, floor=0.08, radius=11)),
    ("msr", "lowlight", retinex),
    ("grayworld", "generic", gray_world),
    ("unsharp", "blur", unsharp),
    ("unsharp_hi", "blur", partial(unsharp, strength=1.6, sigma=2.0)),
    ("bilateral", "noise", bilateral),
)
NAMES = tuple(n for n, _, _ in BANK)
FILTERS = {n: f for n, _, f in BANK}


def restore(img: np.ndarray, name: str) -> np.ndarray:
    return np.clip(FILTERS[name](np.clip(as_unit(img), 0.0, 1.0)), 0.0, 1.0).astype(np.float32)
