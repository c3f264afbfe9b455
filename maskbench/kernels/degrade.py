"""Seeded frame corruptions. ``s`` is the severity scaled to [0, 1]; frames are RGB in [0, 1]."""

from __future__ import annotations

import hashlib
import math

import numpy as np

from .image import EPS, as_unit, box_blur, cubic_axis

# Compound corruptions and the order in which their members apply.
COMPOUNDS = {
    "C1_fog_noise": ("fog", "sensor_noise"),
    "C2_lowlight_blur": ("lowlight", "motion_blur"),
    "C3_rain_snow": ("rain", "snow"),
    "C4_fog_blur_noise": ("fog", "motion_blur", "sensor_noise"),
}


def depth_field(h: int, w: int, cell: float, rng: np.random.Generator) -> np.ndarray:
    """Smooth field in [0, 1]: a coarse random grid, cubically enlarged."""
    cell = max(cell, 1.0)
    gh, gw = (max(2, math.ceil(n / cell) + 1) for n in (h, w))
    coarse = rng.random((gh, gw)).astype(np.float32)
    f = np.clip(cubic_axis(h, gh) @ coarse @ cubic_axis(w, gw).T, 0.0, 1.0)
    return (f - f.min()) / (f.max() - f.min() + EPS)


def scatter(x: np.ndarray, transmission: np.ndarray, light) -> np.ndarray:
    t = transmission[..., None]
    return x * t + light * (1.0 - t)


def fog(x, s, rng):
    h, w = x.shape[:2]
    depth = depth_field(h, w, max(16.0, min(h, w) / 6.0), rng)
    t = np.exp(-(0.6 + 3.4 * s) * (0.15 + 0.85 * depth))
    return np.clip(scatter(x, t, 0.75 + 0.20 * s), 0.0, 1.0)


def lowlight(x, s, rng):
    dark = np.clip(x, 0.0, 1.0) ** (1.0 + 2.4 * s) * (1.0 - 0.35 * s)
    return dark + rng.normal(0.0, 0.02 + 0.06 * s, x.shape)


def _stamp(layer: np.ndarray, ys: np.ndarray, xs: np.ndarray, values: np.ndarray) -> None:
    """Write values in order, later ones over earlier ones; points outside are dropped."""
    ok = (ys >= 0) & (ys < layer.shape[0]) & (xs >= 0) & (xs < layer.shape[1])
    layer[ys[ok], xs[ok]] = values[ok]


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and position of every element when the i-th owner has ``lengths[i]`` elements."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def draw_rows(rng: np.random.Generator, n: int, columns: list[tuple[int, int] | None]) -> np.ndarray:
    """n rows of draws, column after column: whole numbers of [low, high), or random numbers of [0, 1) for None.

    The values are those of ``rng.integers(low, high)`` and ``rng.random()`` called one by one, taken from the generator's raw
    words: a random number takes a word, a whole number half of one. For use as the last draws of a generator.
    """
    start = rng.bit_generator.state
    width = np.array([1 if c is None else c[1] - c[0] for c in columns], np.uint64)
    half = np.array([c is not None and c[1] - c[0] > 1 for c in columns])
    used = np.array([c is None for c in columns]) | half
    halves, kept = np.tile(half[used], n), np.flatnonzero(used)
    nth = np.cumsum(halves) - 1
    new = ~halves | (nth % 2 == 0)
    at = np.cumsum(new) - 1
    second = np.flatnonzero(~new)
    at[second] = at[np.flatnonzero(halves)[nth[second] - 1]]
    words = rng.bit_generator.random_raw(int(new.sum()))[at].reshape(n, len(kept))
    later = ~new.reshape(n, len(kept))
    out = np.empty((n, len(columns)))
    safe = not start["has_uint32"] and start["bit_generator"] == "PCG64"
    for i, c in enumerate(columns):
        if not used[i]:
            out[:, i] = c[0]
            continue
        k = int(np.searchsorted(kept, i))
        w = words[:, k]
        if c is None:
            out[:, i] = (w >> np.uint64(11)) * (1.0 / (1 << 53))
            continue
        scaled = np.where(later[:, k], w >> np.uint64(32), w & np.uint64(0xFFFFFFFF)) * width[i]
        # the generator draws again where the low half is small: rare, so such rows are drawn one by one
        safe = safe and not (scaled & np.uint64(0xFFFFFFFF) < np.uint64(((1 << 32) - int(width[i])) % int(width[i]))).any()
        out[:, i] = c[0] + (scaled >> np.uint64(32))
    if safe:
        return out
    rng.bit_generator.state = start
    return np.array([[rng.random() if c is None else rng.integers(*c) for c in columns] for _ in range(n)], float)


def rain(x, s, rng):
    h, w = x.shape[:2]
    veil = fog(x, s / 2.0, rng) if s > 0.2 else x
    layer = np.zeros((h, w))
    length, thick = int(8 + 26 * s), max(1, int(1 + 2 * s))
    drawn = draw_rows(rng, int(20 + 320 * s), [(0, w), (0, h), None, None])
    px, py, value = drawn[:, 0], drawn[:, 1], 0.5 + 0.5 * drawn[:, 3]
    angle = np.radians(-25.0 + 50.0 * drawn[:, 2])
    dx, dy = np.trunc(length * np.sin(angle)), np.trunc(length * np.cos(angle))
    steps = np.maximum(np.maximum(np.abs(dx), np.abs(dy)), 1).astype(int)
    k, at = _runs(steps + 1)
    t = at / steps[k]
    ys, xs = np.rint(py[k] + t * dy[k]).astype(int), np.rint(px[k] + t * dx[k]).astype(int)
    across = (xs[:, None] + np.arange(thick) - thick // 2).ravel()
    _stamp(layer, np.repeat(ys, thick), across, np.repeat(value[k], thick))
    drops = np.clip(box_blur(layer, 3), 0.0, 1.0)[..., None]
    return 1.0 - (1.0 - veil) * (1.0 - 0.7 * drops)


def snow(x, s, rng):
    h, w = x.shape[:2]
    veil = fog(x, 0.375 * s, rng)
    layer = np.zeros((h, w))
    largest = max(1, int(1 + 3 * s))
    drawn = draw_rows(rng, int(60 + 600 * s), [(0, w), (0, h), (1, largest + 1), None])
    px, py, r = drawn[:, :3].astype(int).T
    gy, gx = np.mgrid[-largest:largest + 1, -largest:largest + 1]
    gy, gx = gy.ravel(), gx.ravel()
    inside = gy * gy + gx * gx <= (r * r + r // 2)[:, None]
    k, j = np.nonzero(inside)
    _stamp(layer, py[k] + gy[j], px[k] + gx[j], 0.6 + 0.4 * drawn[k, 3])
    flakes = np.clip(box_blur(layer, 3), 0.0, 1.0)[..., None]
    return veil * (1.0 - 0.35 * flakes) + flakes


def line_kernel(size: int, degrees: float) -> np.ndarray:
    """A horizontal line of the given size, turned about its centre with linear sampling."""
    a, mid = math.radians(degrees), size / 2.0 - 0.5
    gy, gx = np.mgrid[0:size, 0:size] - mid
    sx, sy = math.cos(a) * gx - math.sin(a) * gy + mid, math.sin(a) * gx + math.cos(a) * gy + mid
    across = np.clip(1.0 - np.abs(sy - size // 2), 0.0, 1.0)
    along = np.clip(np.minimum(sx + 1.0, size - sx), 0.0, 1.0)
    k = across * along
    return k / (k.sum() + EPS)


def motion_blur(x, s, rng):
    size = int(3 + 24 * s)
    k = line_kernel(size, rng.random() * 180.0)
    lead = size // 2
    p = np.pad(x, ((lead, size - lead), (lead, size - lead), (0, 0)), mode="edge")
    h, w = x.shape[:2]
    return sum(k[j, i] * p[j:j + h, i:i + w] for j, i in zip(*np.nonzero(k > 1e-9)))


def sensor_noise(x, s, rng):
    sigma = 0.01 + 0.09 * s
    out = x + rng.normal(0.0, sigma, x.shape)
    chroma = [rng.normal(0.0, 0.3 * sigma, x.shape[:2]) for _ in range(3)]
    return out + np.stack(chroma, axis=-1)


def underwater(x, s, rng):
    h, w = x.shape[:2]
    loss = np.array([0.35 + 1.60 * s, 0.18 + 0.90 * s, 0.08 + 0.35 * s])
    glow = np.array([0.10, 0.28, 0.34]) * (0.25 + 0.85 * s)
    depth = depth_field(h, w, max(20.0, min(h, w) / 5.0), rng)
    return scatter(x * np.exp(-loss), np.exp(-(0.4 + 2.2 * s) * depth), glow)


def dust(x, s, rng):
    tint = np.array([1.0 + 0.18 * s, 1.0 + 0.06 * s, 1.0 - 0.28 * s])
    out = fog(x, 0.45 * s, rng) * tint
    return out + 0.30 * s * (out.mean(axis=2, keepdims=True) - out)


SINGLES = {f.__name__: f for f in (fog, lowlight, rain, snow, motion_blur, sensor_noise,
                                   underwater, dust)}


def scaled_severity(level: float) -> float:
    return (min(max(float(level), 1.0), 5.0) - 1.0) / 4.0


def name_hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def degrade(img: np.ndarray, name: str, level: float, seed: int, stream: int) -> np.ndarray:
    """Corrupt a frame. The generator depends on (seed, stream) only; each member of a compound
    owns a sub-stream, so adding a member does not disturb the others."""
    x = as_unit(img)
    if name == "clean":
        return x
    s, root = scaled_severity(level), int(seed) * 1_000_003
    if name in COMPOUNDS:
        for member in COMPOUNDS[name]:
            rng = np.random.default_rng(root + int(stream) * 97 + name_hash(member) % 9973)
            x = np.clip(SINGLES[member](x, s, rng), 0.0, 1.0).astype(np.float32)
        return x
    rng = np.random.default_rng(root + int(stream))
    return np.clip(SINGLES[name](x, s, rng), 0.0, 1.0).astype(np.float32)


def schedule_phase(seed: int) -> float:
    return float(np.random.default_rng(int(seed) * 7919 + 13).random() * 2.0 * np.pi)
