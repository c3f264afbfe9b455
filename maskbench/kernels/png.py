"""PNG label maps and frames of 8 bits or less a sample, without interlacing, read and written as stacks."""

from __future__ import annotations

import struct
import zlib
from typing import Sequence

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1}     # fixed values: grey, colour, palette
STACK = 1 << 22                   # samples whose prediction is undone together


def _inflate(data: bytes) -> tuple[int, int, int, int, np.ndarray]:
    """(height, width, depth, channels, rows with their leading filter byte)."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        if name == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif name == b"IDAT":
            body.append(data[at + 8:at + 8 + size])
        at += size + 12
    if head is None or head[3] not in CHANNELS or head[2] > 8 or head[6] or (head[3] == 2 and head[2] != 8):
        raise ValueError("expected a grey, palette or 24-bit PNG of at most 8 bits a sample without interlacing")
    w, h, depth, colour = head[:4]
    stride = (w * depth * CHANNELS[colour] + 7) // 8
    return h, w, depth, CHANNELS[colour], np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, stride + 1)


def _unpredict_simple(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The same where rows are predicted from the left or from above only: running sums, which bytes wrap as they have to."""
    out = rows.copy()
    left, up = kinds == 1, kinds == 2
    if left.any():
        out[np.nonzero(left)[0], :, np.nonzero(left)[1]] = np.cumsum(
            rows[np.nonzero(left)[0], :, np.nonzero(left)[1]], axis=1, dtype=np.uint8)
    if up.all(axis=0)[up.any(axis=0)].all():                       # images predicted from above in all their rows
        some = up.any(axis=0)
        out[:, :, some] = np.cumsum(rows[:, :, some], axis=0, dtype=np.uint8)
    else:
        for y in np.flatnonzero(up.any(axis=1)):
            if y:
                out[y][:, up[y]] += out[y - 1][:, up[y]]
    return out


def unpredict(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples of a stack of images from their differences.

    ``kinds`` is (height, images), ``rows`` (height, width, images, channels). A sample depends on its left,
    upper and upper left neighbours, so all samples of one anti-diagonal, of all images, are found at once.
    """
    if not kinds.any():
        return rows
    if kinds.max() <= 2:
        return _unpredict_simple(kinds, rows)
    h, w = rows.shape[:2]
    out = np.zeros((h + 1, w + 1, *rows.shape[2:]), np.int16)
    by_row = kinds[:, :, None]
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h - 1, d) + 1)
        x = d - y
        left, up, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], by_row[y]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.where(kind == 1, left, np.where(kind == 2, up, np.where(kind == 3, (left + up) >> 1, np.where(kind == 4, nearest, 0))))
        out[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def read_png(files: Sequence[bytes]) -> list[np.ndarray]:
    """Samples of each file, (height, width) or (height, width, 3); files of one shape are treated as a stack."""
    parts = [_inflate(bytes(f)) for f in files]
    shapes: dict[tuple, list[int]] = {}
    for i, p in enumerate(parts):
        shapes.setdefault(p[:4], []).append(i)
    out: list[np.ndarray] = [None] * len(parts)
    stacks = [(shape, some) for shape, members in shapes.items() for simple in (True, False)
              if (some := [i for i in members if (parts[i][4][:, :1].max(initial=0) <= 2) == simple])]
    for (h, w, depth, ch), members in stacks:
        step = max(1, STACK // max(1, h * w * ch))
        for lo in range(0, len(members), step):
            some = members[lo:lo + step]
            raw = np.stack([parts[i][4] for i in some], axis=1)                     # (h, images, 1 + stride)
            px = raw[:, :, 1:].reshape(h, len(some), -1, ch).transpose(0, 2, 1, 3)
            px = unpredict(raw[:, :, 0], px)
            for k, i in enumerate(some):
                one = px[:, :, k]
                if depth < 8:
                    bits = np.unpackbits(one[..., 0], axis=1)[:, :w * depth].reshape(h, w, depth)
                    one = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]
                out[i] = np.ascontiguousarray(one[..., 0] if ch == 1 else one)
    return out


def write_png(a: np.ndarray, kind: int = 0, palette: bool = False) -> bytes:
    """A file of (height, width) or (height, width, 3) bytes; ``kind`` is the prediction of all rows, 0 to 2."""
    if kind not in (0, 1, 2):
        raise ValueError("rows are written with prediction 0, 1 or 2")
    h, w = a.shape[:2]
    before = np.zeros_like(a)
    if kind == 1:
        before[:, 1:] = a[:, :-1]
    elif kind == 2:
        before[1:] = a[:-1]
    rows = np.concatenate([np.full((h, 1), kind, np.uint8), (a - before).reshape(h, -1)], axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    colour = 2 if a.ndim == 3 else 3 if palette else 0
    return (MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", bytes(range(256)) * 3) if palette else b"")
            + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b""))
