"""Rasters of 8-bit RGB: portable pixmaps, antialiased resizing and centre crops, in numpy."""

from __future__ import annotations

import functools
import math
import re

import numpy as np

_HEAD = re.compile(rb"P6\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", re.S)


def pixmap(x: np.ndarray) -> bytes:
    """A binary portable pixmap of a height x width x 3 raster."""
    return b"P6\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + np.ascontiguousarray(x, np.uint8).tobytes()


def raster(data: bytes) -> np.ndarray:
    """The raster of a binary portable pixmap of 8 bits; anything else, or a short one, raises."""
    head = _HEAD.match(data)
    if head is None or head[3] != b"255":
        raise ValueError("no 8-bit pixmap")
    w, h = int(head[1]), int(head[2])
    if not w or not h or len(data) < head.end() + 3 * w * h:
        raise ValueError("the pixmap is short")
    return np.frombuffer(data, np.uint8, 3 * w * h, head.end()).reshape(h, w, 3)


def cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * (x**3 - 5 * x**2 + 8 * x - 4), 0.0))


@functools.lru_cache(maxsize=256)
def weights(size: int, to: int, first: int = 0, n: int | None = None) -> np.ndarray:
    """(n, size): the weight of every old place in n of the `to` new ones from `first` on (all, if not given);
    where a side shrinks the kernel widens by the same factor, so that no old place is passed over."""
    scale = size / to
    wide = max(scale, 1.0)
    centre = (np.arange(first, to if n is None else first + n) + 0.5) * scale
    w = cubic((np.arange(size) + 0.5 - centre[:, None]) / wide)
    # A kernel reaches two places to either side, of the widened ones.
    lo, hi = np.floor(centre - 2 * wide + 0.5), np.floor(centre + 2 * wide + 0.5)
    at = np.arange(size)
    w = np.where((at >= lo[:, None]) & (at < hi[:, None]), w, 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(x: np.ndarray, width: int, height: int, left: int = 0, top: int = 0, size: int | None = None) -> np.ndarray:
    """Bicubic with antialiasing, rows first, each of the two passes rounded to 8 bits; with `size` only the
    size x size window at (left, top) is made."""
    h, w = x.shape[:2]
    across, down = size or width, size or height
    if w == width:
        x = x[:, left : left + across].astype(np.float64)
    else:
        y = weights(w, width, left, across) @ x.transpose(1, 0, 2).reshape(w, -1).astype(np.float64)
        x = np.clip(np.floor(y + 0.5), 0, 255).reshape(across, h, 3).transpose(1, 0, 2)
    if h == height:
        return x[top : top + down].astype(np.uint8)
    y = weights(h, height, top, down) @ x.reshape(h, -1)
    y += 0.5
    np.clip(y, 0, 255, out=y)
    return y.astype(np.uint8).reshape(down, across, 3)  # which cuts what follows the point


def geometry(width: int, height: int, size: int) -> tuple[int, int, int, int]:
    """(width, height) with the shorter side at `size`, and the crop's corner, halves to the even one."""
    short, long = sorted((width, height))
    other = int(size * long / short)
    w, h = (size, other) if width <= height else (other, size)
    return w, h, round((w - size) / 2), round((h - size) / 2)


def crop(data: bytes, size: int) -> bytes:
    """The size x size x 3 bytes of the middle of a pixmap, its shorter side resized to `size`."""
    x = raster(data)
    w, h, left, top = geometry(x.shape[1], x.shape[0], size)
    return resized(x, w, h, left, top, size).tobytes()
