"""From 64x64 grey frames to 64 coefficients, in numpy."""

from __future__ import annotations

import numpy as np

from twinreel.constants import HASH_BITS, LEAST_ENERGY

SIDE, THUMB, KEEP = 64, 16, 8
#: A row or column moves if some pixel's variance over time is above this; fewer than LEAST_SPAN moving ones are no picture.
MOVING, LEAST_SPAN = 2.0, 16


def scale(frame: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A grey frame of any size as side x side bytes, by area."""
    h, w = frame.shape
    out = _area(0, h, side, h) @ frame.astype(np.float32) @ _area(0, w, side, w).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _area(first: int, length: int, cells: int, whole: int) -> np.ndarray:
    """(cells, whole): the share of each source pixel in each cell, for `length` pixels from `first`."""
    edge = np.arange(cells + 1, dtype=np.float32) * np.float32(length / cells)
    at = np.arange(length, dtype=np.float32)
    lap = np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None)
    out = np.zeros((cells, whole), np.float32)
    out[:, first : first + length] = lap / np.maximum(lap.sum(1, keepdims=True), np.float32(1e-12))
    return out


def moving_area(frames: np.ndarray) -> tuple[int, int, int, int]:
    """(top, height, left, width) of the part of (n, 64, 64) frames that changes; the whole if too little does."""
    variance = frames.astype(np.float64).var(axis=0)
    found = []
    for line in (variance.max(axis=1), variance.max(axis=0)):
        at = np.flatnonzero(line > MOVING)
        if not len(at) or at[-1] - at[0] + 1 < LEAST_SPAN:
            found += [0, SIDE]
            continue
        lo, hi = int(at[0]), int(at[-1]) + 1
        lo, hi = lo + (lo > 0), hi - (hi < SIDE)
        found += [lo, hi - lo]
    return tuple(found)


def basis() -> np.ndarray:
    k, x = np.arange(KEEP, dtype=np.float32)[:, None], np.arange(THUMB, dtype=np.float32)[None, :]
    return np.cos(np.float32(np.pi) * (2 * x + 1) * k / (2 * THUMB)).astype(np.float32)


def coefficients(frames: np.ndarray) -> np.ndarray:
    """(n, 64): the low-frequency cosine block of each frame's moving area, the mean level set to zero."""
    top, height, left, width = moving_area(frames)
    rows, cols, b = _area(top, height, THUMB, SIDE), _area(left, width, THUMB, SIDE), basis()
    out = np.einsum("kr,nrc,lc->nkl", b @ rows, frames.astype(np.float32), b @ cols).astype(np.float32).reshape(len(frames), HASH_BITS)
    out[:, 0] = 0
    return out


def hashes(block: np.ndarray) -> np.ndarray:
    """Signed 64-bit median hashes of (n, 64) coefficients."""
    s = np.sort(block, axis=1)
    bits = block > ((s[:, HASH_BITS // 2 - 1] + s[:, HASH_BITS // 2]) / 2)[:, None]
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def featureless(block: np.ndarray) -> np.ndarray:
    return np.abs(block).mean(axis=1) < LEAST_ENERGY
