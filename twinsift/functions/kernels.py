"""Vectorised pixel arithmetic on stacks of equally sized rasters (NumPy only, no Spark)."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import ceil, floor

import numpy as np

from twinsift.schemas import GRID_HEIGHT, GRID_WIDTH, PSNR_CAP

# Rec.601 luma weights, SSIM window and constants, highlight colour.
LUMA = (0.299, 0.587, 0.114)
SSIM_WINDOW = 8
SSIM_C1 = (0.01 * 255.0) * (0.01 * 255.0)
SSIM_C2 = (0.03 * 255.0) * (0.03 * 255.0)
MAGENTA = (255, 0, 255, 255)


def flatten_on_white(rgba: np.ndarray) -> np.ndarray:
    """Blend straight alpha onto white; opaque pixels keep their values. Shape (..., 4) of uint8."""
    alpha = rgba[..., 3:4].astype(np.uint32)
    blend = (rgba[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255
    out = np.empty_like(rgba)
    out[..., :3] = np.where(alpha == 255, rgba[..., :3], blend)
    out[..., 3] = 255
    return out


def to_gray(rgba: np.ndarray) -> np.ndarray:
    r, g, b = (rgba[..., i].astype(np.float64) for i in range(3))
    return np.floor(LUMA[0] * r + LUMA[1] * g + LUMA[2] * b + 0.5).astype(np.uint8)


@lru_cache(maxsize=4096)
def _taps(size: int, target: int) -> tuple[tuple[int, np.ndarray], ...]:
    """Per output cell: first input cell and the normalised float32 weights of a triangle filter."""
    scale = np.float32(size) / np.float32(target)
    reach = max(scale, np.float32(1))
    rows = []
    for cell in range(target):
        centre = (np.float32(cell) + np.float32(0.5)) * scale
        first = min(max(floor(centre - reach), 0), size - 1)
        stop = min(max(ceil(centre + reach), first + 1), size)
        offset = np.arange(first, stop).astype(np.float32) - (centre - np.float32(0.5))
        weight = np.maximum(np.float32(1) - np.abs(offset / reach), np.float32(0))
        total = np.float32(0)
        for w in weight:
            total = np.float32(total + w)
        rows.append((first, (weight / total).astype(np.float32)))
    return tuple(rows)


def _resample(stack: np.ndarray, axis: int, target: int) -> np.ndarray:
    source = np.moveaxis(stack, axis, 0)
    out = np.zeros((target, *source.shape[1:]), dtype=np.float32)
    for cell, (first, weights) in enumerate(_taps(source.shape[0], target)):
        for k, w in enumerate(weights):
            out[cell] += source[first + k] * w
    return np.moveaxis(out, 0, axis)


def shrink_to_grid(stack: np.ndarray) -> np.ndarray:
    """Force (n, h, w, 4) to (n, 8, 9, 4): rows first, then columns, float32, rounded at the end."""
    tall = _resample(stack.astype(np.float32), 1, GRID_HEIGHT)
    grid = _resample(tall, 2, GRID_WIDTH)
    return np.floor(np.clip(grid, 0, 255) + np.float32(0.5)).astype(np.uint8)


def grid_bits(gray: np.ndarray) -> np.ndarray:
    """Difference hashes (int64 bit patterns) of grids of shape (n, 72) or (n, 8, 9)."""
    gray = gray.reshape(-1, GRID_HEIGHT, GRID_WIDTH)
    bits = gray[:, :, :-1] < gray[:, :, 1:]
    packed = np.packbits(bits.reshape(len(gray), -1), axis=1)
    return packed.view(">u8").reshape(-1).astype(np.uint64).view(np.int64)


def dhash(flat: np.ndarray) -> np.ndarray:
    """Difference hashes of a stack (n, h, w, 4) of flattened rasters."""
    return grid_bits(to_gray(shrink_to_grid(flat)))


def sha256_each(rows: np.ndarray) -> list[str]:
    return [hashlib.sha256(np.ascontiguousarray(row)).hexdigest() for row in rows]


def differs(a: np.ndarray, b: np.ndarray, tolerance: int) -> np.ndarray:
    """Mask of pixels where red, green or blue differ by more than the tolerance."""
    gap = np.abs(a[..., :3].astype(np.int16) - b[..., :3].astype(np.int16))
    return (gap > tolerance).any(axis=-1)


def diff_ratio(a: np.ndarray, b: np.ndarray, tolerance: int) -> np.ndarray:
    mask = differs(a, b, tolerance).reshape(len(a), -1)
    if mask.shape[1] == 0:
        return np.zeros(len(a))
    return mask.sum(axis=1) / mask.shape[1]


def squared_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per raster, the exact sum of squared differences of red, green and blue."""
    gap = a[..., :3].astype(np.int64) - b[..., :3].astype(np.int64)
    return (gap * gap).reshape(len(a), -1).sum(axis=1)


def psnr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    samples = a[0, ..., :3].size if len(a) else 0
    if samples == 0:
        return np.full(len(a), PSNR_CAP)
    mse = squared_gaps(a, b).astype(np.float64) / samples
    with np.errstate(divide="ignore"):
        db = 10.0 * np.log10(255.0 * 255.0 / mse)
    return np.where(mse == 0, PSNR_CAP, np.minimum(db, PSNR_CAP))


def _box_sums(values: np.ndarray, wh: int, ww: int) -> np.ndarray:
    """Sums over every full wh x ww window of (n, h, w) integers, by a summed-area table."""
    n, h, w = values.shape
    table = np.zeros((n, h + 1, w + 1), dtype=np.int64)
    table[:, 1:, 1:] = values.cumsum(axis=1).cumsum(axis=2)
    return (
        table[:, wh:, ww:] - table[:, :-wh, ww:] - table[:, wh:, :-ww] + table[:, :-wh, :-ww]
    )


def ssim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean structural similarity of two gray stacks (n, h, w), clamped to 0..1."""
    n, h, w = a.shape
    if h == 0 or w == 0:
        return np.ones(n)
    flat = ssim_windows(a, b).reshape(n, -1)
    # cumsum adds strictly left to right, which fixes the last bit of the mean.
    return np.clip(flat.cumsum(axis=1)[:, -1] / flat.shape[1], 0.0, 1.0)


def ssim_windows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of every window of two gray stacks (n, h, w); one window if a side is shorter than a window."""
    n, h, w = a.shape
    wh, ww = (h, w) if h < SSIM_WINDOW or w < SSIM_WINDOW else (SSIM_WINDOW, SSIM_WINDOW)
    x, y = a.astype(np.int64), b.astype(np.int64)
    area = float(wh * ww)
    mx = _box_sums(x, wh, ww) / area
    my = _box_sums(y, wh, ww) / area
    vx = _box_sums(x * x, wh, ww) / area - mx * mx
    vy = _box_sums(y * y, wh, ww) / area - my * my
    cxy = _box_sums(x * y, wh, ww) / area - mx * my
    return ((2.0 * mx * my + SSIM_C1) * (2.0 * cxy + SSIM_C2)) / (
        (mx * mx + my * my + SSIM_C1) * (vx + vy + SSIM_C2)
    )


def highlight(a: np.ndarray, b: np.ndarray, tolerance: int) -> np.ndarray:
    """Faded gray of ``a`` with differing pixels painted magenta."""
    faded = ((to_gray(a).astype(np.uint32) * 2 + 767) // 5).astype(np.uint8)
    base = np.stack([faded, faded, faded, np.full_like(faded, 255)], axis=-1)
    return np.where(differs(a, b, tolerance)[..., None], np.array(MAGENTA, np.uint8), base)


def reorient(rgba: np.ndarray, orientation: int) -> np.ndarray:
    """Apply an EXIF orientation (1..8) to one (h, w, 4) raster; other values leave it alone."""
    if orientation in (5, 6, 7, 8):
        rgba = np.swapaxes(rgba, 0, 1)
    if orientation in (2, 3, 6, 7):
        rgba = rgba[:, ::-1]
    if orientation in (3, 4, 7, 8):
        rgba = rgba[::-1]
    return np.ascontiguousarray(rgba)


def widest_distance(phashes: np.ndarray) -> int:
    """Greatest pairwise Hamming distance of one bounded set of int64 fingerprints."""
    values = np.asarray(phashes, dtype=np.int64).view(np.uint64)
    best = 0
    for start in range(0, len(values), 512):
        chunk = values[start : start + 512, None] ^ values[None, :]
        best = max(best, int(np.bitwise_count(chunk).max(initial=0)))
    return best



def links_to_few(phashes: np.ndarray, few: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs ``(row, place in few)``: each row with the first and the last of ``few`` within ``threshold`` bits."""
    rows, places = [], []
    for start in range(0, len(phashes), 64):
        part = phashes[start : start + 64].view(np.uint64)
        near = np.bitwise_count(part[:, None] ^ few.view(np.uint64)[None, :]) <= threshold
        row, place = _ends(near)
        rows.append(row + start)
        places.append(place)
    return np.concatenate(rows), np.concatenate(places)


def links_before(phashes: np.ndarray, labels: np.ndarray, lags: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels: each row from place ``lags`` on, with the nearest and the farthest of the ``lags`` rows
    before it that are within ``threshold`` bits and have another label."""
    values = phashes.view(np.uint64)
    around, names = (np.lib.stride_tricks.sliding_window_view(x, lags) for x in (values, labels))
    a, b = [labels[:0]], [labels[:0]]
    for start in range(0, len(values) - lags, 64):
        stop = min(start + 64, len(values) - lags)
        near = np.bitwise_count(around[start:stop] ^ values[start + lags : stop + lags, None]) <= threshold
        near &= names[start:stop] != labels[start + lags : stop + lags, None]
        row, place = _ends(near)
        a.append(labels[start + lags + row])
        b.append(labels[start + row + place])
    return np.concatenate(a), np.concatenate(b)


def _ends(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first and the last set cell of each row that has any."""
    row, place = np.nonzero(near)
    if not len(row):
        return row, place
    turn = row[1:] != row[:-1]
    ends = np.append(True, turn) | np.append(turn, True)
    return row[ends], place[ends]
