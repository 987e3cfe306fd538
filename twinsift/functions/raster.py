"""Arrow-batched column functions over RGBA rasters (``BINARY`` plus width and height).

Rows of a batch that share dimensions are stacked and handled by one NumPy call.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.functions import kernels
from twinsift.schemas import RASTER_HASH_SCHEMA, SCORE_SCHEMA, STRIP_SCHEMA

# Pixels stacked into one NumPy call; larger stacks only cost memory.
_STACK_PIXELS = 1 << 20


def _stacks(*shapes: tuple[int, int]) -> Iterator[tuple[tuple[int, int], list[int]]]:
    """Batches of row numbers that share (width, height), bounded in pixels."""
    by_shape: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, shape in enumerate(shapes):
        if shape is not None:
            by_shape[shape].append(i)
    for (w, h), rows in by_shape.items():
        step = max(1, _STACK_PIXELS // max(1, w * h))
        for start in range(0, len(rows), step):
            yield (w, h), rows[start : start + step]


def _shape(raw, width, height) -> tuple[int, int] | None:
    """(w, h) of a sound raster, else None."""
    if raw is None or pd.isna(width) or pd.isna(height):
        return None
    w, h = int(width), int(height)
    return (w, h) if w > 0 and h > 0 and len(raw) == w * h * 4 else None


def _stack(column: pd.Series, rows: list[int], w: int, h: int) -> np.ndarray:
    joined = b"".join(column.iat[i] for i in rows)
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(rows), h, w, 4)


@F.pandas_udf(T.BinaryType())
def _flatten(rgba: pd.Series) -> pd.Series:
    return rgba.map(
        lambda raw: None
        if raw is None
        else kernels.flatten_on_white(np.frombuffer(raw, np.uint8).reshape(-1, 4)).tobytes()
    )


@F.pandas_udf(T.BinaryType())
def _gray(rgba: pd.Series) -> pd.Series:
    return rgba.map(
        lambda raw: None
        if raw is None
        else kernels.to_gray(np.frombuffer(raw, np.uint8).reshape(-1, 4)).tobytes()
    )


@F.pandas_udf(RASTER_HASH_SCHEMA)
def _hashes(rgba: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    shapes = [_shape(r, w, h) for r, w, h in zip(rgba, width, height)]
    sha: list[str | None] = [None] * len(rgba)
    bits = np.zeros(len(rgba), dtype=np.int64)
    for (w, h), rows in _stacks(*shapes):
        flat = kernels.flatten_on_white(_stack(rgba, rows, w, h))
        bits[rows] = kernels.dhash(flat)
        for i, digest in zip(rows, kernels.sha256_each(flat)):
            sha[i] = digest
    return pd.DataFrame({"pixel_sha256": pd.Series(sha, dtype=object), "phash": bits})


def _scorer(tolerance: int, with_highlight: bool):
    @F.pandas_udf(SCORE_SCHEMA)
    def scores(
        a: pd.Series, b: pd.Series, width: pd.Series, height: pd.Series
    ) -> pd.DataFrame:
        shapes = [
            sa if sa is not None and sa == _shape(y, w, h) else None
            for sa, y, w, h in (
                (_shape(x, w, h), y, w, h) for x, y, w, h in zip(a, b, width, height)
            )
        ]
        out = {name: [None] * len(a) for name in SCORE_SCHEMA.fieldNames()}
        for (w, h), rows in _stacks(*shapes):
            fa = kernels.flatten_on_white(_stack(a, rows, w, h))
            fb = kernels.flatten_on_white(_stack(b, rows, w, h))
            ratio = kernels.diff_ratio(fa, fb, tolerance)
            ssim = kernels.ssim(kernels.to_gray(fa), kernels.to_gray(fb))
            strict = kernels.diff_ratio(fa, fb, 0) if tolerance else ratio
            psnr = kernels.psnr(fa, fb)
            shown = kernels.highlight(fa, fb, tolerance) if with_highlight else None
            for k, i in enumerate(rows):
                out["pixel_diff_ratio"][i] = float(ratio[k])
                out["ssim"][i] = float(ssim[k])
                out["psnr"][i] = float(psnr[k])
                out["strict_ratio"][i] = float(strict[k])
                if shown is not None:
                    out["highlight"][i] = shown[k].tobytes()
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in out.items()})

    return scores


def _strip_scorer(tolerance: int, with_highlight: bool):
    @F.pandas_udf(STRIP_SCHEMA)
    def sums(a: pd.Series, b: pd.Series, width: pd.Series, own: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y, w, n in zip(a, b, width, own):
            fa, fb = (kernels.flatten_on_white(np.frombuffer(raw, np.uint8).reshape(1, -1, w, 4)) for raw in (x, y))
            # Windows reach into the rows of the next strip; all other sums cover a strip's own rows.
            tall = fa.shape[1] >= kernels.SSIM_WINDOW
            ssim = kernels.ssim_windows(kernels.to_gray(fa), kernels.to_gray(fb)).sum() if tall else 0.0
            fa, fb = fa[:, :n], fb[:, :n]
            unequal, differing = (int(kernels.differs(fa, fb, t).sum()) for t in (0, tolerance))
            shown = kernels.highlight(fa, fb, tolerance).tobytes() if with_highlight else None
            rows.append((differing, unequal, int(kernels.squared_gaps(fa, fb)[0]), float(ssim), shown))
        return pd.DataFrame(rows, columns=STRIP_SCHEMA.fieldNames())

    return sums


@F.pandas_udf(T.BinaryType())
def _reorient(
    rgba: pd.Series, width: pd.Series, height: pd.Series, orientation: pd.Series
) -> pd.Series:
    def one(raw, w, h, o):
        if _shape(raw, w, h) is None or pd.isna(o):
            return raw
        pixels = np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 4)
        return kernels.reorient(pixels, int(o)).tobytes()

    return pd.Series([one(*row) for row in zip(rgba, width, height, orientation)], dtype=object)


def flatten_on_white(rgba: Column | str) -> Column:
    """Straight-alpha RGBA blended onto white, alpha set to 255."""
    return _flatten(rgba)


def to_gray(rgba: Column | str) -> Column:
    """Rec.601 gray, one byte per pixel."""
    return _gray(rgba)


def raster_hashes(rgba: Column | str, width: Column | str, height: Column | str) -> Column:
    """Struct (pixel_sha256, phash) of the flattened raster.

    The pixel hash covers bytes only, not dimensions. A raster of zero size or wrong length has
    fingerprint 0 and no pixel hash.
    """
    return _hashes(rgba, width, height)


def pair_scores(
    a: Column | str, b: Column | str, width: Column | str, height: Column | str,
    tolerance: int = 0, with_highlight: bool = False,
) -> Column:
    """Struct (pixel_diff_ratio, ssim, psnr, highlight, strict_ratio) of two rasters of the same dimensions.

    ``strict_ratio`` is the difference ratio at tolerance zero.
    """
    return _scorer(_checked(tolerance), with_highlight)(a, b, width, height)


def strip_sums(
    a: Column | str, b: Column | str, width: Column | str, own: Column | str,
    tolerance: int = 0, with_highlight: bool = False,
) -> Column:
    """Sums over one strip of two rasters: its ``own`` rows, and up to seven rows of the next strip for the windows."""
    return _strip_scorer(_checked(tolerance), with_highlight)(a, b, width, own)


def _checked(tolerance: int) -> int:
    if not 0 <= tolerance <= 255:
        raise ValueError("tolerance must lie in 0..255")
    return tolerance


def reorient(
    rgba: Column | str, width: Column | str, height: Column | str, orientation: Column | str
) -> Column:
    """RGBA with an EXIF orientation applied; for 5..8 the caller swaps width and height."""
    return _reorient(rgba, width, height, orientation)
