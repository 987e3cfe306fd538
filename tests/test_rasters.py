"""Pixel arithmetic: published expectations, through DataFrames."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift.functions import kernels
from twinsift.functions.bits import dhash9x8, hamming, hamming_hex, phash_from_hex, phash_hex, signed64
from twinsift.functions.raster import flatten_on_white, pair_scores, raster_hashes, reorient, to_gray
from twinsift.operators.compare import compare_pairs, with_raster_hashes

ONES = (1 << 64) - 1


def noise_bytes(count):
    """Fixed generator: state = state * 1664525 + 1013904223 (mod 2^32), top byte, seed 0x9E3779B9."""
    state, out = 0x9E3779B9, np.empty(count, np.uint8)
    for i in range(count):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i] = state >> 24
    return out


def raster(w, h, *planes):
    """RGBA bytes from functions of x and y (or plain numbers), each taken modulo 256."""
    y, x = np.mgrid[0:h, 0:w]
    stack = [np.broadcast_to(np.asarray(p(x, y) if callable(p) else p), (h, w)) for p in planes]
    return (np.stack(stack, axis=-1).astype(np.int64) % 256).astype(np.uint8)


def gray(w, h, f, alpha=255):
    return raster(w, h, f, f, f, alpha)


def published_rasters():
    ramp = lambda x, y: (x + y) * 255 // 175
    ring = lambda x, y: np.minimum(np.sqrt((x - 31.0) ** 2 + (y - 31.0) ** 2) * 5.0, 255.0).astype(int)
    wave = lambda x, y: np.array([int((math.sin(i * 0.3) * 0.5 + 0.5) * 255.0) for i in range(128)])[x]
    return {
        "diag-100x77": raster(100, 77, ramp, lambda x, y: ramp(x, y) + 40, lambda x, y: 255 - ramp(x, y), 200),
        "radial-63x63": raster(63, 63, ring, 128, lambda x, y: 255 - ring(x, y), 255),
        "ripple-128x40": gray(128, 40, wave),
        "checker-90x80": gray(90, 80, lambda x, y: np.where((x // 7 + y // 7) % 2 == 0, 230, 25)),
        "noise-70x50": noise_bytes(70 * 50 * 4).reshape(50, 70, 4),
        "exact-9x8": gray(9, 8, lambda x, y: (x * 8 + y) * 3),
    }


def published_pairs():
    g = lambda x, y: (x * 4 + y * 3) % 256
    base = raster(64, 48, g, lambda x, y: g(x, y) + 17, lambda x, y: g(x, y) + 90, 255)
    shifted = base.reshape(-1, 4).copy()
    shifted[::37, 0] += 23
    shifted[::37, 2] -= 11
    inverted = base.copy()
    inverted[..., :3] = 255 - inverted[..., :3]
    return {"same": (base, base), "shifted": (base, shifted.reshape(base.shape)), "inverted": (base, inverted)}


def fold(raw):
    acc = 0
    for byte in raw:
        acc = (acc * 31 + byte) & 0xFFFFFFFF
    return f"{acc:08x}"


# Published difference hash, byte fold and SHA-256 of each flattened raster.
RASTERS = {
    "diag-100x77": (
        "fffffffffffefcf8", "b4dbf87e", "c72e0b22578bd66dc34565a55631e27c8d3a9b4b7cceb5f5d98ad475d17744b7"),
    "radial-63x63": (
        "0f0f0f0f0f0f0f0f", "29e25660", "0cf38ae8139fffbfc3ee22e79f5014966d7182d69b91272a36dd7741d5b34016"),
    "ripple-128x40": (
        "2424242424242424", "0d41c250", "b68688f4b76ad911788e054fb77f1073b9090b2ade7aeabd2f8ee322cca59f81"),
    "checker-90x80": (
        "3232c80032c8cc32", "d0b76c54", "9e114fe0a59db92e35d8bcd2e1e04facb0d586d2260303d64d2cc31cb7a7d557"),
    "noise-70x50": (
        "a5a72d05a9bd69d9", "4fb12c38", "31e5849177c379f8d549d1616f0399bded0b6406104aaaad5f79c4dfdf5b6456"),
    "exact-9x8": (
        "ffffffffffffffff", "44dde0c4", "f026368aaffc3ea78a27563c12e71f51856745952a4315840a8a203de0b4cc28"),
}
# Published bit patterns of difference ratio, SSIM and PSNR, and the highlight's fold.
PAIRS = {
    "same": ("0000000000000000", "3ff0000000000000", "4059000000000000", "7dbcbac0"),
    "shifted": ("3f9c000000000000", "3fefa20f3bbc5724", "403d8d4ed840525e", "fcdcf159"),
    "inverted": ("3ff0000000000000", "0000000000000000", "4012f2fa5882a58f", "70710c00"),
}


def frame(spark, rasters):
    rows = [(k, bytearray(v.tobytes()), v.shape[1], v.shape[0]) for k, v in rasters.items()]
    return spark.createDataFrame(rows, "path string, rgba binary, width int, height int")


def test_published_rasters(spark):
    df = frame(spark, published_rasters()).repartition(2)
    got = df.select(
        "path", flatten_on_white("rgba").alias("flat"), raster_hashes("rgba", "width", "height").alias("h")
    ).collect()
    found = {r.path: (f"{r.h.phash & ONES:016x}", fold(r.flat), r.h.pixel_sha256) for r in got}
    assert found == RASTERS


def test_published_scores(spark):
    rows = [(k, bytearray(a.tobytes()), bytearray(b.tobytes()), 64, 48) for k, (a, b) in published_pairs().items()]
    df = spark.createDataFrame(rows, "name string, a binary, b binary, w int, h int")
    got = df.select("name", pair_scores("a", "b", "w", "h", 0, True).alias("s")).collect()
    bits = lambda v: struct.pack(">d", v).hex()
    found = {
        r.name: (bits(r.s.pixel_diff_ratio), bits(r.s.ssim), bits(r.s.psnr), fold(r.s.highlight)) for r in got
    }
    assert found == PAIRS


def test_hash_is_scale_invariant_and_flat_is_zero(spark):
    ramp = lambda w: lambda x, y: x * 255 // (w - 1)
    df = frame(spark, {"s": gray(90, 80, ramp(90)), "l": gray(900, 800, ramp(900)), "flat": gray(16, 16, 128)})
    got = {r.path: r.h.phash for r in df.select("path", raster_hashes("rgba", "width", "height").alias("h")).collect()}
    assert got == {"s": -1, "l": -1, "flat": 0}


def test_unsound_raster_hashes_to_zero(spark):
    rows = [("empty", bytearray(), 0, 0), ("short", bytearray([0, 0, 0, 255]), 2, 2), ("none", None, 1, 1)]
    df = spark.createDataFrame(rows, "path string, rgba binary, width int, height int")
    got = df.select(raster_hashes("rgba", "width", "height").alias("h")).collect()
    assert [(r.h.phash, r.h.pixel_sha256) for r in got] == [(0, None)] * 3


def test_pixel_hash_ignores_dimensions(spark):
    raw = np.random.default_rng(3).integers(0, 256, 128).astype(np.uint8)
    raw[3::4] = 255
    df = frame(spark, {f"{w}x{h}": raw.reshape(h, w, 4) for w, h in ((8, 4), (4, 8), (16, 2))})
    got = [r.h for r in df.select(raster_hashes("rgba", "width", "height").alias("h")).collect()]
    assert len({h.pixel_sha256 for h in got}) == 1
    assert len({h.phash for h in got}) == 3


def test_gray_and_flatten(spark):
    rows = [
        (bytearray([255, 255, 255, 255, 0, 0, 0, 255, 255, 0, 0, 255]),),
        (bytearray([10, 20, 30, 255, 10, 20, 30, 0, 0, 0, 0, 128]),),
    ]
    df = spark.createDataFrame(rows, "rgba binary")
    a, b = df.select(to_gray("rgba").alias("g"), flatten_on_white("rgba").alias("f")).collect()
    assert list(a.g) == [255, 0, 76]
    assert list(b.f) == [10, 20, 30, 255, 255, 255, 255, 255, 127, 127, 127, 255]


def test_gray_value_survives_equal_channels():
    v = np.arange(256, dtype=np.uint8)
    assert (kernels.to_gray(np.stack([v, v, v, v], axis=-1)) == v).all()


def stack(*pixels):
    return np.array([[pixels]], dtype=np.uint8)


def test_ratio_and_highlight_tolerance_is_strict():
    a, b = stack([100, 0, 0, 255]), stack([105, 0, 0, 255])
    assert (kernels.diff_ratio(a, b, 5)[0], kernels.diff_ratio(a, b, 4)[0]) == (0.0, 1.0)
    assert list(kernels.highlight(a, b, 4)[0, 0, 0]) == [255, 0, 255, 255]
    assert list(kernels.highlight(a, b, 5)[0, 0, 0]) != [255, 0, 255, 255]
    a, b = stack([10, 20, 30, 255], [40, 50, 60, 255]), stack([10, 20, 30, 255], [99, 50, 60, 255])
    shown = kernels.highlight(a, b, 0)[0, 0]
    assert list(shown[1]) == [255, 0, 255, 255] and list(shown[0]) != [255, 0, 255, 255]
    white_black = stack([255, 255, 255, 255], [0, 0, 0, 255])
    assert kernels.highlight(white_black, white_black, 0)[0, 0].tolist() == [[255] * 4, [153, 153, 153, 255]]


def test_magenta_area_equals_ratio():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (3, 9, 11, 4)).astype(np.uint8)
    b = np.where(rng.random((3, 9, 11, 1)) < 0.5, a, a + 9).astype(np.uint8)
    shown = kernels.highlight(a, b, 8)
    magenta = (shown == np.array([255, 0, 255, 255])).all(axis=-1).reshape(3, -1).sum(axis=1)
    assert (magenta == np.round(kernels.diff_ratio(a, b, 8) * 99)).all()


def test_psnr_cases():
    a = np.full((1, 2, 4, 4), 100, np.uint8)
    assert kernels.psnr(a, a)[0] == 100.0
    assert abs(kernels.psnr(a, a + 1)[0] - 48.1311) < 1e-3
    b = a.copy()
    b[..., 3] = 0
    assert kernels.psnr(a, b)[0] == 100.0
    empty = np.zeros((1, 0, 0, 4), np.uint8)
    assert kernels.psnr(empty, empty)[0] == 100.0
    assert kernels.diff_ratio(empty, empty, 0)[0] == 0.0


def test_ssim_cases():
    g = (np.arange(256).reshape(1, 16, 16) % 256).astype(np.uint8)
    assert abs(kernels.ssim(g, g)[0] - 1) < 1e-9
    assert kernels.ssim(np.zeros((1, 16, 16), np.uint8), np.full((1, 16, 16), 255, np.uint8))[0] < 1e-3
    y, x = np.mgrid[0:8, 0:8]
    board = (((x + y) % 2) * 255).astype(np.uint8)[None]
    assert kernels.ssim(board, 255 - board)[0] == 0.0
    tiny = np.array([[[1, 200, 3]]], np.uint8)
    assert abs(kernels.ssim(tiny, tiny)[0] - 1) < 1e-12
    assert kernels.ssim(np.zeros((1, 0, 0), np.uint8), np.zeros((1, 0, 0), np.uint8))[0] == 1.0


def test_ssim_equals_direct_windows():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 256, (1, 13, 10)).astype(np.uint8)
    b = rng.integers(0, 256, (1, 13, 10)).astype(np.uint8)
    scores = []
    for y in range(6):
        for x in range(3):
            p = a[0, y : y + 8, x : x + 8].astype(float)
            q = b[0, y : y + 8, x : x + 8].astype(float)
            cov = (p * q).mean() - p.mean() * q.mean()
            top = (2 * p.mean() * q.mean() + 6.5025) * (2 * cov + 58.5225)
            scores.append(top / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (p.var() + q.var() + 58.5225)))
    assert abs(kernels.ssim(a, b)[0] - max(0, np.mean(scores))) < 1e-12


def test_grid_bits_three_ways(spark):
    rng = random.Random(1)
    grids = [[i % 9 for i in range(72)], [8 - i % 9 for i in range(72)], [0] + [1] * 8 + [0] * 63]
    grids += [[rng.randrange(4) for _ in range(72)] for _ in range(20)]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "i int, g array<int>")
    got = [r.h for r in df.select("i", dhash9x8("g").alias("h")).orderBy("i").collect()]
    assert got[:3] == [-1, 0, signed64(1 << 63)]
    assert got == kernels.grid_bits(np.array(grids, np.uint8)).tolist()


def test_hex_forms(spark):
    values = [0, 1, 1 << 63, ONES, 0x0123456789ABCDEF]
    df = spark.createDataFrame([(signed64(v),) for v in values], "h long")
    rows = df.select("h", phash_hex("h").alias("x"), phash_from_hex(phash_hex("h")).alias("back")).collect()
    assert [r.x for r in rows] == [f"{v:016x}" for v in values]
    assert all(r.h == r.back for r in rows)
    texts = ["zzz", "", "+", "-1", "+F", "00000000000000000000ff", "1" * 17, "Ab", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(phash_from_hex("t")).collect()]
    assert got == [None, None, None, None, 15, 255, None, 0xAB, None]


def test_hamming(spark):
    df = spark.createDataFrame([(0, 0), (0, -1), (0b1011, 0b0010)], "a long, b long")
    assert [r[0] for r in df.select(hamming("a", "b")).collect()] == [0, 64, 2]
    df = spark.createDataFrame([("f", "0"), ("x", "0")], "a string, b string")
    assert [r[0] for r in df.select(hamming_hex("a", "b")).collect()] == [4, None]


@pytest.mark.parametrize("code,corner", [(1, 0), (2, 2), (3, 5), (4, 3), (5, 0), (6, 3), (7, 5), (8, 2)])
def test_orientation(spark, code, corner):
    pixels = np.zeros((2, 3, 4), np.uint8)
    pixels[..., 0] = np.arange(6).reshape(2, 3)
    df = spark.createDataFrame([(bytearray(pixels.tobytes()), 3, 2, code)], "p binary, w int, h int, o int")
    out = df.select(reorient("p", "w", "h", "o")).first()[0]
    assert out[0] == corner and len(out) == 24


@pytest.mark.parametrize("strip_pixels", [1, 300, 900])
def test_strips_give_the_scores_of_whole_rasters(spark, strip_pixels):
    rng = np.random.default_rng(4)
    big = rng.integers(0, 256, (50, 37, 4)).astype(np.uint8)
    near = big.copy()
    near[20:31, 5:9, 1] ^= 3
    rasters = {"a": big, "b": near, "c": rng.integers(0, 256, (50, 37, 4)).astype(np.uint8), "d": big.copy()}
    rasters |= {"flat": big[:4], "flat2": near[20:24], "e": big[:16, :16], "f": near[16:32, :16]}
    df = with_raster_hashes(frame(spark, rasters)).withColumn("sha256", F.concat(F.lit("sha-"), "path"))
    df = df.withColumn("rgba", F.when(F.col("path") == "f", F.lit(b"1234")).otherwise(F.col("rgba")))
    asked = [("a", "b"), ("a", "c"), ("a", "b"), ("a", "d"), ("flat", "flat2"), ("e", "f"), ("a", "e")]
    pairs = spark.createDataFrame(asked, "a string, b string")
    rows = lambda **options: sorted(compare_pairs(pairs, df, 2, True, "ratio", **options).collect())
    whole, strips, once = rows(), rows(strip_pixels=strip_pixels, hot_rows=1), rows(in_one_pass=True)
    assert len(whole) == len(asked) and [r.ssim for r in whole if (r.a, r.b) == ("e", "f")] == [None]
    assert whole == once
    for x, y in zip(whole, strips):
        x, y = x.asDict(), y.asDict()
        pairs_of = [(x.pop(name), y.pop(name)) for name in ("ssim", "psnr")]
        assert all(p is q is None or abs(p - q) < 1e-11 for p, q in pairs_of) and x == y


def test_compare_pairs(spark):
    same, other = gray(8, 8, lambda x, y: x * 20), gray(8, 8, lambda x, y: x * 20 + (y == 0) * 9)
    rasters = {"a": same, "b": other, "c": gray(16, 4, 7), "d": same.copy()}
    df = with_raster_hashes(frame(spark, rasters)).withColumn("sha256", F.concat(F.lit("sha-"), "path"))
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "a")], "a string, b string")
    for hot_rows in (1, 100):
        got = {(r.a, r.b): r for r in compare_pairs(pairs, df, 0, True, hot_rows=hot_rows).collect()}
        assert [got["a", k].verdict for k in "abcd"] == ["identical", "near_identical", "incomparable", "same_pixels"]
        far = got["a", "c"]
        assert (far.comparable, far.pixel_equal, far.pixel_diff_ratio, far.ssim, far.psnr, far.highlight) == (
            False, None, None, None, None, None)
        assert far.hamming is not None and far.sha_equal is False
        near = got["a", "b"]
        assert (near.pixel_equal, near.pixel_diff_ratio) == (False, 0.125)
    by_ratio = {(r.a, r.b): r for r in compare_pairs(pairs, df, 20, pixel_equal_by="ratio").collect()}
    assert by_ratio["a", "b"].pixel_equal is False and by_ratio["a", "b"].pixel_diff_ratio == 0.0
    assert by_ratio["a", "d"].pixel_equal is True
    with pytest.raises(ValueError):
        compare_pairs(pairs, df, 300)
