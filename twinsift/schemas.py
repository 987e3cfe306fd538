"""Constants and fixed schemas shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the record format (part of the published contract).
SCHEMA_VERSION = 1
HASH_ALGO = "dhash-1"
HASH_BITS = 64
GRID_WIDTH = 9
GRID_HEIGHT = 8
GRID_CELLS = GRID_WIDTH * GRID_HEIGHT
DEFAULT_THRESHOLD = 10
PSNR_CAP = 100.0
# Extensions indexed by default, and those the browser front end adds.
DEFAULT_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "heic", "heif", "avif")
EXTRA_EXTENSIONS = ("tif", "svg")
FORMAT_ALIASES = {"jpg": "jpeg", "tif": "tiff"}

STRICTNESS = ("exact", "pixel", "perceptual")

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("bytes", T.LongType(), False),
        T.StructField("width", T.IntegerType(), False),
        T.StructField("height", T.IntegerType(), False),
        T.StructField("format", T.StringType(), False),
        T.StructField("sha256", T.StringType(), False),
        T.StructField("pixel_sha256", T.StringType(), True),
        T.StructField("phash", T.LongType(), True),
    ]
)
RECORD_COLUMNS = RECORD_SCHEMA.fieldNames()

SKIPPED_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("reason", T.StringType(), False),
    ]
)

HASH_INDEX_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("mtime_ns", T.LongType(), False),
        T.StructField("hash_algo", T.StringType(), False),
        T.StructField("sha256", T.StringType(), False),
        T.StructField("pixel_sha256", T.StringType(), True),
        T.StructField("phash", T.LongType(), True),
        T.StructField("width", T.IntegerType(), False),
        T.StructField("height", T.IntegerType(), False),
        T.StructField("format", T.StringType(), False),
        T.StructField("indexed_at", T.LongType(), False),
    ]
)

RASTER_HASH_SCHEMA = T.StructType(
    [
        T.StructField("pixel_sha256", T.StringType(), True),
        T.StructField("phash", T.LongType(), True),
    ]
)

SCORE_SCHEMA = T.StructType(
    [
        T.StructField("pixel_diff_ratio", T.DoubleType(), True),
        T.StructField("ssim", T.DoubleType(), True),
        T.StructField("psnr", T.DoubleType(), True),
        T.StructField("highlight", T.BinaryType(), True),
        T.StructField("strict_ratio", T.DoubleType(), True),
    ]
)

# Sums over one strip of a pair; those of all strips give the scores of the pair.
STRIP_SCHEMA = T.StructType(
    [
        T.StructField("differing", T.LongType(), True),
        T.StructField("unequal", T.LongType(), True),
        T.StructField("squares", T.LongType(), True),
        T.StructField("ssim_sum", T.DoubleType(), True),
        T.StructField("highlight", T.BinaryType(), True),
    ]
)


def check_strictness(name: str) -> str:
    if name not in STRICTNESS:
        raise ValueError(f"unknown strictness {name!r}; use one of {', '.join(STRICTNESS)}")
    return name
