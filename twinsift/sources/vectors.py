"""Vector adapter: numbers in [-1, 1] become raster bytes.

The content hash covers the numbers as they are, the pixel hash the rounded bytes: vectors that round
to the same raster share pixels but not content. A vector that no raster can stand for (null, empty, or
with an entry that is null, not a number or outside [-1, 1]) has an ``error`` and no raster, so that it
is listed as skipped and never shares pixels with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.raster import raster_hashes
from twinsift.schemas import RECORD_COLUMNS

NO_VECTOR = "no vector"
NOT_IN_RANGE = "entries outside [-1, 1]"


def vector_bytes(vector: Column | str) -> Column:
    """Array of 0..255: ``floor((v + 1) * 127.5)`` kept inside the byte range. See :func:`vector_error`."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(
        vector,
        lambda v: F.least(F.greatest(F.floor((v.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int"),
    )


def vector_error(vector: Column | str) -> Column:
    """Why a vector has no raster; null where it has one."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    inside = lambda v: F.coalesce(F.abs(v.cast("double")) <= 1, F.lit(False))
    missing = vector.isNull() | (F.size(vector) == 0)
    return F.when(missing, NO_VECTOR).when(~F.forall(vector, inside), NOT_IN_RANGE)


def exact_text(vector: Column | str) -> Column:
    """A text that two arrays of floats or doubles share only if all their numbers are equal.

    Multiplying by a power of two is exact, so three whole parts hold every bit of a number in range.
    """
    vector = F.col(vector) if isinstance(vector, str) else vector

    def parts(v: Column) -> Column:
        x = v.cast("double")
        a = x * 2.0**50
        b = (a - F.floor(a)) * 2.0**60
        c = (b - F.floor(b)) * 2.0**60
        exact = F.concat_ws(":", F.floor(a), F.floor(b), F.floor(c))
        return F.when(F.abs(x) <= 4096, exact).otherwise(F.coalesce(x.cast("string"), F.lit("null")))

    return F.array_join(F.transform(vector, parts), ",")


def _pack(values: Column) -> Column:
    """Array of 0..255 -> bytes."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def gray_rgba(values: Column) -> Column:
    """Opaque RGBA bytes of a gray array."""
    pixel = lambda v: F.concat(F.repeat(F.lpad(F.hex(v), 2, "0"), 3), F.lit("FF"))
    return F.unhex(F.array_join(F.transform(values, pixel), ""))


def vector_rasters(
    df: DataFrame, path: Column, vector: str = "embedding", channels: int = 1,
    width: Column | int = 8, height: Column | int = 8,
) -> DataFrame:
    """``(path, width, height, bytes, sha256, rgba, error)`` of a table of vectors.

    ``channels=1`` reads each value as an opaque gray pixel; ``channels=4`` reads four values as one
    RGBA pixel. A row with an ``error`` has no ``rgba``. Built-in expressions only.
    """
    if channels not in (1, 4):
        raise ValueError("channels must be 1 or 4")
    values = vector_bytes(vector)
    as_col = lambda v: F.lit(v) if isinstance(v, int) else v
    raw = _pack(F.col("_values"))
    error = vector_error(vector)
    return (
        df.withColumn("_values", values)
        .select(
            path.alias("path"),
            as_col(width).cast("int").alias("width"),
            as_col(height).cast("int").alias("height"),
            F.greatest(F.size("_values"), F.lit(0)).cast("bigint").alias("bytes"),
            F.sha2(F.coalesce(exact_text(vector), F.lit("")), 256).alias("sha256"),
            F.when(error.isNull(), gray_rgba(F.col("_values")) if channels == 1 else raw).alias("rgba"),
            error.alias("error"),
        )
    )


def hashed_vectors(df: DataFrame, path: Column, vector: str = "embedding", **options) -> DataFrame:
    """Hashed rows of a table of vectors: the record columns and ``error``, for ``index``."""
    rasters = vector_rasters(df, path, vector, **options)
    hashed = rasters.withColumn("format", F.lit("vector")).withColumn("_h", raster_hashes("rgba", "width", "height"))
    hashed = hashed.withColumn("pixel_sha256", F.col("_h.pixel_sha256")).withColumn("phash", F.col("_h.phash"))
    return hashed.select(*RECORD_COLUMNS, "error")
