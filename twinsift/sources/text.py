"""Text adapter: any table of texts becomes records with a 9x8 token raster.

Each token falls into one of 72 cells by hash; a cell's gray value is its token count, scaled to the
fullest cell where that holds over 255. The cells only serve the fingerprint. The pixel hash decides
what a clean-up removes, so it covers the tokens themselves, in order: texts share it only if they
are equal up to the number of spaces between tokens and around them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.functions import kernels
from twinsift.schemas import GRID_CELLS

# Tokens and strings of so many bytes of text are held at once, however many rows a batch brings.
SLICE_BYTES = 1 << 20

_OUT = T.StructType(
    [
        T.StructField("gray", T.BinaryType()),
        T.StructField("pixel_sha256", T.StringType()),
        T.StructField("phash", T.LongType()),
    ]
)


def _cells(tokens: pa.Array) -> np.ndarray:
    """Cell of each token; every distinct token of the batch is hashed once."""
    coded = pc.dictionary_encode(tokens)
    words = pc.cast(coded.dictionary, pa.binary()).to_pylist()
    digests = b"".join([hashlib.md5(word).digest() for word in words])
    # The first 8 hex digits of each digest, as a number.
    cell = np.frombuffer(digests, dtype=">u4")[::4].astype(np.int64) % GRID_CELLS
    return cell[coded.indices.to_numpy(zero_copy_only=False)]


def slices(text: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """``text`` in runs of rows of about ``most`` bytes together; a longer row is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield text.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


@F.arrow_udf(_OUT)
def _text_raster(text: pa.Array) -> pa.Array:
    parts = [_raster_slice(part) for part in slices(text)]
    return pa.concat_arrays(parts) if parts else _raster_slice(text)


def _raster_slice(text: pa.Array) -> pa.Array:
    rows = len(text)
    lists = pc.split_pattern(pc.fill_null(text, ""), " ")
    tokens = pc.list_flatten(lists)
    owner = pc.list_parent_indices(lists)
    real = pc.not_equal(tokens, "")
    tokens, owner = tokens.filter(real), owner.filter(real).to_numpy(zero_copy_only=False)
    counts = np.bincount(owner * GRID_CELLS + _cells(tokens), minlength=rows * GRID_CELLS)
    counts = counts.reshape(rows, GRID_CELLS)
    most = counts.max(axis=1, keepdims=True, initial=0)
    gray = np.where(most > 255, counts * 255 // np.maximum(most, 1), counts).astype(np.uint8)
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=rows))).astype(np.int32)
    single = pc.binary_join(pa.ListArray.from_arrays(ends, tokens), pa.scalar(" ", tokens.type))
    digests = [hashlib.sha256(row).hexdigest() for row in pc.cast(single, pa.binary()).to_pylist()]
    phash = kernels.grid_bits(gray) if rows else np.array([], dtype=np.int64)
    return pa.StructArray.from_arrays(
        [
            pa.array([row.tobytes() for row in gray], type=pa.binary()),
            pa.array(digests, type=pa.string()),
            pa.array(phash, type=pa.int64()),
        ],
        names=["gray", "pixel_sha256", "phash"],
    )


def text_raster(text: Column | str) -> Column:
    """Struct (gray, pixel_sha256, phash) of a text."""
    return _text_raster(text)


def hashed_texts(
    df: DataFrame,
    path: Column,
    text: str = "text",
    width: Column | None = None,
    format: str = "txt",
    with_gray: bool = False,
) -> DataFrame:
    """Hashed rows of a table of texts: width in characters, height 1, size in UTF-8 bytes, ``error``.

    A row without a text has an ``error``, so ``index`` lists it as skipped. One narrow pass: no shuffle,
    and only the text and the columns in ``path`` and ``width`` are read.
    """
    missing = F.col(text).isNull()
    width = F.char_length(text) if width is None else width
    raster = text_raster(F.col(text))
    out = df.select(
        path.alias("path"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"),
        F.when(missing, 0).otherwise(width).cast("int").alias("width"),
        F.lit(1).alias("height"),
        F.lit(format).alias("format"),
        # Never null here; saying so spares later not-null filters from hashing a second time.
        F.coalesce(F.sha2(text, 256), F.lit("")).alias("sha256"),
        raster.alias("_raster"),
        F.when(missing, "no text").alias("error"),
    )
    fields = ["path", "bytes", "width", "height", "format", "sha256"]
    fields += [F.col("_raster.pixel_sha256"), F.col("_raster.phash")]
    if with_gray:
        fields.append(F.col("_raster.gray"))
    return out.select(*fields, "error")


def text_records(df: DataFrame, path: Column, text: str = "text", **options) -> DataFrame:
    """Records of the rows that have a text; see :func:`hashed_texts` for those that have none."""
    return hashed_texts(df.where(F.col(text).isNotNull()), path, text, **options).drop("error")


def balanced(df: DataFrame) -> DataFrame:
    """Spread a table over all cores if its scan has fewer splits than there are cores.

    Only a table below ``cores`` splits qualifies, so the shuffle is small by construction; a table
    with more splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
