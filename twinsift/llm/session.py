"""What the jobs of this package need from a session, and small helpers they share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.cluster import small_batches


def prepare(spark: SparkSession) -> None:
    """Session settings of all jobs here: UTC, adaptive execution and batches that fit small workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    small_batches(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def string(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hash_share(key: Column, rows: int, total: int) -> Column:
    """A condition that keeps about one and a half times ``rows`` of ``total`` rows, picked by the hash of ``key``.

    Sorting what is left and taking ``rows`` then gives a sample without moving the whole table.
    """
    cells = 1 << 40
    return F.pmod(F.xxhash64(key), F.lit(cells)) < min(cells, int(1.5 * cells * rows / max(total, 1)) + 1)


def give_back() -> None:
    """Return free memory to the system at the end of a task, as idle workers stay for later ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], list], added: list[T.StructField]) -> DataFrame:
    """Append columns computed from each Arrow batch of ``df``. A narrow step: no row moves.

    ``function`` returns the new columns' arrays, in the order of ``added``.
    """
    schema = T.StructType(df.schema.fields + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                arrays = list(batch.columns) + list(function(batch))
                names = batch.schema.names + [field.name for field in added]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    return df.mapInArrow(run, schema)
