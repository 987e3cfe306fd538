"""Keeping a hash index: what can be reused, what must be hashed, what is gone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators.group import prune_pixel_hash
from twinsift.operators.storage import stage
from twinsift.schemas import HASH_ALGO, HASH_INDEX_SCHEMA, RECORD_COLUMNS

_KEY = ["path", "size", "mtime_ns"]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index table as written, all versions of each path. Missing folders read as empty."""
    try:
        found = spark.read.schema(HASH_INDEX_SCHEMA).option("recursiveFileLookup", True).parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], HASH_INDEX_SCHEMA)
    return found


# What decides whether an entry is still valid, and which of two entries is newer.
_CHECKED = ["size", "mtime_ns", "hash_algo"]
_NEWER = ["indexed_at", "mtime_ns", "size", "hash_algo"]


def latest(index: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Newest entry per path. An aggregate, so repeats are folded before the shuffle.

    ``columns`` (all by default) are the ones to carry. Entries equal in all of ``_NEWER`` differ in
    hashes at most, so the hash breaks ties only where hashes are asked for.
    """
    rest = [c for c in (index.columns if columns is None else columns) if c != "path"]
    order = F.struct(*_NEWER, *[c for c in ("sha256",) if c in rest])
    newest = index.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("_e"))
    return newest.select("path", *[F.col(f"_e.{c}").alias(c) for c in rest])


def _usable(index: DataFrame, hash_algo: str, columns: list[str] | None = None) -> DataFrame:
    return latest(index, columns).where(F.col("hash_algo") == hash_algo)


def cache_hits(listing: DataFrame, index: DataFrame, hash_algo: str = HASH_ALGO) -> DataFrame:
    """Index entries that are still valid: same path, size, modification time and algorithm."""
    return _usable(index, hash_algo).join(listing.select(*_KEY), _KEY, "left_semi")


def cache_misses(listing: DataFrame, index: DataFrame, hash_algo: str = HASH_ALGO) -> DataFrame:
    """Listed items without a valid entry. ``listing`` carries metadata only, never content."""
    return listing.join(_usable(index, hash_algo, _CHECKED).select(*_KEY), _KEY, "left_anti")


def orphans(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries whose path is no longer listed. None when the listing is empty (a failed listing)."""
    newest = latest(index)
    if listing.isEmpty():
        return newest.limit(0)
    return newest.join(listing.select("path"), "path", "left_anti")


def collect_garbage(index: DataFrame, listing: DataFrame) -> DataFrame:
    """The index without orphans; all of it when the listing is empty (a failed listing)."""
    newest = latest(index)
    return newest if listing.isEmpty() else newest.join(listing.select("path"), "path", "left_semi")


def to_entries(records: DataFrame, keys: DataFrame, hash_algo: str = HASH_ALGO) -> DataFrame:
    """Index rows for fresh records; ``keys`` gives size and modification time per path."""
    stamp = F.unix_micros(F.current_timestamp())
    return (
        records.join(keys.select(*_KEY), "path")
        .withColumn("hash_algo", F.lit(hash_algo))
        .withColumn("indexed_at", stamp)
        .select(*HASH_INDEX_SCHEMA.fieldNames())
    )


def to_records(entries: DataFrame) -> DataFrame:
    return entries.withColumnRenamed("size", "bytes").select(*RECORD_COLUMNS)


@dataclass
class Indexed:
    """``records`` of all readable items (pixel hashes pruned) and the ``skipped`` ones with a reason."""

    records: DataFrame
    skipped: DataFrame
    unpruned: DataFrame


def index(hashed: DataFrame, prune: bool = True) -> Indexed:
    """Split hashed rows into records and skipped items.

    ``hashed`` has the record columns and ``error`` (null where reading worked). Lookups use
    ``unpruned``: a query may equal a pixel hash that no second record shares. Pruning reads the rows
    more than once, so they are written first: every item is read and hashed once.
    """
    if prune:
        hashed = stage(hashed.select(*RECORD_COLUMNS, "error"), "hashed")
    good = hashed.where(F.col("error").isNull()).select(*RECORD_COLUMNS)
    skipped = hashed.where(F.col("error").isNotNull()).select("path", F.col("error").alias("reason"))
    return Indexed(prune_pixel_hash(good) if prune else good, skipped, good)


def refresh(
    listing: DataFrame,
    index_path: str,
    hash_items: Callable[[DataFrame], DataFrame],
    hash_algo: str = HASH_ALGO,
) -> Indexed:
    """Hash what the index does not know yet, append it, and return the records of the listing.

    ``listing(path, size, mtime_ns)`` holds metadata only. ``hash_items`` gets the misses and returns
    hashed rows; failures are not written, so the next run tries them again.
    """
    spark = listing.sparkSession
    known = read_index(spark, index_path)
    misses = cache_misses(listing, known, hash_algo)
    fresh = stage(hash_items(misses), "fresh")
    good = fresh.where(F.col("error").isNull())
    if not good.isEmpty():
        to_entries(good.select(*RECORD_COLUMNS), listing, hash_algo).write.mode("append").parquet(index_path)
    hits = cache_hits(listing, read_index(spark, index_path), hash_algo)
    records = to_records(hits)
    skipped = fresh.where(F.col("error").isNotNull()).select("path", F.col("error").alias("reason"))
    return Indexed(prune_pixel_hash(records), skipped, records)
