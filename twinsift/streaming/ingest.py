"""Resumable incremental indexing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinsift.functions.paths import plain_uri, relative_path
from twinsift.operators.index import cache_misses, read_index
from twinsift.operators.storage import stage, stage_measured
from twinsift.schemas import DEFAULT_EXTENSIONS, HASH_ALGO, HASH_INDEX_SCHEMA, RECORD_COLUMNS
from twinsift.sources.images import extension_glob, hash_files, hash_listed, list_images, root_uri

_OFFER = "path string, size bigint, mtime_ns bigint, attempt int, offered_at bigint"


def index_stream(
    stream: DataFrame,
    hash_batch: Callable[[DataFrame], DataFrame],
    index_path: str,
    retry_path: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Append each micro-batch of new items to the hash index.

    ``hash_batch`` turns a batch into hashed rows that also carry ``size`` and ``mtime_ns``. A batch
    owns one folder and overwrites it, so a batch that is run again after a crash leaves no
    repeats. Items that fail are not indexed; they go to ``retry_path``, because a file source does
    not offer a file twice. :func:`offer` brings failed and changed items back into a stream of offers; rows
    of such a stream carry their ``offered_at``.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        hashed = stage(hash_batch(batch), "stream-batch")
        good = hashed.where(F.col("error").isNull()).select(*RECORD_COLUMNS, "size", "mtime_ns")
        entries = good.withColumn("hash_algo", F.lit(HASH_ALGO)).withColumn(
            "indexed_at", F.unix_micros(F.current_timestamp())
        )
        folder = f"batch={batch_id:012d}"
        entries.select(*HASH_INDEX_SCHEMA.fieldNames()).write.mode("overwrite").parquet(f"{index_path}/{folder}")
        failed = hashed.where(F.col("error").isNotNull())
        at = F.col("offered_at") if "offered_at" in failed.columns else F.lit(None).cast("bigint")
        failed.select("path", F.col("error").alias("reason"), at.alias("offered_at")).write.mode("overwrite").parquet(
            f"{retry_path}/{folder}"
        )

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def open_retries(spark: SparkSession, retry_path: str, index_path: str) -> DataFrame:
    """``(path, reason)`` of failed items that no index entry has settled since, one row per path.

    Joined to a listing they are what a batch run hashes again; entries it appends settle them.
    """
    failed = _read_or_empty(spark, retry_path, "path string, reason string")
    once = failed.groupBy("path").agg(F.max("reason").alias("reason"))
    return once.join(read_index(spark, index_path).select("path").distinct(), "path", "left_anti")


def offer(listing: DataFrame, offers_path: str, retry_path: str, index_path: str, attempts: int = 3) -> DataFrame:
    """Append to the table of offers what a stream should index now, and return those rows.

    ``listing`` has ``path``, ``size`` and ``mtime_ns``; other columns (a ``uri``) travel along. Of the items that the
    index does not know in this version, those are due that were never offered, that were offered in another version
    last (*changed* in place, or put back), or whose last offer failed, until a version had ``attempts`` offers. An
    offer that waits to be read is not repeated. A stream that reads the offers meets each once, which a stream
    over the files themselves cannot do: it knows paths only.
    """
    spark = listing.sparkSession
    state = F.struct("size", "mtime_ns", "attempt", "offered_at")
    last = _read_or_empty(spark, offers_path, _OFFER).groupBy("path").agg(F.max_by(state, "offered_at").alias("_last"))
    failed = _read_or_empty(spark, retry_path, "path string, offered_at bigint").distinct()
    failed = failed.select("path", F.col("offered_at").alias("_failed"))
    misses = cache_misses(listing, read_index(spark, index_path)).join(last, "path", "left")
    misses = misses.withColumn("_at", F.col("_last.offered_at"))
    misses = misses.join(failed, (misses["path"] == failed["path"]) & (misses["_at"] == failed["_failed"]), "left").drop(failed["path"])
    same = (F.col("size") == F.col("_last.size")) & (F.col("mtime_ns") == F.col("_last.mtime_ns"))
    again = same & F.col("_failed").isNotNull() & (F.col("_last.attempt") < attempts)
    attempt = F.when(F.coalesce(same, F.lit(False)), F.col("_last.attempt") + 1).otherwise(1).cast("int")
    due = misses.where(F.col("_last").isNull() | ~same | again).select(
        *listing.columns, attempt.alias("attempt"), F.unix_micros(F.current_timestamp()).alias("offered_at")
    )
    due, seen = stage_measured(due, "offers", rows=F.count(F.lit(1)))
    if seen["rows"]:
        due.write.mode("append").parquet(offers_path)
    return due


def offered(spark: SparkSession, offers_path: str, extra: str = "", files_per_batch: int = 100) -> DataFrame:
    """The offers as a stream; ``extra`` are the DDL fields that the listing has besides."""
    fields = _OFFER + (f", {extra}" if extra else "")
    return spark.readStream.schema(fields).option("maxFilesPerTrigger", files_per_batch).parquet(offers_path)


def last_offers(batch: DataFrame) -> DataFrame:
    """One row per path of a batch of offers: the last one, which is what the store holds."""
    rest = [c for c in batch.columns if c != "path"]
    last = batch.groupBy("path").agg(F.max_by(F.struct(*rest), "offered_at").alias("_o"))
    return last.select("path", "_o.*")


def follow_images(
    spark: SparkSession, root: str, index_path: str, retry_path: str, offers_path: str, checkpoint: str,
    extensions=DEFAULT_EXTENSIONS, attempts: int = 3,
) -> DataFrame:
    """One round over a folder: offer what is new, changed or failed, then index it as a stream to the end.

    Returns the offers of the round. Names stay on the executors; a folder without offers starts no stream.
    """
    listing = list_images(spark, root, extensions)
    due = offer(listing, offers_path, retry_path, index_path, attempts)
    if _read_or_empty(spark, offers_path, _OFFER).isEmpty():
        return due

    def hash_batch(batch: DataFrame) -> DataFrame:
        files = stage(last_offers(batch), "offered-files")
        return hash_listed(files.select("path", "uri", "size"), root).join(files.drop("uri"), "path")

    stream = offered(spark, offers_path, "uri string")
    index_stream(stream, hash_batch, index_path, retry_path, checkpoint).awaitTermination()
    return due


def _read_or_empty(spark: SparkSession, path: str, fields: str) -> DataFrame:
    try:
        return spark.read.schema(fields).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], fields)


def stream_images(
    spark: SparkSession,
    root: str,
    index_path: str,
    retry_path: str,
    checkpoint: str,
    extensions=DEFAULT_EXTENSIONS,
    files_per_batch: int = 1_000,
    available_now: bool = True,
) -> StreamingQuery:
    """Index new image files below ``root`` as they appear."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", extension_glob(extensions))
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
        .select("path", "modificationTime", "length")
    )

    def hash_batch(batch: DataFrame) -> DataFrame:
        # Bounded by files_per_batch: only the names of this batch reach the driver.
        uris = [r.path for r in batch.select("path").collect()]
        hashed = hash_files(spark, uris, root)
        keys = batch.select(
            relative_path(plain_uri("path"), root_uri(root)).alias("path"),
            F.col("length").alias("size"),
            (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        )
        return hashed.join(keys, "path")

    return index_stream(files, hash_batch, index_path, retry_path, checkpoint, available_now)
