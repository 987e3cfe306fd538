"""Image folders: listing, decoding through Spark's image source, hashing.

No file is lost silently. Spark's file sources hide names that begin with ``_`` or ``.``, end a whole job over
a folder they may not read, and refuse a list of paths if one of them is gone. So folders are listed here on
the executors, level by level, with every name and an ``error`` for what cannot be listed; listed files are
decoded by content, whatever their names; and each path asked for comes back with hashes or with a reason.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.functions.paths import extension, has_extension, normalize_ext, plain_uri, relative_path
from twinsift.functions.raster import raster_hashes, reorient
from twinsift.operators.lookup import expand_join
from twinsift.operators.storage import remove, scratch_path, stage_measured
from twinsift.schemas import DEFAULT_EXTENSIONS, RECORD_COLUMNS

# Paths handed to one read of missing files, where executors cannot open the store themselves.
CHUNK = 20_000
# Content kept at a time while listed files are hashed, and files a task opens.
WAVE_BYTES = 1 << 40
FILES_A_TASK = 256
_HASHED = "path string, bytes bigint, width int, height int, format string, sha256 string, " \
    "pixel_sha256 string, phash bigint, error string"


def extension_glob(extensions: Iterable[str]) -> str:
    """Glob that matches the extensions in any mix of case, so the listing is pruned early."""
    either = lambda ch: f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch
    return "*.{" + ",".join("".join(either(ch) for ch in ext) for ext in extensions) + "}"


def _reader(spark: SparkSession, fmt: str, extensions: Iterable[str], recurse: bool):
    reader = spark.read.format(fmt).option("pathGlobFilter", extension_glob(extensions))
    return reader.option("recursiveFileLookup", True) if recurse else reader


# Stores that executors list themselves; others are listed by Spark, which leaves hidden names out.
LISTED_SCHEMES = ("file", "s3", "s3a", "gs", "hdfs")
# Deeper folders are reported, not followed: a link may lead back up.
MAX_DEPTH = 64
VANISHED = "vanished"
_LISTED = "path string, uri string, size bigint, mtime_ns bigint, is_folder boolean, error string"


def list_images(
    spark: SparkSession, root: str, extensions: Iterable[str] = DEFAULT_EXTENSIONS, recurse: bool = True
) -> DataFrame:
    """``(path, uri, size, mtime_ns)`` of the image files below ``root``; no content is read."""
    return list_everything(spark, root, extensions, recurse).where("error IS NULL").drop("error")


def list_everything(
    spark: SparkSession, root: str, extensions: Iterable[str] = DEFAULT_EXTENSIONS, recurse: bool = True
) -> DataFrame:
    """:func:`list_images` and, with an ``error`` instead of a size, the folders that could not be listed.

    Each level of folders is one narrow job whose tasks list a share of them, so the driver sees counts only.
    """
    extensions = list(extensions)
    if root_uri(root).split(":", 1)[0] not in LISTED_SCHEMES:
        found = _listed_by_spark(spark, root, extensions, recurse)
        return found.withColumn("error", F.lit(None).cast("string"))
    folders = spark.createDataFrame([(root_uri(root),)], "uri string")
    found, waiting = None, 1
    for depth in range(MAX_DEPTH + 1):
        spread = folders.repartition(min(waiting, spark.sparkContext.defaultParallelism * 4))
        level, seen = stage_measured(
            _list_level(spread, root, depth == MAX_DEPTH), "listing", folders=F.count(F.when(F.col("is_folder"), 1))
        )
        files = level.where(~F.col("is_folder") & (F.col("error").isNotNull() | has_extension("path", extensions)))
        found = files if found is None else found.unionByName(files)
        waiting = seen["folders"]
        if not recurse or not waiting:
            break
        folders = level.where("is_folder").select("uri")
    return found.drop("is_folder")


def _list_level(folders: DataFrame, root: str, last: bool) -> DataFrame:
    """What lies directly in ``folders``, files and folders; a folder that cannot be listed has an ``error``."""
    base = root_uri(root).rstrip("/") + "/"

    def entries(uri: str) -> list[tuple]:
        below = lambda u: u[len(base) :] if u.startswith(base) else u
        if last:
            return [(below(uri), uri, None, None, False, "too deep")]
        try:
            store, path = open_store(uri)
            inside = store.get_file_info(fs.FileSelector(path))
        except OSError as error:
            return [(below(uri), uri, None, None, False, f"cannot list: {type(error).__name__}")]
        rows = []
        for item in inside:
            own = f"{uri.rstrip('/')}/{item.base_name}"
            # Whole milliseconds, as Spark's readers give them.
            changed = None if item.mtime_ns is None else item.mtime_ns // 1_000_000 * 1_000_000
            error = None if item.type in (fs.FileType.File, fs.FileType.Directory) else VANISHED
            rows.append((below(own), own, item.size, changed, item.type == fs.FileType.Directory, error))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        names = [part.split(" ")[0] for part in _LISTED.split(", ")]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                columns = list(zip(*entries(uri))) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return folders.mapInArrow(run, _LISTED)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a plain (not percent-encoded) URI and the path in it."""
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, _, path = rest.lstrip("/").partition("/")
    store, prefix = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}/")
    return store, f"{prefix.rstrip('/')}/{path}"


def _listed_by_spark(spark: SparkSession, root: str, extensions: list[str], recurse: bool) -> DataFrame:
    files = _reader(spark, "binaryFile", extensions, recurse).load(root)
    return (
        files.where(has_extension("path", extensions))
        .select(
            relative_path(plain_uri("path"), root_uri(root)).alias("path"),
            F.col("path").alias("uri"),
            F.col("length").alias("size"),
            (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        )
    )


def is_hidden(path: Column) -> Column:
    """Whether Spark's readers leave a file out for its own name."""
    return F.regexp_extract(path, "[^/]*$", 0).rlike(r"^(\.|_(?!.*=))")


def root_uri(root: str) -> str:
    if "://" in root or root.startswith("file:"):
        scheme, rest = root.split(":", 1)
        return f"{scheme}:/{rest.lstrip('/')}"
    return f"file:/{root.lstrip('/')}"


@F.pandas_udf(T.BinaryType())
def _to_rgba(data: pd.Series, channels: pd.Series) -> pd.Series:
    def one(raw, n):
        if raw is None or n not in (1, 3, 4) or len(raw) % n:
            return None
        pixels = np.frombuffer(raw, np.uint8).reshape(-1, n)
        out = np.full((len(pixels), 4), 255, np.uint8)
        out[:, :3] = pixels[:, :3][:, ::-1] if n > 1 else pixels
        if n == 4:
            out[:, 3] = pixels[:, 3]
        return out.tobytes()

    return pd.Series([one(r, n) for r, n in zip(data, channels)], dtype=object)


def _spelled_out(origin: Column) -> Column:
    """The image source writes paths percent-encoded, the binary source as they are."""
    return F.try_url_decode(F.replace(origin, F.lit("+"), F.lit("%2B")))


def _literal(uri: str) -> str:
    """A path that readers take as it is, not as a glob."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", uri)


def _decoded(images: DataFrame, root: str, orientation: Column | None) -> DataFrame:
    """``(path, width, height, rgba, error)`` from Spark's image struct (stored as BGR or BGRA)."""
    i = F.col("image")
    rgba = _to_rgba(i["data"], i["nChannels"])
    width, height = i["width"], i["height"]
    if orientation is not None:
        rgba = reorient(rgba, width, height, orientation)
        turned = F.coalesce(orientation.between(5, 8), F.lit(False))
        width, height = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    error = (
        F.when(i["width"] <= 0, "cannot decode")
        .when(~i["nChannels"].isin(1, 3, 4), F.concat(F.lit("unsupported channels: "), i["nChannels"].cast("string")))
    )
    return images.select(
        relative_path(plain_uri(_spelled_out(i["origin"])), root_uri(root)).alias("path"),
        width.alias("width"), height.alias("height"), rgba.alias("rgba"), error.alias("error"),
    )


def _hash(files: DataFrame, images: DataFrame, root: str, orientation: Column | None) -> DataFrame:
    """Join content hashes and raster hashes per path. Only hashes are shuffled, never pixels."""
    contents = files.select(
        relative_path(plain_uri("path"), root_uri(root)).alias("path"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
    rasters = _decoded(images, root, orientation).withColumn("_h", raster_hashes("rgba", "width", "height"))
    rasters = rasters.select("path", "width", "height", "error", "_h.pixel_sha256", "_h.phash")
    joined = contents.join(rasters, "path", "left")
    return joined.select(
        "path", "bytes",
        F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"),
        normalize_ext(extension("path")).alias("format"), "sha256", "pixel_sha256", "phash",
        # A file of which one of the two readers saw nothing went away in between.
        F.when(F.col("width").isNull(), VANISHED).otherwise(F.col("error")).alias("error"),
    )


def hash_folder(
    spark: SparkSession,
    root: str,
    extensions: Iterable[str] = DEFAULT_EXTENSIONS,
    recurse: bool = True,
    orientation: Column | None = None,
) -> DataFrame:
    """Hashed rows (record columns and ``error``) of every image below ``root``.

    Visible files are read by folder, without their paths passing the driver. Folders that cannot be listed, files with
    hidden names or below hidden folders, and files that came or went meanwhile, come from a listing.
    """
    extensions = list(extensions)
    files = _reader(spark, "binaryFile", extensions, recurse).load(root)
    images = _reader(spark, "image", extensions, recurse).option("dropInvalid", False).load(root)
    seen = _hash(files, images, root, orientation)
    listing = list_everything(spark, root, extensions, recurse)
    shut = _failed(listing.where("error IS NOT NULL"), F.col("error"))
    hidden = listing.where(F.col("error").isNull() & F.col("path").rlike(r"(^|/)(\.|_(?![^/]*=))"))
    return seen.unionByName(hash_listed(hidden, root, orientation=orientation)).unionByName(shut)


def _failed(rows: DataFrame, reason: Column) -> DataFrame:
    """Hashed rows of items of which nothing but a ``path`` (and perhaps a size) is known."""
    size = F.coalesce(F.col("size"), F.lit(0)) if "size" in rows.columns else F.lit(0)
    none = F.lit(None).cast("string")
    return rows.select(
        "path", size.cast("bigint").alias("bytes"), F.lit(0).alias("width"), F.lit(0).alias("height"),
        normalize_ext(extension("path")).alias("format"), F.lit("").alias("sha256"), none.alias("pixel_sha256"),
        F.lit(None).cast("bigint").alias("phash"), reason.alias("error"),
    )


def folder_rasters(
    spark: SparkSession, root: str, extensions: Iterable[str] = DEFAULT_EXTENSIONS, recurse: bool = True,
    orientation: Column | None = None,
) -> DataFrame:
    """``(path, width, height, rgba)`` of every readable image below ``root``, for comparing pairs."""
    images = _reader(spark, "image", list(extensions), recurse).option("dropInvalid", False).load(root)
    good = _decoded(images, root, orientation).where(F.col("error").isNull())
    return good.select("path", "width", "height", "rgba")


def hash_files(
    spark: SparkSession, uris: Iterable[str], root: str, orientation: Column | None = None
) -> DataFrame:
    """Hashed rows of one bounded list of files; one that is gone, or goes while it is read, has the reason ``vanished``."""
    uris = list(uris)
    asked = spark.createDataFrame([(uri,) for uri in uris], "uri string")
    asked = asked.select(relative_path(plain_uri("uri"), root_uri(root)).alias("path")).distinct()
    found = _read_present(spark, uris, root, orientation)
    lost = asked if found is None else asked.join(found.select("path"), "path", "left_anti")
    lost = _failed(lost, F.lit(VANISHED))
    return lost if found is None else found.unionByName(lost)


def _read_present(spark: SparkSession, uris: list[str], root: str, orientation: Column | None) -> DataFrame | None:
    """Hashed rows of those files that exist. Readers refuse a list with a missing path, so it is halved then."""
    paths = [_literal(uri) for uri in uris]
    try:
        files = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(paths)
        images = spark.read.format("image").option("dropInvalid", False).option("ignoreMissingFiles", True).load(paths)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        half = len(uris) // 2
        parts = [_read_present(spark, part, root, orientation) for part in (uris[:half], uris[half:]) if half and part]
        parts = [part for part in parts if part is not None]
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None
    return _hash(files, images, root, orientation)


def hash_listed(
    misses: DataFrame, root: str, chunk: int = CHUNK, orientation: Column | None = None, wave_bytes: int = WAVE_BYTES
) -> DataFrame:
    """Hashed rows of listed files, one for each, by content where the executors can open the store.

    Each file is opened once, by a task, which hashes it and keeps its content under that hash; the image
    source then decodes every *distinct* content once, whatever the names. The driver sees no path. Contents
    are kept for one wave of at most about ``wave_bytes`` only, so a first index of a large folder needs no
    second copy of it. Other stores are read in chunks of explicit paths, and so are visible files if there is an
    ``orientation``, which may look at the origin of an image.
    """
    if root_uri(root).split(":", 1)[0] not in LISTED_SCHEMES:
        return _hash_by_path(misses, root, chunk, orientation)
    if orientation is None:
        return _hash_by_content(misses, wave_bytes)
    hidden = is_hidden(F.col("path"))
    seen = _hash_by_path(misses.where(~hidden), root, chunk, orientation)
    return seen.unionByName(_hash_by_content(misses.where(hidden), wave_bytes, orientation))


def _hash_by_path(misses: DataFrame, root: str, chunk: int, orientation: Column | None) -> DataFrame:
    """File sources cannot take a join as a path filter, so the driver hands them one chunk of paths at a time.

    Names that Spark hides have no reader here and are reported.
    """
    spark = misses.sparkSession
    hidden = is_hidden(F.col("path"))
    out = scratch_path(spark, "hashed-files")
    _failed(misses.where(hidden), F.lit("hidden name")).write.parquet(out)
    for uris in _chunks((r.uri for r in misses.where(~hidden).select("uri").toLocalIterator(prefetchPartitions=True)), chunk):
        hash_files(spark, uris, root, orientation).write.mode("append").parquet(out)
    return spark.read.schema(_HASHED).parquet(out)


def _hash_by_content(misses: DataFrame, wave_bytes: int, orientation: Column | None = None) -> DataFrame:
    spark = misses.sparkSession
    asked, seen = stage_measured(
        misses.select("path", "uri", "size"), "asked-files", rows=F.count(F.lit(1)), bytes=F.sum("size")
    )
    out = scratch_path(spark, "hashed-files")
    _failed(asked.limit(0), F.lit(VANISHED)).write.parquet(out)
    waves = max(1, ceil(seen["bytes"] / wave_bytes)) if seen["rows"] else 0
    for wave in range(waves):
        part = asked.where(F.pmod(F.xxhash64("path"), F.lit(waves)) == wave)
        # A row of names stands for megabytes of content, so tasks are cut by the number of files.
        tasks = min(ceil(seen["rows"] / waves / FILES_A_TASK), 100_000)
        folder = scratch_path(spark, "contents")
        kept, told = stage_measured(
            keep_contents(part.repartition(max(tasks, 1)), folder), "content-hashes",
            rows=F.count(F.lit(1)), good=F.count(F.when(F.col("error").isNull(), 1)),
        )
        _failed(kept.where("error IS NOT NULL"), F.col("error")).write.mode("append").parquet(out)
        if told["good"]:
            hashed = _decode_contents(kept.where("error IS NULL"), folder, told["good"], orientation)
            hashed.write.mode("append").parquet(out)
        remove(spark, folder)
    return spark.read.schema(_HASHED).parquet(out)


def keep_contents(files: DataFrame, folder: str) -> DataFrame:
    """Hash each file and keep its content in ``folder/kept`` under the hash: ``(path, bytes, sha256, error)``.

    Copies of one content share one file there. A task that is tried again writes the same bytes to the same name.
    """
    folder = root_uri(folder)

    def one(uri: str, store: fs.FileSystem, target: str) -> tuple[int | None, str | None, str | None]:
        digest, size = hashlib.sha256(), 0
        draft = f"{target}/drafts/{uuid.uuid4().hex}"
        try:
            source, at = open_store(uri)
            with source.open_input_stream(at) as given, store.open_output_stream(draft) as taken:
                while block := given.read(1 << 20):
                    digest.update(block)
                    size += len(block)
                    taken.write(block)
        except FileNotFoundError:
            return None, None, VANISHED
        except OSError as problem:
            return None, None, f"cannot read: {type(problem).__name__}"
        name = f"{target}/kept/{digest.hexdigest()}"
        there = lambda: store.get_file_info(name).type == fs.FileType.File
        if there():
            store.delete_file(draft)
            return size, digest.hexdigest(), None
        try:
            store.move(draft, name)
        except OSError:
            # Some stores do not rename onto a file that another task has just put there.
            if not there():
                raise
        return size, digest.hexdigest(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, target = open_store(folder)
        for below in ("drafts", "kept"):
            store.create_dir(f"{target}/{below}", recursive=True)
        for batch in batches:
            found = [one(uri, store, target) for uri in batch.column(1).to_pylist()]
            sizes, hashes, errors = zip(*found) if found else ((), (), ())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "bytes", "sha256", "error"])

    return files.select("path", "uri").mapInArrow(run, "path string, bytes bigint, sha256 string, error string")


def _decode_contents(kept: DataFrame, folder: str, rows: int, orientation: Column | None) -> DataFrame:
    """Hashed rows of kept files. Each content is decoded once; its hashes go to all of its names."""
    inside = f"{root_uri(folder)}/kept"
    images = kept.sparkSession.read.format("image").option("dropInvalid", False).load(inside)
    rasters = _decoded(images, inside, orientation).withColumn("_h", raster_hashes("rgba", "width", "height"))
    rasters = rasters.select(
        F.col("path").alias("sha256"), "width", "height", F.col("error").alias("_why"), "_h.pixel_sha256", "_h.phash"
    )
    uses = kept.groupBy("sha256").agg(F.count(F.lit(1)).alias("_n"))
    # A third of all files may be copies of one content: the salted join spreads them.
    joined = expand_join(kept, rasters.join(uses, "sha256"), "sha256", "_n", how="left", max_weight=rows)
    return joined.select(
        "path", "bytes", "width", "height", normalize_ext(extension("path")).alias("format"),
        "sha256", "pixel_sha256", "phash", F.col("_why").alias("error"),
    )


def _chunks(items: Iterable[str], size: int) -> Iterator[list[str]]:
    part: list[str] = []
    for item in items:
        part.append(item)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


HASHED_COLUMNS = [*RECORD_COLUMNS, "error"]
