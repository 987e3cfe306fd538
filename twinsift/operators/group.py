"""All-against-all grouping at three levels of strictness."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions import kernels
from twinsift.operators.components import connected_components
from twinsift.operators.diameter import max_hamming
from twinsift.operators.hamming import HOT_BUCKET, hamming_join, region_links
from twinsift.operators.lookup import HOT_ROWS, expand_join
from twinsift.operators.positions import with_position
from twinsift.operators.storage import stage, stage_measured
from twinsift.schemas import DEFAULT_THRESHOLD, HASH_BITS, check_strictness

# Regions of so many fingerprints merge with their neighbours by heads before rows are paired.
DENSE = 256
# So many fingerprints, picked by hash, are compared with all others before any pairs are formed.
PIVOTS = 1_024
# Tables of more fingerprints than this are also sorted, with their bits turned round by so many places in each pass ...
SORTED_ROWS = 50_000
TURNS = ((0,), (24, 48), (8, 32, 56, 16), (40, 5, 29, 53, 13, 37, 61, 21))
# ... and each fingerprint is compared with so many before it.
SORTED_LAGS = 512
_SORTED_BATCH = 8_192
# Rows of a Python task, as far as the shuffle partitions allow.
TASK_ROWS = 65_536
_LINK = "a long, b long"

GROUP_COLUMNS = [
    "group_id", "strictness", "keeper", "first_path", "n_members", "reclaimable_bytes",
    "auto_deletable", "max_hamming",
]


@dataclass
class Grouping:
    """Groups (one row each) and their members (one row per record of a group).

    Members stay in long form: a group may hold a third of all records, so no row lists them.
    """

    strictness: str
    threshold: int | None
    groups: DataFrame
    members: DataFrame
    _records: DataFrame

    def stats(self, skipped: DataFrame | None = None) -> DataFrame:
        return scan_stats(self._records, self.groups, skipped)

    def display_members(self) -> DataFrame:
        """Members with a sort key that puts the keeper first and the rest in path order."""
        return self.members.withColumn("rank_key", F.struct(~F.col("is_keeper"), F.col("path")))


def prune_pixel_hash(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keep the pixel hash only where at least two records share the fingerprint.

    The counts are reduced to repeated fingerprints before they meet the records again, and the
    common fingerprint 0 of flat rasters is handled by the salted join.
    """
    shared = (
        records.where(F.col("phash").isNotNull())
        .groupBy("phash")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n >= 2")
    )
    shared, seen = stage_measured(shared, "shared-phashes", most=F.max("_n"))
    out = expand_join(
        records, shared, "phash", "_n", how="left", max_weight=seen["most"], hot_rows=hot_rows
    )
    kept = F.when(F.col("_n").isNotNull(), F.col("pixel_sha256"))
    return out.withColumn("pixel_sha256", kept).select(*records.columns)


def _area() -> Column:
    return F.col("width").cast("bigint") * F.col("height").cast("bigint")


def _summaries(rows: DataFrame, key: str) -> DataFrame:
    """One row per key with two or more records. Partial aggregation runs before the shuffle."""
    best = F.struct((-_area()).alias("area"), (-F.col("bytes")).alias("size"), F.col("path").alias("path"))
    return (
        rows.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n_members"),
            F.min("path").alias("first_path"),
            F.min(best).alias("_best"),
            F.sum("bytes").alias("_total"),
        )
        .where("n_members >= 2")
        .select(
            key, "n_members", "first_path", F.col("_best.path").alias("keeper"),
            (F.col("_total") + F.col("_best.size")).alias("reclaimable_bytes"),
        )
    )


def _number(groups: DataFrame, strictness: str) -> tuple[DataFrame, int]:
    """Groups with ids from 0 by smallest member path, and the size of the largest group."""
    numbered, seen = with_position(groups, ["first_path"], "group_id", most=F.max("n_members"))
    numbered = numbered.withColumn("strictness", F.lit(strictness)).withColumn(
        "auto_deletable", F.lit(strictness != "perceptual")
    )
    return numbered, seen["most"]


def _member_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "group_id", "path", "bytes", "keeper", (F.col("path") == F.col("keeper")).alias("is_keeper")
    )


def group_equal(records: DataFrame, strictness: str, hot_rows: int = HOT_ROWS) -> Grouping:
    """Groups of records with the same content hash (``exact``) or pixel hash (``pixel``)."""
    key = {"exact": "sha256", "pixel": "pixel_sha256"}[strictness]
    rows = records.where(F.col(key).isNotNull())
    groups, most = _number(_summaries(rows, key), strictness)
    groups = groups.withColumn("max_hamming", F.lit(None).cast("int"))
    members = expand_join(
        rows.select(key, "path", "bytes"), groups.select(key, "group_id", "keeper", "n_members"),
        key, "n_members", max_weight=most, hot_rows=hot_rows,
    )
    return Grouping(strictness, None, groups.select(*GROUP_COLUMNS), _member_rows(members), records)


def fingerprint_components(
    fingerprints: DataFrame,
    threshold: int,
    rows: int,
    hot_rows: int = HOT_ROWS,
    hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """``(phash, component)`` of the graph that links fingerprints within ``threshold`` bits.

    ``component`` is one of the component's fingerprints. First crowded regions merge at linear cost:
    fingerprints that agree outside a window of ``threshold`` bits are within the threshold for
    certain, so each links to the smallest of its window key, and each links to some of ``PIVOTS`` fingerprints
    that it is compared with. Regions that hold many fingerprints then
    merge with their neighbours by one head per band key and region. Pairs are formed between regions
    that are still different. Each task reduces its pairs to pairs of regions before anything is written,
    so a dense cluster lists neither its own pairs nor all pairs with its neighbours.
    """
    only = fingerprints.select("phash")
    if threshold >= HASH_BITS:
        least = only.agg(F.min("phash")).first()[0]
        return only.withColumn("component", F.lit(least).cast("bigint"))
    if threshold == 0:
        return only.withColumn("component", F.col("phash"))

    certain = _window_links(only, threshold, hot_rows).unionByName(_pivot_links(only, threshold, rows))
    merged = stage(_label(only, connected_components(certain, hot_rows)), "merged")
    if rows > SORTED_ROWS:
        for turns in TURNS:
            merged = _merge_sorted(merged, threshold, turns, rows, hot_rows)
    merged = _merge_dense(merged, threshold, rows, hot_rows)
    links = _links_between(merged, threshold, rows, hot_bucket)
    upper = connected_components(links, hot_rows)
    sizes = merged.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    upper = stage(
        upper.select(F.col("node").alias("component"), F.col("component").alias("top")).join(sizes, "component"),
        "upper",
    )
    labelled = expand_join(merged, upper, "component", "n", how="left", max_weight=rows, hot_rows=hot_rows)
    return labelled.select("phash", F.coalesce("top", "component").alias("component"))


def _links_between(merged: DataFrame, threshold: int, rows: int, hot_bucket: int) -> DataFrame:
    """All pairs ``(a, b)`` of components that hold fingerprints within ``threshold`` bits.

    One side of any such pair is outside the largest component, so only the rows outside look for neighbours: the
    candidates inside a component that holds most rows are never formed.
    """
    sizes = merged.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max_by("component", F.struct("n", "component"))).first()[0]
    outside = merged.where(F.col("component") != largest)
    keep = (F.col("p_component") != F.col("b_component")) & (
        (F.col("b_component") == largest) | (F.col("p_phash") < F.col("b_phash"))
    )
    across = hamming_join(outside, merged, threshold, rows, keep=keep, hot_bucket=hot_bucket)
    return across.select(
        F.least("p_component", "b_component").alias("a"), F.greatest("p_component", "b_component").alias("b")
    ).distinct()


def _merge_dense(merged: DataFrame, threshold: int, rows: int, hot_rows: int) -> DataFrame:
    """``merged`` with regions of ``DENSE`` fingerprints or more joined, as far as their heads link them."""
    sizes = merged.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    dense, seen = stage_measured(sizes.where(F.col("n") >= DENSE), "dense-regions", regions=F.count(F.lit(1)))
    if seen["regions"] < 2:
        return merged
    inside = expand_join(merged, dense, "component", "n", max_weight=rows, hot_rows=hot_rows)
    links = region_links(inside.select("phash", "component"), "component", threshold, rows)
    joined = connected_components(links, hot_rows).select(F.col("node").alias("component"), F.col("component").alias("to"))
    joined = joined.join(dense, "component")
    moved = expand_join(merged, joined, "component", "n", how="left", max_weight=rows, hot_rows=hot_rows)
    return stage(moved.select("phash", F.coalesce("to", "component").alias("component")), "merged")


def _window_links(fingerprints: DataFrame, threshold: int, hot_rows: int) -> DataFrame:
    """Edges from each fingerprint to the smallest one that agrees outside a window of bits."""
    keys = []
    for number, shift in enumerate(range(0, HASH_BITS, threshold)):
        width = min(threshold, HASH_BITS - shift)
        window = ((1 << width) - 1) << shift
        window = window - (1 << HASH_BITS) if window >> (HASH_BITS - 1) else window
        outside = F.col("phash").bitwiseAND(F.lit(~window).cast("bigint"))
        keys.append(F.struct(F.lit(number).alias("window"), outside.alias("key")))
    rows = fingerprints.withColumn("_k", F.explode(F.array(*keys))).select("phash", "_k.window", "_k.key")
    heads = (
        rows.groupBy("window", "key")
        .agg(F.min("phash").alias("head"), F.count(F.lit(1)).alias("n"))
        .where("n >= 2")
    )
    heads, seen = stage_measured(heads, "windows", most=F.max("n"))
    linked = expand_join(rows, heads, ["window", "key"], "n", max_weight=seen["most"], hot_rows=hot_rows)
    return linked.select(F.col("phash").alias("a"), F.col("head").alias("b"))


def _pivot_links(fingerprints: DataFrame, threshold: int, rows: int) -> DataFrame:
    """Two edges at most from each fingerprint to those of ``PIVOTS`` fingerprints that are within the threshold.

    Where a good share of all pairs is that close, this joins most of them, and their pairs need not be listed.
    """
    pivots = fingerprints.orderBy(F.xxhash64("phash"), "phash").limit(PIVOTS).select(F.col("phash").alias("pivot"))
    few = np.array([row.pivot for row in pivots.collect()], dtype=np.int64)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phashes = batch.column(0).to_numpy()
            if len(phashes):
                row, place = kernels.links_to_few(phashes, few, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(phashes[row]), pa.array(few[place])], names=["a", "b"])

    return fingerprints.repartition(_tasks(fingerprints, rows), "phash").mapInArrow(link, _LINK)


def _tasks(df: DataFrame, rows: int) -> int:
    """Tasks for Python work on so many rows: a short table may sit in one file, and a task costs as much as some thousand rows."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, min(most, rows // TASK_ROWS))


def _merge_sorted(merged: DataFrame, threshold: int, turns: tuple[int, ...], rows: int, hot_rows: int) -> DataFrame:
    """``merged`` with components joined that have fingerprints near each other in sort order.

    The table is sorted once for each of ``turns``, by the fingerprints with their bits turned round by so many places,
    so those that share a run of bits lie side by side. Each is compared with ``SORTED_LAGS`` before it.
    """
    keys = []
    for turn in turns:
        key = F.shiftleft("phash", turn).bitwiseOR(F.shiftrightunsigned("phash", HASH_BITS - turn)) if turn else F.col("phash")
        keys.append(F.struct(F.lit(turn).alias("turn"), key.alias("key")))
    tasks = _tasks(merged, rows * len(turns))
    side = merged.withColumn("_k", F.explode(F.array(*keys))).select("phash", "component", "_k.turn", "_k.key")
    side = side.repartitionByRange(tasks, "turn", "key").sortWithinPartitions("turn", "key").select("phash", "component")

    def link(batches: Iterator[pa.RecordBatch], lags=SORTED_LAGS) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        wait = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, wait
            both = np.concatenate(held, axis=1)
            a, b = kernels.links_before(both[0], both[1], lags, threshold)
            held, wait = [both[:, -lags:].copy()], 0
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            if not held:
                # The first row stands before itself: no link, as its label is its own.
                held.append(np.repeat(part[:, :1], lags, axis=1))
            held.append(part)
            wait += part.shape[1]
            if wait >= _SORTED_BATCH:
                yield flush()
        if wait:
            yield flush()

    links = side.mapInArrow(link, _LINK).distinct()
    return _join_regions(merged, connected_components(links, hot_rows), rows, hot_rows)


def _join_regions(merged: DataFrame, joined: DataFrame, rows: int, hot_rows: int) -> DataFrame:
    """``merged`` after the components in ``joined(node, component)`` became one."""
    sizes = merged.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("to")).join(sizes, "component")
    moved = expand_join(merged, stage(to, "joined"), "component", "n", how="left", max_weight=rows, hot_rows=hot_rows)
    return stage(moved.select("phash", F.coalesce("to", "component").alias("component")), "merged")


def _label(fingerprints: DataFrame, components: DataFrame) -> DataFrame:
    return fingerprints.join(
        components.withColumnRenamed("node", "phash"), "phash", "left"
    ).select("phash", F.coalesce("component", "phash").alias("component"))


def group_perceptual(
    records: DataFrame,
    threshold: int = DEFAULT_THRESHOLD,
    hot_rows: int = HOT_ROWS,
    **tuning,
) -> Grouping:
    """Connected components of records whose fingerprints are within ``threshold`` bits.

    Equal fingerprints are one node, so copies cost nothing in the pair search. Chains join records
    that are farther apart than the threshold; ``max_hamming`` shows by how much.
    """
    rows = records.where(F.col("phash").isNotNull())
    fingerprints, seen = stage_measured(
        rows.groupBy("phash").agg(F.count(F.lit(1)).alias("n")), "fingerprints",
        rows=F.count(F.lit(1)), most=F.max("n"),
    )
    distinct = seen["rows"]
    labels = fingerprint_components(fingerprints, threshold, distinct, hot_rows=hot_rows, **tuning)
    labels = stage(labels.join(fingerprints, "phash"), "labels")

    labelled = expand_join(rows, labels, "phash", "n", max_weight=seen["most"], hot_rows=hot_rows)
    groups = stage(_summaries(labelled, "component"), "summaries")
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    groups = groups.join(sizes, "component")
    inside = expand_join(
        labels.select("component", "phash"), groups.select("component", "n_nodes"), "component", "n_nodes",
        max_weight=distinct, hot_rows=hot_rows,
    )
    widest = max_hamming(inside.select("component", "phash"), hot_rows=hot_rows)
    groups, _ = _number(groups.join(widest, "component"), "perceptual")

    tagged = expand_join(
        labels, groups.select("component", "group_id", "keeper", "n_nodes"), "component", "n_nodes",
        max_weight=distinct, hot_rows=hot_rows,
    )
    members = expand_join(
        rows.select("phash", "path", "bytes"), tagged.select("phash", "group_id", "keeper", "n"),
        "phash", "n", max_weight=seen["most"], hot_rows=hot_rows,
    )
    return Grouping("perceptual", threshold, groups.select(*GROUP_COLUMNS), _member_rows(members), records)


def scan(
    records: DataFrame, strictness: str = "perceptual", threshold: int | None = None, **tuning
) -> Grouping:
    """Group an indexed table. ``threshold`` applies to ``perceptual`` only (default 10)."""
    check_strictness(strictness)
    if strictness == "perceptual":
        limit = DEFAULT_THRESHOLD if threshold is None else threshold
        if limit < 0:
            raise ValueError("threshold must not be negative")
        return group_perceptual(records, limit, **tuning)
    return group_equal(records, strictness, **tuning)


def scan_stats(records: DataFrame, groups: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: records, skipped, groups, surplus members and bytes; also the auto-deletable bytes."""
    sides = [
        records.agg(F.count(F.lit(1)).alias("scanned")),
        groups.agg(
            F.count(F.lit(1)).alias("groups"),
            F.coalesce(F.sum(F.col("n_members") - 1), F.lit(0)).alias("duplicates"),
            F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"),
            F.coalesce(
                F.sum(F.when(F.col("auto_deletable"), F.col("reclaimable_bytes"))), F.lit(0)
            ).alias("reclaimable_auto"),
        ),
    ]
    if skipped is not None:
        sides.append(skipped.agg(F.count(F.lit(1)).alias("skipped")))
    one = [side.withColumn("_one", F.lit(1)) for side in sides]
    out = one[0]
    for side in one[1:]:
        out = out.join(side, "_one")
    if skipped is None:
        out = out.withColumn("skipped", F.lit(0).cast("bigint"))
    return out.select("scanned", "skipped", "groups", "duplicates", "reclaimable_bytes", "reclaimable_auto")
