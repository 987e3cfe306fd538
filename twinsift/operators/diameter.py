"""Greatest pairwise Hamming distance inside each group, without listing a group's pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.functions import kernels
from twinsift.functions.bits import hamming
from twinsift.operators.hamming import BLOCK_ROWS, HOT_BUCKET, hamming_join
from twinsift.operators.lookup import HOT_ROWS, expand_join
from twinsift.operators.storage import stage, stage_measured
from twinsift.schemas import HASH_BITS

# Groups up to this many distinct fingerprints are solved from one bounded array.
SMALL_GROUP = 1_024
# So many fingerprints of a group, those farthest from its majority fingerprint, are compared with all of it.
STARTS = 256
# Widest complement distance worth a banded join.
_MAX_COMPLEMENT = 12


@F.pandas_udf(T.IntegerType())
def _widest(phashes: pd.Series) -> pd.Series:
    return phashes.map(kernels.widest_distance).astype("int32")


def _small(sets: DataFrame) -> DataFrame:
    lists = sets.groupBy("component").agg(F.collect_list("phash").alias("phashes"))
    return lists.select("component", _widest("phashes").alias("max_hamming"))


def max_hamming(
    sets: DataFrame,
    small_group: int = SMALL_GROUP,
    hot_rows: int = HOT_ROWS,
    hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """``sets(component, phash)`` with distinct fingerprints -> ``(component, max_hamming)``.

    Groups of one or two fingerprints follow from their smallest and largest value, groups of at
    most ``small_group`` from one short array each. Larger groups are bounded from both sides:

    * from below by two sweeps: the fingerprint farthest from an arbitrary one, then the one
      farthest from that; where that leaves a gap, also by ``STARTS`` fingerprints on the group's rim;
    * from above by the number of bits that vary at all and by twice the greatest distance to the
      majority fingerprint.

    Where the bounds meet the group is done. Otherwise only a strictly wider pair is looked for: it
    is a pair whose one side, complemented in the varying bits, lies within the (small) remaining
    gap of the other, which is again a banded equi-join. A gap too wide for bands leaves a blocked
    comparison of those fingerprints that can still take part in a wider pair. Every step is exact.
    """
    stats = sets.groupBy("component").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("phash").alias("low"),
        F.max("phash").alias("high"),
        F.bit_or("phash").bitwiseXOR(F.bit_and("phash")).alias("varying"),
    )
    stats, seen = stage_measured(stats, "group-stats", most=F.max("n"))
    tiny = stats.where("n <= 2").select("component", hamming("low", "high").alias("max_hamming"))
    sized = expand_join(
        sets, stats.where("n > 2").select("component", "n", "varying", "low"), "component", "n",
        max_weight=seen["most"], hot_rows=hot_rows,
    )
    out = tiny.union(_small(sized.where(F.col("n") <= small_group)))
    if seen["most"] <= small_group:
        return out
    large = stage(sized.where(F.col("n") > small_group), "large-groups")
    return out.union(_large(large, stats.where(F.col("n") > small_group), hot_rows, hot_bucket))


def _large(sets: DataFrame, stats: DataFrame, hot_rows: int, hot_bucket: int) -> DataFrame:
    def attach(rows: DataFrame, per_group: DataFrame) -> DataFrame:
        return expand_join(rows, per_group, "component", "n", hot_rows=hot_rows)

    shape = ["n", "varying"]

    def farthest(rows: DataFrame, origin: str) -> DataFrame:
        distance = hamming("phash", origin)
        return rows.groupBy("component").agg(
            F.max_by("phash", distance).alias("far"), F.max(distance).alias("found"),
        )

    ones = [
        F.sum(F.shiftrightunsigned("phash", bit).bitwiseAND(F.lit(1))).alias(f"ones{bit}")
        for bit in range(HASH_BITS)
    ]
    centres = sets.groupBy("component").agg(F.count(F.lit(1)).alias("n"), *ones)
    centre = F.lit(0).cast("bigint")
    for bit in range(HASH_BITS):
        place = 1 << bit if bit < HASH_BITS - 1 else -(1 << bit)
        centre = centre.bitwiseOR(
            F.when(F.col(f"ones{bit}") * 2 > F.col("n"), F.lit(place).cast("bigint")).otherwise(F.lit(0))
        )
    centres = centres.select("component", centre.alias("centre"))

    first = farthest(sets, "low").withColumnRenamed("found", "found1")
    hints = stage(
        first.join(centres, "component").join(stats.select("component", "n"), "component"), "sweep"
    )
    rows = attach(sets.select("component", "phash", "low"), hints)
    to_centre = hamming("phash", "centre")
    bounds = (
        rows.groupBy("component")
        .agg(
            F.max(hamming("phash", "far")).alias("found2"),
            F.first("found1").alias("found1"),
            F.max(to_centre).alias("reach"),
            F.first("centre").alias("centre"),
        )
        .join(stats.select("component", *shape), "component")
        .withColumn("found", F.greatest("found1", "found2"))
        .withColumn("limit", F.least(F.bit_count("varying").cast("int"), F.col("reach") * 2))
    )
    bounds = stage(bounds, "bounds")
    if bounds.where("found < limit").isEmpty():
        return bounds.select("component", F.col("found").alias("max_hamming"))

    starts = _rim(attach(sets.select("component", "phash"), bounds.where("found < limit").select("component", "n", "centre")))
    starts = starts.join(bounds.select("component", "n"), "component")
    met = attach(_spread(sets.select("component", "phash")), starts).select("component", "phash", F.explode("starts").alias("start"))
    seen = met.groupBy("component").agg(F.max(hamming("phash", "start")).alias("found3"))
    bounds = bounds.join(seen, "component", "left").withColumn("found", F.greatest("found", "found3")).drop("found3")
    bounds = stage(bounds, "bounds")
    open_groups = bounds.where("found < limit").withColumn("gap", F.bit_count("varying") - F.col("found") - 1)
    known = bounds.select("component", F.col("found").alias("max_hamming"))
    if open_groups.isEmpty():
        return known

    # Only fingerprints far enough from the centre can be in a pair wider than the one found.
    live = attach(sets.select("component", "phash"), open_groups.drop("low")).where(
        hamming("phash", "centre") + F.col("reach") > F.col("found")
    )
    live = stage(live.select("component", "phash", "varying", "gap", "found"), "live")
    banded = live.where(F.col("gap") <= _MAX_COMPLEMENT)
    blocked = live.where(F.col("gap") > _MAX_COMPLEMENT)
    wider = _wider_by_bands(banded, hot_bucket).union(_wider_by_blocks(blocked, hot_rows))
    return known.union(wider).groupBy("component").agg(F.max("max_hamming").alias("max_hamming"))


def _rim(rows: DataFrame) -> DataFrame:
    """``rows(component, phash, centre)`` -> ``(component, starts)``: the ``STARTS`` fingerprints farthest from the centre."""
    last = Window.partitionBy("component").orderBy(hamming("phash", "centre").desc(), "phash")
    first = rows.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= STARTS)
    return first.groupBy("component").agg(F.collect_list("phash").alias("starts"))


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all shuffle partitions: each meets many others, and a short table may sit in few files."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "phash")


def _wider_by_bands(live: DataFrame, hot_bucket: int) -> DataFrame:
    """One join per gap that occurs, so a group is searched no further than its own gap asks for."""
    # One row per gap, of which there are at most _MAX_COMPLEMENT + 1.
    sizes = live.groupBy("gap").count().orderBy("gap").collect()
    wider = live.select("component", F.lit(None).cast("int").alias("max_hamming")).where(F.lit(False))
    for gap, rows in sizes:
        group = live.where(F.col("gap") == gap)
        mirrored = group.select("component", F.col("phash").bitwiseXOR(F.col("varying")).alias("phash"), "varying")
        pairs = hamming_join(
            mirrored, group.select("component", "phash"), gap, rows, on=("component",), hot_bucket=hot_bucket
        )
        width = (F.bit_count("p_varying") - F.col("distance")).cast("int")
        wider = wider.union(pairs.groupBy(F.col("p_component").alias("component")).agg(F.max(width).alias("max_hamming")))
    return wider


def _wider_by_blocks(live: DataFrame, hot_rows: int) -> DataFrame:
    count = F.count(F.lit(1))
    sizes = live.groupBy("component").agg(count.alias("n"), F.ceil(count / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes, seen = stage_measured(sizes, "block-counts", most=F.max("n"))
    rows = expand_join(
        live.select("component", "phash"), sizes, "component", "n", max_weight=seen["most"], hot_rows=hot_rows
    )
    block: Column = F.pmod(F.xxhash64("phash"), F.col("blocks")).cast("int")
    a = rows.select("component", F.col("phash").alias("a"), block.alias("x"), "blocks")
    b = a.withColumnRenamed("a", "b")
    # A row of block x meets the blocks x.. as left side and ..x as right side.
    a = a.withColumn("y", F.explode(F.sequence("x", F.col("blocks") - 1))).drop("blocks")
    b = b.withColumnRenamed("x", "y").drop("blocks")
    b = b.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("y"))))
    return (
        a.join(b, ["component", "x", "y"])
        .groupBy("component")
        .agg(F.max(hamming("a", "b")).alias("max_hamming"))
    )
