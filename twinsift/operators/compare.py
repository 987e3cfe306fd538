"""Pairwise comparison of records and their rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.bits import hamming
from twinsift.functions.kernels import SSIM_WINDOW
from twinsift.functions.paths import verdict
from twinsift.functions.raster import pair_scores, raster_hashes, strip_sums
from twinsift.operators.lookup import HOT_ROWS, expand_join
from twinsift.operators.storage import stage_measured
from twinsift.schemas import PSNR_CAP

# Rasters beyond this are scored in strips of about so many pixels (16 MB each side).
STRIP_PIXELS = 1 << 22
# Scores of two rasters with the same content.
_EQUAL = {"pixel_diff_ratio": 0.0, "ssim": 1.0, "psnr": PSNR_CAP}

_FACTS = ["sha256", "pixel_sha256", "phash", "width", "height"]


def with_raster_hashes(rasters: DataFrame) -> DataFrame:
    """Add ``pixel_sha256`` and ``phash`` to a table with ``rgba``, ``width`` and ``height``."""
    hashed = rasters.withColumn("_h", raster_hashes("rgba", "width", "height"))
    return hashed.select(*rasters.columns, "_h.pixel_sha256", "_h.phash")


def compare_pairs(
    pairs: DataFrame,
    rasters: DataFrame,
    tolerance: int = 0,
    with_highlight: bool = False,
    pixel_equal_by: str = "hash",
    hot_rows: int = HOT_ROWS,
    strip_pixels: int = STRIP_PIXELS,
    in_one_pass: bool = False,
) -> DataFrame:
    """Score every pair ``(a, b)`` of record paths.

    ``rasters`` has ``path``, ``sha256``, ``pixel_sha256``, ``phash``, ``width``, ``height`` and
    ``rgba``. Where the dimensions differ the pair cannot be compared: ``pixel_equal``, the three
    scores and the highlight are null, which is not the same as a comparison that failed.
    ``pixel_equal_by='ratio'`` derives equality from a difference ratio of zero at tolerance zero.

    Facts are joined first. Pixels are fetched only for pairs of equal dimensions and different
    content (or all of equal dimensions, if highlights are asked for); equal content has known scores.
    Rasters of more than ``strip_pixels`` pixels are cut into strips that are scored apart and summed up.
    A record that occurs in very many pairs is spread by the salted join. ``in_one_pass`` joins facts and pixels at
    once and writes nothing in between: for rasters of at most a few kilobytes, such as vectors.
    """
    if pixel_equal_by not in ("hash", "ratio"):
        raise ValueError("pixel_equal_by must be 'hash' or 'ratio'")
    joined = _with_sides(pairs, rasters, [*_FACTS, "rgba"] if in_one_pass else _FACTS, hot_rows)
    same_size = (F.col("a_width") == F.col("b_width")) & (F.col("a_height") == F.col("b_height"))
    same_pixels = F.col("a_pixel_sha256") == F.col("b_pixel_sha256")
    joined = joined.withColumn("dims_equal", same_size).withColumn("_same", F.coalesce(same_pixels, F.lit(False)))
    needed = F.coalesce("dims_equal", F.lit(False)) & (F.lit(with_highlight) | ~F.col("_same"))
    joined = joined.withColumn("_needed", needed)
    known = F.struct(
        *[F.when(F.col("dims_equal"), F.lit(value)).alias(name) for name, value in _EQUAL.items()],
        F.lit(None).cast("binary").alias("highlight"), F.when(F.col("dims_equal"), F.lit(0.0)).alias("strict_ratio"),
    )
    scores = pair_scores("a_rgba", "b_rgba", "a_width", "a_height", tolerance, with_highlight)
    if in_one_pass:
        asked = joined.withColumn("a_rgba", F.when(F.col("_needed"), F.col("a_rgba"))).withColumn("_scored", scores)
        scored = asked.withColumn("_s", F.when(F.col("_needed"), F.col("_scored")).otherwise(known)).drop("_scored")
    else:
        area = F.col("a_width").cast("bigint") * F.col("a_height")
        large = needed & (area > strip_pixels) & (F.least("a_width", "a_height") >= SSIM_WINDOW)
        joined, seen = stage_measured(
            joined.withColumn("_large", F.coalesce(large, F.lit(False))), "pair-facts",
            whole=F.count(F.when(needed & ~large, 1)), large=F.count(F.when(large, 1)),
        )
        scored = joined.where("NOT _needed").withColumn("_s", known)
        if seen["whole"]:
            whole = _with_sides(joined.where("_needed AND NOT _large"), rasters, ["rgba"], hot_rows)
            scored = scored.unionByName(whole.withColumn("_s", scores).drop("a_rgba", "b_rgba"))
        if seen["large"]:
            asked = joined.where("_large")
            summed = _in_strips(asked, rasters, tolerance, with_highlight, strip_pixels, hot_rows)
            scored = scored.unionByName(expand_join(asked, summed, ["a", "b"], "_n", how="left", hot_rows=hot_rows).drop("_n"))

    equal = F.col("_s.strict_ratio") == 0 if pixel_equal_by == "ratio" else same_pixels
    out = scored.select(
        *pairs.columns,
        (F.col("a_sha256") == F.col("b_sha256")).alias("sha_equal"),
        "dims_equal",
        F.col("dims_equal").alias("comparable"),
        F.when(F.col("dims_equal"), equal).alias("pixel_equal"),
        F.col("_s.pixel_diff_ratio").alias("pixel_diff_ratio"),
        F.col("_s.ssim").alias("ssim"),
        F.col("_s.psnr").alias("psnr"),
        hamming("a_phash", "b_phash").alias("hamming"),
        *([F.col("_s.highlight").alias("highlight")] if with_highlight else []),
    )
    return out.withColumn("verdict", verdict("sha_equal", "pixel_equal", "dims_equal", "ssim"))


def _in_strips(
    asked: DataFrame, rasters: DataFrame, tolerance: int, with_highlight: bool, strip_pixels: int, hot_rows: int
) -> DataFrame:
    """``(a, b, _n, _s)``: the scores of each distinct pair, and how often it is asked for.

    A strip holds whole rows of pixels, and seven rows of the next one, so that every window lies in one strip.
    Strips are dealt over the tasks, hence no task holds two whole rasters in Python. The sums of differences are
    whole numbers; those of the windows are added in the order of the strips.
    """
    distinct = asked.groupBy("a", "b").agg(
        F.first("a_width").alias("_w"), F.first("a_height").alias("_h"), F.count(F.lit(1)).alias("_n")
    )
    sides = _with_sides(distinct.drop("_n"), rasters, ["rgba"], hot_rows)
    w, h = F.col("_w").cast("bigint"), F.col("_h").cast("bigint")
    sound = (F.octet_length("a_rgba") == w * h * 4) & (F.octet_length("b_rgba") == w * h * 4)
    rows = F.greatest(F.lit(SSIM_WINDOW).cast("bigint"), F.floor(F.lit(strip_pixels) / w))

    def strip(k: Column) -> Column:
        first = k * rows
        size = F.least(rows + SSIM_WINDOW - 1, h - first) * w * 4
        cut = lambda side: F.substring(F.col(side), (first * w * 4 + 1).cast("int"), size.cast("int"))
        own = F.least(rows, h - first).cast("int")
        return F.struct(k.alias("k"), own.alias("own"), cut("a_rgba").alias("x"), cut("b_rgba").alias("y"))

    places = F.sequence(F.lit(0).cast("bigint"), F.ceil(h / rows).cast("bigint") - 1)
    strips = sides.where(sound).select("a", "b", "_w", "_h", F.explode(F.transform(places, strip)).alias("_t"))
    strips = strips.select("a", "b", "_w", "_h", "_t.*").repartition("a", "b", "k")
    strips = strips.withColumn("_p", strip_sums("x", "y", "_w", "own", tolerance, with_highlight))
    summed = strips.groupBy("a", "b", "_w", "_h").agg(
        F.sum("_p.differing").alias("differing"), F.sum("_p.unequal").alias("unequal"), F.sum("_p.squares").alias("squares"),
        # One number (and, if asked for, one piece of the highlight) per strip.
        F.sort_array(F.collect_list(F.struct("k", "_p.ssim_sum", "_p.highlight"))).alias("_parts"),
    )
    windows = (w - (SSIM_WINDOW - 1)) * (h - (SSIM_WINDOW - 1))
    total = F.aggregate("_parts", F.lit(0.0), lambda acc, part: acc + part["ssim_sum"])
    decibel = F.lit(10.0) * F.log10(F.lit(255.0 * 255.0) / (F.col("squares") / (w * h * 3)))
    shown = F.unhex(F.array_join(F.transform("_parts", lambda part: F.hex(part["highlight"])), ""))
    scores = F.struct(
        (F.col("differing") / (w * h)).alias("pixel_diff_ratio"),
        F.least(F.greatest(total / windows, F.lit(0.0)), F.lit(1.0)).alias("ssim"),
        F.when(F.col("squares") == 0, F.lit(PSNR_CAP)).otherwise(F.least(decibel, F.lit(PSNR_CAP))).alias("psnr"),
        (shown if with_highlight else F.lit(None).cast("binary")).alias("highlight"),
        (F.col("unequal") / (w * h)).alias("strict_ratio"),
    )
    return distinct.select("a", "b", "_n").join(summed.select("a", "b", scores.alias("_s")), ["a", "b"])


def _with_sides(pairs: DataFrame, rasters: DataFrame, columns: list[str], hot_rows: int) -> DataFrame:
    """Pairs with columns of both records, prefixed ``a_`` and ``b_``. Only records of a pair are carried."""
    joined = pairs
    for side in ("a", "b"):
        uses = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_n"))
        facts = rasters.select(F.col("path").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        joined = expand_join(joined, facts.join(uses, side), side, "_n", hot_rows=hot_rows).drop("_n")
    return joined
