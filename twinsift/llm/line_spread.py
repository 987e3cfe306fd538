"""Line deduplication by the spread of a line over distinct sites.

A line that many sites carry is boilerplate. Each line's sites are gathered in a HyperLogLog sketch,
built per task and merged by aggregation, so a line found everywhere costs one small sketch per task
and no list of sites. Where the estimate is far from the threshold it decides; lines whose estimate is
near it are counted exactly, as distinct pairs of line and site. The first occurrence of a boilerplate
line (least ``doc_id``, then place) stays, all others go.

Lines are split at line breaks and compared without the white space around them; lines of fewer than
``min_words`` words are never boilerplate. A document with nothing but boilerplate keeps an empty
text. Null texts stay null and have no lines, a null source is a site of its own, rows with the same
``doc_id`` are one document whose equal rows are treated alike, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.session import string
from twinsift.operators.storage import stage

MIN_SITES = 8
MIN_WORDS = 4
# 2^10 registers: a standard error of 3 %.
LOG_REGISTERS = 10
# Estimates within this share of the threshold are counted exactly: ten standard errors.
NEAR = 0.3
_SPACE = " \t\r\n\f\u000b"


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(_SPACE)))


def _occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """Long enough lines: key of the document, place, line hash and site."""
    placed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("version"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("site"),
        F.posexplode(_lines(string("text"))).alias("place", "line"),
    )
    spaced = F.size(F.split("line", r"[ \t\r\f\u000b]+"))
    hashed = placed.where(spaced >= min_words)
    return hashed.select("doc_id", "version", "site", "place", _hash(F.col("line")).alias("line"))


def _hash(line: Column) -> Column:
    """128 bits of a line."""
    return F.substring(F.unhex(F.sha2(line, 256)), 1, 16)


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``line`` (hash), ``first_doc``, ``first_version``, ``first_place`` of every line on ``min_sites`` sites or more."""
    lines = _occurrences(docs, min_words)
    spread = lines.groupBy("line").agg(
        F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"),
        F.count(F.lit(1)).alias("rows"),
        F.min(F.struct("doc_id", "version", "place")).alias("first"),
    )
    # Fewer rows than sites asked for settle a line before its sketch is read.
    often = spread.where(F.col("rows") >= min_sites).select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    often = stage(often.where(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    sure = F.col("sites") > min_sites * (1 + NEAR)
    near = often.where(~sure)
    counted = lines.join(near.select("line"), "line", "left_semi").select("line", "site").distinct()
    exact = counted.groupBy("line").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites)
    found = often.where(sure).select("line", "first").unionByName(near.join(exact, "line").select("line", "first"))
    return found.select(
        "line",
        F.col("first.doc_id").alias("first_doc"),
        F.col("first.version").alias("first_version"),
        F.col("first.place").alias("first_place"),
    )


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``__n_lines`` and ``__n_dropped`` added.

    Only the places of dropped lines are gathered per document; texts without any stay as they are.
    """
    found = stage(boilerplate(docs, min_sites, min_words), "boilerplate")
    first = (
        F.col("doc_id").eqNullSafe(F.col("first_doc"))
        & (F.col("version") == F.col("first_version"))
        & (F.col("place") == F.col("first_place"))
    )
    hits = _occurrences(docs, min_words).join(found, "line").where(~first)
    # A document's places are no more than its own lines.
    dropped = hits.groupBy("doc_id", "version").agg(F.collect_set("place").alias("__places"))
    dropped = stage(dropped, "dropped").select(
        F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), "__places"
    )
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__version"))
    joined = docs.join(dropped, same, "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line, place: ~F.array_contains("__places", place))
    text = F.when(F.col("__places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("__n_lines"),
        F.coalesce(F.size("__places"), F.lit(0)).cast("bigint").alias("__n_dropped"),
    )


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without boilerplate lines. A document of which nothing is left is text found elsewhere and goes."""
    cleaned = dedup_lines(docs, min_sites, min_words)
    left = (F.col("__n_dropped") == 0) | F.col("text").rlike(r"[^ \t\r\n\f\u000b]")
    return cleaned.where(left).select(*docs.columns)
