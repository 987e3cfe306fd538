"""Numbering rows of a whole table in sort order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.operators.storage import stage_measured

_MARK = "_mark"
_PART = "_part"
_BEFORE = "_before"
# monotonically_increasing_id keeps the partition number above bit 33 and the row number below it.
_ROW_BITS = 33


def with_position(
    df: DataFrame, order_by: list[Column | str], out: str, **metrics: Column
) -> tuple[DataFrame, dict[str, int]]:
    """Add ``out`` = 0, 1, 2, ... following ``order_by`` over the whole table.

    Rows are range-partitioned and sorted inside their partition. Each row is marked with its
    partition and place, the marked table is written once (so a lost executor cannot change it), and
    one row per partition is summed up to the number of rows before it. Only those per-partition
    counts meet in one place; their number is the shuffle width, not the data size.

    Also returns the ``metrics``, aggregates observed while writing.
    """
    marked = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn(_MARK, F.monotonically_increasing_id())
    )
    marked, seen = stage_measured(marked, "positions", rows=F.count(F.lit(1)), **metrics)
    marked = marked.withColumn(_PART, F.shiftright(_MARK, _ROW_BITS))
    counts = marked.groupBy(_PART).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(_BEFORE))
    place = F.col(_MARK).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = (
        marked.join(F.broadcast(offsets), _PART)
        .withColumn(out, F.col(_BEFORE) + place)
        .drop(_PART, _MARK, _BEFORE)
    )
    return numbered, seen
