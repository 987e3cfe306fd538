"""Making repeated names distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.operators.lookup import HOT_ROWS, expand_join
from twinsift.operators.positions import with_position
from twinsift.operators.storage import stage, stage_measured

# Ranks of one name that are looked up together.
BLOCK_RANKS = 100_000


def unique_paths(
    df: DataFrame, base: str, order: str, out: str = "path", hot_rows: int = HOT_ROWS,
    block_ranks: int = BLOCK_RANKS,
) -> DataFrame:
    """Number repeated names: ``a.png``, ``a (2).png``, ``a (3).png`` as if read in ``order``.

    ``order`` must be unique per row. A row takes its own name if no earlier row holds it, else the
    smallest number from 2 whose numbered name no earlier row holds.

    Rows of one name are ranked through a distributed sort (a name held by a third of all rows is
    not one window task). Row ``k`` of a name asks for number ``k``; where two different names ask
    for the same text, the earlier row keeps it and the number is struck from the other name. Ranks
    are fixed: row ``k`` then takes the ``k``-th number that is left, found among ``block_ranks`` ranks
    of its name at a time. Rounds end when nobody clashes, normally at once.
    """
    ranked, _ = with_position(df, [base, order], "_pos")
    firsts = ranked.groupBy(base).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ranked = expand_join(ranked, firsts, base, "_n", hot_rows=hot_rows)
    ranked = ranked.withColumn("_rank", F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first", "_n")
    ranked = stage(ranked, "ranked-names")

    struck = None
    while True:
        named = _numbered(ranked, base, struck, out, block_ranks)
        claims = named.groupBy(out).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_winner"))
        clashes = claims.where("_n > 1").select(out, "_winner")
        losers = (
            named.join(clashes, out)
            .where(F.col(order) != F.col("_winner"))
            .select(base, F.col("_number").alias("_struck"))
            .distinct()
        )
        losers, seen = stage_measured(losers, "struck-names", rows=F.count(F.lit(1)))
        if seen["rows"] == 0:
            return named.drop("_rank", "_number")
        struck = stage((losers if struck is None else struck.union(losers)).distinct(), "struck-names")


def _numbered(ranked: DataFrame, base: str, struck: DataFrame | None, out: str, block_ranks: int) -> DataFrame:
    if struck is None:
        return _named(ranked.withColumn("_number", F.col("_rank")), base, out)
    return stage(_named(_past_struck(ranked, base, struck, block_ranks), base, out), "named")


def _past_struck(ranked: DataFrame, base: str, struck: DataFrame, block_ranks: int) -> DataFrame:
    """``_number``: the ``_rank``-th number of a name that is not struck.

    The i-th struck number s has s - i free ones below it, so it is passed by the ranks above s - i:
    a rank moves up by the largest such i. Ranks meet the struck numbers of their own block of ranks;
    one row per block carries on what the blocks before it passed.
    """
    placed, _ = with_position(struck, [base, "_struck"], "_at")
    firsts = placed.groupBy(base).agg(F.min("_at").alias("_first"))
    passed = (F.col("_at") - F.col("_first") + 1).alias("_passed")
    jumps = placed.join(firsts, base).select(base, "_struck", passed)
    jumps = jumps.groupBy(base, (F.col("_struck") - F.col("_passed")).alias("_free")).agg(F.max("_passed").alias("_passed"))
    block = F.floor(F.col("_free") / block_ranks).cast("bigint")
    jumps = stage(jumps.withColumn("_block", block), "struck-ranks")
    ranked = ranked.withColumn("_free", F.col("_rank") - 1).withColumn("_block", block)

    later = ranked.where("_block > 0").select(base, "_block").distinct().withColumn("_passed", F.lit(None).cast("bigint"))
    blocks = jumps.select(base, "_block", "_passed").union(later).groupBy(base, "_block").agg(F.max("_passed").alias("_passed"))
    earlier = Window.partitionBy(base).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(base, "_block", F.max("_passed").over(earlier).alias("_before")).where("_before IS NOT NULL")

    own = Window.partitionBy(base, "_block").orderBy("_free").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = ranked.unionByName(jumps, allowMissingColumns=True).withColumn("_inside", F.max("_passed").over(own))
    moved = F.coalesce(F.greatest("_inside", "_before"), F.lit(0))
    return (
        both.where("_rank IS NOT NULL")
        .join(blocks, [base, "_block"], "left")
        .withColumn("_number", F.col("_rank") + moved)
        .drop("_free", "_block", "_passed", "_inside", "_before")
    )


def _named(ranked: DataFrame, base: str, out: str) -> DataFrame:
    # A dot at the very front does not start an extension.
    stem = F.regexp_extract(base, r"(?s)^(.+?)(\.[^.]*)?$", 1)
    ext = F.regexp_extract(base, r"(?s)^.+?(\.[^.]*)?$", 1)
    text = F.concat(stem, F.lit(" ("), F.col("_number").cast("string"), F.lit(")"), ext)
    return ranked.withColumn(out, F.when(F.col("_number") == 1, F.col(base)).otherwise(text))
