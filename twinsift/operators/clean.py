"""Planning a clean-up: what goes, what stays, what is refused. Sources are never changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.paths import inside_root
from twinsift.operators.group import Grouping, scan
from twinsift.operators.lookup import HOT_ROWS, expand_join

PLAN_COLUMNS = ["path", "group_id", "bytes", "keeper"]


@dataclass
class CleanPlan:
    """``plan`` lists removals, ``rejected`` those the path guard refuses, ``retained`` what remains."""

    plan: DataFrame
    rejected: DataFrame
    retained: DataFrame
    grouping: Grouping
    _records: DataFrame

    def stats(self) -> DataFrame:
        return clean_stats(self._records, self.grouping.groups, self.plan, self.rejected)


def plan_deletions(
    records: DataFrame, groups: DataFrame, members: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Members other than the keeper, of groups that may be removed without a look.

    ``members(group_id, path, keeper)`` may come from elsewhere than ``records``; a path the records
    do not know counts zero bytes.
    """
    allowed = groups.where("auto_deletable").select("group_id", "n_members")
    size = records.select("path", F.col("bytes").alias("_bytes"))
    surplus = members.where(F.col("path") != F.col("keeper"))
    planned = expand_join(surplus, allowed, "group_id", "n_members", hot_rows=hot_rows)
    return (
        planned.select("path", "group_id", "keeper")
        .join(size, "path", "left")
        .select("path", "group_id", F.coalesce("_bytes", F.lit(0)).alias("bytes"), "keeper")
    )


def plan_clean(
    records: DataFrame, strictness: str = "pixel", root: str | None = None, **tuning
) -> CleanPlan:
    """Plan the removal of exact or pixel duplicates of a freshly indexed table.

    Perceptual groups are never planned: similarity is not transitive and needs a human look.
    Targets outside ``root`` or with odd path segments are refused, not removed.
    """
    if strictness not in ("exact", "pixel"):
        raise ValueError("clean works on 'exact' or 'pixel' groups only")
    grouping = scan(records, strictness, **tuning)
    # Every member is a record and carries its size, so no second lookup is needed here.
    planned = grouping.members.where(~F.col("is_keeper")).select(*PLAN_COLUMNS)
    safe = inside_root("path", root)
    plan = planned.where(safe)
    return CleanPlan(
        plan, planned.where(~safe), records.join(plan.select("path"), "path", "left_anti"), grouping, records
    )


def clean_stats(records: DataFrame, groups: DataFrame, plan: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: records, auto-deletable groups, planned and refused removals, bytes to gain."""
    count = F.count(F.lit(1))
    parts = [
        records.agg(count.alias("scanned")),
        groups.where("auto_deletable").agg(count.alias("groups")),
        plan.agg(count.alias("planned"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("reclaimable_bytes")),
        rejected.agg(count.alias("rejected")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def reconcile(records: DataFrame, removed: DataFrame, strictness: str, threshold: int | None = None) -> Grouping:
    """Group again without the paths that were removed."""
    rest = records.join(removed.select("path"), "path", "left_anti")
    return scan(rest, strictness, threshold)
