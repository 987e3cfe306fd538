"""Joining many rows to one row per key when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key with more rows than this is spread over several tasks.
HOT_ROWS = 2_000_000
# Most hot keys that are broadcast; a longer list is joined like any other table.
MAX_HOT_KEYS = 200_000
_SALT = "_salt"
_PARTS = "_parts"


def expand_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    weight: str,
    how: str = "inner",
    max_weight: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left JOIN right`` where ``right`` has one row per key and knows the key's row count in ``left``.

    Keys whose ``weight`` passes ``hot_rows`` are salted: their ``left`` rows are spread over
    ``ceil(weight / hot_rows)`` sub-keys and the single ``right`` row is repeated that often. The
    hot keys are counted first: up to ``MAX_HOT_KEYS`` are broadcast, a longer list is joined by key.
    All other rows join as usual. No row is dropped or capped.

    ``max_weight`` is a known upper bound of ``weight`` (the row count of ``left`` is one); where it
    rules out hot keys, they are not searched for.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if max_weight is not None and max_weight <= hot_rows:
        return left.join(right, keys, how)
    hot_keys = right.where(F.col(weight) > hot_rows).count()
    if hot_keys == 0:
        return left.join(right, keys, how)
    parts = F.ceil(F.col(weight) / hot_rows).cast("int")
    hot = right.where(F.col(weight) > hot_rows).select(*keys, parts.alias(_PARTS))

    hot = F.broadcast(hot) if hot_keys <= MAX_HOT_KEYS else hot
    spread = F.pmod(F.xxhash64(*_cheap_columns(left)), F.col(_PARTS).cast("bigint")).cast("int")
    salted = (
        left.join(hot, keys, "left").withColumn(_SALT, F.coalesce(spread, F.lit(0))).drop(_PARTS)
    )
    last = F.coalesce(F.col(_PARTS), F.lit(1)) - 1
    copies = (
        right.join(hot, keys, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), last)))
        .drop(_PARTS)
    )
    return salted.join(copies, [*keys, _SALT], how).drop(_SALT)


def _cheap_columns(df: DataFrame) -> list[str]:
    """Columns to derive a salt from: everything but raw bytes and nested values."""
    heavy = (T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, heavy)]
