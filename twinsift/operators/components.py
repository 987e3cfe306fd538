"""Connected components by repeated local contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.operators.lookup import HOT_ROWS, expand_join
from twinsift.operators.storage import stage, stage_measured

# On edge tables up to this length a round looks three steps far instead of one: starting a round
# costs more than its rows, and fewer rounds are needed. On longer tables one step moves least data.
SHORT_TABLE = 5_000_000
# So few edges (a few megabytes, however long the first table was) are finished by one task instead of further rounds.
LAST_EDGES = 100_000


def connected_components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)`` for every node that has an edge.

    Each round, every node moves to the node with the lowest random rank within a step or three, and
    the edges move along; loops and repeats vanish. A move never leaves the component and never tears
    one apart, so when no edge is left the composed moves are the answer.
    With a fresh random rank per round the graph shrinks by a constant factor, so all rounds
    together cost about as much as the first, also on long chains.

    Rounds end once a task can hold what is left: at most ``LAST_EDGES`` edges.

    The only group-wise step is a minimum with map-side combine, so a node with a third of all
    edges is one small row per task. Edges find their node's move through a salted join.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    rows = F.count(F.lit(1))
    edges, seen = stage_measured(edges, "edges", rows=rows)
    if seen["rows"] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    moves: list[tuple[DataFrame, int]] = []
    while seen["rows"] > LAST_EDGES:
        hops = 3 if seen["rows"] <= SHORT_TABLE else 1
        step = _moves(edges, len(moves), hops, 2 * seen["rows"], hot_rows)
        step, size = stage_measured(step, "moves", rows=rows, degree=F.max("degree"))
        moves.append((step, size["rows"]))
        edges, seen = stage_measured(_follow(edges, step, size["degree"], hot_rows), "edges", rows=rows)
    if seen["rows"]:
        last, size = stage_measured(_finish(edges), "last-moves", rows=rows)
        moves.append((last, size["rows"]))
    return _compose(moves, hot_rows)


def _finish(edges: DataFrame) -> DataFrame:
    """Each node's target, its component, by merging a short edge table in one task."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def top(node):
            while parent.setdefault(node, node) != node:
                parent[node] = node = parent[parent[node]]
            return node

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = top(a), top(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        columns = [pa.array(nodes, kind), pa.array([top(node) for node in nodes], kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "target"])

    own = edges.schema["a"].dataType
    kind = pa.string() if isinstance(own, T.StringType) else pa.int64()
    schema = T.StructType([T.StructField("node", own), T.StructField("target", own)])
    return edges.select("a", "b").coalesce(1).mapInArrow(merge, schema)


def _moves(edges: DataFrame, turn: int, hops: int, most: int, hot_rows: int) -> DataFrame:
    """Each node's target: the node of lowest rank within ``hops`` steps."""
    ends = [F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in ("ab", "ba")]
    both = edges.select(F.explode(F.array(*ends)).alias("_e")).select("_e.node", "_e.other")
    rank = lambda c: F.xxhash64(c, F.lit(turn))

    def lower(mine: str, theirs: str) -> Column:
        return F.when(rank(theirs) < rank(mine), F.col(theirs)).otherwise(F.col(mine))

    step = both.groupBy("node").agg(
        F.min_by("other", rank("other")).alias("_best"), F.count(F.lit(1)).alias("degree")
    ).select("node", lower("node", "_best").alias("target"), "degree")
    for _ in range(hops - 1):
        reached = step.select(F.col("node").alias("other"), F.col("target").alias("_via"), "degree")
        seen = expand_join(both, reached, "other", "degree", max_weight=most, hot_rows=hot_rows)
        # The neighbours' targets cover everything one step farther than their own reach.
        best = seen.groupBy("node").agg(
            F.min_by("_via", rank("_via")).alias("_best"), F.count(F.lit(1)).alias("degree")
        )
        step = best.select("node", lower("node", "_best").alias("target"), "degree")
    return step


def _follow(edges: DataFrame, step: DataFrame, degree: int, hot_rows: int) -> DataFrame:
    for end in ("a", "b"):
        to = step.select(F.col("node").alias(end), F.col("target").alias(f"_{end}"), "degree")
        edges = expand_join(edges, to, end, "degree", max_weight=degree, hot_rows=hot_rows).drop("degree")
    moved = edges.where(F.col("_a") != F.col("_b"))
    return moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()


def _compose(moves: list[tuple[DataFrame, int]], hot_rows: int) -> DataFrame:
    """Chain the rounds from the last to the first; tables grow back to full size only at the end."""
    last, _ = moves[-1]
    final = last.select("node", F.col("target").alias("component"))
    for step, rows in reversed(moves[:-1]):
        if rows > hot_rows:
            followers = step.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
            final = stage(final.withColumnRenamed("node", "target").join(followers, "target"), "chained")
        else:
            final = final.withColumnRenamed("node", "target").withColumn("n", F.lit(1))
        final = expand_join(
            step.select("node", "target"), final, "target", "n", how="left", max_weight=rows,
            hot_rows=hot_rows,
        ).select("node", F.coalesce("component", "target").alias("component"))
    return final
