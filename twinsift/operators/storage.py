"""Writing intermediate tables to the cluster's shared folder.

Iterative jobs and tables used more than once are written as Parquet below ``spark.checkpoint.dir``
and read back. That cuts lineage on storage that outlives any executor, gives the optimizer real
file sizes for its join choices, and keeps column pruning and filter pushdown for every reader.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CONF = "spark.checkpoint.dir"
_local_fallback: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Only a one-process session may make its own."""
    configured = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_CONF} to a folder that the driver and every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_fallback:
        _local_fallback[app] = tempfile.mkdtemp(prefix="twinsift-")
    return _local_fallback[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/twinsift-{app}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession) -> bool:
    """Delete the intermediate tables of this application. Results that still read them fail afterwards."""
    return remove(spark, f"{scratch_root(spark)}/twinsift-{spark.sparkContext.applicationId}")


def remove(spark: SparkSession, folder: str) -> bool:
    """Delete one folder that this application has made."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` once, keep the result as Parquet in the shared folder and return a reader of it."""
    return _write(df, df, name)


def stage_measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`stage`, with aggregates observed while writing. They cost no job of their own."""
    seen = Observation()
    observed = df.observe(seen, *[column.alias(key) for key, column in metrics.items()])
    staged = _write(observed, df, name)
    return staged, {key: value or 0 for key, value in seen.get.items()}


def _write(df: DataFrame, plain: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(plain.schema).parquet(path)
