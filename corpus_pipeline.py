"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each result as
Parquet below ``spark.checkpoint.dir`` and reads it again as the next stage's documents. All stages but
the last return the columns of ``documents``.

1. toxicity: documents that score as toxic go.
2. line_dedup: lines that many sites carry stay in their first place only. A document that consisted of
   nothing else is text found elsewhere and goes.
3. near_dedup: one document of each group of near duplicates stays.
4. decontamination: documents that share ten consecutive words with a benchmark item go.
5. packing: what is left becomes sequences of at most 4,096 tokens, one row per piece with its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinsift.cluster import ship
from twinsift.llm.chosen_path import keep_one
from twinsift.llm.line_spread import remove_boilerplate
from twinsift.llm.packing import pack
from twinsift.llm.queries import WORD_TOKENIZER
from twinsift.llm.session import prepare, table
from twinsift.llm.suffixes import decontaminate
from twinsift.llm.toxicity import drop_toxic
from twinsift.operators.storage import stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return remove_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return pack(docs, WORD_TOKENIZER, with_ids=True)


def _ready(spark: SparkSession) -> None:
    ship(spark)
    prepare(spark)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
# Tokens, learned scores and bins cannot be put as SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
