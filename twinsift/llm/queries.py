"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.cluster import ship
from twinsift.llm.chat import digest, examples
from twinsift.llm.chosen_path import near_duplicates
from twinsift.llm.factors import remove_repeats
from twinsift.llm.isolation import judge
from twinsift.llm.licenses import scan_licenses
from twinsift.llm.line_spread import dedup_lines
from twinsift.llm.packing import pack
from twinsift.llm.piece_table import render, restore, transform
from twinsift.llm.pii import personal_data
from twinsift.llm.session import prepare, table
from twinsift.llm.suffixes import contamination
from twinsift.llm.token_store import read_store, write_store
from twinsift.llm.toxicity import scores
from twinsift.llm.whitening import whiten
from twinsift.operators.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
PIECE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, PIECE_TOKENIZER)
    return read_store(spark, path)


def op2_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("matches")


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op7_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string"
    )
    return digest(examples(given.unionByName(more)))


def op8_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cleaned.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op10_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return found.select("vec_id", *[F.col(c).alias(c.removeprefix("__")) for c in found.columns if c.startswith("__")])


def op12_relative_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op13_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = render(transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    kept = made.select(
        "doc_id", "__n", "__form", "__prefix_chars", "__middle_chars", "__output_sha256", "__output"
    )
    return restore(kept, with_text=False).select(
        "doc_id",
        F.col("__n").alias("n"),
        F.col("__form").alias("form"),
        F.col("__prefix_chars").alias("prefix_chars"),
        F.col("__middle_chars").alias("middle_chars"),
        F.col("__output_sha256").alias("output_sha256"),
        F.col("__restored_sha256").alias("restored_sha256"),
    )


def _ready(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        prepare(spark)
        return query(spark, sf_dir)

    return run


_ALL = [
    op1_token_store, op2_suffix_decontamination, op3_chosen_path, op4_license_index, op5_noisy_channel_toxicity,
    op6_boosted_pii, op7_prefix_targets, op8_site_spread, op9_harmonic_packing, op10_isolation_forest,
    op11_whitening, op12_relative_parsing, op13_piece_table,
]
QUERIES: dict[str, Query] = {query.__name__: _ready(query) for query in _ALL}
