"""License scan with a positional index of rare words.

The index maps each word of the licence notices to its places in them. A text's licence words are
looked up, and every hit proposes an alignment: notice and position where it would start. Alignments
collect the notice's other words at their relative places, weighted by how rare the words are in the
corpus; only those that hold one of the notice's rarest words count. A label is given where an
alignment reaches ``COVER`` of the notice's weight and all words of its mandatory key phrase stand in
place. The base phrases are in the same index as notices that are all key, so their places are counted
exactly.

Everything is DataFrame functions. The pass over the texts keeps only the few licence words of each
text; function words are no licence words. Document frequencies cover all texts.

Null texts are empty ones and have no words; texts are read whole; repeated rows are scanned each; equal
weights rank by word; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.llm.session import string
from twinsift.operators.storage import stage

COVER = 0.5
# Rarest words of a notice of which an alignment needs one.
ANCHORS = 3

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Usual wordings of licence notices, their label and their mandatory key phrase.
NOTICES = [
    ("released under the mit license", "mit", "mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", "permission is hereby granted free of charge"),
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license version 2 0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3", "gnu general public license version 3"),
    ("gnu lesser general public license", "lgpl", "lesser general public license"),
    ("gnu affero general public license", "agpl", "affero general public license"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "cc by nc 4 0"),
    ("licensed under cc by 4 0", "cc-by-4.0", "cc by 4 0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "cc by sa 4 0"),
    ("creative commons attribution license", "cc", "creative commons attribution"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "redistribution and use in source and binary forms"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0", "mozilla public license"),
    ("eclipse public license v 2 0", "epl-2.0", "eclipse public license"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "free and unencumbered software"),
    ("all rights reserved", "all-rights-reserved", "all rights reserved"),
]
# Words too common to be looked up; their places are not compared.
FUNCTION_WORDS = {"the", "of", "to", "is", "a", "in", "and", "or", "by", "this", "with", "are", "any", "all", "into", "use"}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words before lower-casing: digits, letters a-z in either case, everything beyond ASCII.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _postings() -> list[tuple[int, str, bool, str, int, bool]]:
    """Rows of the index: notice, label, base, word, place, key."""
    rows = []
    notices = [(text, label, text, True) for text, label in BASE.items()] + [(*n, False) for n in NOTICES]
    for number, (text, label, key, base) in enumerate(notices):
        words, inner = text.split(), key.split()
        first = next(i for i in range(len(words)) if words[i : i + len(inner)] == inner)
        for place, word in enumerate(words):
            if word not in FUNCTION_WORDS:
                rows.append((number, label, base, word, place, first <= place < first + len(inner)))
    return rows


def license_words() -> list[str]:
    return sorted({row[3] for row in _postings()})


def _found(text: Column) -> Column:
    """``pos`` and ``word`` of every licence word of a text."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    marked = F.transform(
        words,
        lambda w, i: F.when(
            F.translate(w, _UPPER, _LOWER).isin(license_words()),
            F.struct(i.alias("pos"), F.translate(w, _UPPER, _LOWER).alias("word")),
        ),
    )
    any_word = text.rlike("(?i)(?<![0-9a-z])(?:" + "|".join(license_words()) + ")(?![0-9a-z])")
    return F.when(any_word, F.filter(marked, lambda x: x.isNotNull()))


def scan_licenses(docs: DataFrame, cover: float = COVER, anchors: int = ANCHORS) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, base places and labels, ``labels``, ``score``."""
    spark = docs.sparkSession
    text = string("text")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("n_words"),
        _found(text).alias("found"),
    )
    # Numbered while written, so that a row keeps its number whoever reads it.
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "license-words")
    hits = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.pos", "f.word")

    texts = rows.count()
    often = hits.select("row", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    index = spark.createDataFrame(_postings(), "notice int, label string, base boolean, word string, place int, key boolean")
    # Bounded by the fixed notices: about a hundred rows.
    rarity = F.log(F.lit(texts + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 0.01
    index = index.join(F.broadcast(often), "word", "left").withColumn("weight", rarity)
    per_notice = Window.partitionBy("notice")
    rank = F.dense_rank().over(per_notice.orderBy(F.desc("weight"), "word"))
    index = index.select(
        "notice", "label", "base", "word", "place", "key", "weight",
        (rank <= anchors).alias("anchor"),
        F.sum("weight").over(per_notice).alias("full"),
        F.sum(F.col("key").cast("int")).over(per_notice).alias("keys"),
    )
    index = stage(index.coalesce(1), "license-index")

    aligned = hits.join(F.broadcast(index), "word").withColumn("start", F.col("pos") - F.col("place"))
    aligned = aligned.groupBy("row", "notice", "start").agg(
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        (F.sum("weight") / F.first("full")).alias("share"),
        (F.sum(F.col("key").cast("int")) == F.first("keys")).alias("complete"),
        F.max("anchor").alias("anchored"),
    )
    aligned = aligned.where("anchored")
    placed = F.col("base") & F.col("complete")
    labelled = F.col("complete") & ((F.col("share") >= cover) | F.col("base"))
    per_row = aligned.groupBy("row").agg(
        F.sum(placed.cast("bigint")).alias("n_base"),
        F.min(F.when(placed, F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(placed, F.col("start"))).cast("bigint").alias("last_word"),
        F.array_sort(F.collect_set(F.when(placed, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(labelled, F.col("label")))).alias("labels"),
        F.max(F.when(labelled, F.col("share")).otherwise(F.col("share") / 2)).alias("score"),
    )
    out = rows.select("row", "doc_id", "n_words").join(per_row, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce(F.array_join("base_labels", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"),
        F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)).alias("score"),
    )
