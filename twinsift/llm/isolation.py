"""Quality rules and an isolation forest over their statistics.

Each text gets counts (words, symbols, repeated lines, repeated word runs and more). A rule statistic is
a ratio of counts beyond the rule's limit, in units of the limit, and 0 within it; so ordinary variation
is no oddity and ordinary rows share one place. Two base rules reject outright. The rest is judged by an isolation forest: trees that split a
random feature at a random value part an odd row from the others after few steps, so a short mean path
length marks it. The forest is grown on a bounded sample of rows, picked by hash; every row is scored.
The threshold is set on labelled rows: the lowest score that no more than ``FALSE_DROPS`` of the rows
labelled good reach and above which bad rows outnumber good ones; without such rows only the base rules
reject.

Null and empty texts have no words and fail the base rule, long texts are counted whole, repeated rows
are judged each, and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.llm.session import hash_share, map_batches, string
from twinsift.llm.words import SOLID, blocks, find_words, mix, windows
from twinsift.operators.storage import stage

WINDOW = 8
MIN_WORDS = 20
MOST_REPEAT_PERCENT = 30
# The forest: trees, rows per tree, and rows of the sample they are drawn from.
TREES = 128
TREE_ROWS = 128
SAMPLE_ROWS = 20_000
# Share of good rows that the threshold may reject.
FALSE_DROPS = 0.002
BINS = 10_000

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MORE = ["n_upper", "n_digits", "n_punct", "n_lines", "n_echo"]
# Limits of the rules; a ratio of at most the limit is ordinary.
LIMITS = {
    "symbols per word": 0.1,
    "duplicate lines per line": 0.5,
    "repeated words per word": 0.3,
    "capitals per character": 0.3,
    "digits per character": 0.3,
    "marks per word": 1.0,
    "words equal to the one before, per word": 0.1,
    "characters per word": 12.0,
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?"]] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[128:192] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether the same owner has it again, and whether it had it before."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    v, o = values[order], owner[order]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    again, before = np.zeros(len(v), bool), np.zeros(len(v), bool)
    again[:-1] = same
    before[1:] = same
    several, earlier = np.empty(len(v), bool), np.empty(len(v), bool)
    several[order], earlier[order] = again | before, before
    return several, earlier


def block_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of the texts in one block."""
    words = find_words(data, offsets, SOLID, lower=False)
    texts = len(offsets) - 1
    count = np.diff(words.offsets)
    solid = SOLID[data] & ~_CONTINUES[data]
    out = {
        "n_words": count,
        "word_chars": _sums(solid, offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_upper": _sums(_UPPER[data], offsets),
        "n_digits": _sums(_DIGIT[data], offsets),
        "n_punct": _sums(_PUNCT[data], offsets),
    }
    # Lines: split at every line break, so a text has one more line than breaks. Only those with a word count.
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    owner = np.concatenate([np.arange(texts), np.searchsorted(offsets, breaks, side="right") - 1])
    owner.sort()
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[-1:] = len(data)
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else np.zeros(0, np.int64)
    ends[last] = offsets[1:]
    with_word = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    used = with_word[ends] > with_word[starts]
    starts, ends, owner = starts[used], ends[used], owner[used]
    lines = find_lines(data, starts, ends)
    _, earlier = _repeats(lines, owner)
    out["n_dup_lines"] = np.bincount(owner[earlier], minlength=texts)
    out["n_lines"] = np.bincount(owner, minlength=texts)

    text_of = np.repeat(np.arange(texts), count)
    echo = np.zeros(len(words.hashes), bool)
    echo[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text_of[1:] == text_of[:-1])
    out["n_echo"] = _sums(echo, words.offsets)
    hashes, bounds = windows(words.hashes, words.offsets, WINDOW)
    per_text = np.diff(bounds)
    several, _ = _repeats(hashes, np.repeat(np.arange(texts), per_text))
    first = np.repeat(words.offsets[:-1] - bounds[:-1], per_text) + np.arange(len(hashes))
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, first[several], 1)
    np.add.at(cover, first[several] + WINDOW, -1)
    out["n_repeat_words"] = _sums(np.cumsum(cover[:-1]) > 0, words.offsets)
    return out


def find_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs ``starts..ends``."""
    bounds = np.concatenate([starts, [len(data)]]) if len(starts) else np.zeros(1, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64)
    marks = np.zeros(256, bool)
    marks[:] = True
    marks[10] = False
    # As every byte but the line break is a member, a line is the word that starts where it starts.
    pieces = find_words(data, np.unique(np.concatenate([[0], bounds, ends])), marks, lower=False)
    return pieces.hashes[np.searchsorted(pieces.starts, starts)]


def with_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and all counts, one row per document. Narrow."""
    names = _COUNTS + _MORE
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), string("text").alias("text"))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        parts: dict[str, list[np.ndarray]] = {name: [] for name in names}
        for _, _, data, offsets in blocks(batch.column(1)):
            for name, values in block_counts(data, offsets).items():
                parts[name].append(values.astype(np.int64))
        return [pa.array(np.concatenate(parts[name])) for name in names]

    return map_batches(docs, compute, [T.StructField(name, T.LongType()) for name in names]).drop("text")


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """How far each rule's ratio lies beyond its limit, in units of the limit: rows by ``LIMITS``."""
    c = {name: np.asarray(values, float) for name, values in counts.items()}
    words, chars, lines = (np.maximum(c[name], 1) for name in ("n_words", "word_chars", "n_lines"))
    ratios = [
        c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars,
        c["n_digits"] / chars, c["n_punct"] / words, c["n_echo"] / words, c["word_chars"] / words,
    ]
    return np.column_stack([np.maximum(r / limit - 1, 0) for r, limit in zip(ratios, LIMITS.values())])


@dataclass
class Forest:
    """Trees as flat arrays, a row of each per tree: feature (-1: leaf), split value, children, path length at leaves."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    scale: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, higher for rows that are parted sooner."""
        total = np.zeros(len(rows))
        for t in range(len(self.feature)):
            at = np.zeros(len(rows), np.int64)
            while True:
                feature = self.feature[t, at]
                inner = np.flatnonzero(feature >= 0)
                if not len(inner):
                    break
                go_left = rows[inner, feature[inner]] < self.value[t, at[inner]]
                at[inner] = np.where(go_left, self.left[t, at[inner]], self.right[t, at[inner]])
            total += self.path[t, at]
        return 2.0 ** (-total / len(self.feature) / self.scale) if len(self.feature) else np.full(len(rows), 0.5)


def _average_path(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    random = np.random.default_rng(seed)
    size = min(tree_rows, len(rows))
    deepest = max(1, int(np.ceil(np.log2(max(size, 2)))) + 4)
    grown = []
    for _ in range(trees if size else 0):
        nodes: list[list[float]] = []

        def build(part: np.ndarray, depth: int) -> int:
            here = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + _average_path(len(part))])
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth < deepest and len(part) > 1 and len(open_):
                feature = int(random.choice(open_))
                value = float(random.uniform(low[feature], high[feature]))
                below = part[:, feature] < value
                if below.any() and not below.all():
                    left, right = build(part[below], depth + 1), build(part[~below], depth + 1)
                    nodes[here] = [feature, value, left, right, 0.0]
            return here

        build(rows[random.choice(len(rows), size, replace=False)], 0)
        grown.append(np.array(nodes))
    width = max((len(n) for n in grown), default=1)
    table = np.zeros((len(grown), width, 5))
    table[:, :, 0] = -1
    for t, nodes in enumerate(grown):
        table[t, : len(nodes)] = nodes
    return Forest(
        table[:, :, 0].astype(np.int64), table[:, :, 1], table[:, :, 2].astype(np.int64), table[:, :, 3].astype(np.int64),
        table[:, :, 4], max(_average_path(size), 1e-9),
    )


def _scored(counts: DataFrame, forest: Broadcast) -> DataFrame:
    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        columns = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in _COUNTS + _MORE}
        return [pa.array(forest.value.score(features(columns)))]

    return map_batches(counts, compute, [T.StructField("score", T.DoubleType())])


def _threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The score above which rows are rejected, from a histogram of all labelled rows that pass the base rules."""
    quality = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    quality = quality.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    cell = F.floor(F.col("score") * BINS).cast("int").alias("cell")
    judged = scored.where(~F.col("base_failed")).join(quality, "doc_id").groupBy(cell).agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad"),
    )
    cells = sorted(judged.collect(), key=lambda row: -row.cell)
    total = sum(row.good for row in cells)
    best, good, bad = 2.0, 0, 0
    for row in cells:
        good, bad = good + row.good, bad + row.bad
        if good > FALSE_DROPS * total:
            break
        if bad > good:
            best = row.cell / BINS
    return best


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: ``doc_id``, the counts, ``base_failed``, ``score``, ``kept``."""
    spark = docs.sparkSession
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    counts = stage(with_counts(docs).withColumn("base_failed", failed), "counts")
    names = _COUNTS + _MORE
    passed = counts.where(~F.col("base_failed"))
    sample = passed.where(hash_share(F.col("doc_id"), sample_rows, passed.count())).orderBy(F.xxhash64(*names), *names).limit(sample_rows).select(*names)
    rows = sample.collect()
    table = {name: np.array([row[name] for row in rows], float) for name in names}
    forest = spark.sparkContext.broadcast(grow(features(table)))
    scored = stage(_scored(counts, forest), "scored")
    limit = _threshold(scored, labels)
    return scored.select(
        "doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.col("score") < limit)).alias("kept"), "score"
    )
