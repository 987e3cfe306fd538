"""Benchmark decontamination with suffix arrays over the training texts.

The training texts are cut into shards, each a run of whole documents inside one task. A shard's
words become a sequence of 64-bit hashes, with a mark between documents, and its suffixes are sorted
by prefix doubling until the order holds for at least ``window`` words. Every suffix of every test
item is then binary-searched, in all shards. A range in the array lists the places of the item's next
``window`` words; places that continue each other are joined to the longest verbatim matches, and each
match is compared word by word as text before it counts.

The test items are a query set: they are sent to the tasks in blocks of bounded size, and every block
meets all training rows, so a large set costs passes, not memory.

A document word inside any match is hit; an item of fewer than ``window`` words is one window. Texts
without words (null, empty) hit nothing, items without words match nothing, repeated rows are judged
each, and an empty table on either side gives no hits. Items without an id count as hits but are not named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.llm.session import map_batches, string
from twinsift.llm.words import ALNUM, blocks, find_words
from twinsift.operators.storage import stage

WINDOW = 10
# Bytes of training text in one suffix array, whole documents each.
SHARD_BYTES = 1 << 20
# Most bytes of benchmark text that travel to the tasks at once.
QUERY_BYTES = 8 << 20
# Blocks of queries that meet the texts in one job; longer query sets are cut by written tables.
QUERY_PASSES = 4

_MATCH = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("item_start", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
_ADDED = [
    T.StructField("__n_words", T.LongType()),
    T.StructField("__n_hit", T.LongType()),
    T.StructField("__items", T.ArrayType(T.LongType())),
    T.StructField("__matches", T.ArrayType(_MATCH)),
]
_MATCHES = pa.list_(pa.struct([(f.name, pa.int64()) for f in _MATCH.fields]))


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``sequence`` sorted by the next ``depth`` values at least (by all, where fewer are left)."""
    _, rank = np.unique(sequence, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order = np.argsort(rank)
    step = 1
    while step < depth:
        following = np.zeros_like(rank)
        following[:-step] = rank[step:]
        key = rank * (len(rank) + 1) + following
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.ones(len(order), np.int64)
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == len(rank):
            break
        step *= 2
    return order


def search(sequence: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) place in ``order`` of the suffixes that begin with each row of ``queries``."""
    padded = np.concatenate([sequence, np.zeros(queries.shape[1], np.uint64)])

    def bound(after_equal: bool) -> np.ndarray:
        low = np.zeros(len(queries), np.int64)
        high = np.full(len(queries), len(order), np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high) // 2
            at = order[np.minimum(middle, len(order) - 1)]
            less = np.zeros(len(queries), bool)
            equal = np.ones(len(queries), bool)
            for k in range(queries.shape[1]):
                value = padded[at + k]
                less |= equal & (value < queries[:, k])
                equal &= value == queries[:, k]
                if not equal.any():
                    break
            right = open_ & (less | (equal & after_equal))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)

    return bound(False), bound(True)


class Queries:
    """Test items as word hashes: for each window length, the windows and where they come from."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.ids = [item for item, _ in items]
        found = []
        for _, _, data, offsets in blocks(pa.array([text for _, text in items], pa.string()), 1 << 62):
            found.append(find_words(data, offsets, ALNUM))
        self.words: list[list[bytes]] = []
        by_length: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for item in range(len(items)):
            first, last = found[0].offsets[item : item + 2]
            hashes = found[0].hashes[first:last]
            self.words.append(found[0].text(first, last))
            size = min(window, len(hashes))
            for start in range(len(hashes) - size + 1 if size else 0):
                by_length.setdefault(size, []).append((item, start, hashes[start : start + size]))
        self.groups = [
            (size, np.array([w[:2] for w in rows], np.int64), np.array([w[2] for w in rows], np.uint64))
            for size, rows in by_length.items()
        ]


def find_matches(words, queries: Queries) -> list[list[tuple[int, int, int, int]]]:
    """For each text of a shard, its maximal matches: (item, item start, text start, length), in words."""
    texts = len(words.offsets) - 1
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(texts)]
    if not len(words.hashes) or not queries.groups:
        return out
    counts = np.diff(words.offsets)
    place = np.arange(len(words.hashes)) + np.repeat(np.arange(texts), counts)
    sequence = np.zeros(len(words.hashes) + texts, np.uint64)
    sequence[place] = words.hashes
    order = suffix_array(sequence, max(size for size, _, _ in queries.groups))
    text_starts = words.offsets[:-1] + np.arange(texts)
    for size, origin, rows in queries.groups:
        low, high = search(sequence, order, rows)
        many = high - low
        if not many.any():
            continue
        query = np.repeat(np.arange(len(rows)), many)
        ends = np.cumsum(many)
        at = order[np.arange(ends[-1]) + np.repeat(low - ends + many, many)]
        item, start = origin[query, 0], origin[query, 1]
        # On one diagonal of one item, places that follow each other belong to one longer match.
        sort = np.lexsort((at, at - start, item))
        at, item, start = at[sort], item[sort], start[sort]
        cut = np.ones(len(at), bool)
        cut[1:] = (item[1:] != item[:-1]) | (at[1:] - start[1:] != at[:-1] - start[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(cut)
        runs = np.diff(np.append(heads, len(at)))
        text = np.searchsorted(text_starts, at[heads], side="right") - 1
        for h, run, t in zip(heads.tolist(), runs.tolist(), text.tolist()):
            match = (int(item[h]), int(start[h]), int(at[h] - text_starts[t]), run + size - 1)
            out[t] += _verified(words, queries, t, match, size)
    return out


def _verified(words, queries: Queries, text: int, match: tuple[int, int, int, int], size: int) -> list[tuple]:
    """The match if its words are equal as text, else the parts of it that are and span a window."""
    item, item_start, start, length = match
    base = int(words.offsets[text]) + start
    theirs = queries.words[item][item_start : item_start + length]
    ours = words.text(base, base + length)
    if ours == theirs:
        return [match]
    parts, run = [], 0
    for k in range(length + 1):
        if k < length and ours[k] == theirs[k]:
            run += 1
            continue
        if run >= size:
            parts.append((item, item_start + k - run, start + k - run, run))
        run = 0
    return parts


def match_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``docs`` with ``__n_words``, ``__n_hit``, ``__items`` (sorted ids) and ``__matches`` added. Narrow on ``docs``."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), string("text").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // query_bytes))
    columns = docs.columns
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for part in range(parts):
        if part and part % QUERY_PASSES == 0:
            docs = stage(docs, "matched")
        rows = [(r.item_id, r.text) for r in items.where(part_of == part).collect()]
        shared = spark.sparkContext.broadcast(Queries(rows, window))
        docs = _one_block(docs, columns, shared)
    return docs


def _one_block(docs: DataFrame, columns: list[str], shared: Broadcast) -> DataFrame:
    earlier = "__matches" in docs.columns
    if earlier:
        docs = docs.select(*columns, F.col("__matches").alias("__before"))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        queries: Queries = shared.value
        before = batch.column(batch.num_columns - 1).to_pylist() if earlier else [[]] * batch.num_rows
        n_words, n_hit, ids, matches = [], [], [], []
        text = batch.column(batch.schema.get_field_index("text"))
        for first, last, data, offsets in blocks(text, SHARD_BYTES):
            words = find_words(data, offsets, ALNUM)
            counts = np.diff(words.offsets)
            for k, found in enumerate(find_matches(words, queries)):
                own = [dict(zip(_MATCH.names, (queries.ids[m[0]], *m[1:]))) for m in found] + before[first + k]
                hit = np.zeros(int(counts[k]), bool)
                for m in own:
                    hit[m["start"] : m["start"] + m["length"]] = True
                n_words.append(int(counts[k]))
                n_hit.append(int(hit.sum()))
                ids.append(sorted({m["item_id"] for m in own if m["item_id"] is not None}))
                matches.append(own)
        return [
            pa.array(n_words, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array(ids, pa.list_(pa.int64())),
            pa.array(matches, _MATCHES),
        ]

    found = map_batches(docs, compute, _ADDED)
    return found.drop("__before") if earlier else found


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``matches``."""
    found = match_items(docs.select("doc_id", "text"), items, window)
    names = F.array_join(F.array_sort(F.transform("__items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"),
        F.col("__matches").alias("matches"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that share ``window`` consecutive words with an item. Columns stay."""
    return match_items(docs, items, window).where(F.col("__n_hit") == 0).select(*docs.columns)
