"""Substring deduplication by relative Lempel-Ziv parsing.

A word goes where it lies in a window of ``window`` words that a document with a smaller ``doc_id`` has as well. Such
windows are found by parsing documents into factors, greedily the longest matches with indexed reference text. A factor
of a window or more is a duplicate span. A window that lies in no single factor crosses exactly one factor boundary (a
greedy factor that begins inside a matching window reaches its end), so only there, and only where both factors together
are long enough, single windows are looked up.

No document can be parsed against all text of a large corpus, nor need it be. The corpus is indexed in reference blocks
by content: from every window the word run of :data:`GRAM` words with the least hash is taken as its anchor, the same in
each document that has the window. The words of all windows with one anchor (a passage) are sent to the anchor's block,
so a document meets exactly those blocks that can hold a match, and each window is looked for once.

1. Anchors are found in one pass; those of a single document are dropped by a map-side combined aggregate.
2. Copies of a passage are aggregated to the one of the smallest ``doc_id``. All others match it as a whole; no text moves.
3. What is left of anchors with several different passages is cut from its documents and grouped by anchor. A block
   holds whole anchors, in a suffix array with longest-match lengths towards smaller documents; passages are parsed on it.
4. An anchor with more than ``most`` different passages, found in ever new contexts, would make a block without bound.
   Its windows are compared one by one instead, as an aggregate of the smallest ``doc_id`` by window.
5. Spans of a document are gathered and cut out.

Passages are told apart by the 64-bit hash of the anchor and another of the whole passage; parsing compares words. Windows
of step 4 have 128 bits. Rows are known by ``doc_id`` and a hash of their text.

Null and empty texts and those below a window have nothing to remove; null texts stay null. Rows with equal ``doc_id`` do
not remove words from each other, but both give to and take from other documents. A null ``doc_id`` is neither smaller
nor larger than any, so such a row stays as it is. Texts of any length are parsed whole; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.llm.session import give_back, map_batches, string
from twinsift.llm.words import SOLID, blocks, find_words, runs, windows
from twinsift.operators.lookup import expand_join
from twinsift.operators.storage import stage, stage_measured

WINDOW = 50
GRAM = 16
# Passages of a reference block, and the most different passages of one anchor that are parsed in one block.
BLOCK = 4096
MOST = 16384
_KEY = ["doc_id", "version"]


# --- anchors -------------------------------------------------------------------------------------------------------


def least_of_runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` hashes the place of its least one, the last of equals."""
    best = np.arange(len(hashes), dtype=np.int32)
    span = 1

    def later(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return np.where(hashes[second] <= hashes[first], second, first)

    while span * 2 <= size:
        best = later(best[:-span], best[span:])
        span *= 2
    rest = size - span
    return later(best[:-rest], best[rest:]) if rest else best


def anchors(hashes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts given by word hashes: text, place in the text, gram hash, passage hash, words before and from it.

    A passage is determined by the words that windows with its anchor can cover, wherever they stand.
    """
    counts = np.diff(offsets)
    whole = counts >= window
    if not whole.any():
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int32, np.int64, np.int64, np.int32, np.int32))
    all_grams, _ = windows(hashes, np.array([0, len(hashes)]), gram)
    best = least_of_runs(all_grams, window - gram + 1)
    starts = np.zeros(len(best), np.int8)
    # Only runs of grams that lie within one text count.
    ends = offsets[1:][whole] - window
    np.add.at(starts, offsets[:-1][whole], 1)
    np.subtract.at(starts, (ends + 1)[ends + 1 < len(starts)], 1)
    own = np.flatnonzero(np.cumsum(starts, dtype=np.int8))
    # Windows with the same anchor follow each other.
    picked = best[own].astype(np.int64)
    turn = np.flatnonzero(np.diff(picked, prepend=-1))
    chosen = picked[turn]
    first, last = own[turn], own[np.append(turn[1:], len(own)) - 1] + window
    text = np.searchsorted(offsets, chosen, side="right") - 1
    passage = runs(hashes, first, last) + (chosen - first).astype(np.uint64)
    return (
        text,
        (chosen - offsets[text]).astype(np.int32),
        all_grams[chosen].view(np.int64),
        passage.view(np.int64),
        (chosen - first).astype(np.int32),
        (last - chosen).astype(np.int32),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("version"), string("text").alias("text"))


def find_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``doc_id, version, place, gram, passage, before, after``: one row per anchor of a document. Narrow."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "version", "place", "gram", "passage", "before", "after"]
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(2)):
                words = find_words(data, offsets, SOLID, lower=False)
                text, *found = anchors(words.hashes, words.offsets, window, gram)
                if len(text):
                    keys = [batch.column(c).slice(first, last - first).take(pa.array(text)) for c in range(2)]
                    yield pa.RecordBatch.from_arrays(keys + [pa.array(column) for column in found], names=names)
        give_back()

    schema = "doc_id bigint, version bigint, place int, gram bigint, passage bigint, before int, after int"
    return _keyed(docs).where(F.col("doc_id").isNotNull()).mapInArrow(find, schema)


# --- parsing -------------------------------------------------------------------------------------------------------


class ReferenceBlock:
    """A suffix array over passages, with the longest match of every place in a passage of a smaller document."""

    def __init__(self, passages: list[str], docs: np.ndarray):
        words = [passage.split(" ") for passage in passages]
        counts = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(counts + 1)])
        codes = pd.factorize(np.array([x for w in words for x in w], dtype=object))[0]
        place = np.arange(len(codes)) + np.repeat(np.arange(len(words)), counts)
        # Each passage ends in a sign of its own, so that no match reaches beyond it.
        signs = codes.max(initial=-1) + 1 + np.arange(int(self.starts[-1]))
        signs[place] = codes
        self.owner = np.repeat(docs, counts + 1)
        self.longest = self._longest_matches(signs, int(counts.max(initial=0)))

    def _longest_matches(self, signs: np.ndarray, most: int) -> np.ndarray:
        ranks = [np.unique(signs, return_inverse=True)[1].astype(np.int64)]
        while 1 << (len(ranks) - 1) < most:
            step, last = 1 << (len(ranks) - 1), ranks[-1]
            follower = np.zeros(len(last), np.int64)
            follower[:-step] = last[step:] + 1
            ranks.append(np.unique(last * (len(last) + 2) + follower, return_inverse=True)[1].astype(np.int64))
        order = np.argsort(ranks[-1], kind="stable")
        common = np.zeros(len(order), np.int64)
        a, b = order[:-1].copy(), order[1:].copy()
        for t in range(len(ranks) - 1, -1, -1):
            step, size = 1 << t, len(order)
            same = (a < size) & (b < size)
            same[same] = ranks[t][a[same]] == ranks[t][b[same]]
            common[1:] += np.where(same, step, 0)
            a, b = np.where(same, a + step, a), np.where(same, b + step, b)
        owner = self.owner[order]
        before = _towards_smaller(owner, common)
        after = _towards_smaller(owner[::-1], np.concatenate([[0], common[:0:-1]]))[::-1]
        longest = np.zeros(len(order), np.int64)
        longest[order] = np.maximum(before, after)
        return longest

    def parse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy factors of all passages: passage, place and length, in order. A word without a match is one of length 1."""
        at, ends = self.starts[:-1].copy(), self.starts[1:] - 1
        found = []
        active = np.flatnonzero(at < ends)
        while len(active):
            step = np.maximum(self.longest[at[active]], 1)
            found.append((active, at[active], step))
            at[active] += step
            active = active[at[active] < ends[active]]
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        passage, place, length = (np.concatenate(column) for column in zip(*found))
        order = np.argsort(place, kind="stable")
        return passage[order], place[order], length[order]

    def duplicate_spans(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans of a window or more that match smaller documents: passage, start and end within it."""
        passage, place, length = self.parse()
        long = length >= window
        spans = [(passage[long], place[long], length[long])]
        # A window across the boundary between two factors starts after the first one's start and ends in the second.
        joint = np.flatnonzero(passage[:-1] == passage[1:]) if len(passage) else np.zeros(0, np.int64)
        edge, right = place[joint + 1], length[joint + 1]
        low = np.maximum(place[joint] + 1, edge - window + 1)
        high = np.minimum(edge - 1, edge + right - window)
        many = np.maximum(high - low + 1, 0)
        ends = np.cumsum(many)
        if len(ends) and ends[-1]:
            start = np.arange(ends[-1]) + np.repeat(low - ends + many, many)
            hit = self.longest[start] >= window
            spans.append((np.repeat(passage[joint], many)[hit], start[hit], self.longest[start[hit]]))
        which, start, size = (np.concatenate(column) for column in zip(*spans))
        start = start - self.starts[which]
        return which, start, start + size


def _towards_smaller(owner: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place the words it shares with the nearest earlier place of a smaller owner; 0 without one.

    ``common[i]`` are the words shared by places ``i - 1`` and ``i``. Links to the previous place are replaced by the
    links of what they point to until each points to a smaller owner or shares nothing.
    """
    link = np.arange(-1, len(owner) - 1)
    shared = common.copy()
    shared[:1] = 0
    open_ = np.flatnonzero(shared > 0)
    while len(open_):
        open_ = open_[(shared[open_] > 0) & (owner[link[open_]] >= owner[open_])]
        via = link[open_]
        shared[open_], link[open_] = np.minimum(shared[open_], shared[via]), link[via]
    return shared


def _parse_blocks(window: int, block: int):
    """Arrow step over passages sorted by anchor: gathers whole anchors to blocks and parses each."""

    def spans_of(rows: pd.DataFrame) -> pa.RecordBatch | None:
        rows = rows.drop_duplicates(["gram", "passage"])
        which, start, end = ReferenceBlock(rows["words"].tolist(), rows["doc_id"].to_numpy(np.int64)).duplicate_spans(window)
        if not len(which):
            return None
        columns = [pa.array(rows[c].to_numpy(np.int64)[which]) for c in ("gram", "passage")]
        return pa.RecordBatch.from_arrays(
            columns + [pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["gram", "passage", "start", "end"]
        )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        count = 0
        for batch in batches:
            rows = batch.to_pandas()
            while len(rows):
                if count < block:
                    held.append(rows)
                    count += len(rows)
                    break
                # The block is full: it ends with the anchor that it holds last.
                own = rows["gram"].to_numpy() == held[-1]["gram"].iloc[-1]
                cut = len(own) if own.all() else int(np.argmin(own))
                if cut:
                    held.append(rows.iloc[:cut])
                if cut == len(own):
                    break
                found = spans_of(pd.concat(held, ignore_index=True))
                if found is not None:
                    yield found
                held, count, rows = [], 0, rows.iloc[cut:]
        if held:
            found = spans_of(pd.concat(held, ignore_index=True))
            if found is not None:
                yield found
        give_back()

    return parse


# --- the job -------------------------------------------------------------------------------------------------------


def _cut_passages(docs: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """Words of the wanted passages. Those of crowded anchors become windows: a row and two hashes for each."""
    names = ["gram", "passage", "doc_id", "words", "start", "window_a", "window_b"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            wants = batch.column(3).to_pylist()
            for first, last, data, offsets in blocks(batch.column(2)):
                words = find_words(data, offsets, SOLID, lower=False)
                out: list[list] = [[] for _ in names]
                for k in range(last - first):
                    key = (ids[first + k], versions[first + k])
                    if key in seen:
                        continue
                    seen.add(key)
                    base = int(words.offsets[k])
                    for w in wants[first + k]:
                        a, b = base + w["place"] - w["before"], base + w["place"] + w["after"]
                        if not w["crowded"]:
                            rows = [(b" ".join(words.text(a, b)).decode(), None, None, None)]
                        else:
                            own, n = words.hashes[a:b], np.arange(b - a - window + 1)
                            pair = [runs(h, n, n + window).view(np.int64).tolist() for h in (own, own * np.uint64(0x9E3779B97F4A7C15) ^ own)]
                            rows = [(None, i, *p) for i, p in enumerate(zip(*pair))]
                        for row in rows:
                            for column, value in zip(out, (w["gram"], w["passage"], key[0], *row)):
                                column.append(value)
                if out[0]:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], names=names)
        give_back()

    schema = "gram bigint, passage bigint, doc_id bigint, words string, start int, window_a bigint, window_b bigint"
    # A document's wanted passages are no more than its own anchors.
    each = wanted.groupBy(*_KEY).agg(F.collect_set(F.struct("gram", "passage", "place", "before", "after", "crowded")).alias("wants"))
    return _keyed(docs).join(each, _KEY).select(*_KEY, "text", "wants").mapInArrow(cut, schema)


def find_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``doc_id, version, spans``: word spans that smaller documents have too, for the documents that have any."""
    found, seen = stage_measured(find_anchors(docs, window, gram), "anchors", rows=F.count(F.lit(1)))
    repeated = found.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("rows"))
    repeated = stage(repeated.where("low < high").select("gram", "rows"), "repeated")
    places = stage(expand_join(found, repeated, "gram", "rows", max_weight=seen["rows"]).drop("rows"), "places")

    same = places.groupBy("gram", "passage").agg(
        F.min(F.struct(*_KEY, "place", "before", "after")).alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows")
    )
    same = stage(same.select("gram", "passage", "first.*", "last", "rows"), "passages")
    several = same.groupBy("gram").agg(F.count(F.lit(1)).alias("variants"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    several = stage(several.where("low < high").select("gram", "variants"), "several")
    wanted = expand_join(same, several, "gram", "variants").withColumn("crowded", F.col("variants") > most)
    cut = stage(_cut_passages(docs, wanted, window, gram), "cut")

    sent = cut.where(F.col("words").isNotNull()).select("gram", "passage", "doc_id", "words")
    parsed = sent.repartition("gram").sortWithinPartitions("gram").mapInArrow(
        _parse_blocks(window, block), "gram bigint, passage bigint, start int, end int"
    )
    own = parsed.unionByName(_repeated_windows(cut, window))
    # A passage holds fewer windows than twice its length.
    own = own.groupBy("gram", "passage").agg(F.collect_set(F.struct("start", "end")).alias("own"))
    known = same.join(own, ["gram", "passage"], "left").where(F.col("own").isNotNull() | (F.col("last") > F.col("doc_id")))
    known = stage(known.select("gram", "passage", F.col("doc_id").alias("first_doc"), "own", "rows"), "known")

    marked = expand_join(places, known, ["gram", "passage"], "rows", max_weight=seen["rows"])
    begin = F.col("place") - F.col("before")
    entire = F.array(F.struct(begin.alias("start"), (F.col("place") + F.col("after")).alias("end")))
    shifted = F.transform("own", lambda s: F.struct((s["start"] + begin).alias("start"), (s["end"] + begin).alias("end")))
    spans = F.when(F.col("doc_id") > F.col("first_doc"), entire).otherwise(shifted)
    # A document's different spans are bounded by its own words, however often its row is repeated.
    return marked.select(*_KEY, F.inline(spans)).groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _repeated_windows(cut: DataFrame, window: int) -> DataFrame:
    """Windows of crowded anchors that smaller documents have: ``gram, passage, start, end``."""
    keys = ["window_a", "window_b"]
    rows = cut.where(F.col("start").isNotNull()).select("gram", "passage", "doc_id", "start", *keys)
    least = rows.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("rows"))
    least = stage(least.where("low < high").select(*keys, "low", "rows"), "windows")
    later = expand_join(rows, least, keys, "rows").where("doc_id > low")
    return later.select("gram", "passage", "start", (F.col("start") + window).alias("end"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``docs`` with ``text`` cut down to its kept words, joined by one space, and ``__n_words`` and ``__n_removed`` added."""
    spans = stage(find_spans(docs, window, gram, most, block), "spans")
    spans = spans.select(F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), F.col("spans").alias("__spans"))
    same = (docs["doc_id"].cast("bigint") == F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__version"))
    joined = docs.join(spans, same, "left").select(*docs.columns, "__spans")
    text_at = docs.columns.index("text")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        out, n_words, n_removed = [], [], []
        spans = batch.column(batch.num_columns - 1).to_pylist()
        for first, last, data, offsets in blocks(batch.column(text_at)):
            words = find_words(data, offsets, SOLID, lower=False)
            gone = np.zeros(len(words.starts) + 1, np.int32)
            for k, own in enumerate(spans[first:last]):
                for span in own or ():
                    gone[words.offsets[k] + span["start"]] += 1
                    gone[words.offsets[k] + span["end"]] -= 1
            kept = np.cumsum(gone[:-1]) == 0
            texts, left = _joined(words, kept)
            out.append(texts)
            n_words.append(np.diff(words.offsets))
            n_removed.append(np.diff(words.offsets) - left)
        texts = pa.chunked_array(out, pa.string()).combine_chunks() if out else pa.array([], pa.string())
        texts = pc.if_else(batch.column(text_at).is_valid(), texts, pa.scalar(None, pa.string()))
        counts = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (n_words, n_removed)]
        return [texts, *[pa.array(c.astype(np.int64)) for c in counts]]

    added = [T.StructField("__kept", T.StringType()), T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType())]
    done = map_batches(joined, compute, added)
    return done.select(*[F.col("__kept").alias("text") if c == "text" else F.col(c) for c in docs.columns], "__n_words", "__n_removed")


def _joined(words, kept: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Kept words of each text with one space between, and their number."""
    starts, ends = words.starts[kept], words.ends[kept]
    of = np.concatenate([[0], np.cumsum(kept)])[words.offsets]
    steps = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(steps, starts, 1)
    np.subtract.at(steps, ends, 1)
    taken = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    # The byte behind a word is white space unless the word ends its text, and then no word follows.
    spaced = np.ones(len(ends), bool)
    spaced[of[1:][of[1:] > of[:-1]] - 1] = False
    gaps = ends[spaced]
    data = words.data.copy()
    data[gaps] = 32
    taken[gaps] = True
    sizes = np.concatenate([[0], np.cumsum(ends - starts + spaced)])
    offsets = sizes[of].astype(np.int32)
    return pa.StringArray.from_buffers(len(of) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[taken].tobytes())), np.diff(of)

