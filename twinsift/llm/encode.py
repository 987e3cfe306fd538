"""Encoding whole texts with a public tokenizer inside tasks.

Neither kind of tokenizer used here forms a token across single white space between two other
characters: the byte-level one starts a piece at it, the word one drops it. So a text is cut there,
each distinct chunk is encoded once per worker by the library, and the ids are put together by array
work. Chunks are known by a 64-bit hash of their bytes and their length. Texts with other spacing
(longer runs of white space, or some at an end) go to the library as they are. ``tests/llm`` compares
both ways.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

from twinsift.llm.words import SOLID, blocks, find_words, mix

# Slots of a worker's table of known chunks; it is emptied when half full or when the ids pass the other bound.
SLOTS = 1 << 22
MOST_IDS = 12_000_000
_ODD = -1
_NEW = -2


def share_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's content (a few megabytes, fixed) for every executor."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


@lru_cache(maxsize=2)
def _encoder(content: str) -> "Encoder":
    return Encoder(content)


def encoder(shared: Broadcast) -> "Encoder":
    """One encoder per worker process and tokenizer; its table of chunks lives as long."""
    return _encoder(shared.value)


class Encoder:
    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        # Strings of special tokens inside a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        offsets = self.tokenizer.encode("a b", add_special_tokens=False).offsets
        self.spaced = any(" " in "a b"[start:end] for start, end in offsets)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.values = np.full(SLOTS, _NEW, np.int32)
        self.bounds = [np.zeros(1, np.int64)]
        self.ids = [np.zeros(0, np.uint32)]
        self.known = 0

    def encode_whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array, end_id: int):
        """Yield (first, last, ids, bounds): ids of the texts ``first..last``, each closed by ``end_id``.

        A null text is an empty one. ``bounds`` cuts ``ids`` into texts.
        """
        for first, last, data, offsets in blocks(column):
            ids, bounds = self._encode_block(data, offsets, end_id)
            yield first, last, ids, bounds

    def _encode_block(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        words = find_words(data, offsets, SOLID, lower=False)
        count = np.diff(words.offsets)
        head = np.zeros(len(words.starts), bool)
        head[words.offsets[:-1][count > 0]] = True
        lead = (~head).astype(np.int64) if self.spaced else np.zeros(len(head), np.int64)
        begins = words.starts - lead
        keys = words.hashes
        if self.spaced:
            before = np.where(head, np.uint64(0), data[words.starts - 1].astype(np.uint64) + np.uint64(1))
            keys = keys ^ (before * np.uint64(0xA24BAED4963EE407))
        keys = mix(keys + (words.ends - begins).astype(np.uint64))
        keys[keys == 0] = 1
        rows = self._rows(keys, data, begins, words.ends)

        # Texts with other spacing: a gap that is not one byte wide, white space at an end, or an odd chunk.
        text_of = np.repeat(np.arange(len(count)), count)
        gap = np.zeros(len(head), np.int64)
        gap[1:] = words.starts[1:] - words.ends[:-1]
        odd = np.zeros(len(count), bool)
        odd[text_of[((gap != 1) & ~head) | (rows == _ODD)]] = True
        some = count > 0
        odd[some] |= words.starts[words.offsets[:-1][some]] != offsets[:-1][some]
        odd[some] |= words.ends[words.offsets[1:][some] - 1] != offsets[1:][some]
        odd |= ~some & (np.diff(offsets) > 0)

        table, limits = self._table()
        keep = ~odd[text_of]
        rows = rows[keep]
        start = limits[rows]
        size = limits[rows + 1] - start
        per_text = np.bincount(text_of[keep], weights=size, minlength=len(count)).astype(np.int64)
        special = np.flatnonzero(odd)
        whole = self.encode_whole([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in special])
        per_text[special] = [len(ids) for ids in whole]
        bounds = np.concatenate([[0], np.cumsum(per_text + 1)])
        out = np.full(int(bounds[-1]), end_id, np.uint32)
        if len(rows):
            ends = np.cumsum(size)
            source = np.repeat(start - ends + size, size) + np.arange(ends[-1])
            place = np.ones(len(out), bool)
            place[bounds[1:] - 1] = False
            for i in special:
                place[bounds[i] : bounds[i + 1]] = False
            out[place] = table[source]
        for i, ids in zip(special, whole):
            out[bounds[i] : bounds[i + 1] - 1] = ids
        return out, bounds

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
            self.bounds = [np.concatenate(self.bounds)]
        return self.ids[0], self.bounds[0]

    def _rows(self, keys: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.known > SLOTS // 2 or self.bounds[-1][-1] > MOST_IDS:
            self._empty()
        slots, found = self._find(keys)
        missing = np.flatnonzero(~found)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            at = missing[first]
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(begins[at].tolist(), ends[at].tolist())]
            self._learn(new, texts)
            slots, _ = self._find(keys)
        return self.values[slots]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        held = self.keys[slots]
        found = held == keys
        todo = np.flatnonzero(~found & (held != 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & (SLOTS - 1)
            held = self.keys[slots[todo]]
            found[todo] = held == keys[todo]
            todo = todo[(held != keys[todo]) & (held != 0)]
        return slots, found

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Encode new chunks. One that has wider white space at an end cannot stand alone and is marked."""
        lead = 1 if self.spaced else 0
        fit = np.array([len(t) - len(t.strip()) == (lead if t[0] in " \t\n\v\f\r" else 0) for t in texts], bool)
        good = [t for t, ok in zip(texts, fit) if ok]
        encoded = self.encode_whole(good)
        ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded))) + self.bounds[-1][-1]
        numbers = np.full(len(texts), _ODD, np.int32)
        held = sum(map(len, self.bounds)) - 1
        numbers[fit] = np.arange(held, held + len(good))
        self.bounds.append(ends)
        self.ids.append(np.fromiter(chain.from_iterable(encoded), np.uint32))
        self._table()
        self._insert(keys, numbers)

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        self.known += len(keys)
        slots = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == 0]
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots[todo]] == keys[todo]
            done = todo[placed]
            self.values[slots[done]] = numbers[done]
            todo = todo[~placed]
            slots[todo] = (slots[todo] + 1) & (SLOTS - 1)
