"""Words and hashed word windows of a batch of texts, as flat arrays.

A batch of texts is one byte buffer with offsets, as Arrow holds it. Words are found and hashed for
the whole buffer at once. Word hashes are prefix sums of a random byte table times powers of an odd
base, mixed at the end; results that must be exact are compared as text afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
# Most bytes of text that one pass of array work covers; a longer single text is one pass.
BLOCK_BYTES = 1 << 19
_powers: dict[str, np.ndarray] = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z and every byte of other letters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
# [^\x20\x09-\x0D]: everything but white space.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < size:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:size], _powers["down"][:size]


@dataclass
class Words:
    """``starts``/``ends``: byte places of the words; ``hashes``; ``offsets``: first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    def text(self, first: int, last: int) -> list[bytes]:
        raw = self.data
        return [raw[s:e].tobytes() for s, e in zip(self.starts[first:last], self.ends[first:last])]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Split a string column into runs of whole texts of about ``limit`` bytes: (first, last, bytes, offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        part = offsets[first : last + 1]
        yield first, last, data[part[0] : part[-1]], part - part[0]
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray, lower: bool = True) -> Words:
    """Words of each text in ``data``, A-Z lower-cased unless told otherwise; a word never spans two texts."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    low = _LOWER[data] if lower else data
    inside = members[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[low] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    hashes[hashes == 0] = 1
    return Words(low, starts, ends, hashes, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words that stay inside a text, and the offsets of each text's runs.

    The run that starts at word ``i`` of a text is its ``i``-th. Texts shorter than ``size`` have none.
    """
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if out[-1] == 0:
        return np.zeros(0, np.uint64), out
    n = len(hashes) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    keep = np.repeat(offsets[:-1] - out[:-1], counts) + np.arange(out[-1])
    return mix(total[keep]), out


def runs(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word runs ``starts[i]`` to ``ends[i]``, of any lengths."""
    up, down = _power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])
