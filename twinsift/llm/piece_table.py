"""Fill-in-the-middle examples from a piece table.

A document is never copied while it is rearranged. It is a list of descriptors ``(buffer, start, end)`` over two
buffers that do not change: the text itself and one short buffer of sentinels. Cutting splits the one descriptor
of a text into prefix, middle and suffix; an arrangement is a permutation of those three, each behind the
descriptor of its sentinel; hashes read the buffers descriptor by descriptor. :func:`render` alone writes text.
:func:`restore` goes the other way: it cuts an output at its sentinels into descriptors over that output and
applies the inverse permutation.

A text is cut between units (a word with the white space before it, or white space at the end), at places drawn
from a hash of ``seed`` and ``doc_id``, so equal rows are cut alike, on any cluster and at any partitioning. A
text that holds a sentinel itself stays plain, hence a form and an output always give back the text.

Every step is narrow: no row moves. A null text counts as empty and an empty text stays plain (``__n`` 0); a null
``doc_id`` is hashed as an empty string; a text of white space only is one unit; a long text costs its length.
Repeated rows give equal rows, an empty table an empty result, and other columns are passed on unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinsift.llm.session import map_batches
from twinsift.llm.words import SOLID, blocks

SEED = 42
# Percent of documents that are rearranged, and of those the percent that put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, MIDDLE, SUFFIX = range(3)
SENTINELS = (b"<P>", b"<M>", b"<S>")
# Order of the parts in the output. Each part stands behind its own sentinel.
ARRANGEMENTS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLAIN = "plain"
TEXT_BUFFER, SENTINEL_BUFFER = 0, 1
_SENTINEL_TEXT = b"".join(SENTINELS)
_SENTINEL_AT = [(SENTINEL_BUFFER, 3 * part, 3 * part + 3) for part in range(3)]

_PIECE = T.StructType(
    [T.StructField("buffer", T.ByteType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)
_ARROW_PIECES = pa.list_(pa.struct([("buffer", pa.int8()), ("start", pa.int64()), ("end", pa.int64())]))
Pieces = list[tuple[int, int, int]]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all units, as places in ``data``, and the offsets of each text's units among them."""
    solid = SOLID[data]
    last = np.zeros(len(data), bool)
    last[:-1] = solid[:-1] & ~solid[1:]
    # The last byte of a text ends a unit, be it a word or white space.
    filled = np.flatnonzero(np.diff(offsets) > 0)
    last[offsets[filled + 1] - 1] = True
    ends = np.flatnonzero(last) + 1
    return ends, np.searchsorted(ends, offsets, side="right")


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from the hash of the seed and the document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def choose_form(text: memoryview, drawn: list[int], rate: int, suffix_first: int) -> str:
    if not len(text) or drawn[2] % 100 >= rate or any(s in text.obj for s in SENTINELS):
        return PLAIN
    return "spm" if drawn[3] % 100 < suffix_first else "psm"


def split(pieces: Pieces, at: int) -> Pieces:
    """Split the descriptors at text place ``at``; an empty part stays a descriptor."""
    out: Pieces = []
    for buffer, start, end in pieces:
        out += [(buffer, start, at), (buffer, at, end)] if start <= at <= end and not out else [(buffer, start, end)]
    return out


def cut(size: int, first: int, second: int) -> Pieces:
    """Prefix, middle and suffix of a text of ``size`` bytes."""
    head, tail = split([(TEXT_BUFFER, 0, size)], first)
    return [head, *split([tail], second)]


def arrange(parts: Pieces, form: str) -> Pieces:
    return [piece for part in ARRANGEMENTS[form] for piece in (_SENTINEL_AT[part], parts[part])]


def read(output: bytes, form: str) -> Pieces:
    """Descriptors over ``output`` that give the text: its parts in the order of the text, without sentinels."""
    if form == PLAIN:
        return [(TEXT_BUFFER, 0, len(output))]
    order = ARRANGEMENTS[form]
    starts, at = [], 0
    for part in order:
        at = output.index(SENTINELS[part], at) + len(SENTINELS[part])
        starts.append(at)
    ends = [start - len(SENTINELS[part]) for start, part in zip(starts[1:], order[1:])] + [len(output)]
    inverse = [order.index(part) for part in (PREFIX, MIDDLE, SUFFIX)]
    return [(TEXT_BUFFER, starts[place], ends[place]) for place in inverse]


def slices(text: memoryview, pieces: Pieces):
    buffers = (text, memoryview(_SENTINEL_TEXT))
    return (buffers[buffer][start:end] for buffer, start, end in pieces)


def stream_hash(text: memoryview, pieces: Pieces) -> str:
    digest = hashlib.sha256()
    for part in slices(text, pieces):
        digest.update(part)
    return digest.hexdigest()


def _texts(column: pa.Array):
    """Each text of a string column as bytes; null is empty."""
    for _, _, data, offsets in blocks(column):
        raw = data.tobytes()
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield raw[start:end]


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with ``__n`` (units), ``__form``, ``__pieces``, ``__prefix_chars``, ``__middle_chars`` and ``__output_sha256``.

    ``__pieces`` are the descriptors of the output in its order, in bytes of UTF-8; no output is written here.
    """
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        out: list[list] = [[] for _ in range(6)]
        ids = batch.column(id_at).to_pylist()
        for first, last, data, offsets in blocks(batch.column(text_at)):
            ends, of = units(data, offsets)
            raw = data.tobytes()
            for k in range(last - first):
                begin, end = int(offsets[k]), int(offsets[k + 1])
                n = int(of[k + 1] - of[k])
                drawn = draws(seed, ids[first + k])
                text = memoryview(raw[begin:end])
                form = choose_form(text, drawn, rate, suffix_first)
                if form == PLAIN:
                    pieces, chars = [(TEXT_BUFFER, 0, end - begin)], (None, None)
                else:
                    places = sorted(h % (n + 1) for h in drawn[:2])
                    at = [int(ends[of[k] + p - 1]) - begin if p else 0 for p in places]
                    parts = cut(end - begin, *at)
                    pieces = arrange(parts, form)
                    chars = tuple(_code_points(data[begin + s : begin + e]) for _, s, e in parts[:2])
                for column, value in zip(out, (n, form, pieces, *chars, stream_hash(text, pieces))):
                    column.append(value)
        kinds = (pa.int64(), pa.string(), _ARROW_PIECES, pa.int64(), pa.int64(), pa.string())
        return [pa.array(_rows(column, kind), kind) for column, kind in zip(out, kinds)]

    added = [
        T.StructField("__n", T.LongType()),
        T.StructField("__form", T.StringType()),
        T.StructField("__pieces", T.ArrayType(_PIECE)),
        T.StructField("__prefix_chars", T.LongType()),
        T.StructField("__middle_chars", T.LongType()),
        T.StructField("__output_sha256", T.StringType()),
    ]
    return map_batches(docs, compute, added)


def _rows(column: list, kind: pa.DataType) -> list:
    if kind is not _ARROW_PIECES:
        return column
    return [[{"buffer": b, "start": s, "end": e} for b, s, e in pieces] for pieces in column]


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def render(made: DataFrame) -> DataFrame:
    """The result of :func:`transform` with ``__output``, the text that its descriptors spell."""
    text_at, pieces_at = made.columns.index("text"), made.columns.index("__pieces")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        written = []
        for text, pieces in zip(_texts(batch.column(text_at)), batch.column(pieces_at).to_pylist()):
            listed = [(p["buffer"], p["start"], p["end"]) for p in pieces]
            written.append(b"".join(slices(memoryview(text), listed)))
        return [pa.array(written, pa.binary()).cast(pa.string())]

    return map_batches(made, compute, [T.StructField("__output", T.StringType())])


def restore(outputs: DataFrame, output: str = "__output", form: str = "__form", with_text: bool = True) -> DataFrame:
    """``outputs`` with ``__restored_sha256`` and, if asked for, ``__restored``: the text behind each output.

    Reads nothing but the two named columns; without texts only hashes leave the task.
    """
    output_at, form_at = outputs.columns.index(output), outputs.columns.index(form)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        hashes, texts = [], []
        for written, kind in zip(_texts(batch.column(output_at)), batch.column(form_at).to_pylist()):
            pieces = read(written, kind)
            hashes.append(stream_hash(memoryview(written), pieces))
            if with_text:
                texts.append(b"".join(slices(memoryview(written), pieces)))
        more = [pa.array(texts, pa.binary()).cast(pa.string())] if with_text else []
        return [pa.array(hashes, pa.string()), *more]

    more = [T.StructField("__restored", T.StringType())] if with_text else []
    return map_batches(outputs, compute, [T.StructField("__restored_sha256", T.StringType()), *more])
