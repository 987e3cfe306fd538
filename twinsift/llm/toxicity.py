"""Toxicity: decode disguised words as a noisy channel, then score the restored text.

1. A character language model: counts of letter trigrams inside words, over all texts. Letters are
   folded to a-z plus one sign for any other letter and one for the word's edge, so the model has at
   most 28^3 counts whatever the corpus holds.
2. Decoding: words with digits or signs among letters, letters repeated three times or more, and
   letters set apart by single spaces, dots or dashes become character lattices; each sign may stand
   for the letters it resembles, a run of one letter for one or two of it. The Viterbi path under the
   language model and the channel's costs is the restored word. Other words are left as they are.
3. Scoring: a text's features are its words, their beginnings, and how densely different words with
   one beginning stand in it. A feature's weight is a cautious (lower bound) estimate of how surely a
   text with it is toxic, from labelled texts; a text's weight joins those of its three surest words or
   densities as independent signs, passed through a curve that is fitted to the labelled texts.

Whole words are counted by distinct contexts (the words on both sides), beginnings by the distinct words
that have them and densities by the distinct sets of those words. So copies of a text count once, and
one word alone does not speak for its beginning.
The classifier is fitted on at most ``FIT_ROWS`` ids of each label, picked by hash, whatever the length
of their texts. Features and contexts of the sample are counted by aggregations, so the driver holds the
candidates and their counts but no text. Only the text of a row is read for its score. Labels are taken
from rows that are not held out.

Null and empty texts get the score of a text without any feature, texts are read whole, repeated rows
are scored each, contradicting labels of a document count as toxic, and with no toxic labels every score
is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.llm.session import give_back, hash_share, map_batches, string
from twinsift.llm.words import blocks
from twinsift.operators.storage import stage

# Rows of each label, toxic and not, that the classifier is fitted on at most.
FIT_ROWS = (3_000, 9_000)
REJECT = 0.7
# Least contexts in toxic texts that a feature needs, the least of a density (each is a whole text), and
# the lengths of word beginnings.
MIN_CONTEXTS = 8
MIN_TEXTS = 4
PREFIXES = (3, 4, 5, 6)
# How many times as common in toxic texts as in others a candidate must be at least.
LIFT = 1.0
# Densities: steps of two, from one word with a beginning in this many words of a text.
SPARSEST, STEPS = 1024, 8
# Signs that are joined, the greatest weight of a text (minus the logarithm of the doubt left) and the
# cells of the curve per unit of weight.
TOGETHER, MOST, CELLS = 3, 16.0, 4
# Rows with this remainder of crc32(doc_id) by 3 never lend a label.
FOLDS, HELD_OUT = 3, 1
# Words a worker remembers the weight of, and contexts it holds before it hands them on.
REMEMBERED = 100_000
# Longer words are decoded each time instead of being remembered.
LONG = 64
TOLD = 100_000

_SIGNS = 28
_OTHER, _EDGE = 26, 27
# The letters that a sign may stand for.
RESEMBLES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou",
}
_SIGN_CLASS = re.escape("".join(RESEMBLES))
_LETTER = r"[^\W\d_]"
# A disguise: signs next to letters, three of a letter, or single letters set apart by one sign.
_SPACED = re.compile(rf"(?<![\w{_SIGN_CLASS}])(?:[{_SIGN_CLASS}]|{_LETTER})(?:([ .\-_])(?:[{_SIGN_CLASS}]|{_LETTER}))(?:\1(?:[{_SIGN_CLASS}]|{_LETTER}))+(?![\w{_SIGN_CLASS}])")
# Runs are found first and tested one by one, each in time linear in its length, however long it is.
_RUN = re.compile(rf"(?<![.\-{_SIGN_CLASS}\w])(?=[^\W\d]*+[{_SIGN_CLASS}])[{_SIGN_CLASS}\w]{{3,}}+(?!-|\.\w)")
_BEGINS = re.compile(rf"[{_SIGN_CLASS}]*+{_LETTER}")
_SIGN_INSIDE = re.compile(rf"[{_SIGN_CLASS}]{_LETTER}")
_SIGNS_BEHIND = re.compile(rf"{_LETTER}++[{_SIGN_CLASS}]++")
_LETTERS = re.compile(rf"{_LETTER}++")
# Both are sought from their rarest sign on, not from every letter.
_ANY_SIGN = re.compile(rf"[{_SIGN_CLASS}](?:(?={_LETTER})|(?<={_LETTER}[{_SIGN_CLASS}]))")
_WORDS = re.compile(r"[^\W_]+")
_SINGLE = re.compile(r"[ .\-_]\w[ .\-_]\w(?!\w)(?:(?<=\W\w[ .\-_]\w[ .\-_]\w)|(?<=^\w[ .\-_]\w[ .\-_]\w))")
_TRIPLE = re.compile(r"([^\W\d_])\1\1", re.IGNORECASE)


def _fold_table() -> np.ndarray:
    table = np.full(256, _EDGE, np.int64)
    table[65:91] = table[97:123] = np.arange(26)
    table[128:] = _OTHER
    return table


_FOLD = _fold_table()


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of folded letter trigrams over every text, as a 28 x 28 x 28 table."""
    cells = _SIGNS**3

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                # One sign per code point: the further bytes of a letter are left out.
                first = (data & 0xC0) != 0x80
                offsets = np.concatenate([[0], np.cumsum(first)])[offsets]
                codes = np.append(_FOLD[data[first]], _EDGE)
                # A text's edge parts it from the next one: a trigram over it counts nowhere.
                cross = np.zeros(len(codes), bool)
                cross[offsets[1:-1]] = True
                cross[offsets[1:-1] - 1] = True
                keys = (codes[:-2] * _SIGNS + codes[1:-1]) * _SIGNS + codes[2:]
                total += np.bincount(keys[~cross[1:-1]], minlength=cells)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])

    rows = docs.select(string("text").alias("text")).mapInArrow(count, "cell bigint, n bigint")
    table = np.zeros(cells, np.int64)
    # At most one row per cell of the fixed table.
    for row in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[row.cell] = row.n
    return table.reshape(_SIGNS, _SIGNS, _SIGNS)


@dataclass
class Decoder:
    """Viterbi decoding of disguised words under a trigram model."""

    log_p: np.ndarray
    sign_cost: float = 0.5
    run_cost: float = 0.5
    known: dict[str, str] = field(default_factory=dict)
    table: list = field(init=False)

    def __post_init__(self) -> None:
        # Plain lists are read one number at a time several times faster than an array.
        self.table = self.log_p.tolist()

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> "Decoder":
        pairs = counts.sum(axis=2, keepdims=True)
        alone = counts.sum(axis=(0, 1)) + 1.0
        back = alone / alone.sum()
        return cls(np.log((counts + 20 * back) / (pairs + 20)))

    @staticmethod
    def _code(letter: str) -> int:
        return ord(letter) - 97 if "a" <= letter <= "z" else _OTHER

    def decode(self, word: str) -> str:
        word = word.lower()
        if len(word) > LONG:
            return self._best(word)
        if word not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[word] = self._best(word)
        return self.known[word]

    def _lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For every run of one character: the letter strings it may stand for and their costs."""
        steps, i = [], 0
        while i < len(word):
            j = i
            while j < len(word) and word[j] == word[i]:
                j += 1
            run, letters = j - i, RESEMBLES.get(word[i], word[i])
            cost = self.sign_cost if word[i] in RESEMBLES else 0.0
            options = []
            for letter in letters:
                for n in (run,) if run < 3 else (1, 2):
                    options.append((letter * n, cost + self.run_cost * (n != run)))
            steps.append(options)
            i = j
        return steps

    def _best(self, word: str) -> str:
        # A path is its cost and a link to its last letters and the path before; only the best one is spelled out.
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(_EDGE, _EDGE): (0.0, None)}
        table = self.table
        for options in self._lattice(word):
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, before) in paths.items():
                for letters, extra in options:
                    total, x, y = cost + extra, a, b
                    for letter in letters:
                        z = self._code(letter)
                        # The step from the edge has no trigram of its own.
                        total -= table[x][y][z] if x != _EDGE or y != _EDGE else 0.0
                        x, y = y, z
                    held = following.get((x, y))
                    if held is None or total < held[0]:
                        following[x, y] = (total, (letters, before))
            paths = following
        ends = [(cost - table[a][b][_EDGE], spelled) for (a, b), (cost, spelled) in paths.items()]
        least = min(cost for cost, _ in ends)
        return min(_spell(spelled) for cost, spelled in ends if cost == least)

    def candidates(self, text: str) -> list[str]:
        """Decoded readings of the disguised words of ``text``."""
        found = []
        if _SINGLE.search(text):
            found += [self.decode(m.group(0).replace(m.group(1), "")) for m in _SPACED.finditer(text)]
        if _ANY_SIGN.search(text):
            found += [self.decode(m.group(0)) for m in _RUN.finditer(text) if _mixed(text, m)]
        if _TRIPLE.search(text):
            found += [self.decode(word) for word in _drawn_out(text)]
        return found


def _spell(path: tuple | None) -> str:
    parts = []
    while path is not None:
        letters, path = path
        parts.append(letters)
    return "".join(reversed(parts))


def _drawn_out(text: str) -> Iterable[str]:
    """Words with a letter three times or more in a row; each is looked at once."""
    end = 0
    for triple in _TRIPLE.finditer(text):
        if triple.start() < end:
            continue
        start = triple.start()
        while start > end and _is_letter(text[start - 1]):
            start -= 1
        end = _LETTERS.match(text, start).end()
        yield text[start:end]


def _is_letter(sign: str) -> bool:
    return sign.isalnum() and not sign.isdecimal()


def _mixed(text: str, run: re.Match) -> bool:
    """Whether a run of letters and signs is a disguised word: a sign before a letter, or signs that end it."""
    word = run.group(0)
    if not _BEGINS.match(word):
        return False
    if _SIGN_INSIDE.search(word):
        return True
    return bool(_SIGNS_BEHIND.fullmatch(word)) and text[run.end() : run.end() + 1].strip() == ""


def beginnings(word: str) -> list[str]:
    return [word[:k] + "*" for k in PREFIXES if len(word) >= k]


def _density(kinds: int, words: int) -> int:
    """The step of a density, 0 if it is below the sparsest or rests on a single word."""
    if kinds < 2:
        return 0
    return min(STEPS, int(math.log2(max(1.0, kinds * SPARSEST / words))))


def _with_decoded(words: list[str], decoder: "Decoder", text: str) -> set[str]:
    found = set(words)
    for reading in decoder.candidates(text):
        found |= {reading, reading[1:], reading[:-1]}
    return found


@dataclass
class Model:
    """Weights of features and the curve from a text's weight to its score."""

    decoder: Decoder
    weights: dict[str, float]
    knots: np.ndarray
    values: np.ndarray
    dense: set[str] = field(default_factory=set)
    heads: set[str] = field(default_factory=set)
    # Words met so far, and of those that bear on a weight what they bear.
    memory: set[str] = field(default_factory=set)
    telling: dict[str, tuple[float, tuple[str, ...]]] = field(default_factory=dict)
    telling_words: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.dense = {feature.partition("|")[0] for feature in self.weights if "|" in feature}
        # What a word must begin with for a beginning of it to have a weight or a density.
        self.heads = {f[: PREFIXES[0]] for f in self.dense.union(self.weights) if f.endswith("*")}

    def _word(self, word: str) -> tuple[float, tuple[str, ...]]:
        own = beginnings(word)
        weight = max(self.weights.get(f, 0.0) for f in [word, *own])
        return weight, tuple(f for f in own if f in self.dense)

    def _meet(self, words: set[str]) -> None:
        """Remember the words that are new, and what they bear."""
        if len(self.memory) > REMEMBERED:
            for held in (self.memory, self.telling, self.telling_words):
                held.clear()
        new = words - self.memory
        self.memory |= new
        shortest = PREFIXES[0]
        for word in [w for w in new if w[:shortest] in self.heads or w in self.weights]:
            known = self._word(word)
            if known[0] or known[1]:
                self.telling[word] = known
                self.telling_words.add(word)

    def weight(self, text: str | None) -> float:
        if not text or not self.weights:
            return 0.0
        words = _WORDS.findall(text.lower())
        found: list[float] = []
        kinds: Counter = Counter()
        own = _with_decoded(words, self.decoder, text)
        self._meet(own)
        # Most words bear on nothing; sets pass them by without a step of Python for each.
        for word in own & self.telling_words:
            weight, starts = self.telling[word]
            if weight:
                found.append(weight)
            kinds.update(starts)
        dense = [self.weights.get(f"{start}|{_density(n, len(words))}", 0.0) for start, n in kinds.items()]
        # Beginnings of one word overlap, so only the surest density counts.
        found.append(max(dense, default=0.0))
        doubt = 1.0
        for weight in heapq.nlargest(TOGETHER, found):
            doubt *= 1.0 - weight
        return min(-math.log(doubt), MOST)

    def score(self, text: str | None) -> float:
        return float(np.interp(self.weight(text), self.knots, self.values))


def _lower_bound(hits: int, misses: float) -> float:
    """Wilson's lower bound of a share, at two standard errors."""
    n, z = hits + misses, 2.0
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _contexts(text: str, decoder: Decoder, among: set[str]) -> set[tuple[str, str]]:
    """Features of a text that are ``among`` those given, each with its contexts; densities count at their own step and below."""
    words = _WORDS.findall(text.lower())
    found = set()
    for before, word, after in zip(["", *words[:-1]], words, [*words[1:], ""]):
        if word in among:
            found.add((word, f"{before} {after}"))
    kinds: dict[str, set[str]] = defaultdict(set)
    for word in _with_decoded(words, decoder, text):
        for start in beginnings(word):
            if start in among:
                kinds[start].add(word)
    for start, own in kinds.items():
        found.update((start, word) for word in own)
        mark = hashlib.blake2b("\0".join(sorted(own)).encode("utf-8", "replace"), digest_size=16).hexdigest()
        for step in range(1, _density(len(own), len(words)) + 1):
            found.add((f"{start}|{step}", mark))
    return found


def _labelled(batch: pa.RecordBatch) -> Iterable[tuple[int, str]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def _sides(rows: DataFrame, n) -> DataFrame:
    """Sums of ``n`` by feature: ``here`` over toxic texts, ``there`` over the others."""
    side = lambda toxic, name: F.sum(F.when(F.col("toxic") == toxic, n).otherwise(0)).alias(name)
    return rows.groupBy("feature").agg(side(1, "here"), side(0, "there"))


def _candidates(sample: DataFrame, decoder: Broadcast, ratio: float) -> set[str]:
    """Words and beginnings of a few toxic texts or more and of a clearly smaller share of the clean ones.

    Only these get their contexts told apart, and only these reach the driver.
    """

    def count(batches):
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for toxic, text in _labelled(batch):
                words = _with_decoded(_WORDS.findall(text.lower()), decoder.value, text)
                counts[toxic].update(words | {start for word in words for start in beginnings(word)})
            for toxic, own in enumerate(counts):
                yield pa.RecordBatch.from_pydict({
                    "feature": pa.array(own.keys(), pa.string()), "toxic": pa.array([toxic] * len(own), pa.int32()),
                    "n": pa.array(own.values(), pa.int64()),
                })
        give_back()

    found = _sides(sample.mapInArrow(count, "feature string, toxic int, n bigint"), F.col("n"))
    found = found.where((F.col("here") >= MIN_TEXTS - 1) & (F.col("here") >= LIFT * ratio * F.col("there")))
    return {row.feature for row in found.select("feature").collect()}


def _told_apart(sample: DataFrame, decoder: Broadcast, candidates: Broadcast) -> DataFrame:
    """Per feature its number of distinct contexts in toxic texts (``here``) and in others (``there``)."""

    def list_contexts(batches):
        for batch in batches:
            seen: tuple[set, set] = (set(), set())
            for toxic, text in _labelled(batch):
                seen[toxic].update(_contexts(text, decoder.value, candidates.value))
                if len(seen[toxic]) > TOLD:
                    yield _context_rows(seen[toxic], toxic)
                    seen[toxic].clear()
            for toxic, own in enumerate(seen):
                yield _context_rows(own, toxic)
        give_back()

    rows = sample.mapInArrow(list_contexts, "feature string, toxic int, context string")
    rows = rows.select("feature", "toxic", F.xxhash64("context").alias("context")).distinct()
    return _sides(rows, F.lit(1))


def _context_rows(own: set[tuple[str, str]], toxic: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "feature": pa.array([f for f, _ in own], pa.string()), "toxic": pa.array([toxic] * len(own), pa.int32()),
        "context": pa.array([c for _, c in own], pa.string()),
    })


def _cells(sample: DataFrame, model: Model) -> Counter:
    """How many texts of each label fall into each cell of weight."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def weigh(batches):
        for batch in batches:
            own = Counter((int(shared.value.weight(text) * CELLS), toxic) for toxic, text in _labelled(batch))
            yield pa.RecordBatch.from_pydict({
                "cell": pa.array([c for c, _ in own], pa.int32()), "toxic": pa.array([t for _, t in own], pa.int32()),
                "n": pa.array(own.values(), pa.int64()),
            })
        give_back()

    rows = sample.mapInArrow(weigh, "cell int, toxic int, n bigint").groupBy("cell", "toxic").agg(F.sum("n").alias("n"))
    return Counter({(row.cell, row.toxic): row.n for row in rows.collect()})


def fit(sample: DataFrame, decoder: Decoder) -> Model:
    """Weights from distinct contexts, and a monotone curve from a text's weight to the share of toxic ones.

    ``sample`` has ``toxic`` (0 or 1) and ``text``, each pair once. Its texts stay on the executors.
    """
    size = {row.toxic: row.n for row in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ratio = max(size.get(1, 0), 1) / max(size.get(0, 0), 1)
    empty = Model(decoder, {}, np.array([0.0, 1.0]), np.array([0.0, 0.0]))
    if not size.get(1):
        return empty
    context = sample.sparkSession.sparkContext
    sent = context.broadcast(decoder)
    told = _told_apart(sample, sent, context.broadcast(_candidates(sample, sent, ratio)))
    least = F.when(F.col("feature").contains("|"), MIN_TEXTS).otherwise(MIN_CONTEXTS)
    weights = {}
    for row in told.where(F.col("here") >= least).collect():
        weight = _lower_bound(row.here, row.there * ratio)
        if weight > 0.6:
            weights[row.feature] = weight
    # A text has its own step of density only; the steps below hold for it as well.
    for feature in [f for f in weights if "|" in f]:
        start, _, step = feature.partition("|")
        for above in range(int(step) + 1, STEPS + 1):
            weights[f"{start}|{above}"] = max(weights.get(f"{start}|{above}", 0.0), weights[feature])
    cells = _cells(sample, Model(decoder, weights, empty.knots, empty.values))
    # Pool neighbours until the share of toxic texts rises with the weight.
    pools: list[list[float]] = []
    for cell in sorted({cell for cell, _ in cells}):
        pools.append([(cell + 0.5) / CELLS, cells[cell, 1], cells[cell, 0], 1])
        while len(pools) > 1 and _share(pools[-2]) >= _share(pools[-1]):
            x, a, b, n = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[3] + x * n) / (last[3] + n)
            last[1:] = [last[1] + a, last[2] + b, last[3] + n]
    knots, values = np.array([p[0] for p in pools]), np.array([_share(p) for p in pools])
    return Model(decoder, weights, knots, values)


def _share(pool: list[float]) -> float:
    return (pool[1] + 0.05) / (pool[1] + pool[2] + 1.0)


def held_out(doc_id) -> "F.Column":
    remainder = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    return remainder == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int] = FIT_ROWS) -> Model:
    """The language model over all texts, and the classifier over a bounded sample of labelled rows."""
    decoder = Decoder.from_counts(trigram_counts(docs))
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    totals = {row.toxic: row.n for row in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    usable = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") > 0)
    ids: list[tuple[int, int]] = []
    for label, rows in ((1, fit_rows[0]), (0, fit_rows[1])):
        picked = marks.where((F.col("toxic") == label) & hash_share(F.col("doc_id"), rows, totals.get(label, 0)))
        # About one and a half times as many ids as rows asked for, so they can be sent out.
        own = usable.select("doc_id").join(F.broadcast(picked), "doc_id", "left_semi").distinct()
        ids += [(r.doc_id, label) for r in own.orderBy(F.xxhash64("doc_id")).limit(rows).collect()]
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id bigint, toxic int")
    sample = usable.join(F.broadcast(chosen), "doc_id").select("toxic", "text").distinct()
    model = fit(stage(sample, "toxicity-sample"), decoder)
    give_back()
    return model


def _apply(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        score = shared.value.score
        return [pa.array([score(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], pa.float64())]

    return map_batches(docs, compute, [T.StructField("__toxic", T.DoubleType())])


def scores(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    found = _apply(docs.select("doc_id", "text"), train(docs, labels))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("__toxic").alias("score"),
        (F.col("__toxic") >= reject).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """``docs`` without the rows that score as toxic. Columns stay."""
    return _apply(docs, train(docs, labels)).where(F.col("__toxic") < reject).select(*docs.columns)
