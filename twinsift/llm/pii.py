"""Personal data: overlapping candidate spans, boosted trees over format and context, calibrated choice.

1. Generators, regular expressions chosen for recall, propose spans of each text. The base kinds (email,
   ip, card, phone) are validated by their rules and always stay where valid.
2. Other candidates (addresses spelled out, long numbers, numbers that look like a base kind but fail
   its check, keys and secrets) are described by format (length, digits, capitals, separators, distinct
   characters) and context (words just before that announce personal data, neighbours).
3. Gradient-boosted trees are fitted on the candidates of half of all texts, picked by hash. Their labels
   are the strict checks that a candidate passes or fails; the trees see shape and surroundings only, never
   the check. Candidates that look alike are one row, weighted by their number.
4. The threshold is the lowest probability whose precision on the candidates of the other half is at least
   ``PRECISION``. Candidates above it become spans.

Applying the trees is one expression per text, so the pass over the texts moves no row. Everything is
DataFrame functions and Spark ML. Places are code points, ends exclusive.

Null texts are empty ones and have no spans, texts are read whole, repeated rows are searched each,
equal spans are given once, and with no candidates, or of a single label, only base spans are given.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.session import string
from twinsift.operators.storage import stage

TREES, DEPTH = 8, 3
PRECISION = 0.95
# Characters before a candidate that are its context.
BEFORE = 24

BASE_KINDS = ["email", "ip", "card", "phone"]
# Java patterns. They start only where a run starts or the last match ended, and repeat without going
# back, which finds the same matches as the plain forms and stays linear on long runs.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]\x20?(?:dot|DOT)\x20?[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    # Seven digits or more in runs that no letter follows; the look ahead spares going back.
    "number": r"(?<![0-9A-Za-z.+])(?=\(?[0-9](?:[\x20().-]{0,2}[0-9]){6}[0-9]*+(?![A-Za-z]))\(?[0-9]++(?:[\x20().-]{1,2}[0-9]++(?![A-Za-z]))*+",
    "key": r"(?<![0-9A-Za-z_+/-])[0-9A-Za-z_+/-]{16,}+",
    "secret": r"(?i:password|passwd|token|secret|api[_-]?key)\x20{0,2}[=:]\x20{0,2}\"?[^\s\"]{6,}+",
}
_NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "spelled": lambda t: t.rlike(r"[\[(]\x20?(?:at|AT)\x20?[\])]"),
    "number": lambda t: t.rlike(r"[0-9][\x20().-]{0,2}[0-9]"),
    "key": lambda t: t.rlike(r"[0-9]"),
    "secret": lambda t: t.rlike(r"[=:]"),
}
_ANNOUNCE = r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|write to|address|\bip\b|host|card|visa|iban|account|ssn|id\b|key|token|secret|passw|login|user)"
FEATURES = ["length", "digits", "letters", "capitals", "separators", "distinct", "announced", "digit_share", "mixed", "generator"]


def _matches(text: Column, kind: str) -> Column:
    """Matches of a kind in order: ``start``, ``end``, ``found``."""
    pattern = _PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # Gaps and matches alternate; their lengths add up to the places.
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("found"))
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(state: Column, step: Column) -> Column:
        begin = state["at"] + step["gap"]
        end = begin + F.char_length(step["found"])
        span = F.struct(begin.alias("start"), end.alias("end"), step["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.when(_NEEDS[kind](text), F.aggregate(steps, start, add, lambda state: state["spans"])).otherwise(none)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    figures = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    """The strict check of a kind."""
    count = F.char_length(_digits(found))
    if kind == "ip":
        return found.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return count.between(16, 19) & luhn(F.when(count.between(16, 19), _digits(found)).otherwise(F.lit("1")))
    if kind == "phone":
        return count.between(8, 15)
    if kind == "number":
        return count.between(13, 19) & luhn(F.when(count.between(13, 19), _digits(found)).otherwise(F.lit("1")))
    if kind == "key":
        return found.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}$|^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,64}$")
    return F.lit(True)


def _described(text: Column, kind: str, number: int, spans: Column) -> Column:
    """Spans with their features; ``strict`` is the label, no feature."""

    def describe(s: Column) -> Column:
        found = s["found"]
        digits, letters = F.char_length(_digits(found)), F.char_length(F.regexp_replace(found, "[^A-Za-z]", ""))
        length = F.char_length(found)
        before = F.substring(text, F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE)))
        values = [
            length, digits, letters, F.char_length(F.regexp_replace(found, "[^A-Z]", "")), length - digits - letters,
            F.size(F.array_distinct(F.regexp_extract_all(found, F.lit("(?s)."), F.lit(0)))), before.rlike(_ANNOUNCE).cast("int"), digits / length,
            ((digits > 0) & (letters > 0)).cast("int"), F.lit(number),
        ]
        return F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            valid(kind, found).alias("strict"),
            *[v.cast("double").alias(n) for n, v in zip(FEATURES, values)],
        )

    return F.transform(spans, describe)


def _valid_spans(text: Column, kind: str) -> Column:
    good = F.filter(_matches(text, kind), lambda s: valid(kind, s["found"]))
    return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _base_spans(text: Column) -> Column:
    """All valid base spans, by kind as listed and place."""
    return F.concat(*[_valid_spans(text, kind) for kind in BASE_KINDS])


def _count(kind: str) -> Column:
    return F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def candidates(text: Column) -> Column:
    """Described spans of all generators; they may overlap. Base kinds come along, failing ones included."""
    parts = [_described(text, kind, number, _matches(text, kind)) for number, kind in enumerate(_PATTERNS)]
    return F.concat(*parts)


def _parse(lines: list[str], at: int = 0):
    """Read a printed tree: (feature, threshold, left, right) or a leaf's value, and the next line."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1]), at + 1
    feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left, at = _parse(lines, at + 1)
    right, at = _parse(lines, at + 1)
    return (int(feature), float(limit), left, right), at


def _tree(node, candidate: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, limit, left, right = node
    return F.when(candidate[FEATURES[feature]] <= limit, _tree(left, candidate)).otherwise(_tree(right, candidate))


class Model:
    """Boosted trees, their weights and the calibrated threshold."""

    def __init__(self, trees: list, weights: list[float], threshold: float):
        self.trees, self.weights, self.threshold = trees, weights, threshold

    def probability(self, candidate: Column) -> Column:
        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            margin = margin + _tree(tree, candidate) * weight
        return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2.0))


def fit(docs: DataFrame) -> Model | None:
    """Fit on the candidates of all texts, whole; candidates that look alike are one weighted row.

    Spark ML places the bounds of its feature bins by about 10,000 of those rows; all of them decide the splits.
    """
    found = docs.select(string("text").alias("text"))
    found = found.select(F.pmod(F.xxhash64("text"), F.lit(2)).alias("half"), F.explode(candidates(F.col("text"))).alias("c"))
    keys = ["half", "strict", *FEATURES]
    rows = found.select("half", "c.strict", *[f"c.{name}" for name in FEATURES]).groupBy(*keys)
    rows = stage(rows.agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions(*keys), "candidates")
    train = rows.where(F.col("half") == 0).select(
        F.col("strict").cast("double").alias("label"), F.col("n").cast("double").alias("n"), *FEATURES
    )
    if len(train.select("label").distinct().take(2)) < 2:
        return None
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    booster = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, weightCol="n")
    fitted = booster.fit(assembler.transform(train))
    trees = [_parse(t.toDebugString.splitlines()[1:])[0] for t in fitted.trees]
    model = Model(trees, list(fitted.treeWeights), 2.0)

    # Calibrated on what is applied later: the trees as an expression.
    held = rows.where(F.col("half") == 1).withColumn("chance", model.probability(F.struct(*FEATURES)))
    cell = F.floor(F.col("chance") * 100).cast("int").alias("cell")
    counted = held.groupBy(cell).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("strict"), F.col("n")).otherwise(0)).alias("good"))
    n = good = 0
    for row in sorted(counted.collect(), key=lambda r: -r.cell):
        n, good = n + row.n, good + row.good
        if good >= PRECISION * n and row.cell >= 50:
            model.threshold = row.cell / 100
    return model


def find_spans(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``__base`` and ``__spans``: arrays of ``kind``, ``start``, ``end``. Narrow."""
    text = string("text")
    base = _base_spans(text)
    if model is None or model.threshold > 1:
        return docs.withColumn("__base", base).withColumn("__spans", F.col("__base"))
    chosen = F.filter(candidates(text), lambda c: (model.probability(c) >= model.threshold) & ~c["kind"].isin(*BASE_KINDS))
    more = F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return docs.withColumn("__base", base).withColumn("__spans", F.concat("__base", more))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, counts of base spans, ``base_sha256``, ``spans``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = find_spans(docs, fit(docs))
    counts = [_count(kind) for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one."""
    found = find_spans(docs, model)
    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        before = F.substring(string("text"), state["at"] + 1, s["start"] - state["at"])
        put = F.concat(state["out"], before, F.lit("["), s["kind"], F.lit("]"))
        inside = s["start"] < state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), F.when(inside, state["out"]).otherwise(put).alias("out")
        )

    rest = lambda state: F.concat(state["out"], F.substring(string("text"), state["at"] + 1, F.length(string("text"))))
    redacted = F.when(F.col("text").isNotNull(), F.aggregate(ordered, begin, add, rest))
    return found.select(*[redacted.alias("text") if c == "text" else F.col(c) for c in docs.columns])
