"""Exact similarity joins on 64-bit fingerprints.

Two fingerprints within ``T`` bits must be close in at least one of ``m`` bands: with radii chosen so
that ``sum(radius + 1) = T + 1``, exceeding every radius would already cost more than ``T`` bits. A band's
radius is split over both sides: each row is expanded to every band key within its side's share, and
the pair meets in a plain equi-join that verifies the full distance. Two small balls of keys hold far
fewer rows than one of the whole radius, so bands can be wide, and wide bands have few candidates.
A pair may then meet at several keys: it is kept where the probe side has flipped the lowest of the
bits that differ. Nothing approximate is involved.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.bits import hamming, signed64
from twinsift.operators.lookup import MAX_HOT_KEYS
from twinsift.operators.storage import stage, stage_measured
from twinsift.schemas import HASH_BITS

# Band keys holding more build rows than this are split by further bands.
HOT_BUCKET = 50_000
# Rows per block of the fallback join.
BLOCK_ROWS = 8_192
# A verified candidate costs about this share of a shuffled probe row.
_CANDIDATE_COST = 0.05
# Longest list of bit flips kept as a literal in the plan.
_MAX_FLIPS = 6_000


@dataclass(frozen=True)
class Band:
    number: int
    shift: int
    width: int
    radius: int

    @property
    def mask(self) -> int:
        return ((1 << self.width) - 1) << self.shift

    @property
    def volume(self) -> int:
        return _volume(self.width, self.radius)

    def flips(self) -> list[int]:
        """All xor patterns of the band with at most ``radius`` bits, as BIGINT values."""
        places = range(self.shift, self.shift + self.width)
        return [
            signed64(sum(1 << p for p in chosen))
            for r in range(self.radius + 1)
            for chosen in combinations(places, r)
        ]


def _volume(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def _side_cost(width: int, probe: int, build: int, rows: int) -> float:
    """Rows and candidates of one band, for each row of a table of ``rows``."""
    keys, own = _volume(width, probe), _volume(width, build)
    return keys + own - 1 + _CANDIDATE_COST * rows * keys * own / 2**width


def split_radius(width: int, radius: int, rows: int) -> tuple[int, int] | None:
    """The cheapest shares of probe and build side in a band's radius; None where each is too large a list."""
    shares = [(radius - build, build) for build in range(radius // 2 + 1)]
    shares = [pair for pair in shares if _volume(width, pair[0]) <= _MAX_FLIPS]
    return min(shares, key=lambda pair: _side_cost(width, *pair, rows), default=None)


def _radii(count: int, threshold: int) -> list[int]:
    share, extra = divmod(threshold + 1, count)
    return [share - 1 + (i < extra) for i in range(count)]


def layout(count: int, threshold: int) -> list[Band]:
    """``count`` bands over 64 bits with radii that cover ``threshold``."""
    edges = [HASH_BITS * i // count for i in range(count + 1)]
    return [
        Band(i, edges[i], edges[i + 1] - edges[i], radius)
        for i, radius in enumerate(_radii(count, threshold))
        if radius >= 0
    ]


def _cost(bands: list[Band], rows: int) -> float:
    return sum(_side_cost(b.width, *split_radius(b.width, b.radius, rows), rows) for b in bands)


def choose_bands(threshold: int, rows: int) -> list[Band] | None:
    """Cheapest layout for this many distinct fingerprints, or None where no banding is selective.

    More rows ask for wider bands (fewer candidates), fewer rows for narrow bands (fewer probes).
    """
    options = [layout(count, threshold) for count in range(2, threshold + 2)] or [layout(1, 0)]
    options = [bands for bands in options if all(split_radius(b.width, b.radius, rows) for b in bands)]
    if not options:
        return None
    best = min(options, key=lambda bands: _cost(bands, rows))
    # Past this distance the candidates approach all pairs and blocks are cheaper to enumerate.
    if threshold > 12 and _cost(best, rows) > _CANDIDATE_COST * rows + rows / BLOCK_ROWS:
        return None
    return best


def _split_cost(bands: list[Band], level: int, threshold: int) -> float:
    """Share of a bucket that a row still meets after splitting it by the bands not used yet."""
    left = len(bands) - level
    if left == 0:
        return 1.0
    width = HASH_BITS / len(bands)
    radii = [r for r in _radii(left, threshold) if r >= 0]
    return sum(sum(comb(round(width), k) for k in range(r + 1)) for r in radii) / 2**width


def _can_split(bands: list[Band], level: int, threshold: int, rows: int) -> bool:
    """Whether the bands left cover the threshold with lists of flips that a plan may hold."""
    radius = max(_radii(len(bands) - level, threshold))
    return all(split_radius(b.width, radius, rows) for b in bands)


def _pieces(level: int, bands: list[Band], threshold: int, side: str) -> tuple[Column, Column, int, int]:
    """Whether the row's current band may be used at this level, and whether it has the wide radius.

    ``level`` bands are fixed already; the others must cover the whole threshold among themselves.
    The first few of them (in band order) get a radius one wider than the rest.
    """
    share, extra = divmod(threshold + 1, len(bands) - level)
    band = F.col(f"{side}_band{level}")
    used = [F.col(f"{side}_band{k}") for k in range(level)]
    place = band
    free = F.lit(True)
    for earlier in used:
        place = place - (earlier < band).cast("int")
        free = free & (earlier != band)
    wide = place < extra
    return (free & wide if share == 0 else free), wide, share - 1, share


def _explode_own(df: DataFrame, bands: list[Band], level: int, threshold: int, side: str) -> DataFrame:
    """One row per usable band with the row's own key."""
    phash, band, key = F.col(f"{side}_phash"), f"{side}_band{level}", f"{side}_key{level}"
    own = [
        F.struct(
            F.lit(b.number).alias("band"),
            phash.bitwiseAND(F.lit(signed64(b.mask)).cast("bigint")).alias("key"),
        )
        for b in bands
    ]
    df = df.withColumn("_k", F.explode(F.array(*own)))
    df = df.withColumn(band, F.col("_k.band")).withColumn(key, F.col("_k.key")).drop("_k")
    usable, *_ = _pieces(level, bands, threshold, side)
    return df.where(usable)


def _bigints(values: list[int]) -> Column:
    """A constant array. One parsed expression; the smallest BIGINT has no literal of its own."""
    return F.expr("array(" + ", ".join(f"{v}L" if v >= 0 else f"({v + 1}L - 1L)" for v in values) + ")")


def _shares(bands: list[Band], level: int, threshold: int, side: str, rows: int) -> list[tuple[Column, Band, int, int]]:
    """Cases of band and radius at a level, the first that holds applies: condition, band, shares of both sides.

    """
    _, wide, narrow_radius, wide_radius = _pieces(level, bands, threshold, side)
    any_wide = (threshold + 1) % (len(bands) - level) > 0
    cases = []
    for b in bands:
        here = F.col(f"{side}_band{level}") == b.number
        for condition, radius in [(here & wide, wide_radius)] * any_wide + [(here, narrow_radius)]:
            radius = max(radius, 0)
            cases.append((condition, b, *split_radius(b.width, radius, rows)))
    return cases


def _explode_near(df: DataFrame, bands: list[Band], level: int, threshold: int, side: str, rows: int) -> DataFrame:
    """One row per usable band and per key within the side's share of the band's radius."""
    df = _explode_own(df, bands, level, threshold, side)
    cases = [(condition, b, shares[side == "b"]) for condition, b, *shares in _shares(bands, level, threshold, side, rows)]
    if not any(radius for _, _, radius in cases):
        return df
    flips = F
    for condition, b, radius in cases:
        flips = flips.when(condition, _bigints(Band(b.number, b.shift, b.width, radius).flips()))
    key = f"{side}_key{level}"
    df = df.withColumn("_flip", F.explode(flips))
    return df.withColumn(key, F.col(key).bitwiseXOR(F.col("_flip"))).drop("_flip")


def _first_meeting(bands: list[Band], level: int, threshold: int, rows: int) -> Column:
    """Whether the probe side has flipped the lowest bits that differ in this band: true at one key for each pair."""
    cases = _shares(bands, level, threshold, "p", rows)
    if not any(build for *_, build in cases):
        return F.lit(True)
    kept = F
    for condition, b, probe, _ in cases:
        place = lambda v: F.shiftrightunsigned(v.bitwiseAND(F.lit(signed64(b.mask)).cast("bigint")), b.shift)  # noqa: B023, E731
        differ = place(F.col("p_phash").bitwiseXOR(F.col("b_phash")))
        flipped = place(F.col(f"p_key{level}").bitwiseXOR(F.col("p_phash")))
        rest = differ
        for _ in range(probe):
            rest = rest.bitwiseAND(rest - 1)
        kept = kept.when(condition, flipped.bitwiseXOR(rest) == differ)
    return kept


def _first_match(bands: list[Band], level: int, threshold: int) -> Column:
    """First usable band in which the pair is within the radius: the pair is kept there only."""
    share, extra = divmod(threshold + 1, len(bands) - level)
    used = [F.col(f"p_band{k}") for k in range(level)]
    differ = F.col("p_phash").bitwiseXOR(F.col("b_phash"))
    first = F
    for b in bands:
        place = F.lit(b.number)
        free = F.lit(True)
        for earlier in used:
            place = place - (earlier < b.number).cast("int")
            free = free & (earlier != b.number)
        radius = F.when(place < extra, share).otherwise(share - 1)
        apart = F.bit_count(differ.bitwiseAND(F.lit(signed64(b.mask)).cast("bigint")))
        first = first.when(free & (apart <= radius), F.lit(b.number))
    return first


def hamming_join(
    probe: DataFrame,
    build: DataFrame,
    threshold: int,
    rows: int,
    on: tuple[str, ...] = (),
    keep: Column | None = None,
    hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """Every (probe, build) pair with ``distance <= threshold``, each exactly once.

    Both tables hold a ``phash`` column, distinct within ``on``; ``on`` columns must be equal in a
    pair. The result has all probe columns prefixed ``p_``, all build columns prefixed ``b_`` and
    ``distance``. ``keep`` is an extra condition on the prefixed columns, applied inside the join.
    ``rows`` is the number of build rows; it picks the layout.

    Band keys with more than ``hot_bucket`` build rows are taken out of the join and split by the
    bands not used yet, which must cover the whole threshold among themselves; that repeats while
    keys stay overfull. Where splitting stops helping, build rows are salted and probe rows repeated.
    """
    p = probe.select(*[F.col(c).alias(f"p_{c}") for c in probe.columns])
    b = build.select(*[F.col(c).alias(f"b_{c}") for c in build.columns])
    out = [*p.columns, *b.columns]
    distance = hamming("p_phash", "b_phash")
    accept = distance <= threshold
    if keep is not None:
        accept = accept & keep
    bands = choose_bands(threshold, rows)
    if bands is None:
        return _block_join(p, b, on, accept, rows).select(*out, distance.alias("distance"))

    tasks = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(on)
    pairs: DataFrame | None = None
    for level in range(len(bands)):
        # A short table may sit in one file; its expansion and the candidates are what takes time.
        p = _explode_near(p.repartition(tasks, "p_phash"), bands, level, threshold, "p", rows)
        b = _explode_near(b.repartition(tasks, "b_phash"), bands, level, threshold, "b", rows)
        keys += [f"band{level}", f"key{level}"]
        accept = accept & (_first_match(bands, level, threshold) == F.col(f"p_band{level}"))
        accept = accept & _first_meeting(bands, level, threshold, rows)
        hot = None if level == 0 and rows <= hot_bucket else _hot_keys(b, keys, hot_bucket)
        if hot is None:
            return _join_all(pairs, _meet(p, b, keys, accept).select(*out), distance)
        cold = _meet(_only(p, hot, keys, "p", "left_anti"), _only(b, hot, keys, "b", "left_anti"), keys, accept)
        pairs = cold.select(*out) if pairs is None else pairs.unionByName(cold.select(*out))
        p = stage(_only(p, hot, keys, "p", "left_semi"), "hot-probes")
        b = stage(_only(b, hot, keys, "b", "left_semi"), "hot-rows")
        if _split_cost(bands, level + 1, threshold) > 0.5 or not _can_split(bands, level + 1, threshold, rows):
            break
    return _join_all(pairs, _salted(p, b, keys, accept, hot, hot_bucket).select(*out), distance)


def _join_all(pairs: DataFrame | None, last: DataFrame, distance: Column) -> DataFrame:
    return (last if pairs is None else pairs.unionByName(last)).withColumn("distance", distance)


def _hot_keys(b: DataFrame, keys: list[str], hot_bucket: int) -> DataFrame | None:
    """Keys with more build rows than allowed; a short list is marked to be sent out, a long one joins by key."""
    counts = b.groupBy(*[F.col(f"b_{k}").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    hot, seen = stage_measured(counts.where(F.col("n") > hot_bucket), "hot-keys", rows=F.count(F.lit(1)))
    if not seen["rows"]:
        return None
    return hot.hint("broadcast") if seen["rows"] <= MAX_HOT_KEYS else hot


def _only(df: DataFrame, hot: DataFrame, keys: list[str], side: str, how: str) -> DataFrame:
    names = hot.select(*[F.col(k).alias(f"{side}_{k}") for k in keys])
    return df.join(names, [f"{side}_{k}" for k in keys], how)


def _meet(p: DataFrame, b: DataFrame, keys: list[str], accept: Column) -> DataFrame:
    """The pairs at each key. The planner knows the short table, not the many rows it is expanded to, so it is told not to send them out."""
    same = [F.col(f"p_{k}") == F.col(f"b_{k}") for k in keys]
    return p.join(b.hint("merge"), [*same, accept])


def _salted(
    p: DataFrame, b: DataFrame, keys: list[str], accept: Column, hot: DataFrame, hot_bucket: int
) -> DataFrame:
    parts = F.ceil(F.col("n") / hot_bucket).cast("int").alias("parts")

    def with_parts(df: DataFrame, side: str) -> DataFrame:
        names = hot.select(*[F.col(k).alias(f"{side}_{k}") for k in keys], parts)
        return df.join(names, [f"{side}_{k}" for k in keys])

    p = with_parts(p, "p").withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    b = with_parts(b, "b").withColumn("b_salt", F.pmod(F.xxhash64("b_phash"), F.col("parts")).cast("int"))
    return _meet(p.drop("parts"), b.drop("parts"), [*keys, "salt"], accept)


def _block_join(p: DataFrame, b: DataFrame, on: tuple[str, ...], accept: Column, rows: int) -> DataFrame:
    """Distances too wide for bands: every build row in one of B blocks, every probe row in all.

    Work is inherently all pairs here; it is cut into even blocks by hash, so no task depends on
    how the fingerprints cluster.
    """
    blocks = max(1, ceil(rows / BLOCK_ROWS))
    p = p.withColumn("p_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = b.withColumn("b_block", F.pmod(F.xxhash64("b_phash"), F.lit(blocks)).cast("int"))
    pairs = _meet(p, b, [*on, "block"], accept)
    return pairs.drop("p_block", "b_block")


def region_links(regions: DataFrame, label: str, threshold: int, rows: int) -> DataFrame:
    """Some of the pairs ``(a, b)`` of labels that have fingerprints within ``threshold`` bits.

    In each band key a region is represented by one row, its head, which meets all rows of the other
    regions there. The work grows with rows times regions of a key, never with pairs of rows.
    """
    bands = choose_bands(threshold, rows)
    if bands is None:
        return regions.select(F.col(label).alias("a"), F.col(label).alias("b")).limit(0)
    sides = []
    for side in "pb":
        own = regions.select(F.col("phash").alias(f"{side}_phash"), F.col(label).alias(f"{side}_label"))
        sides.append(_explode_near(own, bands, 0, threshold, side, rows))
    p, b = sides
    heads = b.groupBy("b_band0", "b_key0", "b_label").agg(F.min("b_phash").alias("b_phash"))
    near = (hamming("p_phash", "b_phash") <= threshold) & (F.col("p_label") != F.col("b_label"))
    met = _meet(p, heads, ["band0", "key0"], near)
    return met.select(F.least("p_label", "b_label").alias("a"), F.greatest("p_label", "b_label").alias("b")).distinct()


def similar_pairs(
    fingerprints: DataFrame,
    threshold: int,
    rows: int,
    differ_in: str | None = None,
    hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """All unordered pairs ``(a, b, distance)`` of a table of distinct ``phash`` values.

    ``differ_in`` names a column (such as a group label) that must differ; pairs inside one label
    are dropped in the join and never leave it.
    """
    keep = F.col("p_phash") < F.col("b_phash")
    columns = ["phash"]
    if differ_in is not None:
        columns.append(differ_in)
        keep = keep & (F.col(f"p_{differ_in}") != F.col(f"b_{differ_in}"))
    side = fingerprints.select(*columns)
    pairs = hamming_join(side, side, threshold, rows, keep=keep, hot_bucket=hot_bucket)
    out = [F.col("p_phash").alias("a"), F.col("b_phash").alias("b"), "distance"]
    if differ_in is not None:
        out += [F.col(f"p_{differ_in}").alias(f"a_{differ_in}"), F.col(f"b_{differ_in}").alias(f"b_{differ_in}")]
    return pairs.select(*out)
