"""One-against-many lookups: ranked matches of query records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from twinsift.functions.bits import hamming
from twinsift.operators.hamming import hamming_join
from twinsift.operators.storage import stage, stage_measured
from twinsift.schemas import DEFAULT_THRESHOLD

# With more record fingerprints than this, queries that find enough close by are not looked up any farther.
CLOSE_ROWS = 50_000
# Fixed order of the match tiers.
TIERS = ("exact", "pixel", "perceptual")
MATCH_COLUMNS = ["path", "bytes", "width", "height", "format", "tier", "hamming"]


def tier_rank(tier: Column | str) -> Column:
    tier = F.col(tier) if isinstance(tier, str) else tier
    rank = F
    for i, name in enumerate(TIERS):
        rank = rank.when(tier == name, i)
    return rank


@dataclass
class Found:
    """Matches of one query. ``matches`` is sorted; ``stats`` counts what is left after ``top``."""

    query: Row
    threshold: int
    matches: DataFrame
    _records: DataFrame

    @property
    def query_schema(self):
        return self._records.schema

    def stats(self, skipped: DataFrame | None = None) -> DataFrame:
        return find_stats(self._records, self.matches, skipped)


def find(
    query: DataFrame | Row,
    records: DataFrame,
    threshold: int = DEFAULT_THRESHOLD,
    top: int | None = None,
    query_path: str | None = None,
) -> Found:
    """Rank all records against one query record: tier, then distance, then path.

    The query is one row, so its values become literals: the job is a filter over the records and,
    with ``top``, a bounded top-n. The record that *is* the query (same ``path`` as ``query_path``)
    is left out, other copies of it stay.
    """
    if isinstance(query, DataFrame):
        rows = query.limit(2).collect()
        if len(rows) != 1:
            raise ValueError("find takes exactly one query record; use find_batch for more")
        query = rows[0]
    distance = hamming(F.col("phash"), F.lit(query["phash"]).cast("bigint"))
    tier = (
        F.when(F.col("sha256") == F.lit(query["sha256"]), "exact")
        .when(F.col("pixel_sha256") == F.lit(query["pixel_sha256"]), "pixel")
        .when(distance <= threshold, "perceptual")
    )
    matched = records.withColumn("hamming", distance).withColumn("tier", tier)
    matched = matched.where(F.col("tier").isNotNull())
    if query_path is not None:
        matched = matched.where(~((F.col("tier") == "exact") & (F.col("path") == query_path)))
    matched = matched.select(*MATCH_COLUMNS).orderBy(tier_rank("tier"), "hamming", "path")
    if top is not None:
        matched = matched.limit(top)
    return Found(query, threshold, matched, records)


def find_batch(
    queries: DataFrame,
    records: DataFrame,
    threshold: int = DEFAULT_THRESHOLD,
    top: int | None = None,
) -> DataFrame:
    """Matches of a whole table of queries, ranked within each ``query_id`` from 1.

    ``queries`` has ``query_id``, ``sha256``, ``pixel_sha256``, ``phash`` and ``query_path`` (null
    where the query is not one of the records). Copies among the queries are looked up once. The
    tiers are three equi-joins that exclude each other: content hash, pixel hash, and the banded
    join of distinct fingerprints.

    With ``top`` no join meets the records themselves, but tables of heads: of all records with one
    content (pixel) hash and fingerprint, and of all with one fingerprint, the first ``top + 1`` paths
    (a query may have to leave itself out). All records behind a head are at the same distance from
    any query and come later in path order, and those before it are as good or better in tier, so
    nothing that ranks is lost. Matches of a fingerprint are cut to ``top + 1`` before they meet the
    queries that have it (see :func:`_near` for what is not looked up at all): at most ``3 (top + 1)`` rows for each content asked for, however many
    records share its hashes. Heads are cut before the shuffle, so a hot hash stays small.
    """
    content = ["sha256", "pixel_sha256", "phash"]
    distinct = stage(queries.select(*content).distinct(), "query-contents").select(
        *[F.col(c).alias(f"q_{c}") for c in content]
    )
    other_sha = F.col("sha256") != F.col("q_sha256")
    other_pixel = ~F.coalesce(F.col("pixel_sha256") == F.col("q_pixel_sha256"), F.lit(False))

    by_sha, by_pixel, by_phash = (_heads(records, keys, top) for keys in (["sha256", "phash"], ["pixel_sha256", "phash"], ["phash"]))
    exact = by_sha.join(distinct, F.col("sha256") == F.col("q_sha256")).withColumn("tier", F.lit("exact"))
    pixel = by_pixel.join(
        distinct, (F.col("pixel_sha256") == F.col("q_pixel_sha256")) & other_sha
    ).withColumn("tier", F.lit("pixel"))

    asked = distinct.where("q_phash is not null").select(F.col("q_phash").alias("phash")).distinct()
    counts = records.where("phash is not null").groupBy("phash").agg(F.count(F.lit(1)).alias("n"))
    known, seen = stage_measured(counts, "record-phashes", rows=F.count(F.lit(1)))
    near = _near(asked, known, threshold, seen["rows"], top)
    by_query = by_phash.join(near, "phash")
    if top is not None:
        nearest = Window.partitionBy("q_phash").orderBy(hamming("phash", "q_phash"), "path")
        by_query = _first(by_query, nearest, top + 1)
    perceptual = (
        by_query.join(distinct, "q_phash")
        .where(other_sha & other_pixel)
        .withColumn("tier", F.lit("perceptual"))
    )

    columns = ["path", "bytes", "width", "height", "format", "phash", "tier"]
    columns += [f"q_{c}" for c in content]
    hits = exact.select(*columns).unionByName(pixel.select(*columns)).unionByName(perceptual.select(*columns))
    hits = hits.withColumn("hamming", hamming("phash", "q_phash")).drop("phash")
    order = [tier_rank("tier"), F.col("hamming"), F.col("path")]
    if top is not None:
        per_content = Window.partitionBy(*[f"q_{c}" for c in content]).orderBy(*order)
        hits = _first(hits, per_content, top + 1)

    same = [F.col(c).eqNullSafe(F.col(f"q_{c}")) for c in content]
    answered = queries.join(hits, same)
    is_self = (F.col("tier") == "exact") & (F.col("path") == F.col("query_path"))
    answered = answered.where(~F.coalesce(is_self, F.lit(False)))
    if top is None:
        return answered.select("query_id", *MATCH_COLUMNS)
    ranked = answered.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", *MATCH_COLUMNS)


def _near(asked: DataFrame, known: DataFrame, threshold: int, rows: int, top: int | None) -> DataFrame:
    """``(q_phash, phash)`` of all fingerprints that hold one of the ``top + 1`` nearest records, or of all within ``threshold``.

    On a large table with ``top``, a narrow join goes first: a fingerprint that finds ``top + 1`` records there has no use
    for those farther away, so the crowded ones do not take part in the wide join. Of all that is found, fingerprints go
    that are farther away than ``top + 1`` others; those at the same distance stay, as paths decide between them.
    """
    pair = [F.col("p_phash").alias("q_phash"), F.col("b_phash").alias("phash")]
    if top is None:
        return hamming_join(asked, known.select("phash"), threshold, rows).select(*pair)
    nearest = Window.partitionBy("q_phash").orderBy("distance")

    def cut(found: DataFrame) -> DataFrame:
        return found.withColumn("_n", F.rank().over(nearest)).where(F.col("_n") <= top + 1).drop("_n")

    parts = []
    close = threshold // 3
    if rows > CLOSE_ROWS and close:
        found = hamming_join(asked, known, close, rows)
        found = stage(cut(found.select(*pair, "distance", F.col("b_n").alias("n"))), "close")
        enough = found.groupBy("q_phash").agg(F.sum("n").alias("_records")).where(F.col("_records") > top)
        enough = stage(enough.select("q_phash"), "answered")
        parts.append(found.join(enough, "q_phash", "left_semi"))
        asked = stage(asked.join(enough.withColumnRenamed("q_phash", "phash"), "phash", "left_anti"), "open-queries")
    found = hamming_join(asked, known.select("phash"), threshold, rows)
    parts.append(cut(found.select(*pair, "distance")))
    near = parts[0].select("q_phash", "phash")
    return near.unionByName(parts[1].select("q_phash", "phash")) if len(parts) > 1 else near


def _first(rows: DataFrame, window, n: int) -> DataFrame:
    """The first ``n`` rows of each window; Spark cuts each task's share before it shuffles."""
    return rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")


def _heads(records: DataFrame, keys: list[str], top: int | None) -> DataFrame:
    """The records that can rank among the best ``top`` by their first key; all of them without ``top``."""
    if top is None:
        return records
    return _first(records.where(F.col(keys[0]).isNotNull()), Window.partitionBy(*keys).orderBy("path"), top + 1)


def find_stats(records: DataFrame, matches: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: records searched, skipped, matches reported."""
    one = F.lit(1).alias("_one")
    count = F.count(F.lit(1))
    out = records.agg(count.alias("scanned")).select("*", one)
    out = out.join(matches.agg(count.alias("matched")).select("*", one), "_one")
    if skipped is None:
        out = out.withColumn("skipped", F.lit(0).cast("bigint"))
    else:
        out = out.join(skipped.agg(count.alias("skipped")).select("*", one), "_one")
    return out.select("scanned", "skipped", "matched")
