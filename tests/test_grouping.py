"""Grouping: expectations on hand-built records and checks against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import brute_components, brute_pairs, distance, rec, records
from twinsift.functions.bits import signed64
from twinsift.operators import components, diameter, group
from twinsift.operators.components import connected_components
from twinsift.operators.diameter import max_hamming
from twinsift.operators.group import _merge_dense, fingerprint_components, prune_pixel_hash, scan
from twinsift.operators.hamming import _volume, choose_bands, layout, region_links, similar_pairs, split_radius
from twinsift.operators.lookup import expand_join
from twinsift.operators.positions import with_position

ONES = (1 << 64) - 1


def groups_of(grouping):
    rows = {r.group_id: r.asDict() for r in grouping.groups.collect()}
    for r in grouping.members.orderBy("path").collect():
        rows[r.group_id].setdefault("members", []).append(r.path)
    return [rows[k] for k in sorted(rows)]


def test_exact_groups_equal_content(spark):
    df = records(spark, [rec("b", sha="AA"), rec("a", sha="AA"), rec("c", sha="BB")])
    (g,) = groups_of(scan(df, "exact"))
    assert (g["group_id"], g["members"], g["auto_deletable"], g["max_hamming"]) == (0, ["a", "b"], True, None)


def test_pixel_ignores_missing_hash(spark):
    df = records(
        spark,
        [rec("a", sha="1", pixel="P"), rec("b", sha="2", pixel="P"), rec("c", sha="3"), rec("d", sha="4", pixel="P")],
    )
    (g,) = groups_of(scan(df, "pixel"))
    assert g["members"] == ["a", "b", "d"]


def test_chain_joins_beyond_threshold(spark):
    df = records(spark, [rec(p, sha=p, phash=h) for p, h in (("a", 0), ("b", 3), ("c", 15))])
    (g,) = groups_of(scan(df, "perceptual", 2))
    assert (g["members"], g["max_hamming"], g["auto_deletable"]) == (["a", "b", "c"], 4, False)


def test_far_apart_is_no_group(spark):
    df = records(spark, [rec("a", sha="1", phash=0), rec("b", sha="2", phash=ONES)])
    assert groups_of(scan(df, "perceptual", 10)) == []


def test_default_threshold_and_wide_threshold(spark):
    df = records(spark, [rec("a", sha="1", phash=0), rec("b", sha="2", phash=0x1F), rec("c", sha="3")])
    (g,) = groups_of(scan(df))
    assert (g["members"], g["max_hamming"]) == (["a", "b"], 5)
    df = records(spark, [rec("a", sha="1", phash=0), rec("b", sha="2", phash=ONES)])
    (g,) = groups_of(scan(df, "perceptual", 64))
    assert g["max_hamming"] == 64


def test_copies_share_a_node(spark):
    df = records(spark, [rec(p, sha=p, phash=7) for p in "abc"])
    (g,) = groups_of(scan(df, "perceptual", 0))
    assert (g["members"], g["max_hamming"]) == (["a", "b", "c"], 0)


def test_keeper_rules(spark):
    df = records(
        spark,
        [
            rec("a", 999, 10, 10, "1"), rec("b", 1, 20, 20, "1"),
            rec("x", 5, 10, 10, "2"), rec("y", 9, 10, 10, "2"),
            rec("zzz", 5, 10, 10, "3"), rec("aaa", 5, 10, 10, "3"),
        ],
    )
    by_keeper = {g["keeper"]: g["reclaimable_bytes"] for g in groups_of(scan(df, "exact"))}
    assert by_keeper == {"b": 999, "y": 5, "aaa": 5}


def test_area_does_not_overflow(spark):
    df = records(spark, [rec("a", 1, 60000, 60000, "1"), rec("b", 2, 50000, 50000, "1")])
    (g,) = groups_of(scan(df, "exact"))
    assert g["keeper"] == "a"


def test_unique_records_form_no_group_and_ids_follow_first_path(spark):
    df = records(spark, [rec("a", sha="S1"), rec("b", sha="S2")])
    assert groups_of(scan(df, "exact")) == []
    df = records(spark, [rec(p, sha=s) for p, s in (("m", "G2"), ("z", "G2"), ("a", "G1"), ("b", "G1"))])
    got = groups_of(scan(df, "exact"))
    assert [(g["group_id"], g["members"]) for g in got] == [(0, ["a", "b"]), (1, ["m", "z"])]


def test_unknown_strictness(spark):
    with pytest.raises(ValueError):
        scan(records(spark, [rec("a")]), "fuzzy")


def test_stats_and_display_order(spark):
    df = records(spark, [rec("a", 1, sha="1"), rec("b", 7, sha="1"), rec("c", 3, sha="2")])
    grouping = scan(df, "exact")
    row = grouping.stats().first()
    assert row.asDict() == {
        "scanned": 3, "skipped": 0, "groups": 1, "duplicates": 1, "reclaimable_bytes": 1, "reclaimable_auto": 1,
    }
    shown = [r.path for r in grouping.display_members().orderBy("group_id", "rank_key").collect()]
    assert shown == ["b", "a"]
    df = records(spark, [rec("a", 1, phash=0), rec("b", 7, phash=1)])
    row = scan(df, "perceptual", 4).stats().first()
    assert (row.reclaimable_bytes, row.reclaimable_auto) == (1, 0)


def test_row_order_does_not_matter(spark):
    rng = random.Random(5)
    rows = [rec(f"p{i}", i, 1, 1, f"s{i}", None, rng.getrandbits(6)) for i in range(40)]
    first = groups_of(scan(records(spark, rows), "perceptual", 1))
    rng.shuffle(rows)
    assert groups_of(scan(records(spark, rows), "perceptual", 1)) == first


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_prune(spark, hot_rows):
    rows = [rec(p, sha=p, pixel="P" + p, phash=h) for p, h in zip("abcdefg", (1, 1, 2, 3, 3, 3, 3))]
    rows.append(rec("h", pixel="Ph"))
    got = {r.path: r.pixel_sha256 for r in prune_pixel_hash(records(spark, rows), hot_rows).collect()}
    assert got == {"a": "Pa", "b": "Pb", "c": None, "d": "Pd", "e": "Pe", "f": "Pf", "g": "Pg", "h": None}


def test_hot_group_is_salted(spark):
    rows = [rec(f"p{i:03d}", i, sha="hot") for i in range(60)] + [rec("q", sha="x"), rec("r", sha="x")]
    cold = groups_of(scan(records(spark, rows), "exact"))
    assert groups_of(scan(records(spark, rows), "exact", hot_rows=7)) == cold
    assert len(cold[0]["members"]) == 60


def test_expand_join_left_keeps_everything(spark):
    left = spark.range(50).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, 17, "x"), (1, 17, "y")], "k long, n long, v string")
    got = expand_join(left, right, "k", "n", how="left", hot_rows=5)
    assert sorted((r.id, r.v) for r in got.collect()) == [(i, {0: "x", 1: "y"}.get(i % 3)) for i in range(50)]


def test_positions(spark):
    df = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).repartition(7)
    numbered, seen = with_position(df, ["k"], "pos", longest=F.max(F.length("k")))
    assert seen == {"rows": 1000, "longest": 64}
    got = [(r.pos, r.k) for r in numbered.collect()]
    assert [k for _, k in sorted(got)] == sorted(k for _, k in got)
    assert sorted(p for p, _ in got) == list(range(1000))


def clustered(rng, n, spread):
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 12))]
    out = set()
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.randrange(spread)):
            v ^= 1 << rng.randrange(64)
        out.add(signed64(v))
    return sorted(out)


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "phash long")


def test_layouts_cover_the_threshold():
    for threshold in range(0, 33):
        for count in range(1, threshold + 2):
            bands = layout(count, threshold)
            assert sum(b.radius + 1 for b in bands) == threshold + 1
        bands = choose_bands(threshold, 10**6)
        if bands:
            assert sum(b.radius + 1 for b in bands) == threshold + 1
    assert choose_bands(40, 10**6) is None
    wide, narrow = choose_bands(10, 10**9), choose_bands(10, 10**3)
    assert len(wide) < len(narrow)


@pytest.mark.parametrize("threshold", [0, 1, 4, 10, 13, 33])
def test_pairs_equal_brute_force(spark, threshold):
    values = clustered(random.Random(threshold), 150, 9)
    got = {(r.a, r.b, r.distance) for r in similar_pairs(frame(spark, values), threshold, len(values)).collect()}
    assert got == brute_pairs(values, threshold)


@pytest.mark.parametrize("threshold", [3, 4, 7])
def test_hot_band_keys_are_split_exactly(spark, threshold):
    rng = random.Random(11)
    # Every fingerprint shares its upper half: most band keys are overfull.
    values = sorted({signed64((0xABCD << 48) | rng.getrandbits(14) | (rng.getrandbits(3) << 30)) for _ in range(200)})
    pairs = similar_pairs(frame(spark, values), threshold, len(values), hot_bucket=8)
    got = [(r.a, r.b, r.distance) for r in pairs.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(values, threshold)


@pytest.mark.parametrize("threshold,hot_bucket", [(8, 10**6), (10, 10**6), (10, 40)])
def test_two_sided_bands_equal_brute_force(spark, threshold, hot_bucket):
    """Layouts of a billion rows: wide bands, keys flipped on both sides, pairs that meet at many keys."""
    assert any(split_radius(b.width, b.radius, 10**9)[1] for b in choose_bands(threshold, 10**9))
    values = clustered(random.Random(threshold), 60, 6)
    pairs = similar_pairs(frame(spark, values), threshold, 10**9, hot_bucket=hot_bucket).collect()
    got = [(r.a, r.b, r.distance) for r in pairs]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(values, threshold)


def test_two_sided_bands_cost_less():
    """Candidates of a row at 1e9 rows and 10 bits, against the one-sided layout with the fewest."""
    rows = 10**9
    met = lambda bands, shares: sum(
        _volume(b.width, p) * _volume(b.width, q) * rows / 2**b.width for b, (p, q) in zip(bands, shares)
    )
    chosen = choose_bands(10, rows)
    two = met(chosen, [split_radius(b.width, b.radius, rows) for b in chosen])
    one_sided = [layout(n, 10) for n in range(2, 12)]
    one_sided = [bands for bands in one_sided if max(b.volume for b in bands) <= 5_000]
    one = min(met(bands, [(b.radius, 0) for b in bands]) for bands in one_sided)
    assert two < one / 2 and one > 1_400_000


def test_dense_neighbours_take_linear_work(spark):
    """Two balls of fingerprints, near each other: heads link them, so no row of one meets all rows of the other."""
    rng = random.Random(3)
    base, far = rng.getrandbits(64), sum(1 << b for b in (1, 9, 22, 35, 48, 60))
    values = {}
    for label, centre in ((0, base), (1, base ^ far), (2, ~base & (2**64 - 1))):
        for _ in range(3_000):
            values[signed64(centre ^ sum(1 << b for b in rng.sample(range(64), 2)))] = label
    table = spark.createDataFrame(list(values.items()), "phash long, region int")
    links = region_links(table, "region", 6, len(values))
    assert [tuple(r) for r in links.collect()] == [(0, 1)]
    merged = table.select("phash", F.col("region").cast("bigint").alias("component"))
    after = _merge_dense(merged, 6, len(values), 10**6).groupBy("component").count().collect()
    assert len(after) == 2
    left = similar_pairs(table.withColumn("region", F.col("region") % 2), 6, len(values), differ_in="region")
    assert left.count() > 0


@pytest.mark.parametrize("hot_rows,short,last", [(3, 10**6, 0), (10**6, 10**6, 0), (3, 0, 0), (3, 0, 50), (3, 0, 10**6)])
def test_components_equal_union_find(spark, monkeypatch, hot_rows, short, last):
    monkeypatch.setattr(components, "SHORT_TABLE", short)
    monkeypatch.setattr(components, "LAST_EDGES", last)
    rng = random.Random(2)
    nodes = list(range(120))
    edges = [(i, i + 1) for i in range(0, 39)]  # a long chain
    edges += [(60, i) for i in range(61, 80)]  # a hub
    edges += [(rng.randrange(80, 120), rng.randrange(80, 120)) for _ in range(30)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {}
    for r in connected_components(df, hot_rows).collect():
        found.setdefault(r.component, set()).add(r.node)
    touched = {n for e in edges if e[0] != e[1] for n in e}
    want = brute_components(sorted(touched), edges)
    assert {frozenset(g) for g in found.values()} == want


@pytest.mark.parametrize("threshold,dense", [(2, 256), (4, 2), (10, 2), (10, 256)])
def test_merge_first_gives_the_same_components(spark, monkeypatch, threshold, dense):
    monkeypatch.setattr(group, "DENSE", dense)
    values = clustered(random.Random(threshold), 200, 8)
    df = frame(spark, values)
    want = brute_components(values, [(a, b) for a, b, _ in brute_pairs(values, threshold)])
    for hot_rows, hot_bucket in ((5, 20), (10**6, 10**6)):
        found = {}
        labels = fingerprint_components(df, threshold, len(values), hot_rows=hot_rows, hot_bucket=hot_bucket)
        for r in labels.collect():
            found.setdefault(r.component, set()).add(r.phash)
        assert {frozenset(g) for g in found.values()} == want


def test_max_hamming_of_every_kind_of_group(spark):
    rng = random.Random(4)
    ball = {0} | {sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(60)}
    spread = {rng.getrandbits(64) for _ in range(70)}
    narrow = {rng.getrandbits(9) << 20 for _ in range(50)}
    lopsided = {rng.getrandbits(30) for _ in range(40)} | {0b111 << 60}
    sets = {1: {5}, 2: {5, 6}, 3: {1, 2, 4, 8}, 4: ball, 5: spread, 6: narrow, 7: lopsided}
    rows = [(k, signed64(v)) for k, vs in sets.items() for v in vs]
    df = spark.createDataFrame(rows, "component long, phash long")
    want = {k: max([distance(a, b) for a in vs for b in vs]) for k, vs in sets.items()}
    for small in (2, 10, 1000):
        got = max_hamming(df, small_group=small, hot_rows=20, hot_bucket=10)
        assert {r.component: r.max_hamming for r in got.collect()} == want


def test_expanded_rows_are_never_broadcast(spark):
    pairs = similar_pairs(frame(spark, range(64)), 10, 500_000)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_deep_levels_hold_no_long_lists_of_flips(spark):
    """Three bands for threshold 10: the last one alone would need lists of 35,443 flips, so its rows are salted instead."""
    base = 0x0F0F_33CC_5555_AA00
    values = [base ^ (1 << a) ^ (1 << b) for a in range(7) for b in range(a)]
    pairs = similar_pairs(frame(spark, values), 10, 3_000_000, hot_bucket=8)
    assert len(pairs._jdf.queryExecution().analyzed().toString()) < 2_000_000
    assert {(r.a, r.b, r.distance) for r in pairs.collect()} == brute_pairs(values, 10)


def test_a_crowd_is_joined_before_its_pairs_are_formed(spark, monkeypatch):
    """All within five bits of one centre, none within a window: 45,000 pairs that need not be listed."""
    random.seed(9)
    crowd = sorted({signed64(sum(1 << bit for bit in random.sample(range(64), 5))) for _ in range(300)})
    far = [signed64((1 << 64) - 1), signed64((1 << 64) - 2)]
    probes, real = [], group.hamming_join
    monkeypatch.setattr(group, "hamming_join", lambda p, *a, **k: probes.append(p.count()) or real(p, *a, **k))
    found = fingerprint_components(frame(spark, crowd + far), 10, len(crowd) + 2).collect()
    by = {r.phash: r.component for r in found}
    assert len({by[v] for v in crowd}) == 1 and by[far[0]] == by[far[1]] != by[crowd[0]]
    assert probes == [2]
    assert fingerprint_components(frame(spark, []), 10, 0).collect() == []


@pytest.mark.parametrize("threshold,lags", [(3, 4), (10, 1), (10, 64)])
def test_sorted_passes_give_the_same_components(spark, monkeypatch, threshold, lags):
    for name, value in (("SORTED_ROWS", 0), ("SORTED_LAGS", lags), ("_SORTED_BATCH", 30), ("PIVOTS", 1)):
        monkeypatch.setattr(group, name, value)
    values = clustered(random.Random(threshold), 200, 8) + [-(1 << 63), (1 << 63) - 1, 0, -1]
    values = sorted(set(values))
    want = brute_components(values, [(a, b) for a, b, _ in brute_pairs(values, threshold)])
    for hot_rows in (5, 10**6):
        found = {}
        for r in fingerprint_components(frame(spark, values), threshold, len(values), hot_rows=hot_rows).collect():
            found.setdefault(r.component, set()).add(r.phash)
        assert {frozenset(g) for g in found.values()} == want


def test_sorted_neighbours_are_joined_before_pairs_are_formed(spark, monkeypatch):
    """A ring of 400 fingerprints, each eight bits from the next: one pivot reaches few of them, and no window any."""
    monkeypatch.setattr(group, "SORTED_ROWS", 0, raising=False)
    monkeypatch.setattr(group, "PIVOTS", 1)
    rng, value, ring = random.Random(6), 0, set()
    for _ in range(400):
        value ^= sum(1 << bit for bit in rng.sample(range(64), 8))
        ring.add(signed64(value))
    probes, real = [], group.hamming_join
    monkeypatch.setattr(group, "hamming_join", lambda p, *a, **k: probes.append(p.count()) or real(p, *a, **k))
    found = fingerprint_components(frame(spark, sorted(ring)), 10, len(ring)).collect()
    assert len({r.component for r in found}) == 1
    assert probes[0] < 20


def test_fingerprints_on_the_rim_close_the_gap(spark, monkeypatch):
    """Two sweeps find 23 of 24 bits here, twice the greatest distance to the centre; the rim finds all, so no pairs are compared."""
    rng = random.Random(10)
    values = sorted({signed64(sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 13)))) for _ in range(300)})
    compared, real = [], diameter._wider_by_blocks
    monkeypatch.setattr(diameter, "_wider_by_blocks", lambda live, *a: compared.append(live.count()) or real(live, *a))
    df = spark.createDataFrame([(1, v) for v in values], "component long, phash long")
    assert [r.max_hamming for r in max_hamming(df, small_group=10).collect()] == [24]
    assert max(distance(a, b) for a in values for b in values) == 24
    assert compared == []
