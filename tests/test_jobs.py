"""Find, clean-up, index life cycle, names, paths and reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import distance, rec, records
from twinsift.functions.bits import signed64
from twinsift.functions.paths import (
    has_extension, human_size, inside_root, normalize_ext, now_rfc3339, parse_extensions, plain_uri, relative_path, verdict,
)
from twinsift.operators import find as find_module
from twinsift.operators.clean import plan_clean, plan_deletions, reconcile
from twinsift.operators.find import _heads, find, find_batch
from twinsift.operators.group import prune_pixel_hash, scan
from twinsift.operators.index import cache_hits, cache_misses, collect_garbage, index, latest, orphans, read_index, refresh
from twinsift.operators.names import unique_paths
from twinsift.operators.report import (
    asset_data, asset_path, clean_report, compare_report, find_report, scan_report, write_report,
)
from twinsift.schemas import HASH_ALGO, HASH_INDEX_SCHEMA

POOL = [
    rec("q.png", sha="Q", pixel="P", phash=0),
    rec("copy.png", sha="Q", pixel="P", phash=0),
    rec("reencoded.png", sha="R", pixel="P", phash=0),
    rec("other-dims.png", sha="D", pixel="P", phash=0xFFF),
    rec("near-b.png", sha="N1", pixel="x", phash=1),
    rec("near-a.png", sha="N2", pixel="y", phash=2),
    rec("far.png", sha="F", pixel="z", phash=0xFFFF),
    rec("nohash.png", sha="H"),
]


def found(df):
    return [(r.path, r.tier, r.hamming) for r in df.collect()]


def test_find_ranks_tiers_distance_path(spark):
    pool = records(spark, POOL)
    query = pool.where("path = 'q.png'")
    want = [
        ("copy.png", "exact", 0), ("reencoded.png", "pixel", 0), ("other-dims.png", "pixel", 12),
        ("near-a.png", "perceptual", 1), ("near-b.png", "perceptual", 1),
    ]
    result = find(query, pool, 10, query_path="q.png")
    assert found(result.matches) == want
    assert result.stats().first().asDict() == {"scanned": 8, "skipped": 0, "matched": 5}
    # Without a path of its own the query excludes nothing.
    assert found(find(query, pool, 10).matches)[:2] == [("copy.png", "exact", 0), ("q.png", "exact", 0)]
    top = find(query, pool, 10, top=2, query_path="q.png")
    assert found(top.matches) == want[:2]
    assert top.stats().first().matched == 2
    with pytest.raises(ValueError):
        find(pool, pool)


def test_find_batch_equals_single_finds(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        h = rng.choice([0, 1 << 40]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4)))
        rows.append(rec(f"p{i:02d}", i, sha=f"s{rng.randrange(25)}", pixel=f"x{rng.randrange(30)}", phash=h))
    pool = records(spark, rows).cache()
    queries = pool.select(
        F.col("path").alias("query_id"), "sha256", "pixel_sha256", "phash", F.col("path").alias("query_path")
    ).where("path < 'p12'")
    singles = {q.path: find(q, pool, 5, query_path=q.path).matches.collect() for q in pool.where("path < 'p12'").collect()}
    everything = {}
    for r in find_batch(queries, pool, 5).collect():
        everything.setdefault(r.query_id, set()).add((r.path, r.tier, r.hamming))
    assert everything == {k: {(m.path, m.tier, m.hamming) for m in v} for k, v in singles.items() if v}
    best = {}
    for r in find_batch(queries, pool, 5, top=3).orderBy("rank").collect():
        best.setdefault(r.query_id, []).append((r.path, r.tier, r.hamming))
    assert best == {k: [(m.path, m.tier, m.hamming) for m in v[:3]] for k, v in singles.items() if v}


@pytest.mark.parametrize("top", [1, 3])
def test_find_batch_looks_close_by_first(spark, monkeypatch, top):
    """Crowded fingerprints find their best matches within a third of the threshold and stay out of the wide join."""
    monkeypatch.setattr(find_module, "CLOSE_ROWS", 0, raising=False)
    rng = random.Random(top)
    rows = []
    for i in range(150):
        h = rng.choice([0, (1 << 40) - 1]) ^ sum(1 << bit for bit in rng.sample(range(64), rng.randrange(3)))
        rows.append(rec(f"p{i:03d}", i, sha=f"s{rng.randrange(60)}", pixel=f"x{rng.randrange(80)}", phash=h))
    for i in range(20):
        rows.append(rec(f"r{i:03d}", i, sha=f"r{i}", pixel=None, phash=0x5555 << 40 ^ sum(1 << bit for bit in rng.sample(range(64), 3))))
    rows.append(rec("none", 1, sha="none"))
    pool = records(spark, rows).cache()
    queries = pool.select(
        F.col("path").alias("query_id"), "sha256", "pixel_sha256", "phash", F.col("path").alias("query_path")
    )
    wide, real = [], find_module.hamming_join
    monkeypatch.setattr(
        find_module, "hamming_join", lambda p, b, t, *a, **k: (t == 6 and wide.append(p.count())) or real(p, b, t, *a, **k)
    )
    best = {}
    for r in find_batch(queries, pool, 6, top=top).orderBy("rank").collect():
        best.setdefault(r.query_id, []).append((r["rank"], r.path, r.tier, r.hamming))
    want = {}
    tiers = ["exact", "pixel", "perceptual"]
    for path, *_, sha, pixel, h in rows:
        hits = []
        for other, *_, sha2, pixel2, h2 in rows:
            bits = None if h is None or h2 is None else distance(h, h2)
            tier = 0 if sha == sha2 else 1 if pixel and pixel == pixel2 else 2 if bits is not None and bits <= 6 else None
            if tier is not None and other != path:
                hits.append((tier, bits, other))
        if hits:
            want[path] = [(k + 1, other, tiers[tier], bits) for k, (tier, bits, other) in enumerate(sorted(hits)[:top])]
    assert best == want
    assert wide[0] < len({r[-1] for r in rows}) / 2


def test_find_batch_meets_heads_only(spark):
    """5,000 records on one fingerprint: as many contents, then one content."""
    rows = [rec(f"p{i:04d}", i, sha=f"s{i}", pixel=f"x{i // 2}", phash=7) for i in range(5_000)]
    rows += [rec(f"q{i:04d}", i, sha="same", pixel="same", phash=3) for i in range(5_000)]
    pool = records(spark, rows)
    assert _heads(pool, ["phash"], 3).count() == 8 and _heads(pool, ["sha256", "phash"], 3).count() == 5_004
    queries = pool.select(
        F.col("path").alias("query_id"), "sha256", "pixel_sha256", "phash", F.col("path").alias("query_path")
    )
    found = find_batch(queries, pool, 1, top=3)
    answers = {}
    for r in found.collect():
        answers.setdefault(r.query_id, []).append((r["rank"], r.path, r.tier, r.hamming))
    assert len(answers) == 10_000
    # Each joined to at most four rows of each tier, against 5,000 or 10,000 before.
    want = [(1, "p0000", "pixel", 0), (2, "p0002", "perceptual", 0), (3, "p0003", "perceptual", 0)]
    assert sorted(answers["p0001"]) == want
    assert sorted(answers["q0001"]) == [(n + 1, p, "exact", 0) for n, p in enumerate(["q0000", "q0002", "q0003"])]
    assert sorted(answers["p4000"])[0] == (1, "p4001", "pixel", 0)


def test_pixel_prune_hides_cross_size_twins_from_scan_only(spark):
    """Equal bytes at other dimensions: find sees the pixel tier, a pruned scan has no group."""
    rows = [rec("a", w=8, h=4, sha="1", pixel="P", phash=1), rec("b", w=4, h=8, sha="2", pixel="P", phash=6)]
    df = records(spark, rows)
    assert scan(prune_pixel_hash(df), "pixel").groups.count() == 0
    assert found(find(df.where("path = 'a'"), df, 0, query_path="a").matches) == [("b", "pixel", 3)]


def test_plan_of_given_groups(spark):
    df = records(spark, [rec("a", 10), rec("b", 20), rec("c", 30)])
    members = spark.createDataFrame([(0, p, "a") for p in "abcx"], "group_id long, path string, keeper string")
    groups = spark.createDataFrame([(0, True, 4)], "group_id long, auto_deletable boolean, n_members long")
    plan = {r.path: r.bytes for r in plan_deletions(df, groups, members).collect()}
    assert plan == {"b": 20, "c": 30, "x": 0}
    held = groups.withColumn("auto_deletable", F.lit(False))
    assert plan_deletions(df, held, members).count() == 0


def test_clean(spark):
    rows = [
        rec("r/a", 10, sha="1", pixel="P"), rec("r/b", 20, sha="2", pixel="P"), rec("r/../c", 5, sha="3", pixel="P"),
        rec("s/d", 5, sha="4", pixel="P"), rec("r/e", 7, sha="5", pixel="E"),
    ]
    plan = plan_clean(records(spark, rows), root="r")
    assert {(r.path, r.bytes, r.keeper) for r in plan.plan.collect()} == {("r/a", 10, "r/b")}
    assert {r.path for r in plan.rejected.collect()} == {"r/../c", "s/d"}
    assert {r.path for r in plan.retained.collect()} == {"r/b", "r/../c", "s/d", "r/e"}
    assert plan.stats().first().asDict() == {
        "scanned": 5, "groups": 1, "planned": 1, "reclaimable_bytes": 10, "rejected": 2,
    }
    with pytest.raises(ValueError):
        plan_clean(records(spark, rows), "perceptual")


def test_reconcile(spark):
    df = records(spark, [rec("a", sha="1"), rec("b", sha="1"), rec("c", sha="2"), rec("d", sha="2")])
    removed = spark.createDataFrame([("b",)], "path string")
    (g,) = reconcile(df, removed, "exact").groups.collect()
    assert (g.group_id, g.first_path) == (0, "c")


def entry(path, size=1, mtime=1, algo=HASH_ALGO, sha="s", at=1):
    return (path, size, mtime, algo, sha, None, 5, 1, 1, "png", at)


def test_cache_life_cycle(spark):
    known = spark.createDataFrame(
        [
            entry("keep"), entry("resized", size=9), entry("touched", mtime=9), entry("old-algo", algo="dhash-0"),
            entry("gone"), entry("twice", sha="old", at=1), entry("twice", sha="new", at=2),
        ],
        HASH_INDEX_SCHEMA,
    )
    paths = ["keep", "resized", "touched", "old-algo", "twice", "brand-new"]
    listing = spark.createDataFrame([(p, 1, 1) for p in paths], "path string, size long, mtime_ns long")
    assert {(r.path, r.sha256) for r in cache_hits(listing, known).collect()} == {("keep", "s"), ("twice", "new")}
    assert {r.path for r in cache_misses(listing, known).collect()} == {"resized", "touched", "old-algo", "brand-new"}
    assert {r.path for r in orphans(known, listing).collect()} == {"gone"}
    assert "gone" not in {r.path for r in collect_garbage(known, listing).collect()}
    assert latest(known).count() == 6
    nothing = listing.limit(0)
    assert orphans(known, nothing).count() == 0
    assert collect_garbage(known, nothing).count() == 6


def test_refresh_hashes_only_misses_and_retries_failures(spark, tmp_path):
    listing = spark.createDataFrame(
        [("a", 3, 1), ("b", 3, 1), ("bad", 3, 1)], "path string, size long, mtime_ns long"
    )
    asked = []

    def hash_items(misses):
        asked.append(sorted(r.path for r in misses.collect()))
        return misses.select(
            "path", F.col("size").alias("bytes"), F.lit(1).alias("width"), F.lit(1).alias("height"),
            F.lit("png").alias("format"), F.sha2("path", 256).alias("sha256"), F.lit("P").alias("pixel_sha256"),
            F.lit(4).cast("bigint").alias("phash"), F.when(F.col("path") == "bad", "broken").alias("error"),
        )

    at = str(tmp_path / "index")
    assert read_index(spark, at).count() == 0
    first = refresh(listing, at, hash_items)
    assert {r.path for r in first.records.collect()} == {"a", "b"}
    assert [(r.path, r.reason) for r in first.skipped.collect()] == [("bad", "broken")]
    assert {r.pixel_sha256 for r in first.records.collect()} == {"P"}
    second = refresh(listing, at, hash_items)
    assert {r.path for r in second.records.collect()} == {"a", "b"}
    assert asked == [["a", "b", "bad"], ["bad"]]
    touched = listing.withColumn("mtime_ns", F.when(F.col("path") == "a", 2).otherwise(1).cast("long"))
    refresh(touched, at, hash_items)
    assert asked[-1] == ["a", "bad"]


def test_index_splits_errors(spark):
    hashed = records(spark, [rec("a"), rec("b")]).withColumn("error", F.when(F.col("path") == "b", "no"))
    out = index(hashed)
    assert [r.path for r in out.records.collect()] == ["a"]
    assert [(r.path, r.reason) for r in out.skipped.collect()] == [("b", "no")]


def sequential_names(bases):
    used, out = set(), []
    for base in bases:
        name, dot = base, base.rfind(".")
        stem, ext = (base[:dot], base[dot:]) if dot > 0 else (base, "")
        n = 2
        while name in used:
            name = f"{stem} ({n}){ext}"
            n += 1
        used.add(name)
        out.append(name)
    return out


def test_struck_numbers_are_passed_block_by_block(spark):
    rng = random.Random(5)
    bases = [f"a ({rng.randint(2, 60)}).png" for _ in range(30)] + ["a.png"] * 40 + ["b.png"] * 3
    df = spark.createDataFrame(list(enumerate(bases)), "i long, base string")
    want = sequential_names(bases)
    for block_ranks in (1, 7, 100):
        got = unique_paths(df, "base", "i", block_ranks=block_ranks).orderBy("i").collect()
        assert [r.path for r in got] == want


@pytest.mark.parametrize("seed", range(3))
def test_unique_paths_equal_sequential_naming(spark, seed):
    rng = random.Random(seed)
    names = ["a.png", "a (2).png", "a (3).png", "a (2) (2).png", ".x", ".x (2)", "b", "b (2)", "c.d.e"]
    bases = [rng.choice(names[: 4 if seed == 0 else None]) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(bases)), "i long, base string")
    got = [r.path for r in unique_paths(df, "base", "i", hot_rows=5).orderBy("i").collect()]
    assert got == sequential_names(bases)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_path_expressions(spark):
    assert parse_extensions("jpg, PNG") == ["jpg", "png"]
    df = spark.createDataFrame([("a.JPG",), ("b.tif",), ("c.png",), ("noext",), ("d.x/e",)], "p string")
    ext = F.regexp_extract("p", r"\.([^./]+)$", 1)
    assert [r[0] for r in df.select(normalize_ext(ext)).collect()] == ["jpeg", "tiff", "png", "", ""]
    assert [r[0] for r in df.select(has_extension("p", ["jpg", "png"])).collect()] == [True, False, True, False, False]
    assert one(spark, relative_path(F.lit("/r/a\\b"), "/r/")) == "a/b"
    assert one(spark, relative_path(F.lit("/rx/a"), "/r")) == "/rx/a"
    assert one(spark, plain_uri(F.lit("file:///x/y"))) == one(spark, plain_uri(F.lit("file:/x/y"))) == "file:/x/y"
    guard = lambda p, root=None: one(spark, inside_root(F.lit(p).cast("string"), root))
    assert guard("a/b") and guard("r/a", "r") and guard("...")
    assert not any([guard(""), guard("a//b"), guard("a/./b"), guard("../a"), guard("a/.."), guard(None), guard("x/a", "r")])


def test_human_size(spark):
    cases = {
        0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.3 KB", 10239: "10.0 KB", 10240: "10 KB", 1536 * 1024: "1.5 MB",
        (1 << 20) - 1: "1024 KB", 5 << 40: "5.0 TB", 5000 << 40: "5000 TB",
    }
    df = spark.createDataFrame([(k,) for k in cases], "n long")
    assert {r.n: r.s for r in df.select("n", human_size("n").alias("s")).collect()} == cases


def test_verdict_and_clock(spark):
    kinds = ("boolean", "boolean", "boolean", "double")
    v = lambda *a: one(spark, verdict(*[F.lit(x).cast(k) for x, k in zip(a, kinds)]))
    assert v(True, None, False, None) == "identical"
    assert v(False, True, True, 0.1) == "same_pixels"
    assert v(False, None, False, None) == "incomparable"
    assert v(False, False, True, 0.995) == "near_identical"
    assert v(False, False, True, 0.9) == "similar"
    assert v(False, False, True, None) == "different"
    assert len(one(spark, now_rfc3339())) == 20


def test_report_lines(spark, tmp_path):
    df = records(spark, [rec("b", sha="1", phash=255), rec("a", sha="1"), rec("c", sha="2")])
    skipped = spark.createDataFrame([("z", "broken")], "path string, reason string")
    lines = scan_report(scan(df, "exact"), skipped, "root", df)
    docs = [json.loads(r.json) for r in lines.collect()]
    by = {}
    for d in docs:
        assert d["kind"] == "scan"
        by.setdefault(d["section"], []).append(d)
    assert {k: len(v) for k, v in by.items()} == {"head": 1, "stats": 1, "group": 1, "member": 2, "skipped": 1, "image": 3}
    assert by["stats"][0]["skipped"] == 1 and by["head"][0]["producer"]["hashAlgo"] == HASH_ALGO
    assert by["group"][0]["maxHamming"] is None
    assert {i["path"]: i["phash"] for i in by["image"]} == {"a": None, "b": "00000000000000ff", "c": None}
    out = str(tmp_path / "report")
    write_report(lines, out)
    images = [json.loads(r.value)["path"] for r in spark.read.text(f"{out}/section=image").collect()]
    assert images == ["a", "b", "c"]
    assert "image" not in {r.section for r in scan_report(scan(df, "exact"), skipped, "root").collect()}


def test_asset_references(spark):
    ref = one(spark, asset_path(F.lit("x.png")))
    assert (ref.kind, ref.path, ref.dataUri) == ("path", "x.png", None)
    ref = one(spark, asset_data(F.lit("image/png"), F.lit(bytearray(b"abc"))))
    assert (ref.kind, ref.dataUri) == ("dataUri", "data:image/png;base64,YWJj")


def test_helpers_agree():
    assert distance(0, -1) == 64 and signed64((1 << 64) - 1) == -1


def test_find_clean_and_compare_reports(spark):
    pool = records(spark, POOL)
    skipped = spark.createDataFrame([("z", "broken")], "path string, reason string")
    docs = find_report(find(pool.where("path = 'q.png'"), pool, 10, query_path="q.png"), skipped, "root")
    lines = [json.loads(r.json) for r in docs.orderBy("section", "sort_key").collect()]
    assert [d["path"] for d in lines if d["section"] == "match"] == [
        "copy.png", "reencoded.png", "other-dims.png", "near-a.png", "near-b.png",
    ]
    assert [d["sha256"] for d in lines if d["section"] == "query"] == ["Q"]
    assert {d["matched"] for d in lines if d["section"] == "stats"} == {5}
    lines = [json.loads(r.json) for r in clean_report(plan_clean(pool), "root").collect()]
    assert {d["path"] for d in lines if d["section"] == "planned"} == {"q.png", "reencoded.png", "other-dims.png"}
    compared = spark.createDataFrame(
        [("a", "b", False, False, False, None, None, None, None, 3, "incomparable")],
        "a string, b string, sha_equal boolean, dims_equal boolean, comparable boolean, pixel_equal boolean, "
        "pixel_diff_ratio double, ssim double, psnr double, hamming int, verdict string",
    )
    (pair,) = [json.loads(r.json) for r in compare_report(compared, now_rfc3339()).where("section = 'pair'").collect()]
    assert pair["ssim"] is None and pair["hammingDistance"] == 3


def test_public_names():
    import twinsift

    assert all(callable(getattr(twinsift, name)) for name in twinsift.__all__)
