"""Adapters and the image folder, batch and streaming."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift.functions import kernels
from twinsift.operators.clean import plan_clean
from twinsift.operators.group import scan
from twinsift.operators.index import index, latest, read_index, refresh, to_records
from twinsift.sources.images import _list_level, folder_rasters, hash_folder, hash_listed, keep_contents, list_everything, list_images
from twinsift.sources.text import hashed_texts, text_raster, text_records
from twinsift.sources.vectors import hashed_vectors, vector_rasters
from twinsift.streaming.ingest import follow_images, open_retries, stream_images


def png(pixels):
    h, w, n = pixels.shape
    chunk = lambda tag, data: (
        struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    )
    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[n], 0, 0, 0)
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (12, 10, 3)).astype(np.uint8)
    rgba = np.concatenate([rgb, np.full((12, 10, 1), 255, np.uint8)], axis=-1)
    soft = rng.integers(0, 256, (9, 9, 4)).astype(np.uint8)
    root = tmp_path / "photos"
    (root / "sub").mkdir(parents=True)
    (root / "a.png").write_bytes(png(rgb))
    (root / "b.PNG").write_bytes(png(rgba))
    (root / "sub" / "copy.png").write_bytes(png(rgb))
    (root / "sub" / "soft.png").write_bytes(png(soft))
    (root / "broken.png").write_bytes(b"not an image")
    (root / "notes.txt").write_text("no image")
    return root, rgba, soft


def test_image_folder(spark, folder):
    root, rgba, soft = folder
    listed = {r.path: r.size for r in list_images(spark, str(root)).collect()}
    assert sorted(listed) == ["a.png", "b.PNG", "broken.png", "sub/copy.png", "sub/soft.png"]
    assert {r.path for r in list_images(spark, str(root), recurse=False).collect()} == {"a.png", "b.PNG", "broken.png"}

    out = index(hash_folder(spark, str(root)))
    rows = {r.path: r for r in out.unpruned.collect()}
    assert sorted(rows) == ["a.png", "b.PNG", "sub/copy.png", "sub/soft.png"]
    assert [(r.path, r.reason) for r in out.skipped.collect()] == [("broken.png", "cannot decode")]
    assert rows["a.png"].pixel_sha256 == rows["b.PNG"].pixel_sha256 == kernels.sha256_each(rgba[None])[0]
    flat = kernels.flatten_on_white(soft)
    assert rows["sub/soft.png"].pixel_sha256 == kernels.sha256_each(flat[None])[0]
    assert rows["sub/soft.png"].phash == kernels.dhash(flat[None])[0]
    assert (rows["a.png"].width, rows["a.png"].height, rows["a.png"].format) == (10, 12, "png")
    assert rows["a.png"].bytes == listed["a.png"]
    groups = lambda level: sorted(r.n_members for r in scan(out.records, level).groups.collect())
    assert (groups("exact"), groups("pixel")) == ([2], [3])
    assert {r.path: r.pixel_sha256 is None for r in out.records.collect()}["sub/soft.png"]


def test_odd_file_names(spark, folder, tmp_path):
    root, _, _ = folder
    names = ["with space.png", "50%.png", "a+b.png", "x#1.png", "x{1}.png", "x[1].png", "é東.png"]
    for name in names:
        (root / name).write_bytes((root / "a.png").read_bytes())
    listed = list_images(spark, str(root))
    for hashed in (hash_folder(spark, str(root)), hash_listed(listed, str(root), chunk=4)):
        out = index(hashed)
        records, skipped = ({r.path for r in df.collect()} for df in (out.records, out.skipped))
        assert records | skipped == {r.path for r in listed.collect()} and set(names) <= records
        assert skipped == {"broken.png"}


def test_no_file_is_lost(spark, folder):
    root, rgba, _ = folder
    one = (root / "a.png").read_bytes()
    for name in ("_x.png", ".x.png", "_a=b.png", ".hid/y.png", "_sub/deep/z.png", "_sub/_w.png"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(one)
    (root / ".bad.png").write_bytes(b"no image")
    (root / "gone.png").write_bytes(one)
    (root / "_gone.png").write_bytes(one)
    listed = list_everything(spark, str(root)).collect()
    files = {r.path for r in listed}
    assert files == {str(p.relative_to(root)) for p in root.rglob("*") if p.suffix.lower() == ".png"}
    assert not [r for r in listed if r.error]
    listing = spark.createDataFrame(listed, "path string, uri string, size long, mtime_ns long, error string").where("error IS NULL").drop("error")
    (root / "gone.png").unlink()
    (root / "_gone.png").unlink()
    hashed = hash_listed(listing, str(root), chunk=5).collect()
    assert len(hashed) == listing.count() and {r.path for r in hashed} == {r.path for r in listed if not r.error}
    reasons = {r.path: r.error for r in hashed if r.error}
    assert reasons == {"gone.png": "vanished", "_gone.png": "vanished", "broken.png": "cannot decode", ".bad.png": "cannot decode"}
    pixels = {r.path: (r.pixel_sha256, r.sha256, r.format) for r in hashed if not r.error}
    assert pixels["_x.png"] == pixels[".x.png"] == pixels[".hid/y.png"] == pixels["_sub/_w.png"] == pixels["a.png"]

    turned = {r.path: (r.width, r.height) for r in hash_folder(spark, str(root), orientation=F.lit(6)).collect()}
    assert turned["_x.png"] == turned["a.png"] == (12, 10)
    whole = index(hash_folder(spark, str(root)))
    records, skipped = ([r.path for r in df.collect()] for df in (whole.unpruned, whole.skipped))
    assert sorted(records + skipped) == sorted(files - {"gone.png", "_gone.png"})
    assert sorted(skipped) == [".bad.png", "broken.png"]


def test_each_content_is_opened_and_decoded_once(spark, folder, tmp_path):
    root, _, _ = folder
    one = (root / "a.png").read_bytes()
    for i in range(30):
        (root / f"again{i}.png").write_bytes(one)
    listed = list_images(spark, str(root))
    kept = keep_contents(listed, str(tmp_path / "store")).collect()
    # 35 files, four contents: four files to decode and no draft left behind.
    assert not list((tmp_path / "store" / "drafts").glob("[0-9a-f]*"))
    assert len(kept) == 35 and {r.sha256 for r in kept} == {p.name for p in (tmp_path / "store" / "kept").glob("[0-9a-f]*")}
    assert len({r.sha256 for r in kept}) == 4
    by_path = {tuple(r) for r in hash_listed(listed, str(root), chunk=7, orientation=F.lit(1)).collect()}
    by_content = [tuple(r) for r in hash_listed(listed, str(root)).collect()]
    in_waves = [tuple(r) for r in hash_listed(listed, str(root), wave_bytes=2_000).collect()]
    assert len(by_content) == len(in_waves) == 35 and set(by_content) == set(in_waves) == by_path
    assert hash_listed(listed.limit(0), str(root)).count() == 0


def test_folders_that_cannot_be_listed_are_reported(spark, folder):
    root, _, _ = folder
    asked = spark.createDataFrame([(f"file:{root}/sub",), (f"file:{root}/closed",), (f"file:{root}/a.png",)], "uri string")
    found = _list_level(asked, str(root), False).collect()
    assert sorted(r.path for r in found if not r.error) == ["sub/copy.png", "sub/soft.png"]
    assert {r.path: r.error.split(":")[0] for r in found if r.error} == {"closed": "cannot list", "a.png": "cannot list"}
    assert [(r.path, r.error) for r in _list_level(asked.limit(1), str(root), True).collect()] == [("sub", "too deep")]


def test_orientation_column(spark, folder):
    root, rgba, _ = folder
    turned = folder_rasters(spark, str(root), orientation=F.lit(6)).where("path = 'b.PNG'").first()
    assert (turned.width, turned.height) == (12, 10)
    assert turned.rgba == kernels.reorient(rgba, 6).tobytes()


def test_refresh_of_a_folder(spark, folder, tmp_path):
    root, _, _ = folder
    at = str(tmp_path / "index")
    asked = []

    def hash_items(misses):
        asked.append(misses.count())
        return hash_listed(misses, str(root), chunk=2)

    first = refresh(list_images(spark, str(root)), at, hash_items)
    assert first.records.count() == 4 and first.skipped.count() == 1
    (root / "sub" / "new.png").write_bytes((root / "a.png").read_bytes())
    (root / "sub" / "soft.png").unlink()
    second = refresh(list_images(spark, str(root)), at, hash_items)
    assert sorted(r.path for r in second.records.collect()) == ["a.png", "b.PNG", "sub/copy.png", "sub/new.png"]
    assert asked == [5, 2]


def test_image_stream_resumes(spark, folder, tmp_path):
    root, _, _ = folder
    at = {k: str(tmp_path / k) for k in ("index", "retry", "checkpoint")}
    run = lambda: stream_images(
        spark, str(root), at["index"], at["retry"], at["checkpoint"], files_per_batch=2
    ).awaitTermination()
    run()
    got = to_records(latest(read_index(spark, at["index"])))
    want = {(r.path, r.sha256, r.pixel_sha256, r.phash) for r in index(hash_folder(spark, str(root))).unpruned.collect()}
    assert {(r.path, r.sha256, r.pixel_sha256, r.phash) for r in got.collect()} == want
    assert [r.path for r in spark.read.option("recursiveFileLookup", True).parquet(at["retry"]).collect()] == ["broken.png"]
    waiting = lambda: [tuple(r) for r in open_retries(spark, at["retry"], at["index"]).collect()]
    assert waiting() == [("broken.png", "cannot decode")]
    assert open_retries(spark, str(tmp_path / "nowhere"), at["index"]).count() == 0
    (root / "late.png").write_bytes((root / "a.png").read_bytes())
    run()
    entries = read_index(spark, at["index"])
    assert entries.count() == 5 and latest(entries).count() == 5
    mended = entries.limit(1).withColumn("path", F.lit("broken.png"))
    mended.write.mode("append").parquet(f"{at['index']}/batch=mended")
    assert waiting() == []


def test_changed_and_failed_files_are_offered_again(spark, folder, tmp_path):
    root, _, _ = folder
    at = [str(tmp_path / k) for k in ("index", "retry", "offers", "checkpoint")]
    follow = lambda: sorted((r.path, r.attempt) for r in follow_images(spark, str(root), *at, attempts=3).collect())
    now = lambda: {r.path: r.sha256 for r in latest(read_index(spark, at[0])).collect()}
    digest = lambda name: hashlib.sha256((root / name).read_bytes()).hexdigest()
    assert follow() == [(name, 1) for name in ("a.png", "b.PNG", "broken.png", "sub/copy.png", "sub/soft.png")]
    assert now() == {name: digest(name) for name in ("a.png", "b.PNG", "sub/copy.png", "sub/soft.png")}
    old = (root / "sub" / "soft.png").stat()
    kept, one = (root / "sub" / "soft.png").read_bytes(), (root / "a.png").read_bytes()
    (root / "sub" / "soft.png").write_bytes(one)
    # Changed in place, failed the first time; nothing else.
    assert follow() == [("broken.png", 2), ("sub/soft.png", 1)]
    assert now()["sub/soft.png"] == digest("a.png") and "broken.png" not in now()
    # A version that was there before is put back; the third attempt is the last.
    (root / "sub" / "soft.png").write_bytes(kept)
    os.utime(root / "sub" / "soft.png", ns=(old.st_mtime_ns, old.st_mtime_ns))
    assert follow() == [("broken.png", 3), ("sub/soft.png", 1)]
    assert now()["sub/soft.png"] == hashlib.sha256(kept).hexdigest()
    assert follow() == []
    (root / "broken.png").write_bytes(one)
    assert follow() == [("broken.png", 1)]
    assert now()["broken.png"] == digest("a.png") and follow() == []


def test_text_adapter_equals_builtin_form(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cell = F.transform(
        F.filter(F.split("text", " "), lambda t: t != ""),
        lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint") % 72).cast("int"),
    )
    cells = docs.select("doc_id", "text", F.explode(cell).alias("c")).groupBy("doc_id", "c").count()
    want = {}
    for r in cells.collect():
        want.setdefault(r.doc_id, [0] * 72)[r.c] = r["count"]
    got = docs.select("doc_id", "text", text_raster("text").alias("r")).collect()
    assert len(got) == docs.count()
    for r in got:
        counts = want.get(r.doc_id, [0] * 72)
        grid = [v * 255 // max(counts) for v in counts] if max(counts) > 255 else counts
        assert list(r.r.gray) == grid
        assert r.r.pixel_sha256 == hashlib.sha256(" ".join(t for t in r.text.split(" ") if t).encode()).hexdigest()
        assert r.r.phash == kernels.grid_bits(np.array([grid], np.uint8))[0]


def test_text_records_odd_values(spark):
    df = spark.createDataFrame([("a", "x  x y"), ("b", ""), ("c", "é é")], "name string, text string")
    rows = {r.path: r for r in text_records(df, F.col("name"), with_gray=True).collect()}
    assert (sum(rows["a"].gray), sum(rows["b"].gray)) == (3, 0)
    assert (rows["c"].bytes, rows["c"].width, rows["b"].phash) == (5, 3, 0)
    many = spark.createDataFrame([("a", "z " * 300 + "y"), ("b", "z " * 400 + "y")], "name string, text string")
    a, b = text_records(many, F.col("name"), with_gray=True).orderBy("path").collect()
    assert max(a.gray) == max(b.gray) == 255 and a.pixel_sha256 != b.pixel_sha256


def test_texts_that_differ_beyond_255_tokens_are_not_planned(spark):
    rows = [("a", "spam " * 300), ("b", "spam " * 400), ("c", "spam " * 400 + " ")]
    records = text_records(spark.createDataFrame(rows, "name string, text string"), F.col("name"))
    assert [r.path for r in plan_clean(records, "pixel").plan.collect()] == ["b"]


def test_no_text_is_lost(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", "")], "name string, text string")
    out = index(hashed_texts(df, F.col("name")))
    assert sorted(r.path for r in out.records.collect()) == ["a", "c"]
    assert [tuple(r) for r in out.skipped.collect()] == [("b", "no text")]
    assert text_records(df, F.col("name")).count() == 2


def test_different_texts_are_never_planned(spark):
    texts = ["above", "narrow", "man bites dog", "dog bites man", "man  bites dog ", "Man bites dog"]
    rows = [(f"{i}.txt", text) for i, text in enumerate(texts)]
    plan = plan_clean(text_records(spark.createDataFrame(rows, "name string, text string"), F.col("name")), "pixel").plan
    assert [(r.path, r.keeper) for r in plan.collect()] == [("2.txt", "4.txt")]


VECTORS = "id int, embedding array<float>"


def test_vector_adapter(spark):
    df = spark.createDataFrame([(1, [-1.0, -0.5, 0.0, 1.0])], VECTORS)
    r = vector_rasters(df, F.lit("v"), width=2, height=2).first()
    assert [r.rgba[i] for i in range(0, 16, 4)] == [0, 63, 127, 255] and r.rgba[3] == 255 and r.error is None
    close = spark.createDataFrame([(1, [0.1000] * 4), (2, [0.1001] * 4), (3, [0.1000] * 4), (4, [1e-30, 0.0, -1e-30, 1e-9])], VECTORS)
    a, b, c, d = vector_rasters(close, F.col("id").cast("string"), width=2, height=2).orderBy("path").collect()
    assert a.rgba == b.rgba and a.sha256 == c.sha256 and len({a.sha256, b.sha256, d.sha256}) == 3
    four = vector_rasters(df, F.lit("v"), channels=4, width=1, height=1).first()
    assert list(four.rgba) == [0, 63, 127, 255]


def test_vectors_without_a_raster_are_skipped(spark):
    nan = float("nan")
    rows = [[5.0] * 64, [9.0] * 64, None, [], [nan] * 64, [None] + [0.0] * 63, [0.5] * 64, [0.5] * 64, [-1.0] * 63 + [1.0]]
    out = index(hashed_vectors(spark.createDataFrame(list(enumerate(rows)), VECTORS), F.col("id").cast("string")), prune=False)
    skipped = {r.path: r.reason for r in out.skipped.collect()}
    assert skipped == {"2": "no vector", "3": "no vector", **dict.fromkeys("0145", "entries outside [-1, 1]")}
    records = {r.path: r.pixel_sha256 for r in out.records.collect()}
    assert sorted(records) == ["6", "7", "8"] and records["6"] == records["7"] != records["8"]
    assert [r.path for r in plan_clean(out.records, "pixel").plan.collect()] == ["7"]


def test_long_texts_are_hashed_in_slices(monkeypatch):
    import pyarrow as pa

    from twinsift.sources import text as source

    texts = pa.array(["ab cd", None, "x" * 40, "", "e f", "gh"])
    parts = list(source.slices(texts, 10))
    assert [len(p) for p in parts] == [2, 1, 3] and pa.concat_arrays(parts).equals(texts)
    seen, real = [], source._raster_slice
    monkeypatch.setattr(source, "_raster_slice", lambda part: seen.append(len(part)) or real(part))
    many = pa.array(["word " * 40_000] * 30)
    out = source._text_raster.func(many)
    assert len(out) == 30 and max(seen) <= 5 and out.equals(real(many))
    assert len(source._text_raster.func(texts.slice(0, 0))) == 0


def test_words_are_hashed_as_the_bytes_they_are():
    import hashlib

    import pyarrow as pa

    from twinsift.sources import text as source

    rows = [None, "", "   ", " a", "a  b ", "  a   b  c ", "\ta\n b", "\u00e9 \u65e5\u672c  x", "a " * 300]
    for kind, texts in ((pa.string(), rows), (pa.large_string(), rows), (pa.string(), rows[:0])):
        out = source._text_raster.func(pa.array(texts, kind)).to_pylist()
        for row, text in zip(out, texts, strict=True):
            words = [w for w in (text or "").split(" ") if w]
            counts = [0] * 72
            for w in words:
                counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 72] += 1
            most = max(255, *counts)
            assert list(row["gray"]) == [c * 255 // most for c in counts]
            assert row["pixel_sha256"] == hashlib.sha256(" ".join(words).encode()).hexdigest()
    # Words stay bytes all the way: one that is no UTF-8 has a cell and a hash like any other.
    raw = [b"ab \xff\xfe  cd", b"cd"]
    odd = pa.Array.from_buffers(pa.string(), 2, pa.array(raw, pa.binary()).buffers())
    out = source._raster_slice(odd).to_pylist()
    assert out[0]["pixel_sha256"] == hashlib.sha256(b"ab \xff\xfe cd").hexdigest() and sum(out[0]["gray"]) == 3


def test_queries_send_small_batches(spark, sf_dir):
    from __spark_entry__ import queries

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 30))
    try:
        queries()["text_fingerprint"](spark, sf_dir)
        assert int(spark.conf.get(name)) <= 8 << 20
    finally:
        spark.conf.set(name, before)


def test_index_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("a", "x y"), ("b", "x  y"), ("c", "other"), ("d", None), ("d", "x y")]
    df = spark.createDataFrame(rows, "name string, text string")
    out = index(hashed_texts(df.mapInArrow(counted, df.schema), F.col("name")))
    assert sorted((r.path, r.pixel_sha256 is not None) for r in out.records.collect()) == [
        ("a", True), ("b", True), ("c", False), ("d", True)
    ]
    assert [tuple(r) for r in out.skipped.collect()] == [("d", "no text")] and out.unpruned.count() == 4
    assert read.value == len(rows)


def test_all_queries_send_small_batches(spark, monkeypatch):
    import __spark_entry__ as contract

    sizes = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {name: spark.conf.get(name) for name in sizes}
    seen = {}

    def stub(name):
        def run(session, sf_dir):
            seen[name] = [int(session.conf.get(size)) for size in sizes]

        return run

    for name in list(contract.QUERIES):
        monkeypatch.setitem(contract.QUERIES, name, stub(name))
    try:
        for name in ("scan_summary", "find_topn_batch", "scan_stats", "reconcile_groups", "keepers", "pixel_groups", "indexed_pages"):
            for size in sizes:
                spark.conf.set(size, str(1 << 30))
            contract.queries()[name](spark, "unread")
            assert seen[name][0] <= 8 << 20 and seen[name][1] <= 500
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
