"""Operators with exact results, against brute force on odd rows and on the smallest table."""

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import brute
from twinsift.llm.chosen_path import keep_one, near_duplicates
from twinsift.llm.isolation import judge
from twinsift.llm.licenses import scan_licenses
from twinsift.llm.line_spread import dedup_lines, remove_boilerplate
from twinsift.llm.packing import Bins, pack, sequences
from twinsift.llm.pii import Model, find_spans, fit, personal_data, redact
from twinsift.llm.suffixes import contamination, decontaminate, match_items, search, suffix_array
from twinsift.llm.token_store import read_store, write_store
from twinsift.operators.storage import scratch_path

PIECES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def same(got, want):
    order = lambda row: tuple((v is not None, str(v)) for v in row)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


@pytest.fixture(params=["odd", "given", "none"])
def docs(request):
    return request.getfixturevalue(request.param)


def rows_of(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]


def whole(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_token_store(llm, docs):
    path = scratch_path(llm, "store")
    write_store(docs, path, PIECES)
    want = brute.token_rows(rows_of(docs), whole(PIECES))
    same(read_store(llm, path).collect(), want)
    if want:
        doc = max(d for d, *_ in want if d is not None)
        one = read_store(llm, path, [doc], with_ids=True).collect()
        assert {(r.doc_id, r.n_tokens, len(r.ids)) for r in one} == {(d, n, 4 * n) for d, _, n, _ in want if d == doc}


def test_packing(llm, docs):
    pieces = pack(docs, WORDS, with_ids=True)
    found = pieces.collect()
    want = brute.token_rows(rows_of(docs), whole(WORDS))
    assert sum(r.length for r in found) == sum(n for _, _, n, _ in want)
    same({(r.doc_id, r.doc_tokens) for r in found}, {(d, n) for d, _, n, _ in want})
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert {r.sequence_id: r.length for r in sequences(pieces).collect()} == {s: sum(n for _, n in p) for s, p in by.items()}


def test_packing_keeps_ids(llm, given):
    import zlib

    ids = {}
    for r in pack(given, WORDS, with_ids=True).collect():
        ids.setdefault(r.doc_id, []).append((r.start, r.ids))
    for doc, _, n, crc in brute.token_rows(rows_of(given), whole(WORDS)):
        joined = b"".join(bytes(part) for _, part in sorted(ids[doc]))
        assert (len(joined), zlib.crc32(joined)) == (4 * n, crc)


@pytest.mark.parametrize("most_short", [0, 1, 64])
@pytest.mark.parametrize("seed", range(6))
def test_bins_have_no_gap(seed, most_short):
    random = np.random.default_rng(seed)
    lengths = [[1, 5, 63, 64, 65, 130, 7, 7, 7], [33] * 50, [1] * 130, [64] * 3][seed] if seed < 4 else random.integers(1, 150, 400).tolist()
    bins, placed = Bins(3, 64, most_short), []
    for i, n in enumerate(lengths):
        placed += bins.add(i, 0, n)
        assert len(bins.short) <= most_short + 1 and len(bins.open) < 16
        assert all(len(b.pieces) < k for k, b in bins.open.items())
    placed += bins.finish()
    by, parts_of = {}, {}
    for doc, start, length, sequence, offset in placed:
        by.setdefault(sequence, []).append((offset, length))
        parts_of.setdefault(doc, []).append((start, length))
    for doc, n in enumerate(lengths):
        parts = sorted(parts_of[doc])
        assert [s for s, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == n
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        total = sum(n for _, n in parts)
        assert total & (total - 1) == 0
    assert len(placed) <= len(lengths) + len(by)


def test_full_class_bins_hold_a_fixed_number_of_documents():
    bins = Bins(0, 60)
    placed = [p for i in range(12) for p in bins.add(i, 0, 20)]
    assert [[p[0] for p in placed if p[3] == s] for s in range(4)] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]


def test_documents_mostly_stay_whole(llm, given):
    found = pack(given, WORDS).where("doc_tokens <= 4096").groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in found) <= 1.5 * len(found)


@pytest.mark.parametrize("query_bytes", [45, 8 << 20])
def test_contamination(llm, odd, query_bytes):
    items = llm.createDataFrame(brute.ODD_ITEMS, "item_id bigint, text string")
    want = brute.contamination(brute.ODD_DOCS, brute.ODD_ITEMS)
    found = match_items(odd, items, query_bytes=query_bytes).collect()
    same([(r.doc_id, r["__n_words"], r["__n_hit"], len(r["__items"])) for r in found], [row[:4] for row in want])
    same(contamination(odd, items).drop("matches").collect(), want)
    same([(r.doc_id,) for r in decontaminate(odd, items).collect()], [(d,) for d, *_, bad in want if not bad])


def test_contamination_of_the_table(llm, given, sf_dir):
    items = llm.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute.contamination(rows_of(given), [tuple(r) for r in items.collect()])
    same(contamination(given, items).drop("matches").collect(), want)
    assert contamination(given, items.limit(0)).where("contaminated").count() == 0
    assert contamination(given.limit(0), items).count() == 0


def test_longest_match(llm):
    docs = llm.createDataFrame([(1, "so " + brute.PASSAGE + " end")], "doc_id bigint, text string")
    items = llm.createDataFrame([(4, "well " + brute.PASSAGE)], "item_id bigint, text string")
    assert [tuple(m) for m in contamination(docs, items).first().matches] == [(4, 1, 1, 13)]


def test_suffix_array_order():
    import numpy as np

    values = np.random.default_rng(1).integers(1, 4, 400).astype(np.uint64)
    order = suffix_array(values, 16)
    keys = [tuple(values[i : i + 16]) for i in order]
    assert keys == sorted(keys)
    low, high = search(values, order, values[:10].reshape(1, -1))
    assert {int(i) for i in order[low[0] : high[0]]} == {
        i for i in range(391) if tuple(values[i : i + 10]) == tuple(values[:10])
    }


def test_near_duplicates(docs):
    want = brute.near_duplicates(rows_of(docs))
    same(near_duplicates(docs).collect(), want)
    same([(r.doc_id,) for r in keep_one(docs).select("doc_id").collect()], [(d,) for d, *_, kept in want if kept])


def test_near_duplicates_in_one_large_group(llm):
    """Copies of one text with a few words changed each, and texts that share one long passage only."""
    import random

    random.seed(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in random.sample(range(120), 3):
            words[at] = f"v{random.randrange(40)}"
        rows.append((i, " ".join(words), "a"))
    for i in range(400, 700):
        rows.append((i, " ".join(base[:40] + [f"o{i}-{k}" for k in range(90)]), "a"))
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(8)
    same(near_duplicates(docs).collect(), brute.near_duplicates(rows))


def test_licenses(docs):
    found = scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    same(found.collect(), brute.licenses(rows_of(docs)))


def test_license_labels(llm):
    texts = {
        1: "Licensed under CC BY-NC 4.0.",
        2: "Redistribution and use in source and binary forms, with or without modification, are permitted",
        3: "Released under the MIT License.",
        4: "a license to think, version 2 of it, under the sun",
    }
    docs = llm.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert [found[i].labels for i in (1, 2, 3, 4)] == ["cc-by-nc-4.0", "bsd", "mit", ""]
    assert found[3].score > 0.5 > found[4].score


def test_personal_data(docs):
    same(personal_data(docs).drop("spans").collect(), brute.personal_data(rows_of(docs)))


def test_spans_cover_long_values(llm):
    everything = Model([], [], 0.0)
    key, figures = "aB3_" * 100, "1234567 " * 20_000
    texts = ["token=" + "x.y1" * 75 + " end", f"see {key} end", f"no {figures.strip()}, end", "call 123 4567 890a now", "is 123 4567a"]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r.doc_id: {(s.kind, s.start, s.end) for s in r["__spans"]} for r in find_spans(docs, everything).collect()}
    assert ("secret", 0, 306) in spans[0] and ("key", 4, 404) in spans[1] and ("number", 3, 160_002) in spans[2]
    assert ("number", 5, 13) in spans[3] and not spans[4]
    redacted = [r.text for r in redact(docs.where("doc_id < 3"), everything).orderBy("doc_id").collect()]
    assert redacted == ["[secret] end", "see [key] end", "no [number], end"]


def test_redaction(llm, given):
    docs = llm.createDataFrame([(1, "mail a.b@c.de, é 1.2.3.4"), (2, None)], "doc_id bigint, text string")
    assert [r.text for r in redact(docs, None).orderBy("doc_id").collect()] == ["mail [email], é [ip]", None]
    model = fit(given)
    spans = find_spans(given, model)
    assert spans.where("size(__spans) < size(__base)").count() == 0


def test_rules(docs, labels):
    found = judge(docs, labels)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same(found.select(*names).collect(), brute.rules(rows_of(docs)))
    assert found.where("base_failed and kept").count() == 0


@pytest.mark.parametrize("sites", [2, 4])
def test_line_spread(docs, sites):
    want = brute.spread(rows_of(docs), sites)
    found = dedup_lines(docs, sites)
    same([(r.doc_id, r["__n_lines"], r["__n_dropped"], r.text) for r in found.collect()], want)
    left = [(d,) for d, _, dropped, text in want if not dropped or text.strip()]
    same([(r.doc_id,) for r in remove_boilerplate(docs, sites).collect()], left)


def test_line_spread_far_from_the_threshold(llm):
    """Lines on far more sites than asked for are settled by their sketches, others by exact counts."""
    rows = [(i, "a line that is everywhere\nand one of some sites" if i % 9 < 2 else "a line that is everywhere", f"s{i}") for i in range(90)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, source string")
    for sites in (8, 20, 21):
        same([(r.doc_id, r["__n_lines"], r["__n_dropped"], r.text) for r in dedup_lines(docs, sites).collect()], brute.spread(rows, sites))


def test_the_fit_covers_all_candidates(llm, monkeypatch):
    """Texts beyond 20,000 characters, texts without a figure or an at sign and every row take part, by their number."""
    from pyspark.sql import functions as F

    from twinsift.llm import pii

    seen, real = {}, pii.stage
    monkeypatch.setattr(pii, "stage", lambda df, name: seen.setdefault(name, real(df, name)))
    rows = [(i, f"call {1000000 + i} now") for i in range(5_000)] + [(5_000, "word " * 5_000 + "ring 1234567"), (5_001, "password: secretly")]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    fit(docs)
    want = docs.selectExpr("text").select(F.size(pii.candidates(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0]
    assert seen["candidates"].agg(F.sum("n")).first()[0] == want >= 5_002
