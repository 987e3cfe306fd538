"""Relative parsing: against all windows of all documents, with every path forced."""

import random

import numpy as np
import pytest

from tests.llm import brute
from twinsift.llm.factors import ReferenceBlock, anchors, least_of_runs, remove_repeats

DOCS = "doc_id bigint, text string, source string"


def all_windows(docs, window):
    """``(doc_id, words, removed, kept text)`` of each row."""
    least = {}
    split = [(doc, None if text is None else brute.SOLID.findall(text)) for doc, text, *_ in docs]
    for doc, words in split:
        for i in range(len(words or ()) - window + 1):
            if doc is not None:
                key = tuple(words[i : i + window])
                least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, words in split:
        gone = set()
        for i in range(len(words or ()) - window + 1):
            if doc is not None and least[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = None if words is None else " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words or ()), len(gone), kept))
    return out


def same(docs, rows, window, **more):
    found = [(r.doc_id, r["__n_words"], r["__n_removed"], r.text) for r in remove_repeats(docs, window=window, **more).collect()]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    want = all_windows(rows, window)
    assert sorted(found, key=key) == sorted(want, key=key)
    return sum(r[2] for r in want)


def mixed(count, seed, words=12):
    """Texts stitched from few passages, so that windows recur whole, in part, across seams and in many contexts."""
    pick = random.Random(seed)
    parts = [" ".join(pick.choice("abcdefgh") * pick.randint(1, 2) for _ in range(pick.randint(3, 40))) for _ in range(words)]
    rows = []
    for i in range(count):
        text = (pick.choice([" ", "\n", "  "])).join(pick.choice(parts) if pick.random() < 0.8 else f"u{i} x{pick.random()}" for _ in range(pick.randint(0, 8)))
        rows.append((pick.randint(1, count // 2), text, "s"))
    return rows


@pytest.mark.parametrize("most,block", [(16384, 4096), (2048, 7), (1, 50), (3, 3)])
def test_mixed_texts(llm, most, block):
    rows = mixed(150, 7)
    assert same(llm.createDataFrame(rows, DOCS), rows, 12, gram=4, most=most, block=block) > 500


def test_production_window(llm):
    rows = [(d, " ".join((t or "").split() * 4), s) for d, t, s in mixed(60, 3)]
    assert same(llm.createDataFrame(rows, DOCS), rows, 50) > 500


def test_odd_rows(llm, odd):
    cleaned = remove_repeats(odd, window=10, gram=3)
    assert cleaned.columns == [*odd.columns, "__n_words", "__n_removed"]
    same(odd, brute.ODD_DOCS, 10, gram=3)
    same(odd, brute.ODD_DOCS, 50)


def test_given_table(llm, given):
    rows = [tuple(r) for r in given.collect()]
    same(given, rows, 50)


def test_empty_table(none):
    assert remove_repeats(none).count() == 0


def test_copies_and_very_long_texts(llm):
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    rows = [(i % 9, "one text " * 30, "hot") for i in range(400)] + [(50, long, "a"), (51, "start " + long + " end", "b"), (None, long, "c")]
    assert same(llm.createDataFrame(rows, DOCS), rows, 50) > 60_000


def test_block_matches_every_place():
    pick = random.Random(5)
    passages = [" ".join(pick.choice("ab") for _ in range(pick.randint(1, 30))) for _ in range(60)]
    docs = np.array([pick.randint(0, 20) for _ in passages])
    block = ReferenceBlock(passages, docs)
    words = [p.split() for p in passages]
    for k, own in enumerate(words):
        for i in range(len(own)):
            best = 0
            for j, other in enumerate(words):
                for a in range(len(other)) if docs[j] < docs[k] else ():
                    n = 0
                    while i + n < len(own) and a + n < len(other) and own[i + n] == other[a + n]:
                        n += 1
                    best = max(best, n)
            assert block.longest[block.starts[k] + i] == best
    for k, (which, start, length) in enumerate(zip(*block.parse())):
        assert length == max(block.longest[start], 1)


def test_anchors_are_shared():
    random_ = np.random.default_rng(1)
    shared = random_.integers(1, 1 << 62, 50, dtype=np.uint64)
    texts = [np.concatenate([random_.integers(1, 1 << 62, n, dtype=np.uint64), shared, random_.integers(1, 1 << 62, 70 - n, dtype=np.uint64)]) for n in (0, 20, 70)]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    text, place, gram, *_ = anchors(np.concatenate(texts), offsets, 50, 16)
    found = [set(zip((place - n)[text == k].tolist(), gram[text == k].tolist())) for k, n in enumerate((0, 20, 70))]
    assert any(0 <= at <= 34 for at, _ in found[0] & found[1] & found[2])


def test_least_of_runs():
    h = np.random.default_rng(2).integers(0, 9, 200).astype(np.uint64)
    for size in (1, 2, 5, 8, 35):
        want = [max(range(i, i + size), key=lambda j: (-int(h[j]), j)) for i in range(200 - size + 1)]
        assert least_of_runs(h, size).tolist() == want
