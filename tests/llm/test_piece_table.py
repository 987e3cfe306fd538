"""Fill-in-the-middle: against a plain version, exact round trips and odd texts."""

import hashlib
import re

import pytest
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st

from twinsift.llm.piece_table import ARRANGEMENTS, arrange, cut, read, render, restore, slices, transform

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_version(doc_id, text):
    text = text or ""
    n = len(UNIT.findall(text))
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    ends = [0] + [m.end() for m in UNIT.finditer(text)]
    a, b = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [
    None, "", " ", "\n\t \r", "word", " word", "word ", " a  b ", "é東 京 x 😀 end", "a <P> b", "<S>", "x<M>", "<P <S< M>",
    "<", ">P>", "a\x0bb\x0cc", "\x00 nul \x1c sep", "long " * 40_000 + "end", "x" * 200_000, "same", "same",
]


@pytest.fixture(scope="module")
def odd_texts(llm):
    rows = [(i * 7 + k, text, "mine", i) for i, text in enumerate(TEXTS) for k in range(7)] + [(None, "no id at all", "mine", 0)] * 2
    return rows, llm.createDataFrame(rows, "doc_id bigint, text string, form string, n int")


def test_odd_texts(odd_texts):
    rows, docs = odd_texts
    made = restore(render(transform(docs)))
    assert made.columns[:4] == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0)
    found = sorted(made.collect(), key=key)
    assert len(found) == len(rows)
    forms = set()
    for row, (doc_id, text, *_) in zip(found, sorted(rows, key=key)):
        n, form, prefix, middle, output = plain_version(doc_id, text)
        assert (row["__n"], row["__form"], row["__prefix_chars"], row["__middle_chars"], row["__output"]) == (n, form, prefix, middle, output)
        assert (row["__output_sha256"], row["__restored"], row["__restored_sha256"]) == (sha(output), text or "", sha(text or ""))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_parameters(odd_texts):
    _, docs = odd_texts
    forms = lambda **more: {r["__form"] for r in transform(docs, **more).collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, suffix_first=100) == {"plain", "spm"}
    assert forms(rate=100, suffix_first=0) == {"plain", "psm"}


def test_empty_table(none):
    assert restore(render(transform(none))).count() == 0


@settings(max_examples=200, deadline=None)
@examples(st.text(alphabet="<>PSM a", max_size=12), st.integers(0, 12), st.integers(0, 12), st.sampled_from(sorted(ARRANGEMENTS)))
def test_any_cut_is_undone(text, first, second, form):
    if re.search("<[PSM]>", text):
        return
    raw = text.encode()
    a, b = sorted((min(first, len(raw)), min(second, len(raw))))
    output = b"".join(slices(memoryview(raw), arrange(cut(len(raw), a, b), form)))
    assert b"".join(slices(memoryview(output), read(output, form))) == raw
