"""Chunked encoding against the library's own, on random and odd texts."""

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinsift.llm.encode import Encoder

ODD = [
    None, "", " ", "  a b", "a  b", "a \n b", "x ", "<|endoftext|> hi <|startoftext|>", "ünï  é\tq  r",
    "don't we'll 12 345 ΟΔΟΣ ΟΔΟΣ.", "a" * 500 + " b", "e ́a ́", "a.\nB c!\n\nd", "x.\n", "\nq w.",
    "it's,   q", "w.\n z", "1. 2, a1. ok", "a\rb c\x1cd \x1c e", "　x  ", "東京 Tokyo x y",
]
ENCODERS = {name: Encoder(open(public_tokenizers.path(name), encoding="utf-8").read()) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def check(encoder, texts):
    got = []
    for first, last, ids, bounds in encoder.encode(pa.array(texts, pa.string()), 2):
        got += [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(last - first)]
    assert got == [[*ids, 2] for ids in encoder.encode_whole([t or "" for t in texts])]


@pytest.mark.parametrize("name", ENCODERS)
def test_odd_texts(name):
    check(ENCODERS[name], ODD)
    check(ENCODERS[name], list(reversed(ODD)))


@pytest.mark.parametrize("name", ENCODERS)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("ab'sé. ,\n\t1  ́Σ<|>")), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_random_texts(name, texts):
    check(ENCODERS[name], texts)


@pytest.mark.parametrize("name", ENCODERS)
def test_table(name, llm, sf_dir):
    texts = [r.text for r in llm.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    check(ENCODERS[name], texts)
