import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.tokens import VOCABULARY, Encoder, encode_column

ENCODER = Encoder(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a", "Hello  world", "don't\r\n\tstop ", "x" * 5000, "漢字仮名" * 900, "Größe naïve ﬁxed é ​", "<|endoftext|>", "1234567890" * 40, "a  　 b"])
def test_same_as_the_public_library(library, text):
    assert ENCODER.encode(text) == library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    global _LIB
    if "_LIB" not in globals():
        _LIB = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
        _LIB.encode_special_tokens = True
    assert ENCODER.encode(text) == _LIB.encode(text, add_special_tokens=False).ids


def test_round_trip():
    back = {i: b for b, i in ENCODER.ranks.items()}
    r = random.Random(3)
    for _ in range(200):
        s = "".join(chr(r.choice([r.randint(32, 126), r.randint(0x400, 0x4FF), r.randint(0x4E00, 0x4FFF)])) for _ in range(50))
        assert b"".join(back[i] for i in ENCODER.encode(s)).decode() == s


def test_column(spark):
    rows = [(1, "a cat", "x"), (2, None, "y"), (3, "", None), (None, "b", "z"), (1, "a cat", "x")]
    got = encode_column(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((a or 0, ENCODER.encode(t)) for a, t, _ in rows)
    assert encode_column(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    sizes = encode_column(spark.createDataFrame(rows, "doc_id long, text string, ids string"), sizes_only=True).collect()
    assert sorted(r.n_tokens for r in sizes) == sorted(len(ENCODER.encode(t)) for _, t, _ in rows)
