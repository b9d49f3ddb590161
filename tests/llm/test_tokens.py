import os
import random

import pytest

from fleetloom.llm.tokens import TOKENIZER, encoding, pieces_of, with_tokens

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary here")


def test_counts_of_null_empty_long_and_odd_texts(spark):
    texts = [None, "", "   ", "Hello world", "ß" * 10, "a b " * 40_000, "x" * 120_000, "<|endoftext|>", "a" * 49_999 + "   b" + " " * 60_000 + "c", "ab1  " * 30_000, "\n \t" * 30_000, "it's \u00a0\x1c so\n" * 9_000]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, tokens int")
    got = {r.doc_id: r.tokens for r in with_tokens(df).collect()}
    with open(TOKENIZER, "rb") as f:
        enc = encoding(f.read())
    assert got[0] == got[1] == 0 and got[3] == 2
    assert all(got[k] == len(enc.encode_ordinary(t)) for k, t in enumerate(texts) if t)
    assert with_tokens(df).columns == ["doc_id", "tokens"]


def test_pieces_join_to_the_text_and_have_its_tokens():
    with open(TOKENIZER, "rb") as f:
        enc = encoding(f.read())
    rng = random.Random(4)
    for text in ("", "ab", "word " * 100, "x" * 1000, " " * 500 + "y" * 500, *("".join(rng.choices("ab1 .'s\n\t\u00a0\u3000\x1cé", k=400)) for _ in range(200))):
        pieces = list(pieces_of(text, 16))
        assert "".join(pieces) == text
        assert [t for p in pieces for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
