"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("FLEETLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how this vocabulary's tokenizer cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 50_000  # characters; longer texts are encoded piece by piece
# No word of the pattern holds a blank after anything but a blank, nor looks back: a text that is cut here
# falls into the same words.
_BORDER = re.compile(r"(?<=\S)[ \n]")


def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces_of(text: str, most: int = LONG) -> Iterator[str]:
    """The text in pieces of at least ``most`` characters that join to it again and have as many tokens together.

    It is cut only before a blank that follows another sign; a run without such a place stays whole.
    """
    at = 0
    while len(text) - at > most and (cut := _BORDER.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def with_tokens(documents: DataFrame, text: str = "text", name: str = "tokens", vocabulary_file: str = TOKENIZER) -> DataFrame:
    """The rows with their number of tokens, without the text; 0 for a null or empty text.

    A column that is called ``name`` already is replaced.
    The vocabulary, under a megabyte whatever the corpus, is read once and sent to the executors.
    """
    with open(vocabulary_file, "rb") as file:
        shipped = documents.sparkSession.sparkContext.broadcast(file.read())
    others = [c for c in documents.columns if c not in (text, name)]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(shipped.value)
        for f in frames:
            sizes = [sum(len(enc.encode_ordinary(p)) for p in pieces_of(t)) if t else 0 for t in f[text]]
            yield f[others].assign(**{name: sizes})

    schema = documents.select(*others, F.lit(0).cast("bigint").alias(name)).schema
    return documents.select(*others, text).mapInPandas(count, schema)
