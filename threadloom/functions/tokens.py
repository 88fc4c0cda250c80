"""Tokenizers. Native ones are plain expressions; a BPE vocabulary runs in an Arrow UDF."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that the framing of a message costs on top of its text.
MESSAGE_OVERHEAD = 7


class Tokenizer(Protocol):
    def ids(self, text: Column) -> Column:
        """array<int> of token ids; null for null."""

    def count(self, text: Column) -> Column:
        """int; null for null."""


def words(text: Column) -> Column:
    """The blank-separated words, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


class WordTokenizer:
    """Words, with a hash as id: no vocabulary, no Python."""

    def ids(self, text: Column) -> Column:
        return F.transform(words(text), lambda w: F.hash(w))

    def count(self, text: Column) -> Column:
        return F.when(text.isNotNull(), F.size(words(text)))


class BpeTokenizer:
    """A tiktoken encoding from a vocabulary file (`token rank` lines, base64) given by path."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def ids(self, text: Column) -> Column:
        path, pattern = self.path, self.pattern

        @F.pandas_udf("array<int>")
        def encode(s: pd.Series) -> pd.Series:
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            return s.map(lambda x: None if x is None else encoding.encode_ordinary(x))

        return encode(text)

    def count(self, text: Column) -> Column:
        return F.when(text.isNotNull(), F.size(self.ids(text)))


DEFAULT = WordTokenizer()


def message_tokens(content: Column, tokenizer: Tokenizer = DEFAULT) -> Column:
    """Tokens of a message with its framing; a null content costs the framing alone."""
    return F.coalesce(tokenizer.count(content), F.lit(0)) + MESSAGE_OVERHEAD
