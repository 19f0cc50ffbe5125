"""Byte-pair token counts where a vocabulary file is at hand, else the estimate."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.text import tokens_ceil

#: How text is parted before merges, for vocabularies of that family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def counter(path: str | None, pattern: str = PATTERN):
    """A column function that counts tokens by the rank file at ``path``, or estimates them without one."""
    if path is None:
        return tokens_ceil

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int32")

    return lambda c: count(c)


def masked_labels(ids: Column, template: Column) -> Column:
    """Ids as training labels: -100 up to the end of the last response template, all where there is none."""
    n = F.size(template)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ids) - n)), lambda i: F.slice(ids, i + 1, n) == template)
    last = F.element_at(starts, -1)
    return F.transform(ids, lambda x, i: F.when((F.size(starts) == 0) | (i < last + n), F.lit(-100)).otherwise(x))
