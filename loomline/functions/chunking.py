"""Chunks of text within a token budget, cut at structure, lines or separators."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

_STRUCTURE = re.compile(r"(?:\s*\d+\t)?(?:class |def )\w+")
_HEADER = re.compile(r"(?:class|def)\s|# Lines \d")
_NAMED = re.compile(r"(?:class|def)\s+\w+")
_SEPARATORS = ", ;}]"

_CHUNK = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line", "tokens"))])

Counter = Callable[[str], int]


def estimate(text: str) -> int:
    return math.ceil(len(text) / 4)


def is_boundary(line: str) -> bool:
    """Whether a class or function begins on a line, numbered or not."""
    return _STRUCTURE.match(line) is not None


def pieces(line: str, most: int, count: Counter = estimate) -> Iterator[str]:
    """An oversized line in parts of about ``most`` tokens that join to it again.

    Parts are of equal width, cut back to the last separator of their back half.
    What is still too large loses its front half until the rest fits.
    """
    total = count(line)
    if total <= most:
        yield line
        return
    width, at = max(1, len(line) // max(2, -(-total // most))), 0
    while at < len(line):
        stop = at + width
        if stop < len(line):
            stop = 1 + max(line.rfind(s, at + width // 2, stop) for s in _SEPARATORS) or stop
        part, at = line[at:stop], stop
        while len(part) > 1 and count(part) > most:
            yield part[: len(part) // 2]
            part = part[len(part) // 2 :]
        yield part


def packed(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of neighbours whose sizes sum to ``most`` at most, as long as they can be; a larger one stands alone."""
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield slice(first, i)
            first, total = i, 0
        total += size
    if sizes:
        yield slice(first, len(sizes))


def chunks(text: str, most: int, count: Counter = estimate, single: int | None = None) -> list[tuple[str, int, int, int]]:
    """``(text, first line, last line, tokens)`` with lines from 1, last included.

    Structural blocks are packed whole by the sum of their counts.  A block of more
    than ``single`` tokens (``most`` if not given), and a text without structure, is
    packed by lines; a line that does not fit is packed by its parts, each of which
    counts as a line.
    """
    lines = text.split("\n")
    edges = [i for i, line in enumerate(lines) if is_boundary(line)]
    whole = [] if not edges else [slice(a, b) for a, b in zip([0, *edges], [*edges, len(lines)], strict=True) if a < b]
    sizes = [count("\n".join(lines[s])) for s in whole]
    out: list[tuple[str, int, int, int]] = []

    def tell(own: list[str], at: int) -> None:
        body = "\n".join(own)
        out.append((body, at + 1, at + len(own), count(body)))

    def by_lines(part: slice) -> None:
        split = [p for line in lines[part] for p in pieces(line, most, count)]
        for run in packed(list(map(count, split)), most):
            tell(split[run], part.start + run.start)

    if not whole:
        by_lines(slice(0, len(lines)))
    for large, run in groupby(range(len(whole)), lambda k: sizes[k] > (most if single is None else single)):
        own = list(run)
        for r in packed([sizes[k] for k in own], 0 if large else most):
            first, last = whole[own[r][0]], whole[own[r][-1]]
            by_lines(first) if large else tell(lines[first.start : last.stop], first.start)
    return out


def without_repeated_definitions(text: str) -> str:
    """Without definitions whose header stood before, up to the next header."""
    seen: set[str] = set()
    out, skip = [], False
    for line in text.split("\n"):
        if _HEADER.match(line):
            name = _NAMED.match(line)
            skip = name is not None and name[0] in seen
            seen.update([name[0]] if name else [])
        if not skip:
            out.append(line)
    return "\n".join(out)


@F.pandas_udf(T.ArrayType(_CHUNK))
def chunked(text: pd.Series, most: pd.Series) -> pd.Series:
    names = ("text", "start_line", "end_line", "tokens")
    return pd.Series([None if t is None else [dict(zip(names, c, strict=True)) for c in chunks(t, int(k))] for t, k in zip(text, most, strict=True)])


@F.pandas_udf(T.StringType())
def deduplicated_definitions(text: pd.Series) -> pd.Series:
    return text.map(without_repeated_definitions, na_action="ignore")


@udtf(returnType="text string, start_line int, end_line int, tokens int")
class Chunk:
    """Table function: a row for each chunk of a text within a budget."""

    def eval(self, text: str | None, most: int) -> Iterator[tuple]:
        yield from chunks(text, most) if text is not None else ()
