"""Spans of a text that compression must keep: paths, lines, hashes, names.

The Arrow function is authoritative, since it needs offsets and which alternative
matched; native counts per group serve reports.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What each group matches, tried in this order; the kinds and sizes that have none.
_EXT = "py|js|ts|tsx|jsx|java|go|rs|cpp|c|h|hpp|rb|php|cs|md|yaml|yml|json|toml|cfg|ini|sh"
_EXT_RELATIVE = "py|js|ts|jsx|java|go|rs|cpp|c|h|md|yaml|yml|json|toml"
GROUPS = {
    "file_path": rf"/workspace/[\w\-./_]+|/[\w\-./_]+\.(?:{_EXT})\b|(?<![\w/])(?:src|tests?|lib|app)/[\w\-./_]+\.(?:{_EXT_RELATIVE})\b",
    "stack_trace_path": r'File\s+"[^"]+\.[a-z]{1,4}"',
    "line_number": r"(?:line|L)\s*[:#]?\s*\d+|(?<=[\s,\(\[])\d{1,4}:\d{1,3}(?=[\s,\)\]])",
    "hash": r"\b(?:commit\s+)?[0-9a-f]{7,40}\b",
    "url": r"https?://[^\s'\"<>\]`)]+",
    "error_class": r"\b[A-Z][a-zA-Z]*(?:Error|Exception|Warning|Failure|Fault)\b",
    "identifier": r"\b[a-z][a-z0-9]*(?:_[a-z][a-z0-9]*){2,}|[a-z][a-z0-9]*(?:[A-Z][a-zA-Z0-9]+){2,}|[A-Z][a-z]+[A-Z][a-z][a-zA-Z0-9]{4,}\b",
    "quoted_literal": r"'[^']{4,80}/[^']*'",
    "package_name": r"\b(?:netcdf4|h5netcdf|xarray|numpy|pandas|torch|tensorflow|sklearn|matplotlib|scipy|requests|django|flask|fastapi|pytest|sympy)\b",
}
THOUGHT_GROUPS = ("error_class", "package_name", "quoted_literal", "url")
NO_SPANS, LEAST_CHARS = ("system_prompt",), 50

_ALL = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in GROUPS.items()))
#: What every match of some group holds; most texts hold none of it and never reach Python.
HINT = (
    r"(?U)/|File\s+\"|(?:line|L)\s*[:#]?\s*\d|\d:\d|[0-9a-f]{7}|Error|Exception|Warning|Failure|Fault|[a-z0-9]_[a-z][a-z0-9]*_[a-z]|[a-z0-9][A-Z]|"
    + "|".join(re.findall(r"\w{4,}", GROUPS["package_name"]))
)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))


def find(text: str | None, kind: str | None) -> list[tuple[int, int, str, str]]:
    """Spans in order; one scan never gives overlapping ones."""
    if text is None or kind in NO_SPANS or len(text) < LEAST_CHARS:
        return []
    found = ((m.start(), m.end(), m.lastgroup, m[0]) for m in _ALL.finditer(text))
    return [s for s in found if kind != "assistant_thinking" or s[2] in THOUGHT_GROUPS]


@F.pandas_udf(SPANS)
def must_keep(text: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("start", "end", "kind", "text"), s, strict=True)) for s in find(t, k)] for t, k in zip(text, kind, strict=True)])


def span_rows(df: DataFrame, keys: list[str], text: str, kind: str) -> DataFrame:
    """One row a span."""
    told = F.when(F.col(text).rlike(HINT), F.col(text))
    return df.select(*keys, F.explode(must_keep(told, F.col(kind))).alias("s")).select(*keys, "s.*")


def group_count(text: Column, group: str) -> Column:
    """How often one group matches on its own, natively."""
    return F.regexp_count(text, F.lit(GROUPS[group]))
