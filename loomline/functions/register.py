"""Names for SQL: native rules as SQL functions, Arrow functions, and table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from loomline.functions import chunking, edits, lint

#: Rules that SQL itself can say; Catalyst inlines them.
NATIVE = {
    "loom_tokens_floor(t STRING) RETURNS INT": "CAST(floor(length(t) / 4) AS INT)",
    "loom_tokens_ceil(t STRING) RETURNS INT": "CAST(ceil(length(t) / 4) AS INT)",
    "loom_content_id(t STRING) RETURNS STRING": "substring(sha2(CAST(t AS BINARY), 256), 1, 16)",
    "loom_without_line_numbers(t STRING) RETURNS STRING": r"regexp_replace(t, r'(?m)^\s*\d+\t', '')",
    "loom_is_tagged(t STRING) RETURNS BOOLEAN": r"t RLIKE r'^\[REF:[a-f0-9]+( src=[^\]]*)?\]'",
}


@udtf(returnType="seg_id string, kind string, level string, content string")
class ParseSegments:
    """Table function: a row for each segment block of a text; of blocks with one id the last holds (PF16)."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        import re

        found = re.finditer(r"\[SEG\s+id=([^\s\]]+)\s+kind=([^\s\]]+)\s+level=([^\s\]]+)\](.*?)\[/SEG\]", text or "", re.DOTALL)
        last = {m[1]: m.groups() for m in found}
        yield from last.values()


TABLES = {"loom_parse_segments": ParseSegments, "loom_chunk": chunking.Chunk, "loom_shell_replacements": edits.ShellReplacements, "loom_diff_changes": edits.DiffChanges}
ARROW = {"loom_lint": lint.linted, "loom_deduplicate_definitions": chunking.deduplicated_definitions}


def register(spark: SparkSession) -> list[str]:
    """Register all functions in the session; returns their names."""
    for head, body in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, function in ARROW.items():
        spark.udf.register(name, function)
    for name, table in TABLES.items():
        spark.udtf.register(name, table)
    return [*(h.partition("(")[0] for h in NATIVE), *ARROW, *TABLES]
