"""Text expressions: sizes, heads, kinds, line numbers, keywords.  All are native columns.

Patterns are ASCII on purpose, so that Java and RE2 agree on them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.schemas import RESULT_KINDS

# Fixed values.
MODEL_KINDS_TASKS = ("task_tracker", "finish")
SYSTEM_HEAD, SYSTEM_MARK = 500, "\n[...truncated...]"
CODE_TOKENS = ("def ", "class ", "import ", "return ", "self.")
FRAME_LINES = ("Exit code:", "Wall time:", "Total output lines:", "Output:")
CODE_WORDS = ("import ", "def ", "class ", "from ", "function ", "package ")
PREAMBLES = (
    "Here is the compressed", "Here's the compressed", "I have compressed", "Below is the compressed",
    "Compressed version:", "The compressed", "I've compressed", "Sure, here",
)
CHAT_PATH, SUBSCRIPTION_URL = "/chat/completions", "https://chatgpt.com/backend-api/codex/responses"
QA_STARTS = ("Yes,", "No,", "The answer is", "To answer", "Based on")
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "about", "between", "through",
    "during", "before", "after", "and", "or", "but", "not", "no", "if", "then", "else", "when", "where", "how", "what", "which", "who", "that",
    "this", "it", "i", "me", "my", "we", "our", "you", "your", "he", "she", "they", "them", "its", "all", "each", "any", "some", "just", "also",
    "very", "so", "too", "up", "out", "get",
)
CODE_HINT = (
    r"(?i)(\bbugs?\b|\bcode\b|\bfiles?\b|\bfunctions?\b|\brefactor|\btests?\b|\bbuild\b|\bimports?\b|\bgrep\b|\brepo\b|\bmodules?\b|\bgit\b|\brun\b|\bfix|\bedit|\brename|"
    r"\bcodebase\b|\bdeprecated\b|\bcompile|\bclass\b|\bmethods?\b|\bvariables?\b|\bstack trace\b|\bimplementation\b|\bparser\b|\bcrash|\bserver\b|"
    r"\w+\(\)|[a-z]+_[a-z]+|\.(py|js|ts|go|md|tsx|java|cpp|rs|json|yaml))"
)
MISSING_TOOL = (
    r"(?i)((do(n'?| no)t|does(n'?| no)t) have\b.{0,40}\b(tool|connector|integration|access|ability)|no\b.{0,30}\b(tool|connector|integration)\b.{0,20}\bavailable"
    r"|not available in this (session|environment)|is(n'?t| not) available|can'?t (complete|do that|help with that|look (this|that) up))"
)


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def starts_with_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(w) for w in words))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def occurrences(c: Column, literal: str) -> Column:
    """How often ``literal`` stands in ``c``, without overlaps."""
    return F.when(c.isNotNull(), ((F.length(c) - F.length(F.replace(c, F.lit(literal)))) / len(literal)).cast("int"))


# --- sizes ---------------------------------------------------------------


def tokens_floor(c: Column) -> Column:
    """Estimate of the batch side: four characters a token, rounded down."""
    return F.floor(F.length(c) / 4).cast("int")


def tokens_ceil(c: Column) -> Column:
    """Estimate of the runtime side: four characters a token, rounded up (R2)."""
    return F.ceil(F.length(c) / 4).cast("int")


def first_tokens(c: Column, k: Column | int) -> Column:
    """The first ``k`` tokens of the four-character encoding, decoded again."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.substring(c, F.lit(1), (4 * k).cast("int"))


def token_ratio(tokens: Column, chars: Column) -> Column:
    """Tokens for each character, three digits, 0 for empty text."""
    return F.when(chars > 0, F.bround(tokens / chars, 3)).otherwise(0.0)


def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def clip_system(c: Column) -> Column:
    """A long system prompt cut to its head, with a mark."""
    return F.when(F.length(c) > SYSTEM_HEAD, F.concat(head(c, SYSTEM_HEAD), F.lit(SYSTEM_MARK))).otherwise(c)


def clip(c: Column, n: int) -> Column:
    """The first ``n`` characters and how many more there were."""
    more = F.format_number(F.length(c) - n, 0)
    return F.when(F.length(c) > n, F.concat(head(c, n), F.lit("… (+"), more, F.lit(" more chars)"))).otherwise(c)


def content_id(c: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


# --- kinds ---------------------------------------------------------------


def message_kind(role: Column, content: Column, first_tool: Column, position: Column) -> Column:
    """Kind of a message from its role, its first tool call and its content."""
    body = F.coalesce(content, F.lit(""))
    top = head(body, 200)
    tool = (
        F.when(body.contains("Traceback") | body.contains("FAILED") | top.contains("Error:"), "log_output")
        .when(starts_with_any(strip(top), ("/", ".", "#!")) | top.contains("@@"), "file_read")
        .when(occurrences(top, "\n") > 5, "log_output")
        .otherwise("tool_result")
    )
    assistant = (
        F.when(first_tool.isNull() | (first_tool == "think"), "assistant_thinking")
        .when(first_tool.isin(*MODEL_KINDS_TASKS), "meta_action")
        .when(first_tool == "str_replace_editor", "file_operation")
        .when(first_tool.isin("execute_bash", "bash"), "bash_command")
        .otherwise("tool_call")
    )
    return (
        F.when(role == "system", "system_prompt")
        .when(role == "user", F.when(position == 0, "user_turn_current").otherwise("user_turn_history"))
        .when(role == "assistant", assistant)
        .when(role == "tool", tool)
        .otherwise("tool_result")
    )


def code_words(top: Column) -> Column:
    """How many of the code words a head holds."""
    return reduce(lambda a, b: a + b, (top.contains(w).cast("int") for w in CODE_WORDS))


def refine_result(kind: Column, content: Column) -> Column:
    """A tool result told apart by the shape of its content."""
    top = head(content, 300)
    refined = (
        F.when(top.contains("Here's the result of running `cat -n`"), "file_read")
        .when(top.startswith("Here's the result of running") & top.contains("cat"), "file_read")
        .when(top.rlike(r"^The file .+ has been (created|edited|saved)"), "file_edit_confirm")
        .when(top.contains("Here's the files and directories"), "directory_listing")
        .when((code_words(top) >= 2) & (occurrences(content, "\n") > 10), "file_read")
        .otherwise("tool_result")
    )
    return F.when(kind == "tool_result", refined).otherwise(kind)


def lone_kind(content: Column) -> Column:
    """Kind of a content without a conversation about it; the order of the rules matters."""
    top = head(content, 300)
    first, lead = head(content, 200), F.regexp_replace(top, r"^\s+", "")
    refined = refine_result(F.lit("tool_result"), content)
    log = F.lit("log_output")
    return (
        F.when(top.contains("[tool_calls]:") | top.contains('"str_replace_editor"'), "file_operation")
        .when(refined != "tool_result", refined)
        .when(top.contains("Traceback") | top.contains("FAILED") | first.contains("Error:"), log)
        .when(first.contains("@@") | starts_with_any(lead, ("/", ".", "#!")), "file_read")
        .when(contains_any(top, CODE_WORDS[:5]), "file_read")
        .when(starts_with_any(lead, ("$ ", "$\t", ">>> ")), log)
        .when(top.rlike(r"(?m)^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}") | top.rlike(r"(?i)\blevel=(?:trace|debug|info|warn|warning|error|fatal)\b"), log)
        .when(occurrences(first, "\n") > 5, log)
        .otherwise("file_read")
    )


# --- blocks and wrapping -------------------------------------------------

SEGMENT_BLOCK = r"(?s)\[SEG\s+id=([^\s\]]+)\s+kind=([^\s\]]+)\s+level=([^\s\]]+)\](.*?)\[/SEG\]"


def segment_block(seg_id: Column, kind: Column, level: Column, content: Column) -> Column:
    """A segment between its marks."""
    return F.concat(F.lit("[SEG id="), seg_id, F.lit(" kind="), kind, F.lit(" level="), level, F.lit("]\n"), content, F.lit("\n[/SEG]"))


def parse_blocks(text: Column) -> Column:
    """``array<struct<seg_id, kind, level, content>>`` of all blocks, in order (PF16).

    Of blocks with one id the last holds; :func:`loomline.operators.segments.blocks` keeps it.
    """
    parts = [F.regexp_extract_all(text, F.lit(SEGMENT_BLOCK), F.lit(k)) for k in range(1, 5)]
    return F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("seg_id", "kind", "level", "content"), strict=True)))


def fenced_input(text: Column) -> Column:
    """What stands between the input fence and the output heading; all of it, or the tail, if a mark is missing (PF18)."""
    start, stop = "```input_data\n", "\n```\n\n### COMPRESSED OUTPUT"
    tail = F.substring(text, F.locate(start, text) + len(start), F.length(text))
    end = F.locate(stop, tail)
    return F.when(F.locate(start, text) == 0, text).when(end == 0, tail).otherwise(F.substring(tail, F.lit(1), end - 1))


def body_of(text: Column, seg_id: str) -> Column:
    """``struct<found, body>`` of one segment; a blank body is null but found."""
    block = rf"(?s)\[SEG\s+id={re.escape(seg_id)}(?=[\s\]])[^\]]*\](.*?)\[/SEG\]"
    body = F.regexp_replace(F.regexp_extract(text, block, 1), r"^\n+|\n+$", "")
    found = text.rlike(block)
    return F.struct(F.coalesce(found, F.lit(False)).alias("found"), F.when(found & body.rlike(r"\S"), body).alias("body"))


def unwrap(text: Column) -> Column:
    """Model output without its thoughts and segment marks, paired or stray.

    All up to the first end of a thought goes, also where its beginning is missing.
    """
    rest = strip(F.regexp_replace(F.regexp_replace(text, r"(?s)\A.*?</think>", ""), r"(?s)<think>.*?</think>\s*", ""))
    paired = r"(?s)\[SEG\b[^\]]*\]\s*(.*?)\s*\[/SEG\]"
    return strip(F.when(rest.rlike(paired), F.regexp_extract(rest, paired, 1)).otherwise(F.regexp_replace(rest, r"\[SEG\b[^\]]*\]|\[/SEG\]", "")))


def without_reminders(text: Column) -> Column:
    """Without system reminders, null where nothing is left."""
    return F.nullif(strip(F.regexp_replace(text, r"(?s)<system-reminder>.*?</system-reminder>", "")), F.lit(""))


def without_line_numbers(text: Column) -> Column:
    """Without the number and tab that a listing puts before each line."""
    return F.regexp_replace(text, r"(?m)^\s*\d+\t", "")


def without_padding(text: Column) -> Column:
    """Line numbers stay, the blanks and tabs before them go."""
    return F.regexp_replace(text, r"(?m)^[ \t]+(\d+\t)", "$1")


def with_line_numbers(text: Column) -> Column:
    """``N<tab>line`` for code of four lines or more that is not numbered yet.

    Code is what holds two code tokens at least; numbered is what has a number and
    a tab or an arrow on 60 % of its first lines.
    """
    lines = F.split(F.regexp_replace(text, r"(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])\z", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", -1)
    tokens = reduce(lambda a, b: a + b, (occurrences(text, w) for w in CODE_TOKENS))
    top = F.slice(lines, 1, 20)
    numbered = F.size(F.filter(top, lambda x: x.rlike(r"^\s*\d+[\t→]")))
    added = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\t"), x, F.lit("\n"))), "")
    return F.when((F.size(lines) >= 4) & (tokens >= 2) & (10 * numbered < 6 * F.size(top)), added).otherwise(text)


def matchable(text: Column) -> Column:
    """Text as it is compared with earlier reads of a file: no numbers, no outer blanks."""
    return strip(without_line_numbers(text))


def unix_lines(text: Column) -> Column:
    """Line ends as line feeds, those of a carriage return alone too."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def command_frame(text: Column) -> Column:
    """``struct<header, body>``: leading lines that report on a command, and its output."""
    told = "|".join(FRAME_LINES)
    header = F.regexp_extract(text, rf"\A((?:[^\S\n]*\n|[^\S\n]+\z|(?:{told})[^\n]*(?:\n|\z))*)", 1)
    seen = header.rlike(rf"(?m)^(?:{told})")
    return F.struct(F.when(seen, header).otherwise("").alias("header"), F.when(seen, F.substring(text, F.length(header) + 1, F.length(text))).otherwise(text).alias("body"))


def intent_text(reasoning: Column, task: Column) -> Column:
    """What the agent is after: its last reasoning and the task, clipped."""
    whole = F.concat(F.lit("(overall task: "), head(task, 200), F.lit(")"))
    why = F.nullif(strip(reasoning), F.lit(""))
    return F.when(why.isNull(), task).when(F.nullif(task, F.lit("")).isNull(), head(why, 900)).otherwise(F.concat(head(why, 900), F.lit("\n"), whole))


def sanitized_source(path: Column) -> Column:
    """A source name that cannot close a tag."""
    return strip(F.replace(F.replace(path, F.lit("]"), F.lit("_")), F.lit("\n"), F.lit(" ")))


def reference_tag(content: Column, source: Column) -> Column:
    """The tag under which compressed text refers to its original."""
    return F.concat(F.lit("[REF:"), content_id(content), F.coalesce(F.concat(F.lit(" src="), sanitized_source(source)), F.lit("")), F.lit("]"))


def is_tagged(content: Column) -> Column:
    """Whether a text is compressed already (PF10)."""
    return content.rlike(r"^\[REF:[a-f0-9]+( src=[^\]]*)?\]")


# --- words ---------------------------------------------------------------


def name_words(name: Column) -> Column:
    """A tool name as words."""
    plain = F.replace(F.replace(name, F.lit("mcp__"), F.lit("")), F.lit("__"), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(plain, r"([a-z0-9])([A-Z])", "$1 $2"), r"[._]+", " "))


def keywords(text: Column) -> Column:
    """Distinct identifiers and their snake and camel parts, lower case, sorted, no stop words."""
    words = F.regexp_extract_all(text, F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))
    parts = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit("[a-z]+|[A-Z][a-z]*"), F.lit(0))))
    both = F.array_union(F.transform(words, F.lower), F.transform(F.filter(parts, lambda p: F.length(p) > 1), F.lower))
    return F.array_sort(F.array_except(both, F.array(*map(F.lit, STOP_WORDS))))


def keyword_score(query: Column, tool: Column, name: Column) -> Column:
    """2 for each word shared, .5 for each pair of which one holds the other, 3 for each word of the name."""
    partial = F.aggregate(
        query,
        F.lit(0),
        lambda n, q: n + F.size(F.filter(tool, lambda t: (q != t) & (t.contains(q) | q.contains(t)))),
    )
    return 2.0 * F.size(F.array_intersect(query, tool)) + 0.5 * partial + 3.0 * F.size(F.array_intersect(query, name))


def wants_code(query: Column) -> Column:
    return F.coalesce(query.rlike(CODE_HINT), F.lit(False))


def lacks_tool(answer: Column) -> Column:
    return F.coalesce(answer.rlike(MISSING_TOOL), F.lit(False))


def marker_counts(text: Column, patterns: dict[str, str]) -> Column:
    """``map<marker, count>`` of case-insensitive patterns."""
    return F.map_from_arrays(F.array(*map(F.lit, patterns)), F.array(*(F.regexp_count(text, F.lit(f"(?i){p}")) for p in patterns.values())))


def label_category(label: Column) -> Column:
    """What a quality label is about."""
    low = F.lower(label)
    return F.when(low.contains("dropped"), "dropped").when(low.contains("docstring"), "docstring").when(low.contains("bash") | low.contains("grep"), "bash_grep").otherwise("code_kept")


def ratio_level(ratio: Column) -> Column:
    """Level of a target ratio, a number or a percentage."""
    text = strip(ratio.cast("string"))
    value = F.when(text.endswith("%"), F.regexp_replace(text, "%$", "").try_cast("double") / 100).otherwise(text.try_cast("double"))
    return F.when(value <= 0.20, "L3").when(value <= 0.25, "L2").when(value <= 0.35, "L1").when(value.isNotNull(), "L0")


def looks_truncated(text: Column) -> Column:
    """Whether an output was cut off.

    Empty ones are, and those that open more segments than they close.  What ends
    in neither a closing mark nor a fence is, unless it is short and without segments.
    """
    opened, closed = F.regexp_count(text, F.lit(r"\[SEG\s+id=[^\s\]]+\s+kind=[^\s\]]+\s+level=[^\s\]]+\]")), occurrences(text, "[/SEG]")
    tail = F.regexp_replace(text, r"\s+\z", "")
    unended = ~(tail.endswith("[/SEG]") | tail.endswith("```"))
    return F.coalesce((tail == "") | (opened > closed) | (unended & ((opened > 0) | (F.length(text) >= 200))), F.lit(True))


def patch_of(answer: Column) -> Column:
    """The diff in an answer (R36): that of a diff fence, of any fence that holds one,
    from where a bare one begins, else the whole answer; a null answer is empty."""
    text = F.coalesce(answer, F.lit(""))
    fence = r"(?s)```[a-zA-Z]*\s*\n(.*?)```"
    tagged = r"(?is)```(?:diff|patch)\s*\n(.*?)```"
    bodies = F.filter(F.regexp_extract_all(text, F.lit(fence), F.lit(1)), lambda b: b.contains("--- a/") | b.rlike(r"\A\s*(---|diff --git)"))
    bare = r"(?s)(?:\A|\n)((?:diff --git [^\n]|--- [^\n]+\n\+\+\+ [^\n]).*)"
    return (
        F.when(text.rlike(tagged), strip(F.regexp_extract(text, tagged, 1)))
        .when(F.size(bodies) > 0, strip(F.get(bodies, 0)))
        .when(text.rlike(bare), strip(F.regexp_replace(strip(F.regexp_extract(text, bare, 1)), r"\A`+|`+\z", "")))
        .otherwise(strip(text))
    )


def touched_files(diff: Column) -> Column:
    """Files that a diff touches, in order."""
    headers = F.regexp_extract_all(diff, F.lit(r"(?m)^diff --git a/(\S+) b/"), F.lit(1))
    plain = F.regexp_extract_all(diff, F.lit(r"(?m)^--- a/(\S+)"), F.lit(1))
    return F.array_distinct(F.when(F.size(headers) > 0, headers).otherwise(plain))


def chat_url(base: Column) -> Column:
    """Where chat requests go: a base that names the endpoint as it is, one with a version in its path
    with the endpoint, any other with version 1 before it (R32)."""
    own = F.regexp_replace(base, r"/+\z", "")
    path = F.regexp_extract(own, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    versioned = F.when(path.rlike(r"/v[0-9]"), F.lit(CHAT_PATH)).otherwise(F.lit("/v1" + CHAT_PATH))
    return F.when(own.endswith(CHAT_PATH), own).otherwise(F.concat(own, versioned))


def responses_url(authorization: Column, base: Column, subscription: str = SUBSCRIPTION_URL) -> Column:
    """Where a request for a response goes: with a token that is no key to the subscription's endpoint."""
    token = F.when(authorization.startswith("Bearer "), F.substring(authorization, 8, F.length(authorization))).otherwise("")
    return F.when((token != "") & ~token.startswith("sk-"), F.lit(subscription)).otherwise(F.concat(base, F.lit("/v1/responses")))


def is_result(kind: Column) -> Column:
    return kind.isin(*RESULT_KINDS)
