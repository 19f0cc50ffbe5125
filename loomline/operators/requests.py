"""Conversation requests: flattening of three wire shapes, tool results and their calls, turns, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.schemas import BLOCK

# Fixed values.
RECENT_TURNS, WINDOW_TOKENS, WINDOW_SHARE = 4, 200_000, 0.8
SAMPLES_A_REQUEST = 4
_FIELDS = [f.split() for f in BLOCK.split(", ")]


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _FIELDS))


def _v(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def message_blocks(requests: DataFrame) -> DataFrame:
    """Blocks of ``requests(request_id, body)`` whose messages hold text or block lists (PF17)."""
    body = requests.select("request_id", F.try_parse_json("body").alias("v"))
    messages = body.select("request_id", F.posexplode(_parts(F.col("v"), "$.messages")).alias("msg_idx", "m"))
    rows = messages.select("*", F.posexplode_outer(_parts(F.col("m"), "$.content")).alias("block_idx", "b"))
    m, b = F.col("m"), F.col("b")
    plain = b.isNull()
    return _rows(
        rows,
        request_id=F.col("request_id"),
        msg_idx=F.col("msg_idx"),
        block_idx=F.coalesce("block_idx", F.lit(0)),
        role=_v(m, "$.role"),
        block_type=F.when(plain, "text").otherwise(_v(b, "$.type")),
        tool_use_id=F.coalesce(_v(b, "$.tool_use_id"), _v(b, "$.id")),
        tool_name=_v(b, "$.name"),
        tool_input=F.to_json(F.try_variant_get(b, "$.input", "variant")),
        text=F.when(plain, _v(m, "$.content")).otherwise(F.coalesce(_v(b, "$.text"), _text_parts(b))),
    )


def chat_blocks(requests: DataFrame) -> DataFrame:
    """Blocks of chat-completion requests: a row for each text, tool call and tool message (PF17)."""
    body = requests.select("request_id", F.try_parse_json("body").alias("v"))
    messages = body.select("request_id", F.posexplode(_parts(F.col("v"), "$.messages")).alias("msg_idx", "m"))
    m = F.col("m")
    role = _v(m, "$.role")
    parts = F.transform(_parts(m, "$.content"), lambda p: F.try_variant_get(p, "$.text", "string"))
    text = F.coalesce(F.array_join(parts, "\n"), _v(m, "$.content"))
    none = F.lit(None).cast("string")
    own = F.struct(F.when(role == "tool", "tool_result").otherwise("text").alias("type"), _v(m, "$.tool_call_id").alias("id"), none.alias("name"), none.alias("input"), text.alias("text"))
    calls = F.transform(
        F.coalesce(_parts(m, "$.tool_calls"), F.array().cast("array<variant>")),
        lambda c: F.struct(
            F.lit("tool_use").alias("type"), F.try_variant_get(c, "$.id", "string").alias("id"), F.try_variant_get(c, "$.function.name", "string").alias("name"),
            F.try_variant_get(c, "$.function.arguments", "string").alias("input"), none.alias("text"),
        ),
    )
    rows = messages.select("request_id", "msg_idx", role.alias("role"), F.posexplode(F.concat(F.when(text.isNotNull(), F.array(own)).otherwise(F.slice(F.array(own), 1, 0)), calls)).alias("block_idx", "b"))
    return _rows(rows, request_id=F.col("request_id"), msg_idx=F.col("msg_idx"), block_idx=F.col("block_idx"), role=F.col("role"), block_type=F.col("b.type"), tool_use_id=F.col("b.id"), tool_name=F.col("b.name"), tool_input=F.col("b.input"), text=F.col("b.text"))


def response_blocks(requests: DataFrame) -> DataFrame:
    """Blocks of response items: messages, function and custom calls, their outputs, reasoning (PF17)."""
    body = requests.select("request_id", F.try_parse_json("body").alias("v"))
    rows = body.select("request_id", F.posexplode(_parts(F.col("v"), "$.input")).alias("msg_idx", "m"))
    m = F.col("m")
    kind = F.coalesce(_v(m, "$.type"), F.lit("message"))
    texts = lambda path: F.array_join(F.transform(_parts(m, path), lambda p: F.try_variant_get(p, "$.text", "string")), "\n")
    is_call, is_output = kind.endswith("_call"), kind.endswith("_call_output")
    return _rows(
        rows,
        request_id=F.col("request_id"),
        msg_idx=F.col("msg_idx"),
        block_idx=F.lit(0),
        role=F.coalesce(_v(m, "$.role"), F.when(is_output, "tool").otherwise("assistant")),
        block_type=F.when(is_output, "tool_result").when(is_call, "tool_use").when(kind == "reasoning", "thinking").otherwise("text"),
        tool_use_id=_v(m, "$.call_id"),
        tool_name=_v(m, "$.name"),
        tool_input=F.coalesce(_v(m, "$.arguments"), F.when(is_call, _v(m, "$.input"))),
        text=F.when(is_output, F.coalesce(texts("$.output"), _v(m, "$.output"))).when(kind == "reasoning", texts("$.summary")).otherwise(F.coalesce(texts("$.content"), _v(m, "$.content"))),
    )


def _parts(v: Column, path: str) -> Column:
    """A variant array as an array of variants; null if it is none."""
    return F.try_variant_get(v, path, "array<variant>")


def _text_parts(block: Column) -> Column:
    """The content of a tool result: a string, or the texts of its parts."""
    parts = F.transform(_parts(block, "$.content"), lambda p: F.try_variant_get(p, "$.text", "string"))
    return F.coalesce(F.array_join(parts, "\n"), _v(block, "$.content"))


def with_call_path(blocks: DataFrame) -> DataFrame:
    """Tool results with the file of the call that they answer."""
    calls = blocks.filter("block_type = 'tool_use'").select(
        "request_id", "tool_use_id", F.coalesce(F.get_json_object("tool_input", "$.file_path"), F.get_json_object("tool_input", "$.notebook_path")).alias("source_path"), F.col("tool_name").alias("called")
    )
    results = blocks.filter("block_type = 'tool_result'").drop("tool_name", "tool_input")
    return results.join(calls.dropDuplicates(["request_id", "tool_use_id"]), ["request_id", "tool_use_id"], "left")


def orphans(blocks: DataFrame, by: str = "request_id") -> DataFrame:
    """Tool results without their call, which are demoted to text."""
    calls = blocks.filter("block_type = 'tool_use'").select(by, "tool_use_id")
    return blocks.filter("block_type = 'tool_result'").join(calls, [by, "tool_use_id"], "left_anti")


def demoted(blocks: DataFrame) -> DataFrame:
    """Blocks with orphaned results as text of the user."""
    gone = orphans(blocks).select("request_id", "msg_idx", "block_idx").withColumn("_orphan", F.lit(True))
    rows = blocks.join(gone, ["request_id", "msg_idx", "block_idx"], "left")
    orphan = F.coalesce("_orphan", F.lit(False))
    return rows.withColumns({"block_type": F.when(orphan, "text").otherwise(F.col("block_type")), "tool_use_id": F.when(~orphan, F.col("tool_use_id"))}).drop("_orphan")


def folded_unsigned(blocks: DataFrame, signed: Column) -> DataFrame:
    """Without tool calls that lack a signature; their results are titled texts of the user."""
    unsigned = (F.col("block_type") == "tool_use") & ~signed
    called = blocks.filter(unsigned & F.col("tool_use_id").isNotNull()).groupBy("request_id", "tool_use_id").agg(F.max_by(F.coalesce("tool_name", F.lit("tool")), F.struct("msg_idx", "block_idx")).alias("_called"))
    rows = blocks.filter(~F.coalesce(unsigned, F.lit(False))).join(called, ["request_id", "tool_use_id"], "left")
    fold = F.col("_called").isNotNull() & (F.col("block_type") == "tool_result")
    told = F.concat(F.lit("[Tool result — "), "_called", F.lit("]\n"), F.coalesce("text", F.lit("")))
    folded = {"block_type": F.lit("text"), "role": F.lit("user"), "text": told, "tool_use_id": F.lit(None)}
    return rows.select(*(F.when(fold, folded[c]).otherwise(F.col(c)).alias(c) if c in folded else F.col(c) for c in blocks.columns))


def concealed(blocks: DataFrame, virtual: list[str]) -> DataFrame:
    """Without calls of internal tools; ``stop_reason`` tells whether a call is left."""
    rest = blocks.filter(~((F.col("block_type") == "tool_use") & F.coalesce(F.col("tool_name").isin(*virtual), F.lit(False))))
    calls = F.max((F.col("block_type") == "tool_use").cast("int")).over(Window.partitionBy("request_id"))
    return rest.withColumn("stop_reason", F.when(calls == 1, "tool_use").otherwise("end_turn"))


def with_turn(messages: DataFrame, by: list[str], order: str, role: str = "role") -> DataFrame:
    """``turn_no``: a message of the user starts a turn; what stands before the first is turn 0."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn_no", F.sum((F.col(role) == "user").cast("int")).over(upto))


def fold_history(messages: DataFrame, by: list[str], order: str, text: str = "text", keep: int = RECENT_TURNS, window: int = WINDOW_TOKENS, share: float = WINDOW_SHARE) -> DataFrame:
    """``folded``: whether a message goes into the summary of old turns.

    Only conversations of more than ``keep`` turns and more tokens than their
    share of the window are folded; the last ``keep`` turns stay.
    """
    whole = Window.partitionBy(*by)
    rows = with_turn(messages, by, order)
    rows = rows.withColumn("_back", F.dense_rank().over(whole.orderBy(F.desc("turn_no"))))
    rows = rows.withColumns({"_turns": F.max("_back").over(whole), "_tokens": F.sum(X.tokens_ceil(F.coalesce(F.col(text), F.lit("")))).over(whole)})
    fold = (F.col("_turns") > keep) & (F.col("_tokens") > int(window * share)) & (F.col("_back") > keep)
    return rows.withColumn("folded", fold).drop("_back", "_turns", "_tokens")


def conversation_facts(messages: DataFrame, by: list[str], order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Key of a conversation and its latest user and assistant texts."""
    own = F.when(F.trim(F.col(text)) != "", F.col(text))
    user, assistant = (F.when(F.col(role) == r, own) for r in ("user", "assistant"))
    at_ = lambda c: F.when(c.isNotNull(), F.col(order))
    first = F.min_by(user, at_(user))
    return messages.groupBy(*by).agg(
        F.coalesce(F.substring(F.md5(first.cast("binary")), 1, 16), F.lit("default")).alias("conversation_key"),
        first.alias("task"),
        F.max_by(user, at_(user)).alias("latest_user"),
        F.max_by(assistant, at_(assistant)).alias("latest_assistant"),
    )


def sampled(blocks: DataFrame, by: str, order: str, saving: str, skipped: str, most: int = SAMPLES_A_REQUEST) -> DataFrame:
    """The first few blocks of a request that saved tokens."""
    w = Window.partitionBy(by).orderBy(order)
    return blocks.filter((F.col(saving) > 0) & ~F.col(skipped)).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def request_stats(blocks: DataFrame, by: str = "request_id") -> DataFrame:
    """Sums of a request, and its skipped tokens by reason."""
    taken = F.col("skip_reason").isNull()
    reasons = blocks.filter("skip_reason is not null").groupBy(by, "skip_reason").agg(F.sum("tokens").alias("t"))
    reasons = reasons.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("skip_reason", "t")))).alias("skipped_by_reason"))
    sums = blocks.groupBy(by).agg(
        F.coalesce(F.sum(F.when(taken, F.col("tokens"))), F.lit(0)).alias("original"),
        F.coalesce(F.sum(F.when(taken, F.col("compressed_tokens"))), F.lit(0)).alias("compressed"),
        F.count_if(taken).alias("items"),
        F.coalesce(F.sum(F.when(~taken, F.col("tokens"))), F.lit(0)).alias("skipped"),
        F.count_if(F.coalesce(F.col("cache_hit"), F.lit(False))).alias("cache_hits"),
    )
    return sums.join(reasons, by, "left")
