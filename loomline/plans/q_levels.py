"""Levels, samples and budgets over the event log, conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import budget
from loomline.functions import text as X
from loomline.operators import levels, reports, segments
from loomline.plans.registry import Tables, query

# The event log as an action log.
ACTIONS = {"view": "file_read", "click": "bash_command", "error": "log_output", "purchase": "file_operation", "signup": "tool_result"}

SQL_ACTIONS = """
a AS (
  SELECT user_id, event_id, props, value, (row_number() OVER w - 1)::INT AS pos, (count(*) OVER (PARTITION BY user_id))::INT AS n,
    CASE event_type WHEN 'view' THEN 'file_read' WHEN 'click' THEN 'bash_command' WHEN 'error' THEN 'log_output' WHEN 'purchase' THEN 'file_operation' WHEN 'signup' THEN 'tool_result' ELSE 'tool_result' END AS kind
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), p AS (
  SELECT *, pos / greatest(1, n - 1) AS rel, n - 1 - pos AS from_end, pos = n - 1 AS is_last FROM a
), acc AS (
  SELECT user_id, pos, row_number() OVER (PARTITION BY user_id, props ORDER BY pos DESC) > 1 AS st FROM p WHERE kind = 'file_operation'
), s0 AS (
  SELECT p.*, coalesce(acc.st, false) AS own FROM p LEFT JOIN acc USING (user_id, pos)
), s AS (
  SELECT *, own OR (kind = 'tool_result' AND coalesce(lag(own) OVER (PARTITION BY user_id ORDER BY pos), false)) AS is_stale FROM s0
), l AS (
  SELECT *, CASE
    WHEN is_last THEN 'L0:is_current_turn'
    WHEN (rel > 0.85 OR from_end <= 1) AND kind IN ('tool_result', 'log_output', 'file_read') THEN 'L0:very_recent_tool_result'
    WHEN is_stale THEN 'L3:stale_file_read'
    WHEN rel < 0.25 AND from_end > 8 AND kind NOT IN ('file_operation', 'bash_command') THEN 'L3:ancient'
    WHEN (rel > 0.7 OR from_end <= 4) AND kind IN ('tool_result', 'log_output', 'file_read') THEN 'L1:recent_' || kind
    WHEN kind IN ('file_operation', 'bash_command', 'tool_call') THEN 'L1:action_' || kind
    WHEN kind = 'file_read' THEN 'L2:mid_file_read'
    WHEN kind IN ('tool_result', 'log_output') AND rel < 0.4 THEN 'L3:old_' || kind
    WHEN kind IN ('tool_result', 'log_output') THEN 'L2:mid_' || kind
    ELSE 'L2:default_' || kind END AS told
  FROM s
)
"""


def actions(t: Tables) -> DataFrame:
    """Events as the labelled action log of each user."""
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in ACTIONS.items()), F.lit("tool_result"))
    rows = levels.with_position(t("events").select("user_id", "event_id", "ts", "value", "props", kind.alias("kind")), ["user_id"], ["ts", "event_id"])
    return levels.label_rows(levels.with_staleness(rows, ["user_id"], F.array("props")), ["user_id"])


@query(
    "flagship_levels",
    f"""WITH {SQL_ACTIONS}
SELECT substr(told, 1, 2) AS level, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(*) FILTER (is_stale) AS n_stale,
  round(avg(rel), 6) AS avg_position, sum(floor(value * 100)::BIGINT * CASE substr(told, 1, 2) WHEN 'L0' THEN 50 WHEN 'L1' THEN 35 WHEN 'L2' THEN 25 ELSE 20 END)::BIGINT AS kept_value_e4
FROM l GROUP BY 1""",
)
def flagship(t: Tables) -> DataFrame:
    """How each actor's history is distributed over retention levels, and how much would be kept."""
    # In whole numbers (hundredths of a value times per cent), so that no order of summation matters.
    ceiling = F.coalesce(*(F.when(F.col("level") == k, round(100 * v)) for k, v in budget.LEVEL_CEILING.items()))
    return actions(t).groupBy("level").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_if("is_stale").alias("n_stale"),
        F.round(F.avg("relative_pos"), 6).alias("avg_position"),
        F.sum(F.floor(F.col("value") * 100) * ceiling).alias("kept_value_e4"),
    )


@query(
    "level_reasons",
    f"""WITH {SQL_ACTIONS}
SELECT substr(told, 1, 2) AS level, substr(told, 4) AS reason, count(*) AS n FROM l GROUP BY ALL""",
)
def level_reasons(t: Tables) -> DataFrame:
    """Rows by level and the rule that gave it."""
    reason = F.when(F.col("level_reason").startswith("ancient"), "ancient").otherwise(F.col("level_reason"))
    return actions(t).groupBy("level", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("stale_rows", f"WITH {SQL_ACTIONS} SELECT user_id, event_id, pos, kind FROM l WHERE is_stale")
def stale_rows(t: Tables) -> DataFrame:
    """Superseded accesses and the results that follow them."""
    return actions(t).filter("is_stale").select("user_id", "event_id", "pos", "kind")


@query(
    "recency_classes",
    f"""WITH {SQL_ACTIONS}
SELECT kind, count(*) FILTER (rel > 0.85 OR from_end <= 1) AS very_recent, count(*) FILTER (rel > 0.7 OR from_end <= 4) AS recent, count(*) FILTER (rel < 0.25 AND from_end > 8) AS ancient
FROM p GROUP BY kind""",
)
def recency_classes(t: Tables) -> DataFrame:
    """Rows of each recency class by kind."""
    r = levels.recency(F.col("relative_pos"), F.col("from_end"))
    return actions(t).groupBy("kind").agg(*(F.count_if(c).alias(name) for name, c in r.items()))


def trajectories(t: Tables) -> DataFrame:
    """Conversations as trajectories without tool calls."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    calls = F.lit(None).cast("array<struct<function: struct<name: string, arguments: string>>>")
    return rows.select(
        F.col("conv_id").cast("string").alias("trajectory_id"),
        F.lit("demo").alias("repo"),
        (F.col("conv_id") % 2).cast("int").alias("resolved"),
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), calls.alias("tool_calls"))).alias("trajectory"),
    )


SQL_SAMPLES = """
m AS (
  SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS i, role, text FROM conversations
), d AS (
  SELECT conv_id, i, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INT AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM m WHERE role = 'assistant'
), q AS (
  SELECT conv_id, i AS decision_idx, CASE WHEN n <= 8 THEN k ELSE j END AS turn_idx
  FROM d LEFT JOIN range(8) r(j) ON n > 8 AND k = floor(j * (n / 8.0))::INT WHERE n <= 8 OR j IS NOT NULL
), s AS (
  SELECT q.*, m.i, m.role, m.text, length(m.text) // 4 AS tokens FROM q JOIN m ON q.conv_id = m.conv_id AND m.i < q.decision_idx WHERE decision_idx >= 3
)
"""


@query(
    "trajectory_samples",
    f"""WITH {SQL_SAMPLES}
SELECT conv_id || '_t' || turn_idx AS sample_id, turn_idx::INT AS turn_idx, decision_idx, conv_id % 2 = 1 AS resolved, count(*)::INT AS n_segments, sum(tokens)::INT AS total_input_tokens,
  string_agg(CASE WHEN role = 'system' THEN 'system_prompt' WHEN role = 'user' AND i = 0 THEN 'user_turn_current' WHEN role = 'user' THEN 'user_turn_history' ELSE 'assistant_thinking' END, ',' ORDER BY i) AS kinds
FROM s GROUP BY conv_id, turn_idx, decision_idx""",
)
def trajectory_samples(t: Tables) -> DataFrame:
    """Decisions of each conversation with their histories (PF14, W5, W6, R1, R9, A3)."""
    rows = segments.samples(trajectories(t))
    return rows.select(
        "sample_id", "turn_idx", "decision_idx", "resolved", F.size("input_segments").alias("n_segments"), "total_input_tokens",
        F.array_join(F.transform("input_segments", lambda s: s["kind"]), ",").alias("kinds"),
    )


@query(
    "sample_levels",
    f"""WITH {SQL_SAMPLES}, n AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn_idx) AS c FROM s)
SELECT CASE WHEN role IN ('system', 'user') OR i = c - 1 THEN 'L0' WHEN i / greatest(1, c - 1) < 0.25 AND c - 1 - i > 8 THEN 'L3' ELSE 'L2' END AS level, count(*) AS n
FROM n GROUP BY 1""",
)
def sample_levels(t: Tables) -> DataFrame:
    """Levels of all segments of samples, assigned inside the rows without a shuffle (W3, PF15)."""
    rows = segments.labelled(segments.samples(trajectories(t)))
    return rows.select(F.explode("token_labels.level").alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "quality_filter",
    f"""WITH {SQL_SAMPLES}, g AS (SELECT conv_id, turn_idx, count(*) AS n, sum(tokens) AS t FROM s GROUP BY ALL)
SELECT CASE WHEN t < 200 THEN 'too_few_tokens' WHEN n < 3 THEN 'too_few_segments' WHEN n > 150 THEN 'too_many_segments' WHEN n < 5 THEN 'too_few_must_keep' ELSE 'ok' END AS reject_reason, count(*) AS n
FROM g GROUP BY 1""",
)
def quality_filter(t: Tables) -> DataFrame:
    """Samples by the first quality rule that they break; segments stand in for spans (PF3)."""
    n = F.size("input_segments")
    reason = budget.reject_reason(F.col("total_input_tokens"), n, n)
    return segments.samples(trajectories(t)).groupBy(reason.alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "document_budgets",
    """WITH d AS (SELECT doc_id, length(text) // 4 * 4 AS tokens, (length(text) // 40)::INT AS must FROM documents), r AS (
  SELECT *, CASE WHEN tokens < 5000 THEN 'short' WHEN tokens < 12000 THEN 'medium' WHEN tokens < 22000 THEN 'long' ELSE 'xlong' END AS bucket,
    (CASE WHEN tokens < 5000 THEN 0.50 WHEN tokens < 12000 THEN 0.35 WHEN tokens < 22000 THEN 0.25 ELSE 0.20 END)::DOUBLE AS ratio FROM d)
SELECT doc_id, bucket, least(greatest(trunc(tokens * ratio), 800, trunc(must * 1.5)), trunc(tokens * 0.95::DOUBLE))::INT AS budget FROM r""",
)
def document_budgets(t: Tables) -> DataFrame:
    """Length bucket and compression budget of each document, characters as tokens."""
    tokens, must = (F.floor(F.length("text") / 4) * 4).cast("int"), F.floor(F.length("text") / 40).cast("int")
    return t("documents").select("doc_id", budget.length_bucket(tokens).alias("bucket"), budget.compression_budget(tokens, must).alias("budget"))


SQL_SOURCES = """
d AS (SELECT source, doc_id, (length(text) // 4)::INT AS tokens FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, sum(tokens) OVER (PARTITION BY source) AS total FROM d),
b AS (SELECT *, i >= greatest(2, n * 30 // 100) AND i < n - greatest(2, n * 50 // 100) AS mid FROM a),
c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, mid ORDER BY tokens DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
e AS (SELECT source, doc_id, tokens FROM c WHERE NOT (mid AND total - before > 20000)),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, sum(tokens) OVER (PARTITION BY source) AS total FROM e),
g AS (SELECT *, coalesce(sum(tokens) OVER w2, 0) AS before, row_number() OVER w1 AS rank FROM f
  WINDOW w1 AS (PARTITION BY source, i >= 2 ORDER BY tokens DESC, i), w2 AS (PARTITION BY source, i >= 2 ORDER BY tokens DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@query(
    "truncate_to_budget",
    f"WITH {SQL_SOURCES} SELECT source, doc_id, tokens FROM g WHERE NOT (i >= 2 AND total - before > 20000 AND rank <= n - 4)",
)
def truncate_to_budget(t: Tables) -> DataFrame:
    """Documents of each source that a budget of 20000 tokens keeps."""
    rows = t("documents").select("source", "doc_id", X.tokens_floor(F.col("text")).alias("tokens"))
    return segments.within_budget(rows, ["source"], 20_000, "doc_id")


@query("split_long_documents")
def split_long_documents(t: Tables) -> DataFrame:
    """Documents split at lines into chunks of 250 tokens; a longer line stands alone."""
    rows = t("documents").select(F.col("doc_id").cast("string").alias("seg_id"), F.col("text").alias("content"), X.tokens_floor(F.col("text")).alias("tokens"))
    return segments.split_long(rows, 250).select("seg_id", "chunk", "tokens", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    "compressible_samples",
    f"""WITH {SQL_SAMPLES}
SELECT conv_id || '_t' || turn_idx AS sample_id, max(tokens)::INT AS longest FROM s
GROUP BY conv_id, turn_idx HAVING bool_or(role = 'assistant' AND tokens >= 100)""",
)
def compressible_samples(t: Tables) -> DataFrame:
    """Samples with a long segment that is not protected (PF2)."""
    rows = segments.samples(trajectories(t)).filter(segments.is_compressible(F.col("input_segments"), 100))
    return rows.select("sample_id", F.array_max(F.transform("input_segments", lambda s: s["tokens"])).alias("longest"))


@query(
    "level_percentiles",
    f"""WITH {SQL_ACTIONS}, v AS (SELECT kind, list_sort(list(value)) AS s, count(value) AS n FROM l GROUP BY kind)
SELECT kind, n, s[n // 4 + 1] AS p25, s[n // 2 + 1] AS p50, s[3 * n // 4 + 1] AS p75, s[floor(n * 0.95)::BIGINT + 1] AS p95 FROM v""",
)
def level_percentiles(t: Tables) -> DataFrame:
    """Index percentiles of values by kind (A5)."""
    return reports.percentiles(actions(t), ["kind"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})


@query(
    "turns_by_user_messages",
    """WITH m AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations), b AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn_no DESC) AS back FROM m), c AS (
  SELECT *, max(back) OVER (PARTITION BY conv_id) AS turns, sum(ceil(length(coalesce(text, '')) / 4)) OVER (PARTITION BY conv_id) AS tokens FROM b)
SELECT conv_id, turn, turn_no::BIGINT AS turn_no, turns > 2 AND tokens > 400 AND back > 2 AS folded FROM c""",
)
def turns_by_user(t: Tables) -> DataFrame:
    """Turns that start with the user's messages, and which of them history folding takes."""
    from loomline.operators import requests

    rows = requests.fold_history(t("conversations"), ["conv_id"], "turn", keep=2, window=500, share=0.8)
    return rows.select("conv_id", "turn", "turn_no", "folded")


@query(
    "conversation_facts",
    """WITH m AS (SELECT *, trim(text) <> '' AS filled FROM conversations)
SELECT conv_id, coalesce(substr(md5(arg_min(text, turn) FILTER (filled AND role = 'user')), 1, 16), 'default') AS conversation_key, arg_min(text, turn) FILTER (filled AND role = 'user') AS task,
  arg_max(text, turn) FILTER (filled AND role = 'user') AS latest_user, arg_max(text, turn) FILTER (filled AND role = 'assistant') AS latest_assistant
FROM m GROUP BY conv_id""",
)
def conversation_facts(t: Tables) -> DataFrame:
    """Key, task and latest texts of each conversation."""
    from loomline.operators import requests

    return requests.conversation_facts(t("conversations"), ["conv_id"], "turn")


@query(
    "last_rows",
    """WITH w AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_id, event_type FROM w WHERE k = 1""",
)
def last_rows(t: Tables) -> DataFrame:
    """The last event of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t("events").withColumn("k", F.row_number().over(w)).filter("k = 1").select("user_id", "event_id", "event_type")
