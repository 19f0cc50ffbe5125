"""Text rules, references, selections and lazy segments over variants of the documents, each against SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import compress, requests, tools, validate
from loomline.plans.q_text import _stream
from loomline.plans.registry import Tables, query
from loomline.streaming import state


def _variant(*texts: str) -> str:
    """SQL that both engines read: the text of a document in one of several shapes, by its id."""
    return "CASE " + " ".join(f"WHEN doc_id % {len(texts)} = {k} THEN {x}" for k, x in enumerate(texts)) + " END"


NL = "chr(10)"
_WRAPPED = _variant(
    f"concat('<think>why', {NL}, 'so</think>', {NL}, ' [SEG id=s1 kind=k level=L1]', {NL}, text, {NL}, '[/SEG] rest')",
    "concat('thought</think>  ', text, '  ')",
    "concat('[SEG id=s1 kind=k level=L1] ', text)",
    "concat(text, '[/SEG]')",
    "concat('a</think>b<think>c</think> ', text)",
)


@query(
    "unwrapped_outputs",
    rf"""WITH v AS (SELECT doc_id, {_WRAPPED} AS t FROM documents), r AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(t, '^.*?</think>', '', 's'), '<think>.*?</think>\s*', '', 'gs'), E' \t\n\r\f\v') AS t FROM v)
SELECT doc_id, trim(CASE WHEN regexp_matches(t, '\[SEG\b[^\]]*\]\s*(.*?)\s*\[/SEG\]', 's') THEN regexp_extract(t, '\[SEG\b[^\]]*\]\s*(.*?)\s*\[/SEG\]', 1, 's')
  ELSE regexp_replace(t, '\[SEG\b[^\]]*\]|\[/SEG\]', '', 'g') END, E' \t\n\r\f\v') AS body FROM r""",
)
def unwrapped_outputs(t: Tables) -> DataFrame:
    """Outputs without thoughts and segment marks."""
    return t("documents").select("doc_id", X.unwrap(F.expr(_WRAPPED)).alias("body"))


_ENDED = _variant(
    "concat('[SEG id=a kind=k level=L1]', text, '[/SEG] ')", "concat('[SEG id=a kind=k level=L1]', text)", "concat(text, '.')", "concat(substring(text, 1, 40), ' and')", "concat('```', text, '```')", "'  '",
    "concat('[SEG id=a]', substring(text, 1, 40))",
)


@query(
    "truncated_outputs",
    rf"""WITH v AS (SELECT doc_id, {_ENDED} AS t FROM documents), c AS (
  SELECT *, rtrim(t, E' \t\n\r\f\v') AS s, len(regexp_extract_all(t, '\[SEG\s+id=[^\s\]]+\s+kind=[^\s\]]+\s+level=[^\s\]]+\]')) AS o, len(regexp_extract_all(t, '\[/SEG\]')) AS c FROM v)
SELECT doc_id, CASE WHEN s = '' THEN true WHEN o > c THEN true WHEN ends_with(s, '[/SEG]') OR ends_with(s, '```') THEN false ELSE NOT (o = 0 AND length(t) < 200) END AS truncated FROM c""",
)
def truncated_outputs(t: Tables) -> DataFrame:
    """Whether an output was cut off."""
    return t("documents").select("doc_id", X.looks_truncated(F.expr(_ENDED)).alias("truncated"))


_FRAMED = _variant(
    f"concat('Exit code: 0', {NL}, 'Wall time: 1', {NL}, {NL}, 'Output:', {NL}, text)", f"concat('Output was lost', {NL}, text)", f"concat({NL}, '  ', {NL}, 'Total output lines: 3', {NL}, text)", "text", "'Exit code: 0'",
    f"concat(chr(13), {NL}, 'a', chr(13), 'b', chr(13), {NL}, text)",
)
_FRAME = r"^((?:[^\S\n]*\n|[^\S\n]+$|(?:Exit code:|Wall time:|Total output lines:|Output:)[^\n]*(?:\n|$))*)"


@query(
    "command_frames",
    rf"""WITH v AS (SELECT doc_id, regexp_replace({_FRAMED}, '\r\n?', chr(10), 'g') AS t FROM documents), h AS (SELECT *, regexp_extract(t, '{_FRAME}', 1) AS h FROM v)
SELECT doc_id, CASE WHEN regexp_matches(h, '(^|\n)(Exit code:|Wall time:|Total output lines:|Output:)') THEN h ELSE '' END AS header,
  CASE WHEN regexp_matches(h, '(^|\n)(Exit code:|Wall time:|Total output lines:|Output:)') THEN substr(t, length(h) + 1) ELSE t END AS body FROM h""",
)
def command_frames(t: Tables) -> DataFrame:
    """Reports on a command apart from its output, line ends as line feeds."""
    return t("documents").select("doc_id", X.command_frame(X.unix_lines(F.expr(_FRAMED))).alias("f")).select("doc_id", "f.*")


_CODE = _variant(
    f"concat('import a', {NL}, 'def f():', {NL}, '    return 1', {NL}, text)", f"concat('for a in b', {NL}, 'while waiting', {NL}, 'if x', {NL}, 'return code')", f"concat('1', chr(9), 'import a', {NL}, ' 2→def f', {NL}, '3', chr(9), 'x', {NL}, '4', chr(9), 'y')",
    f"concat(chr(9), ' 12', chr(9), 'class x', {NL}, '     3', chr(9), 'import y', {NL}, '7', chr(9), 'z')", "text",
)


@query(
    "line_numbers",
    rf"""WITH v AS (SELECT doc_id, {_CODE} AS t FROM documents), l AS (SELECT *, string_split(regexp_replace(t, '\n$', ''), chr(10)) AS l FROM v), n AS (
  SELECT *, list_sum(list_transform(['def ', 'class ', 'import ', 'return ', 'self.'], lambda w: (length(t) - length(replace(t, w, ''))) // length(w))) AS k, len(list_filter(l[1:20], lambda x: regexp_matches(x, '^\s*\d+[\t→]'))) AS c FROM l)
SELECT doc_id, CASE WHEN len(l) >= 4 AND k >= 2 AND c < len(l[1:20]) * 0.6 THEN array_to_string(list_transform(l, lambda x, i: concat(i, chr(9), x, chr(10))), '') ELSE t END AS numbered,
  regexp_replace(t, '(?m)^[ \t]+(\d+\t)', '\1', 'g') AS bare, trim(regexp_replace(t, '(?m)^\s*\d+\t', '', 'g'), E' \t\n\r\f\v') AS matchable FROM n""",
)
def line_numbers(t: Tables) -> DataFrame:
    """Code numbered, numbers without padding, text as it is matched."""
    text = F.expr(_CODE)
    return t("documents").select("doc_id", X.with_line_numbers(text).alias("numbered"), X.without_padding(text).alias("bare"), X.matchable(text).alias("matchable"))


_ANSWER = _variant(
    f"concat('so', {NL}, '```DIFF', {NL}, '--- a/x.py', {NL}, '+++ b/x.py', {NL}, '```')", f"concat('```', {NL}, 'no', {NL}, '```', {NL}, '```text', {NL}, '  diff --git a/p.py b/p.py', {NL}, '```')",
    f"concat('see', {NL}, 'diff --git a/p.py b/p.py', {NL}, '--- a/p.py', {NL}, '+++ b/p.py', {NL}, '``` ')", "concat('  ', text, ' ')", f"concat('--- a/q.py', {NL}, '+++ b/q.py')",
)
_ANY, _TAG, _BARE = r"```[a-zA-Z]*\s*\n(.*?)```", r"```(?:diff|patch)\s*\n(.*?)```", r"(?:^|\n)((?:diff --git [^\n]|--- [^\n]+\n\+\+\+ [^\n]).*)"


@query(
    "extracted_patches",
    rf"""WITH v AS (SELECT doc_id, {_ANSWER} AS t FROM documents), b AS (SELECT *, list_filter(regexp_extract_all(t, '{_ANY}', 1, 's'), lambda x: contains(x, '--- a/') OR regexp_matches(x, '^\s*(---|diff --git)')) AS b FROM v), p AS (
  SELECT doc_id, trim(CASE WHEN regexp_matches(t, '{_TAG}', 'si') THEN regexp_extract(t, '{_TAG}', 1, 'si') WHEN len(b) > 0 THEN b[1]
    WHEN regexp_matches(t, '{_BARE}', 's') THEN trim(trim(regexp_extract(t, '{_BARE}', 1, 's'), E' \t\n\r\f\v'), '`') ELSE t END, E' \t\n\r\f\v') AS patch FROM b)
SELECT doc_id, patch, array_to_string(list_distinct(CASE WHEN regexp_matches(patch, '(?m)^diff --git a/(\S+) b/') THEN regexp_extract_all(patch, '(?m)^diff --git a/(\S+) b/', 1) ELSE regexp_extract_all(patch, '(?m)^--- a/(\S+)', 1) END), ',') AS files FROM p""",
)
def extracted_patches(t: Tables) -> DataFrame:
    """The diff in an answer and the files it touches."""
    patch = X.patch_of(F.expr(_ANSWER))
    return t("documents").select("doc_id", patch.alias("patch")).withColumn("files", F.array_join(X.touched_files(F.col("patch")), ","))


@query(
    "small_text_rules",
    rf"""SELECT doc_id, nullif(trim(regexp_replace(concat('<system-reminder>', source, chr(10), 'x</system-reminder> ', CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END), '<system-reminder>.*?</system-reminder>', '', 'gs'), E' \t\n\r\f\v'), '') AS reminded,
  concat(substr(trim(text, E' \t\n\r\f\v'), 1, 900), chr(10), '(overall task: ', substr(source, 1, 200), ')') AS intent, trim(replace(replace(concat(source, ']', chr(10), lang), ']', '_'), chr(10), ' '), E' \t\n\r\f\v') AS source_name,
  CASE WHEN doc_id % 3 = 0 THEN 'L3' WHEN doc_id % 3 = 1 THEN 'L1' ELSE 'L0' END AS level, CASE WHEN doc_id % 4 = 0 THEN 'dropped' WHEN doc_id % 4 = 1 THEN 'docstring' WHEN doc_id % 4 = 2 THEN 'bash_grep' ELSE 'code_kept' END AS category,
  doc_id % 2 = 0 AS found, CASE WHEN doc_id % 2 = 0 THEN source END AS body, doc_id % 2 = 0 AS code, doc_id % 2 = 1 AS lacking FROM documents""",
)
def small_text_rules(t: Tables) -> DataFrame:
    """Reminders, intents, source names, levels of ratios, label categories, bodies of segments, hints."""
    even = F.col("doc_id") % 2 == 0
    ratio = F.expr(_variant("'20%'", "'0.35'", "'50%'"))
    label = F.expr(_variant("'was DROPPED'", "'docstring lost'", "'Grep output'", "'kept'"))
    block = F.concat(F.lit("[SEG id=a.c kind=k level=L1]\n"), F.col("source"), F.lit("\n[/SEG]"))
    body = X.body_of(F.when(even, block).otherwise(F.replace(block, F.lit("a.c"), F.lit("abc"))), "a.c")
    return t("documents").select(
        "doc_id",
        X.without_reminders(F.concat(F.lit("<system-reminder>"), "source", F.lit("\nx</system-reminder> "), F.when(even, F.col("text")).otherwise(""))).alias("reminded"),
        X.intent_text(F.col("text"), F.col("source")).alias("intent"),
        X.sanitized_source(F.concat("source", F.lit("]\n"), "lang")).alias("source_name"),
        X.ratio_level(ratio).alias("level"),
        X.label_category(label).alias("category"),
        body["found"].alias("found"),
        body["body"].alias("body"),
        X.wants_code(F.when(even, F.lit("please refactor it")).otherwise("hello")).alias("code"),
        X.lacks_tool(F.when(even, F.lit("done")).otherwise("I don't have a calendar tool")).alias("lacking"),
    )


_CALL = _variant(
    "concat('{\"shadow_id\": \"', substr(sha256_text, 1, 16), '\"}')", "concat('{\"id\": \" ', substr(sha256_text, 1, 16), ' src=a.py\"}')", "concat('{\"shadow_id\": \"[REF:', substr(sha256_text, 1, 16), ' src=/w/a.py]\"}')",
    "concat('{\"shadow_id\": \"\", \"id\": \"[REF:', substr(sha256_text, 1, 16), ']\"}')", "'{}'",
)


@query(
    "resolved_references",
    r"""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '' ELSE substr(sha256(text), 1, 16) END AS reference,
  CASE WHEN doc_id % 5 <> 4 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 <> 0) THEN text
    ELSE concat('[Reference ''', CASE WHEN doc_id % 5 = 4 THEN '' ELSE substr(sha256(text), 1, 16) END, ''' can no longer be expanded (it may have aged out of the shadow store). Its summary is still in your context above — carry on using that.]') END AS content
FROM documents""",
)
def resolved_references(t: Tables) -> DataFrame:
    """Calls for an original, in all shapes of a reference, against a store that lacks a third."""
    docs = t("documents").select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha256_text"))
    calls = docs.select("doc_id", F.expr(_CALL).alias("tool_input"))
    store = docs.filter("doc_id % 3 <> 0").groupBy(X.content_id(F.col("text")).alias("content_id")).agg(F.min("text").alias("original"))
    return compress.resolved(calls, store).select("doc_id", "reference", "content")


_OFFERED = """SELECT user_id, CASE event_type WHEN 'click' THEN 'Bash' WHEN 'view' THEN 'Read' WHEN 'error' THEN 'mcp__e' ELSE event_type END || CASE WHEN event_id % 3 = 0 AND event_type NOT IN ('click', 'view') THEN '2' ELSE '' END AS name, max(value) AS score FROM events GROUP BY ALL"""


@query(
    "selected_tools",
    f"""WITH o AS ({_OFFERED}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, name) - 1 AS rank FROM o), w AS (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS n, max(score) OVER (PARTITION BY user_id) AS best, user_id % 2 = 0 AND name IN ('Read', 'Bash') AS listed FROM r), p AS (
  SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY listed DESC, CASE WHEN listed THEN CASE name WHEN 'Read' THEN 1 ELSE 4 END ELSE rank END) - 1)::INT AS place FROM w)
SELECT user_id, name, place, n <= 3 OR ((listed OR score >= 0.9 * best OR place < 3) AND place < 5) AS kept FROM p""",
)
def selected_tools(t: Tables) -> DataFrame:
    """Whitelisted tools, then those near the best, within bounds."""
    t("events").createOrReplaceTempView("events")
    offered = t.spark.sql(_OFFERED)
    ranked = tools.top_k(offered, ["user_id"], 5, pos="name").drop("kept")
    return tools.selected(ranked, ["user_id"], F.col("user_id") % 2 == 0, least=3, most=5).select("user_id", "name", "place", "kept")


@query(
    "core_tools",
    """WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'apply_patch' ELSE event_type END AS name, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, CASE WHEN n < 5 OR k <= 2 OR name = 'apply_patch' THEN 'keep' ELSE 'drop' END AS fate FROM r""",
)
def core_tools(t: Tables) -> DataFrame:
    """No selection takes the tools away that an agent acts with."""
    name = F.when(F.col("event_type") == "click", "apply_patch").otherwise(F.col("event_type"))
    ranked = tools.top_k(t("events").select("user_id", "event_id", name.alias("name"), "value", F.lit("").alias("description")), ["user_id"], 2, "value", "event_id")
    return tools.applied(ranked, tools.mcp_signal(ranked.filter("kept"), ["user_id"]), ["user_id"]).select("user_id", "event_id", "fate")


@query(
    "stream_selected_tools",
    """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), f AS (SELECT user_id, min(event_id) AS first FROM e WHERE event_type <> 'view' GROUP BY 1), g AS (
  SELECT user_id, event_type AS chosen FROM events JOIN f USING (user_id) WHERE event_id = first)
SELECT e.user_id, e.event_id, CASE WHEN first IS NULL OR e.event_id < first THEN 'view' WHEN e.event_type = 'view' AND chosen <> 'view' THEN 'view' ELSE chosen END AS selection FROM e LEFT JOIN f USING (user_id) LEFT JOIN g USING (user_id)""",
)
def stream_selected_tools(t: Tables) -> DataFrame:
    """What a request chooses is frozen for its session unless few tools are offered, and while it is still offered (ST4)."""
    events, path = _stream(t, "events")
    few = F.col("event_type") == "view"
    offered = F.when(few, F.array("event_type")).otherwise(F.array(*map(F.lit, ("click", "error", "purchase", "signup"))))
    rows = events.select("user_id", "event_id", offered.alias("offered"), F.array("event_type").alias("chosen"))
    out = state.run_once(state.frozen_selection(rows, "user_id", "event_id", "offered", "chosen", 1), f"{path}/out", f"{path}/cp")
    return out.select("user_id", "event_id", F.get("selection", F.lit(0)).alias("selection"))


def _shortened() -> Column:
    """Documents of which a part of varying size is left, whole lines or none."""
    return F.expr(_variant("substring(text, 1, CAST(length(text) * 0.9 AS INT))", "substring(text, 1, CAST(length(text) * 0.3 AS INT))", "replace(text, ' ', '_')"))


@query(
    "lazy_by_kind",
    f"""WITH v AS (SELECT doc_id, lang AS kind, text, {_variant("substr(text, 1, CAST(floor(length(text) * 0.9) AS INT))", "substr(text, 1, CAST(floor(length(text) * 0.3) AS INT))", "replace(text, ' ', '_')")} AS o FROM documents), l AS (
  SELECT doc_id, unnest(string_split(o, chr(10))) AS x, generate_subscripts(string_split(o, chr(10)), 1) AS i, text FROM v), f AS (
  SELECT *, length(x) > 5 AND contains(text, x) AS hit FROM l), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, hit ORDER BY i) AS island FROM f), r AS (
  SELECT doc_id, max(s) AS run FROM (SELECT doc_id, sum(CASE WHEN hit THEN length(x) + 1 ELSE 0 END) AS s FROM g GROUP BY doc_id, hit, island) GROUP BY 1), s AS (
  SELECT kind, length(o) / greatest(1, length(text)) AS ratio, run / greatest(1, length(o)) AS share, length(text) > 500 AND length(o) > 200 AS large FROM v JOIN r USING (doc_id))
SELECT kind, count(*) AS n_segments, round(avg(ratio), 4) AS ratio, round(avg(share), 4) AS verbatim_share, count(*) FILTER (WHERE large AND ratio > 0.5 AND share > 0.5) AS n_lazy,
  round(100 * count(*) FILTER (WHERE large AND ratio > 0.5 AND share > 0.5) / count(*), 2) AS lazy_percent FROM s GROUP BY kind""",
)
def lazy_by_kind(t: Tables) -> DataFrame:
    """Copied segments by the strict rule, and the report by kind."""
    both = t("documents").select(F.col("lang").alias("kind"), F.col("text").alias("content"), _shortened().alias("out"))
    return validate.lazy_by_kind(validate.lazy_segments(both))


@query(
    "request_rules",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 AND signed = 0 THEN 'user' ELSE role END AS role, CASE WHEN turn % 3 = 2 AND signed = 0 THEN 'text' WHEN turn % 3 = 2 THEN 'tool_result' WHEN turn % 3 = 1 THEN 'tool_use' ELSE 'text' END AS block_type,
  CASE WHEN turn % 3 = 2 AND signed = 0 THEN '[Tool result — f]' || chr(10) || coalesce(text, '') ELSE text END AS text
FROM (SELECT *, conv_id % 2 AS signed FROM (SELECT conv_id, turn, role, text FROM conversations WHERE turn <= 5 AND conv_id IS NOT NULL)
  QUALIFY count(*) OVER (PARTITION BY conv_id, turn) = 1 AND max(turn) OVER (PARTITION BY conv_id) % 3 = 2 AND count(*) OVER (PARTITION BY conv_id) = max(turn) OVER (PARTITION BY conv_id) + 1) WHERE NOT (turn % 3 = 1 AND signed = 0)""",
)
def request_rules(t: Tables) -> DataFrame:
    """Unsigned calls go and their results are titled texts (E14); turns 1, 2 of three stand for a call and its result."""
    rows = t("conversations").filter("turn <= 5 and conv_id is not null")
    rows.createOrReplaceTempView("early_turns")
    whole = t.spark.sql("""SELECT conv_id, turn, role, text FROM (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS c, max(turn) OVER (PARTITION BY conv_id) AS m, count(*) OVER (PARTITION BY conv_id) AS n FROM early_turns) WHERE c = 1 AND m % 3 = 2 AND n = m + 1""")
    kind = F.when(F.col("turn") % 3 == 1, "tool_use").when(F.col("turn") % 3 == 2, "tool_result").otherwise("text")
    use = F.when(kind != "text", F.concat(F.lit("u"), F.floor(F.col("turn") / 3).cast("string")))
    blocks = whole.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("msg_idx"), F.lit(0).alias("block_idx"), "role", kind.alias("block_type"), "text", use.alias("tool_use_id"), F.lit("f").alias("tool_name"))
    out = requests.folded_unsigned(blocks, F.col("request_id") % 2 == 1)
    return out.select(F.col("request_id").alias("conv_id"), F.col("msg_idx").alias("turn"), "role", "block_type", "text")


@query(
    "dates_and_maps",
    """SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, floor(epoch(ts))::BIGINT - epoch(TIMESTAMP '2024-01-01')::BIGINT AS age, strftime(ts, '%Y%m%d_%H%M%S') AS stamp,
  CASE WHEN event_type = 'click' THEN 'late' ELSE 'early' END AS merged, event_type AS other, array_to_string(list_reverse(string_split(event_type, 'e')), 'e') AS reversed FROM events""",
)
def dates_and_maps(t: Tables) -> DataFrame:
    """Epoch arithmetic, formatted times, merged maps of which the later wins, reversed lists."""
    ts = F.to_timestamp("ts")
    base = F.create_map(F.lit("k"), F.lit("early"), F.lit("o"), F.col("event_type"))
    late = F.when(F.col("event_type") == "click", F.create_map(F.lit("k"), F.lit("late"))).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(late, k))
    merged = F.map_concat(kept, late)
    return t("events").select(
        "event_id", F.unix_timestamp(ts).alias("seconds"), (F.unix_timestamp(ts) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))).alias("age"), F.date_format(ts, "yyyyMMdd_HHmmss").alias("stamp"),
        merged["k"].alias("merged"), merged["o"].alias("other"), F.array_join(F.reverse(F.split("event_type", "e")), "e").alias("reversed"),
    )
