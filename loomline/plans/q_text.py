"""Joins, validation, text functions, tools, requests, sources, streams and Arrow functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import chunking, edits, lint, spans
from loomline.functions import text as X
from loomline.operators import compress, merge, requests, tools, validate
from loomline.plans import scratch
from loomline.plans.registry import Tables, query
from loomline.schemas import BATCH_RESULT
from loomline.sources import io
from loomline.streaming import state

# --- merges and joins ----------------------------------------------------


@query(
    "upsert_merge",
    """WITH r AS (SELECT doc_id, 'new' AS lang, source || '!' AS source FROM documents WHERE doc_id % 3 = 0)
SELECT d.doc_id, coalesce(r.lang, d.lang) AS lang, coalesce(r.source, d.source) AS source FROM documents d LEFT JOIN r USING (doc_id)""",
)
def upsert_merge(t: Tables) -> DataFrame:
    """Rows replaced whole by key."""
    base = t("documents").select("doc_id", "lang", "source")
    new = base.filter("doc_id % 3 = 0").withColumns({"lang": F.lit("new"), "source": F.concat("source", F.lit("!"))})
    return merge.upsert(base, new, "doc_id")


@query("unmatched_replacements", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def unmatched_replacements(t: Tables) -> DataFrame:
    """Replacements without a base row (J7, anti-join)."""
    return merge.unmatched(t("documents").filter("lang = 'en'"), t("labels"), "doc_id").select("doc_id")


@query(
    "pending_rows",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def pending_rows(t: Tables) -> DataFrame:
    """Rows not done yet, or done with an error, which is retried (PF7, SK6)."""
    done = t("labels").select("doc_id", F.when(F.col("quality") == 0, "failed").alias("error"))
    return merge.pending(t("documents").select("doc_id", "lang"), done, "doc_id", retry_errors=True)


@query(
    "resumed_results",
    """SELECT d.doc_id, CASE WHEN n.doc_id IS NOT NULL THEN 'new' WHEN o.doc_id IS NOT NULL THEN 'old' END AS result, coalesce(n.quality, o.quality) AS quality
FROM documents d LEFT JOIN labels o ON d.doc_id = o.doc_id LEFT JOIN (SELECT * FROM labels WHERE doc_id % 2 = 0) n ON d.doc_id = n.doc_id""",
)
def resumed_results(t: Tables) -> DataFrame:
    """The pool with old and new results, new ones first."""
    old = t("labels").select("doc_id", F.lit("old").alias("result"), "quality")
    return merge.resumed(t("documents").select("doc_id"), old, old.filter("doc_id % 2 = 0").withColumn("result", F.lit("new")), "doc_id", ["result", "quality"])


@query("default_lookup", "SELECT doc_id, coalesce('Q' || quality, 'L2') AS level FROM documents LEFT JOIN labels USING (doc_id)")
def default_lookup(t: Tables) -> DataFrame:
    """A label by key with a default."""
    table = t("labels").select("doc_id", F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("level"))
    return merge.looked_up(t("documents").select("doc_id"), table, ["doc_id"], "level", "L2")


@query("needed_rows", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def needed_rows(t: Tables) -> DataFrame:
    """Rows whose key is needed (J2, SC8)."""
    return merge.only_needed(t("documents").select("doc_id", "lang", "n_chars"), t("labels"), "doc_id")


@query("gold_candidates", "SELECT l.doc_id, l.quality, d.n_chars, d.doc_id IS NULL AS dropped FROM labels l LEFT JOIN (SELECT doc_id, n_chars FROM documents WHERE n_chars > 500) d USING (doc_id)")
def gold_candidates(t: Tables) -> DataFrame:
    """Gold rows with what was found for them."""
    found = t("documents").filter("n_chars > 500").select("doc_id", "n_chars")
    return merge.candidates(t("labels").select("doc_id", "quality"), found, "doc_id")


@query(
    "unique_names",
    "WITH p AS (SELECT split_part(split_part(url, '://', 2), '?', 1) AS path FROM pages), n AS (SELECT string_split(path, '/')[-1] AS name, path FROM p) SELECT name, min(path) AS path FROM n GROUP BY name HAVING count(DISTINCT path) = 1",
)
def unique_names(t: Tables) -> DataFrame:
    """Base names that stand for one path."""
    return merge.unique_names(t("pages").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)).alias("path")))


@query(
    "distinct_contents",
    "SELECT substr(sha256(text), 1, 16) AS content_id, arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1",
)
def distinct_contents(t: Tables) -> DataFrame:
    """The first document of each content."""
    rows = t("documents").select(X.content_id(F.col("text")).alias("content_id"), "doc_id", "source")
    return merge.first_of(rows, ["content_id"], F.col("doc_id"))


@query(
    "union_with_kinds",
    "SELECT kind, count(*) AS n, count(lang) AS n_lang FROM (SELECT 'doc' AS kind, lang FROM documents UNION ALL SELECT 'bench', NULL FROM benchmark) GROUP BY kind",
)
def union_with_kinds(t: Tables) -> DataFrame:
    """Sources of different columns one after the other."""
    rows = merge.with_default_kind({"doc": t("documents").select("doc_id", "lang"), "bench": t("benchmark").select("item_id")})
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("n_lang"))


# --- validation ----------------------------------------------------------

_OUT = "CASE doc_id % 5 WHEN 0 THEN substr(text, 1, length(text) // 2) WHEN 1 THEN 'Here''s the compressed ' || substr(text, 1, length(text) // 3) WHEN 2 THEN 'Yes, ' || substr(text, 1, length(text) // 3) WHEN 3 THEN '```' || chr(10) || substr(text, 1, length(text) // 3) || '```' ELSE text END"


def outputs(t: Tables) -> DataFrame:
    c, n = F.col("text"), F.length("text")
    part = lambda k: F.substring(c, F.lit(1), F.floor(n / k).cast("int"))
    kind = F.col("doc_id") % 5
    out = (
        F.when(kind == 0, part(2)).when(kind == 1, F.concat(F.lit("Here's the compressed "), part(3))).when(kind == 2, F.concat(F.lit("Yes, "), part(3)))
        .when(kind == 3, F.concat(F.lit("```\n"), part(3), F.lit("```"))).otherwise(c)
    )
    return t("documents").select("doc_id", c.alias("original"), out.alias("output"), F.floor(n / 8).cast("int").alias("budget"))


@query(
    "output_checks",
    f"""WITH o AS (SELECT doc_id, text AS a, {_OUT} AS b, length(text) // 8 AS m FROM documents)
SELECT doc_id, CASE WHEN length(b) // 4 > m * 1.3 THEN 'exceeds_budget' WHEN length(b) // 4 < m * 0.2 THEN 'too_short' WHEN length(b) / greatest(1, length(a)) > 0.65 THEN 'near_identity'
  WHEN starts_with(lower(b), 'here''s the compressed') THEN 'hallucinated_preamble' WHEN starts_with(b, '```') THEN 'wrapped_in_codefence' WHEN starts_with(b, 'Yes,') THEN 'looks_like_qa_response' ELSE 'ok' END AS reject_reason FROM o""",
)
def output_checks(t: Tables) -> DataFrame:
    """The first check that each output fails (V1-V6, PF4)."""
    rows = outputs(t)
    return rows.select("doc_id", F.coalesce(validate.text_reason(F.col("output"), F.col("budget"), F.col("original")), F.lit("ok")).alias("reject_reason"))


@query("validate_segments")
def validate_segments(t: Tables) -> DataFrame:
    """All eight checks over outputs whose segments are whole documents (PF4, PF16, V7, V8, W10)."""
    rows = t("documents").select("doc_id", F.col("text"))
    block = lambda body: X.segment_block(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("file_read"), F.lit("L1"), body)
    pairs = rows.groupBy(F.floor(F.col("doc_id") / 4).cast("string").alias("sample_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", block(F.col("text")).alias("b")))), lambda x: x["b"]), "\n\n").alias("original"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", block(F.substring("text", F.lit(1), (F.length("text") * 0.55).cast("int"))).alias("b")))), lambda x: x["b"]), "\n\n").alias("output"),
    )
    pairs = pairs.withColumn("budget", X.tokens_floor(F.col("output")))
    spans_ = rows.select(F.floor(F.col("doc_id") / 4).cast("string").alias("sample_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("seg_id"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0))).alias("text"))
    return validate.validate(pairs, spans_).select("sample_id", "reject_reason")


@query(
    "segment_states",
    """WITH a AS (SELECT doc_id % 50 AS g, doc_id, length(text) AS n FROM documents WHERE lang <> 'es'), b AS (SELECT doc_id % 50 AS g, doc_id, length(text) * (doc_id % 4 + 1) // 4 AS m FROM documents WHERE lang <> 'de')
SELECT CASE WHEN m IS NULL THEN 'DROPPED' WHEN n IS NULL THEN 'ADDED' WHEN m < 0.7 * n THEN 'SHRUNK' ELSE 'INTACT' END AS state, count(*) AS n FROM a FULL JOIN b USING (g, doc_id) GROUP BY 1""",
)
def segment_states(t: Tables) -> DataFrame:
    """Segments of both sides by what became of them."""
    d = t("documents").select((F.col("doc_id") % 50).alias("sample_id"), F.col("doc_id").alias("seg_id"), F.col("text").alias("content"), "lang", F.lit("k").alias("kind"), F.lit("L1").alias("level"))
    after = d.filter("lang <> 'de'").withColumn("content", F.substring("content", F.lit(1), F.floor(F.length("content") * (F.col("seg_id") % 4 + 1) / 4).cast("int")))
    return validate.segment_states(d.filter("lang <> 'es'"), after, ["sample_id", "seg_id"]).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "span_containment",
    """WITH s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{7,}')) AS span FROM documents)
SELECT doc_id, count(*) AS n_spans, count(*) FILTER (contains(substr(text, 1, length(text) // 2), span)) AS n_kept FROM s JOIN documents USING (doc_id) GROUP BY doc_id""",
)
def span_containment(t: Tables) -> DataFrame:
    """Spans that the first half of a document holds: an equi-join, then containment."""
    d = t("documents").select("doc_id", "text")
    span = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0))).alias("span")).distinct()
    half = d.select("doc_id", F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("half"))
    return span.join(half, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.count_if(F.col("half").contains(F.col("span"))).alias("n_kept"))


@query(
    "batch_guard",
    """SELECT doc_id::VARCHAR AS custom_id, CASE WHEN doc_id % 7 = 0 THEN 'api_error' WHEN doc_id % 5 = 0 THEN 'malformed_response' WHEN l.doc_id IS NULL THEN 'sample_not_in_pool' END AS reject_reason
FROM documents LEFT JOIN labels l USING (doc_id)""",
)
def batch_guard(t: Tables) -> DataFrame:
    """Guards over batch results that come as JSON lines (J1, PF5, D10)."""
    choices = F.when(F.col("doc_id") % 5 != 0, F.array(F.struct(F.struct(F.substring("text", 1, 20).alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))))
    body = F.struct(F.struct(choices.alias("choices")).alias("body"), F.when(F.col("doc_id") % 7 == 0, 500).otherwise(200).alias("status_code"))
    lines = t("documents").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("custom_id"), body.alias("response"))).alias("value"))
    rows = lines.select(F.from_json("value", BATCH_RESULT).alias("r")).select("r.*")
    pool = t("labels").select(F.col("doc_id").cast("string").alias("sample_id"))
    return validate.batch_guard(rows, pool).select("custom_id", "reject_reason")


_ENDS = rf"""length(trim({_OUT}, E' \t\n\r\f\v')) = 0 OR len(regexp_extract_all({_OUT}, '\[SEG\s+id=[^\s\]]+\s+kind=[^\s\]]+\s+level=[^\s\]]+\]')) > len(regexp_extract_all({_OUT}, '\[/SEG\]'))
  OR (NOT regexp_matches({_OUT}, '(\[/SEG\]|```)\s*$') AND (length({_OUT}) >= 200 OR regexp_matches({_OUT}, '\[SEG\s+id=[^\s\]]+\s+kind=[^\s\]]+\s+level=[^\s\]]+\]')))"""


@query(
    "failure_flags",
    f"""WITH o AS (SELECT length({_OUT}) / greatest(1, length(text)) AS r, length({_OUT}) // 4 > (length(text) // 8) * 1.3 AS e, doc_id % 3 = 0 AS h, {_ENDS} AS c FROM documents), f AS (
  SELECT unnest(list_filter([CASE WHEN r > 0.85 THEN 'NO_COMPRESSION' WHEN r > 0.65 THEN 'WEAK_COMPRESSION' END, CASE WHEN c THEN 'TRUNCATED' END, CASE WHEN h THEN 'HIT_MAX_TOKENS' END, CASE WHEN e THEN 'EXCEEDS_BUDGET' END], lambda x: x IS NOT NULL)) AS flag FROM o)
SELECT flag, count(*) AS n FROM f GROUP BY flag""",
)
def failure_flags(t: Tables) -> DataFrame:
    """How often each failure flag is set."""
    rows = outputs(t)
    flags = validate.failure_flags(F.col("output"), F.col("original"), F.col("budget"), F.when(F.col("doc_id") % 3 == 0, "length"), F.lit(1))
    return validate.flag_tally(rows.withColumn("flags", flags), "flags", ["HIT_MAX_TOKENS", "NO_COMPRESSION"]).select("flag", "n")


# --- text ----------------------------------------------------------------


@query(
    "text_heads",
    r"""SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '[...truncated...]' ELSE text END AS clipped,
  CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '… (+' || format('{:,}', length(text) - 100) || ' more chars)' ELSE text END AS short,
  substr(sha256(text), 1, 16) AS content_id, length(text) - length(replace(text, chr(10), '')) AS n_newlines FROM documents""",
)
def text_heads(t: Tables) -> DataFrame:
    """Clipped texts, content ids and newline counts."""
    c = F.col("text")
    return t("documents").select("doc_id", X.clip_system(c).alias("clipped"), X.clip(c, 100).alias("short"), X.content_id(c).alias("content_id"), X.occurrences(c, "\n").cast("bigint").alias("n_newlines"))


@query(
    "lone_kinds",
    r"""WITH h AS (SELECT doc_id, text, substr(text, 1, 300) AS top, substr(text, 1, 200) AS f FROM documents)
SELECT doc_id, CASE WHEN contains(top, 'Traceback') OR contains(top, 'FAILED') OR contains(f, 'Error:') THEN 'log_output'
  WHEN contains(f, '@@') OR regexp_matches(ltrim(top), '^[/.]') THEN 'file_read'
  WHEN regexp_matches(top, '(import |def |class |from |function )') THEN 'file_read'
  WHEN length(f) - length(replace(f, chr(10), '')) > 5 THEN 'log_output' ELSE 'file_read' END AS kind FROM h""",
)
def lone_kinds(t: Tables) -> DataFrame:
    """Kind of each document taken alone."""
    return t("documents").select("doc_id", X.lone_kind(F.col("text")).alias("kind"))


@query(
    "marker_counts",
    r"""SELECT doc_id, len(regexp_extract_all(lower(text), 'the')) AS n_the, len(regexp_extract_all(text, '[0-9]+')) AS n_digits, len(regexp_extract_all(lower(text), 'licen[sc]e')) AS n_license FROM documents""",
)
def marker_counts(t: Tables) -> DataFrame:
    """Counts of markers by pattern."""
    m = X.marker_counts(F.col("text"), {"the": "the", "digits": "[0-9]+", "license": "licen[sc]e"})
    return t("documents").select("doc_id", *(m[k].cast("bigint").alias(f"n_{k}") for k in ("the", "digits", "license")))


@query(
    "parsed_blocks",
    """SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN 'a' ELSE 'b' END AS seg_id, 'k' AS kind, 'L1' AS level, chr(10) || text || chr(10) AS content FROM documents""",
)
def parsed_blocks(t: Tables) -> DataFrame:
    """Blocks written and parsed again; of two with one id the last holds (R13, PF16, PF18)."""
    from loomline.operators import segments

    sid = F.when(F.length("text") % 2 == 0, "a").otherwise("b")
    two = F.concat(X.segment_block(sid, F.lit("old"), F.lit("L0"), F.lit("first")), F.lit("\n\n"), X.segment_block(sid, F.lit("k"), F.lit("L1"), F.col("text")))
    fenced = F.concat(F.lit("intro\n```input_data\n"), two, F.lit("\n```\n\n### COMPRESSED OUTPUT\nrest"))
    return segments.blocks(t("documents").select("doc_id", X.fenced_input(fenced).alias("body")), "body")


@query("keyword_sets", r"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*') AS ws FROM benchmark), e AS (
  SELECT item_id, lower(unnest(ws)) AS k FROM w UNION SELECT item_id, lower(p) FROM (SELECT item_id, unnest(flatten(list_transform(ws, lambda x: regexp_extract_all(x, '[a-z]+|[A-Z][a-z]*')))) AS p FROM w) WHERE length(p) > 1)
SELECT item_id, count(DISTINCT k) AS n_keywords, min(k) AS first FROM e WHERE k NOT IN (SELECT unnest(string_split('""" + " ".join(X.STOP_WORDS) + """', ' '))) GROUP BY item_id""")
def keyword_sets(t: Tables) -> DataFrame:
    """Keywords of each item."""
    k = X.keywords(F.col("text"))
    return t("benchmark").select("item_id", F.size(k).cast("bigint").alias("n_keywords"), F.get(k, 0).alias("first"))


@query("must_keep_spans")
def must_keep_spans(t: Tables) -> DataFrame:
    """Spans of documents that compression must keep."""
    rows = t("documents").select("doc_id", "text", F.lit("file_read").alias("seg_kind"))
    return spans.span_rows(rows, ["doc_id"], "text", "seg_kind")


@query(
    "native_span_counts",
    r"""SELECT doc_id, len(regexp_extract_all(text, '\b(?:commit\s+)?[0-9a-f]{7,40}\b')) AS n_hash, len(regexp_extract_all(text, '\b[A-Z][a-zA-Z]*(?:Error|Exception|Warning|Failure|Fault)\b')) AS n_error FROM documents""",
)
def native_span_counts(t: Tables) -> DataFrame:
    """Spans of groups that need no look-behind, counted natively."""
    return t("documents").select("doc_id", *(spans.group_count(F.col("text"), g).cast("bigint").alias(n) for g, n in (("hash", "n_hash"), ("error_class", "n_error"))))


@query("linted_documents")
def linted_documents(t: Tables) -> DataFrame:
    """Documents after all lint passes."""
    return t("documents").select("doc_id", F.md5(lint.linted(F.col("text")).cast("binary")).alias("lint_md5"))


@query(
    "native_lint",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), lambda x: regexp_replace(x, '\s+$', '')), chr(10)) ELSE text END AS body FROM documents""",
)
def native_lint(t: Tables) -> DataFrame:
    """The stateless lint passes."""
    return t("documents").select("doc_id", lint.native_lint(F.col("text")).alias("body"))


@query("chunked_documents")
def chunked_documents(t: Tables) -> DataFrame:
    """Documents in chunks of at most 200 tokens."""
    rows = t("documents").select("doc_id", F.posexplode(chunking.chunked(F.col("text"), F.lit(200))).alias("chunk", "c"))
    return rows.select("doc_id", "chunk", "c.start_line", "c.end_line", "c.tokens")


@query("located_edits")
def located_edits(t: Tables) -> DataFrame:
    """Items found again in documents that hold them once, layout ignored."""
    flat = F.regexp_replace("text", r"\s+", " ")
    part = F.substring(flat, F.lit(1), F.lit(60))
    return t("documents").select("doc_id", edits.located(part, F.col("text")).isNotNull().alias("found"))


# --- tools and vectors ---------------------------------------------------


@query(
    "nearest_vectors",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (
  SELECT query_id, vec_id AS item_id, round(list_cosine_similarity(a, embedding::DOUBLE[]), 6) AS score FROM q, embeddings), r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1)::INT AS rank FROM s)
SELECT query_id, item_id, score, rank FROM r WHERE rank < 10""",
)
def nearest_vectors(t: Tables) -> DataFrame:
    """The ten vectors nearest to every hundredth one, by cosine."""
    v = t("embeddings").select("vec_id", "embedding")
    return tools.nearest(v.filter("vec_id % 100 = 0"), v, 10).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query(
    "retrieval_recall",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a, label AS l FROM embeddings WHERE vec_id % 100 = 0), s AS (
  SELECT query_id, l, label, (row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(a, embedding::DOUBLE[]), 9) DESC, vec_id) - 1) AS rank FROM q, embeddings)
SELECT query_id, count(*) FILTER (l = label) AS n_same, count(*) AS n_kept FROM s WHERE rank < 10 GROUP BY query_id""",
)
def retrieval_recall(t: Tables) -> DataFrame:
    """How many of the ten nearest share the label."""
    v = t("embeddings")
    best = tools.nearest(v.filter("vec_id % 100 = 0").select("vec_id", "embedding"), v.select("vec_id", "embedding"), 10)
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("l"))
    rows = best.join(own, "query_id").join(v.select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    return rows.groupBy("query_id").agg(F.count_if(F.col("l") == F.col("label")).alias("n_same"), F.count(F.lit(1)).alias("n_kept"))


@query(
    "mcp_selection",
    """WITH r AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'error') THEN 'mcp__' || event_type ELSE event_type END AS name,
  (row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1)::INT AS rank FROM events), s AS (
  SELECT user_id, round(sum(CASE WHEN starts_with(name, 'mcp__') THEN CASE WHEN rank < 3 THEN 3.0 WHEN rank < 6 THEN 1.0 ELSE 0.3 END ELSE 0 END), 6) AS signal FROM r WHERE rank < 8 GROUP BY 1), n AS (SELECT user_id, count(*) AS n FROM r GROUP BY 1)
SELECT user_id, event_id, CASE WHEN n < 5 OR rank < 8 THEN 'keep' WHEN starts_with(name, 'mcp__') AND signal >= 1 THEN 'stub' ELSE 'drop' END AS fate FROM r JOIN s USING (user_id) JOIN n USING (user_id)""",
)
def mcp_selection(t: Tables) -> DataFrame:
    """What becomes of ranked tools: kept, stubbed or dropped."""
    name = F.when(F.col("event_type").isin("click", "error"), F.concat(F.lit("mcp__"), "event_type")).otherwise(F.col("event_type"))
    ranked = tools.top_k(t("events").select("user_id", "event_id", name.alias("name"), "value", F.lit("").alias("description")), ["user_id"], 8, "value", "event_id")
    signal = tools.mcp_signal(ranked.filter("kept"), ["user_id"])
    return tools.applied(ranked, signal, ["user_id"]).select("user_id", "event_id", "fate")


@query("keyword_scores")
def keyword_scores(t: Tables) -> DataFrame:
    """The five documents with the highest keyword scores of each item, whole texts of both."""
    docs = t("documents").select("doc_id", F.col("text").alias("d"), F.col("source").alias("name"))
    return tools.keyword_best(t("benchmark").select("item_id", F.col("text").alias("q")), docs, 5)


# --- compression ---------------------------------------------------------


def _blocks(t: Tables) -> DataFrame:
    return t("documents").select(
        F.col("doc_id").alias("seq"), F.col("text").alias("content"), F.lit("file_read").alias("kind"), F.lit("L2").alias("level"), F.lit(None).cast("string").alias("intent"),
        F.concat(F.lit("/"), "source").alias("path"), (F.col("doc_id") % 17 == 0).alias("pinned"),
    )


@query(
    "compression_gates",
    """WITH w AS (SELECT doc_id, text, ceil(length(text) / 4) AS tokens, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS prior FROM documents)
SELECT CASE WHEN doc_id % 17 = 0 THEN 'pinned' WHEN coalesce(contains(trim(prior), trim(text)), false) THEN 'path_shortcircuit' WHEN tokens < 100 THEN 'below_min_tokens' WHEN tokens > 2000 THEN 'above_max_tokens' ELSE 'ineffective' END AS reason,
  count(*) AS n, sum(tokens)::BIGINT AS tokens FROM w GROUP BY 1""",
)
def compression_gates(t: Tables) -> DataFrame:
    """Why contents are left as they are; the identity compressor saves nothing (PF9, PF10, J13, J14, Q11)."""
    rows = compress.compress(_blocks(t), compress.identity, least=100, most=2000)
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("original_tokens").cast("bigint").alias("tokens"))


@query("compressed_documents")
def compressed_documents(t: Tables) -> DataFrame:
    """The decision list with the deterministic compressor (§3.2, S9, A17)."""
    rows = compress.compress(_blocks(t), compress.linting, least=20)
    return rows.select("seq", "reason", "original_tokens", "compressed_tokens", "cache_hit")


@query(
    "request_stats",
    """WITH b AS (SELECT source, ceil(length(text) / 4)::BIGINT AS tokens, CASE WHEN length(text) < 800 THEN 'below_min_tokens' WHEN length(text) > 8000 THEN 'above_max_tokens' END AS r, doc_id % 9 = 0 AS hit FROM documents)
SELECT source AS request_id, coalesce(sum(tokens) FILTER (r IS NULL), 0)::BIGINT AS original, coalesce(sum(tokens // 2) FILTER (r IS NULL), 0)::BIGINT AS compressed, count(*) FILTER (r IS NULL) AS items,
  coalesce(sum(tokens) FILTER (r IS NOT NULL), 0)::BIGINT AS skipped, count(*) FILTER (hit) AS cache_hits FROM b GROUP BY 1""",
)
def request_stats(t: Tables) -> DataFrame:
    """Sums of each request."""
    n = F.length("text")
    tokens = X.tokens_ceil(F.col("text")).cast("bigint")
    rows = t("documents").select(F.col("source").alias("request_id"), tokens.alias("tokens"), F.floor(tokens / 2).alias("compressed_tokens"), F.when(n < 800, "below_min_tokens").when(n > 8000, "above_max_tokens").alias("skip_reason"), (F.col("doc_id") % 9 == 0).alias("cache_hit"))
    return requests.request_stats(rows).drop("skipped_by_reason")


# --- sources and sinks ---------------------------------------------------


@query("json_lines_round_trip", "SELECT doc_id, quality, toxic FROM labels")
def json_lines_round_trip(t: Tables) -> DataFrame:
    """Rows written as JSON lines and read back by schema (SC5, SK1)."""
    rows = t("labels").select("doc_id", "quality", "toxic")
    path = scratch.folder(t.spark, "labels")
    io.write_json_lines(rows, path)
    return io.json_lines(t.spark, path, rows.schema)


@query("tolerant_json_lines", "SELECT doc_id % 3 = 0 AS bad, count(*) AS n FROM labels GROUP BY 1")
def tolerant_json_lines(t: Tables) -> DataFrame:
    """Lines that do not parse are told apart, not lost (SC6)."""
    rows = t("labels").select(F.when(F.col("doc_id") % 3 == 0, F.lit('{"doc_id": 1, ')).otherwise(F.to_json(F.struct("doc_id", "quality"))).alias("value"))
    path = scratch.folder(t.spark, "lines")
    rows.write.text(path)
    good, bad = io.tolerant_json_lines(t.spark, path, t("labels").select("doc_id", "quality").schema)
    return good.select(F.lit(False).alias("bad")).unionAll(bad.select(F.lit(True))).groupBy("bad").agg(F.count(F.lit(1)).alias("n"))


@query("row_counts", "SELECT count(*) AS n_rows FROM lineitem")
def row_counts(t: Tables) -> DataFrame:
    """Rows of a table from its footers (SC2)."""
    return io.row_count(t("lineitem"))


@query("projected_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 10 GROUP BY 1")
def projected_scan(t: Tables) -> DataFrame:
    """Two columns and a pushed filter (SC1, SC3)."""
    return t("lineitem").filter("l_quantity < 10").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("prefix_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 200")
def prefix_scan(t: Tables) -> DataFrame:
    """The first 200 rows of a kind in an explicit order (SC4, SC9)."""
    return io.first_rows(t("orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus"), 200, "o_orderkey")


@query("batch_request_lines", "SELECT doc_id::VARCHAR AS custom_id, floor((length(text) // 8) * 1.5)::INT AS max_tokens FROM documents")
def batch_request_lines(t: Tables) -> DataFrame:
    """Request lines of a batch job, parsed again (SK2)."""
    message = F.array(F.struct(F.lit("user").alias("role"), F.substring("text", 1, 30).alias("content")))
    rows = t("documents").select(F.col("doc_id").cast("string").alias("sample_id"), message.alias("messages"), F.floor(F.length("text") / 8).alias("budget"))
    lines = io.batch_requests(rows, "model")
    return lines.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.get_json_object("value", "$.body.max_tokens").cast("int").alias("max_tokens"))


@query("stream_folding", "SELECT conv_id AS message_id, turn::INT AS block, text FROM conversations WHERE text <> ''")
def stream_folding(t: Tables) -> DataFrame:
    """Texts cut into deltas as server-sent events and folded again (SC15, ST10)."""
    texts = t("conversations").select(F.col("conv_id").alias("message_id"), F.col("turn").cast("int").alias("block"), "text")
    parts = io.unfolded_stream(texts, 50)
    event = F.struct(F.lit("content_block_delta").alias("type"), F.col("block").alias("index"), F.struct(F.lit("text_delta").alias("type"), F.col("delta").alias("text")).alias("delta"))
    lines = parts.select("message_id", F.col("part").alias("seq"), F.concat(F.lit("data: "), F.to_json(event)).alias("line"))
    return io.folded_stream(io.events_of_stream(lines))


@query(
    "context_sections",
    "SELECT source, doc_id AS pos, source || '/' || doc_id AS path, length(text) AS n FROM documents WHERE NOT contains(text, chr(10) || '# File: ')",
)
def context_sections(t: Tables) -> DataFrame:
    """Files framed into one context a source and taken apart again."""
    rows = t("documents").select("source", F.col("doc_id").alias("pos"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("body"))
    parts = io.expanded_sections(io.framed_sections(rows, "source"), "source", "context")
    return parts.select("source", F.split_part("path", F.lit("/"), F.lit(2)).cast("bigint").alias("pos"), "path", F.length("body").cast("bigint").alias("n"))


@query(
    "wire_blocks",
    "SELECT conv_id::VARCHAR AS request_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS msg_idx, role, 'text' AS block_type, text FROM conversations",
)
def wire_blocks(t: Tables) -> DataFrame:
    """Conversations as request bodies and flattened again (PF17, D14, PF13)."""
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    message = F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["content"].alias("text"))).alias("content")))
    body = rows.select(F.col("conv_id").cast("string").alias("request_id"), F.to_json(F.struct(message.alias("messages"))).alias("body"))
    return requests.message_blocks(body).select("request_id", "msg_idx", "role", "block_type", "text")


# --- streams -------------------------------------------------------------


def _stream(t: Tables, name: str) -> tuple[DataFrame, str]:
    """A table as a stream of its files, and a folder for the query."""
    schema = t(name).schema
    path = scratch.folder(t.spark, f"stream-{name}")
    t(name).write.parquet(f"{path}/in")
    return state.stream(t.spark, f"{path}/in", schema), path


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_totals", "SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def stream_totals(t: Tables) -> DataFrame:
    """Running totals by key, driven to the end (ST5)."""
    events, path = _stream(t, "events")
    return state.run_totals(state.totals(events, ["event_type"], users="user_id"), f"{path}/out", f"{path}/cp")


@query("stream_first_sightings", "SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_first_sightings(t: Tables) -> DataFrame:
    """The first row of each key, as a cache write (ST7, ST1)."""
    events, path = _stream(t, "events")
    return state.run_once(state.first_sightings(_timed(events), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), f"{path}/out", f"{path}/cp")


@query(
    "stream_path_history",
    """WITH d AS (SELECT user_id, props, max(event_id) AS seen FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC) AS k FROM d)
SELECT user_id, string_agg(props, '|' ORDER BY seen) AS items FROM r WHERE k <= 8 GROUP BY user_id""",
)
def stream_path_history(t: Tables) -> DataFrame:
    """The last eight distinct items of each user (ST2, W13)."""
    events, path = _stream(t, "events")
    out = state.run_once(state.path_history(events, "user_id", "props", "event_id"), f"{path}/out", f"{path}/cp")
    return out.select("user_id", F.array_join("items", "|").alias("items"))


@query(
    "stream_frozen_selection",
    "WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS first FROM events GROUP BY 1) SELECT user_id, event_id, first AS selection FROM events JOIN f USING (user_id)",
)
def stream_frozen_selection(t: Tables) -> DataFrame:
    """The first choice of a user serves all later requests while it is offered (ST4)."""
    events, path = _stream(t, "events")
    first = F.array_distinct(F.concat(F.array("event_type"), F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))))
    chosen = events.select("user_id", "event_id", first.alias("names"))
    out = state.run_once(state.frozen_selection(chosen.withColumn("names", F.slice("names", 1, 6)), "user_id", "event_id", "names"), f"{path}/out", f"{path}/cp")
    own = t("events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first"))
    return out.join(own, "user_id").select("user_id", "event_id", F.when(F.array_contains("selection", F.col("first")), F.col("first")).alias("selection"))


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(t: Tables) -> DataFrame:
    """Event-time windows, all of them closed by the end of the input (an addition)."""
    events, path = _stream(t, "events")
    out = state.run_totals(state.windowed(_timed(events), "ts", "1 day", "365 days", "event_type"), f"{path}/out", f"{path}/cp")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
