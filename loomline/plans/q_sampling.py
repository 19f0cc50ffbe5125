"""Sampling, accounting and reports over documents, labels and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import budget
from loomline.functions import text as X
from loomline.operators import accounting, reports, sampling
from loomline.plans.registry import Tables, query

BUCKET = "CASE WHEN n_chars < 600 THEN 's' WHEN n_chars < 1500 THEN 'm' ELSE 'l' END"


def strata(t: Tables) -> DataFrame:
    bucket = F.when(F.col("n_chars") < 600, "s").when(F.col("n_chars") < 1500, "m").otherwise("l")
    return t("documents").select("doc_id", "lang", "source", bucket.alias("bucket"))


def _allocation(target: int) -> str:
    return f"""
c AS (SELECT lang, {BUCKET} AS bucket, count(*) AS n FROM documents GROUP BY ALL),
t0 AS (SELECT *, least(n, round_even({target} * n / sum(n) OVER (), 0)::BIGINT) AS take FROM c),
t1 AS (SELECT *, {target} - sum(take) OVER () AS lack FROM t0 WHERE take > 0),
t2 AS (SELECT *, coalesce(sum(n - take) OVER (ORDER BY n DESC, lang, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
  coalesce(sum(take - 1) OVER (ORDER BY take DESC, lang, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare FROM t1),
plan AS (SELECT lang, bucket, n, (take + CASE WHEN lack > 0 THEN greatest(0, least(n - take, lack - room)) WHEN lack < 0 THEN -greatest(0, least(take - 1, -lack - spare)) ELSE 0 END)::BIGINT AS take FROM t2)
"""


@query("allocation", f"WITH {_allocation(337)} SELECT lang, bucket, n, take FROM plan")
def allocation(t: Tables) -> DataFrame:
    """Rows of each stratum in a proportional sample of 337 (T4)."""
    return sampling.allocate(strata(t).groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n")), ["lang", "bucket"], 337)


@query(
    "stratified_sample",
    f"""WITH {_allocation(337)}, r AS (SELECT doc_id, lang, {BUCKET} AS bucket, row_number() OVER (PARTITION BY lang, {BUCKET} ORDER BY md5(doc_id || '|43'), doc_id) AS place FROM documents)
SELECT doc_id, lang, bucket FROM r JOIN plan USING (lang, bucket) WHERE place <= take""",
)
def stratified_sample(t: Tables) -> DataFrame:
    """A proportional sample by language and length, in hash order (T5)."""
    return sampling.stratified(strata(t).select("doc_id", "lang", "bucket"), ["lang", "bucket"], "doc_id", 337, 43)


@query(
    "stratified_subsample",
    f"""WITH c AS (SELECT lang, {BUCKET} AS bucket, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT *, greatest(1, round_even(50 * n / sum(n) OVER (), 0)::BIGINT) AS share FROM c),
r AS (SELECT doc_id, lang, {BUCKET} AS bucket, row_number() OVER (PARTITION BY lang, {BUCKET} ORDER BY md5(doc_id || '|7'), doc_id) AS place FROM documents),
q AS (SELECT doc_id, lang, bucket, row_number() OVER (ORDER BY md5(doc_id || '|8'), doc_id) AS place FROM r JOIN s USING (lang, bucket) WHERE place <= share)
SELECT doc_id, lang, bucket FROM q WHERE place <= 50""",
)
def stratified_subsample(t: Tables) -> DataFrame:
    """At least one row a stratum, 50 in all."""
    return sampling.subsample(strata(t).select("doc_id", "lang", "bucket"), ["lang", "bucket"], "doc_id", 50, 7)


@query(
    "split_by_source",
    """WITH g AS (SELECT source, row_number() OVER (ORDER BY md5(source || '|42'), source) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, CASE WHEN place <= floor(n * 0.25) THEN 'val' ELSE 'train' END AS split FROM documents JOIN g USING (source)""",
)
def split_by_source(t: Tables) -> DataFrame:
    """Whole sources as validation, a quarter of them."""
    return sampling.split_by_group(t("documents").select("doc_id", "source"), "source", 0.25, 42)


@query(
    "per_source_sample",
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|5'), doc_id) AS place, count(*) OVER (PARTITION BY source) < 30 AS short FROM documents)
SELECT doc_id, source, place, short FROM r WHERE place <= 30""",
)
def per_source_sample(t: Tables) -> DataFrame:
    """30 documents of each source in hash order, and whether a source has fewer."""
    return sampling.per_kind(t("documents").select("doc_id", "source"), "source", "doc_id", 30, 5).select("doc_id", "source", "place", "short")


@query("hash_order_take", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|42'), doc_id LIMIT 100")
def hash_order_take(t: Tables) -> DataFrame:
    """The first 100 documents in hash order."""
    return sampling.take(t("documents").select("doc_id"), "doc_id", 100, 42)


@query("repeated_rows", "SELECT doc_id, quality FROM labels, range(3) r(i) WHERE i = 0 OR quality = 0")
def repeated_rows(t: Tables) -> DataFrame:
    """Rows of the rare class three times."""
    return sampling.repeated(t("labels").select("doc_id", "quality"), F.col("quality") == 0, 3)


@query(
    "top_reports",
    "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20",
)
def top_reports(t: Tables) -> DataFrame:
    """The longest documents."""
    return reports.top_rows(t("documents").select("doc_id", "n_chars"), 20, F.desc("n_chars"), "doc_id")


SQL_LOG = """
log AS (
  SELECT event_id AS seq, CASE user_id % 6 WHEN 0 THEN 'anthropic/claude-sonnet-4' WHEN 1 THEN 'gpt-5-mini-x' WHEN 2 THEN 'gpt-5' WHEN 3 THEN 'foo' WHEN 4 THEN 'Claude-Opus-4' ELSE 'gpt-4o-mini' END AS model,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
    CASE WHEN event_type = 'signup' THEN 0 ELSE trunc(value * 10)::BIGINT END AS content_orig, CASE WHEN event_type = 'signup' THEN 0 ELSE trunc(value * 4)::BIGINT END AS content_comp,
    CASE WHEN event_type = 'click' THEN trunc(value)::BIGINT ELSE 0 END AS tools_orig, CASE WHEN event_type = 'click' THEN trunc(value)::BIGINT // 3 ELSE 0 END AS tools_comp,
    CASE WHEN event_type = 'view' THEN trunc(value)::BIGINT % 500 ELSE 0 END AS skipped, CASE WHEN event_type = 'view' THEN CASE WHEN value < 50 THEN 'below_min_tokens' ELSE 'gpu' END END AS skip_reason,
    CASE WHEN event_type = 'purchase' THEN trunc(value)::BIGINT - 20 END AS expanded
  FROM events
)"""


def usage_log(t: Tables) -> DataFrame:
    """The event log as a request log of six models."""
    kind, v = F.col("event_type"), F.col("value")
    models = ["anthropic/claude-sonnet-4", "gpt-5-mini-x", "gpt-5", "foo", "Claude-Opus-4", "gpt-4o-mini"]
    n = lambda c: c.cast("bigint")
    return t("events").select(
        F.col("event_id").alias("seq"),
        F.element_at(F.array(*map(F.lit, models)), (F.col("user_id") % 6 + 1).cast("int")).alias("model"),
        F.when(kind == "error", 500).otherwise(200).alias("status"),
        F.when(kind == "signup", F.lit(0)).otherwise(n(v * 10)).alias("content_orig"),
        F.when(kind == "signup", F.lit(0)).otherwise(n(v * 4)).alias("content_comp"),
        F.when(kind == "click", n(v)).otherwise(F.lit(0)).alias("tools_orig"),
        F.when(kind == "click", F.floor(n(v) / 3)).otherwise(F.lit(0)).alias("tools_comp"),
        F.when(kind == "view", n(v) % 500).otherwise(F.lit(0)).alias("skipped"),
        F.when(kind == "view", F.when(v < 50, "below_min_tokens").otherwise("gpu")).alias("skip_reason"),
        F.when(kind == "purchase", n(v) - 20).alias("expanded"),
    )


_SLOT_SUMS = ", ".join(
    f"coalesce(sum({p}_{s}) FILTER ({p}_slot = '{k}'), 0)::BIGINT AS {p}_{k}_{s}" for p in ("content", "tools") for k in ("first", "rest") for s in ("orig", "comp")
)
SQL_MODELS = f"""{SQL_LOG}, s AS (
  SELECT *, {", ".join(f"CASE WHEN coalesce(sum({p}_orig) OVER (PARTITION BY model ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 'first' ELSE 'rest' END AS {p}_slot" for p in ("content", "tools"))}
  FROM log WHERE status BETWEEN 200 AND 299
), models AS (SELECT model, {_SLOT_SUMS} FROM s GROUP BY model)"""


@query("usage_by_model", f"WITH {SQL_MODELS} SELECT * FROM models")
def usage_by_model(t: Tables) -> DataFrame:
    """Tokens of each model by first and later requests; failed requests do not count (A18, W14, PF11)."""
    return accounting.by_model(usage_log(t))


_CASE = lambda prefixes, default: "CASE " + " ".join(f"WHEN starts_with(name, '{p}') THEN {v}" for p, v in sorted(prefixes.items(), key=lambda x: -len(x[0]))) + f" ELSE {default} END"


@query(
    "cost_saved",
    f"""WITH {SQL_MODELS}, n AS (SELECT *, CASE WHEN contains(model, '/') THEN lower(split_part(model, '/', 2)) ELSE lower(model) END AS name FROM models),
r AS (SELECT *, {_CASE(accounting.PRICES, 3.0)} AS price, {_CASE(accounting.CACHE_READ, 0.1)} AS mult, {_CASE(dict.fromkeys(accounting.PRICES, "true"), "false")} AS matched FROM n)
SELECT model, price::DOUBLE AS usd_per_mtok, matched AS usd_per_mtok_matched, mult::DOUBLE AS read_mult,
  round(((content_first_orig - content_first_comp + tools_first_orig - tools_first_comp) * 1.25 + (content_rest_orig - content_rest_comp + tools_rest_orig - tools_rest_comp) * mult::DOUBLE) * price::DOUBLE / 1000000, 4) AS saved_usd
FROM r""",
)
def cost_saved(t: Tables) -> DataFrame:
    """Dollars saved by model, prices by longest prefix."""
    return accounting.saved_cost(accounting.by_model(usage_log(t))).select("model", "usd_per_mtok", "usd_per_mtok_matched", "read_mult", "saved_usd")


@query(
    "usage_snapshot",
    f"""WITH {SQL_LOG}, ok AS (SELECT * FROM log WHERE status BETWEEN 200 AND 299), s AS (SELECT sum(content_orig)::BIGINT AS original,
  (sum(content_comp) + sum(greatest(coalesce(expanded, 0), 0)))::BIGINT AS compressed, sum(skipped)::BIGINT AS skipped, count(expanded) AS expansions FROM ok)
SELECT *, original - compressed AS saved, CASE WHEN original > 0 THEN round_even(compressed / original, 3) ELSE 0 END AS ratio FROM s""",
)
def usage_snapshot(t: Tables) -> DataFrame:
    """Totals of the log with expansions given back."""
    return accounting.snapshot(usage_log(t))


@query("skipped_by_reason", f"WITH {SQL_LOG} SELECT skip_reason, count(*) AS n, sum(skipped)::BIGINT AS tokens FROM log WHERE status BETWEEN 200 AND 299 AND skip_reason IS NOT NULL GROUP BY 1")
def skipped_by_reason(t: Tables) -> DataFrame:
    """Skipped tokens by reason."""
    return accounting.skipped_by_reason(usage_log(t))


@query(
    "recent_samples",
    f"""WITH {SQL_LOG}, r AS (SELECT model, seq, row_number() OVER (PARTITION BY model ORDER BY seq DESC) AS k, count(*) OVER (PARTITION BY model) AS n FROM log)
SELECT model, seq, least(99, least(n, 6) - 1)::INT AS page FROM r WHERE k = least(n, 6)""",
)
def recent_samples(t: Tables) -> DataFrame:
    """Page 99 of the last six requests of each model is the oldest of them (W12, ST6)."""
    return accounting.recent(usage_log(t), ["model"], "seq", 99).select("model", "seq", "page")


@query(
    "largest_saving",
    f"WITH {SQL_LOG}, r AS (SELECT model, seq, content_orig - content_comp AS saving, row_number() OVER (PARTITION BY model ORDER BY content_orig - content_comp DESC, seq) AS k FROM log) SELECT model, seq, saving FROM r WHERE k = 1",
)
def largest_saving(t: Tables) -> DataFrame:
    """The request of each model that saves most."""
    return accounting.largest_saving(usage_log(t), ["model"], "seq").select("model", "seq", "saving")


@query("event_shares", "SELECT event_type, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM events GROUP BY 1")
def event_shares(t: Tables) -> DataFrame:
    """Events by type with their share (A1, A2)."""
    return reports.shares(t("events"), ["event_type"])


@query(
    "value_percentiles",
    """WITH v AS (SELECT event_type, list_sort(list(value)) AS s, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n, s[n // 4 + 1] AS p25, s[n // 2 + 1] AS p50, s[floor(n * 0.95)::BIGINT + 1] AS p95 FROM v""",
)
def value_percentiles(t: Tables) -> DataFrame:
    """Index percentiles without interpolation (A5)."""
    return reports.percentiles(t("events"), ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p95": 0.95})


@query(
    "most_common_props",
    """WITH c AS (SELECT event_type, props, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, f) AS k FROM c)
SELECT event_type, props, n, k::INT AS rank FROM r WHERE k <= 3""",
)
def most_common_props(t: Tables) -> DataFrame:
    """The three most frequent properties of each type, ties by first appearance."""
    return reports.most_common(t("events"), ["event_type"], "props", "event_id", 3)


@query(
    "recall_rollup",
    """SELECT 'q' || quality AS state, CASE WHEN grouping(lang) = 1 THEN 'OVERALL' ELSE lang END AS kind, count(*) AS total, sum((toxic = 0)::INT)::BIGINT AS n_kept, round(sum((toxic = 0)::INT) / count(*), 4) AS recall
FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((quality, lang), (quality))""",
)
def recall_rollup(t: Tables) -> DataFrame:
    """Conditional shares by two keys with a total for the first."""
    from loomline.operators import validate

    rows = t("labels").join(t("documents"), "doc_id").select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("state"), F.col("lang").alias("kind"), (F.col("toxic") == 0).alias("kept"))
    return validate.recall_report(rows)


@query(
    "grouping_sets_report",
    """SELECT lang, source, count(r) AS kept, count(*) FILTER (r IS NULL) AS dropped, round(avg(r), 6) AS avg_ratio
FROM (SELECT lang, source, CASE WHEN n_chars >= 500 THEN 500 / n_chars END AS r FROM documents) GROUP BY GROUPING SETS ((lang), (source))""",
)
def grouping_sets_report(t: Tables) -> DataFrame:
    """Independent groupings of one input; a null ratio is a dropped row."""
    rows = t("documents").select("lang", "source", F.when(F.col("n_chars") >= 500, 500 / F.col("n_chars")).alias("ratio"))
    return reports.compression_report(rows, [["lang"], ["source"]])


@query(
    "hint_lines",
    r"""WITH w AS (SELECT doc_id % 10 AS g, lang AS kind, doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS text, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{6,}'), 1) AS k FROM documents),
c AS (SELECT g, kind, text, count(*) AS n, min(doc_id * 100000 + k) AS f FROM w GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY g, kind) AS d, count(*) OVER (PARTITION BY g) AS a, row_number() OVER (PARTITION BY g, kind ORDER BY n DESC, f) AS place FROM c)
SELECT g::VARCHAR AS sample_id, kind, string_agg('`' || text || '`' || CASE WHEN n > 1 THEN ' (×' || n || ')' ELSE '' END, ', ' ORDER BY place) AS hints
FROM r WHERE place <= greatest(3, least(12, round_even(60 * d / a, 0)::INT)) GROUP BY g, kind""",
)
def hint_lines(t: Tables) -> DataFrame:
    """Most frequent capitalised words by group and language, in slots by diversity."""
    words = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0))
    rows = t("documents").select((F.col("doc_id") % 10).cast("string").alias("sample_id"), F.col("lang").alias("kind"), "doc_id", F.posexplode(words).alias("k", "text"))
    rows = rows.select("sample_id", "kind", "text", (F.col("doc_id") * 100000 + F.col("k")).alias("pos"))
    return reports.hint_lines(rows, "sample_id", budget.hint_slots)


@query(
    "resolve_rates",
    """WITH a AS (SELECT CASE WHEN toxic = 0 THEN 'baseline' ELSE 'other' END AS arm, count(*) AS total, sum(quality)::BIGINT AS n_resolved FROM labels GROUP BY 1)
SELECT *, n_resolved / total AS rate, n_resolved / (SELECT n_resolved FROM a WHERE arm = 'baseline') AS retained FROM a""",
)
def resolve_rates(t: Tables) -> DataFrame:
    """Resolved share of each arm, and what it keeps of the baseline."""
    rows = t("labels").select(F.when(F.col("toxic") == 0, "baseline").otherwise("other").alias("arm"), F.col("quality").alias("resolved"))
    return accounting.resolve_rates(rows, "baseline")


@query(
    "price_join",
    """WITH p(prefix, tag) AS (VALUES ('b', 1), ('blog', 2), ('blog.th', 3), ('www', 4), ('www.th', 5), ('www.ther', 6)), h AS (SELECT DISTINCT split_part(split_part(url, '://', 2), '/', 1) AS name FROM pages),
m AS (SELECT h.name, prefix, tag, row_number() OVER (PARTITION BY h.name ORDER BY length(prefix) DESC) AS k FROM h JOIN p ON starts_with(h.name, prefix))
SELECT h.name, prefix, tag FROM h LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (name)""",
)
def price_join(t: Tables) -> DataFrame:
    """Longest-prefix join of hosts with a small table, by equi-join on prefixes."""
    names = t("pages").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("name")).distinct()
    table = t.spark.createDataFrame([("b", 1), ("blog", 2), ("blog.th", 3), ("www", 4), ("www.th", 5), ("www.ther", 6)], "prefix string, tag int")
    return accounting.longest_prefix(names, "name", table, "prefix", []).select("name", "prefix", "tag")


@query(
    "token_estimates",
    "SELECT doc_id, (length(text) // 4)::INT AS floor_tokens, ceil(length(text) / 4)::INT AS ceil_tokens, CASE WHEN length(text) > 0 THEN round_even(ceil(length(text) / 4) / length(text), 3) ELSE 0 END AS ratio, substr(text, 1, 40) AS first_ten FROM documents",
)
def token_estimates(t: Tables) -> DataFrame:
    """Both token estimates, their ratio, and the first ten tokens decoded."""
    c = F.col("text")
    return t("documents").select("doc_id", X.tokens_floor(c).alias("floor_tokens"), X.tokens_ceil(c).alias("ceil_tokens"), X.token_ratio(X.tokens_ceil(c), F.length(c)).alias("ratio"), X.first_tokens(c, 10).alias("first_ten"))
