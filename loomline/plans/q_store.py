"""The store, its pins, embeddings and URLs over the documents, each against SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import tools
from loomline.plans import scratch
from loomline.plans.q_rules import _variant
from loomline.plans.registry import Tables, query
from loomline.sources.store import COMPRESSED, PATH, PINNED_CONTENT, PINNED_PATH, ContentStore

_BASES = _variant(
    "concat('https://api.example.com/', source, '/')",
    "concat('https://h.example/api/v1/', source)",
    "'https://h.example/v1beta/openai//'",
    "concat('https://', source, '.example/v1/chat/completions/')",
    "'https://v1.example.com'",
    "'https://h.example/x?next=/v1'",
    "'http://localhost:11434/v1'",
)
_TOKENS = _variant("'Bearer sk-1'", "concat('Bearer ', source)", "'Bearer '", "source", "NULL")


@query(
    "upstream_urls",
    rf"""WITH b AS (SELECT doc_id, rtrim({_BASES}, '/') AS b, {_BASES} AS base, {_TOKENS} AS a FROM documents)
SELECT doc_id, CASE WHEN b LIKE '%/chat/completions' THEN b WHEN regexp_matches(regexp_extract(b, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/v[0-9]') THEN b || '/chat/completions' ELSE b || '/v1/chat/completions' END AS chat,
  CASE WHEN starts_with(a, 'Bearer ') AND length(a) > 7 AND NOT starts_with(a, 'Bearer sk-') THEN 'https://login.example/responses' ELSE base || '/v1/responses' END AS responses FROM b""",
)
def upstream_urls(t: Tables) -> DataFrame:
    """Endpoints of bases in several shapes and tokens of several kinds."""
    base = F.expr(_BASES)
    return t("documents").select("doc_id", X.chat_url(base).alias("chat"), X.responses_url(F.expr(_TOKENS), base, "https://login.example/responses").alias("responses"))


START, NOW, TTL = datetime(2024, 1, 1), datetime(2024, 1, 1, 10), 6 * 3600


def _at():
    return F.timestamp_add("MINUTE", F.pmod(F.col("doc_id"), F.lit(600)).cast("int"), F.lit(START)).alias("at")


@query(
    "stored_contents",
    """WITH d AS (SELECT text, '/' || source AS path, doc_id % 600 AS m, substr(sha256(text), 1, 16) AS id FROM documents WHERE text IS NOT NULL), c AS (
  SELECT id, length(min(text)) AS chars FROM d GROUP BY 1 HAVING max(m) > 240), p AS (
  SELECT id, count(*) AS n FROM (SELECT path, max(struct_pack(m := m, id := id)).id AS id FROM d WHERE m > 240 GROUP BY 1) GROUP BY 1), z AS (
  SELECT id, max(m) AS m FROM d WHERE m % 2 = 0 GROUP BY 1)
SELECT c.id AS content_id, chars, coalesce(p.n, 0)::BIGINT AS paths, coalesce(z.m > 240, false) AS is_cached FROM c LEFT JOIN p USING (id) LEFT JOIN z USING (id)""",
)
def stored_contents(t: Tables) -> DataFrame:
    """What a store with a time to live of six hours holds after ten: contents, cached texts, last ids of paths (ST1)."""
    docs = t("documents").select("doc_id", F.col("text").alias("content"), F.concat(F.lit("/"), "source").alias("path"), _at())
    store = ContentStore(t.spark, scratch.folder(t.spark, "store"), TTL)
    for part in (0, 1):
        store.remember(docs.filter(F.pmod("doc_id", F.lit(2)) == part))
    own = docs.filter("at is not null and content is not null and minute(at) % 2 = 0")
    store.put(COMPRESSED, own.select(X.content_id(F.col("content")).alias("key"), F.lit("short").alias("value"), "at"))
    store.compacted(NOW)
    paths = store.held(PATH, NOW).groupBy(F.col("value").alias("content_id")).agg(F.count(F.lit(1)).alias("paths"))
    rows = store.contents(NOW).join(store.cache(NOW), "content_id", "left").join(paths, "content_id", "left")
    return rows.select("content_id", F.length("original").cast("bigint").alias("chars"), F.coalesce("paths", F.lit(0)).cast("bigint").alias("paths"), F.col("compressed").isNotNull().alias("is_cached"))


@query(
    "pinned_blocks",
    """WITH d AS (SELECT doc_id, text, '/' || source AS path, substr(sha256(text), 1, 16) AS id FROM documents)
SELECT doc_id, coalesce(path IN (SELECT path FROM d WHERE doc_id = 3), false) OR coalesce(id IN (SELECT id FROM d WHERE doc_id % 13 = 0 AND text IS NOT NULL), false) AS pinned FROM d""",
)
def pinned_blocks(t: Tables) -> DataFrame:
    """Blocks whose path or content is pinned; pins outlive the time to live (ST3)."""
    docs = t("documents").select("doc_id", F.col("text").alias("content"), F.concat(F.lit("/"), "source").alias("path"), F.lit(START).alias("at"))
    store = ContentStore(t.spark, scratch.folder(t.spark, "pins"), 1)
    store.put(PINNED_PATH, docs.filter("doc_id = 3").select(F.col("path").alias("key"), F.lit("").alias("value"), "at"))
    store.put(PINNED_CONTENT, docs.filter("doc_id % 13 = 0").select(X.content_id(F.col("content")).alias("key"), F.lit("").alias("value"), "at"))
    store.compacted(NOW)
    return store.pinned(docs).select("doc_id", "pinned")


@query(
    "embedded_documents",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), b AS (
  SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS k, count(*) AS n FROM w GROUP BY 1, 2), s AS (
  SELECT doc_id, count(*) AS buckets, max(n) / sqrt(sum(n * n)) AS most, 1.0::DOUBLE AS norm FROM b GROUP BY 1)
SELECT doc_id, coalesce(buckets, 0)::BIGINT AS buckets, round(coalesce(most, 0), 6)::DOUBLE AS most, coalesce(norm, 0)::DOUBLE AS norm FROM documents LEFT JOIN s USING (doc_id)""",
)
def embedded_documents(t: Tables) -> DataFrame:
    """Facts of the vectors that the encoder without weights gives whole texts."""
    rows = t("documents").select("doc_id", tools.embedder(tools.hashed_words())(F.col("text")).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("doc_id", F.size(F.filter("v", lambda x: x > 0)).cast("bigint").alias("buckets"), F.round(F.array_max("v"), 6).alias("most"), F.round(norm, 6).alias("norm"))
