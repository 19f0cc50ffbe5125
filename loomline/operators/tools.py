"""Tool selection: keyword and vector scores, top-k, whitelists, stubs, retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as X

# Fixed values.
WHITELIST = ("Read", "Grep", "Glob", "Bash", "Edit", "Write")
#: An agent cannot act without these: no selection takes them away.
CORE = ("shell", "shell_command", "local_shell", "container.exec", "exec", "bash", "apply_patch", "run_terminal_cmd", "str_replace_editor", "editor")
TOP_K, SESSION_K, DYNAMIC_LEAST, DYNAMIC_MOST, ALPHA = 5, 8, 5, 20, 0.9
MCP_THRESHOLD = 1.0
LEAST_TOOLS = 5
VECTOR_BLOCK = 8 << 20
#: Text of queries that meets all rows at once; rows scored at once; words whose weights a task remembers.
KEYWORD_BLOCK, KEYWORD_ROWS, KEYWORD_MEMO = 256 << 10, 512, 1 << 18


def tool_text(tool: Column) -> Column:
    """What of a tool is searched: name, description, parameters and their descriptions."""
    props = F.transform(F.map_entries(tool["properties"]), lambda e: F.concat_ws(" ", e["key"], e["value"]["description"]))
    return F.concat_ws(" ", tool["name"], tool["description"], F.array_join(props, " "))


def keyword_scores(pairs: DataFrame, query: str, text: str, name: str) -> DataFrame:
    """``score`` of each (query, tool) row."""
    rows = pairs.withColumns({"_q": X.keywords(F.col(query)), "_t": X.keywords(F.col(text)), "_n": X.keywords(F.col(name))})
    empty = (F.size("_q") == 0) | (F.size("_t") == 0)
    return rows.withColumn("score", F.when(empty, 0.0).otherwise(X.keyword_score(F.col("_q"), F.col("_t"), F.col("_n")))).drop("_q", "_t", "_n")


def _pieces(word: Column, most: Column) -> Column:
    """Distinct substrings of at most ``most`` characters."""
    n = F.length(word)
    of = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(word, i, k))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, most)), of)))


def keyword_search(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``item_id, doc_id, score`` of all pairs of ``queries(item_id, q)`` and ``docs(doc_id, d, name)`` that score above 0.

    As :func:`keyword_scores`, but by equality: what one word of a query and one of
    a document add is found once for distinct words, words that hold others by
    their substrings.
    """
    q = queries.select("item_id", F.explode(X.keywords(F.col("q"))).alias("qw"))
    t = docs.select("doc_id", "name", F.explode(X.keywords(F.col("d"))).alias("tw"))
    query_words, words = q.select("qw").distinct(), t.select("tw").distinct()
    longest = query_words.agg(F.max(F.length("qw"))).first()[0] or 0
    inside = words.select("tw", F.explode(_pieces(F.col("tw"), F.lit(longest))).alias("qw")).join(query_words, "qw")
    around = query_words.select("qw", F.explode(_pieces(F.col("qw"), F.length("qw"))).alias("tw")).filter("qw <> tw").join(words, "tw")
    pairs = inside.select("qw", "tw", F.when(F.col("qw") == F.col("tw"), 2.0).otherwise(0.5).alias("w")).unionByName(around.select("qw", "tw", F.lit(0.5).alias("w")))
    weights = q.join(pairs, "qw").groupBy("item_id", "tw").agg(F.sum("w").alias("w"))
    shared = t.join(weights, "tw").select("item_id", "doc_id", "w")
    names = docs.select("name").distinct().select("name", F.explode(X.keywords(F.col("name"))).alias("qw"))
    named = q.join(names, "qw").groupBy("item_id", "name").agg((3.0 * F.count(F.lit(1))).alias("w"))
    worded = docs.filter(F.size(X.keywords(F.col("d"))) > 0).select("doc_id", "name")
    return shared.unionByName(worded.join(named, "name").select("item_id", "doc_id", "w")).groupBy("item_id", "doc_id").agg(F.sum("w").alias("score"))


class _Keywords(dict):
    """Keywords of an identifier, as :func:`loomline.functions.text.keywords` takes them, remembered."""

    def __init__(self, most: int) -> None:
        import re

        self.most, self.word, self.part = most, re.compile("[a-zA-Z_][a-zA-Z0-9_]*").findall, re.compile("[a-z]+|[A-Z][a-z]*").findall

    def __missing__(self, word: str) -> set[str]:
        if len(self) >= self.most:
            self.clear()
        own = {word.lower(), *(p.lower() for p in self.part(word) if len(p) > 1)}
        self[word] = own.difference(X.STOP_WORDS)
        return self[word]

    def of(self, text: str | None) -> set[str]:
        return set().union(*(self[w] for w in set(self.word(text or ""))))


class _Weights:
    """What the words of a row add to the score of each query of a block, in halves."""

    SHORT = 32  # of longer query words the pieces are not listed but looked for

    def __init__(self, queries: list[list[str]], most: int) -> None:
        import numpy as np

        self.n, self.most = len(queries), most
        holders: dict[str, list[int]] = {}
        for i, own in enumerate(queries):
            for w in own:
                holders.setdefault(w, []).append(i)
        self.words = list(holders)
        self.number = {w: k for k, w in enumerate(self.words)}
        self.queries, self.size = np.concatenate([np.array(q) for q in holders.values()]), np.array([len(q) for q in holders.values()])
        self.first = np.cumsum(self.size) - self.size
        self.lengths = sorted({len(w) for w in holders})
        self.text = "\n".join(self.words)
        self.ends = np.cumsum([len(w) + 1 for w in self.words]).tolist()
        self.pieces = {w[i:j] for w in holders if len(w) <= self.SHORT for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        self.long = "\n".join(w for w in holders if len(w) > self.SHORT)
        self.memo: dict[str, list[int]] = {}

    def related(self, word: str) -> set[int]:
        """Numbers of the query words that the word holds or that hold it, its own among them."""
        from bisect import bisect_right

        n, number = len(word), self.number
        found = {number[part] for k in self.lengths if k <= n for i in range(n - k + 1) if (part := word[i : i + k]) in number}
        if n < self.lengths[-1] and (word in self.pieces or word in self.long):
            at = self.text.find(word)
            while at >= 0:
                k = bisect_right(self.ends, at)
                found.add(k)
                at = self.text.find(word, self.ends[k])
        return found

    def of(self, word: str) -> list[int]:
        """Numbers of query words, once for each half that the word adds: the same word adds 2, others .5."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            found = list(self.related(word))
            if word in self.number:
                found += 3 * [self.number[word]]
            self.memo[word] = found
        return found

    def score(self, words: set[str], name: set[str]):
        import numpy as np

        halves = [k for w in words for k in self.of(w)]
        if words:
            halves += [self.number[w] for w in name if w in self.number for _ in range(6)]
        if not halves:
            return np.zeros(self.n)
        count = np.bincount(halves)
        met = np.flatnonzero(count)
        size = self.size[met]
        at = np.repeat(self.first[met] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.queries[at], np.repeat(count[met], size), self.n) / 2


def _best_by_keywords(queries: list[tuple], k: int, at_once: int, memo: int):
    """The ``k`` best rows of a partition for each query of a block, as :func:`_best`."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weights, keywords, ids = _Weights([words for _, words in queries], memo), _Keywords(memo), np.array([i for i, _ in queries], np.int64)
        held = [np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)]
        for batch in batches:
            for first in range(0, batch.num_rows, at_once):
                doc, texts, names = (c.to_pylist() for c in batch.slice(first, at_once).columns)
                scores = np.array([weights.score(keywords.of(t), keywords.of(m)) for t, m in zip(texts, names, strict=True)])
                own = np.hstack([held[1], np.tile(np.array(doc, np.int64), (len(ids), 1))])
                score = np.hstack([held[0], scores.T])
                order = np.lexsort((own, -score), axis=1)[:, :k]
                held = [np.take_along_axis(score, order, 1), np.take_along_axis(own, order, 1)]
        n = held[0].shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(held[1].ravel()), pa.array(held[0].ravel())], names=["item_id", "doc_id", "score"])

    return run


def keyword_best(queries: DataFrame, docs: DataFrame, k: int, block: int = KEYWORD_BLOCK, at_once: int = KEYWORD_ROWS, memo: int = KEYWORD_MEMO) -> DataFrame:
    """``item_id, doc_id, score, rank``: the ``k`` best rows of ``docs(doc_id, d, name)`` for each of ``queries(item_id, q)``.

    Scores are those of :func:`keyword_scores`; rows of score 0 are none, ties go by
    doc_id.  Queries go out in blocks of bounded text and meet all rows in one map
    pass a block; a partition keeps ``k`` a query, so neither pairs nor words are
    shuffled.  Rows without an id are left out.
    """
    spark = docs.sparkSession
    own = queries.filter("item_id is not null").select("item_id", X.keywords(F.col("q")).alias("words"))
    size = own.agg(F.sum(F.octet_length(F.array_join("words", " ")))).first()[0] or 0
    blocks = max(1, -(-size // block))
    rows = docs.filter("doc_id is not null").select("doc_id", "d", "name")
    schema = "item_id long, doc_id long, score double"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        asked = own.filter((F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) & (F.size("words") > 0)).orderBy("item_id").collect()
        if asked:
            out = out.unionAll(rows.mapInArrow(_best_by_keywords([(r[0], list(r[1])) for r in asked], k, at_once, memo), schema))
    return top_k(out.filter("score > 0"), ["item_id"], k, pos="doc_id").filter("kept").drop("kept")


def top_k(scored: DataFrame, by: list[str], k: int, score: str = "score", pos: str = "pos", positive: bool = False) -> DataFrame:
    """``rank`` from 0 and ``kept``: the ``k`` best of each query, ties by position."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), pos)
    rows = scored.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))
    kept = F.col("rank") < k
    return rows.withColumn("kept", kept & (F.col(score) > 0) if positive else kept)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """A vector of length one; a vector of zeros stays."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def _best(queries: list[tuple], k: int):
    """The ``k`` nearest rows of a partition to each query vector of a block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids = [q[0] for q in queries]
        q = np.array([q[1] for q in queries], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        held = [np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            sim = np.hstack([held[0], q @ v.T])
            own = np.hstack([held[1], np.tile(batch.column(0).to_numpy(), (len(ids), 1))])
            order = np.lexsort((own, -sim), axis=1)[:, :k]
            held = [np.take_along_axis(sim, order, 1), np.take_along_axis(own, order, 1)]
        n = held[0].shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(held[1].ravel()), pa.array(held[0].ravel())], names=["query_id", "item_id", "score"])

    return run


def nearest(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The ``k`` items nearest to each query by cosine: ``query_id, item_id, score, rank``.

    Both sides are ``(id, vector)``.  Queries go out in blocks of bounded size and
    meet all items; each partition keeps ``k`` a query, so what is shuffled is
    queries times partitions times ``k``, never all pairs.  Ties by item id.
    """
    spark = items.sparkSession
    q_id, q_v = queries.columns
    size = queries.agg(F.sum(8 * F.size(q_v))).first()[0] or 0
    blocks = max(1, -(-size // VECTOR_BLOCK))
    out = spark.createDataFrame([], "query_id long, item_id long, score double")
    for b in range(blocks):
        rows = [(r[0], list(r[1])) for r in queries.filter(F.pmod(F.xxhash64(q_id), F.lit(blocks)) == b).orderBy(q_id).collect()]
        if rows:
            out = out.unionAll(items.mapInArrow(_best(rows, k), "query_id long, item_id long, score double"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return out.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).filter(F.col("rank") < k)


def embedder(load: Callable[[], Callable[[list[str]], object]]) -> Callable[[Column], Column]:
    """A column function from text to a vector of length one.

    ``load`` runs once a task and gives the encoder: a function from texts to a matrix.
    A null text is an empty one; a vector of zeros stays.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        encode = load()
        for texts in batches:
            v = np.asarray(encode(texts.fillna("").tolist()), np.float64)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if len(v) else v
            yield pd.Series(list(v), dtype="object")

    return run


def hashed_words(dimensions: int = 256) -> Callable[[], Callable[[list[str]], object]]:
    """An encoder without weights: words counted in buckets of their MD5."""

    def load():
        import re
        from hashlib import md5

        import numpy as np

        words = re.compile("[a-z0-9]+").findall

        def encode(texts: list[str]):
            out = np.zeros((len(texts), dimensions))
            for row, text in zip(out, texts, strict=True):
                for w in words(text.lower()):
                    row[int(md5(w.encode()).hexdigest()[:8], 16) % dimensions] += 1
            return out

        return encode

    return load


def dynamic_k(ranked: DataFrame, by: list[str], alpha: float = ALPHA, least: int = DYNAMIC_LEAST, most: int = DYNAMIC_MOST) -> DataFrame:
    """``kept``: items whose score is near the best, at least and at most so many."""
    best = F.max("score").over(Window.partitionBy(*by))
    return ranked.withColumn("kept", (F.col("rank") < least) | ((F.col("score") >= alpha * best) & (F.col("rank") < most)))


def with_whitelist(ranked: DataFrame, by: list[str], wanted: Column, k: int = SESSION_K, whitelist: tuple[str, ...] = WHITELIST, name: str = "name") -> DataFrame:
    """Where ``wanted``, listed tools come first, then the best others, ``k`` in all."""
    listed = F.when(wanted & F.col(name).isin(*whitelist), 0).otherwise(1)
    w = Window.partitionBy(*by).orderBy(listed, "rank")
    return ranked.withColumn("place", (F.row_number().over(w) - 1).cast("int")).withColumn("kept", F.col("place") < k)


def selected(ranked: DataFrame, by: list[str], wanted: Column, alpha: float = ALPHA, least: int = DYNAMIC_LEAST, most: int = DYNAMIC_MOST, name: str = "name") -> DataFrame:
    """``place`` and ``kept``: whitelisted tools first where ``wanted``, then those near the best.

    ``ranked`` has ``score`` and ``rank`` from 0 by falling score.  Others follow in
    order as long as their score is at least ``alpha`` of the best, or fewer than
    ``least`` tools are chosen; ``most`` in all.  ``least`` tools or fewer all stay.
    """
    whole = Window.partitionBy(*by)
    place = F.coalesce(F.array_position(F.array(*map(F.lit, WHITELIST)), F.col(name)), F.lit(0))
    listed = F.coalesce(wanted, F.lit(False)) & (place > 0)
    rows = ranked.withColumns({"_listed": listed, "_n": F.count(F.lit(1)).over(whole), "_best": F.max("score").over(whole)})
    order = whole.orderBy(F.desc("_listed"), F.when(F.col("_listed"), place).otherwise(F.col("rank")))
    rows = rows.withColumn("place", (F.row_number().over(order) - 1).cast("int"))
    near = F.col("_listed") | (F.col("score") >= alpha * F.col("_best")) | (F.col("place") < least)
    return rows.withColumn("kept", (F.col("_n") <= least) | (near & (F.col("place") < most))).drop("_listed", "_n", "_best")


def is_mcp(name: Column) -> Column:
    return name.startswith("mcp__")


def mcp_signal(ranked: DataFrame, by: list[str], name: str = "name", rank: str = "rank") -> DataFrame:
    """Weight of MCP tools in a selection: 3 in the first three places, 1 in the next three, .3 after."""
    weight = F.when(F.col(rank) < 3, 3.0).when(F.col(rank) < 6, 1.0).otherwise(0.3)
    return ranked.groupBy(*by).agg(F.round(F.sum(F.when(is_mcp(F.col(name)), weight).otherwise(0.0)), 6).alias("signal"))


def applied(tools: DataFrame, signal: DataFrame, by: list[str], threshold: float = MCP_THRESHOLD) -> DataFrame:
    """What becomes of each tool: ``keep``, ``stub`` or ``drop``.

    Fewer than five tools pass as they are, and so do core tools, whether the
    selection kept them or not; tools that are not kept are stubbed only if they are
    MCP tools and the selection's signal is strong enough.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = tools.join(signal, by, "left").withColumn("_n", n)
    fate = F.when((F.col("_n") < LEAST_TOOLS) | F.col("kept") | F.col("name").isin(*CORE), "keep").when(is_mcp(F.col("name")) & (F.coalesce("signal", F.lit(0.0)) >= threshold), "stub").otherwise("drop")
    description = F.concat(F.lit("[deferred] "), F.substring(F.coalesce("description", F.lit("")), 1, 48), F.lit(" — call to load full schema."))
    return rows.withColumn("fate", fate).withColumn("description", F.when(F.col("fate") == "stub", description).otherwise(F.col("description"))).drop("_n", "signal")


def filtered_stub(description: Column) -> Column:
    """Description of a tool that was filtered out but can be searched."""
    return F.concat(F.lit("[Filtered] "), F.substring(F.coalesce(description, F.lit("")), 1, 80), F.lit(". Use gateway_search_tools to access."))


def recall_at(picked: DataFrame, gold: DataFrame, by: str, name: str) -> DataFrame:
    """By query: whether all gold items are picked, and how many were kept."""
    hits = gold.join(picked.select(by, name).withColumn("_hit", F.lit(1)), [by, name], "left").groupBy(by).agg((F.count("_hit") == F.count(F.lit(1))).alias("all_found"))
    return hits.join(picked.groupBy(by).agg(F.count(F.lit(1)).alias("n_kept")), by, "left")


def agreement(a: DataFrame, b: DataFrame, by: str, name: str) -> DataFrame:
    """Jaccard similarity of two selections of each query, and whether they are identical."""
    sets = [x.groupBy(by).agg(F.collect_set(name).alias(f"_{k}")) for k, x in enumerate((a, b))]
    rows = sets[0].join(sets[1], by, "full_outer").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("_0", "_1")})
    union = F.size(F.array_union("_0", "_1"))
    return rows.select(by, F.when(union > 0, F.size(F.array_intersect("_0", "_1")) / union).otherwise(1.0).alias("jaccard"), (F.array_sort("_0") == F.array_sort("_1")).alias("identical"))
