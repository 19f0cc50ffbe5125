"""Settings, the store and the client that joins them with the operators."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomline.client import Loom
from loomline.settings import Settings, load
from loomline.sources.store import COMPRESSED, CONTENT, PATH, PINNED_CONTENT, PINNED_PATH, ContentStore

NOW = datetime(2024, 5, 1, 12)


def test_precedence(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"compression": {"min_tokens": 10, "max_tokens": 900}, "store": {"ttl_seconds": None}}))
    environ = {"LOOMLINE_COMPRESSION__MIN_TOKENS": "20", "LOOMLINE_HISTORY__ENABLED": "no", "LOOMLINE_TESTDATA": "/x", "OTHER": "1"}
    assert load(environ={}) == Settings() and load(str(tmp_path / "none.json"), environ={}) == Settings()
    assert load(str(path), environ={}).compression.min_tokens == 10
    own = load(str(path), environ)
    assert (own.compression.min_tokens, own.compression.max_tokens, own.history.enabled) == (20, 900, False)
    spark.conf.set("loomline.compression.min_tokens", "30")
    spark.conf.set("loomline.store.ttl_seconds", "60")
    try:
        own = load(str(path), environ, spark)
        assert (own.compression.min_tokens, own.store.ttl_seconds) == (30, 60)
    finally:
        spark.conf.unset("loomline.compression.min_tokens")
        spark.conf.unset("loomline.store.ttl_seconds")


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("history:\n  keep_recent_turns: 2\n  context_threshold: 0.5\n")
    (tmp_path / "empty.yaml").write_text("")
    assert load(str(tmp_path / "s.yaml"), {}).history.keep_recent_turns == 2
    assert load(str(tmp_path / "empty.yaml"), {}) == Settings()


@pytest.mark.parametrize(
    "given",
    [
        {"compresion": {}}, {"compression": {"min_token": 1}}, {"compression": 3}, {"compression": {"min_tokens": 60_000}}, {"compression": {"min_tokens": "x"}},
        {"compression": {"refusal_threshold": 1.5}}, {"compression": {"compressor": "none"}}, {"compression": {"min_tokens": 1.5}}, {"compression": {"min_tokens": None}},
        {"tool_selection": {"top_k": 0}}, {"history": {"keep_recent_turns": 0}}, {"history": {"enabled": "maybe"}}, {"store": {"ttl_seconds": 0}},
    ],
)
def test_wrong_settings_raise(given):
    with pytest.raises(ValueError):
        Settings().merged(given)


def entries(spark, *rows):
    return spark.createDataFrame(rows, "key string, value string, at timestamp")


def test_store(spark, tmp_path):
    store = ContentStore(spark, f"file://{tmp_path}/store", 60)
    held = lambda kind, now: sorted((r["key"], r["value"]) for r in store.held(kind, now).collect())
    assert held(CONTENT, NOW) == []
    store.put(COMPRESSED, entries(spark, ("a", "1", NOW), ("b", "1", NOW), (None, "x", NOW), ("", "y", NOW)))
    store.put(COMPRESSED, entries(spark, ("a", "2", NOW + timedelta(seconds=30)), ("b", "0", NOW), ("c", None, NOW)))
    assert held(COMPRESSED, NOW + timedelta(seconds=59)) == [("a", "2"), ("b", "1"), ("c", None)]
    assert held(COMPRESSED, NOW + timedelta(seconds=60)) == [("a", "2")]
    assert held(COMPRESSED, NOW + timedelta(seconds=90)) == []
    blocks = spark.createDataFrame([("x", "/p", NOW), ("y", "/p", NOW + timedelta(seconds=1)), ("x", None, NOW), (None, "/q", NOW)], "content string, path string, at timestamp")
    store.remember(blocks)
    assert sorted(r["original"] for r in store.contents(NOW).collect()) == ["x", "y"]
    ids = {r["original"]: r["content_id"] for r in store.contents(NOW).collect()}
    assert held(PATH, NOW) == [("/p", ids["y"])]
    store.put(PINNED_PATH, entries(spark, ("/z", "", NOW), ("/z", "", NOW)))
    store.put(PINNED_CONTENT, entries(spark, (ids["x"], "", NOW)))
    assert store.compacted(NOW + timedelta(seconds=60)) == 1
    assert store.entries(COMPRESSED).count() == 1 and held(CONTENT, NOW + timedelta(seconds=60)) == [(ids["y"], "y")]
    rows = spark.createDataFrame([(1, "x", "/p", True), (2, "y", "/z", True), (3, "y", None, True), (4, None, "/p", True)], "seq int, content string, path string, pinned boolean")
    assert sorted((r["seq"], r["pinned"]) for r in store.pinned(rows).collect()) == [(1, True), (2, True), (3, False), (4, False)]
    with pytest.raises(ValueError):
        store.put("other", entries(spark))


def test_client(spark, tmp_path):
    settings = Settings().merged({"compression": {"min_tokens": 5}, "store": {"path": f"file://{tmp_path}/store", "ttl_seconds": 60}, "history": {"keep_recent_turns": 1, "context_window": 10}})
    loom = Loom(spark, settings)
    code = "\n\n\n".join(f"import os\nvalue_{k} = {k}\n" for k in range(30))
    blocks = spark.createDataFrame([(1, code, "file_read", "L2", None, "/a.py"), (2, "short", "file_read", "L2", None, None)], "seq int, content string, kind string, level string, intent string, path string")
    first = {r["seq"]: r for r in loom.compress(blocks, NOW).collect()}
    assert first[1]["reason"] is None and not first[1]["cache_hit"] and first[2]["reason"] == "below_min_tokens"
    again = {r["seq"]: r for r in loom.compress(blocks, NOW + timedelta(seconds=30)).collect()}
    assert again[1]["cache_hit"] and again[1]["output"] == first[1]["output"]
    late = {r["seq"]: r for r in loom.compress(blocks, NOW + timedelta(hours=1)).collect()}
    assert not late[1]["cache_hit"]
    calls = spark.createDataFrame([(json.dumps({"id": first[1]["content_id"]}),), (json.dumps({"id": "0" * 16}),)], "tool_input string")
    told = [r["content"] for r in loom.resolve(calls, NOW + timedelta(hours=1)).collect()]
    assert code in told and any("no longer be expanded" in c or "can no longer" in c for c in told)
    ranked = spark.createDataFrame([("q", f"mcp__t{k}", "d", 1.0 - k / 10, k) for k in range(9)], "q string, name string, description string, score double, rank int")
    fates = {r["name"]: r["fate"] for r in loom.select_tools(ranked, ["q"], F.lit(False)).collect()}
    assert fates["mcp__t0"] == "keep" and fates["mcp__t8"] == "stub" and len(fates) == 9
    talk = spark.createDataFrame([("c", 1, "user", "x" * 100), ("c", 2, "assistant", "y" * 100), ("c", 3, "user", "z" * 100)], "c string, n int, role string, text string")
    assert [r["folded"] for r in loom.fold_history(talk, ["c"], "n").orderBy("n").collect()] == [True, True, False]
    off = Loom(spark, settings.merged({"history": {"enabled": False}, "store": {"path": ""}}))
    assert not any(r["folded"] for r in off.fold_history(talk, ["c"], "n").collect())
    assert off.compress(blocks, NOW).filter("cache_hit").count() == 0
    with pytest.raises(ValueError):
        off.resolve(calls)


def test_embedder(spark):
    from loomline.operators import tools

    rows = spark.createDataFrame([(1, "read the file"), (2, "file read the"), (3, ""), (4, None), (5, "other words")], "id long, text string")
    own = rows.select("id", tools.embedder(tools.hashed_words(64))(F.col("text")).alias("v"))
    got = {r["id"]: r["v"] for r in own.collect()}
    assert got[1] == got[2] != got[5] and got[3] == got[4] == [0.0] * 64
    best = tools.nearest(own.filter("id = 1"), own, 2).orderBy("rank").collect()
    assert [r["item_id"] for r in best] == [1, 2] and abs(best[1]["score"] - 1) < 1e-9
