"""As-of evaluation against scanning the list for every capture, and the SQL oracle."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomline.llm import queries, url_filter
from tests.compare import connect, same

START = datetime(2024, 1, 1)


def brute(url, at, entries):
    host = url.split("://")[1].split("/")[0].lower() if url and "://" in url else None
    labels = host.split(".") if host else []
    for name in [".".join(labels[k:]) for k in range(len(labels))] if at else []:
        dated = sorted((t, a) for d, a, t in entries if d == name and t <= at)
        if dated:
            action = min(a for t, a in dated if t == dated[-1][0])
            if action != "remove":
                return name, action
    return None, None


def test_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.y.z.w.example.com", "q.x.y.z.w.example.com", "other.org", "www.other.org", "org"]
    entries = [(rng.choice(hosts), rng.choice(["block", "allow", "remove"]), START + timedelta(days=rng.randrange(20))) for _ in range(40)]
    captures = [(i, f"http://{rng.choice(hosts)}/p", START + timedelta(hours=rng.randrange(500))) for i in range(300)] + [(900, None, START), (901, "not a url", START), (902, "http://other.org/", None)]
    e = spark.createDataFrame(entries, "domain string, action string, listed_at timestamp")
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp")
    for size in (url_filter.BROADCAST_BYTES, 0):
        got = {r["page_id"]: (r["listed_domain"], r["action"], r["kept"]) for r in url_filter.evaluate(c, e, size).collect()}
        for i, url, at in captures:
            name, action = brute(url, at, entries)
            assert got[i] == (name, action, action != "block"), (i, url, at)


def test_parents_of_any_length(spark):
    e = spark.createDataFrame([("a.b.c.d.example", "block", START), ("TOP", "block", START)], "domain string, action string, listed_at timestamp")
    c = spark.createDataFrame([(1, "http://x.a.b.c.d.example/", START), (2, "http://any.thing.top", START)], "page_id long, url string, fetched_at timestamp")
    assert {r["page_id"]: (r["listed_domain"], r["kept"]) for r in url_filter.evaluate(c, e).collect()} == {1: ("a.b.c.d.example", False), 2: ("top", False)}


def test_runs_of_one_action_are_one_interval(spark):
    days = [(0, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "block")]
    e = spark.createDataFrame([("a.b", a, START + timedelta(days=d)) for d, a in days], "domain string, action string, listed_at timestamp")
    got = sorted((r["valid_from"].day - 1, r["action"], r["valid_to"] and r["valid_to"].day - 1) for r in url_filter.intervals(e).collect())
    assert got == [(0, "block", 2), (2, "allow", 4), (4, "block", None)]


def test_hosts(spark):
    urls = ["HTTP://User:pw@WWW.A.com:80/x", "https://a.com.", "http://", "a.com/x", None, "http://a.com?q", "ftp://h#f"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", url_filter.host(F.col("u")).alias("h"))
    assert [r["h"] for r in df.orderBy("i").collect()] == ["www.a.com", "a.com", None, None, None, "a.com", "h"]


def test_oracle(spark, data):
    same(queries.op8_url_filter(spark, data), url_filter.ORACLE, connect(data))


def test_awkward(spark):
    c = spark.createDataFrame([(1, "http://a.b/", START)] * 2, "page_id long, url string, fetched_at timestamp")
    e = spark.createDataFrame([(None, "block", START), ("a.b", None, START), ("a.b", "block", None)], "domain string, action string, listed_at timestamp")
    assert [r["kept"] for r in url_filter.evaluate(c, e).collect()] == [True, True]
    assert url_filter.evaluate(c.limit(0), e).collect() == [] and url_filter.evaluate(c, e.limit(0)).count() == 2
    more = c.selectExpr("*", "'x' AS domain", "'y' AS history", "1 AS salt", "2 AS level", "'z' AS host", "'z' AS action", "0 AS kept")
    for size in (url_filter.BROADCAST_BYTES, 0):
        out = url_filter.evaluate(more, e, size)
        assert out.columns == ["page_id", "url", "fetched_at", "domain", "history", "salt", "level", "host", "listed_domain", "action", "kept"]
        assert [r["host"] for r in out.collect()] == ["a.b", "a.b"]
