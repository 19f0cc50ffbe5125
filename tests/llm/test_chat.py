"""Snapshot collapse against comparing whole turn lists, and the SQL oracle."""

import random

from loomline.llm import chat
from tests.compare import connect, same


def turns(spark, conversations):
    rows = [(c, k, r, t) for c, ts in conversations for k, (r, t) in enumerate(ts)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def brute(conversations):
    lists = {c: tuple(ts) for c, ts in conversations}
    out = {}
    for ts in set(lists.values()):
        if not any(len(o) > len(ts) and o[: len(ts)] == ts for o in lists.values()):
            own = [c for c, o in lists.items() if o == ts]
            out[min(own)] = (len(ts), len(own))
    return out


def test_brute_force(spark):
    rng = random.Random(1)
    whole = [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for _ in range(rng.randrange(1, 6))] for _ in range(60)]
    snapshots = [w[: rng.randrange(1, len(w) + 1)] for w in whole for _ in range(3)]
    conversations = list(enumerate(whole + snapshots + [whole[0]] * 40))
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chat.format_chats(turns(spark, conversations)).collect()}
    assert got == brute(conversations)


def test_rendering(spark):
    df = turns(spark, [(1, [("user", "hi"), ("assistant", "yo")]), (2, [("user", "hi")]), (3, [(None, None)])])
    got = {r["conv_id"]: r["rendered"] for r in chat.format_chats(df).collect()}
    assert got == {1: "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n", 3: "<|unknown|>\n\n<|end|>\n"}


def test_oracle(spark, data):
    same(chat.format_chats(spark.read.parquet(f"{data}/conversations.parquet")), chat.ORACLE, connect(data))


def test_awkward(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "user", "y"), (None, 5, "user", "y"), (None, 0, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, None, None, None), (3, 0, "user", "long " * 20_000), (4, 0, "a", "tie"), (4, 0, "b", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS k", "'x' AS a", "'y' AS h1", "2 AS n_turns", "'q' AS rendered")
    got = sorted((r["conv_id"] or 0, r["n_turns"], r["n_copies"], r["rendered"][:12]) for r in chat.format_chats(df).collect())
    assert got == [(0, 1, 2, "<|user|>\ny\n<"), (1, 1, 2, "<|user|>\nx\n<"), (2, 1, 2, "<|unknown|>\n"), (3, 1, 1, "<|user|>\nlon"), (4, 2, 1, got[-1][3])]


def test_the_two_hashes_are_no_function_of_one_another(spark):
    """A hash of a hash would be 64 bits told twice."""
    from pyspark.sql import functions as F

    one = spark.range(1).select(F.xxhash64(F.lit(1), F.lit("x")).alias("a"), F.xxhash64(F.lit("x")).alias("h"))
    assert one.filter(F.col("a") == F.xxhash64(F.lit("x"), F.lit(1))).count() == 0
    plan = chat.collapse(turns(spark, [(1, [("user", "x")])]))._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(1, " in plan and "xxhash64(2, " in plan


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df.limit(0)).collect() == []
