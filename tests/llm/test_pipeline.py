"""Each stage on awkward and on ordinary input, and the whole."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from loomline.llm import decontaminate, near_dedup, secrets
from loomline.llm.queries import QUERIES


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, data).cache()
        assert docs.columns == columns, name
        assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    assert near_dedup.near_duplicates(docs).filter("not kept").count() == 0
    assert decontaminate.find_leaks(docs, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0
    assert secrets.scan_secrets(docs).filter("spans <> ''").count() == 0
    assert all(len(r["text"]) == r["n_chars"] for r in docs.collect())
    pieces = P.STAGES[-1][1](spark, docs, data)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    # Where documents are cut depends on the partitions; what they hold does not.
    total = lambda df: {(r["doc_id"], r["n"]) for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total(P.run(spark, data)) == total(pieces)


def test_awkward(spark, data, awkward, empty):
    for name, stage in P.STAGES:
        assert stage(spark, empty, data).collect() == [], name
        out = stage(spark, awkward, data)
        assert out.count() >= 1, name
        assert name == "packing" or out.columns == awkward.columns
    kept = {r["doc_id"] for r in P.identify_language(spark, awkward, data).collect()}
    assert not kept & {1, 2, 3, 5} and {7, 8, 9} <= kept
    left = [r["doc_id"] for r in P.deduplicate(spark, awkward, data).collect()]
    assert left.count(8) == 1 and 9 not in left and left.count(None) == 1


def test_rows_of_one_id(spark, data):
    """Of rows that share a doc_id the one with the least text stays, if the document is kept."""
    rows = [(1, "b text of its own with more words", "en", "s", 1), (1, "a text of its own with other words", "en", "s", 2), (1, None, "en", "s", 0), (2, "c c c c c c", "en", "s", 3), (3, "c c c c c c", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((r["doc_id"], r["n_chars"]) for r in P.deduplicate(spark, docs, data).collect())
    assert left == [(1, 2), (2, 3)]
    assert sorted(r["doc_id"] for r in P.deduplicate(spark, docs.filter("doc_id > 1"), data).collect()) == [2]


def test_copies_alone_are_moved(spark, data):
    """Texts without a copy stay where they lie, whatever is broadcast: less than a text a document is shuffled in all."""
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(1500)) for _ in range(150)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate([*texts, *(f"{t} end" for t in texts[:5])])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).localCheckpoint()
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def moved():
        """Bytes of shuffles, by stage."""
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = set(moved())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = [r["doc_id"] for r in P.deduplicate(spark, docs, data).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(left) == list(range(150))
    assert sum(n for k, n in moved().items() if k not in before) < 0.5 * sum(map(len, texts))


def test_language_is_no_letter_filter(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = docs.limit(1).withColumn("doc_id", F.lit(10**9).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit("Это предложение на другом языке."))
    kept = {r["doc_id"] for r in P.identify_language(spark, docs.unionAll(odd), data).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_eleven_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
